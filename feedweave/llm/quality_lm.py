"""Quality by the perplexity of an interpolated modified Kneser-Ney bigram model, trained on trusted text.

Words are runs of anything but space and 0x09-0x0D. Each language has its own
model over a closed vocabulary: all words that its trusted text uses twice or
more, all others by their shape (lower case, capitals, digits, symbols, ...) and
their spelling (byte pairs of such words), and a start mark. Neither words nor
languages are limited; an id is a 64-bit hash of language and word.

* Texts are encoded once, in slices of about SCORED_BYTES: a slice has its
  distinct words once, and its documents as places among these.
* Vocabulary, unigrams and pairs are tables that grow with the corpus and stay
  sharded. A slice sends its distinct words to their shards, which answer
  which of them are in the vocabulary, with their log(weight) and log(p).
* Interpolation makes the score of an unseen pair a sum of two parts that
  depend on one word each: log(weight of v) + log(p(w)), summed at the slice.
* What seen pairs add to that comes from the pair table: a slice sends its
  distinct pairs, sorted, to their shards, which answer how often each model
  has them; the slice knows all else, and sums up each document.
* Slices are scored in at most PARTS parts, one after the other: a part's
  shuffle files go before the next one's are written.
* The models share one table each of words, pairs and ids: a row has a column
  for each model, so what several models have alike is moved once. An id or
  pair that only some of them have (a word may be in the vocabulary of one
  model and a shape to another) counts 0 for the others.
* What is broadcast has a few numbers, eight shapes and at most 65,536 byte
  pairs for each language.
* Of the trusted documents one in ``HELD_OUT`` is kept out of training. The
  others are held out in turn, by models that are trained without a third of
  them (cross-validation), so each trusted document has a held-out perplexity.
  How far these lie above their model's mean gives each language its threshold,
  a high quantile; a language with few of them takes that of all languages. A short text's mean is drawn towards its language's mean by
  PRIOR_WORDS words.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedweave.llm import batches, hashing
from feedweave.llm.batches import broadcast_if_small, unused, written

#: Different ids that words can have; nothing else bounds a vocabulary.
VOCABULARY = 1 << 64
#: Shapes of words outside the vocabulary; 0 is the start of a text.
SHAPES = 8
#: Of the trusted documents one in so many is fold 0; the others are dealt to folds 1 to FOLDS - 1. Model k is trained without fold k; model 0 judges.
HELD_OUT, FOLDS = 10, 4
QUANTILE, PRIOR_WORDS = 0.99, 20
#: A language's own quantile needs so many held-out documents; one with fewer takes that of all languages, if it is higher.
LEAST_HELD_OUT = 5
#: Pairs sent to one shard, about; bytes of text in a slice; parts that slices are scored in, and bytes of text of one, if there are fewer.
SHARD_PAIRS, SCORED_BYTES = 1 << 22, 8 << 20
PARTS, PART_BYTES = 4, 32 << 20
#: Rows of the pair table that are packed together.
_PACKED_ROWS = 1 << 20
#: Bytes of an id or pair that are sent to its shard.
_SENT = 6
_MASK = np.uint64((1 << 8 * _SENT) - 1)
#: Tells a row's scores by another model from those by model 0.
_OTHER = 0x123456789ABCDEF

_KIND = np.full(256, 3, dtype=np.uint8)  # 0 lower or not ASCII, 1 upper, 2 digit, 3 symbol
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 0, 1, 2, 0


def shapes(words: hashing.Words) -> np.ndarray:
    """1 lower, 2 one capital first, 3 capitals, 4 mixed, 5 with digits, 6 symbols only, 7 symbols inside or several."""
    raw = np.frombuffer(words.data, dtype=np.uint8)
    kind = _KIND[raw]
    counts = []
    for k in range(4):
        total = np.zeros(len(raw) + 1, dtype=np.int32)
        np.cumsum(kind == k, out=total[1:])
        counts.append(total[words.end] - total[words.start])
    lower, upper, digit, symbol = counts
    inner = symbol - (kind[words.end - 1] == 3)
    first_upper = kind[words.start] == 1
    return np.select([lower + upper + digit == 0, inner > 0, digit > 0, (lower == 0) & (upper > 1), first_upper & (upper == 1), upper == 0], [6, 7, 5, 3, 2, 1], 4).astype(np.int64)


def key(words: np.ndarray, language: np.ndarray) -> np.ndarray:
    """Ids of words by their hashes; the start of a text and the shapes have 0 to SHAPES - 1 for a hash."""
    return hashing.mix(words.astype(np.uint64) + (language + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def pair_key(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return hashing.mix(first * np.uint64(0xD6E8FEB86659FD93) + second)


def discounts(n: list[int]) -> tuple[float, float, float]:
    """For counts of 1, 2, and 3 or more, from how many entries have the counts 1 to 4."""
    n1, n2, n3, n4 = n
    if not n1 or not n2:
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    raw = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5
    return tuple(min(max(d, 0.05), k - 0.05) for k, d in enumerate(raw, 1))


class Model:
    """By number of language: discounts, and what ids score that the tables don't have. A few numbers for each language."""

    def __init__(self, pair_counts: np.ndarray, before: np.ndarray, words: np.ndarray):
        """pair_counts: pairs seen 1 to 4 times; before: how many ids have 1, 2, 3, 4, and 3 or more different words before them, and the sum over all ids; words: the vocabulary's size."""
        self.discount = np.array([discounts(list(map(int, row))) for row in pair_counts]).reshape(-1, 3)
        self.low = np.array([discounts(list(map(int, row[:4]))) for row in before]).reshape(-1, 3)
        self.all_pairs = np.maximum(before[:, 5], 1).astype(float)
        cut = (self.low * before[:, [0, 1, 4]]).sum(axis=1)
        self.trained = before[:, 5] > 0
        self.rest = np.where(before[:, 5] > 0, cut / self.all_pairs, 1.0) / (SHAPES + words)

    def log_weight(self, language: np.ndarray, total: np.ndarray, kinds: list[np.ndarray]) -> np.ndarray:
        """kinds: how many pairs begin with the id that were seen once, twice, and more often."""
        weight = (self.discount[language] * np.stack(kinds, axis=1)).sum(axis=1) / np.maximum(total, 1)
        # a word that nothing followed gives all its weight to the lower order
        return np.log(np.where(total > 0, np.maximum(weight, 1e-9), 1.0))

    def log_p(self, language: np.ndarray, before: np.ndarray) -> np.ndarray:
        cut = np.where(before > 0, self.low[language, np.clip(before, 1, 3) - 1], 0.0)
        return np.log((before - cut) / self.all_pairs[language] + self.rest[language])

    def seen_gain(self, language: np.ndarray, n: np.ndarray, total: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """How much more a seen pair scores than an unseen one of the same words, whose logarithm is lower."""
        cut = self.discount[language, np.minimum(n, 3) - 1]
        return np.log((n - cut) / total + np.exp(lower)) - lower


class Spelling:
    """log p(byte | byte before) by language, from the byte pairs (language << 16 | before << 8 | byte) that were seen."""

    def __init__(self, pairs: np.ndarray, n: np.ndarray):
        order = np.argsort(pairs)
        self.pairs, n = pairs[order], n[order].astype(float)
        self.before, at = np.unique(self.pairs >> 8, return_inverse=True)
        total = np.bincount(at, n, len(self.before)) + 256 * 0.05
        self.seen, self.unseen = np.log((n + 0.05) / total[at]), np.log(0.05 / total)

    def score(self, pairs: np.ndarray) -> np.ndarray:
        out = np.full(len(pairs), -math.log(256))
        if len(self.pairs):
            at = np.minimum(np.searchsorted(self.before, pairs >> 8), len(self.before) - 1)
            out = np.where(self.before[at] == pairs >> 8, self.unseen[at], out)
            at = np.minimum(np.searchsorted(self.pairs, pairs), len(self.pairs) - 1)
            out = np.where(self.pairs[at] == pairs, self.seen[at], out)
        return out


def _pack(values: np.ndarray) -> bytes:
    """The last _SENT bytes of these, best if sorted by them."""
    return _squeezed(np.diff(values & _MASK, prepend=np.uint64(0)))


def _unpack(packed: bytes) -> np.ndarray:
    return np.cumsum(_loosened(packed, "<u8"), dtype=np.uint64)


def _squeezed(values: np.ndarray) -> bytes:
    """Compressed, all first bytes before all second bytes and so on."""
    planes = np.ascontiguousarray(np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T).tobytes()
    return len(planes).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def _loosened(squeezed: bytes, kind: str) -> np.ndarray:
    planes = pa.decompress(squeezed[8:], int.from_bytes(squeezed[:8], "little"), "zstd", asbytes=True)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(size, -1).T).view(kind).reshape(-1)


_SLICE = "slice long, fold int, rows binary, lengths binary, languages binary, places binary, shapes binary, letters binary, sizes binary"


_WORDS = ["places", "lengths", "languages", "letters", "sizes"]


def _encoded(batch: pa.RecordBatch, number: dict[str, int]) -> tuple:
    """A slice of texts (text, lang, row) as columns of _SLICE from rows on. Texts of languages without a model have no words."""
    langs = np.array([number.get(x, -1) for x in batch.column(1).to_pylist()], dtype=np.int64)
    texts = [t if x >= 0 else b"" for t, x in zip(batches.as_bytes(batch.column(0)), langs, strict=True)]
    found = hashing.Words(texts)
    lengths = np.diff(found.first)
    _, at, places, times = np.unique(key(found.hash, np.repeat(langs, lengths)), return_index=True, return_inverse=True, return_counts=True)
    # frequent words first: most places are small numbers
    order = np.argsort(-times, kind="stable")
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    at, places = at[order], rank[places]
    shape = shapes(found)[at] if len(at) else np.zeros(0, dtype=np.int64)
    size = found.end[at] - found.start[at]
    letters = np.frombuffer(found.data, dtype=np.uint8)[np.repeat(found.start[at] - np.cumsum(size) + size, size) + np.arange(size.sum())]
    return (batch.column(2).to_numpy().astype("<i8").tobytes(), _squeezed(lengths.astype("<i4")), _squeezed(langs.astype("<i4")), _squeezed(places.astype("<u4")),
            _squeezed(shape.astype(np.uint8)), _squeezed(letters), _squeezed(size.astype("<i4")))


class Words:
    """Of a slice: each document's length and language, the distinct words' ids and languages, and where the documents have them."""

    def __init__(self, r: dict):
        read = lambda name, kind: _loosened(r[name], kind)
        self.letters, self.sizes = read("letters", "u1").astype(np.int64), read("sizes", "<i4").astype(np.int64)
        spaced = np.full(len(self.letters) + len(self.sizes), 32, dtype=np.uint8)
        spaced[np.arange(len(self.letters)) + np.repeat(np.arange(len(self.sizes)), self.sizes)] = self.letters
        hashes = hashing.Words([spaced.tobytes()]).hash
        self.lengths, self.languages = read("lengths", "<i4").astype(np.int64), read("languages", "<i4").astype(np.int64)
        self.places = read("places", "<u4").astype(np.int64)
        self.language = np.zeros(len(hashes), dtype=np.int64)
        self.language[self.places] = np.repeat(self.languages, self.lengths)
        self.keys = key(hashes, self.language)


def _by_shard(keys: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of keys by shard and then by what is sent of them, and where each shard begins in it."""
    shard = (keys % np.uint64(shards)).astype(np.int64)
    order = np.lexsort((keys & _MASK, shard))
    return order, np.searchsorted(shard[order], np.arange(shards + 1))


class Slice(Words):
    """These, with what the shards answered for its distinct words: models whose vocabulary has them (a bit each), and of each model so many values."""

    def __init__(self, one: pa.Table, answers: pa.Table, shards: int, values: int = 0):
        r = one.slice(0, 1).to_pylist()[0]
        super().__init__(r)
        self.fold, self.shape, self.rows = r["fold"], _loosened(r["shapes"], "u1").astype(np.int64), np.frombuffer(r["rows"], "<i8")
        self.models, self.values = np.zeros(len(self.keys), dtype=np.uint8), np.zeros((FOLDS, values, len(self.keys)), dtype=np.int64)
        #: (model, shard): what the shard of pairs answered
        self.of_pairs = {}
        order, cuts = _by_shard(self.keys, shards)
        for of, s, hits, value in zip(*(answers.column(x).to_pylist() for x in ("slice", "s", "hits", "values")), strict=True):
            m = of % FOLDS
            if s >= shards:
                self.of_pairs[m, s - shards] = value
                continue
            own = order[cuts[s]:cuts[s + 1]]
            at = own[np.unpackbits(np.frombuffer(hits, np.uint8), count=len(own)).astype(bool)]
            self.models[at] |= np.uint8(1 << m)
            if values:
                self.values[m][:, at] = _loosened(value, "<i8").reshape(values, -1)
        self.shape_keys, self.start_keys = key(self.shape, self.language), key(np.zeros(len(self.languages)), self.languages)
        # documents with words; the start of a text comes before its first word
        self.full = np.flatnonzero(self.lengths)
        self.starts = (np.cumsum(self.lengths) - self.lengths)[self.full]

    def known(self, model: int) -> np.ndarray:
        return (self.models >> model & 1).astype(bool)

    def ids(self, model: int) -> np.ndarray:
        return np.where(self.known(model), self.keys, self.shape_keys)

    def before(self, by_word: np.ndarray, at_start: np.ndarray) -> np.ndarray:
        """For each word in the texts, the value of the one before it; at_start: by document."""
        own = by_word[self.places]
        out = np.concatenate([own[:1], own[:-1]])
        out[self.starts] = at_start[self.full]
        return out

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pairs of words, and which of them each word ends: places of the first, or -1 - language at the start of a text; of the second."""
        size, lowest = max(len(self.keys), 1), 1 + int(self.languages.max(initial=0))
        pairs, back = np.unique((self.before(np.arange(len(self.keys)), -1 - self.languages) + lowest) * size + self.places, return_inverse=True)
        return pairs // size - lowest, pairs % size, back

    def named(self, model: int, before: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct pairs by the model's ids."""
        ids, start = self.ids(model), key(np.zeros(len(before)), np.maximum(-1 - before, 0))
        return np.where(before >= 0, ids[np.maximum(before, 0)], start) if len(ids) else start, ids[word]

    def wanted(self, before: np.ndarray, word: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """The keys of these by the models that score the slice, each once, by shard; where each shard begins; by model, which of them each pair has."""
        models = _judges(self.fold)
        keys, back = np.unique(np.concatenate([pair_key(*self.named(m, before, word)) for m in models]), return_inverse=True)
        order, cuts = _by_shard(keys, shards)
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        return keys[order], cuts, list(rank[back].reshape(len(models), -1))

    def spelled(self, outside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte pairs of these of the distinct words, with the white space around them, and which word each belongs to."""
        size, begin = self.sizes[outside], (np.cumsum(self.sizes) - self.sizes)[outside]
        word = np.repeat(np.arange(len(outside)), size + 1)
        place = np.arange(len(word)) - np.repeat(np.cumsum(size + 1) - size - 1, size + 1)
        at, end = begin[word] + place, size[word]
        byte = lambda at, inside: np.where(inside, self.letters[np.clip(at, 0, max(len(self.letters) - 1, 0))], 32) if len(at) else at
        return self.language[outside][word] << 16 | byte(at - 1, place > 0) << 8 | byte(at, place < end), outside[word]


def _of_slice(looked_up: DataFrame):
    """The answers for all models of a slice."""
    return looked_up.groupBy(F.expr(f"slice div {FOLDS}"))


def _looked_up(slices: DataFrame, table: DataFrame, names: list[str], shards: int, models_of) -> DataFrame:
    """What the shards of table (key, models, names) answer for the distinct words of each slice: slice * FOLDS + model, s, hits (a bit for each of the slice's words of the shard, if the model knows it), values.

    names has as many columns for each model; a slice gets those of its own models (models_of its fold).
    """

    def ask(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for r in batch.to_pylist():
                keys = Words(r).keys
                order, cuts = _by_shard(keys, shards)
                held = np.flatnonzero(np.diff(cuts))
                same = lambda x: pa.array(np.full(len(held), x))
                yield pa.RecordBatch.from_arrays([pa.array(held), same(r["slice"]), same(r["fold"]), pa.array([_pack(keys[order[cuts[s]:cuts[s + 1]]]) for s in held], pa.binary())], ["s", "slice", "fold", "keys"])

    def answer(asked: pa.Table, known: pa.Table) -> pa.Table:
        own = known.column("key").to_numpy().view(np.uint64) & _MASK
        order = np.argsort(own)
        own, models = own[order], known.column("models").to_numpy()[order].astype(np.uint8)
        value = np.stack([known.column(x).to_numpy()[order] for x in names]) if names else np.zeros((0, len(own)), dtype=np.int64)
        each, out = len(names) // FOLDS, []
        for one, s, fold, wanted in zip(*(asked.column(x).to_pylist() for x in ("slice", "s", "fold")), map(_unpack, asked.column("keys").to_pylist()), strict=True):
            at = np.minimum(np.searchsorted(own, wanted), max(len(own) - 1, 0))
            known_by = np.where(own[at] == wanted, models[at], 0) if len(own) else np.zeros(len(wanted), dtype=np.uint8)
            for m in models_of(fold):
                hit = (known_by >> m & 1).astype(bool)
                out.append((one * FOLDS + m, s, np.packbits(hit).tobytes(), _squeezed(value[m * each:(m + 1) * each, at[hit]].astype("<i8").reshape(-1)) if each else b""))
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 4, [pa.int64(), pa.int64(), pa.binary(), pa.binary()], strict=True)], ["slice", "s", "hits", "values"])

    asked = slices.select("slice", F.col("fold").cast("long").alias("fold"), *_WORDS).mapInArrow(ask, "s long, slice long, fold long, keys binary")
    held = table.select(_shard("key", shards).alias("s"), "key", "models", *names)
    return asked.groupBy("s").cogroup(held.groupBy("s")).applyInArrow(answer, "slice long, s long, hits binary, values binary")


def _judges(fold: int) -> list[int]:
    """The models that score documents of a fold."""
    return [0, fold] if fold > 0 else [0]


def _scored_as(rows: np.ndarray, model: int) -> np.ndarray:
    """What tells rows' scores by a model apart."""
    return rows ^ np.int64(model * _OTHER)


#: What a model has of an id: how many pairs begin with it, how many different ones that were seen once, twice and more often; different ids before it.
_COUNTS = ["total", "n1", "n2", "n3", "before"]


def _each(*names: str) -> list[str]:
    """Columns of all models."""
    return [f"{x}_{k}" for k in range(FOLDS) for x in names]


def _shard(name: str, shards: int) -> Column:
    """Of a 64-bit number without sign, as Spark has it with one."""
    return F.pmod(F.pmod(F.col(name), F.lit(shards)) + F.when(F.col(name) < 0, F.lit((1 << 64) % shards)).otherwise(F.lit(0)), F.lit(shards))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quality_col: str = "quality",
          quantile: float = QUANTILE, prior_words: int = PRIOR_WORDS) -> DataFrame:
    """One row per row of docs: id, lang, n_words, perplexity, threshold, kept.

    labels has id and quality; documents with quality 1 are trusted (a repeated
    label counts once). perplexity is that of the text, drawn to the language's
    mean by ``prior_words`` words; threshold is the ``quantile`` of the language's
    trusted documents, each scored by a model that has not seen it. Rejected: perplexity above threshold.
    Null lang is a language of its own. A language with fewer than
    LEAST_HELD_OUT trusted documents has the quantile of all languages, above
    its own mean. One without trusted text, or with all of it in one fold, has
    no text to hold against a model: null perplexity or threshold, rejects
    nothing; neither does a text without words (null text is empty). Null ids
    are never trusted. Repeated rows are judged alike. Other columns are not
    read. An empty table, or one without labels, rejects nothing.
    """
    return _judged(docs, labels, id_col, text_col, lang_col, quality_col, quantile, prior_words).drop("__row")


def _row(id_col: str, text_col: str, lang_col: str) -> Column:
    """What tells rows apart: equal rows are judged alike, others each for itself."""
    return F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.coalesce(F.col(lang_col).cast("string"), F.lit("")))


def _judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quality_col: str = "quality",
            quantile: float = QUANTILE, prior_words: int = PRIOR_WORDS) -> DataFrame:
    """As judge, with each row's __row."""
    spark = docs.sparkSession
    plain = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"))
    trusted = labels.where((F.col(quality_col) == 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id")).distinct()
    dealt = F.pmod(F.xxhash64("id"), F.lit(HELD_OUT))
    marks = broadcast_if_small(trusted.withColumn("fold", F.when(dealt == 0, 0).otherwise(1 + F.floor((dealt - 1) * (FOLDS - 1) / (HELD_OUT - 1))).cast("int")))

    languages = sorted(r["lang"] for r in plain.join(marks, "id", "left_semi").select("lang").distinct().collect())
    numbers = len(languages) * FOLDS
    number = {x: i for i, x in enumerate(languages)}
    sent_number = spark.sparkContext.broadcast(number)
    keyed = plain.withColumn("row", _row("id", "text", "lang"))
    size = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # a word is about seven bytes; odd, so that both words of a pair choose its shard
    shards = max(16, size // 7 // SHARD_PAIRS) | 1

    def encode(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, count = TaskContext.get().partitionId() << 32, 0
        for batch in rows:
            for fold in range(-1, FOLDS):
                for own in batches.slices(iter([batch.filter(pc.equal(batch.column(3), fold))]), text=0, limit=SCORED_BYTES):
                    yield pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip((task + count, fold, *_encoded(own, sent_number.value)), [pa.int64(), pa.int32(), *[pa.binary()] * 7], strict=True)], [c.split()[0] for c in _SLICE.split(", ")])
                    count += 1

    # a slice's documents are of one fold, -1 if they aren't trusted
    slices = written(keyed.join(marks, "id", "left").select("text", "lang", "row", F.coalesce("fold", F.lit(-1)).alias("fold")).mapInArrow(encode, _SLICE), "slices")
    trained = slices.where("fold >= 0")

    def word_counts(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for r in batch.to_pylist():
                own = Words(r)
                yield pa.RecordBatch.from_arrays([pa.array(own.keys.view(np.int64)), pa.array(own.language.astype(np.int32)), pa.array(np.full(len(own.keys), r["fold"], dtype=np.int32)), pa.array(np.bincount(own.places, minlength=len(own.keys)))], ["key", "language", "fold", "n"])

    counted = trained.select("fold", *_WORDS).mapInArrow(word_counts, "key long, language int, fold int, n long")
    # models, a bit each: a word is in a vocabulary if the other folds have it twice
    outside = lambda k: F.sum("n") - F.sum(F.when(F.col("fold") == k, F.col("n")).otherwise(0))
    bits = sum((F.when(outside(k) > 1, 1 << k).otherwise(0) for k in range(1, FOLDS)), F.when(outside(0) > 1, 1).otherwise(0))
    words = written(counted.groupBy("key").agg(F.min("language").alias("language"), bits.cast("int").alias("models")).where("models > 0"), "vocabulary")

    def pair_counts(one: pa.Table, answers: pa.Table) -> pa.Table:
        """By shard: pairs of ids (language 0 and up), and byte pairs of words outside the vocabulary (language -1, first), with each model's count."""
        own = Slice(one, answers, shards)
        models = [m for m in range(FOLDS) if m != own.fold]
        before, word, back = own.distinct()
        n = np.bincount(back, minlength=len(word))
        # as the first of the models has them, and what others have otherwise
        parts = []
        for m in models:
            first, second = own.named(m, before, word)
            alike = (first == parts[0][0]) & (second == parts[0][1]) if parts else np.zeros(len(n), dtype=bool)
            if parts:
                parts[0][3][alike, m] = n[alike]
            counts = np.zeros((len(n), FOLDS), dtype=np.int64)
            counts[:, m] = n
            parts.append((first[~alike], second[~alike], own.language[word[~alike]], counts[~alike]))
        first, second, language, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
        _, at, back = np.unique(pair_key(first, second), return_index=True, return_inverse=True)
        unknown = np.stack([~own.known(m) if m in models else np.zeros(len(own.keys), dtype=bool) for m in range(FOLDS)], axis=1)
        spelled, of_word = own.spelled(np.flatnonzero(unknown.any(axis=1)))
        spelled, spelled_back = np.unique(spelled, return_inverse=True)
        times = (unknown * np.bincount(own.places, minlength=len(own.keys))[:, None])[of_word]
        summed = lambda back, n, size: np.bincount(back, n, size).astype(np.int64)
        first, second = np.append(first[at], spelled.astype(np.uint64)), np.append(second[at], np.zeros(len(spelled), dtype=np.uint64))
        language = np.append(language[at], np.full(len(spelled), -1))
        counts = np.stack([np.append(summed(back, counts[:, k], len(at)), summed(spelled_back, times[:, k], len(spelled))) for k in range(FOLDS)])
        shard = (pair_key(first, second) % np.uint64(shards)).astype(np.int64)
        order = np.lexsort((second, first, shard))
        cuts = np.searchsorted(shard[order], np.arange(shards + 1))
        out = [(s, *pair_rows(language[i], first[i], second[i], counts[:, i])) for s in range(shards) if len(i := order[cuts[s]:cuts[s + 1]])]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 5, [pa.int64(), *[pa.binary()] * 4], strict=True)], ["s", "language", "first", "second", "n"])

    def pair_rows(language: np.ndarray, first: np.ndarray, second: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes, bytes, bytes]:
        return _squeezed(language.astype("<i4")), _squeezed(np.diff(first, prepend=np.uint64(0))), second.astype("<u8").tobytes(), _squeezed(counts.astype("<i8").reshape(-1))

    def added(sent: pa.Table) -> pa.Table:
        """The pairs of a shard, each once."""
        column = lambda name: sent.column(name).to_pylist()
        language, second = np.concatenate([_loosened(x, "<i4") for x in column("language")]), np.concatenate([np.frombuffer(x, "<u8") for x in column("second")])
        first, counts = np.concatenate([np.cumsum(_loosened(x, "<u8"), dtype=np.uint64) for x in column("first")]), np.concatenate([_loosened(x, "<i8").reshape(FOLDS, -1) for x in column("n")], axis=1)
        order = np.lexsort((second, first, language))
        language, first, second = language[order], first[order], second[order]
        new = np.flatnonzero(np.concatenate([[True], (first[1:] != first[:-1]) | (second[1:] != second[:-1]) | (language[1:] != language[:-1])]))
        return pa.table({"language": pa.array(language[new]), "first": pa.array(first[new].view(np.int64)), "second": pa.array(second[new].view(np.int64)), **{f"n_{k}": pa.array(np.add.reduceat(counts[k][order], new)) for k in range(FOLDS)}})

    # a slice is sent once, whatever the number of its models
    found = trained.groupBy("slice").cogroup(_of_slice(_looked_up(trained, words, [], shards, lambda fold: [m for m in range(FOLDS) if m != fold]))).applyInArrow(pair_counts, "s long, language binary, first binary, second binary, n binary")
    summed = found.groupBy("s").applyInArrow(added, "language int, first long, second long, " + ", ".join(f"{x} long" for x in _each("n")))
    pairs = written(summed.select("language", "first", "second", F.struct(*_each("n")).alias("n")), "pairs").select("language", "first", "second", "n.*")
    # at most 65,536 for each language of a model
    letters = pairs.where("language < 0").drop("language", "second").toArrow()
    pairs = pairs.where("language >= 0")
    seen = lambda k: [F.sum(f"n_{k}").alias(f"total_{k}"), *(F.count_if(F.col(f"n_{k}") == j if j < 3 else F.col(f"n_{k}") >= 3).alias(f"n{j}_{k}") for j in (1, 2, 3))]
    by_first = pairs.groupBy(F.col("first").alias("key")).agg(F.min("language").alias("language"), *(c for k in range(FOLDS) for c in seen(k)))
    by_second = pairs.groupBy(F.col("second").alias("key")).agg(F.min("language").alias("language"), *(F.count_if(F.col(f"n_{k}") > 0).alias(f"before_{k}") for k in range(FOLDS)))
    # models is 0 for the start of a text and the shapes
    unigrams = written(by_first.join(by_second, ["key", "language"], "full").join(words.select("key", "models"), "key", "left").na.fill(0, [*_each(*_COUNTS), "models"]), "unigrams")

    def by_language(counts: DataFrame, names: list[str]) -> np.ndarray:
        """Language x of model k is k * languages + x."""
        out = np.zeros((numbers, len(names)), dtype=np.int64)
        for r in counts.collect():
            for k in range(FOLDS):
                out[k * len(languages) + r["language"]] = [r[f"{x}_{k}"] for x in names]
        return out

    several = lambda c: [x for k in range(FOLDS) for x in (*(F.count_if(F.col(f"{c}_{k}") == j).alias(f"is{j}_{k}") for j in (1, 2, 3, 4)), F.count_if(F.col(f"{c}_{k}") >= 3).alias(f"more_{k}"), F.sum(f"{c}_{k}").alias(f"sum_{k}"))]
    model = Model(by_language(pairs.groupBy("language").agg(*several("n")), ["is1", "is2", "is3", "is4"]), by_language(unigrams.groupBy("language").agg(*several("before")), ["is1", "is2", "is3", "is4", "more", "sum"]),
                  by_language(words.groupBy("language").agg(*(F.count_if(F.col("models").bitwiseAND(1 << k) > 0).alias(f"count_{k}") for k in range(FOLDS))), ["count"])[:, 0])

    sent_model = spark.sparkContext.broadcast((model,))
    # the start of a text and the shapes, of each language
    every, of_shape = np.repeat(np.arange(numbers), SHAPES), np.tile(np.arange(SHAPES), numbers)
    marks_of = key(of_shape, every % max(len(languages), 1)).view(np.int64)[:len(languages) * SHAPES]
    place = {int(k): i for i, k in enumerate(marks_of)}
    of_marks = np.zeros((len(_COUNTS), len(every)), dtype=np.int64)
    if languages:
        wanted = spark.createDataFrame([(k,) for k in place], "key long")
        for r in unigrams.join(F.broadcast(wanted), "key", "left_semi").collect():
            for k in range(FOLDS):
                of_marks[:, k * len(place) + place[r["key"]]] = [r[f"{x}_{k}"] for x in _COUNTS]
    spelled, spelled_n = (np.concatenate([f(k)[letters.column(f"n_{k}").to_numpy() > 0] for k in range(FOLDS)]) for f in (lambda k: letters.column("first").to_numpy() + (k * len(languages) << 16), lambda k: letters.column(f"n_{k}").to_numpy()))
    sent_scores = spark.sparkContext.broadcast((of_marks, Spelling(spelled, spelled_n)))

    def of_documents(own: Slice, m: int, before: np.ndarray, word: np.ndarray, back: np.ndarray, n: np.ndarray) -> np.ndarray:
        """What each document scores by model m, that has the slice's distinct pairs n times."""
        (model,), (of_marks, spelling) = sent_model.value, sent_scores.value
        out = np.zeros(len(own.rows))
        if not len(own.full):
            return out
        mark, known, language = m * len(languages) * SHAPES, own.known(m), own.language + m * len(languages)
        total, *kinds, followed = np.where(known, own.values[m], of_marks[:, mark + own.language * SHAPES + own.shape])
        log_weight, log_p = model.log_weight(language, total, kinds), model.log_p(language, followed)
        # the start of a text of each language
        at_start = of_marks[:, mark:mark + len(languages) * SHAPES:SHAPES]
        start_weight = model.log_weight(np.arange(len(languages)) + m * len(languages), at_start[0], list(at_start[1:4]))
        of_start, of_first = np.maximum(-1 - before, 0), np.maximum(before, 0)
        total = np.where(before >= 0, total[of_first], at_start[0][of_start])
        score = np.where(before >= 0, log_weight[of_first], start_weight[of_start]) + log_p[word]
        at = np.flatnonzero((n > 0) & (total > 0))
        score[at] += model.seen_gain(language[word[at]], n[at], total[at], score[at])
        spelled, of_word = own.spelled(np.flatnonzero(~known))
        spelled = np.bincount(of_word, spelling.score(spelled + (m * len(languages) << 16)), len(known))
        out[own.full] = np.add.reduceat(score[back] + spelled[own.places], own.starts)
        return out

    def requests(one: pa.Table, answers: pa.Table) -> pa.Table:
        """By shard: the slice's distinct pairs, as its models know them."""
        own = Slice(one, answers, shards)
        pair, cuts, _ = own.wanted(*own.distinct()[:2], shards)
        held, number = np.flatnonzero(np.diff(cuts)), one.column("slice")[0].as_py()
        return pa.table({"s": pa.array(held), "slice": pa.array(np.full(len(held), number)), "fold": pa.array(np.full(len(held), own.fold)), "pairs": pa.array([_pack(pair[cuts[s]:cuts[s + 1]]) for s in held], pa.binary())})

    def packed(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs and each model's counts by shard."""

        def by_shard(held: pa.Table) -> pa.RecordBatch:
            pair = pair_key(*(held.column(x).to_numpy().view(np.uint64) for x in ("first", "second")))
            counts = np.stack([held.column(x).to_numpy() for x in _each("n")])
            order, cuts = _by_shard(pair, shards)
            some = np.flatnonzero(np.diff(cuts))
            parts = [order[cuts[s]:cuts[s + 1]] for s in some]
            return pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(x, pa.binary()) for x in ([_pack(pair[i]) for i in parts], [_squeezed(counts[:, i].astype("<i8").reshape(-1)) for i in parts]))], ["s", "pairs", "n"])

        held, size = [], 0
        for batch in rows:
            held.append(batch)
            size += batch.num_rows
            if size >= _PACKED_ROWS:
                yield by_shard(pa.Table.from_batches(held))
                held, size = [], 0
        if held:
            yield by_shard(pa.Table.from_batches(held))

    def answer(asked: pa.Table, known: pa.Table) -> pa.Table:
        """How often each of a slice's models has its pairs of this shard; s is beyond the shards of words."""
        column = lambda name: known.column(name).to_pylist()
        pair = np.concatenate([np.zeros(0, dtype=np.uint64), *map(_unpack, column("pairs"))])
        counts = np.concatenate([np.zeros((FOLDS, 0), dtype=np.int64), *(_loosened(x, "<i8").reshape(FOLDS, -1) for x in column("n"))], axis=1)
        order = np.argsort(pair)
        pair, counts, out = pair[order], counts[:, order], []
        for s, number, fold, wanted in zip(*(asked.column(x).to_pylist() for x in ("s", "slice", "fold")), map(_unpack, asked.column("pairs").to_pylist()), strict=True):
            at = np.minimum(np.searchsorted(pair, wanted), max(len(pair) - 1, 0))
            seen = pair[at] == wanted if len(pair) else np.zeros(len(wanted), dtype=bool)
            out += [(number * FOLDS + m, shards + s, b"", _squeezed(np.where(seen, counts[m, at], 0).astype("<i8") if len(pair) else np.zeros(len(wanted), dtype="<i8"))) for m in _judges(fold)]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 4, [pa.int64(), pa.int64(), pa.binary(), pa.binary()], strict=True)], ["slice", "s", "hits", "values"])

    def row_sums(one: pa.Table, answers: pa.Table) -> pa.Table:
        """Rows by the models that score them, what they score, and their words."""
        own = Slice(one, answers, shards, values=len(_COUNTS))
        before, word, back = own.distinct()
        pair, cuts, places = own.wanted(before, word, shards)
        rows, sums = [], []
        for m, at in zip(_judges(own.fold), places, strict=True):
            n = np.concatenate([np.zeros(0, dtype=np.int64), *(_loosened(own.of_pairs[m, s], "<i8") for s in np.flatnonzero(np.diff(cuts)))])
            rows.append(_scored_as(own.rows, m))
            sums.append(of_documents(own, m, before, word, back, n[at]))
        return pa.table({"row": pa.array(np.concatenate(rows)), "log_p": pa.array(np.concatenate(sums)), "n": pa.array(np.tile(own.lengths, len(rows)))})

    known = written(pairs.select("first", "second", *_each("n")).mapInArrow(packed, "s long, pairs binary, n binary"), "known")

    def scored_part(part: DataFrame) -> DataFrame:
        asked = part.groupBy("slice").cogroup(_of_slice(_looked_up(part, words, [], shards, _judges))).applyInArrow(requests, "s long, slice long, fold long, pairs binary")
        of_pairs = asked.groupBy("s").cogroup(known.groupBy("s")).applyInArrow(answer, "slice long, s long, hits binary, values binary")
        of_words = _looked_up(part, unigrams.where("models > 0"), _each(*_COUNTS), shards, _judges)
        answers = of_words.unionByName(of_pairs).withColumn("of", F.expr(f"slice div {FOLDS}"))
        return part.groupBy("slice").cogroup(answers.groupBy("of")).applyInArrow(row_sums, "row long, log_p double, n long")

    count = min(PARTS, 1 + size // PART_BYTES)
    # the slices of a task are numbered from 0 in the low half
    parts = [scored_part(slices.where(F.expr(f"pmod((slice >> 32) + slice, {count}) = {i}"))) for i in range(count)]
    sums = functools.reduce(DataFrame.unionAll, [written(x, "sums") for x in parts] if count > 1 else parts)
    scored = sums.groupBy("row").agg(F.sum("log_p").alias("log_p"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("copies"))
    # rows that repeat were summed together
    scored = written(scored.select("row", (-F.col("log_p") / F.col("copies")).alias("nats"), (F.col("n") / F.col("copies")).cast("long").alias("n")), "scored")
    modelled = F.broadcast(spark.createDataFrame([(x, k, True) for k in range(FOLDS) for x in languages if model.trained[k * len(languages) + number[x]]], "lang string, fold int, known boolean"))
    rows = keyed.select("id", "lang", "row").join(scored, "row").join(modelled.where("fold = 0").drop("fold"), "lang", "left").na.fill(False, ["known"])

    # each trusted document by the model that has not seen it
    held = keyed.select("id", "lang", "row").join(marks, "id").withColumn("row", F.col("row").bitwiseXOR(F.col("fold").cast("long") * F.lit(_OTHER)))
    held = written(held.join(scored, "row").join(modelled, ["lang", "fold"]).where("n > 0").select("lang", "fold", "nats", "n"), "held-out")
    means = held.groupBy("lang", "fold").agg((F.sum("nats") / F.sum("n")).alias("of_fold"))
    above = held.join(F.broadcast(means), ["lang", "fold"]).withColumn("above", (F.col("nats") - F.col("n") * F.col("of_fold")) / (F.col("n") + prior_words))
    level = F.percentile_approx("above", F.lit(quantile), F.lit(100_000))
    # the mean of the judging model's own held-out documents, or else that of the other models'
    limits = above.groupBy("lang").agg(F.sum(F.when(F.col("fold") == 0, F.col("nats"))).alias("own"), F.sum(F.when(F.col("fold") == 0, F.col("n"))).alias("own_n"), (F.sum("nats") / F.sum("n")).alias("all"), F.count(F.lit(1)).alias("held"), level.alias("level"))
    limits = limits.withColumn("mean", F.coalesce(F.col("own") / F.col("own_n"), "all"))
    limits = limits.crossJoin(F.broadcast(above.agg(level.alias("pooled")))).withColumn("level", F.when(F.col("held") >= LEAST_HELD_OUT, F.col("level")).otherwise(F.greatest("level", "pooled")))
    limits = limits.select("lang", "mean", F.exp(F.col("mean") + F.col("level")).alias("threshold"))
    drawn = lambda c: F.exp((F.col("nats") + prior_words * c) / (F.col("n") + prior_words))
    # a row for each language
    judged = rows.join(F.broadcast(limits), "lang", "left")
    perplexity = F.when(F.col("known") & (F.col("n") > 0), drawn(F.coalesce("mean", F.col("nats") / F.col("n"))))
    return judged.select(F.col("id").alias(id_col), "lang", F.col("n").alias("n_words"), perplexity.alias("perplexity"), "threshold", F.coalesce(perplexity <= F.col("threshold"), F.lit(True)).alias("kept"), F.col("row").alias("__row"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of docs that aren't rejected, with all their columns. A rejected row takes no other text or language of its id (or of null ids) with it."""
    row, gone, gone_id = (unused(docs, x) for x in ("__row", "__rejected", "__id"))
    rejected = written(_judged(docs, labels, id_col).where("not kept").select(F.col(id_col).alias(gone_id), F.col("__row").alias(gone)).distinct(), "rejected")
    marked = docs.withColumn(row, _row(id_col, "text", "lang"))
    return marked.join(broadcast_if_small(rejected), (F.col(row) == F.col(gone)) & F.col(id_col).eqNullSafe(F.col(gone_id)), "left_anti").drop(row)
