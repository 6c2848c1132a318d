"""Phrase collocations from count streams in prefix and suffix order.

Counting goes up by length. A phrase can only be frequent if both its parts
that are a word shorter are, so each pass over the texts counts the phrases
whose two parts pass a Bloom filter of the frequent ones before. The filter has
a bounded size; what it lets through wrongly is counted and dropped by its
count, so the counts are exact. Within a batch, words and phrases are told
apart by exact dictionary numbers; between batches and tasks, by their text.

The frequent phrases are then kept twice, range-partitioned and sorted: by
their words from the first on (prefix order), where a phrase stands directly
before its right extensions, and from the last on (suffix order), where it
stands directly before its left extensions. One pass over a sorted partition
with a stack of the open phrases has the counts of all first parts (or last
parts), and the largest count of an extension. Phrases that are open where a
partition begins are looked up beforehand: at most one a length. The two
streams are merge-joined, and every cut of a phrase is scored from them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedweave.llm import batches, hashing
from feedweave.llm.batches import broadcast_if_small, written
from feedweave.session import reliable_checkpoint

#: Bits of the broadcast filter for each frequent phrase, and at most (64 MB); beyond, it lets more through.
BITS_EACH, MOST_BITS = 16, 1 << 29
#: Bits of a part of the filter: one group where it is put together.
_PART_BITS = 1 << 20
#: UTF-8 bytes of a batch's texts.
_BATCH_BYTES = 8 << 20

#: What a byte is: part of a word, a space between words, or the end of a piece.
_WORD, _SPACE, _END = 0, 1, 2
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[[0x20, 0x09]] = _SPACE
_KIND[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = _END
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class _Batch:
    """Words of a batch: number (an exact id for each distinct word), piece, and the language's place in ``langs``."""

    def __init__(self, texts: list[bytes], langs: list[str]):
        raw = np.frombuffer(b"\n".join([*texts, b""]), dtype=np.uint8)
        cuts = np.zeros(len(texts) + 1, dtype=np.int64)
        np.cumsum([len(t) + 1 for t in texts], out=cuts[1:])
        kind = _KIND[raw]
        inside = kind == _WORD
        edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
        start, end = edge[0::2], edge[1::2]
        self.piece = np.cumsum(kind == _END, dtype=np.int32)[start]
        offsets = np.zeros(len(start) + 1, dtype=np.int32)
        np.cumsum(end - start, out=offsets[1:])
        found = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(_LOWER[raw[inside]])]).dictionary_encode()
        self.number, self.words = found.indices.to_numpy().astype(np.int64), found.dictionary
        self.langs, code = np.unique(np.array(langs, dtype=object), return_inverse=True)
        self.lang = code[np.searchsorted(cuts, start, side="right") - 1]

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        own = hashing.Words(self.words.to_pylist()).hash if len(self.words) else np.zeros(0, dtype=np.uint64)
        return own[self.number]

    def lang_hashes(self) -> np.ndarray:
        return np.array([_lang_hash(x) for x in self.langs], dtype=np.uint64)[self.lang] if len(self.langs) else np.zeros(0, dtype=np.uint64)

    def counted(self, at: np.ndarray, length: int) -> tuple[pa.Array, pa.Array, np.ndarray]:
        """Language, phrase and count of the distinct phrases of ``length`` words that begin at the given words."""
        size = max(1, len(self.words))
        steps, own = [], self.lang[at]
        for j in range(length):
            key = own * size + self.number[at + j]
            if j == length - 1:
                key, count = np.unique(key, return_counts=True)
                steps.append(key)
            else:
                steps.append(np.unique(key))
                own = np.searchsorted(steps[-1], key)
        parts, own = [], np.arange(len(count))
        for step in reversed(steps):
            key = step[own]
            parts.append(self.words.take(pa.array(key % size)))
            own = key // size
        phrase = parts[0] if length == 1 else pc.binary_join_element_wise(*reversed(parts), b" ")
        return pa.array(self.langs.tolist(), pa.string()).take(pa.array(own)), phrase.cast(pa.string()), count


def _lang_hash(lang: str) -> int:
    return int(hashing.mix(np.array([int.from_bytes(lang.encode()[:7].ljust(8, b"\1"), "little") + len(lang)], dtype=np.uint64))[0])


def _grams(words: np.ndarray, langs: np.ndarray, length: int) -> np.ndarray:
    """The filter's hash of the phrase of ``length`` words that begins at each word."""
    return hashing.mix(hashing.ngram_hashes(words, length) ^ langs[:max(0, len(words) - length + 1)])


def _bits(grams: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(grams >> np.uint64(s)) & np.uint64(bits - 1) for s in (0, 29)]


def _filter(frequent: DataFrame, bits: int) -> bytes:
    """Bloom filter of the phrases (lang, phrase), put together in parts."""

    def places(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches.slices(rows):
            phrases = batches.as_bytes(batch.column(1))
            found = hashing.Words(phrases)
            langs = np.array([_lang_hash(x) for x in batch.column(0).to_pylist()], dtype=np.uint64)
            length = int(found.first[1])  # phrases of one length
            grams = hashing.mix(hashing.ngram_hashes(found.hash, length)[found.first[:-1]] ^ langs)
            at = np.unique(np.concatenate(_bits(grams, bits))).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at // _PART_BITS), pa.array(at % _PART_BITS)], ["part", "at"])

    def part(key: tuple, table: pa.Table) -> pa.Table:
        own = np.zeros(min(bits, _PART_BITS), dtype=bool)
        own[table.column("at").to_numpy()] = True
        return pa.table({"part": [key[0].as_py()], "bits": [np.packbits(own, bitorder="little").tobytes()]})

    out = np.zeros(bits // 8, dtype=np.uint8)
    parts = frequent.select("lang", "phrase").mapInArrow(places, "part long, at long").distinct().groupBy("part").applyInArrow(part, "part long, bits binary")
    for row in parts.toLocalIterator():  # bits / 8 bytes in all, whatever the number of phrases
        piece = np.frombuffer(bytes(row["bits"]), dtype=np.uint8)
        out[row["part"] * (_PART_BITS // 8):][:len(piece)] = piece
    return out.tobytes()


def count_phrases(docs: DataFrame, longest: int = 5, least: int = 100, text_col: str = "text", lang_col: str = "lang", most_bits: int = MOST_BITS) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, a) of the phrases of 1 to ``longest`` words with at least ``least`` occurrences, and (lang, n): all words."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))

    def counts(length: int, sieve=None, bits: int = 0):
        def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            allowed = None if sieve is None else np.frombuffer(sieve.value, dtype=np.uint8)
            for batch in batches.slices(rows, limit=_BATCH_BYTES):
                own = _Batch(batches.as_bytes(batch.column(1)), batch.column(0).to_pylist())
                at = np.arange(len(own.number))
                if length > 1:
                    ok = np.ones(max(0, len(at) - length + 2), dtype=bool)
                    for b in _bits(_grams(own.hashes(), own.lang_hashes(), length - 1), bits):
                        ok &= (allowed[b >> np.uint64(3)] >> (b & np.uint64(7)).astype(np.uint8) & 1).view(bool)
                    at = np.flatnonzero(ok[:-1] & ok[1:] & (own.piece[:len(ok) - 1] == own.piece[length - 1:])) if len(ok) > 1 else at[:0]
                if len(at):
                    lang, phrase, n = own.counted(at, length)
                    yield pa.RecordBatch.from_arrays([lang, phrase, pa.array(n)], ["lang", "phrase", "n"])
                if length == 1 and len(at):
                    total = np.bincount(own.lang, minlength=len(own.langs))
                    yield pa.RecordBatch.from_arrays([pa.array(own.langs.tolist(), pa.string()), pa.nulls(len(total), pa.string()), pa.array(total, pa.int64())], ["lang", "phrase", "n"])

        found = texts.mapInArrow(run, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("a"))
        return written(found.where((F.col("a") >= least) | F.col("phrase").isNull()), f"phrases-{length}")

    first = counts(1)
    totals = first.where("phrase IS NULL").select("lang", F.col("a").alias("n"))
    frequent = out = first.where(F.col("phrase").isNotNull())
    for length in range(2, longest + 1):
        size = frequent.count()
        if not size:
            break
        bits = min(most_bits, max(1 << 13, 1 << (BITS_EACH * size - 1).bit_length()))
        sieve = spark.sparkContext.broadcast(_filter(frequent, bits))
        frequent = counts(length, sieve, bits)
        out = out.unionByName(frequent)
    return out, totals


def _stream(phrases: DataFrame, back: bool, name: str) -> DataFrame:
    """(lang, phrase, a, parts, longer) in prefix order (suffix order if ``back``).

    parts: counts of the phrase's first (last) 1, 2, ... words; longer: the
    largest count of a phrase with one more word after (before) it, 0 if none.
    Rows with null a carry a later partition's part of ``longer``.
    """
    spark = phrases.sparkSession
    key = F.split("phrase", " ")
    key = F.reverse(key) if back else key
    ordered = reliable_checkpoint(phrases.select("lang", key.alias("words"), "a").repartitionByRange("lang", "words").sortWithinPartitions("lang", "words"))

    def head(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), batch.column(0).slice(0, 1), batch.column(1).slice(0, 1)], ["part", "lang", "words"])
                return

    # a row for each partition, and each of its open phrases
    heads = [(r["part"], r["lang"], r["words"][:k]) for r in ordered.mapInArrow(head, "part long, lang string, words array<string>").collect() for k in range(1, len(r["words"]))]
    begun: dict[int, list[tuple[str, list[str], int]]] = {}
    if heads:
        wanted = F.broadcast(spark.createDataFrame(heads, "part long, lang string, words array<string>"))
        for r in sorted(ordered.join(wanted, ["lang", "words"]).collect(), key=lambda r: len(r["words"])):
            begun.setdefault(r["part"], []).append((r["lang"], r["words"], r["a"]))

    def scan(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # open phrases: language, words, count (None in the result if it belongs to an earlier partition), largest extension
        opened = [[lang, words, a, 0, True] for lang, words, a in begun.get(TaskContext.get().partitionId(), [])]
        done: list[tuple] = []

        def close(depth: int) -> None:
            while len(opened) > depth:
                lang, words, a, longer, carried = opened.pop()
                done.append((lang, " ".join(reversed(words) if back else words), None if carried else a, [x[2] for x in opened], longer))

        def batch_of() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done, strict=True), (pa.string(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.int64()), strict=True)],
                                             ["lang", "phrase", "a", "parts", "longer"])
            done.clear()
            return out

        for batch in rows:
            for lang, words, a in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                depth = 0
                while depth < min(len(opened), len(words) - 1) and opened[depth][0] == lang and opened[depth][1] == words[:depth + 1]:
                    depth += 1
                close(depth)
                if opened:
                    opened[-1][3] = max(opened[-1][3], a)
                opened.append([lang, words, a, 0, False])
            if done:
                yield batch_of()
        close(0)
        if done:
            yield batch_of()

    return written(ordered.mapInArrow(scan, "lang string, phrase string, a long, parts array<long>, longer long"), name)


def score_phrases(phrases: DataFrame, totals: DataFrame, subsumed_percent: int = 100) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of the phrases of two words or more that no longer phrase stands for.

    A cut after the first words has l, the count of the first part, r, that of
    the rest, and score floor(1000 * a * n / (l * r)), in whole numbers of 38
    digits; the lowest counts, of equal ones the earliest. A phrase goes if a
    phrase that contains it has ``subsumed_percent`` of its count; there is
    then one with one more word that has.
    """
    prefix, suffix = _stream(phrases, False, "prefix-order"), _stream(phrases, True, "suffix-order")
    left = prefix.where("a IS NOT NULL").select("lang", "phrase", "a", F.col("parts").alias("lefts"), F.col("longer").alias("after"))
    right = suffix.where("a IS NOT NULL").select("lang", "phrase", F.col("parts").alias("rights"), F.col("longer").alias("before"))
    both = left.hint("merge").join(right, ["lang", "phrase"])
    # a few rows for each partition
    late = prefix.where("a IS NULL").unionByName(suffix.where("a IS NULL")).groupBy("lang", "phrase").agg(F.max("longer").alias("late"))
    both = both.join(broadcast_if_small(late), ["lang", "phrase"], "left").join(broadcast_if_small(totals), "lang")
    longer = F.greatest("after", "before", F.coalesce("late", F.lit(0)))
    cut = F.expr("""array_min(transform(sequence(1, size(lefts)), k -> struct(
        (1000BD * CAST(a AS decimal(15,0)) * CAST(n AS decimal(18,0))) div (CAST(lefts[k - 1] AS decimal(18,0)) * CAST(rights[size(rights) - k] AS decimal(18,0))) AS score,
        k, lefts[k - 1] AS l, rights[size(rights) - k] AS r)))""")
    kept = both.where((F.size("lefts") > 0) & (100 * longer < subsumed_percent * F.col("a"))).withColumn("cut", cut)
    return kept.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").cast("long").alias("score"))


def mine(docs: DataFrame, top: int = 2000, longest: int = 5, least: int = 100, subsumed_percent: int = 100, text_col: str = "text", lang_col: str = "lang", most_bits: int = MOST_BITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``top`` phrases by score and a descending, then by UTF-8 bytes ascending.

    A-Z are lower-cased; texts are cut at ``.,;:!?`` and 0x0A-0x0D into pieces,
    these at spaces and tabs into words. Null text is empty, null lang ``und``.
    Every row counts, repeated ones too. A text of any length is read whole in
    one batch, at about 40 bytes of memory for each of its own. Other columns
    are not read. No frequent phrase, or an empty table: an empty result.
    """
    phrases, totals = count_phrases(docs, longest, least, text_col, lang_col, most_bits)
    found = score_phrases(phrases, totals, subsumed_percent)
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return found.withColumn("rank", place).where(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


#: DuckDB SQL of op13_collocations.
COLLOCATIONS_SQL = r"""
    WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
    w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS words FROM p),
    n AS (SELECT lang, CAST(sum(len(words)) AS BIGINT) AS n FROM w GROUP BY lang),
    s AS (SELECT lang, words, m, unnest(range(1, len(words) - m + 2)) AS i FROM w, (SELECT unnest(range(1, 6)) AS m) WHERE len(words) >= m),
    f AS (SELECT lang, m, words[i:i + m - 1] AS ws, count(*) AS f FROM s GROUP BY ALL HAVING count(*) >= 100),
    c AS (SELECT lang, m, ws, f AS a, unnest(range(1, m)) AS k FROM f WHERE m > 1),
    x AS (SELECT c.lang, c.m, c.ws, c.a, c.k, l.f AS l, r.f AS r, n.n, (1000::HUGEINT * c.a * n.n) // (l.f::HUGEINT * r.f) AS score
          FROM c JOIN f l ON l.lang = c.lang AND l.ws = c.ws[1:c.k] JOIN f r ON r.lang = c.lang AND r.ws = c.ws[c.k + 1:] JOIN n ON n.lang = c.lang),
    b AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, ws ORDER BY score, k) = 1),
    g AS (SELECT DISTINCT lang, ws[j:j + q - 1] AS ws, f FROM (SELECT lang, ws, f, m, q, unnest(range(1, m - q + 2)) AS j FROM f, (SELECT unnest(range(2, 5)) AS q) WHERE m > q)),
    d AS (SELECT lang, ws, max(f) AS longer FROM g GROUP BY ALL)
    SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, encode(array_to_string(b.ws, ' '))) AS rank, array_to_string(b.ws, ' ') AS phrase, a, l, r, n, CAST(score AS BIGINT) AS score
    FROM b LEFT JOIN d ON d.lang = b.lang AND d.ws = b.ws WHERE coalesce(100 * d.longer < 100 * b.a, true) QUALIFY rank <= 2000"""
