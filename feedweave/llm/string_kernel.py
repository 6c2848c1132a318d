"""Language ID by a string kernel: blended n-gram presence, Nystroem landmarks, one-versus-rest kernel ridge regression.

A text is its set G of byte n-grams of ``SHORTEST`` to ``LONGEST`` bytes, A-Z
lower-cased, every run of ASCII other than letters one space, a space at both
ends. The kernel of two texts is |G & G'| / sqrt(|G| |G'|).

Fitting takes a bounded sample: for each language the ``texts`` of smallest
hash. The first of them are landmarks (a passage of at most ``LANDMARK_WORDS``
words of each). All of them, whole and as short passages, are examples. With
the landmarks' kernel matrix M and an example's kernel row k, its features are
k M^-1/2; ridge regression of +1 (own language) and -1 gives the weights.

Whole texts are scored in tasks: a batch's presence matrix times the landmarks'
presence matrix gives all intersection sizes at once, exactly (whole numbers in
single precision); scaled, times the coefficients, they are the outputs.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedweave.llm import batches
from feedweave.llm.batches import written

SHORTEST, LONGEST = 2, 4
#: Labelled texts and landmarks of a language, and of all: bounds of the sample that the model is fitted on.
TEXTS, LANDMARKS, MOST_TEXTS, MOST_LANDMARKS = 256, 48, 2048, 512
#: Languages that are learned at most, those with most labelled texts.
MOST_LANGUAGES = 512
LANDMARK_WORDS = 400
#: Words of the passages that are examples beside the whole text.
PASSAGES = (2, 6, 20)
RIDGE = 1e-3
#: Texts whose presence matrix is multiplied at once.
_ROWS = 64

#: Space for ASCII other than letters, letters lower-cased, other bytes as they are.
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[:128] = 0x20
_PLAIN[97:123] = np.arange(97, 123)
_PLAIN[65:91] = np.arange(97, 123)


def plain(text: bytes) -> np.ndarray:
    """The text's bytes as the kernel reads them."""
    raw = np.empty(len(text) + 2, dtype=np.uint8)
    raw[0] = raw[-1] = 0x20
    raw[1:-1] = _PLAIN[np.frombuffer(text, dtype=np.uint8)]
    space = raw == 0x20
    keep = np.ones(len(raw), dtype=bool)
    keep[1:] = ~(space[1:] & space[:-1])
    return raw[keep]


def ngrams(text: bytes) -> np.ndarray:
    """The set of a text's n-grams, sorted. An n-gram is a number of its bytes; none begins with byte 0, so lengths can't meet."""
    raw = plain(text).astype(np.uint32)
    found, code = [], raw
    for n in range(2, LONGEST + 1):
        code = (code[:-1] << np.uint32(8)) | raw[n - 1:]
        if n >= SHORTEST:
            found.append(code)
    return np.unique(np.concatenate(found))


def passage(text: bytes, words: int) -> bytes:
    """``words`` consecutive words of the text, at a place that its checksum gives; the whole text if it has no more."""
    own = text.split()
    if len(own) <= words:
        return text
    at = zlib.crc32(text) % (len(own) - words + 1)
    return b" ".join(own[at:at + words])


@dataclass(frozen=True)
class Model:
    """grams: the landmarks' n-grams, sorted; has: a row for each, a bit for each landmark; size: n-grams of each landmark; weights: landmarks x languages."""

    languages: list[str]
    grams: np.ndarray
    has: np.ndarray
    size: np.ndarray
    weights: np.ndarray

    def kernel(self, sets: list[np.ndarray]) -> np.ndarray:
        """Rows of the kernel with every landmark, for texts given as n-gram sets."""
        out = np.zeros((len(sets), len(self.size)))
        for at in range(0, len(sets), _ROWS):
            some = sets[at:at + _ROWS]
            flat = np.concatenate(some)
            row = np.repeat(np.arange(len(some)), [len(s) for s in some])
            place = np.searchsorted(self.grams, flat)
            place[place == len(self.grams)] = 0
            known = self.grams[place] == flat
            used, column = np.unique(place[known], return_inverse=True)
            presence = np.zeros((len(some), len(used)), dtype=np.float32)
            presence[row[known], column] = 1
            shared = presence @ np.unpackbits(self.has[used], axis=1, count=len(self.size)).astype(np.float32)
            # a text without n-grams shares none
            out[at:at + len(some)] = shared / np.sqrt(np.outer([max(1, len(s)) for s in some], self.size))
        return out


def _landmarks(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    grams = np.unique(np.concatenate(sets))
    has = np.zeros((len(grams), len(sets)), dtype=bool)
    for j, s in enumerate(sets):
        has[np.searchsorted(grams, s), j] = True
    return grams, np.packbits(has, axis=1), np.array([len(s) for s in sets], dtype=np.float64)


def solve(kernel: np.ndarray, landmarks: np.ndarray, own: np.ndarray, classes: int, ridge: float) -> np.ndarray:
    """Coefficients (landmarks x classes) of one-versus-rest ridge regression on the features kernel @ landmarks ** -1/2."""
    value, vector = np.linalg.eigh(landmarks)
    # directions that the landmarks don't span have no features
    root = np.where(value > 1e-9 * value[-1], 1 / np.sqrt(np.maximum(value, 1e-300)), 0)
    whiten = (vector * root) @ vector.T
    features = kernel @ whiten
    target = np.where(own[:, None] == np.arange(classes), 1.0, -1.0)
    # each class weighs the same, however many examples it has
    weight = 1 / np.bincount(own, minlength=classes)[own]
    left = (features * weight[:, None]).T @ features + ridge * classes * np.eye(len(landmarks))
    return whiten @ np.linalg.solve(left, (features * weight[:, None]).T @ target)


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", texts: int = TEXTS, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model | None:
    """The model of the labelled texts; None if no row has a language and a letter.

    At most MOST_LANGUAGES languages are learned, from at most ``texts`` texts
    each and MOST_TEXTS in all (one each at least). Equal texts of a language
    count once. The sample depends on texts and languages only.
    """
    spark = labelled.sparkSession
    rows = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where(F.col("lang").isNotNull() & has_letter(F.col("text"))).withColumn("h", F.xxhash64("text"))
    narrow = written(rows.select("lang", "h").distinct(), "language-hashes")
    learned = [r["lang"] for r in narrow.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES).collect()]
    if not learned:
        return None
    languages = sorted(learned, key=str.encode)
    texts = min(texts, max(1, MOST_TEXTS // len(languages)))
    landmarks = min(landmarks, texts, max(1, MOST_LANDMARKS // len(languages)))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    chosen = narrow.where(F.col("lang").isin(languages)).withColumn("place", place).where(F.col("place") <= texts)
    # MOST_TEXTS + MOST_LANGUAGES rows of two numbers at most
    sample = written(rows.join(F.broadcast(chosen), ["lang", "h"]).dropDuplicates(["lang", "h"]), "language-sample")
    number = {lang: i for i, lang in enumerate(languages)}

    def marks(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches.slices(parts):
            sets = [ngrams(passage(t, LANDMARK_WORDS)).tobytes() for t in batches.as_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sets, pa.binary())], ["lang", "h", "grams"])

    found = sample.where(F.col("place") <= landmarks).select("lang", "text", "h").mapInArrow(marks, "lang string, h long, grams binary").collect()
    found.sort(key=lambda r: (number[r["lang"]], r["h"]))
    sets = [np.frombuffer(bytes(r["grams"]), dtype=np.uint32) for r in found]
    bare = Model(languages, *_landmarks(sets), np.zeros((len(sets), len(languages))))
    shared = spark.sparkContext.broadcast(bare)

    def examples(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches.slices(parts):
            own = batches.as_bytes(batch.column(1))
            # one row, one text and its passages: whole rows of the kernel
            found = [ngrams(x) for t in own for x in (t, *(passage(t, n) for n in PASSAGES))]
            kernel = shared.value.kernel(found).reshape(len(own), -1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([k.tobytes() for k in kernel], pa.binary())], ["lang", "h", "kernel"])

    seen = sample.select("lang", "text", "h").mapInArrow(examples, "lang string, h long, kernel binary").collect()
    seen.sort(key=lambda r: (number[r["lang"]], r["h"]))
    kernel = np.concatenate([np.frombuffer(bytes(r["kernel"]), dtype=np.float64).reshape(-1, len(sets)) for r in seen])
    own = np.repeat([number[r["lang"]] for r in seen], 1 + len(PASSAGES))
    weights = solve(kernel, bare.kernel(sets), own, len(languages), ridge)
    return Model(languages, bare.grams, bare.has, bare.size, weights)


def predict(docs: DataFrame, model: Model | None, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per row of docs: the columns in ``carry``, lang_pred and score.

    lang_pred is the language of the largest output (of equal ones the first by
    UTF-8 bytes), score that output, from -1 to 1, laid out from 0 to 1. Null
    texts, texts without a letter and all texts without a model are ``und``
    with score 0. Whole texts are read, in one piece however long: a text takes
    about 40 bytes of memory for each of its own.
    """
    spark = docs.sparkSession
    asked = docs.select(F.struct(F.lit(0).alias("__"), *carry).alias("carried"), F.when(has_letter(F.col(text_col).cast("string")), F.col(text_col).cast("string")).alias("text"))
    if model is None:
        return asked.select(*(F.col("carried")[c].alias(c) for c in carry), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = spark.sparkContext.broadcast(model)

    def scored(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches.slices(parts):
            texts = batches.as_bytes(batch.column(1))
            asked = [i for i, t in enumerate(texts) if t]
            langs, scores = ["und"] * len(texts), [0.0] * len(texts)
            for at in range(0, len(asked), _ROWS):
                some = asked[at:at + _ROWS]
                # whole numbers and fixed sums of them: rounding hides what the order of sums may change
                out = np.round(shared.value.kernel([ngrams(texts[i]) for i in some]) @ shared.value.weights, 9)
                best = out.argmax(axis=1)
                for i, b, o in zip(some, best, out[np.arange(len(some)), best], strict=True):
                    langs[i], scores[i] = shared.value.languages[b], float(np.clip((o + 1) / 2, 0, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs), pa.array(scores)], ["carried", "lang_pred", "score"])

    kind = asked.schema["carried"].dataType.simpleString()
    found = asked.mapInArrow(scored, f"carried {kind}, lang_pred string, score double")
    return found.select(*(F.col("carried")[c].alias(c) for c in carry), "lang_pred", "score")


def held_out(id_col: Column) -> Column:
    """Whether the crc32 of the decimal id leaves 1 when divided by 3; false for a null id."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 3 == 1, F.lit(False))


def predict_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of docs (doc_id, text, lang), learned from those that aren't held out.

    Rows without an id aren't held out. Other columns are not read. An empty
    table gives an empty result.
    """
    marked = docs.select("doc_id", "text", "lang", held_out(F.col("doc_id")).alias("held_out"))
    return predict(marked, fit(marked.where("NOT held_out")), carry=("doc_id", "held_out"))
