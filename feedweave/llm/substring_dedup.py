"""Substring dedup by suffix automata of reference shards and matching statistics.

A window is ``words`` consecutive words of one document. Words covered by a
window whose word sequence starts anywhere else too are removed.

1. Each window has a minimizer: the least hash among its short word n-grams.
   Equal windows have equal minimizers. A minimizer that occurs at one place
   only has no equal windows; of the others, the owner is the least text hash
   among the documents that have it.
2. Each document is cut into pieces: the words of consecutive windows whose
   minimizers have one owner. Equal windows lie in pieces of one owner, so an
   owner's pieces are a group that is complete by itself. Equal pieces are
   counted and kept once, combined before the shuffle.
3. A group's pieces are dealt to reference shards of bounded size. For each
   shard, a suffix automaton over its words is built, with the number of places
   of every state, and sent all the group's pieces: matching statistics give
   for each word the longest sequence ending there that lies somewhere else;
   where they reach ``words``, the window is a repeat. Small groups share a task.
4. The spans go back to the documents, and maximal covered spans are removed.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedweave.llm import batches, hashing
from feedweave.llm.batches import written

#: Words of a minimizer's n-gram.
ANCHOR_WORDS = 8
#: Words of a reference shard: bounds one automaton.
SHARD_WORDS = 100_000


class SuffixAutomaton:
    """Of several word sequences; places counts a state's occurrences, each sequence as often as its weight."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.places = [-1], [0], [0]

    def _state(self, length: int, link: int, step: dict[int, int]) -> int:
        self.next.append(step)
        self.length.append(length)
        self.link.append(link)
        self.places.append(0)
        return len(self.link) - 1

    def add(self, sequence: list[int], weight: int) -> None:
        nxt, link, length = self.next, self.link, self.length
        last = 0
        for c in sequence:
            p, q = last, nxt[last].get(c)
            if q is not None:
                last = q if length[q] == length[p] + 1 else self._clone(p, q, c)
            else:
                last = self._state(length[p] + 1, 0, {})
                while p >= 0 and c not in nxt[p]:
                    nxt[p][c] = last
                    p = link[p]
                if p >= 0:
                    q = nxt[p][c]
                    link[last] = q if length[q] == length[p] + 1 else self._clone(p, q, c)
            self.places[last] += weight

    def _clone(self, p: int, q: int, c: int) -> int:
        nxt, link = self.next, self.link
        new = self._state(self.length[p] + 1, link[q], nxt[q].copy())
        link[q] = new
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        return new

    def close(self) -> None:
        """After the last add: places of a state include those of all longer sequences that end with it."""
        for v in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            if self.link[v] > 0:
                self.places[self.link[v]] += self.places[v]

    def covered(self, sequence: list[int], least: int, places: int) -> list[tuple[int, int]]:
        """Maximal spans of the sequence covered by runs of ``least`` that have so many places here."""
        nxt, link, length, of = self.next, self.link, self.length, self.places
        out: list[tuple[int, int]] = []
        v = n = 0
        for i, c in enumerate(sequence):
            q = nxt[v].get(c)
            while v and (q is None or of[q] < places):
                v = link[v]
                n = length[v]
                q = nxt[v].get(c)
            if q is not None and of[q] >= places:
                v, n = q, n + 1
                if n >= least:
                    if out and out[-1][1] >= i + 1 - least:
                        out[-1] = (out[-1][0], i + 1)
                    else:
                        out.append((i + 1 - least, i + 1))
        return out


def minimizers(low: np.ndarray, window: int, gram: int) -> np.ndarray:
    """For each window of words, the least of its n-grams' hashes, which are given."""
    need = window - gram + 1
    if len(low) < need:
        return np.zeros(0, dtype=np.uint64)
    width = 1
    while 2 * width <= need:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < need:
        low = np.minimum(low[:-(need - width)], low[need - width:])
    return low


def _starts(values: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, dtype=np.int64)


def find_repeats(docs: DataFrame, words: int, id_col: str, text_col: str, anchor_words: int, carry: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(texts with id, text, th, carried) and (id, th, spans), th being the hash of the text: word ranges to remove, which may overlap."""
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.struct(F.lit(0).alias("__"), *carry).alias("carried")).withColumn("th", F.xxhash64("text"))
    kind = texts.schema["id"].dataType.simpleString()
    gram = max(1, min(anchor_words, words - 1))

    def anchors(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches.slices(rows):
            found = hashing.Words(batches.as_bytes(batch.column(1)))
            row, value, count = [], [], []
            for i, (a, b) in enumerate(zip(found.first[:-1], found.first[1:], strict=True)):
                grams = hashing.ngram_hashes(found.hash[a:b], gram)
                low = minimizers(grams, words, gram)
                if len(low):
                    values = np.unique(low[_starts(low)])
                    grams, times = np.unique(grams, return_counts=True)
                    row.append(np.full(len(values), i))
                    value.append(values)
                    count.append(times[np.searchsorted(grams, values)])
            if row:
                row = pa.array(np.concatenate(row))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(2).take(row), pa.array(np.concatenate(value).view(np.int64)), pa.array(np.concatenate(count))], ["id", "th", "anchor", "n"])

    found = written(texts.select("id", "text", "th").mapInArrow(anchors, f"id {kind}, th long, anchor long, n long"), "anchors")
    owners = found.groupBy("anchor").agg(F.sum("n").alias("n"), F.min("th").alias("owner")).where("n > 1").drop("n")
    marks = found.select("id", "th", "anchor").join(owners, "anchor").groupBy("id", "th").agg(F.collect_set(F.struct("anchor", "owner")).alias("marks"))
    marked = texts.drop("carried").join(marks.withColumnsRenamed({"id": "m_id", "th": "m_th"}), F.col("id").eqNullSafe(F.col("m_id")) & (F.col("th") == F.col("m_th"))).select("id", "text", "th", "marks")

    def pieces(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches.slices(rows):
            texts = batches.as_bytes(batch.column(1))
            found = hashing.Words(texts)
            marks = batch.column(3)
            cuts = marks.offsets.to_numpy()
            flat = marks.values.field("anchor").to_numpy().view(np.uint64), marks.values.field("owner").to_numpy()
            row, owner, start, size, content, digest = [], [], [], [], [], []
            for i, (a, b) in enumerate(zip(found.first[:-1], found.first[1:], strict=True)):
                low = minimizers(hashing.ngram_hashes(found.hash[a:b], gram), words, gram)
                anchor, of = (x[cuts[i]:cuts[i + 1]] for x in flat)
                order = np.argsort(anchor)
                anchor, of = anchor[order], of[order]
                at = np.minimum(np.searchsorted(anchor, low), len(anchor) - 1)
                known, mine = anchor[at] == low, of[at]
                # runs of windows that have one owner
                cut = np.flatnonzero(np.append(True, (known[1:] != known[:-1]) | (mine[1:] != mine[:-1])))
                for x, y in zip(cut, np.append(cut[1:], len(low)), strict=True):
                    if known[x]:
                        n = int(y - x) + words - 1
                        piece = b" ".join(found.data[found.start[a + x]:found.end[a + x + n - 1]].split())
                        row.append(i)
                        owner.append(int(mine[x]))
                        start.append(int(x))
                        size.append(n)
                        content.append(piece)
                        digest.append(hashlib.blake2b(piece, digest_size=16).digest())
            if row:
                row = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(owner, pa.int64()), pa.array(digest, pa.binary()), batch.column(0).take(row), batch.column(2).take(row), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(content, pa.binary())], ["owner", "digest", "id", "th", "start", "size", "content"])

    cut = written(marked.mapInArrow(pieces, f"owner long, digest binary, id {kind}, th long, start long, size long, content binary"), "pieces")
    single = cut.groupBy("owner", "digest").agg(F.count(F.lit(1)).alias("places"), F.max("size").alias("size"))
    groups = single.groupBy("owner").agg(F.sum("size").alias("weight"))
    distinct = cut.groupBy("owner", "digest").agg(F.count(F.lit(1)).alias("places"), F.max("size").alias("size"), F.first("content").alias("content")).join(groups, "owner")
    units = max(1, math.ceil((groups.agg(F.sum("weight")).first()[0] or 0) / SHARD_WORDS))
    shards = F.ceil(F.col("weight") / SHARD_WORDS).cast("int")
    dealt = distinct.withColumn("shards", shards).withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    unit = F.when(F.col("shards") == 1, F.pmod(F.xxhash64("owner"), F.lit(units)).cast("string")).otherwise(F.concat_ws(":", "owner", "shard"))
    dealt = dealt.select(unit.alias("unit"), "owner", "digest", "places", "content", (F.pmod(F.xxhash64("digest"), F.col("shards")) == F.col("shard")).alias("refers"))

    def matched(table: pa.Table) -> pa.Table:
        owners, digests, starts, ends = [], [], [], []
        table = table.sort_by([("owner", "ascending"), ("digest", "ascending")])
        rows = list(zip(*(table.column(c).to_pylist() for c in ("owner", "digest", "places", "content", "refers")), strict=True))
        for owner, group in groupby(rows, key=lambda r: r[0]):
            group = list(group)
            number: dict[bytes, int] = {}
            sequences = [[number.setdefault(w, len(number)) for w in r[3].split()] for r in group]
            if len(group) == 1 and group[0][4] and group[0][2] > 1:
                spans = [[(0, len(sequences[0]))]]
            else:
                automaton = SuffixAutomaton()
                for r, s in zip(group, sequences, strict=True):
                    if r[4]:
                        automaton.add(s, r[2])
                automaton.close()
                spans = [automaton.covered(s, words, 2 if r[4] else 1) for r, s in zip(group, sequences, strict=True)]
            for r, s in zip(group, spans, strict=True):
                for a, b in s:
                    owners.append(owner)
                    digests.append(r[1])
                    starts.append(a)
                    ends.append(b)
        return pa.table({"owner": pa.array(owners, pa.int64()), "digest": pa.array(digests, pa.binary()), "a": pa.array(starts, pa.int64()), "b": pa.array(ends, pa.int64())})

    spans = dealt.groupBy("unit").applyInArrow(matched, "owner long, digest binary, a long, b long").groupBy("owner", "digest").agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    placed = cut.select("owner", "digest", "id", "th", "start").join(spans, ["owner", "digest"])
    moved = F.transform("spans", lambda s: F.struct((s["a"] + F.col("start")).alias("a"), (s["b"] + F.col("start")).alias("b")))
    return texts, placed.select("id", "th", moved.alias("spans")).groupBy("id", "th").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def remove_repeats(docs: DataFrame, words: int = 50, id_col: str = "doc_id", text_col: str = "text", anchor_words: int = ANCHOR_WORDS, carry: tuple[str, ...] = (), as_is: bool = False) -> DataFrame:
    """One row per row of docs: id, n_words, n_removed, text (the kept words, joined by one space), and the columns in ``carry``.

    With ``as_is``, a text that loses nothing stays as it is.

    Words are runs of anything but space and 0x09-0x0D, compared as they are.
    Null text counts as empty: no words. A text of fewer than ``words`` words
    has no window and loses nothing. Repeated rows are places of their own, so
    they lose all their windows. Null ids are kept. Other columns are not read.
    An empty table gives an empty result.
    """
    if words < 2:
        raise ValueError("a window has two words at least")
    texts, spans = find_repeats(docs, words, id_col, text_col, anchor_words, carry)
    kind = texts.schema["id"].dataType.simpleString()
    joined = texts.join(spans.withColumnsRenamed({"id": "s_id", "th": "s_th"}), F.col("id").eqNullSafe(F.col("s_id")) & (F.col("th") == F.col("s_th")), "left").select("id", "text", F.col("spans.a").alias("a"), F.col("spans.b").alias("b"), "carried")

    def removed(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches.slices(rows):
            n_words, n_removed, kept = [], [], []
            for text, a, b in zip(batches.as_bytes(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                found = text.split()
                n_words.append(len(found))
                left = found
                if a:
                    depth = np.zeros(len(found) + 1, dtype=np.int64)
                    np.add.at(depth, a, 1)
                    np.add.at(depth, b, -1)
                    left = [found[i] for i in np.flatnonzero(np.cumsum(depth)[:-1] == 0).tolist()]
                n_removed.append(len(found) - len(left))
                kept.append(text if as_is and len(left) == len(found) else b" ".join(left))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), batch.column(4)], ["id", "n_words", "n_removed", "text", "carried"])

    carried = texts.schema["carried"].dataType.simpleString()
    out = joined.mapInArrow(removed, f"id {kind}, n_words long, n_removed long, text string, carried {carried}")
    return out.select(F.col("id").alias(id_col), "n_words", "n_removed", "text", *(F.col("carried")[c].alias(c) for c in carry))
