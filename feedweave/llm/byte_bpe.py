"""Byte-level BPE encoding and decoding with a rank queue made of hierarchical bitmaps.

The ranks file gives each byte string its rank; ids are ranks. A pre-token
that has a rank is that id. The others are merged many at a time: their bytes
are parts of doubly linked lists in one buffer, and the adjacent pairs whose
joined bytes have the lowest rank are merged first, from left to right. Each
rank has a bucket of the list positions whose pair has it; a three-level bitmap
over the ranks marks the buckets that hold any, so that find-first-set on three
words gives the next rank, for all pre-tokens of the buffer. A merge changes two
neighbours; what their old buckets hold of them is left there and skipped as
stale when it comes up. So n bytes take O(n) bucket entries, however they are
split into pre-tokens, each O(log) for its place in a bucket.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedweave.llm import batches, tokenizing

#: Fan-out of the bitmap: words of 64 bits, three levels (262,144 ranks).
_BITS = 6
#: Bytes of pre-tokens that are merged together; a longer one is alone.
MERGED_BYTES = 1 << 18


class RankQueue:
    """Positions by rank; the lowest rank's bucket is taken whole. Empty again after a full drain, so it is reused."""

    __slots__ = ("top", "mid", "low", "bucket")

    def __init__(self):
        self.top = 0
        self.mid = [0] * (1 << _BITS)
        self.low = [0] * (1 << 2 * _BITS)
        self.bucket: dict[int, list[int]] = {}

    def add(self, rank: int, held: list[int]) -> None:
        """Positions in any order."""
        bucket = self.bucket
        if rank in bucket:
            bucket[rank] += held
            return
        bucket[rank] = held
        word = rank >> 6
        low = self.low
        if not low[word]:
            group = rank >> 12
            if not self.mid[group]:
                self.top |= 1 << group
            self.mid[group] |= 1 << (word & 63)
        low[word] |= 1 << (rank & 63)

    def take(self) -> tuple[int, list[int]] | None:
        """The lowest rank and its positions, the last first."""
        top = self.top
        if not top:
            return None
        group = (top & -top).bit_length() - 1
        mid = self.mid[group]
        word = group << 6 | (mid & -mid).bit_length() - 1
        low = self.low[word]
        rank = word << 6 | (low & -low).bit_length() - 1
        low &= low - 1
        self.low[word] = low
        if not low:
            mid &= mid - 1
            self.mid[group] = mid
            if not mid:
                self.top = top & (top - 1)
        held = self.bucket.pop(rank)
        held.sort(reverse=True)
        return rank, held

    def push(self, rank: int, at: int) -> None:
        self.add(rank, [at])

    def pop(self) -> tuple[int, int] | None:
        """The lowest rank's smallest position."""
        lowest = self.take()
        if lowest is None:
            return None
        rank, held = lowest
        at = held.pop()
        if held:
            self.add(rank, held)
        return rank, at


class BytePairEncoder:
    """ids of texts by the ranks at ``path`` and the pre-token ``pattern``, and bytes of ids."""

    def __init__(self, path: str, pattern: str, memo_entries: int = 2 * tokenizing.MEMO_ENTRIES):
        import regex

        self.find = regex.compile(pattern).findall
        self.ranks: dict[bytes, int] = {}
        with open(path, "rb") as lines:
            for line in lines:
                if line.strip():
                    token, rank = line.split()
                    self.ranks[base64.b64decode(token)] = int(rank)
        if max(self.ranks.values()) >= 1 << 3 * _BITS:
            raise ValueError("the bitmap has room for 262,144 ranks")
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.packed = {rank: array("I", [rank]).tobytes() for rank in self.tokens}
        self.of_one = np.array([self.ranks[bytes([x])] for x in range(256)])
        self.of_two = np.array([self.ranks.get(bytes([x, y]), -1) for x in range(256) for y in range(256)])
        self.memo = tokenizing.Memo(self._packed, memo_entries)
        self.words: dict[str, bytes] = {}
        self.queue = RankQueue()

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Packed ids of pre-tokens, which are merged together in buffers of about MERGED_BYTES."""
        ranks = self.ranks
        out = [b"" if not word else self.packed[whole] if (whole := ranks.get(word)) is not None else None for word in words]
        rest = [i for i, x in enumerate(out) if x is None]
        at = 0
        while at < len(rest):
            to, size = at, 0
            while to < len(rest) and (to == at or size + len(words[rest[to]]) <= MERGED_BYTES):
                size += len(words[rest[to]])
                to += 1
            for i, ids in zip(rest[at:to], self._merged([words[i] for i in rest[at:to]]), strict=True):
                out[i] = ids
            at = to
        return out

    def _merged(self, words: list[bytes]) -> list[bytes]:
        """Of words that aren't empty and have no rank of their own, each of which has a place after it in the buffer."""
        get, queue = self.ranks.get, self.queue
        add = queue.add
        data = b"\n".join([*words, b""])
        n = len(data)
        raw = np.frombuffer(data, np.uint8).astype(np.int32)
        ends = np.cumsum([len(x) + 1 for x in words]) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        rank_at = np.append(self.of_two[raw[:-1] << 8 | raw[1:]], -1)
        rank_at[ends] = rank_at[ends - 1] = -1
        left_of = np.arange(-1, n - 1)
        left_of[starts] = -1
        edge = bytearray(n)
        for end in ends.tolist():
            edge[end] = 1
        after, before, pair, ident = list(range(1, n + 1)), left_of.tolist(), rank_at.tolist(), self.of_one[raw].tolist()
        places = np.flatnonzero(rank_at >= 0)
        places = places[np.argsort(rank_at[places], kind="stable")]
        cuts = np.flatnonzero(np.diff(rank_at[places], prepend=-1)).tolist()
        for a, b in pairwise([*cuts, len(places)]):
            add(int(rank_at[places[a]]), places[a:b].tolist())
        while (lowest := queue.take()) is not None:
            rank, held = lowest
            while held:
                i = held.pop()
                if pair[i] != rank:
                    continue  # stale: merged away, or its neighbour has changed
                ident[i] = rank
                gone = after[i]
                end = after[i] = after[gone]
                pair[gone] = pair[i] = -1
                least = rank + 1
                if not edge[end]:
                    before[end] = i
                    new = get(data[i:after[end]])
                    if new is not None:
                        pair[i] = new
                        add(new, [i])
                        least = new
                left = before[i]
                if left >= 0:
                    new = get(data[left:end])
                    if new is None:
                        pair[left] = -1
                    else:
                        pair[left] = new
                        add(new, [left])
                        if new < least:
                            least = new
                if least <= rank:
                    # what this merge has made comes before the rest of the bucket
                    if held:
                        add(rank, held)
                    break
        out = []
        for i, end in zip(starts.tolist(), ends.tolist(), strict=True):
            ids = []
            while i < end:
                ids.append(ident[i])
                i = after[i]
            out.append(array("I", ids).tobytes())
        return out

    def _packed(self, pieces: list[str]) -> list[bytes]:
        words = self.words
        if len(words) > self.memo.entries:
            words.clear()
        cut = [self.find(piece) for piece in pieces]
        new = list({w for found in cut for w in found if w not in words})
        made = dict(zip(new, self.merge([w.encode() for w in new]), strict=True))
        out = [b"".join([words[w] if w in words else made[w] for w in found]) for found in cut]
        words.update((w, ids) for w, ids in made.items() if len(w) <= 64)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """ids of each text as little-endian unsigned 32-bit integers."""
        cut = [tokenizing.segments(x) for x in texts]
        self.memo.fill(cut)
        return [b"".join(map(self.memo.held.__getitem__, x)) for x in cut]

    def decode(self, packed: bytes) -> bytes:
        """The bytes that the ids stand for."""
        return b"".join(map(self.tokens.__getitem__, memoryview(packed).cast("I")))


_ENCODERS: dict[tuple[str, str], BytePairEncoder] = {}


def encoder(path: str, pattern: str) -> BytePairEncoder:
    """One for each worker, so that its memo outlives a task."""
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = BytePairEncoder(path, pattern)
    return _ENCODERS[path, pattern]


def encode_texts(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ids (binary, little-endian unsigned 32-bit), n_tokens, ids_sha256, decoded_sha256.

    decoded_sha256 is that of the bytes that come back from the ids. Null text
    counts as empty (no ids). Null ids and repeated rows pass through; other
    columns are not read; an empty table gives an empty result. No shuffle.
    """

    def encode(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path, pattern)
        for batch in batches.slices(rows):
            ids = bpe.encode(batches.as_str(batch.column(1)))
            sha = lambda x: hashlib.sha256(x).hexdigest()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(map(sha, ids), pa.string()), pa.array([sha(bpe.decode(x)) for x in ids], pa.string())], ["id", "ids", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.select(F.col(id_col).alias("id")).schema["id"].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        encode, f"id {kind}, ids binary, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)


def decode_ids(rows: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The inverse: id and bytes (binary) of packed ids; null ids give no bytes."""

    def decode(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path, pattern)
        for batch in batches.slices(parts):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([bpe.decode(x or b"") for x in batch.column(1).to_pylist()], pa.binary())], ["id", "bytes"])

    kind = rows.select(F.col(id_col).alias("id")).schema["id"].dataType.simpleString()
    return rows.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(decode, f"id {kind}, bytes binary").withColumnRenamed("id", id_col)
