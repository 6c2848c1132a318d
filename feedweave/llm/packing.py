"""Packing by vector bin packing: tokens, segments and loss-bearing tokens are limited at once.

An example is a vector of three sizes. A sequence is opened, and of a bounded
buffer of waiting examples the one that fits and whose vector (as shares of
the limits) has the largest dot product with what is left of the sequence is
placed next, until none fits. With ``cut``, the largest waiting example is then
cut to fill the rest, so full sequences have no padding.

Each task packs the rows that it reads: no shuffle, and a buffer of bounded
size. Sequence ids carry the number of the task's partition in their high bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedweave.llm import batches, tokenizing

MAX_TOKENS = 4096
MAX_SEGMENTS = 1024
BUFFER = 512


@dataclass
class Piece:
    key: object
    start: int
    length: int
    sequence: int
    offset: int


class VectorPacker:
    """add() and finish() give the pieces of sequences as they close."""

    def __init__(self, limits: tuple[int, int, int], cut: bool = False, buffer: int = BUFFER):
        if min(limits) < 1:
            raise ValueError("each limit must be 1 at least")
        self.limits, self.cut, self.buffer = np.array(limits, dtype=np.int64), cut, buffer
        self.size = np.zeros((buffer, 3), dtype=np.int64)
        self.keys: list = [None] * buffer
        self.starts = [0] * buffer
        self.n, self.sequences = 0, 0
        self._open()

    def _open(self) -> None:
        self.left, self.placed = self.limits.copy(), []

    def add(self, key, tokens: int, loss: int) -> list[Piece]:
        """An example; with ``cut``, every token must bear loss."""
        size = np.array([tokens, 1, loss], dtype=np.int64)
        if not self.cut and (size > self.limits).any():
            raise ValueError(f"{key!r} is larger than a sequence: {size.tolist()}")
        if self.cut and loss != tokens:
            raise ValueError("only examples whose tokens all bear loss can be cut")
        out, start = [], 0
        whole = int(min(self.limits[0], self.limits[2]))
        while self.cut and tokens - start >= whole:
            out.append(Piece(key, start, whole, self._next(), 0))
            start += whole
        if tokens == 0 or start < tokens:
            while self.n == self.buffer:
                out += self._place()
            self.size[self.n] = (tokens - start, 1, loss - start) if self.cut else size
            self.keys[self.n], self.starts[self.n] = key, start
            self.n += 1
        return out

    def finish(self) -> list[Piece]:
        out = []
        while self.n:
            out += self._place()
        return out + self._close()

    def _next(self) -> int:
        self.sequences += 1
        return self.sequences - 1

    def _take(self, i: int) -> None:
        self.n -= 1
        self.size[i], self.keys[i], self.starts[i] = self.size[self.n], self.keys[self.n], self.starts[self.n]

    def _place(self) -> list[Piece]:
        """One step: a piece into the open sequence, or the sequence closed."""
        size = self.size[:self.n]
        fits = (size <= self.left).all(axis=1)
        if fits.any():
            score = (size / self.limits) @ (self.left / self.limits)
            i = int(np.argmax(np.where(fits, score, -1.0)))
            self.placed.append((self.keys[i], self.starts[i], int(size[i, 0])))
            self.left -= size[i]
            self._take(i)
        elif self.cut and self.left[1] and (room := int(min(self.left[0], self.left[2]))):
            i = int(np.argmax(size[:, 0]))
            self.placed.append((self.keys[i], self.starts[i], room))
            self.left -= (room, 1, room)
            self.size[i] -= (room, 0, room)
            self.starts[i] += room
        else:
            return self._close()
        return self._close() if not self.left.all() else []

    def _close(self) -> list[Piece]:
        """The open sequence's pieces. With ``cut``, one that isn't full is cut into powers of two, which need no padding."""
        out, placed, total = [], self.placed, sum(x[2] for x in self.placed)
        if placed and (not self.cut or total == self.limits[0]):
            sequence, at = self._next(), 0
            for key, start, length in placed:
                out.append(Piece(key, start, length, sequence, at))
                at += length
        elif placed:
            placed, room = placed[::-1], 0
            while placed:
                key, start, length = placed.pop()
                while length or not total:
                    if not room:
                        full = room = 1 << max(0, total.bit_length() - 1)
                        sequence = self._next()
                    n = min(room, length)
                    out.append(Piece(key, start, n, sequence, full - room))
                    start, length, room, total = start + n, length - n, room - n, total - n
                    if not length:
                        break
        self._open()
        return out


#: Bits of a sequence id that number the sequences of one task.
TASK_BITS = 40


def _base() -> int:
    return TaskContext.get().partitionId() << TASK_BITS


def pack_documents(docs: DataFrame, path: str, end_id: int | None = 2, max_tokens: int = MAX_TOKENS, max_segments: int = MAX_SEGMENTS,
                   max_loss: int = MAX_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenized documents, cut into pieces that fill sequences: one row per piece.

    Columns: id, start, length, ids (binary, little-endian unsigned 32-bit),
    doc_tokens (with the end id), sequence_id, offset. Every token bears loss.
    Null text counts as empty: its only token is the end id (without one, it
    gives no piece). Null ids and repeated rows are packed like any other.
    Other columns are not read. An empty table gives an empty result.
    """

    def pack(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokenizing.packed_encoder(path)
        end = b"" if end_id is None else end_id.to_bytes(4, "little")
        packer, base = VectorPacker((max_tokens, max_segments, max_loss), cut=True), _base()
        held: dict[int, tuple] = {}
        serial = 0

        def table(pieces: list[Piece]) -> pa.RecordBatch:
            rows = [(held[p.key], p) for p in pieces]
            made = pa.RecordBatch.from_arrays([pa.array([d[0] for d, _ in rows], kind), pa.array([p.start for _, p in rows], pa.int64()), pa.array([p.length for _, p in rows], pa.int64()), pa.array([d[1][4 * p.start:4 * (p.start + p.length)] for d, p in rows], pa.binary()), pa.array([len(d[1]) // 4 for d, _ in rows], pa.int64()), pa.array([base | p.sequence for _, p in rows], pa.int64()), pa.array([p.offset for _, p in rows], pa.int64())], names)
            for d, p in rows:
                d[2] -= p.length
                if not d[2]:
                    del held[p.key]
            return made

        kind = None
        for batch in batches.slices(rows):
            kind = batch.column(0).type
            packed = encoder.encode(batches.as_str(batch.column(1)))
            out = []
            for doc, ids in zip(batch.column(0).to_pylist(), packed, strict=True):
                ids += end
                if ids:
                    held[serial] = [doc, ids, len(ids) // 4]
                    out += packer.add(serial, len(ids) // 4, len(ids) // 4)
                    serial += 1
            if out:
                yield table(out)
        if kind is not None and (out := packer.finish()):
            yield table(out)

    names = ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    kind_name = docs.select(F.col(id_col).alias("id")).schema["id"].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        pack, f"id {kind_name}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long").withColumnRenamed("id", id_col)


def pack_examples(examples: DataFrame, max_tokens: int, max_segments: int, max_loss: int, id_col: str = "id", tokens_col: str = "n_tokens",
                  loss_col: str = "n_loss", buffer: int = BUFFER) -> DataFrame:
    """Whole instruction examples into sequences: one row per example, with sequence_id and offset.

    n_loss is the number of tokens that bear loss (null: all). Null n_tokens
    counts as 0. An example beyond a limit can't be placed whole: it keeps a
    row with null sequence_id and offset. Null ids and repeated rows are packed
    like any other; an empty table gives an empty result.
    """

    def pack(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, base, kind = VectorPacker((max_tokens, max_segments, max_loss), buffer=buffer), _base(), None

        def table(pieces: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in pieces], kind), *(pa.array([x[i] for x in pieces], pa.int64()) for i in (1, 2, 3, 4))], ["id", "n_tokens", "n_loss", "sequence_id", "offset"])

        for batch in rows:
            kind, out = batch.column(0).type, []
            for key, tokens, loss in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if tokens > max_tokens or loss > max_loss:
                    out.append((key, tokens, loss, None, None))
                else:
                    out += [(*p.key, base | p.sequence, p.offset) for p in packer.add((key, tokens, loss), tokens, loss)]
            if out:
                yield table(out)
        if kind is not None and (out := packer.finish()):
            yield table([(*p.key, base | p.sequence, p.offset) for p in out])

    tokens = F.coalesce(F.col(tokens_col).cast("long"), F.lit(0))
    kind_name = examples.select(F.col(id_col).alias("id")).schema["id"].dataType.simpleString()
    return examples.select(F.col(id_col).alias("id"), tokens.alias("t"), F.coalesce(F.col(loss_col).cast("long"), tokens).alias("l")).mapInArrow(
        pack, f"id {kind_name}, n_tokens long, n_loss long, sequence_id long, offset long").withColumnRenamed("id", id_col)
