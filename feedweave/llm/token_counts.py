"""Token counts of whole texts, huge ones by overlapping chunks that are spliced at stable boundaries.

Texts up to ``chunk_chars`` are encoded whole. A longer one is cut into chunks
of that length; each reaches ``overlap_chars`` into the next. Every chunk is
encoded by itself, with the offsets of its pre-tokens and the tokens before
each. Two neighbours are spliced at a boundary that

* both have, at the same offset of the document, and
* lies so far before the left chunk's end that nothing beyond that end can
  move it (the longest special string, or the pattern's look-ahead).

The pattern scans forward only, so from a common boundary on, both scans agree
with the scan of the whole text: the splice is exact. If the overlap has no
such boundary (a pre-token longer than the overlap), the left chunk is encoded
again with twice the reach, until one is found, the next chunk is swallowed
whole, or the document ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedweave.llm import batches, tokenizing

CHUNK_CHARS = 32_768
OVERLAP_CHARS = 1_024
#: Longer segments are not kept in the memo; the offsets of their pre-tokens are boundaries too.
LONG_SEGMENT = 256


class ChunkedCounter:
    """Counts the tokens of texts as the tokenizers library does for the vocabulary at ``path``."""

    def __init__(self, path: str, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS):
        if not 0 < overlap_chars <= chunk_chars:
            raise ValueError("overlap_chars must lie between 1 and chunk_chars")
        self.tok = tokenizing.tokenizer(path)
        self.chunk, self.overlap = chunk_chars, overlap_chars
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.margin = 8 + max(map(len, self.special), default=0)
        self.memo = tokenizing.Memo(self._lengths)

    def _lengths(self, pieces: list[str]) -> list[int]:
        return list(map(len, self.tok.encode_batch_fast(pieces, add_special_tokens=False)))

    def count(self, texts: list[str]) -> list[int]:
        parts, owner = [], []
        for i, text in enumerate(texts):
            for at in range(0, max(1, len(text)), self.chunk) if len(text) > self.chunk else (0,):
                parts.append(text[at:at + self.chunk + self.overlap] if len(text) > self.chunk else text)
                owner.append((i, at))
        cut = [tokenizing.segments(x) for x in parts]
        self.memo.fill([[s for s in x if len(s) <= LONG_SEGMENT] for x in cut])
        out, k = [0] * len(texts), 0
        while k < len(parts):
            i, n = owner[k][0], 1
            while k + n < len(parts) and owner[k + n][0] == i:
                n += 1
            if n == 1:
                out[i] = sum(self._tokens(s) for s in cut[k])
            else:
                out[i] = self._splice(texts[i], [(owner[j][1], len(parts[j]), self._boundaries(cut[j])) for j in range(k, k + n)])
            k += n
        return out

    def _tokens(self, segment: str) -> int:
        have = self.memo.held.get(segment)
        return have if have is not None else len(self.tok.encode(segment, add_special_tokens=False))

    def _boundaries(self, cut: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Offsets at which pre-tokens start, and the tokens before each; last the chunk's end and all its tokens."""
        at, before, offsets, counts = 0, 0, [], []
        for s in cut:
            offsets.append(at)
            counts.append(before)
            if len(s) > LONG_SEGMENT and not any(x in s for x in self.special):
                words = [w for w in self.tok.encode(s, add_special_tokens=False).word_ids if w is not None]
                per = np.bincount(words) if words else np.zeros(0, dtype=int)
                spans = [span for _, span in self.tok.pre_tokenizer.pre_tokenize_str(s)]
                if len(spans) == len(per):
                    offsets += [at + a for a, _ in spans[1:]]
                    counts += (before + np.cumsum(per)[:-1]).tolist()
                before += len(words)
            else:
                before += self._tokens(s)
            at += len(s)
        return np.array([*offsets, at]), np.array([*counts, before])

    def _splice(self, text: str, chunks: list[tuple[int, int, tuple[np.ndarray, np.ndarray]]]) -> int:
        """chunks: start in the document, length, boundaries. Tokens of the whole text."""
        total, k = 0, 0
        # what counts of the current chunk starts at this offset of the document, with so many of its tokens before
        (start, length, (offsets, counts)), skipped = chunks[0], 0
        since = 0
        while start + length < len(text):
            k += 1
            if k == len(chunks):
                # the last chunk was swallowed and the text goes on: widen to its end
                start, length, (offsets, counts), skipped = self._again(text, since, len(text))
                break
            right, right_length, (theirs, their_counts) = chunks[k]
            reach = self.overlap
            while True:
                if start + length >= right + right_length and start + length >= len(text):
                    break  # swallowed, and the document ends here
                stable = offsets[offsets + start + self.margin <= start + length] + start
                stable = stable[(stable >= right) & (stable > since)]
                common = np.intersect1d(stable, theirs[:-1] + right)
                common = common[common > right] if right else common
                if len(common):
                    at = int(common[0])
                    total += int(counts[np.searchsorted(offsets, at - start)]) - skipped
                    skipped = int(their_counts[np.searchsorted(theirs, at - right)])
                    start, length, offsets, counts, since = right, right_length, theirs, their_counts, at
                    break
                if start + length >= right + right_length:
                    break  # swallowed whole: go on with the next one
                reach *= 2
                start, length, (offsets, counts), skipped = self._again(text, since, right + reach)
        return total + int(counts[-1]) - skipped

    def _again(self, text: str, since: int, to: int):
        """The current chunk from its last splice on, encoded with a longer reach."""
        piece = text[since:to]
        return since, len(piece), self._boundaries(tokenizing.segments(piece)), 0


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024,
                 chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """One row per document: id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    Null text counts as empty: 0 bytes, 0 tokens. Null ids and repeated rows
    pass through, one result for each row. Other columns are not read. An
    empty table gives an empty result. No shuffle: rows are encoded where
    they are read, in slices of bounded size.
    """

    def encode(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = ChunkedCounter(path, chunk_chars, overlap_chars)
        for batch in batches.slices(rows):
            texts = batches.as_str(batch.column(1))
            n = counter.count(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x.encode()) for x in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.select(F.col(id_col).alias("id")).schema["id"].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        encode, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)
