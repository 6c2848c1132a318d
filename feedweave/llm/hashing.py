"""Vectorised 64-bit hashing of ASCII-space-separated words, shared by the text operators.

Everything here works on one Arrow batch at a time: the batch's texts are laid
end to end in one byte buffer, and words, n-grams and their hashes come out of
a fixed number of numpy passes, without a Python loop over words.
"""

from __future__ import annotations

import numpy as np

#: Separators of words: space and the controls 0x09 to 0x0D.
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.Generator(np.random.PCG64(20240501)).integers(1, 1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW: dict[int, np.ndarray] = {}


def _pow(base: int, n: int) -> np.ndarray:
    have = _POW.get(base)
    if have is None or len(have) < n:
        have = _POW[base] = _powers(base, 1 << max(16, (n - 1).bit_length()))
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """An invertible 64-bit finaliser, so that near hashes fall far apart."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """Words of a batch of texts.

    hash: one 64-bit hash per word, in text order; start, end: byte offsets in
    ``data``; first: for text i its words are first[i] .. first[i + 1].
    """

    def __init__(self, texts: list[bytes], lower: bool = False):
        # a separator after each text keeps its last word apart from the next text
        self.data = b"\n".join([*texts, b""])
        raw = np.frombuffer(self.data, dtype=np.uint8)
        cuts = np.zeros(len(texts) + 1, dtype=np.int64)
        np.cumsum([len(t) + 1 for t in texts], out=cuts[1:])
        inside = ~_SPACE[raw]
        edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
        self.start, self.end = edge[0::2], edge[1::2]
        self.first = np.searchsorted(self.start, cuts)
        self.cuts = cuts
        if lower:
            raw = _LOWER[raw]
        total = np.zeros(len(raw) + 1, dtype=np.uint64)
        # in blocks, so that the 8-byte temporaries stay small beside the text
        base, step = np.uint64(0), 1 << 20
        power = _pow(_BASE, step)
        for at in range(0, len(raw), step):
            piece = _BYTE[raw[at:at + step]] * power[:min(step, len(raw) - at)]
            piece *= np.uint64(pow(_BASE, at, 1 << 64))
            np.cumsum(piece, out=total[at + 1:at + 1 + len(piece)])
            total[at + 1:at + 1 + len(piece)] += base
            base = total[at + len(piece)]
        inverse = _inverse_powers(self.start)
        self.hash = mix((total[self.end] - total[self.start]) * inverse)


def _inverse_powers(at: np.ndarray) -> np.ndarray:
    """_BASE ** -at for each offset, from two short tables."""
    low = _pow(_BASE_INV, 1 << 16)
    high = _pow(pow(_BASE_INV, 1 << 16, 1 << 64), max(1, int(at[-1] >> 16) + 1) if len(at) else 1)
    return low[at & 0xFFFF] * high[at >> 16]


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """The hash of each run of n consecutive words; empty if there are fewer than n."""
    if len(words) < n:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(len(words) - n + 1, dtype=np.uint64)
    for i in range(n):
        out = out * np.uint64(0xD6E8FEB86659FD93) + words[i:len(words) - n + 1 + i]
    return mix(out)


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """As ngram_hashes in a number of passes that does not grow with n (a rolling polynomial)."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(words * _pow(_BASE, len(words)), out=total[1:])
    return mix((total[n:] - total[:m]) * _pow(_BASE_INV, m))


def shingle_sets(texts: list[bytes], n: int, lower: bool = True) -> list[np.ndarray]:
    """Sorted distinct n-word shingles of each text; a shorter text is one shingle, an empty one none."""
    words = Words(texts, lower)
    out = []
    for a, b in zip(words.first[:-1], words.first[1:], strict=True):
        own = words.hash[a:b]
        if len(own) >= n:
            out.append(np.unique(ngram_hashes(own, n)))
        elif len(own):
            # the length takes part, so that a short sequence never equals a shingle of n words
            out.append(mix(ngram_hashes(own, len(own)) + np.uint64(len(own))))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out
