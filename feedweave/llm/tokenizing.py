"""Tokenizers' library inside tasks: whole texts through a bounded memo of space-separated segments.

A single space between two characters that are not white space always starts
a new pre-token (byte-level vocabularies) or is dropped (word vocabularies).
So a text may be cut there, and the ids of the whole are those of the segments
in turn. Segments repeat a lot; each distinct one goes through the library once
until the memo is full and starts anew.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable

#: A space beside other white space is no cut.
_BESIDE = re.compile(r"\s | \s")
_CUT = re.compile(r"(?<=\S) (?=\S)")

MEMO_ENTRIES = 300_000


def vocabulary_path(name: str, path: str | None = None) -> str:
    """path, or where the installed package of public tokenizers keeps the file of this name."""
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(name)


_LOADED: dict[str, object] = {}


def tokenizer(path: str):
    """The library's tokenizer, loaded once a worker; it must not start threads beside Spark's own."""
    if path not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _LOADED[path] = Tokenizer.from_file(path)
    return _LOADED[path]


def segments(text: str) -> list[str]:
    """Pieces that give the whole text when joined by "" (each but the first starts with the space before it)."""
    if not text:
        return []
    first, *rest = text.split(" ") if not _BESIDE.search(text) else _CUT.split(text)
    out = [" " + x for x in rest]
    return [first, *out] if first else out


class Memo:
    """segment -> value, filled by ``make`` for batches of new segments; at most ``entries`` are held."""

    def __init__(self, make: Callable[[list[str]], list], entries: int = MEMO_ENTRIES):
        self.make, self.entries, self.held = make, entries, {}

    def fill(self, pieces: list[list[str]]) -> None:
        """After this, ``held`` has every segment of the given texts."""
        if len(self.held) > self.entries:
            self.held.clear()
        new = set()
        for x in pieces:
            new.update(x)
        new = [x for x in new if x not in self.held]
        for at in range(0, len(new), 20_000):
            part = new[at:at + 20_000]
            self.held.update(zip(part, self.make(part), strict=True))


#: How the word vocabulary's file splits text, and marks that compose with ASCII letters.
_WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_WORD_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
_MARKS = re.compile("[̀-ͯ]")
_PLAIN = re.compile(r"[!-&(-@\[-~ \t-\r]+")
_PLAIN_PARTS = re.compile(r"[a-z]+|[0-9]|[!-/:-@\[-`{-~]+")


class PackedEncoder:
    """ids of whole texts as little-endian unsigned 32-bit integers, as the library gives them without added tokens.

    For a word vocabulary (lower case, white space dropped) a segment of plain
    ASCII is split here by the file's own pattern, and its words go to the
    library's model one by one; all other segments go through the whole library.
    """

    def __init__(self, path: str, entries: int = 2 * MEMO_ENTRIES):
        import json

        self.tok = tokenizer(path)
        spec = json.loads(self.tok.to_str())
        parts = [((spec["normalizer"] or {}).get("normalizers") or []), ((spec["pre_tokenizer"] or {}).get("pretokenizers") or [])]
        self.words = [x["type"] for x in parts[0]] == _WORD_NORMALIZERS and [x["type"] for x in parts[1]] == ["Split", "ByteLevel"] and parts[1][0]["pattern"] == {"Regex": _WORD_SPLIT} and not parts[1][1]["use_regex"]
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.memo = Memo(self._make, entries)
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [segments(self._folded(x)) for x in texts]
        self.memo.fill(cut)
        held = self.memo.held
        return [b"".join([held[s] for s in x]) for x in cut]

    def _folded(self, text: str) -> str:
        """A-Z in lower case where that can change no id: no special string can appear, nothing composes with another letter."""
        if not self.words or "<" in text or not text.isascii() and _MARKS.search(text):
            return text
        return text.encode().lower().decode()

    def _make(self, pieces: list[str]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(pieces)
        rest = []
        if len(self.known) > self.memo.entries:
            self.known.clear()
        known, model = self.known, self.tok.model
        for i, s in enumerate(pieces):
            if self.words and _PLAIN.fullmatch(s) and "<" not in s:
                ids = []
                for w in _PLAIN_PARTS.findall(s):
                    have = known.get(w)
                    if have is None:
                        have = b"".join([t.id.to_bytes(4, "little") for t in model.tokenize(w)])
                        if len(w) <= 64:
                            known[w] = have
                    ids.append(have)
                out[i] = b"".join(ids)
            else:
                rest.append(i)
        for i, e in zip(rest, self.tok.encode_batch_fast([pieces[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = b"".join([x.to_bytes(4, "little") for x in e.ids])
        return out


_ENCODERS: dict[str, PackedEncoder] = {}


def packed_encoder(path: str) -> PackedEncoder:
    """One for each worker, so that its memo outlives a task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PackedEncoder(path)
    return _ENCODERS[path]
