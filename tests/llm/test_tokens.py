"""Token counts, byte-level BPE and packing against the tokenizers' own libraries."""

from __future__ import annotations

import base64
import hashlib
import random

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")

from feedweave.llm import byte_bpe, packing, token_counts, tokenizing  # noqa: E402

from . import samples  # noqa: E402

BYTE, WORD, RANKS = "byte_bpe_50k.json", "word_bpe_49k.json", "byte_bpe_50k.tiktoken"


@pytest.mark.parametrize("chunk, overlap", [(32_768, 1_024), (300, 40), (64, 8), (50, 50)])
def test_chunked_counts_equal_the_library(chunk, overlap):
    texts = [t or "" for _, t in samples.texts()]
    rng = random.Random(3)
    texts += ["".join(rng.choice("ab' \n1é!") for _ in range(1500)), " " * 900 + "q", "<|endoftext|>" * 60, "it's they're " * 100]
    tok = tokenizing.tokenizer(P.path(BYTE))
    assert token_counts.ChunkedCounter(P.path(BYTE), chunk, overlap).count(texts) == [len(tok.encode(t, add_special_tokens=False)) for t in texts]


def test_count_tokens(llm):
    rows = samples.texts()
    tok = tokenizing.tokenizer(P.path(BYTE))
    want = [(i, len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False)), len(tok.encode(t or "", add_special_tokens=False)) > 100) for i, t in rows]
    got = token_counts.count_tokens(samples.documents(llm, rows), P.path(BYTE), limit=100)
    assert samples.rows_of(got, "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(want, key=repr)
    assert token_counts.count_tokens(samples.documents(llm, []), P.path(BYTE)).count() == 0


def reference_bpe():
    import tiktoken

    with open(P.path(RANKS), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_rank_queue_is_a_priority_queue():
    rng = random.Random(2)
    for _ in range(50):
        queue, held = byte_bpe.RankQueue(), []
        for _ in range(300):
            if held and rng.random() < 0.45:
                held.sort()
                assert queue.pop() == held.pop(0)
            else:
                item = (rng.choice([3, 64, 4095, 4096, 50_000, rng.randrange(1 << 18)]), rng.randrange(1000))
                if item not in held:
                    held.append(item)
                    queue.push(*item)
        for item in sorted(held):
            assert queue.pop() == item
        assert queue.pop() is None


@pytest.mark.parametrize("size", [1, 40, 1 << 18])
def test_words_merged_together_equal_the_library(monkeypatch, size):
    monkeypatch.setattr(byte_bpe, "MERGED_BYTES", size)
    rng = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyz \n\u00e9\u4e2d\U0001f600'0"
    words = ["".join(rng.choices(letters, k=rng.choice([1, 2, 3, 8, 30]))) for _ in range(400)] + ["a" * 3000, "ab" * 2000, "aab" * 700, "\n" * 500, "", "x"]
    bpe, library = byte_bpe.BytePairEncoder(P.path(RANKS), P.PATTERN), reference_bpe()
    got = [list(memoryview(x).cast("I")) for x in bpe.merge([w.encode() for w in words])]
    assert got == [library._encode_single_piece(w.encode()) if w else [] for w in words]
    assert bpe.queue.take() is None and not any(bpe.queue.low)


def test_ranks_that_put_a_later_merge_first(tmp_path):
    """A pair made by a merge may have a lower rank than that merge: it comes before the rest of its bucket."""
    tokens = [bytes([x]) for x in range(256)] + [b"aba", b"abab", b"ab", b"ba", b"bab", b"aa", b"baa"]
    path = tmp_path / "ranks.tiktoken"
    path.write_bytes(b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in enumerate(tokens)))
    bpe, ranks = byte_bpe.BytePairEncoder(str(path), P.PATTERN), {t: i for i, t in enumerate(tokens)}

    def plain(word: bytes) -> list[int]:
        parts = [word[i:i + 1] for i in range(len(word))]
        while (best := min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks), default=None)) is not None:
            parts[best[1]:best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return [ranks[x] for x in parts]

    rng = random.Random(5)
    words = [bytes(rng.choices(b"ab", k=rng.randrange(1, 25))) for _ in range(500)]
    assert [list(memoryview(x).cast("I")) for x in bpe.merge(words)] == [[ranks[w]] if w in ranks else plain(w) for w in words]


def test_bpe_equals_the_library_and_goes_back(llm):
    rows = samples.texts()
    library = reference_bpe()
    docs = samples.documents(llm, rows)
    encoded = byte_bpe.encode_texts(docs, P.path(RANKS), P.PATTERN)
    want = []
    for i, t in rows:
        ids = np.array(library.encode_ordinary(t or ""), dtype="<u4").tobytes()
        want.append((i, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert samples.rows_of(encoded, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)
    back = byte_bpe.decode_ids(encoded, P.path(RANKS), P.PATTERN)
    assert sorted((r["doc_id"], bytes(r["bytes"])) for r in back.collect() if r["doc_id"] is not None) == sorted((i, (t or "").encode()) for i, t in rows if i is not None)
    assert byte_bpe.encode_texts(samples.documents(llm, []), P.path(RANKS), P.PATTERN).count() == 0


def test_word_vocabulary_folding_equals_the_library():
    rng = random.Random(5)
    texts = [t or "" for _, t in samples.texts()] + ["J̌A İ ΣΑΣ T̈", "x\x1cY\x00", "they'LL 'S don't", "½ ² 12a3B4", "A<|ENDOFTEXT|>b"]
    texts += ["".join(rng.choice("abC' \n1é!.,<|>ÉÑß") for _ in range(60)) for _ in range(200)]
    encoder = tokenizing.PackedEncoder(P.path(WORD))
    assert encoder.words
    for text, packed in zip(texts, encoder.encode(texts), strict=True):
        assert np.frombuffer(packed, "<u4").tolist() == encoder.tok.encode(text, add_special_tokens=False).ids, text


def test_packed_documents(llm):
    rows = samples.texts()
    tok = tokenizing.tokenizer(P.path(WORD))
    got = packing.pack_documents(samples.documents(llm, rows).coalesce(2), P.path(WORD), max_tokens=128, max_segments=20, max_loss=128).collect()
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append(r)
        assert r["length"] == len(r["ids"]) // 4 > 0
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 128 and len(pieces) <= 20 and (at == 128 or at & at - 1 == 0)
    want = sorted((i if i is not None else -1, [*tok.encode(t or "", add_special_tokens=False).ids, 2]) for i, t in rows if t != rows[7][1])
    whole = {}
    for r in sorted((r for r in got if r["doc_id"] is not None and r["doc_id"] != rows[7][0]), key=lambda r: r["start"]):
        whole.setdefault(r["doc_id"], []).extend(np.frombuffer(r["ids"], "<u4").tolist())
    assert sorted(whole.items()) == [x for x in want if x[0] >= 0]
    assert packing.pack_documents(samples.documents(llm, []), P.path(WORD)).count() == 0


def test_packed_examples_obey_all_limits(llm):
    rng = random.Random(4)
    rows = [(i, rng.randrange(1, 60), None if i % 7 == 0 else rng.randrange(0, 20)) for i in range(400)] + [(900, 500, 1), (901, None, None), (None, 5, 5), (5, 10, 3)]
    got = packing.pack_examples(llm.createDataFrame(rows, "id long, n_tokens long, n_loss long").coalesce(1), 100, 6, 40, buffer=50).collect()
    assert sorted((r["id"] is None, r["id"] or 0) for r in got) == sorted((i is None, i or 0) for i, _, _ in rows)
    held = {}
    for r in got:
        if r["sequence_id"] is None:
            assert r["n_tokens"] > 100 or r["n_loss"] > 40
        else:
            held.setdefault(r["sequence_id"], []).append(r)
    for pieces in held.values():
        assert sum(r["n_tokens"] for r in pieces) <= 100 and len(pieces) <= 6 and sum(r["n_loss"] for r in pieces) <= 40
        ordered = sorted(pieces, key=lambda r: (r["offset"], r["n_tokens"]))
        assert [r["offset"] for r in ordered] == [sum(x["n_tokens"] for x in ordered[:k]) for k in range(len(ordered))]
    placed = [r for r in got if r["sequence_id"] is not None]
    least = max(sum(r["n_tokens"] for r in placed) / 100, len(placed) / 6, sum(r["n_loss"] for r in placed) / 40)
    assert len(held) <= 1.25 * least + 1
