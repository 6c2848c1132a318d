"""Merkle manifest against a plain tree, and against tampering."""

from __future__ import annotations

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from feedweave.llm import merkle_manifest

NAMES = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tag string, idx string, hash string, kids string, n string, root string, place string"


def digest(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return digest("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row)


def levels(nodes, fan):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest(out[-1][i:i + fan]) for i in range(0, len(out[-1]), fan)])
    return out


def siblings(tree, i, fan):
    for level in tree[:-1]:
        a = i // fan * fan
        yield level[a:i], level[i + 1:a + fan]
        i //= fan


def lowered(text):
    return None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def plain(rows, fan=16):
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = levels([leaf(r) for r in by[s]], fan)
    top = levels([trees[s][-1][0] for s in order], fan)
    out = []
    for p, s in enumerate(order):
        for i, r in enumerate(by[s]):
            around = [*siblings(trees[s], i, fan), *siblings(top, p, fan)]
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            fold = leaf((*r[:4], lowered(r[4]))) if tampered else leaf(r)
            for a, b in around:
                fold = digest([*a, fold, *b])
            root = top[-1][0]
            out.append((r[0], trees[s][0][i], trees[s][-1][0], root, digest(x for a, b in around for x in (*a, *b)), fold, fold == root))
    return sorted(out, key=repr)


def rows(n, sources):
    out = [(i, sources[i * i % len(sources)], [None, "en"][i % 2], [None, i][i % 3 > 0], ["Text Ä %d" % i, None, "", "x" * 5000, "lower"][i % 5]) for i in range(n)]
    return out


CASES = {
    "one row": ([(7, "s", "en", 1, "A")], 16),
    "one source": (rows(40, ["a"]), 16),
    "a source each": ([(i, f"s{i:03}", None, i, "T") for i in range(40)], 16),
    "lone leaves beside a deep source": (rows(300, ["big"] * 9 + ["Z", "é"]) + [(1000, None, "en", 1, "B"), (1001, "", "en", 1, "C")], 16),
    "ties, repeats and null ids": ([(5, "s", None, None, "Q")] * 4 + [(None, "s", None, None, t) for t in ("a", "B", None)] + [(5, "t", None, None, "R"), (5, "s", None, None, "r")], 2),
    "narrow runs": (rows(70, ["a", "b", None]), 3),
}


@pytest.mark.parametrize("name", CASES)
def test_against_a_plain_tree(llm, name, monkeypatch):
    given, fan = CASES[name]
    monkeypatch.setattr(merkle_manifest, "RUNS_PER_COPY", 3)  # so that upper runs are copied
    docs = llm.createDataFrame([(*r, *["?"] * 7) for r in given], SCHEMA).repartition(3)
    got = merkle_manifest.verify_documents(docs, fan=fan)
    assert got.columns == list(NAMES)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain(given, fan)


def test_only_the_tampered_row_fails(llm):
    docs = llm.createDataFrame([(i, f"s{i % 3}", f"text {i}") for i in range(100)], "doc_id long, source string, text string")
    recorded = merkle_manifest.digest(F.col("doc_id"), F.col("text"))
    held = F.when(F.col("doc_id") == 41, merkle_manifest.digest(F.col("doc_id"), F.lit("other"))).otherwise(recorded)
    found = merkle_manifest.climb(merkle_manifest.build(docs, recorded, held))
    assert [r["id"] for r in found.where("NOT verified").collect()] == [41]
    assert found.select("root").distinct().count() == 1


def test_of_nothing(llm):
    got = merkle_manifest.verify_documents(llm.createDataFrame([], SCHEMA))
    assert got.columns == list(NAMES) and got.count() == 0


def test_digests_move_as_bytes_and_once(llm):
    docs = llm.createDataFrame([(i, "s", f"text {i}") for i in range(40)], "doc_id long, source string, text string")
    recorded = merkle_manifest.digest(F.col("doc_id"), F.col("text"))
    held = F.when(F.col("doc_id") == 17, merkle_manifest.digest(F.lit("other"))).otherwise(recorded)
    kids = [k for r in merkle_manifest.build(docs, recorded, held).runs.collect() for k in r["kids"]]
    assert len(kids) == 40 and all(len(k["leaf"]) == 32 for k in kids)
    assert [(k["id"], len(k["held"])) for k in kids if k["held"] is not None] == [(17, 32)]
