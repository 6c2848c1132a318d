"""The pipeline's stages against brute force, each on its own input, and the registered queries."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from feedweave.llm import tokenizing  # noqa: E402
from feedweave.llm.queries import ORACLE, QUERIES  # noqa: E402

from . import samples  # noqa: E402
from .test_duplicates import SPACE, brute_components, brute_removal  # noqa: E402


@pytest.fixture(scope="module")
def stages(llm, tmp_path_factory):
    """Rows before and after each stage."""
    sf = str(tmp_path_factory.mktemp("sf"))
    rng = random.Random(11)
    rows = [(i, t) for i, t in samples.texts(4) if i is not None] + [(1000 + k, " ".join(samples.words(rng, rng.choice([20, 60, 120])))) for k in range(120)] + [(600 + k, "".join(f"{rng.choice('&*#$%')}" * 4 + "Q!! " for _ in range(80 + k))) for k in range(6)]
    samples.documents(llm, rows).selectExpr("doc_id", "text", "'en' AS lang", "source", "n_chars").repartition(4).write.parquet(f"{sf}/documents.parquet")
    llm.createDataFrame([(i, int(not 600 <= i < 610), 0) for i, _ in rows if i % 3], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    docs, seen = llm.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.written(stage(llm, docs, sf), name)
        if name != "pack":
            assert out.dtypes == docs.dtypes
        seen.append((docs.collect(), out.collect()))
        docs = out
    return sf, dict(zip([n for n, _ in corpus_pipeline.STAGES], seen, strict=True))


def test_quality_drops_junk_and_keeps_the_rest(stages):
    before, after = stages[1]["quality"]
    left = {r["doc_id"] for r in after}
    assert not any(600 <= i < 610 for i in left)
    assert sum(r["doc_id"] in left for r in before) >= 0.97 * (len(before) - 6)


def test_exact_and_near_keep_one_of_each_group(stages):
    before, after = stages[1]["exact"]
    groups = {}
    for r in before:
        groups.setdefault(SPACE.sub(" ", r["text"] or ""), []).append(r["doc_id"])
    assert sorted(r["doc_id"] for r in after) == sorted(min(g) for g in groups.values())
    before, after = stages[1]["near"]
    found = brute_components([(r["doc_id"], r["text"]) for r in before], 5, 80)
    assert sorted(r["doc_id"] for r in after) == sorted({c for _, _, c in found})


def test_passages_are_removed(stages):
    before, after = stages[1]["passages"]
    want = {i: (n, gone, text) for i, n, gone, text in brute_removal([(r["doc_id"], r["text"]) for r in before], corpus_pipeline.PASSAGE_WORDS)}
    whole = {r["doc_id"]: r["text"] for r in before}
    assert {r["doc_id"]: r["text"] for r in after} == {i: (text if gone else whole[i] or "") for i, (n, gone, text) in want.items() if not n or gone < n}
    assert all(r["n_chars"] == len(r["text"]) for r in after)


def test_packing_holds_every_token(stages, llm):
    before, after = stages[1]["pack"]
    tok = tokenizing.tokenizer(tokenizing.vocabulary_path("word_bpe_49k.json"))
    whole = {}
    for r in sorted(after, key=lambda r: r["start"]):
        assert r["start"] == len(whole.setdefault(r["doc_id"], []))
        whole[r["doc_id"]] += np.frombuffer(r["ids"], "<u4").tolist()
    assert whole == {r["doc_id"]: [*tok.encode(r["text"] or "", add_special_tokens=False).ids, 2] for r in before}
    assert len(corpus_pipeline.run(llm, stages[0]).select("doc_id").distinct().collect()) == len(before)


def test_stages_drop_rows_by_id_and_text(llm, tmp_path):
    rng = random.Random(12)
    text = lambda n: " ".join(samples.words(rng, n))
    rows = [(i, text(60)) for i in range(150)]
    junk = "&&&&Q!! ****Q!! " * 100
    rows += [(None, junk), (None, text(60)), (500, junk), (500, text(60))]
    docs = samples.documents(llm, rows).selectExpr("doc_id", "text", "'en' AS lang", "source", "n_chars")
    llm.createDataFrame([(i, 1) for i in range(150)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = {(r["doc_id"], r["text"]) for r in corpus_pipeline.quality(llm, docs, str(tmp_path)).collect()}
    assert rows[-3] in kept and rows[-1] in kept and rows[-4] not in kept and rows[-2] not in kept

    rows += [(None, rows[7][1] + " more"), (600, rows[8][1] + " more"), (600, text(60))]
    docs = samples.documents(llm, rows).selectExpr("doc_id", "text", "'en' AS lang", "source", "n_chars")
    left = corpus_pipeline.near(llm, docs, str(tmp_path)).collect()
    kept = {(r["doc_id"], r["text"]) for r in left}
    assert set(rows) - kept == {(None, rows[7][1] + " more"), (600, rows[8][1] + " more"), (500, junk), (None, junk)} - kept
    assert {(None, rows[7][1] + " more"), (600, rows[8][1] + " more")}.isdisjoint(kept) and rows[-1] in kept and rows[-6] in kept


def test_registry():
    import __spark_entry__ as entry

    names = [k for k in entry.queries() if re.match(r"op\d+_", k)]
    assert sorted(int(re.match(r"op(\d+)", k)[1]) for k in names) == list(range(1, 14))
    assert "pipeline" in entry.queries() and set(ORACLE) <= set(QUERIES) <= set(entry.queries())


def test_stages_keep_columns_named_like_their_own(llm, tmp_path):
    names = ("__row", "__rejected", "__id", "__text_hash", "__goes", "__text_sha", "__sha")
    rows = [(i, f"some words of text number {i} and a few more", "en") for i in range(40)] + [(50, "some words of text number 3 and a few more", "en"), (51, None, None)]
    docs = llm.createDataFrame([(*r, *names) for r in rows], "doc_id long, text string, lang string, " + ", ".join(f"`{c}` string" for c in names))
    llm.createDataFrame([(i, 1) for i in range(40)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    for stage, most in ((corpus_pipeline.quality, 42), (corpus_pipeline.exact, 41), (corpus_pipeline.near, 41)):
        left = stage(llm, docs, str(tmp_path)).collect()
        assert 0 < len(left) <= most and all(tuple(r)[3:] == names for r in left)
