"""Language ID: the kernel against sets, the whole fit against a plain one, held-out accuracy, awkward texts."""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pytest
import regex

from feedweave.llm import string_kernel

from . import samples

SF001 = "/root/testdata/sf0.001"


def grams(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    raw = b" " + re.sub(rb"[^a-z\x80-\xff]+", b" ", low.encode()) + b" "
    raw = re.sub(rb" +", b" ", raw)
    return {raw[i:i + n] for n in (2, 3, 4) for i in range(len(raw) - n + 1)}


def kernel(a, b):
    return len(a & b) / math.sqrt(max(1, len(a)) * len(b))


TEXTS = ["", "a", "A", "Hello, World 42!", "éÀ ß", "日本語 text", "x" * 3000, "a\x00b", "  ", "...", "tab\tand\nline"]


def test_ngram_sets():
    for text in TEXTS:
        want = sorted(int.from_bytes(g, "big") for g in grams(text))
        assert string_kernel.ngrams(text.encode()).tolist() == want


def test_kernel_rows():
    marks = [string_kernel.ngrams(t.encode()) for t in TEXTS[1:6]]
    model = string_kernel.Model([], *string_kernel._landmarks(marks), np.zeros((5, 0)))
    many = TEXTS * 20
    got = model.kernel([string_kernel.ngrams(t.encode()) for t in many])
    want = [[kernel(grams(a), grams(b)) for b in TEXTS[1:6]] for a in many]
    assert np.allclose(got, want, rtol=0, atol=1e-12)


def test_the_whole_model_against_a_plain_one(llm):
    rows = [(r["text"], r["lang"]) for r in llm.read.parquet(f"{SF001}/documents.parquet").select("text", "lang").limit(60).collect()]
    labelled = llm.createDataFrame(rows, "text string, lang string").repartition(3)
    texts, landmarks = 6, 3
    model = string_kernel.fit(labelled, texts=texts, landmarks=landmarks)

    hashed = {(r["lang"], r["h"], r["text"]) for r in labelled.selectExpr("lang", "xxhash64(text) AS h", "text").collect()}
    langs = sorted({x[0] for x in hashed})
    chosen = [x for g in langs for x in sorted(y for y in hashed if y[0] == g)[:texts]]
    marks = [grams(string_kernel.passage(t.encode(), 400).decode()) for g in langs for _, _, t in [x for x in chosen if x[0] == g][:landmarks]]
    examples = [(g, grams(p.decode())) for g, _, t in chosen for p in (t.encode(), *(string_kernel.passage(t.encode(), n) for n in string_kernel.PASSAGES))]
    assert model.languages == langs
    k_mm = np.array([[kernel(a, b) for b in marks] for a in marks])
    k = np.array([[kernel(e, b) for b in marks] for _, e in examples])
    # the primal problem of the same features, by least squares on stacked rows
    values, vectors = np.linalg.eigh(k_mm)
    phi = k @ vectors / np.sqrt(values)
    per = np.array([sum(g == h for h, _ in examples) for g, _ in examples])
    rows_of = np.concatenate([phi / np.sqrt(per)[:, None], math.sqrt(string_kernel.RIDGE * len(langs)) * np.eye(len(marks))])
    for j, g in enumerate(langs):
        target = np.concatenate([np.where([h == g for h, _ in examples], 1.0, -1.0) / np.sqrt(per), np.zeros(len(marks))])
        w = np.linalg.lstsq(rows_of, target, rcond=None)[0]
        assert np.allclose(k @ model.weights[:, j], phi @ w, atol=1e-6)

    asked = llm.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in string_kernel.predict(asked, model).collect()}
    for i, (t, _) in enumerate(rows):
        out = np.array([kernel(grams(t), b) for b in marks]) @ model.weights
        assert got[i]["lang_pred"] == langs[int(np.argmax(out))]
        assert got[i]["score"] == pytest.approx(min(1, max(0, (out.max() + 1) / 2)), abs=1e-8)


def test_held_out_accuracy(llm):
    docs = llm.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = string_kernel.predict_documents(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(found) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in found)
    held = [r for r in found if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.98 * len(held)


def test_short_passages_of_held_out_texts(llm):
    docs = llm.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("held_out", string_kernel.held_out(string_kernel.F.col("doc_id")))
    model = string_kernel.fit(docs.where("NOT held_out"))
    short = docs.where("held_out AND size(split(text, ' ')) > 12").selectExpr("doc_id", "lang", "array_join(slice(split(text, ' '), 3, 8), ' ') AS text")
    found = string_kernel.predict(short, model, carry=("doc_id", "lang")).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in found) >= 0.9 * len(found)


def test_learns_from_text_and_lang_alone(llm):
    docs = llm.read.parquet(f"{SF001}/documents.parquet")
    base = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in string_kernel.predict_documents(docs).collect()}
    held = string_kernel.held_out(string_kernel.F.col("doc_id"))
    other = docs.withColumn("source", string_kernel.F.lit("x")).withColumn("lang", string_kernel.F.when(held, string_kernel.F.lit("xx")).otherwise(string_kernel.F.col("lang")))
    assert base == {r["doc_id"]: (r["lang_pred"], r["score"]) for r in string_kernel.predict_documents(other.repartition(5)).collect()}


def test_awkward_texts(llm):
    rows = samples.texts()
    got = string_kernel.predict_documents(samples.documents(llm, rows).repartition(3))
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    found = samples.rows_of(got, "doc_id")
    assert found == sorted(((i,) for i, _ in rows), key=repr)
    by = {r["doc_id"]: r for r in got.collect() if r["doc_id"] is not None}
    for i, t in rows:
        if i is not None:
            assert (by[i]["lang_pred"] == "und") == (not regex.search(r"\p{L}", t or ""))
            assert 0 <= by[i]["score"] <= 1


def test_without_labels_or_rows(llm):
    schema = "doc_id long, text string, lang string"
    got = string_kernel.predict_documents(llm.createDataFrame([(1, "words", None), (2, None, None)], schema)).collect()
    assert [(r["lang_pred"], r["score"]) for r in got] == [("und", 0.0)] * 2
    assert string_kernel.predict_documents(llm.createDataFrame([], schema)).count() == 0
    one = string_kernel.predict_documents(llm.createDataFrame([(i, f"Same words {i}", "en") for i in range(9)], schema)).collect()
    assert {r["lang_pred"] for r in one} == {"en"}
