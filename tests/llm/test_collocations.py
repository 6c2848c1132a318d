"""Phrase collocations against a plain count."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from feedweave.llm import collocations

from . import samples

NAMES = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def plain(rows, top, longest, least, percent):
    totals, counts = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = tuple(re.findall(r"[^\x20\x09]+", piece))
            totals[lang] += len(words)
            for m in range(1, longest + 1):
                for i in range(len(words) - m + 1):
                    counts[lang, words[i:i + m]] += 1
    found = {}
    for (lang, words), a in counts.items():
        if a < least or len(words) < 2:
            continue
        cuts = []
        for k in range(1, len(words)):
            left, right = counts[lang, words[:k]], counts[lang, words[k:]]
            cuts.append((1000 * a * totals[lang] // (left * right), k, left, right))
        found[lang, words] = (a, *min(cuts))
    gone = set()
    for (lang, words), (a, *_) in found.items():
        for m in range(2, len(words)):
            for i in range(len(words) - m + 1):
                part = words[i:i + m]
                if 100 * a >= percent * found[lang, part][0]:
                    gone.add((lang, part))
    out = []
    for lang in totals:
        own = sorted((-score, -a, " ".join(words).encode(), left, right) for (g, words), (a, score, _, left, right) in found.items() if g == lang and (g, words) not in gone)
        out += [(lang, i + 1, p.decode(), -a, left, right, totals[lang], -score) for i, (score, a, p, left, right) in enumerate(own[:top])]
    return sorted(out)


def texts():
    rng = random.Random(5)
    common = "the of and a to in is was ÀB über ñandú \x01\x02 x\x0etab".split(" ")
    rows = []
    for i in range(150):
        words = [rng.choice(common) if rng.random() < 0.8 else f"W{rng.randrange(40)}" for _ in range(rng.choice([0, 1, 2, 5, 30, 200]))]
        text = "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", " ; "]) for w in words)
        rows.append((text, rng.choice(["en", "en", "en", "de", None, "und", "e"])))
    rows += [("one fixed phrase here", "en")] * 30 + [("fixed phrase", "en")] * 3 + [("z " * 3000, "fr"), (None, "en"), ("", None), ("...", "en"), ("é" * 9000, "en")]
    return rows


@pytest.mark.parametrize("top, longest, least, percent, bits", [(2000, 5, 4, 100, 1 << 29), (7, 5, 3, 80, 1 << 29), (50, 3, 2, 100, 1 << 13), (50, 2, 10, 100, 1 << 29)])
def test_against_a_plain_count(llm, top, longest, least, percent, bits):
    rows = texts()
    clash = [c for c in samples.CLASHING if c != "class"] + ["phrase", "words", "a_", "longer", "parts", "rank"]
    docs = llm.createDataFrame([(*r, *["?"] * len(clash)) for r in rows], "text string, lang string, " + ", ".join(f"`{c}` string" for c in clash)).repartition(5)
    got = collocations.mine(docs, top, longest, least, percent, most_bits=bits)
    assert got.columns == list(NAMES)
    want = plain(rows, top, longest, least, percent)
    assert len(want) > 5
    assert sorted(tuple(r) for r in got.collect()) == want


def test_phrases_open_across_partitions(llm):
    """Every phrase in a partition of its own: what is open comes from earlier ones, and extensions reach back."""
    counts = [("en", "a", 9), ("en", "a b", 8), ("en", "a b c", 8), ("en", "b", 9), ("en", "b c", 9), ("en", "c", 10), ("fr", "a", 4), ("fr", "a a", 3)]
    phrases = llm.createDataFrame(counts, "lang string, phrase string, a long")
    llm.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        prefix = collocations._stream(phrases, False, "prefix").groupBy("lang", "phrase").agg({"a": "max", "longer": "max"}).collect()
        suffix = collocations._stream(phrases, True, "suffix").where("a IS NOT NULL").collect()
    finally:
        llm.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    longer = {(r["lang"], r["phrase"]): r["max(longer)"] for r in prefix}
    assert longer == {("en", "a"): 8, ("en", "a b"): 8, ("en", "a b c"): 0, ("en", "b"): 9, ("en", "b c"): 0, ("en", "c"): 0, ("fr", "a"): 3, ("fr", "a a"): 0}
    assert {(r["lang"], r["phrase"]): r["parts"] for r in suffix}["en", "a b c"] == [10, 9]


def test_of_nothing(llm):
    empty = llm.createDataFrame([], "text string, lang string")
    assert collocations.mine(empty).columns == list(NAMES)
    assert collocations.mine(empty).count() == 0
    assert collocations.mine(llm.createDataFrame([(None, None), ("", "en"), ("one", "en")], "text string, lang string"), least=2).count() == 0


def test_products_beyond_64_bits(llm):
    big = 3_000_000_000_000
    phrases = llm.createDataFrame([("en", "a", big), ("en", "b", big - 1), ("en", "a b", big - 2)], "lang string, phrase string, a long")
    totals = llm.createDataFrame([("en", 4 * big)], "lang string, n long")
    row = collocations.score_phrases(phrases, totals).first()
    assert row["score"] == 1000 * (big - 2) * 4 * big // (big * (big - 1))
