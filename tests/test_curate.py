"""Curation rules (K1-K7, K10) on hand-written rows."""

import datetime as dt

from pyspark.sql import functions as F

from feedweave.operators import curate

RULES = [
    {"kind": "prefer", "term": "Cancer", "weight": 2},
    {"kind": "seek", "term": "trial", "weight": 1},
    {"kind": "less", "term": "beauty", "weight": -1},
    {"kind": "skip", "term": "dividend"},
    {"kind": "category", "term": "trial", "label": "Clinical Trials", "priority": 2},
    {"kind": "category", "term": "fda", "label": "FDA & Regulatory", "priority": 1},
]


def items(spark, rows):
    return spark.createDataFrame(rows, "digest_type string, item_no long, org string, title string, summary string")


def test_scores_and_skip(spark):
    df = items(spark, [("press", 1, "a", "Cancer trial results", ""),
                       ("press", 2, "b", "Beauty line", "new trial"),
                       ("press", 3, "c", "Dividend declared", ""),
                       ("press", 4, "d", "Dividend for cancer fund", ""),
                       ("press", 5, "e", "Nothing", "")])
    got = {r.item_no: (r.score, r.dropped) for r in curate.score_items(df, RULES).collect()}
    assert got == {1: (3, False), 2: (0, False), 3: (0, True), 4: (2, False), 5: (0, False)}


def test_floor_and_cap(spark):
    def picks(n_items, n_positive):
        rows = [("press", i, f"o{i % 3}", "trial" if i <= n_positive else "plain", "")
                for i in range(1, n_items + 1)]
        scored = curate.score_items(items(spark, rows), RULES)
        return [r.item_no for r in curate.top_with_floor(scored).orderBy("pick_rank").collect()]
    assert len(picks(40, 5)) == 15                   # aim for 15 even with few positives
    assert len(picks(40, 30)) == 20                  # never more than 20
    assert len(picks(40, 17)) == 17
    assert picks(8, 2) == [1, 2, 3, 4, 5, 6, 7, 8]   # fewer items than the floor: all of them
    assert picks(40, 5)[:5] == [1, 2, 3, 4, 5]       # positives first, then pass order


def test_category_priority_and_org_groups(spark):
    df = items(spark, [("press", 1, "a", "FDA clears trial drug", ""),
                       ("press", 2, "a", "trial update", ""),
                       ("press", 3, "b", "misc", "")])
    picks = curate.top_with_floor(curate.score_items(df, RULES))
    cats = {r.item_no: r.category for r in curate.categorise(picks, RULES).collect()}
    assert cats == {1: "FDA & Regulatory", 2: "Clinical Trials", 3: "General"}
    groups = {r.org: (r.n_picks, r.best_rank) for r in curate.org_groups(picks).collect()}
    assert groups == {"a": (2, 1), "b": (1, 3)}


def test_themes_need_two_items_and_two_orgs(spark):
    df = items(spark, [("org", 1, "a", "Medicare costs rise", ""),
                       ("org", 2, "b", "Medicare enrollment", ""),
                       ("org", 3, "a", "Hospice costs", ""),
                       ("org", 4, "a", "Hospice staffing", "")])
    got = {r.term: (r.n_items, r.n_orgs) for r in curate.cross_item_themes(df).collect()}
    assert got == {"medicare": (2, 2)}              # hospice: two items but one org


def test_continuity_and_unpitched(spark):
    runs = spark.createDataFrame(
        [(1, "org", dt.date(2024, 1, 1), dt.datetime(2024, 1, 1, 13), "alpha beta"),
         (2, "org", dt.date(2024, 1, 2), dt.datetime(2024, 1, 2, 13), "beta gamma"),
         (3, "press", dt.date(2024, 1, 2), dt.datetime(2024, 1, 2, 13), "alpha")],
        "id long, digest_type string, run_date date, created_at timestamp, markdown string")
    got = sorted((r.digest_type, r.seq, r.term, r.status)
                 for r in curate.run_continuity(runs, min_len=4).collect())
    assert got == [("org", 2, "alpha", "dropped"), ("org", 2, "beta", "continuing"),
                   ("org", 2, "gamma", "new")]
    mem = {r.term: r.status for r in curate.thread_memory(runs, "2024-01-03", min_len=4)
           .filter(F.col("digest_type") == "org").collect()}
    assert mem == {"beta": "established", "alpha": "emerging", "gamma": "emerging"}
    cand = spark.createDataFrame([("org", "beta", 2, 2), ("org", "delta", 2, 2)],
                                 "digest_type string, term string, n_items long, n_orgs long")
    pitched = spark.createDataFrame([("org", "beta")], "digest_type string, term string")
    assert [r.term for r in curate.unpitched(cand, pitched).collect()] == ["delta"]
