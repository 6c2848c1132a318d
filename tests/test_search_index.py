"""The trigram index gives what the scan gives, from fewer bodies."""

import datetime as dt
import random

import pytest

from feedweave.operators import history, search_index

TERMS = ["que", " que ", "q\\ue", "QUE", "the the", "ab", "", "  ", "%", "_", "a%b", "th_ alpha", "al%ga%", "100\\%", "x\\_y", "x_y", "2024-01-1", "-01-", "ß", "STRASSE", "straße",
         "İs", "ΑΣ", "日本語", "本語", "no such words", "alpha\\", "\\", "a\\\\b", "ét", "𝔘𝔫𝔦", "new\nline", "'quote'", "."]


@pytest.fixture(scope="module")
def runs(spark):
    rnd = random.Random(4)
    words = ["que", "alpha", "gamma", "the", "Straße", "İstanbul", "ΑΣ", "ΑΣΑ", "日本語", "100%", "x_y", "xzy", "a\\b", "état", "𝔘𝔫𝔦x", "new\nline", "'quote'"]
    rows = [(i, dt.date(2024, 1, 1) + dt.timedelta(i % 20), "press" if i % 2 else "org", i % 7, " ".join(rnd.choice(words) for _ in range(rnd.choice([0, 1, 2, 6])))) for i in range(120)]
    rows += [(500, dt.date(2024, 3, 1), "org", 1, None), (501, dt.date(2024, 3, 1), "org", 1, "long " * 4000 + "needle")]
    return spark.createDataFrame(rows, "id long, run_date date, digest_type string, item_count int, markdown string").repartition(3)


@pytest.fixture(scope="module")
def index(runs, tmp_path_factory):
    # in two parts, the second with runs of the first once more
    made = search_index.build(runs.filter("id < 80"), str(tmp_path_factory.mktemp("index") / "i"), slots=4)
    return search_index.add(made, runs.filter("id >= 60"))


def test_same_runs_as_the_scan(runs, index):
    for term in [*TERMS, "needle", "long long needle"]:
        got = sorted(r.id for r in search_index.search(runs, index, term).select("id").collect())
        want = sorted(r.id for r in history.search(runs, term).select("id").collect())
        assert got == want, term


def test_candidates_are_few(spark, index):
    assert [r.id for r in search_index.candidates(spark, index, "needle").collect()] == [501]
    assert search_index.candidates(spark, index, "no such words").count() == 0
    for term in ("ab", "%", "a%b", "_ab_", ""):
        assert search_index.candidates(spark, index, term) is None


def test_many_candidates_are_joined(runs, index, monkeypatch):
    monkeypatch.setattr(search_index, "FILTER_IDS", 2)
    got = sorted(r.id for r in search_index.search(runs, index, "alpha").collect())
    assert got == sorted(r.id for r in history.search(runs, "alpha").collect()) and len(got) > 2


def test_the_scan_reads_the_candidates_dates_and_ids(spark, runs, index, scratch_dir):
    runs.write.partitionBy("run_date").parquet(f"{scratch_dir}/runs")
    stored = spark.read.schema(runs.schema).parquet(f"{scratch_dir}/runs")
    plan = search_index.search(stored, index, "needle")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(run_date" in plan and "2024-03-01" in plan and "EqualTo(id,501)" in plan
    assert [r.id for r in search_index.search(stored, index, "needle").collect()] == [501]


def test_literal_parts():
    assert search_index.literal_parts("%a\\%b_cd%") == ["a%b", "cd"]
    assert search_index.literal_parts("%%") == []
    assert search_index.literal_parts("%a\\") == ["a\\"]
