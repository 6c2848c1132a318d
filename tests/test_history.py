"""Run-history queries: search wildcards (Q11), validation, ordering."""

import datetime as dt

from pyspark.sql import functions as F

from feedweave.operators import history


def runs(spark):
    rows = [(1, dt.date(2024, 1, 1), "press", 5, "alpha 50% off", dt.datetime(2024, 1, 1, 13, 0)),
            (2, dt.date(2024, 1, 1), "org", 7, "beta", dt.datetime(2024, 1, 1, 14, 0)),
            (3, dt.date(2024, 1, 2), "org", 3, "gamma_x", dt.datetime(2024, 1, 2, 13, 0)),
            (4, dt.date(2024, 1, 2), "org", 4, "delta", dt.datetime(2024, 1, 2, 18, 30))]
    return spark.createDataFrame(
        rows, "id long, run_date date, digest_type string, item_count int, markdown string, "
              "created_at timestamp").withColumn("source_count", F.lit(3)) \
        .withColumn("trends_raw", F.lit(None).cast("string")) \
        .withColumn("feature_pitch_raw", F.lit(None).cast("string"))


def test_search_counts_only_matching_runs(spark):
    idx = {r.run_date: r for r in history.date_index(runs(spark), "alpha").collect()}
    assert list(idx) == ["2024-01-01"]
    assert (idx["2024-01-01"].press_runs, idx["2024-01-01"].org_runs,
            idx["2024-01-01"].press_items) == (1, 0, 5)


def test_search_wildcards_are_live(spark):
    assert history.date_index(runs(spark), "%").count() == 2
    assert history.date_index(runs(spark), "a_x").count() == 1   # '_' matches any char
    assert history.date_index(runs(spark), " 2024-01-02 ").count() == 1


def test_runs_for_date_display(spark):
    out = history.runs_for_date(runs(spark), "2024-01-02").orderBy("display_rank").collect()
    assert [r.id for r in out] == [4, 3]
    assert all(r.show_time for r in out)
    assert out[0].run_time == "12:30 PM"   # 18:30 UTC in Chicago (CST)
    assert history.runs_for_date(runs(spark), "2024-02-30").count() == 0
    assert history.runs_for_date(runs(spark), "2024-1-2").count() == 0


def test_press_before_org(spark):
    out = history.runs_for_date(runs(spark), "2024-01-01").orderBy("display_rank").collect()
    assert [r.digest_type for r in out] == ["press", "org"]
    assert not any(r.show_time for r in out)


def test_run_id_validation(spark):
    raw = ["1", "01", "0", "-1", "1.0", " 1", "9007199254740991", "9007199254740992", "abc", ""]
    df = spark.createDataFrame([(x,) for x in raw], "raw_id string")
    got = [r.v for r in df.select(history.valid_run_id("raw_id").alias("v")).collect()]
    assert got == [True, True, False, False, False, False, True, False, False, False]


def test_active_date_falls_back_to_newest(spark):
    idx = history.date_index(runs(spark), "")
    req = spark.createDataFrame([("2024-01-01",), ("2023-05-05",)], "requested string")
    got = {r.requested: r.active_date for r in history.active_dates(req, idx).collect()}
    assert got == {"2024-01-01": "2024-01-01", "2023-05-05": "2024-01-02"}


def test_previous_run_per_type(spark):
    got = {r.id: r.prev_id for r in history.previous_run(runs(spark)).collect()}
    assert got == {1: None, 2: None, 3: 2, 4: 3}


def test_append_runs_ids_and_schema_evolution(spark, scratch_dir):
    path = f"{scratch_dir}/runs"
    old = spark.createDataFrame([(dt.date(2024, 1, 1), "org", 3, 2, "old md")],
                                "run_date date, digest_type string, source_count int, "
                                "item_count int, markdown string")
    history.append_runs(history.with_run_ids(old, 0, "2024-01-01 13:00:00"), path)
    new = runs(spark).filter("id = 4").drop("id", "created_at")
    a = history.with_run_ids(new, 1, "2024-01-02 13:00:00")
    b = history.with_run_ids(new, 1, "2024-01-02 13:00:00")
    assert a.first().id == b.first().id and 1 <= a.first().id <= history.MAX_SAFE_INTEGER
    history.append_runs(a, path)
    got = history.read_runs(spark, path)
    rows = {r.markdown: r for r in got.collect()}
    assert rows["old md"].trends_raw is None and rows["delta"].item_count == 4
    assert got.filter("run_date = date'2024-01-02'").count() == 1


def test_memory_latest_wins(spark):
    log = spark.createDataFrame([("org", 1, "m1", dt.datetime(2024, 1, 1)),
                                 ("org", 2, "m2", dt.datetime(2024, 1, 2)),
                                 ("press", 3, "p1", dt.datetime(2024, 1, 1))],
                                "digest_type string, request_id long, memory string, updated_at timestamp")
    got = {r.digest_type: r.memory for r in history.memory_latest(log).collect()}
    assert got == {"org": "m2", "press": "p1"}


def test_append_runs_again_and_a_second_run_of_a_day(spark, scratch_dir):
    path = f"{scratch_dir}/runs"
    cols = "id long, run_date date, digest_type string, chunk_no int, n_chunks int, markdown string"
    row = lambda i, t, c, text: (i, dt.date(2024, 1, 1), t, c, 2, text)
    first = spark.createDataFrame([row(1, "org", 0, "a"), row(1, "org", 1, "b"), row(2, "press", 0, "p")], cols)
    second = spark.createDataFrame([row(3, "org", 0, "c"), row(3, "org", 1, "d")], cols)
    for batch in (first, second, first, second, second):
        history.append_runs(batch, path)
    got = sorted((r.id, r.chunk_no, r.markdown) for r in history.read_runs(spark, path).collect())
    assert got == [(1, 0, "a"), (1, 1, "b"), (2, 0, "p"), (3, 0, "c"), (3, 1, "d")]
    assert history.run_heads(history.read_runs(spark, path)).count() == 3
    history.append_runs(spark.createDataFrame([row(1, "org", 0, "x")], cols), path)  # run 1 anew, with one chunk
    assert sorted((r.id, r.markdown) for r in history.read_runs(spark, path).collect()) == [(1, "x"), (2, "p"), (3, "c"), (3, "d")]
