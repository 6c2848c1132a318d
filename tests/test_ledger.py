"""Ledger expiry (Q12), insert-if-absent, and the replay fold against brute force."""

import datetime as dt
import random

from feedweave.operators import ledger

D0 = dt.date(2024, 1, 1)


def sight(spark, rows):
    return spark.createDataFrame(rows, "digest_type string, link string, run_date date")


def accepted(df):
    return sorted((r.digest_type, r.link, r.run_date) for r in df.collect())


def test_day_seven_suppressed_day_eight_accepted(spark):
    rows = [("org", "L", D0), ("org", "L", D0 + dt.timedelta(7)), ("org", "M", D0),
            ("org", "M", D0 + dt.timedelta(8))]
    got = accepted(ledger.replay(sight(spark, rows), 7))
    assert got == [("org", "L", D0), ("org", "M", D0), ("org", "M", D0 + dt.timedelta(8))]


def test_resighting_does_not_refresh(spark):
    rows = [("org", "L", D0 + dt.timedelta(d)) for d in (0, 5, 8, 9)]
    got = accepted(ledger.replay(sight(spark, rows), 7))
    assert [r[2] for r in got] == [D0, D0 + dt.timedelta(8)]


def brute_force(rows, dedup_days):
    book = {}
    out = []
    for d in sorted({r[2] for r in rows}):
        cutoff = d - dt.timedelta(dedup_days)
        book = {k: v for k, v in book.items() if not v < cutoff}   # prune
        for t, link, rd in sorted(r for r in rows if r[2] == d):
            if (t, link) not in book:
                out.append((t, link, d))
                book[(t, link)] = d
    return sorted(out)


def test_replay_equals_daily_loop(spark):
    rnd = random.Random(7)
    rows = sorted({(rnd.choice(["org", "press"]), f"L{rnd.randrange(12)}",
                    D0 + dt.timedelta(rnd.randrange(40))) for _ in range(300)})
    for days in (3, 7):
        assert accepted(ledger.replay(sight(spark, rows), days)) == brute_force(rows, days)


def test_new_rows_insert_if_absent(spark):
    book = spark.createDataFrame([("A", "org", D0), ("B", "org", D0 + dt.timedelta(6))],
                                 "link string, digest_type string, first_seen date")
    arts = spark.createDataFrame([("org", "A"), ("org", "B"), ("org", "C"), ("org", ""),
                                  ("org", "C")], "digest_type string, link string")
    as_of = D0 + dt.timedelta(9)
    got = sorted((r.link, r.first_seen) for r in ledger.new_rows(arts, book, as_of, 7).collect())
    # A expired (first_seen < as_of - 7), B live, C new, '' never recorded
    assert got == [("A", as_of), ("C", as_of)]


def test_append_and_compact(spark, scratch_dir):
    rows = spark.createDataFrame([("A", "org", D0), ("B", "org", D0 + dt.timedelta(9)),
                                  ("B", "org", D0 + dt.timedelta(10))],
                                 "link string, digest_type string, first_seen date")
    ledger.append(rows, f"{scratch_dir}/log")
    log = spark.read.parquet(f"{scratch_dir}/log")
    ledger.compact(log, D0 + dt.timedelta(10), 7, f"{scratch_dir}/snap")
    snap = spark.read.parquet(f"{scratch_dir}/snap")
    assert sorted((r.link, r.first_seen) for r in snap.collect()) == [("B", D0 + dt.timedelta(9))]


def test_bucketed_ledger_avoids_ledger_shuffle(spark):
    from feedweave.operators import ingest
    rows = spark.createDataFrame([(f"https://l/{i}", "org" if i % 2 else "press",
                                   D0 + dt.timedelta(i % 10)) for i in range(200)],
                                 "link string, digest_type string, first_seen date")
    ledger.save_bucketed(rows, "ledger_bucketed_t", 8, mode="overwrite")
    book = ledger.live(ledger.read_bucketed(spark, "ledger_bucketed_t"), D0 + dt.timedelta(9), 7)
    arts = spark.createDataFrame([("org", f"https://l/{i}") for i in range(0, 40)],
                                 "digest_type string, link string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = ingest.drop_seen(arts, book)
        plan = out._jdf.queryExecution().executedPlan().toString()
        got = sorted(r.link for r in out.collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    live = {f"https://l/{i}" for i in range(200) if i % 2 and (i % 10) >= 2}
    assert got == sorted(f"https://l/{i}" for i in range(40) if f"https://l/{i}" not in live)
    scan = [ln for ln in plan.split("\n") if "ledger_bucketed_t" in ln]
    assert scan and "Bucketed: true" in scan[0] and "PartitionFilters" in scan[0]
    assert plan.count("Exchange hashpartitioning") == 1   # only the articles move
