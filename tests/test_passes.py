"""Responses joined to requests in the stream: whole passes, both outputs together, repeats without effect."""

import datetime as dt
import os

import pytest

from feedweave.operators import history
from feedweave.streaming import passes

T0 = dt.datetime(2024, 1, 1, 6)
ANSWER = "request_id string, blocks array<struct<type:string,text:string>>, stop_reason string, status_code int, connection_error boolean, received_at timestamp"


def request(pass_no, chunk, n):
    t, d = ("org", "press")[pass_no % 2], dt.date(2024, 1, 1) + dt.timedelta(pass_no // 2)
    return (f"r{pass_no}-{chunk}", t, d, chunk, n, T0 + dt.timedelta(pass_no // 2))


def answer(r, text, hours=1, stop="end_turn", status=200):
    return (r[0], [("text", text)], stop, status, False, r[5] + dt.timedelta(hours=hours))


def snapshot(path):
    return sorted(os.path.join(d, f) for d, _, names in os.walk(path) for f in names)


@pytest.fixture()
def world(spark, scratch_dir):
    asked = [request(p, c, 2) for p in range(8) for c in range(2)]
    by = {r[0]: r for r in asked}
    told = {p: [answer(by[f"r{p}-{c}"], f" body {p} {c} ") for c in range(2)] for p in range(8)}
    told[2][1] = answer(by["r2-1"], "x", stop="refusal")
    told[3].pop(0)                                            # never answered
    told[4][0] = answer(by["r4-0"], "x", hours=7)             # after the time allowed
    told[5].append(answer(by["r5-1"], "again", hours=2))      # answered again: the first counts
    told[6][0] = answer(by["r6-0"], "half", stop="max_tokens")  # kept although cut off
    told[7].append(("r-unknown", [("text", "?")], "end_turn", 200, False, T0))
    passes_of = sorted({(r[1], r[2]) for r in asked})
    totals = spark.createDataFrame([(t, d, 3, 4) for t, d in passes_of], "digest_type string, run_date date, source_count int, item_count int")
    items = spark.createDataFrame([(t, d, link) for t, d in passes_of for link in (f"https://{t}/{d}", "https://same", "https://same", "")],
                                  "digest_type string, run_date date, link string")
    return asked, told, totals, items


def land(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


@pytest.mark.parametrize("order, files", [("together", None), ("answers first", 1), ("day by day", 1)])
def test_passes_are_whole(spark, scratch_dir, world, order, files):
    asked, told, totals, items = world
    q, a, out, ck = (os.path.join(scratch_dir, x) for x in ("q", "a", "out", "ck"))

    def go():
        query = passes.start_passes(spark, q, a, totals, items, out, ck, max_files_per_trigger=files)
        query.awaitTermination(600)
        assert query.exception() is None

    answers = [r for p in told.values() for r in p]
    if order == "day by day":
        for d in range(4):
            land(spark, [r for r in asked if r[2].day == d + 1], passes.REQUEST_SCHEMA, q)
            land(spark, [r for p in (2 * d, 2 * d + 1) for r in told[p]], ANSWER, a)
            if d == 1:
                go()
                early = passes.commits(spark, out).collect()
                assert {(r.digest_type, r.run_date.day) for r in early if r.status == "done"} == {("org", 1), ("press", 1)}
    elif order == "answers first":
        for part in (answers[::2], answers[1::2]):
            land(spark, part, ANSWER, a)
        land(spark, asked, passes.REQUEST_SCHEMA, q)
    else:
        land(spark, asked, passes.REQUEST_SCHEMA, q)
        land(spark, answers, ANSWER, a)
    passes.heartbeat(spark, q, a, "2024-02-01 00:00:00")
    go()

    status = {(r.digest_type, r.run_date.day): (r.status, r.n_chunks, r.n_usable) for r in passes.commits(spark, out).collect()}
    assert status == {("org", 1): ("done", 2, 2), ("press", 1): ("done", 2, 2), ("org", 2): ("given_up", 2, 1), ("press", 2): ("given_up", 2, 1),
                      ("org", 3): ("given_up", 2, 1), ("press", 3): ("done", 2, 2), ("org", 4): ("done", 2, 2), ("press", 4): ("done", 2, 2)}
    done = {k for k, v in status.items() if v[0] == "done"}
    runs = passes.committed_runs(spark, out).collect()
    assert sorted((r.digest_type, r.run_date.day, r.chunk_no) for r in runs) == sorted((*k, c) for k in done for c in range(2))
    text = lambda t, d: "".join(r.markdown for r in sorted(runs, key=lambda r: r.chunk_no) if (r.digest_type, r.run_date.day) == (t, d))
    assert text("org", 1).startswith("# Org News Digest — January 2024\n") and text("org", 1).endswith("---\n\nbody 0 0\n\nbody 0 1")
    assert text("press", 3).endswith(" body 5 0 \n\n body 5 1 ") and text("org", 4).endswith("half\n\nbody 6 1")
    assert len({r.id for r in runs}) == len(done) and {(r.source_count, r.item_count) for r in runs} == {(3, 4)}
    links = sorted((r.digest_type, r.first_seen.day, r.link) for r in passes.committed_ledger(spark, out).collect())
    assert links == sorted((t, d, x) for t, d in done for x in (f"https://{t}/2024-01-0{d}", "https://same"))
    # the index counts runs, not chunks
    index = {r.run_date: (r.press_runs, r.org_runs) for r in history.date_index(passes.committed_runs(spark, out)).collect()}
    assert index["2024-01-01"] == (1, 1) and index["2024-01-03"] == (1, 0)


def test_nothing_shows_without_its_commit_and_a_repeat_changes_nothing(spark, scratch_dir, world):
    asked, told, totals, items = world
    out = os.path.join(scratch_dir, "out")
    joined = [(*r[:5], *(next((x[5], x[1], x[2], x[3], x[4], True) for x in told[0] if x[0] == r[0]))) for r in asked[:2]]
    schema = ("request_id string, digest_type string, run_date date, chunk_no int, n_chunks int, received_at timestamp, "
              "blocks array<struct<type:string,text:string>>, stop_reason string, status_code int, connection_error boolean, answered boolean")
    handle = passes.make_pass_handler(totals, items, out)
    handle(spark.createDataFrame(joined[:1], schema), 0)   # half a pass: nothing decided
    assert passes.commits(spark, out).count() == 0 and not os.path.exists(f"{out}/runs")
    handle(spark.createDataFrame(joined[1:], schema), 1)
    before = (passes.committed_runs(spark, out).collect(), passes.committed_ledger(spark, out).collect(), passes.commits(spark, out).collect())
    assert len(before[0]) == 2 and len(before[1]) == 2
    handle(spark.createDataFrame(joined[1:], schema), 1)   # the batch is repeated
    after = (passes.committed_runs(spark, out).collect(), passes.committed_ledger(spark, out).collect(), passes.commits(spark, out).collect())
    assert [sorted(map(str, x)) for x in after] == [sorted(map(str, x)) for x in before]
    # a failure before the commit: the written partitions belong to no committed pass
    lost = os.path.join(scratch_dir, "lost")
    handle = passes.make_pass_handler(totals, items, lost)
    handle(spark.createDataFrame(joined, schema), 0)
    os.rename(f"{lost}/commits", f"{lost}/_commits")
    assert passes.committed_runs(spark, lost).count() == 0 and passes.committed_ledger(spark, lost).count() == 0
    handle(spark.createDataFrame(joined, schema), 0)
    assert passes.committed_runs(spark, lost).count() == 2 and passes.committed_ledger(spark, lost).count() == 2
