"""Incremental ingest equals the batch replay; re-running is a no-op (L1-L3)."""

import datetime as dt
import os
import random

from feedweave.operators import ledger
from feedweave.streaming import incremental


def rss(links):
    items = "".join(f"<item><title>{l}</title><link>{l}</link></item>" for l in links)
    return f"<rss><channel>{items}</channel></rss>"


def test_stream_matches_replay_and_is_idempotent(spark, scratch_dir):
    from helpers import settings_df
    rnd = random.Random(3)
    d0 = dt.date(2024, 1, 1)
    landing = os.path.join(scratch_dir, "landing")
    sightings = set()
    for day in range(12):
        d = d0 + dt.timedelta(day)
        for t, idx in (("org", 0), ("press", 1)):
            links = sorted({f"https://s/{rnd.randrange(8)}" for _ in range(3)})
            for link in links:
                sightings.add((t, link, d))
            p = os.path.join(landing, f"run_date={d}", f"digest_type={t}", f"source_idx={idx}")
            os.makedirs(p)
            with open(os.path.join(p, "feed.xml"), "w") as fh:
                fh.write(rss(links))
    sources = spark.createDataFrame(
        [("org", 0, "o", "o", "c", []), ("press", 1, "p", "p", "c", [])],
        "digest_type string, source_idx int, source_name string, org string, category string, "
        "source_filter array<string>")
    settings = settings_df(spark, cap=20, min_items=0)
    paths = {k: os.path.join(scratch_dir, k) for k in ("ledger", "runs", "ckpt")}
    q = incremental.start_incremental(spark, landing, sources, settings, paths["ledger"],
                                      paths["runs"], paths["ckpt"], max_files_per_trigger=7)
    q.awaitTermination(600)
    got = sorted((r.digest_type, r.link, r.run_date)
                 for r in incremental.accepted_sightings(spark, paths["ledger"]).collect())
    sdf = spark.createDataFrame(sorted(sightings), "digest_type string, link string, run_date date")
    want = sorted((r.digest_type, r.link, r.run_date) for r in ledger.replay(sdf, 7).collect())
    assert got == want
    # replaying the batches of the same stream changes nothing
    handler = incremental.make_batch_handler(sources, settings, paths["ledger"], paths["runs"])
    batch = spark.read.schema(incremental.LANDING_SCHEMA).option("wholetext", True).text(landing)
    first_day = batch.filter("run_date = date'2024-01-01'")
    handler(first_day, 0)
    again = sorted((r.digest_type, r.link, r.run_date)
                   for r in incremental.accepted_sightings(spark, paths["ledger"]).collect())
    assert again == want
    runs = spark.read.parquet(paths["runs"])
    assert runs.select("run_date").distinct().count() == 12


def test_a_run_is_whole_however_its_files_come(spark, scratch_dir):
    """Two files of one run, each below the gate: the gate counts the run, not the micro-batch."""
    from helpers import settings_df
    landing = os.path.join(scratch_dir, "landing")
    for day, idx, links in (("2024-01-02", 0, ["https://a/1", "https://a/2"]), ("2024-01-02", 1, ["https://a/2", "https://a/3"]),
                            ("2024-01-03", 0, ["https://a/1", "https://a/4"]), ("2024-01-03", 1, ["https://a/5"])):
        p = os.path.join(landing, f"run_date={day}", "digest_type=org", f"source_idx={idx}")
        os.makedirs(p)
        with open(os.path.join(p, "feed.xml"), "w") as fh:
            fh.write(rss(links))
    sources = spark.createDataFrame([("org", i, f"o{i}", "o", "c", []) for i in (0, 1)],
                                    "digest_type string, source_idx int, source_name string, org string, category string, "
                                    "source_filter array<string>")
    got = {}
    for files in (None, 1):
        paths = {k: os.path.join(scratch_dir, f"{k}-{files}") for k in ("ledger", "runs", "ckpt")}
        q = incremental.start_incremental(spark, landing, sources, settings_df(spark, cap=20, min_items=2), paths["ledger"],
                                          paths["runs"], paths["ckpt"], max_files_per_trigger=files)
        q.awaitTermination(600)
        got[files] = sorted((r.link, str(r.run_date)) for r in incremental.accepted_sightings(spark, paths["ledger"]).collect())
    assert got[None] == got[1] == [("https://a/1", "2024-01-02"), ("https://a/2", "2024-01-02"), ("https://a/3", "2024-01-02"),
                                   ("https://a/4", "2024-01-03"), ("https://a/5", "2024-01-03")]


def test_response_stream_memory_and_sections(spark, scratch_dir):
    import json
    rdir = os.path.join(scratch_dir, "responses")
    os.makedirs(rdir)
    body = ("## Trends & Continuity\nt{n}\n\n## Bigger Picture: Feature Pitch\np{n}\n\n"
            "```digest_memory\n- mem {n}\n```")
    rows = []
    for n in range(6):
        rows.append({"request_id": n, "digest_type": "org" if n % 2 else "press",
                     "blocks": [{"type": "text", "text": body.format(n=n)}],
                     "stop_reason": "refusal" if n == 5 else "end_turn", "status_code": 200,
                     "connection_error": False,
                     "received_at": f"2024-01-0{n + 1}T13:00:00"})
    for i, chunk in enumerate((rows[:3], rows[3:])):
        with open(os.path.join(rdir, f"part-{i}.json"), "w") as fh:
            fh.write("\n".join(json.dumps(r) for r in chunk))
    paths = {k: os.path.join(scratch_dir, k) for k in ("sections", "memory", "ckpt")}
    q = incremental.start_responses_incremental(spark, rdir, paths["sections"], paths["memory"],
                                                paths["ckpt"])
    q.awaitTermination(300)
    mem = {r.digest_type: r.memory for r in incremental.current_memory(spark, paths["memory"]).collect()}
    assert mem == {"press": "- mem 4", "org": "- mem 3"}     # request 5 was refused
    secs = {r.request_id: (r.outcome, r.trends_raw, r.feature_pitch_raw)
            for r in spark.read.parquet(paths["sections"]).collect()}
    assert secs[0] == ("ok", "t0", "p0") and secs[5][0] == "refused"


def test_a_late_file_computes_only_the_days_that_it_changes(spark, scratch_dir):
    import glob
    from helpers import settings_df
    landing = os.path.join(scratch_dir, "landing")

    def put(day, idx, links):
        p = os.path.join(landing, f"run_date=2024-01-{day:02}", "digest_type=org", f"source_idx={idx}")
        os.makedirs(p)
        with open(os.path.join(p, "feed.xml"), "w") as fh:
            fh.write(rss(links))

    put(2, 0, ["https://a/1"])
    put(4, 0, ["https://a/2"])
    put(20, 0, ["https://a/1", "https://a/2"])
    sources = spark.createDataFrame([("org", i, f"o{i}", "o", "c", []) for i in (0, 1)],
                                    "digest_type string, source_idx int, source_name string, org string, category string, "
                                    "source_filter array<string>")
    paths = {k: os.path.join(scratch_dir, k) for k in ("ledger", "runs", "ckpt")}
    go = lambda: incremental.start_incremental(spark, landing, sources, settings_df(spark, cap=20, min_items=0), paths["ledger"],
                                               paths["runs"], paths["ckpt"]).awaitTermination(600)
    go()
    files = {d: sorted(glob.glob(f"{paths['runs']}/run_date=2024-01-{d:02}/part-*")) for d in (2, 4, 20)}
    put(2, 1, ["https://a/2"])  # late: day 4 loses its link, day 20 is beyond the retention of both
    go()
    now = {d: sorted(glob.glob(f"{paths['runs']}/run_date=2024-01-{d:02}/part-*")) for d in (2, 4, 20)}
    assert now[20] == files[20] and now[4] != files[4] and now[2] != files[2]
    got = sorted((r.link, r.run_date.day) for r in incremental.accepted_sightings(spark, paths["ledger"]).collect())
    assert got == [("https://a/1", 2), ("https://a/1", 20), ("https://a/2", 2), ("https://a/2", 20)]
