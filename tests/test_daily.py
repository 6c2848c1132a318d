"""The daily job end to end from configuration files and landed feeds."""

import datetime as dt
import hashlib
import json
import os

from feedweave.operators import assemble
from feedweave.plans import daily

RSS = ("<rss><channel>"
       "<item><title>New one</title><link>https://n/1</link><description>fresh &lt;b&gt;x&lt;/b&gt;</description>"
       "<pubDate>Thu, 04 Jan 2024 10:00:00 +0000</pubDate></item>"
       "<item><title>Seen</title><link>https://n/2</link><pubDate>Thu, 04 Jan 2024 09:00:00 +0000</pubDate></item>"
       "<item><title>Old</title><link>https://n/3</link><pubDate>Mon, 01 Jan 2024 09:00:00 +0000</pubDate></item>"
       "</channel></rss>")


def test_daily_pass_from_files(spark, scratch_dir):
    cfg = os.path.join(scratch_dir, "org")
    os.makedirs(cfg)
    with open(os.path.join(cfg, "sources.json"), "w") as fh:
        json.dump({"sources": [{"_section": "x"},
                               {"name": "Feed A", "org": "A", "category": "Cat", "feed_url": "https://a"},
                               {"name": "Off", "feed_url": "https://off", "_disabled": True}]}, fh)
    settings = os.path.join(scratch_dir, "digest_config.json")
    with open(settings, "w") as fh:
        json.dump({"dedup_days": 7, "org": {"days_back": 2, "max_items_per_source": 20,
                                             "min_items_to_send": 1, "model": "m"}}, fh)
    land = os.path.join(scratch_dir, "landing", "digest_type=org", "source_idx=1")
    os.makedirs(land)
    with open(os.path.join(land, "feed.xml"), "w") as fh:
        fh.write(RSS)
    book = spark.createDataFrame([("https://n/2", "org", dt.date(2024, 1, 1))],
                                 "link string, digest_type string, first_seen date")
    out = daily.daily_pass_from_files(spark, os.path.join(cfg, "sources.json"), settings,
                                      os.path.join(scratch_dir, "landing"), book,
                                      "2024-01-05 00:00:00")
    fresh = out.fresh.collect()
    assert [(r.title, r.summary, r.item_no) for r in fresh] == [("New one", "fresh x", 1)]
    tot = out.totals.collect()
    assert [(r.digest_type, r.source_count, r.item_count) for r in tot] == [("org", 2, 1)]
    header = out.headers.first().header
    assert header.startswith("# Org News Digest — January 2024\n**Run date:** 2024-01-05")
    assert "**Sources monitored:** 2 | **Items fetched:** 1" in header
    req = out.requests.first().user_text
    assert "Total items to process: 1" in req and "[Item 1]\nOrg: A\nCategory: Cat\nSource: Feed A" in req

    # nothing is recorded without a usable response; with one, run and links come together
    schema = ("request_id string, blocks array<struct<type:string,text:string>>, stop_reason string, "
              "status_code int, connection_error boolean")
    rid = out.requests.first().request_id
    for blocks, stop, status in (([("text", "no")], "refusal", 200), ([], None, 502), ([("text", "  ")], "end_turn", 200)):
        failed = daily.finish_pass(out, spark.createDataFrame([(rid, blocks, stop, status, False)], schema))
        assert failed.runs.count() == 0 and failed.ledger_rows.count() == 0
    assert daily.finish_pass(out, spark.createDataFrame([], schema)).ledger_rows.count() == 0
    good = daily.finish_pass(out, spark.createDataFrame([(rid, [("text", "\n body \n")], "end_turn", 200, False)], schema))
    run = good.runs.first()
    assert (str(run.run_date), run.digest_type, run.source_count, run.item_count) == ("2024-01-05", "org", 2, 1)
    assert run.markdown == header + "body"
    assert [(r.link, str(r.first_seen)) for r in good.ledger_rows.collect()] == [("https://n/1", "2024-01-05")]


def test_both_flat_catalogues(spark, scratch_dir):
    """config/{org,press}_sources.json beside each other: the file's name gives the type."""
    cfg = os.path.join(scratch_dir, "config")
    os.makedirs(cfg)
    for t in ("org", "press"):
        with open(os.path.join(cfg, f"{t}_sources.json"), "w") as fh:
            json.dump({"sources": [{"name": f"Feed {t}", "feed_url": f"https://{t}"}]}, fh)
        land = os.path.join(scratch_dir, "landing", f"digest_type={t}", "source_idx=0")
        os.makedirs(land)
        with open(os.path.join(land, "feed.xml"), "w") as fh:
            fh.write(RSS)
    with open(os.path.join(cfg, "digest_config.json"), "w") as fh:
        one = {"days_back": 2, "max_items_per_source": 20, "min_items_to_send": 1, "model": "m"}
        json.dump({"_comment": "c", "dedup_days": 7, "org": one, "press": one}, fh)
    book = spark.createDataFrame([], "link string, digest_type string, first_seen date")
    paths = [os.path.join(cfg, f"{t}_sources.json") for t in ("org", "press")]
    out = daily.daily_pass_from_files(spark, paths, os.path.join(cfg, "digest_config.json"), os.path.join(scratch_dir, "landing"), book, "2024-01-05 00:00:00",
                                      preferences_path=os.path.join(cfg, "absent.md"))
    assert sorted((r.digest_type, r.source_count, r.item_count) for r in out.totals.collect()) == [("org", 1, 2), ("press", 1, 2)]
    assert {r.source_name for r in out.fresh.collect()} == {"Feed org", "Feed press"}


def test_a_run_has_one_digest_over_all_its_chunks(spark):
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    runs = {"org": ["a", "b", "c"], "press": ["a", "c", "b"], "other": ["a"]}
    rows = spark.createDataFrame([(t, i, md5(x)) for t, texts in runs.items() for i, x in enumerate(texts)], "t string, chunk_no int, h string").repartition(3)
    got = {(r.t, r.chunk_no): (r.h, r.whole) for r in assemble.with_whole_md5(rows, ["t"], "chunk_no", "h", "whole").collect()}
    assert got == {(t, i): (md5(x), md5("".join(map(md5, texts)))) for t, texts in runs.items() for i, x in enumerate(texts)}


def test_digest_rows_tell_the_whole_run(spark, scratch_dir):
    from __spark_entry__ import queries
    docs = [(i, f"src{6 + i % 12}", "en", f"Text {i} que") for i in range(360)]
    spark.createDataFrame(docs, "doc_id long, source string, lang string, text string").coalesce(1).write.parquet(os.path.join(scratch_dir, "documents.parquet"))
    rows = sorted(queries()["digest_rows"](spark, scratch_dir).collect(), key=lambda r: r.chunk_no)
    assert len(rows) > 1 and [(r.digest_type, r.n_chunks) for r in rows] == [("org", len(rows))] * len(rows)
    assert {r.digest_md5 for r in rows} == {hashlib.md5("".join(r.markdown_md5 for r in rows).encode()).hexdigest()}
