"""Catalogue, settings, preferences and landed feed files."""

import json
import os

from pyspark.sql import functions as F

from feedweave.sources import catalogue, feeds

RSS = """<?xml version="1.0"?><rss version="2.0" xmlns:dc="http://purl.org/dc/elements/1.1/"><channel>
<title>Wire</title>
<item><title>First &amp; best</title><link> https://w/1 </link><guid>g1</guid>
<description><![CDATA[<p>Acme Corp announces</p>]]></description>
<pubDate>Thu, 04 Jan 2024 10:00:00 +0000</pubDate><dc:creator>Acme</dc:creator></item>
<item><title>Second</title><link>https://w/2</link><description>plain</description></item>
</channel></rss>"""

ATOM = """<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom"><title>A</title>
<entry><id>urn:a1</id><title>Atom one</title><link rel="self" href="https://a/1.xml"/>
<link rel="alternate" href="https://a/1"/><summary type="html">&lt;b&gt;S&lt;/b&gt;</summary>
<author><name>Ann</name></author><updated>2024-01-04T12:00:00+02:00</updated></entry>
</feed>"""

TRUNCATED = """<rss><channel><item><title>ok1</title><link>https://t/1</link></item>
<item><title>ok2</title><link>https://t/2</link></item><item><title>cut"""

HTML = "<!DOCTYPE html><html><body><p>Not a feed</p></body></html>"
EMPTY = "<rss><channel><title>none</title></channel></rss>"


def land(root, digest_type, idx, text):
    d = os.path.join(root, f"digest_type={digest_type}", f"source_idx={idx}")
    os.makedirs(d, exist_ok=True)
    with open(os.path.join(d, "feed.xml"), "w") as fh:
        fh.write(text)


def test_feed_status_and_entries(spark, scratch_dir):
    root = os.path.join(scratch_dir, "landing")
    for i, text in enumerate([RSS, ATOM, TRUNCATED, HTML, EMPTY]):
        land(root, "press", i, text)
    docs = feeds.read_landed(spark, root)
    status = {r.source_idx: (r.status, r.n_entries) for r in feeds.feed_status(docs).collect()}
    assert status == {0: ("ok", 2), 1: ("ok", 1), 2: ("ok", 2), 3: ("malformed", 0),
                      4: ("empty", 0)}
    e = {(r.source_idx, r.pos): r for r in feeds.parse_entries(docs).collect()}
    assert sorted(e) == [(0, 0), (0, 1), (1, 0), (2, 0), (2, 1)]
    first = e[(0, 0)]
    assert (first.title, first.link, first.entry_id, first.author) == ("First & best", "https://w/1", "g1", "Acme")
    assert first.summary == "<p>Acme Corp announces</p>"
    assert str(first.pub_ts) == "2024-01-04 10:00:00"
    atom = e[(1, 0)]
    assert (atom.link, atom.author, atom.summary) == ("https://a/1", "Ann", "<b>S</b>")
    assert str(atom.pub_ts) == "2024-01-04 10:00:00"
    assert e[(0, 1)].pub_ts is None


def test_entries_of_awkward_feeds(spark, scratch_dir):
    root = os.path.join(scratch_dir, "landing2")
    land(root, "org", 0, "<rss><channel><item><title>a&nbsp;b &amp; c & d</title><guid isPermaLink=\"false\">g</guid></item>"
                         "<item><title>p</title><guid>https://p/1</guid><content:encoded>body</content:encoded></item>"
                         "<item><title>bad <b></title></item></channel></rss>")
    with open(os.path.join(root, "digest_type=org", "source_idx=0", "next.xml"), "w") as fh:
        fh.write("<feed><entry><title>n</title><content>c</content><link href=\"https://n/1\"/></entry></feed>")
    docs = feeds.read_landed(spark, root)
    got = {r.pos: (r.title, r.link, r.summary) for r in feeds.parse_entries(docs).collect()}
    assert got == {0: ("a\xa0b & c & d", None, None), 1: ("p", "https://p/1", "body"), 3: ("n", "https://n/1", "c")}
    status = sorted((r.n_entries, r.n_bad, r.status) for r in feeds.feed_status(docs).collect())
    assert status == [(1, 0, "ok"), (3, 1, "ok")]


def test_catalogue_order_defaults_and_filters(spark, scratch_dir):
    path = os.path.join(scratch_dir, "org", "sources.json")
    os.makedirs(os.path.dirname(path))
    doc = {"_comment": "x", "sources": [
        {"_section": "-- A --"},
        {"_disabled": True, "name": "Off", "feed_url": "https://off"},
        {"name": "NoOrg", "feed_url": "https://n", "source_filter": ["Acme"]},
        {"name": "NoUrl"},
        {"name": "Empty", "org": "E", "feed_url": ""},
        {"feed_url": "https://anon", "category": "C"},
    ]}
    with open(path, "w") as fh:
        json.dump(doc, fh, indent=2)
    cat = catalogue.read_catalogue(spark, path)
    active = catalogue.active_sources(cat)
    assert active.count() == 4          # has feed_url key: disabled and empty URL still counted
    srcs = catalogue.with_source_defaults(active)
    rows = {r.source_idx: r for r in srcs.collect()}
    assert rows[2].org == "NoOrg" and rows[2].source_filter == ["Acme"] and rows[2].digest_type == "org"
    assert rows[5].source_name == "Unknown source" and rows[5].org == "Unknown source"
    fetch = sorted(r.source_idx for r in catalogue.fetchable_sources(srcs).collect())
    assert fetch == [2, 5]


def test_settings_and_preferences(spark, scratch_dir):
    path = os.path.join(scratch_dir, "digest_config.json")
    with open(path, "w") as fh:
        json.dump({"_comment": "c", "org": {"days_back": 2, "max_items_per_source": 20,
                                             "min_items_to_send": 1, "model": "m"},
                   "press": {"days_back": 1, "max_items_per_source": 60,
                             "min_items_to_send": 1, "model": "m"}}, fh, indent=2)
    s = {r.digest_type: r for r in catalogue.read_settings(spark, path).collect()}
    assert set(s) == {"org", "press"}
    assert (s["org"].max_items_per_source, s["press"].days_back, s["org"].dedup_days) == (20, 1, 7)
    prefs = os.path.join(scratch_dir, "prefs.md")
    with open(prefs, "w") as fh:
        fh.write("\n  # Prefs\n- more\n\n")
    assert catalogue.read_preferences(spark, prefs) == "# Prefs\n- more"
    assert catalogue.read_preferences(spark, os.path.join(scratch_dir, "missing.md")) == ""


def test_landed_feeds_through_ingest(spark, scratch_dir):
    from feedweave.operators import ingest
    from helpers import ledger_df, settings_df
    root = os.path.join(scratch_dir, "landing")
    land(root, "press", 0, RSS)
    land(root, "press", 1, TRUNCATED)
    docs = feeds.read_landed(spark, root)
    sources = spark.createDataFrame(
        [("press", 0, "Wire", "Wire", "c", ["acme"]), ("press", 1, "T", "T", "c", [])],
        "digest_type string, source_idx int, source_name string, org string, category string, "
        "source_filter array<string>")
    entries = feeds.feed_entries(docs, sources)
    out = ingest.fresh_items(entries, settings_df(spark), ledger_df(spark, []), "2024-01-05 00:00:00")
    got = sorted((r.source_idx, r.title, r.summary) for r in out.collect())
    # the wire item without the term is dropped; the filter sees the raw HTML summary
    assert got == [(0, "First & best", "Acme Corp announces"), (1, "ok1", ""), (1, "ok2", "")]
