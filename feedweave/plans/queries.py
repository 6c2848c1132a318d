"""

Each entry is ``(spark, sf_dir) -> DataFrame``.  Output columns are aliased to
match ``feedweave.plans.oracle.ORACLE``; timestamps are rendered as text so
both engines hash the same values.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedweave.functions import markdown as mdf
from feedweave.functions import responses as rsp
from feedweave.functions import text as tx
from feedweave.operators import assemble, checks, curate, day_index, history, ingest, ledger, search_index, trends
from feedweave.session import reliable_checkpoint, shared_folder
from feedweave.sources import catalogue, feeds
from feedweave.sources import fixtures as fx
from feedweave.streaming import ledger_state, passes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def ts_text(col) -> F.Column:
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss")


def _staged(spark, sf_dir, settings=None):
    s = settings if settings is not None else fx.settings(spark)
    return ingest.with_settings(fx.feed_items(spark, sf_dir), s)


# ---------------------------------------------------------------- ingest (§2.3, §2.6)

@query("fresh_items")
def q_fresh_items(spark, sf_dir):
    out = ingest.fresh_items(fx.feed_items(spark, sf_dir), fx.settings(spark),
                             fx.seen_ledger(spark, sf_dir), fx.AS_OF)
    return out.select("digest_type", "item_no", "source_idx", "pos", "org", "category",
                      "source_name", "title", "summary", "link", "published",
                      ts_text("pub_ts").alias("pub_ts"))


@query("per_source_cap")
def q_per_source_cap(spark, sf_dir):
    df = ingest.cap_per_source(_staged(spark, sf_dir), cap=20)
    return df.select("digest_type", "source_idx", "pos", "entry_id")


@query("recency_cutoff")
def q_recency_cutoff(spark, sf_dir):
    df = ingest.recency_cutoff(ingest.cap_per_source(_staged(spark, sf_dir)), fx.AS_OF)
    return df.select("digest_type", "source_idx", "pos", "entry_id",
                     tx.published_label("pub_ts").alias("published"))


@query("source_filter")
def q_source_filter(spark, sf_dir):
    df = ingest.recency_cutoff(ingest.cap_per_source(_staged(spark, sf_dir)), fx.AS_OF)
    df = ingest.source_filter(df)
    return df.select("digest_type", "source_idx", "pos", "entry_id")


@query("in_run_dedup")
def q_in_run_dedup(spark, sf_dir):
    df = ingest.in_run_dedup(_staged(spark, sf_dir))
    return df.select("digest_type", "entry_key", "source_idx", "pos", "entry_id")


@query("newest_first")
def q_newest_first(spark, sf_dir):
    df = _staged(spark, sf_dir)
    df = ingest.in_run_dedup(ingest.source_filter(
        ingest.recency_cutoff(ingest.cap_per_source(df), fx.AS_OF)))
    ranked = ingest.newest_first(df, "rank")
    return ranked.select("digest_type", "rank", "source_idx", "pos",
                         tx.published_label("pub_ts").alias("published"))


@query("min_items_gate")
def q_min_items_gate(spark, sf_dir):
    # threshold of 100 fresh items: the smaller pass is gated at sf0.01
    s = fx.settings(spark, min_items=100)
    out = ingest.fresh_items(fx.feed_items(spark, sf_dir), s, fx.seen_ledger(spark, sf_dir),
                             fx.AS_OF, ordered=False)
    return ingest.type_counts(out).select("digest_type", F.col("n_items").alias("item_count"))


# ---------------------------------------------------------------- text scalars (§2.2)

@query("entry_key")
def q_entry_key(spark, sf_dir):
    it = fx.feed_items(spark, sf_dir)
    # a whitespace-only link on some rows exercises the or-before-strip corner
    link = F.when(F.col("doc_id") % 29 == 0, F.lit("  \t")).otherwise(F.col("link"))
    return it.select("doc_id", tx.entry_key(link, "entry_id", "title").alias("entry_key"))


@query("entry_date")
def q_entry_date(spark, sf_dir):
    d = fx.table(spark, sf_dir, "documents").select("doc_id")
    base = F.timestamp_add("MINUTE", (F.col("doc_id") % 60).cast("int"),
                           F.timestamp_add("HOUR", ((F.col("doc_id") * 37) % 96).cast("int"),
                                           F.lit(fx.BASE_TS).cast("timestamp")))
    m = F.col("doc_id") % 5
    published = (F.when(m == 0, F.concat(F.date_format(base, "EEE, dd MMM yyyy HH:mm:ss"),
                                         F.lit(" +0000")))
                 .when(m == 1, F.concat(F.date_format(base, "yyyy-MM-dd'T'HH:mm:ss"),
                                        F.lit("+02:00")))
                 .when(m == 2, F.lit("not a date"))
                 .when(m == 3, F.lit(None).cast("string"))
                 .otherwise(F.lit("")))
    updated = F.when(F.col("doc_id") % 3 == 0, F.date_format(
        F.timestamp_add("HOUR", F.lit(1), base), "yyyy-MM-dd HH:mm:ss"))
    created = F.concat(F.date_format(F.timestamp_add("HOUR", F.lit(2), base),
                                     "dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))
    return d.select("doc_id", ts_text(tx.entry_date(published, updated, created)).alias("entry_ts"))


def _landed_feeds(spark, sf_dir):
    """A feed file per document: RSS or Atom by its language, with what readers must cope with."""
    d = fx.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    text = F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    url = F.concat(F.lit("https://f/"), F.col("doc_id").cast("string"))
    c = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    value = (F.when(F.col("lang") == "en", c("<rss><channel><item><title>A &amp; B</title><link>", url, "</link><description>", text,
                                             "</description><pubDate>Thursday, 04 Jan 24 10:00 GMT</pubDate></item></channel></rss>"))
             .when(F.col("lang") == "fr", c("<feed><entry><id>i</id><title>T</title><link rel=\"self\" href=\"x\"/><link href=\"", url,
                                            "\"/><summary>", text, "</summary><updated>2024-01-04T12:00:00.1234567+0200</updated></entry></feed>"))
             .when(F.col("lang") == "de", c("<feed><entry><id>i</id><title>T</title><link href=\"", url, "\"/><content>", text,
                                            "</content><published>2024-01-04 10:00Z</published></entry></feed>"))
             .otherwise(c("<rss><channel><item><title>One&nbsp;title</title><guid>", url, "</guid><content:encoded>", text,
                          "</content:encoded></item><item><title>cut <b></title></item></channel></rss>")))
    return d.select(F.lit("org").alias("digest_type"), F.col("doc_id").cast("int").alias("source_idx"),
                    F.lit("feed.xml").alias("path"), value.alias("value"))


@query("feed_entries")
def q_feed_entries(spark, sf_dir):
    e = feeds.parse_entries(_landed_feeds(spark, sf_dir))
    return e.select("source_idx", "pos", "title", "link", tx.clean_html("summary").alias("summary"),
                    ts_text("pub_ts").alias("pub_ts"))


@query("feed_status")
def q_feed_status(spark, sf_dir):
    return feeds.feed_status(_landed_feeds(spark, sf_dir)).select("source_idx", "n_entries", "n_bad", "status")


@query("clean_html")
def q_clean_html(spark, sf_dir):
    p = fx.table(spark, sf_dir, "pages").select("page_id", "html")
    return p.select("page_id", tx.clean_html("html").alias("text"),
                    F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


@query("article_projection")
def q_article_projection(spark, sf_dir):
    arts = ingest.project_articles(_staged(spark, sf_dir))
    return arts.select("digest_type", "source_idx", "pos", "title", "summary", "link", "published")


# ---------------------------------------------------------------- ledger (§2.6 F7, §2.10)


LEDGER_PRUNE_AS_OF = "2024-01-08"


@query("ledger_replay")
def q_ledger_replay(spark, sf_dir):
    out = ledger.replay(fx.sightings(spark, sf_dir), dedup_days=7)
    return out.select("digest_type", "link", F.col("run_date").cast("string").alias("run_date"))


@query("ledger_stream")
def q_ledger_stream(spark, sf_dir):
    """``ledger_replay`` by the stream's keyed state: sightings landed week by week, two files a micro-batch."""
    sightings = fx.sightings(spark, sf_dir)
    base = shared_folder(spark, "ledger-stream")
    for week in range(6):  # the events span 30 days; files of a week are open together
        days = F.date_diff("run_date", F.lit(fx.BASE_DATE).cast("date"))
        ledger_state.land(sightings.filter(F.floor(days / 6) == week).coalesce(2), f"{base}/sightings")
    last = sightings.agg(F.max("run_date")).first()[0]
    if last is not None:
        ledger_state.heartbeat(spark, f"{base}/sightings", last + dt.timedelta(30))
    ledger_state.start_ledger_stream(spark, f"{base}/sightings", f"{base}/accepted", f"{base}/state", dedup_days=7,
                                     late_days=6, max_files_per_trigger=2).awaitTermination()
    out = ledger_state.read_accepted(spark, f"{base}/accepted")
    return out.select("digest_type", "link", F.col("run_date").cast("string").alias("run_date"))


@query("ledger_late_days")
def q_ledger_late_days(spark, sf_dir):
    """``ledger_replay`` without the days whose files come late, then those days worked in by key."""
    sightings = fx.sightings(spark, sf_dir)
    is_late = F.dayofmonth("run_date") % 9 == 4
    accepted = reliable_checkpoint(ledger.replay(sightings.filter(~is_late), dedup_days=7))
    changes = ledger.refold(sightings, accepted, sightings.filter(is_late), dedup_days=7, span_days=10)
    out = ledger.apply_changes(accepted, changes)
    return out.select("digest_type", "link", F.col("run_date").cast("string").alias("run_date"))


@query("ledger_insert")
def q_ledger_insert(spark, sf_dir):
    book = fx.seen_ledger(spark, sf_dir)
    fresh = ingest.fresh_items(fx.feed_items(spark, sf_dir), fx.settings(spark), book,
                               fx.AS_OF, ordered=False)
    rows = ledger.new_rows(fresh, book, fx.AS_OF, dedup_days=7)
    return rows.select("link", "digest_type", F.col("first_seen").cast("string").alias("first_seen"))


@query("ledger_prune")
def q_ledger_prune(spark, sf_dir):
    kept = ledger.live(fx.seen_ledger(spark, sf_dir), LEDGER_PRUNE_AS_OF, dedup_days=7)
    return kept.select("link", "digest_type", F.col("first_seen").cast("string").alias("first_seen"))


# ---------------------------------------------------------------- history (§2.5, §2.6, §2.7)

@query("date_index")
def q_date_index(spark, sf_dir):
    return history.date_index(fx.digest_runs(spark, sf_dir), "")


@query("date_index_search")
def q_date_index_search(spark, sf_dir):
    return history.date_index(fx.digest_runs(spark, sf_dir), "  que ")


@query("date_index_search_escape")
def q_date_index_search_escape(spark, sf_dir):
    # a backslash before a plain character stands for that character
    return history.date_index(fx.digest_runs(spark, sf_dir), " q\\ue ")


@query("date_index_search_date")
def q_date_index_search_date(spark, sf_dir):
    return history.date_index(fx.digest_runs(spark, sf_dir), "2024-01-1")


@query("date_index_wide")
def q_date_index_wide(spark, sf_dir):
    """The index over a long history (one run per order), exercising the 400-day limit."""
    o = fx.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate",
                                                  "o_totalprice")
    runs = o.select(
        F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("run_date"),
        F.when(F.col("o_orderstatus") == "F", F.lit("press")).otherwise(F.lit("org")).alias("digest_type"),
        (F.col("o_orderkey") % 50).cast("int").alias("item_count"))
    return history.date_index(runs, "")


@query("runs_for_date")
def q_runs_for_date(spark, sf_dir):
    return history.day_ranks(fx.digest_runs(spark, sf_dir))


@query("day_documents")
def q_day_documents(spark, sf_dir):
    """Every run of every date with its texts."""
    out = history.runs_for_dates(fx.digest_runs(spark, sf_dir))
    return out.select("id", "run_date", "show_time", "display_rank", F.md5("markdown").alias("markdown_md5"),
                      F.md5("feature_pitch_raw").alias("pitch_md5"))


# terms of the search by index: plain, escaped, of the date text, with wildcards, too short, found nowhere
INDEXED_TERMS = ["  que ", "q\\ue", "2024-01-1", "er%ung", "e", "zzzzzz"]


@query("indexed_search")
def q_indexed_search(spark, sf_dir):
    """The date index of several terms, their runs found by the trigram index."""
    runs = fx.digest_runs(spark, sf_dir)
    index = search_index.build(runs, shared_folder(spark, "search-index"))
    out = None
    for term in INDEXED_TERMS:
        days = history.date_index(runs, term, found=search_index.search(runs, index, term)).select(F.lit(term).alias("term"), "*")
        out = days if out is None else out.unionByName(days)
    return out


@query("run_by_id")
def q_run_by_id(spark, sf_dir):
    runs = fx.digest_runs(spark, sf_dir)
    m = (F.col("id") / 100).cast("bigint") % 7
    raw = (F.when(m == 0, F.concat(F.col("id").cast("string"), F.lit("x")))
           .when(m == 1, F.concat(F.lit("-"), F.col("id").cast("string")))
           .when(m == 2, F.concat(F.lit("0"), F.col("id").cast("string")))
           .when(m == 3, F.concat(F.lit(" "), F.col("id").cast("string")))
           .when(m == 4, F.concat(F.col("id").cast("string"), F.lit("000000000000000")))
           .when(m == 5, F.concat(F.col("id").cast("string"), F.lit("\n")))
           .otherwise(F.col("id").cast("string")))
    requests = runs.select(raw.alias("raw_id"))
    out = history.lookup_runs(requests, runs)
    return out.select("raw_id", "valid", "id", "digest_type",
                      F.col("run_date").cast("string").alias("run_date"), "item_count",
                      history.run_time_label().alias("run_time"))


@query("previous_digest")
def q_previous_digest(spark, sf_dir):
    out = history.previous_run(fx.digest_runs(spark, sf_dir))
    return out.select("id", "digest_type", "seq", "prev_id",
                      F.col("prev_run_date").cast("string").alias("prev_run_date"))


@query("latest_digest")
def q_latest_digest(spark, sf_dir):
    out = history.latest_run(fx.digest_runs(spark, sf_dir))
    return out.select("digest_type", "id", F.col("run_date").cast("string").alias("run_date"))


@query("active_date")
def q_active_date(spark, sf_dir):
    runs = fx.digest_runs(spark, sf_dir)
    req = runs.select(F.date_add("run_date", F.when(F.col("id") % 9 == 0, F.lit(500))
                                 .otherwise(F.lit(0))).cast("string").alias("requested")).distinct()
    out = history.active_dates(req, history.date_index(runs, ""))
    return out.select("requested", "active_date", "press_runs", "org_runs", "press_items",
                      "org_items")


@query("run_time_label")
def q_run_time_label(spark, sf_dir):
    runs = fx.digest_runs(spark, sf_dir)
    return runs.select("id", ts_text("created_at").alias("created_at"),
                       history.run_time_label().alias("run_time"))


@query("run_labels")
def q_run_labels(spark, sf_dir):
    return history.run_labels(fx.digest_runs(spark, sf_dir))


@query("day_summary_labels")
def q_day_summary_labels(spark, sf_dir):
    return history.day_summary_labels(history.date_index(fx.digest_runs(spark, sf_dir), ""))


@query("run_constraints")
def q_run_constraints(spark, sf_dir):
    return history.constraint_violations(fx.digest_runs(spark, sf_dir))


@query("day_index_updates")
def q_day_index_updates(spark, sf_dir):
    """The date index after three batches: overlapping ones, and one with late days."""
    runs = fx.digest_runs(spark, sf_dir)
    path = shared_folder(spark, "day-index")
    late = F.dayofmonth("run_date") % 7 == 3
    day_index.update(runs.filter(~late & (F.col("id") % 3 != 0)), path)
    # a batch that repeats a third of the first; a row stands for its first, wrong, delivery
    day_index.update(runs.filter(~late & (F.col("id") % 3 != 1)), path)
    wrong = runs.withColumn("item_count", F.col("item_count") + 1).withColumn("created_at", F.timestamp_add("DAY", F.lit(-1), "created_at"))
    day_index.update(runs.filter(late).unionByName(wrong.filter(late & (F.col("id") % 2 == 0))), path)
    return day_index.read(spark, path)


@query("write_rules")
def q_write_rules(spark, sf_dir):
    """Rules of the three tables, counted while rows with faults are written."""
    out = shared_folder(spark, "write-rules")
    runs = fx.digest_runs(spark, sf_dir)
    runs = runs.withColumns({"id": F.when(F.col("id") % 5 == 0, F.lit(100)).otherwise(F.col("id")),
                             "digest_type": F.when(F.col("id") % 7 == 0, F.lit("other")).otherwise(F.col("digest_type")),
                             "markdown": F.when(F.col("id") % 11 != 0, F.col("markdown"))})
    book = fx.sightings(spark, sf_dir).select("link", "digest_type", F.when(F.dayofmonth("run_date") > 2, F.col("run_date")).alias("first_seen"))
    found = []
    for table, rows in (("runs", runs), ("ledger", book), ("memory", _memory_log(spark, sf_dir))):
        found += checks.write_checked(rows, table, lambda df, to=f"{out}/{table}": df.write.parquet(to))
    return checks.report(spark, found)


# ---------------------------------------------------------------- responses (§2.9 I1-I3, I8-I10, J4)


def _responses_with_body(spark, sf_dir):
    r = fx.responses(spark, sf_dir)
    return r.withColumn("body", rsp.response_text("blocks"))


@query("response_text")
def q_response_text(spark, sf_dir):
    r = _responses_with_body(spark, sf_dir)
    return r.select("request_id", F.col("body").alias("text"), rsp.is_blank("body").alias("is_blank"))


@query("response_triage")
def q_response_triage(spark, sf_dir):
    r = _responses_with_body(spark, sf_dir)
    return r.select("request_id", "stop_reason", "status_code",
                    rsp.triage("body", "stop_reason", "status_code", "connection_error").alias("outcome"))


@query("memory_block")
def q_memory_block(spark, sf_dir):
    r = _responses_with_body(spark, sf_dir)
    return r.select("request_id", rsp.has_memory("body").alias("has_memory"),
                    rsp.memory_block("body").alias("memory"))


@query("response_sections")
def q_response_sections(spark, sf_dir):
    r = _responses_with_body(spark, sf_dir).withColumn("visible", rsp.visible_body("body"))
    return r.select("request_id",
                    rsp.named_section("visible", rsp.TRENDS_HEADING).alias("trends_raw"),
                    rsp.named_section("visible", rsp.PITCH_HEADING).alias("feature_pitch_raw"))


def _memory_log(spark, sf_dir):
    """Memory revisions: usable responses with a closed fence, time-stamped by request."""
    r = _responses_with_body(spark, sf_dir)
    outcome = rsp.triage("body", "stop_reason", "status_code", "connection_error")
    usable = r.filter(outcome.isin("ok", "truncated") & rsp.has_memory("body"))
    return usable.select("digest_type", "request_id", rsp.memory_block("body").alias("memory"),
                         F.timestamp_add("MINUTE", F.col("request_id"),
                                         F.lit(fx.BASE_TS).cast("timestamp")).alias("updated_at"))


memory_latest = history.memory_latest


@query("memory_latest")
def q_memory_latest(spark, sf_dir):
    out = memory_latest(_memory_log(spark, sf_dir))
    return out.select("digest_type", "memory", ts_text("updated_at").alias("updated_at"))


@query("comparison_request")
def q_comparison_request(spark, sf_dir):
    runs = fx.digest_runs(spark, sf_dir)
    prev = history.previous_run(runs)
    mem = memory_latest(_memory_log(spark, sf_dir))
    return assemble.comparison_requests(runs, prev, mem)


INSTRUCTION = "Synthesis at the end of {label}, {context}"


@query("comparison_context")
def q_comparison_context(spark, sf_dir):
    """Instruction of each run's comparison, by its type."""
    runs = fx.digest_runs(spark, sf_dir)
    return runs.select("id", assemble.with_context(INSTRUCTION).alias("system"))


# ---------------------------------------------------------------- landed configuration (§2.1 A1, A2, A5, B1, B2, C1), J6


@query("landed_sources")
def q_landed_sources(spark, sf_dir):
    """Catalogue files as they are landed, one for each type, to active, defaulted and fetchable sources."""
    path = shared_folder(spark, "catalogue")
    c = fx.table(spark, sf_dir, "customer").select("c_custkey", "c_name").withColumn("k", F.col("c_custkey"))
    some = lambda every, value: F.when(F.col("k") % every != 0, value)
    source = F.struct(some(7, F.col("c_name")).alias("name"), some(5, F.concat(F.lit("org "), "c_name")).alias("org"), some(3, F.lit("cat")).alias("category"),
                      some(11, F.when(F.col("k") % 13 == 0, F.lit("")).otherwise(F.concat(F.lit("https://"), F.col("k").cast("string")))).alias("feed_url"),
                      F.when(F.col("k") % 4 == 0, F.array(F.lit("a"), F.lit("b"))).alias("source_filter"), F.when(F.col("k") % 6 == 0, F.lit(True)).alias("_disabled"),
                      F.when(F.col("k") % 17 == 0, F.lit("head")).alias("_section"))
    # a file holds the sources of one configuration: 100 of them
    listed = c.select(F.floor(F.col("k") / 100).alias("file"), F.struct("k", source.alias("s")).alias("s")).groupBy("file").agg(F.array_sort(F.collect_list("s")).alias("s"))
    listed.select(F.concat(F.lit("t"), F.col("file").cast("string")).alias("type"), F.to_json(F.struct(F.col("s.s").alias("sources"))).alias("value")).write.partitionBy("type").text(path)
    read = catalogue.read_catalogue(spark, path, F.regexp_extract("_file", "type=([^/]+)/", 1))
    kept = catalogue.fetchable_sources(catalogue.with_source_defaults(catalogue.active_sources(read)))
    return kept.select("digest_type", "source_idx", "source_name", "org", "category", "feed_url", F.array_join("source_filter", ",").alias("source_filter"))


@query("runs_of_two_schemas")
def q_runs_of_two_schemas(spark, sf_dir):
    """History written before the sections existed and after, read as one."""
    path = shared_folder(spark, "runs")
    runs = fx.digest_runs(spark, sf_dir)
    old = F.col("run_date") < F.lit("2024-01-15").cast("date")
    history.append_runs(runs.filter(old).drop("trends_raw", "feature_pitch_raw", "created_at"), path)
    history.append_runs(runs.filter(~old), path)
    history.append_runs(runs.filter(~old), path)  # once more: replaces itself
    out = history.read_runs(spark, path)
    return out.select("id", F.col("run_date").cast("string").alias("run_date"), "digest_type", "item_count", F.md5("markdown").alias("markdown_md5"),
                      F.md5("trends_raw").alias("trends_md5"), ts_text("created_at").alias("created_at"))


# ---------------------------------------------------------------- markdown (§2.9 I4-I7)

@query("markdown_blocks")
def q_markdown_blocks(spark, sf_dir):
    return mdf.line_blocks(fx.markdown_docs(spark, sf_dir), "markdown", ["doc_id"])


@query("markdown_spans")
def q_markdown_spans(spark, sf_dir):
    blocks = mdf.line_blocks(fx.markdown_docs(spark, sf_dir), "markdown", ["doc_id"])
    return mdf.inline_spans(blocks, ["doc_id", "line_no"])


@query("markdown_links")
def q_markdown_links(spark, sf_dir):
    blocks = mdf.line_blocks(fx.markdown_docs(spark, sf_dir), "markdown", ["doc_id"])
    spans = mdf.inline_spans(blocks, ["doc_id", "line_no"])
    return spans.filter(F.col("kind") == "link").select("doc_id", "line_no", "span_no", "text", "href")


@query("full_document")
def q_full_document(spark, sf_dir):
    runs = fx.digest_runs(spark, sf_dir)
    return runs.select("id", mdf.full_document("markdown", "trends_raw", "feature_pitch_raw")
                       .alias("document"))


# ---------------------------------------------------------------- assembly (§2.2 B13-B15, §2.5)

def _fresh_ordered(spark, sf_dir):
    return ingest.fresh_items(fx.feed_items(spark, sf_dir), fx.settings(spark),
                              fx.seen_ledger(spark, sf_dir), fx.AS_OF)


def _fixture_sources(spark, sf_dir):
    return (fx.feed_items(spark, sf_dir).select("digest_type", "source_idx", "source_name")
            .distinct())


@query("digest_header")
def q_digest_header(spark, sf_dir):
    runs = fx.digest_runs(spark, sf_dir)
    return runs.select("id", assemble.digest_header("digest_type", "run_date", "source_count",
                                                    "item_count").alias("header"))


@query("org_items_block")
def q_org_items_block(spark, sf_dir):
    return assemble.items_blocks(_fresh_ordered(spark, sf_dir)).filter(F.col("digest_type") == "org")


@query("press_items_block")
def q_press_items_block(spark, sf_dir):
    return assemble.items_blocks(_fresh_ordered(spark, sf_dir)).filter(F.col("digest_type") == "press")


@query("all_items_index")
def q_all_items_index(spark, sf_dir):
    return assemble.all_items_index(_fresh_ordered(spark, sf_dir))


# a small budget, so that the fixture's passes have several chunks
FIXTURE_BUDGET = 5000


@query("items_text")
def q_items_text(spark, sf_dir):
    return assemble.sized_blocks(_fresh_ordered(spark, sf_dir), FIXTURE_BUDGET)


@query("index_text")
def q_index_text(spark, sf_dir):
    return assemble.sized_index(_fresh_ordered(spark, sf_dir), FIXTURE_BUDGET)


FIXTURE_PREFERENCES = "- Prefer items that mention que"


@query("curation_request")
def q_curation_request(spark, sf_dir):
    fresh = _fresh_ordered(spark, sf_dir)
    totals = assemble.pass_totals(_fixture_sources(spark, sf_dir), fresh)
    return assemble.curation_requests(assemble.items_blocks(fresh), totals, "2024-01-05",
                                      FIXTURE_PREFERENCES)


def _finished(spark, sf_dir):
    """The fixture's pass with an answer to each request: the org chunks' are usable, one press chunk's is refused."""
    fresh = _fresh_ordered(spark, sf_dir)
    totals = assemble.pass_totals(_fixture_sources(spark, sf_dir), fresh)
    headers = totals.select("digest_type", assemble.digest_header(
        "digest_type", F.lit("2024-01-05").cast("date"), "source_count", "item_count").alias("header"))
    asked = assemble.items_blocks(fresh).select("digest_type", "chunk_no", "text")
    refused = (F.col("digest_type") == "press") & (F.col("chunk_no") == 0)
    told = asked.select("digest_type", "chunk_no", F.concat(F.lit(" "), "text").alias("body"),
                        F.when(refused, F.lit("refused")).otherwise(F.lit("ok")).alias("outcome"))
    return fresh, assemble.digest_rows(headers, told, totals, "2024-01-05")


@query("digest_rows")
def q_digest_rows(spark, sf_dir):
    """Run rows, a row a chunk, with the digest of the whole run's markdown over those of its chunks."""
    runs = _finished(spark, sf_dir)[1]
    rows = runs.select("digest_type", F.col("run_date").cast("string").alias("run_date"), "chunk_no", "n_chunks", "source_count", "item_count",
                       F.md5(F.regexp_replace("markdown", r"\s+", " ")).alias("markdown_md5"))
    return assemble.with_whole_md5(rows, ["digest_type", "run_date"], "chunk_no", "markdown_md5", "digest_md5")


@query("ledger_after_success")
def q_ledger_after_success(spark, sf_dir):
    fresh, runs = _finished(spark, sf_dir)
    out = ledger.rows_of_finished(fresh, runs, "2024-01-05")
    return out.select("link", "digest_type", F.col("first_seen").cast("string").alias("first_seen"))


def _settled_passes(spark, sf_dir):
    """The folder in which the stream has settled the fixture's passes: two landings, then both streams come to March."""
    requests, answers, totals, items = fx.pass_stream(spark, sf_dir)
    out = shared_folder(spark, "passes")
    q, a = f"{out}/requests", f"{out}/responses"
    for early in (True, False):
        half = lambda df, at: df.filter((F.col(at) < F.lit("2024-01-20").cast("timestamp")) == F.lit(early)).coalesce(2)  # noqa: B023, E731
        half(requests, "asked_at").write.mode("append").parquet(q)
        half(answers, "received_at").write.mode("append").parquet(a)
    passes.heartbeat(spark, q, a, "2024-03-01 00:00:00")
    totals, items = reliable_checkpoint(totals), reliable_checkpoint(items.filter(F.col("link") != "").distinct())
    passes.start_passes(spark, q, a, totals, items, out, f"{out}/state", max_files_per_trigger=3).awaitTermination()
    return out


@query("stream_passes")
def q_stream_passes(spark, sf_dir):
    """Decision of every pass, with the run chunks and ledger rows that its commit made visible."""
    out = _settled_passes(spark, sf_dir)
    runs = passes.committed_runs(spark, out).groupBy(*passes.PASS).agg(F.count(F.lit(1)).alias("n_rows"))
    links = passes.committed_ledger(spark, out).withColumnRenamed("first_seen", "run_date").groupBy(*passes.PASS).agg(F.count(F.lit(1)).alias("n_links"))
    both = passes.commits(spark, out).join(runs, passes.PASS, "left").join(links, passes.PASS, "left")
    return both.select("digest_type", F.col("run_date").cast("string").alias("run_date"), "status", "n_chunks", "n_usable",
                       F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


@query("stream_pass_runs")
def q_stream_pass_runs(spark, sf_dir):
    runs = passes.committed_runs(spark, _settled_passes(spark, sf_dir))
    return runs.select("digest_type", F.col("run_date").cast("string").alias("run_date"), "chunk_no", "n_chunks", "source_count", "item_count",
                       F.md5("markdown").alias("markdown_md5"))


@query("source_status")
def q_source_status(spark, sf_dir):
    accepted = ingest.in_run_dedup(ingest.source_filter(ingest.recency_cutoff(
        ingest.cap_per_source(_staged(spark, sf_dir)), fx.AS_OF)))
    return assemble.source_status(_fixture_sources(spark, sf_dir), accepted)


@query("pass_totals")
def q_pass_totals(spark, sf_dir):
    fresh = ingest.fresh_items(fx.feed_items(spark, sf_dir), fx.settings(spark),
                               fx.seen_ledger(spark, sf_dir), fx.AS_OF, ordered=False)
    return assemble.pass_totals(_fixture_sources(spark, sf_dir), fresh)


# ---------------------------------------------------------------- curation (§2.11)


# The fixture's rule table (terms chosen to occur in the supplied text).
FIXTURE_RULES = [
    {"kind": "prefer", "term": "que", "weight": 2},
    {"kind": "seek", "term": "the", "weight": 1},
    {"kind": "seek", "term": "ung", "weight": 1},
    {"kind": "less", "term": "aux", "weight": -1},
    {"kind": "skip", "term": "zz"},
    {"kind": "skip", "term": "mit"},
    {"kind": "category", "term": "ción", "label": "Spanish", "priority": 1},
    {"kind": "category", "term": "der", "label": "German", "priority": 2},
    {"kind": "category", "term": "les", "label": "French", "priority": 3},
    {"kind": "category", "term": "and", "label": "English", "priority": 4},
]
THREADS_AS_OF = "2024-02-10"


def _scored(spark, sf_dir):
    return curate.score_items(_fresh_ordered(spark, sf_dir), FIXTURE_RULES)


def _picks(spark, sf_dir):
    return curate.top_with_floor(_scored(spark, sf_dir))


@query("rule_score")
def q_rule_score(spark, sf_dir):
    return _scored(spark, sf_dir).select("digest_type", "item_no", "score", "dropped")


@query("top_with_floor")
def q_top_with_floor(spark, sf_dir):
    return _picks(spark, sf_dir).select("digest_type", "pick_rank", "item_no", "score")


@query("categorise")
def q_categorise(spark, sf_dir):
    return curate.category_counts(curate.categorise(_picks(spark, sf_dir), FIXTURE_RULES))


@query("org_groups")
def q_org_groups(spark, sf_dir):
    return curate.org_groups(_picks(spark, sf_dir))


def _rule_table(spark, sf_dir):
    """A rule for each word of the conversations: its kind, weight and priority by its checksum."""
    c = fx.table(spark, sf_dir, "conversations").select(F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("term")).distinct()
    h = F.crc32("term")
    kind = F.element_at(F.array(*[F.lit(k) for k in ("prefer", "seek", "less", "skip", "category")]), (h % 5 + 1).cast("int"))
    return c.select(kind.alias("kind"), "term", F.concat(F.lit("about "), "term").alias("label"), (h % 4 - 1).cast("int").alias("weight"),
                    (h % 1000003).cast("int").alias("priority"))


@query("rules_table_score")
def q_rules_table_score(spark, sf_dir):
    """Score and category of every fresh item by a large rule table."""
    rules = reliable_checkpoint(_rule_table(spark, sf_dir))
    scored = curate.score_by_table(_fresh_ordered(spark, sf_dir), rules)
    return curate.categorise_by_table(scored, rules).select("digest_type", "item_no", "score", "dropped", "category")


def _whole_items(spark, sf_dir):
    return curate.with_whole_text(_fresh_ordered(spark, sf_dir), fx.feed_items(spark, sf_dir))


@query("cross_item_themes")
def q_cross_item_themes(spark, sf_dir):
    out = curate.cross_item_themes(_whole_items(spark, sf_dir))
    return out.select("digest_type", "theme_rank", "term", "n_items", "n_orgs")


@query("run_continuity")
def q_run_continuity(spark, sf_dir):
    return curate.run_continuity(fx.digest_runs(spark, sf_dir))


@query("thread_memory")
def q_thread_memory(spark, sf_dir):
    out = curate.thread_memory(fx.digest_runs(spark, sf_dir), THREADS_AS_OF)
    return out.select("digest_type", "rank", "term", "status", "n_runs",
                      F.col("last_seen").cast("string").alias("last_seen"))


@query("unpitched_themes")
def q_unpitched_themes(spark, sf_dir):
    cand = curate.theme_candidates(_whole_items(spark, sf_dir))
    pitched = curate.terms(fx.digest_runs(spark, sf_dir), "feature_pitch_raw", ["digest_type"])
    return curate.unpitched(cand, pitched).select("digest_type", "term", "n_items", "n_orgs")


def _audit_inputs(spark, sf_dir):
    # links of French items carry a suffix that the generated documents lack
    link = F.when((F.col("author") == "fr") & (F.col("link") != ""), F.concat("link", F.lit("?ref=feed"))).otherwise(F.col("link"))
    items = fx.feed_items(spark, sf_dir).select(
        F.col("source_name").alias("run_id"), "doc_id", "entry_id", link.alias("link"))
    docs = (fx.markdown_docs(spark, sf_dir)
            .join(items.select("doc_id", "run_id"), "doc_id"))
    return items, mdf.any_urls(docs, "markdown", ["run_id"])


@query("index_audit")
def q_index_audit(spark, sf_dir):
    items, urls = _audit_inputs(spark, sf_dir)
    return curate.index_audit(items, urls).select("run_id", "entry_id", "link")


@query("kept_ratio")
def q_kept_ratio(spark, sf_dir):
    items, urls = _audit_inputs(spark, sf_dir)
    return curate.kept_counts(items, urls)


# ---------------------------------------------------------------- run sections (entry 2)


@query("run_sections")
def q_run_sections(spark, sf_dir):
    runs = fx.digest_runs(spark, sf_dir).select("id", "digest_type", "run_date")
    parsed = trends.parse_responses(fx.responses(spark, sf_dir))
    out = trends.attach_sections(runs, parsed.drop("digest_type"))
    return out.select("id", "digest_type", "outcome", "trends_raw", "feature_pitch_raw")
