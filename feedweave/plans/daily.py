"""The daily job as one lazy plan per output, for every digest type at once.

``daily_pass`` wires the sources, ingest, ledger and assembly operators the way
the scheduled job uses them: prune-on-read ledger, fresh items, run totals behind
the gate, headers and curation requests; ``finish_pass`` takes the responses and
gives the run rows and the ledger rows to append.  Nothing
is collected; each output is a DataFrame the caller writes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedweave.functions import responses as rsp
from feedweave.operators import assemble, ingest, ledger
from feedweave.sources import catalogue, feeds


@dataclass
class DailyPass:
    fresh: DataFrame          # ordered articles (item_no per type)
    totals: DataFrame         # source_count / item_count per written run
    headers: DataFrame        # digest header per written run
    requests: DataFrame       # curation request text per (type, chunk)
    as_of: str


@dataclass
class FinishedPass:
    runs: DataFrame           # run rows (header + bodies) of the types that have a digest
    ledger_rows: DataFrame    # links to record: only of those types


def daily_pass(entries: DataFrame, sources: DataFrame, settings: DataFrame, book: DataFrame,
               as_of, preferences: str = "") -> DailyPass:
    """One run of every digest type on ``as_of`` (UTC ``YYYY-MM-DD HH:MM:SS``).

    ``sources``: catalogue rows with a feed URL (disabled ones included; they
    count towards ``source_count``).  ``book``: the ledger log, pruned on read.
    """
    configured = settings.agg(F.max("dedup_days")).first()[0]
    dedup_days = 7 if configured is None else configured  # a configured 0 stays 0
    fresh = ingest.fresh_items(entries, settings, book, as_of, dedup_days)
    totals = assemble.pass_totals(sources, fresh, settings)
    run_date = str(as_of)[:10]
    headers = totals.select(
        "digest_type",
        assemble.digest_header("digest_type", F.lit(run_date).cast("date"), "source_count",
                               "item_count").alias("header"))
    requests = assemble.curation_requests(assemble.sized_blocks(fresh), totals, run_date,
                                          preferences)
    return DailyPass(fresh, totals, headers, requests, str(as_of))


def finish_pass(done: DailyPass, responses: DataFrame) -> FinishedPass:
    """Digests and ledger rows once the responses are there: all or nothing per type.

    ``responses``: ``request_id, blocks, stop_reason, status_code,
    connection_error``.  A type whose requests lack a usable response stores
    neither run nor links, so its items come again with the next pass.
    """
    body = responses.withColumn("body", rsp.response_text("blocks"))
    told = body.select("request_id", "body", rsp.triage(
        "body", "stop_reason", "status_code", "connection_error").alias("outcome"))
    asked = done.requests.select("request_id", "digest_type", "chunk_no").join(told, "request_id", "left")
    runs = assemble.digest_rows(done.headers, asked, done.totals, done.as_of)
    return FinishedPass(runs, ledger.rows_of_finished(done.fresh, runs, done.as_of))


def daily_pass_from_files(spark: SparkSession, catalogue_path: str | list[str], settings_path: str,
                          landing_dir: str, book: DataFrame, as_of,
                          preferences_path: str | None = None) -> DailyPass:
    """``daily_pass`` reading configuration files and landed feeds.

    ``catalogue_path``: one or more files, each named ``<type>_sources.json`` or
    in a folder named after its type.
    """
    active = catalogue.with_source_defaults(
        catalogue.active_sources(catalogue.read_catalogue(spark, catalogue_path)))
    settings = catalogue.read_settings(spark, settings_path)
    prefs = catalogue.read_preferences(spark, preferences_path) if preferences_path else ""
    entries = feeds.feed_entries(feeds.read_landed(spark, landing_dir),
                                 catalogue.fetchable_sources(active))
    return daily_pass(entries, active, settings, book, as_of, prefs)
