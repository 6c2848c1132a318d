"""Responses of the comparison step -> run sections and memory revisions.

A comparison response either yields both visible sections (``''`` when a
section is missing) and optionally a memory revision, or it fails; a failed or
missing response leaves both sections NULL on the run.  Runs are never lost:
sections attach through a left join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedweave.functions import responses as rsp

USABLE = ("ok", "truncated")


def parse_responses(responses: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per response: outcome, memory revision and the two sections (I1-I3, I8, I9), and the columns in ``carry``."""
    body = rsp.response_text("blocks")
    with_body = responses.withColumn("_body", body)
    outcome = rsp.triage("_body", "stop_reason", "status_code", "connection_error")
    vis = rsp.visible_body("_body")
    return with_body.select(
        "request_id", "digest_type", outcome.alias("outcome"),
        rsp.memory_block("_body").alias("memory"),
        rsp.named_section(vis, rsp.TRENDS_HEADING).alias("trends_raw"),
        rsp.named_section(vis, rsp.PITCH_HEADING).alias("feature_pitch_raw"), *carry)


def attach_sections(runs: DataFrame, parsed: DataFrame, run_key: str = "id") -> DataFrame:
    """Runs with ``trends_raw`` / ``feature_pitch_raw`` from usable responses, else NULL."""
    ok = parsed.filter(F.col("outcome").isin(*USABLE)).select(
        F.col("request_id").alias(run_key), "trends_raw", "feature_pitch_raw")
    base = runs.drop("trends_raw", "feature_pitch_raw")
    out = base.join(ok, run_key, "left")
    resp = parsed.select(F.col("request_id").alias(run_key), "outcome")
    return out.join(resp, run_key, "left")


def memory_revisions(parsed: DataFrame, updated_at) -> DataFrame:
    """Memory log rows from usable responses whose fence closed (J4 input)."""
    return (parsed.filter(F.col("outcome").isin(*USABLE) & F.col("memory").isNotNull())
            .select("digest_type", "request_id", "memory", updated_at.alias("updated_at")))
