"""Small literal fixtures shared by the tests."""

from __future__ import annotations

import datetime as dt

from feedweave import schemas

ENTRY_SCHEMA = schemas.ENTRY

AS_OF = "2024-01-05 00:00:00"
FRESH = dt.datetime(2024, 1, 4, 12, 0, 0)
STALE = dt.datetime(2023, 12, 1, 0, 0, 0)


def entry(digest_type="org", source_idx=0, pos=0, link="", entry_id="", title="t",
          summary="s", pub_ts=FRESH, source_filter=None, author=""):
    return (digest_type, source_idx, pos, f"org{source_idx}", "cat", f"src{source_idx}",
            source_filter or [], link, entry_id, title, summary, None, author, pub_ts)


def entries_df(spark, rows):
    return spark.createDataFrame(rows, ENTRY_SCHEMA)


def settings_df(spark, cap=20, min_items=1, days_back=2):
    from feedweave.sources.fixtures import SETTINGS_SCHEMA
    return spark.createDataFrame([("org", days_back, cap, min_items, "m", 7),
                                  ("press", days_back, cap, min_items, "m", 7)], SETTINGS_SCHEMA)


def ledger_df(spark, rows):
    return spark.createDataFrame(rows, "link string, digest_type string, first_seen date")
