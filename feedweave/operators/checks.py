"""Rules of the stored tables, counted by the write itself.

Not-null and allowed-value rules are observed on the rows as they are written
(``Observation``).  Unique keys are observed on a second branch of the same
job, over the key columns only: counts are combined before the shuffle, so a
key that a third of the rows share is one row a task, and no text is moved.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rules:
    required: tuple[str, ...]
    key: tuple[str, ...]
    types: tuple[str, ...] = ("press", "org")


# The tables' required columns, allowed types and keys.
RULES = {
    "runs": Rules(("run_date", "digest_type", "source_count", "item_count", "markdown", "created_at"), ("id",)),
    "run_chunks": Rules(("run_date", "digest_type", "source_count", "item_count", "markdown", "created_at", "chunk_no"), ("id", "chunk_no")),
    "ledger": Rules(("link", "digest_type", "first_seen"), ("link", "digest_type")),
    "memory": Rules(("digest_type", "memory", "updated_at"), ("digest_type",)),
}


def write_checked(rows: DataFrame, table: str, write: Callable[[DataFrame], None]) -> list[tuple[str, str, int]]:
    """Write rows and return ``(table, rule, violations)`` for every rule of the table.

    ``write`` gets the frame to write and must run one action on it.  Of rows
    that share a key (nulls are equal), all but one are violations.
    """
    rules = RULES[table]
    seen, keyed = Observation(), Observation()
    observed = rows.observe(
        seen, *(F.count_if(F.col(c).isNull()).alias(f"not_null_{c}") for c in rules.required),
        F.count_if(~F.col("digest_type").isin(*rules.types)).alias("type_check"))
    counts = rows.groupBy(*rules.key).agg(F.count(F.lit(1)).alias("_fw_n"))
    counts = counts.observe(keyed, F.coalesce(F.sum(F.col("_fw_n") - 1), F.lit(0)).alias("excess"))
    # contributes no rows to the write: every count is positive
    nothing = counts.filter("_fw_n < 0").select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema.fields))
    write(observed.unionByName(nothing))
    found = {**seen.get, f"unique_{'_'.join(rules.key)}": keyed.get["excess"]}
    return [(table, rule, int(n)) for rule, n in found.items()]


def report(spark, found: list[tuple[str, str, int]]) -> DataFrame:
    """``table, rule, violations`` of several writes."""
    return spark.createDataFrame(found, "table string, rule string, violations bigint")
