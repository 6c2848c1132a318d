"""The per-day index kept up to date from each batch of runs.

``facts/run_date=<d>`` has one narrow row per run (id, type, item count);
``days/run_date=<d>`` the day's counts, which are added up from the facts of
that day alone.  An update merges its runs into the facts of the days that it
touches (a run id replaces itself, so a repeated batch changes nothing) and
writes these days only, however late they come.  Reading the index never
touches the history.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedweave.operators import history
from feedweave.session import reliable_checkpoint

FACT = "id bigint, digest_type string, item_count int, created_at timestamp, run_date date"
DAY = "press_runs int, org_runs int, press_items int, org_items int, run_date date"


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)  # a missing table is an empty table


def _write(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_date").parquet(path)


def update(runs: DataFrame, path: str) -> None:
    """Merge runs (``id, run_date, digest_type, item_count, created_at``; of chunked ones any or all rows) into the index.

    Of rows with one id, also within the batch, the one created last counts;
    a run keeps its date.  Facts are written before the days: what a failure
    leaves undone is done by the repeated batch.
    """
    spark = runs.sparkSession
    delta = runs.select("id", "digest_type", "item_count", "created_at", "run_date").filter(F.col("run_date").isNotNull())
    delta = reliable_checkpoint(delta.distinct())
    # calendar days of one batch
    days = [r.run_date for r in delta.select("run_date").distinct().collect()]
    if not days:
        return
    known = _read(spark, f"{path}/facts", FACT).filter(F.col("run_date").isin(days))
    both = known.withColumn("_new", F.lit(0)).unionByName(delta.withColumn("_new", F.lit(1)))
    latest = F.max_by(F.struct("digest_type", "item_count", "created_at"), F.struct("_new", "created_at", "digest_type", "item_count"))
    facts = reliable_checkpoint(both.groupBy("run_date", "id").agg(latest.alias("f")).select("id", "f.*", "run_date"))
    _write(facts, f"{path}/facts")
    _write(history.day_summary(facts), f"{path}/days")


def read(spark: SparkSession, path: str, limit: int = history.INDEX_LIMIT) -> DataFrame:
    """``history.date_index`` of everything merged so far."""
    top = _read(spark, f"{path}/days", DAY).orderBy(F.col("run_date").desc()).limit(limit)
    return top.select(F.col("run_date").cast("string").alias("run_date"), "press_runs", "org_runs", "press_items", "org_items")
