"""Incremental runs with Structured Streaming (L1-L3).

Landed feed files arrive under
``<landing>/run_date=<d>/digest_type=<t>/source_idx=<i>/<file>``.  A file
stream with ``trigger(availableNow=True)`` hands each micro-batch to
``foreachBatch``, which runs the *same* batch functions as the daily job:

* a run is all files landed for its date, however many micro-batches they come
  in: every run date of the batch is computed from all of them, so the gate and
  the in-run dedup see whole runs (``max_files_per_trigger`` changes no result);
* dates go in order, because a day's ledger depends on what earlier days
  accepted; of the days after a late one, those are computed again before which,
  within the retention, a day's accepted links have changed: where the change
  dies out, later days stay as they are;
* ledger rows and run totals are written to ``.../run_date=<d>`` in overwrite
  mode, so re-executing a batch (after a failure) rewrites the same directories:
  exactly-once output;
* the ledger a run sees holds the days before it only, so a replay reads the
  same state as the first attempt.

The stream's own progress lives in ``checkpointLocation`` (a shared directory
on a cluster).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

from feedweave import schemas
from feedweave.operators import assemble, ingest, ledger
from feedweave.session import reliable_checkpoint
from feedweave.sources import feeds

LANDING_SCHEMA = T.StructType([
    T.StructField("value", T.StringType()),
    T.StructField("run_date", T.DateType()),
    T.StructField("digest_type", T.StringType()),
    T.StructField("source_idx", T.IntegerType()),
])

LEDGER_SCHEMA = T.StructType([
    T.StructField("link", T.StringType()),
    T.StructField("digest_type", T.StringType()),
    T.StructField("first_seen", T.DateType()),
    T.StructField("run_date", T.DateType()),
])


def _read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)  # a missing table is an empty table


def ledger_before(spark: SparkSession, ledger_path: str, run_date, dedup_days: int = 7) -> DataFrame:
    """Ledger state seen by the run of ``run_date``: what earlier days wrote.

    ``run_date`` equals ``first_seen``, so its bounds prune the partitions that
    are read to the days that can suppress anything.
    """
    book = _read_or_empty(spark, ledger_path, LEDGER_SCHEMA)
    d = F.lit(str(run_date)).cast("date")
    return book.filter((F.col("run_date") >= F.date_sub(d, dedup_days)) & (F.col("run_date") < d)).select(
        "link", "digest_type", "first_seen")


def process_run(spark: SparkSession, entries: DataFrame, sources: DataFrame, settings: DataFrame,
                ledger_path: str, runs_path: str, run_date, dedup_days: int = 7) -> bool:
    """One daily run: fresh items -> its ledger rows (L2) and run totals (L3).

    Returns whether its ledger rows differ from those that were there.
    """
    as_of = f"{run_date} 00:00:00"
    book = ledger_before(spark, ledger_path, run_date, dedup_days)
    fresh = ingest.fresh_items(entries, settings, book, as_of, dedup_days, ordered=False)
    rows = reliable_checkpoint(ledger.rows_of_finished(fresh, fresh, as_of).select("link", "digest_type", "first_seen"))
    there = _read_or_empty(spark, ledger_path, LEDGER_SCHEMA).filter(F.col("run_date") == F.lit(str(run_date)).cast("date"))
    key = ["digest_type", "link"]
    changed = not (rows.join(there, key, "left_anti").isEmpty() and there.join(rows, key, "left_anti").isEmpty())
    rows.write.mode("overwrite").parquet(
        f"{ledger_path}/run_date={run_date}")
    totals = assemble.pass_totals(sources, fresh, settings)
    totals.write.mode("overwrite").parquet(f"{runs_path}/run_date={run_date}")
    return changed


RUNS_SCHEMA = T.StructType([T.StructField("digest_type", T.StringType()), T.StructField("run_date", T.DateType())])


def make_batch_handler(sources: DataFrame, settings: DataFrame, ledger_path: str,
                       runs_path: str, dedup_days: int = 7, landing_dir: str | None = None):
    """``foreachBatch`` body: every run date of the micro-batch, and computed later ones that it changes, in order.

    With ``landing_dir``, a run's entries are all files landed for its date;
    without, those of the micro-batch.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        # run dates are calendar days: a handful in one micro-batch
        came = {r.run_date for r in batch.select("run_date").distinct().collect()}
        dates = set(came)
        landed = batch
        if landing_dir and dates:
            landed = _landed(spark.read.schema(LANDING_SCHEMA).option("wholetext", True).format("text").load(landing_dir))
            known = _read_or_empty(spark, runs_path, RUNS_SCHEMA).select("run_date").distinct()
            dates |= {r.run_date for r in known.filter(F.col("run_date") > F.lit(min(dates))).collect()}
        last_change = None
        for d in sorted(dates):
            if d not in came and (last_change is None or (d - last_change).days > dedup_days):
                continue  # sees the ledger that it has seen
            docs = landed.filter(F.col("run_date") == F.lit(str(d)).cast("date"))
            if process_run(spark, feeds.feed_entries(docs, sources), sources, settings, ledger_path, runs_path, d, dedup_days):
                last_change = d
    return handle


def _landed(files: DataFrame) -> DataFrame:
    return files.select("*", F.col("_metadata.file_path").alias("path"))


def start_incremental(spark: SparkSession, landing_dir: str, sources: DataFrame,
                      settings: DataFrame, ledger_path: str, runs_path: str,
                      checkpoint_location: str, dedup_days: int = 7,
                      max_files_per_trigger: int | None = None):
    """Start the incremental ingest (L1) over everything landed so far (``availableNow``)."""
    reader = spark.readStream.schema(LANDING_SCHEMA).option("wholetext", True)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.format("text").load(landing_dir)
    return (_landed(stream).writeStream
            .foreachBatch(make_batch_handler(sources, settings, ledger_path, runs_path, dedup_days, landing_dir))
            .option("checkpointLocation", checkpoint_location)
            .trigger(availableNow=True)
            .start())


def accepted_sightings(spark: SparkSession, ledger_path: str) -> DataFrame:
    """Ledger rows written by the stream, as ``(digest_type, link, run_date)``."""
    book = _read_or_empty(spark, ledger_path, LEDGER_SCHEMA)
    return book.select("digest_type", "link", F.col("first_seen").alias("run_date"))


# ---------------------------------------------------------------- responses (L3)

RESPONSE_SCHEMA = T.StructType(schemas.RESPONSE.fields + [
    T.StructField("received_at", T.TimestampType())])

MEMORY_LOG_SCHEMA = T.StructType(schemas.DIGEST_MEMORY.fields + [
    T.StructField("batch_id", T.LongType())])


def make_response_handler(sections_path: str, memory_path: str):
    """``foreachBatch`` body: parse responses, write run sections and memory revisions."""
    from feedweave.operators import trends

    def handle(batch: DataFrame, batch_id: int) -> None:
        parsed = trends.parse_responses(batch, carry=("received_at",))
        (parsed.select("request_id", "digest_type", "outcome", "trends_raw", "feature_pitch_raw")
         .write.mode("overwrite").parquet(f"{sections_path}/batch_id={batch_id}"))
        revisions = trends.memory_revisions(parsed, F.col("received_at"))
        revisions.write.mode("overwrite").parquet(f"{memory_path}/batch_id={batch_id}")
    return handle


def start_responses_incremental(spark: SparkSession, responses_dir: str, sections_path: str,
                                memory_path: str, checkpoint_location: str):
    """Incremental parse of landed response files (JSON lines) (L3)."""
    stream = spark.readStream.schema(RESPONSE_SCHEMA).json(responses_dir)
    return (stream.writeStream
            .foreachBatch(make_response_handler(sections_path, memory_path))
            .option("checkpointLocation", checkpoint_location)
            .trigger(availableNow=True)
            .start())


def current_memory(spark: SparkSession, memory_path: str) -> DataFrame:
    """Latest memory per type from the revisions written so far."""
    from feedweave.operators import history
    return history.memory_latest(_read_or_empty(spark, memory_path, MEMORY_LOG_SCHEMA))
