"""Requests joined to their responses in a stream; whole passes stored or given up.

A pass is the requests of one (digest_type, run_date).  The stream of requests
is outer-joined with the stream of responses: a response counts if it comes
within ``answer_within`` of its request, and once the watermark is beyond that
time a request without one comes out alone.  Every request so comes out, and a
pass is decided by the micro-batch in which its last request does:

* ``done``: every request has a usable response.  The run's chunks and the
  ledger rows of the pass's items are written;
* ``given_up``: a response is missing, refused, empty or failed.  Neither is
  written, so its items are offered again.

Each micro-batch first keeps its own answers (``answers/batch_id=<n>``), then
writes the partitions of the passes that it decides, then one commit row for
each (``commits/batch_id=<n>``).  Readers see the runs and ledger rows of
committed passes only, so both appear together or not at all; a repeated batch
overwrites the same folders with the same rows.  Passes are decided on narrow
rows; bodies are only read for the chunks that are written, a row each.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedweave import schemas
from feedweave.functions import responses as rsp
from feedweave.operators import assemble, history
from feedweave.operators.common import sized_broadcast
from feedweave.session import ensure_checkpoint_dir

PASS = ["digest_type", "run_date"]
REQUEST_SCHEMA = "request_id string, digest_type string, run_date date, chunk_no int, n_chunks int, asked_at timestamp"
ANSWER_SCHEMA = T.StructType([T.StructField("request_id", T.StringType())] + schemas.RESPONSE.fields[2:] + [
    T.StructField("received_at", T.TimestampType())])
_KEPT_SCHEMA = "request_id string, digest_type string, chunk_no int, n_chunks int, received_at timestamp, outcome string, body string, run_date date, batch_id long"
_COMMIT_SCHEMA = "digest_type string, run_date date, status string, n_chunks int, n_usable int, batch_id long"


def pass_requests(requests: DataFrame, run_date, asked_at) -> DataFrame:
    """The requests of a daily pass (``assemble.curation_requests``) as rows of the request stream."""
    chunks = requests.groupBy("digest_type").agg(F.count(F.lit(1)).cast("int").alias("n_chunks"))
    return requests.join(sized_broadcast(chunks), "digest_type").select(
        "request_id", "digest_type", F.lit(str(run_date)).cast("date").alias("run_date"), "chunk_no", "n_chunks",
        F.lit(str(asked_at)).cast("timestamp").alias("asked_at"))


def answered_stream(requests: DataFrame, answers: DataFrame, answer_within: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Every request with its response, or with nulls once none can come any more."""
    asked = requests.withWatermark("asked_at", late).alias("q")
    told = answers.withWatermark("received_at", late).alias("a")
    in_time = (F.col("a.received_at") >= F.col("q.asked_at")) & (F.col("a.received_at") <= F.col("q.asked_at") + F.expr(f"INTERVAL {answer_within}"))
    both = asked.join(told, (F.col("q.request_id") == F.col("a.request_id")) & in_time, "left_outer")
    return both.select("q.request_id", "digest_type", "run_date", "chunk_no", "n_chunks", "received_at", "blocks", "stop_reason", "status_code", "connection_error",
                       F.col("a.request_id").isNotNull().alias("answered"))


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)  # a missing table is an empty table


def make_pass_handler(totals: DataFrame, items: DataFrame, out: str):
    """``foreachBatch`` body over ``answered_stream``.

    ``totals``: ``digest_type, run_date, source_count, item_count``; ``items``:
    ``digest_type, run_date, link`` of every pass, fresh ones only.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        body = rsp.response_text("blocks")
        outcome = F.when(F.col("answered"), rsp.triage("body", "stop_reason", "status_code", "connection_error"))
        (batch.filter(F.col("digest_type").isNotNull()).withColumn("body", body)
         .select("request_id", "digest_type", "chunk_no", "n_chunks", "received_at", outcome.alias("outcome"), "body", "run_date")
         .write.mode("overwrite").partitionBy("run_date").parquet(f"{out}/answers/batch_id={batch_id}"))

        kept = _read(spark, f"{out}/answers", _KEPT_SCHEMA).filter(F.col("batch_id") <= batch_id)
        # passes that this batch touches: a few types times a few days
        touched = kept.filter(F.col("batch_id") == batch_id).select(*PASS).distinct()
        known = _read(spark, f"{out}/commits", _COMMIT_SCHEMA).filter(F.col("batch_id") < batch_id).select(*PASS)
        touched = touched.join(known, PASS, "left_anti")
        days = [r.run_date for r in touched.select("run_date").distinct().collect()]
        if not days:
            return
        # a request that was answered again counts by its first answer
        of_passes = kept.filter(F.col("run_date").isin(days)).join(F.broadcast(touched), PASS, "left_semi")
        first = of_passes.groupBy(*PASS, "chunk_no").agg(
            F.max("n_chunks").alias("n_chunks"), F.min_by(F.struct("batch_id", "received_at", "request_id", "outcome"), F.struct("received_at", "batch_id")).alias("first"))
        decided = (first.groupBy(*PASS).agg(
            F.max("n_chunks").alias("n_chunks"), F.count(F.lit(1)).cast("int").alias("n_known"),
            F.count_if(assemble.usable_outcome("first.outcome")).cast("int").alias("n_usable"))
            .filter("n_known = n_chunks").drop("n_known")
            .withColumn("status", F.when(F.col("n_usable") == F.col("n_chunks"), F.lit("done")).otherwise(F.lit("given_up"))))
        found = decided.collect()  # a row a pass
        if not found:
            return
        decided = spark.createDataFrame(found, decided.schema)
        done = decided.filter("status = 'done'").join(totals, PASS).withColumn(
            "header", assemble.digest_header("digest_type", "run_date", "source_count", "item_count"))
        done = history.with_run_ids(done, 0, "1970-01-01").withColumn("created_at", F.to_timestamp("run_date"))

        picked = first.select(*PASS, "chunk_no", "first.batch_id", "first.received_at", "first.request_id")
        chunks = (of_passes.select(*PASS, "chunk_no", "batch_id", "received_at", "request_id", "body")
                  .join(picked, [*PASS, "chunk_no", "batch_id", "received_at", "request_id"])
                  .join(F.broadcast(done.drop("n_usable", "status")), PASS).dropDuplicates([*PASS, "chunk_no"]))
        texts = assemble.digest_chunks(chunks, [*PASS, "id", "created_at", "n_chunks", "source_count", "item_count"])
        history.append_runs(texts, f"{out}/runs")
        links = (items.join(F.broadcast(done.select(*PASS)), PASS, "left_semi").filter(F.col("link") != "")
                 .select("link", "digest_type", F.col("run_date").alias("first_seen")).distinct())
        (links.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("first_seen", "digest_type").parquet(f"{out}/ledger"))
        decided.select("digest_type", "run_date", "status", "n_chunks", "n_usable").coalesce(1).write.mode("overwrite").parquet(
            f"{out}/commits/batch_id={batch_id}")
    return handle


def start_passes(spark: SparkSession, requests_path: str, answers_path: str, totals: DataFrame, items: DataFrame, out: str,
                 checkpoint_location: str, answer_within: str = "6 hours", late: str = "1 hour", max_files_per_trigger: int | None = None):
    """Join what has landed since the last call (Parquet files) and settle the passes that it decides."""
    ensure_checkpoint_dir(spark)

    def stream(path: str, schema) -> DataFrame:
        reader = spark.readStream.schema(schema)
        return (reader.option("maxFilesPerTrigger", max_files_per_trigger) if max_files_per_trigger else reader).parquet(path)

    joined = answered_stream(stream(requests_path, REQUEST_SCHEMA), stream(answers_path, ANSWER_SCHEMA), answer_within, late)
    return (joined.writeStream.foreachBatch(make_pass_handler(totals, items, out)).outputMode("append")
            .option("checkpointLocation", checkpoint_location).trigger(availableNow=True).start())


def heartbeat(spark: SparkSession, requests_path: str, answers_path: str, at) -> None:
    """A request and a response that belong to no pass: both streams have come to the time ``at``."""
    time = F.lit(str(at)).cast("timestamp")
    one = spark.range(1).coalesce(1)
    schema = spark.createDataFrame([], REQUEST_SCHEMA).schema
    for path, fields, when in ((requests_path, schema, "asked_at"), (answers_path, ANSWER_SCHEMA, "received_at")):
        rid = "heartbeat-request" if when == "asked_at" else "heartbeat-response"
        one.select(*((F.lit(rid) if f.name == "request_id" else time if f.name == when else F.lit(None)).cast(f.dataType).alias(f.name)
                     for f in fields.fields)).write.mode("append").parquet(path)


def commits(spark: SparkSession, out: str) -> DataFrame:
    """``digest_type, run_date, status, n_chunks, n_usable`` of every decided pass."""
    return _read(spark, f"{out}/commits", _COMMIT_SCHEMA).drop("batch_id")


def _done(spark: SparkSession, out: str) -> DataFrame:
    return sized_broadcast(commits(spark, out).filter("status = 'done'").select(*PASS))


def committed_runs(spark: SparkSession, out: str) -> DataFrame:
    """Run rows (one a chunk) of the passes that are done."""
    return history.read_runs(spark, f"{out}/runs").join(_done(spark, out), PASS, "left_semi")


def committed_ledger(spark: SparkSession, out: str) -> DataFrame:
    """Ledger rows of the passes that are done."""
    rows = _read(spark, f"{out}/ledger", "link string, first_seen date, digest_type string")
    return rows.join(_done(spark, out).withColumnRenamed("run_date", "first_seen"), ["digest_type", "first_seen"], "left_semi").select("link", "digest_type", "first_seen")
