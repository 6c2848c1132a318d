"""Exact dedup by a stateful stream over digests, with the bytes compared on hits.

Each row's text is normalised and hashed where it is read; digest, id and the
place of the content (file and row) go to the shared folder, not the text. A
stream reads them (all that is there now, or a number of files a trigger) into
keyed state on disk (RocksDB) without expiry: digest -> the smallest id, where
its content lies, and how many rows had it. The aggregation combines before
its shuffle, so copies of one text are a row a task, however many they are.

A hit means equal digests. The texts themselves are then compared: grouped by
digest and whole text, again combined before the shuffle. A digest with more
than one text is told apart by its texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedweave.llm.batches import broadcast_if_small, shared_dir, unused, written

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: The state's keyed store is on disk; a small store must not reserve megabytes there.
_STATE = {"spark.sql.streaming.stateStore.providerClass": _ROCKS, "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false"}


def normalised(text: Column) -> Column:
    """Runs of space and 0x09-0x0D become one space; null is empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def stream_state(spark: SparkSession, staged: str, schema, files_per_trigger: int | None = None, checkpoint: str | None = None) -> DataFrame:
    """digest, keeper (struct of the row that stays) and n, after the stream has read the staged folder.

    With a checkpoint folder of an earlier call, only files that are new since are read and the state goes on.
    """
    checkpoint = checkpoint or shared_dir(spark, "dedup-state")
    updates = f"{checkpoint}/updates"
    before = {k: spark.conf.get(k, None) for k in _STATE}
    for k, v in _STATE.items():
        spark.conf.set(k, v)
    try:
        reader = spark.readStream.schema(schema)
        if files_per_trigger:
            reader = reader.option("maxFilesPerTrigger", files_per_trigger)
        keyed = reader.parquet(staged).groupBy("digest").agg(F.min("place").alias("keeper"), F.count(F.lit(1)).alias("n"))
        # a repeated batch overwrites its own folder: at least once becomes exactly once
        query = keyed.writeStream.outputMode("update").option("checkpointLocation", f"{checkpoint}/query").trigger(availableNow=True).foreachBatch(
            lambda df, batch: df.write.mode("overwrite").parquet(f"{updates}/batch={batch}")).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    # the last update of a digest is the one that has counted most rows
    return spark.read.parquet(updates).groupBy("digest").agg(F.max_by("keeper", "n").alias("keeper"), F.max("n").alias("n"))


def dedup_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_bytes: int = 32, files_per_trigger: int | None = None) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256, keep_file (where the kept content lies).

    Of rows with equal normalised text, the one with the smallest id stays;
    null ids come last (a group of null ids has a null keep_id), and of rows
    that repeat an id, one stays. Null text equals empty text. Other columns
    are not read. An empty table gives an empty result. ``digest_bytes``
    shortens the digest that keys the state; results don't depend on it.
    """
    spark = docs.sparkSession
    norm = normalised(F.col(text_col))
    base = docs.select(F.col(id_col).alias("id"), F.unhex(F.sha2(norm, 256)).alias("sha"))
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", F.monotonically_increasing_id().alias("row"), F.input_file_name().alias("file")).alias("place")
    cut = F.col("sha") if digest_bytes >= 32 else F.expr(f"substring(sha, 1, {int(digest_bytes)})")
    staged_path = shared_dir(spark, "dedup-digests")
    base.select("sha", cut.alias("digest"), place).write.parquet(staged_path)
    staged = spark.read.parquet(staged_path)
    if not spark.read.parquet(staged_path).head(1):
        return _result(staged.withColumns({"keeper": F.col("place"), "n": F.lit(0).cast("long")}), id_col)
    state = stream_state(spark, staged_path, staged.schema, files_per_trigger)

    # the whole texts of equal digests, byte by byte
    texts = docs.select(F.unhex(F.sha2(norm, 256)).alias("sha"), norm.alias("text")).select(cut.alias("digest"), "text").groupBy("digest", "text").count()
    mixed = written(texts.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("digest"), "dedup-mixed")
    if mixed.isEmpty():
        return _result(staged.join(state, "digest"), id_col)
    told = written(docs.select(F.col(id_col).alias("id"), norm.alias("text")).withColumn("sha", F.unhex(F.sha2("text", 256))).withColumn("digest", cut).withColumn("place", place).join(mixed, "digest", "left_semi"), "dedup-told")
    apart = told.groupBy("digest", "text").agg(F.min("place").alias("keeper"), F.count(F.lit(1)).alias("n"))
    by_text = told.join(apart, ["digest", "text"]).select("digest", "sha", "place", "keeper", "n")
    return _result(staged.join(mixed, "digest", "left_anti").join(state, "digest").select("digest", "sha", "place", "keeper", "n").unionByName(by_text), id_col)


def _result(rows: DataFrame, id_col: str) -> DataFrame:
    return rows.select(F.col("place.id").alias(id_col), F.col("keeper.id").alias("keep_id"), F.col("n").alias("group_size"),
                       (F.col("place.row") == F.col("keeper.row")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"), F.col("keeper.file").alias("keep_file"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    found = written(dedup_exact(docs, id_col, text_col), "exact")
    goes = found.where("not kept")
    text_sha, goes_sha, goes_id = (unused(docs, x) for x in ("__text_sha", "__sha", "__id"))
    own, sha = F.col(id_col).alias(goes_id), F.col("text_sha256").alias(goes_sha)
    marked = docs.withColumn(text_sha, F.sha2(normalised(F.col(text_col)), 256))
    same = F.col(id_col).eqNullSafe(F.col(goes_id)) & (F.col(text_sha) == F.col(goes_sha))
    others = goes.where(~F.col(id_col).eqNullSafe(F.col("keep_id"))).select(own, sha).distinct()
    left = marked.join(broadcast_if_small(others), same, "left_anti")
    if not goes.where(F.col(id_col).eqNullSafe(F.col("keep_id"))).isEmpty():
        # rows that repeat an id and its text
        left = left.dropDuplicates([id_col, text_sha])
    return left.drop(text_sha)
