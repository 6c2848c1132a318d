"""Arrow batches in tasks: bounded slices, and texts as bytes or strings with nulls as empty."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 4 << 20


def slices(batches: Iterator[pa.RecordBatch], text: int = 1, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose text column (by position) holds about ``limit`` bytes.

    A longer single text is a batch of its own: rows are never cut.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        total = pc.cumulative_sum(pc.cast(pc.fill_null(pc.binary_length(batch.column(text)), 0), pa.int64())).to_numpy()
        at = 0
        while at < batch.num_rows:
            before = int(total[at - 1]) if at else 0
            to = max(at + 1, int(total.searchsorted(before + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null is empty."""
    return [x or b"" for x in pc.cast(column, pa.binary()).to_pylist()]


def as_str(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder path in the shared folder that the cluster names in spark.checkpoint.dir."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Frees the shuffle files of an execution when it has ended.
_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read back: later reads survive lost executors and cut the lineage. What was shuffled for it is freed."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    before = spark.conf.get(_FREED)
    spark.conf.set(_FREED, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_FREED, before)
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """name, made longer until no column of df is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Rows (of a few numbers) that may be broadcast.
BROADCAST_ROWS = 1 << 20


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A narrow table, marked for broadcast if a count shows that it has at most ``rows`` rows; a join with a larger one is shuffled."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
