"""The link ledger as keyed state of a stream.

Sightings ``(digest_type, link, run_date)`` are files of a parquet log.  For
each (type, link), state on disk (RocksDB) holds the date that it was last
accepted and the dates that are not closed yet.  A day is closed when the
watermark reaches it: ``late_days`` after it, a sighting of a newer day has
come.  A closed date is accepted if nothing is held, or if the date held is
more than ``dedup_days`` before it, so the order of files within the open days
changes nothing, and no micro-batch reads the ledger again.

State is bounded: timers fold a key's dates as they close and remove the key
once ``first_seen + dedup_days`` is closed.  Sightings that come after their
day was closed are dropped by the watermark and counted in the query's
progress; ``ledger.refold`` works them into the accepted log.

Quiet days: ``heartbeat`` rows have no link and only move the watermark on.
"""

from __future__ import annotations

import datetime as dt
import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from feedweave.operators import ledger
from feedweave.session import ensure_checkpoint_dir

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SIGHTING_SCHEMA = "digest_type string, link string, run_date date"
_DAY_MS = 86_400_000

# Python workers get this module's processor with the query: they need not have the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class LedgerProcessor(StatefulProcessor):
    """Accepts a key's closed dates; dates are days since 1970-01-01."""

    def __init__(self, dedup_days: int):
        self.dedup_days = dedup_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "day int")
        self.opened = handle.getValueState("opened", "days array<int>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        if key[1] is None:  # a heartbeat
            return
        days = {r.day for r in rows}
        if self.opened.exists():
            days.update(self.opened.get()[0])
        yield from self._settled(key, days, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        days = set(self.opened.get()[0]) if self.opened.exists() else set()
        yield from self._settled(key, days, timerValues)

    def _settled(self, key, days: set[int], timerValues) -> Iterator[Row]:
        closed = timerValues.getCurrentWatermarkInMs() // _DAY_MS
        held = self.held.get()[0] if self.held.exists() else None
        for day in sorted(d for d in days if d <= closed):
            if held is None or day > held + self.dedup_days:
                held = day
                yield Row(digest_type=key[0], link=key[1], run_date=dt.date(1970, 1, 1) + dt.timedelta(day))
        opened = sorted(d for d in days if d > closed)
        if opened:
            self.opened.update((opened,))
            self.handle.registerTimer(opened[0] * _DAY_MS)
        else:
            self.opened.clear()
        # once the last day that it suppresses is closed, a date has no effect
        if held is None or held + self.dedup_days <= closed:
            self.held.clear()
        else:
            self.held.update((held,))
            self.handle.registerTimer((held + self.dedup_days) * _DAY_MS)

    def close(self) -> None:
        pass


def accepted_stream(sightings: DataFrame, dedup_days: int = 7, late_days: int = 1) -> DataFrame:
    """Accepted sightings of a stream of ``(digest_type, link, run_date)``, each when its day closes.

    A day is open until a row of ``late_days`` days after it has come: with 1, a
    day's files come in any order, but before those of the next day.  Empty
    links are not sightings; rows without a link are heartbeats.
    """
    timed = sightings.withColumn("at", F.col("run_date").cast("timestamp")).withWatermark("at", f"{late_days} days")
    # heartbeats go on to the processor: a filter on them would be applied before the watermark sees them
    days = timed.where("link IS NULL OR link <> ''").withColumn("day", F.unix_date("run_date"))
    return days.groupBy("digest_type", "link").transformWithState(LedgerProcessor(dedup_days), SIGHTING_SCHEMA, "append", "EventTime")


def start_ledger_stream(spark: SparkSession, sightings_path: str, accepted_path: str, checkpoint_location: str,
                        dedup_days: int = 7, late_days: int = 1, max_files_per_trigger: int | None = None):
    """Run the ledger over the sightings landed since the last call; accepted ones go to ``accepted_path/run_date=<d>``.

    A day closes in one micro-batch, which writes the whole day: a repeated
    batch overwrites the same days with the same rows.  The state goes on from
    ``checkpoint_location``.
    """
    ensure_checkpoint_dir(spark)
    reader = spark.readStream.schema(SIGHTING_SCHEMA).option("recursiveFileLookup", "true")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    accepted = accepted_stream(reader.parquet(sightings_path), dedup_days, late_days)

    def write(batch: DataFrame, batch_id: int) -> None:
        (batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("run_date").parquet(accepted_path))

    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    try:
        return (accepted.writeStream.foreachBatch(write).outputMode("append")
                .option("checkpointLocation", checkpoint_location).trigger(availableNow=True).start())
    finally:
        if before is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def read_accepted(spark: SparkSession, accepted_path: str) -> DataFrame:
    return spark.read.schema(SIGHTING_SCHEMA).parquet(accepted_path)


def absorb_late(spark: SparkSession, sightings_path: str, accepted_path: str, late: DataFrame, dedup_days: int = 7) -> list[dt.date]:
    """Work sightings of closed days, which the log has and the stream dropped, into the accepted log (L1).

    Only the links of ``late`` are folded again, and only the days on which
    something changes are written; returns those days.
    """
    log = spark.read.schema(SIGHTING_SCHEMA).parquet(sightings_path).where("link IS NOT NULL AND link <> ''")
    accepted = read_accepted(spark, accepted_path)
    late = late.where("link IS NOT NULL AND link <> ''").select(*ledger.ACCEPTED_COLUMNS)
    return ledger.rewrite_changed(accepted, ledger.refold(log, accepted, late, dedup_days), accepted_path)


def land(sightings: DataFrame, path: str) -> None:
    """Append sightings to the log."""
    sightings.select("digest_type", "link", "run_date").write.mode("append").parquet(path)


def heartbeat(spark: SparkSession, path: str, run_date: dt.date) -> None:
    """A row without a link: ``run_date`` has begun, whether or not it has sightings."""
    land(spark.range(1).select(F.lit(None).cast("string").alias("digest_type"), F.lit(None).cast("string").alias("link"), F.lit(run_date).alias("run_date")).coalesce(1), path)


def late_rows(query) -> int:
    """Sightings that came after their day was closed, over the query's micro-batches that are still reported."""
    return sum(op.numRowsDroppedByWatermark for p in query.recentProgress for op in p.stateOperators)


def state_rows(query) -> int:
    """Keys in state after the last micro-batch."""
    done = [p for p in query.recentProgress if p.stateOperators]
    return sum(op.numRowsTotal for op in done[-1].stateOperators) if done else 0
