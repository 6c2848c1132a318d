"""Cross-run link ledger: expiring "seen" set per digest type.

Semantics: a link accepted on day *d* is recorded with ``first_seen = d``;
re-sightings do not refresh it; the row is dropped once
``first_seen < today - dedup_days``, so the link is suppressed through
*d + dedup_days* and accepted again from *d + dedup_days + 1*.

Storage is an append-only parquet log partitioned by ``first_seen``; "live"
rows are selected on read (partition-pruned) and expired partitions are removed
by a compaction job that rewrites a snapshot.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedweave.operators.common import date_lit
from feedweave.session import reliable_checkpoint

LEDGER_COLUMNS = ["link", "digest_type", "first_seen"]


def live(ledger: DataFrame, as_of, dedup_days: int = 7) -> DataFrame:
    """Rows in force on ``as_of`` (J3 as a read filter).

    ``as_of - n <= first_seen <= as_of``: replaying an earlier day is not
    suppressed by what later days have recorded.
    """
    day = date_lit(as_of)
    return ledger.filter(F.col("first_seen").between(F.date_sub(day, dedup_days), day))


def new_rows(articles: DataFrame, ledger: DataFrame, as_of, dedup_days: int = 7) -> DataFrame:
    """Ledger rows to append after a pass (D4 / J2): insert-if-absent against the live ledger.

    Every article of the pass is recorded (not only curated ones); empty links
    are never recorded.
    """
    batch = (articles.select("digest_type", "link").filter(F.col("link") != "")
             .distinct())
    current = live(ledger, as_of, dedup_days).select("digest_type", "link")
    fresh = batch.join(current, ["digest_type", "link"], "left_anti")
    return fresh.select("link", "digest_type", date_lit(as_of).alias("first_seen"))


def rows_of_finished(fresh: DataFrame, finished: DataFrame, as_of) -> DataFrame:
    """Ledger rows of the passes that produced a digest (J2): links of types in ``finished``.

    ``fresh`` has already been anti-joined with the live ledger, so its distinct
    links are new; a pass without a usable response records nothing and its
    items are offered again.
    """
    done = fresh.join(finished.select("digest_type").distinct(), "digest_type", "left_semi")
    return (done.filter(F.col("link") != "").select("link", "digest_type").distinct()
            .withColumn("first_seen", date_lit(as_of)))


def append(rows: DataFrame, path: str) -> None:
    """Append ledger rows to the parquet log, partitioned by ``first_seen``."""
    (rows.select(*LEDGER_COLUMNS).write.mode("append")
     .partitionBy("first_seen").parquet(path))


def compact(ledger: DataFrame, as_of, dedup_days: int, out_path: str) -> None:
    """Physically drop expired rows: write the live snapshot to ``out_path``.

    The earliest ``first_seen`` of a (link, type) among live rows wins, which is
    the insert-if-absent rule applied to a log that may hold repeats.
    """
    snap = (live(ledger, as_of, dedup_days).groupBy("link", "digest_type")
            .agg(F.min("first_seen").alias("first_seen")))
    snap.write.mode("overwrite").partitionBy("first_seen").parquet(out_path)


def replay(sightings: DataFrame, dedup_days: int = 7) -> DataFrame:
    """Accepted sightings when one daily run per date applies prune -> anti-join -> record.

    Input: distinct ``(digest_type, link, run_date)``.  Acceptance depends on the
    last *accepted* date, not the previous sighting, so a plain ``lag`` is wrong:
    the sorted distinct dates of each key are folded greedily.  The array per key
    is bounded by the number of distinct run dates.
    """
    gap = dedup_days + 1
    # collect_set de-duplicates map-side (partial aggregation), so a hot link
    # ships at most one set of dates per map partition: one shuffle in total
    per_key = (sightings.select("digest_type", "link", "run_date")
               .groupBy("digest_type", "link")
               .agg(F.array_sort(F.collect_set("run_date")).alias("dates")))
    accepted = F.aggregate(
        "dates", F.array().cast("array<date>"),
        lambda acc, d: F.when(
            (F.size(acc) == 0) | (d >= F.date_add(F.element_at(acc, -1), gap)),
            F.concat(acc, F.array(d))).otherwise(acc))
    return per_key.select("digest_type", "link",
                          F.explode(accepted).alias("run_date"))


KEY = ["digest_type", "link"]
ACCEPTED_COLUMNS = [*KEY, "run_date"]


def _fold(dates: Column, held: Column, gap: int) -> Column:
    """Accepted dates of a key's sorted distinct dates, after a sighting accepted on ``held`` (NULL: none)."""
    def step(acc, d):
        last = F.coalesce(F.try_element_at(acc, F.lit(-1)), held)
        return F.when(last.isNull() | (d >= F.date_add(last, gap)), F.concat(acc, F.array(d))).otherwise(acc)
    return F.aggregate(dates, F.array().cast("array<date>"), step)


def refold(sightings: DataFrame, accepted: DataFrame, late: DataFrame, dedup_days: int = 7,
           span_days: int | None = None) -> DataFrame:
    """Changes that late sightings make to the accepted ones (L1): ``(digest_type, link, run_date, added)``.

    ``sightings``: every known one, the late ones included; ``accepted``: the
    replay without the late ones; ``late``: those that came after their day was
    computed.  All are ``(digest_type, link, run_date)``, stored by ``run_date``.

    Only keys of ``late`` are folded again, each from its first late date, in
    spans of ``span_days``: a span reads its own days only.  A key goes on to
    the next span while its last accepted date differs from the stored one and
    either could still suppress a sighting; after that both folds are the same
    for good, unless more late dates follow.  ``added`` is false where a stored date is no longer accepted.
    """
    gap = dedup_days + 1
    span = span_days or 4 * gap
    end = sightings.agg(F.max("run_date")).first()[0]
    active = late.groupBy(*KEY).agg(F.min("run_date").alias("from_date"), F.max("run_date").alias("to_date"))
    # the last date accepted before a key's first late one, as far as it can suppress anything
    first = late.agg(F.min("run_date")).first()[0]
    no_change = accepted.select(*ACCEPTED_COLUMNS).limit(0).withColumn("added", F.lit(True))
    if first is None or end is None:
        return no_change
    near = accepted.filter(F.col("run_date") >= F.lit(first - dt.timedelta(dedup_days)))
    before = (near.join(active, KEY).filter(F.col("run_date") < F.col("from_date"))
              .groupBy(*KEY).agg(F.max("run_date").alias("held")))
    active = reliable_checkpoint(active.join(before, KEY, "left").withColumn("stored", F.col("held")))
    out = None
    while first is not None and first <= end:
        last = first + dt.timedelta(span - 1)
        days = F.col("run_date").between(F.lit(first), F.lit(last))
        seen = (sightings.filter(days).join(active.select(*KEY, "from_date"), KEY)
                .filter(F.col("run_date") >= F.col("from_date"))
                .groupBy(*KEY).agg(F.array_sort(F.collect_set("run_date")).alias("dates")))
        old = (accepted.filter(days).join(active.select(*KEY, "from_date"), KEY)
               .filter(F.col("run_date") >= F.col("from_date"))
               .groupBy(*KEY).agg(F.array_sort(F.collect_set("run_date")).alias("old")))
        none = F.array().cast("array<date>")
        state = (active.join(seen, KEY, "left").join(old, KEY, "left")
                 .withColumn("old", F.coalesce("old", none))
                 .withColumn("new", _fold(F.coalesce("dates", none), F.col("held"), gap)))
        state = reliable_checkpoint(state.select(*KEY, "from_date", "to_date", "old", "new", F.coalesce(F.try_element_at("new", F.lit(-1)), "held").alias("held"),
                                                 F.coalesce(F.try_element_at("old", F.lit(-1)), "stored").alias("stored")))
        changes = F.concat(F.transform(F.array_except("new", "old"), lambda d: F.struct(d.alias("run_date"), F.lit(True).alias("added"))),
                           F.transform(F.array_except("old", "new"), lambda d: F.struct(d.alias("run_date"), F.lit(False).alias("added"))))
        delta = state.select(*KEY, F.explode(changes).alias("c")).select(*KEY, "c.run_date", "c.added")
        out = delta if out is None else out.unionByName(delta)
        following = last + dt.timedelta(1)
        reach = F.date_sub(F.lit(following), gap)
        differs = ~F.col("held").eqNullSafe(F.col("stored")) & ((F.col("held") > reach) | (F.col("stored") > reach))
        more = F.col("to_date") > F.lit(last)
        active = state.filter(more | F.coalesce(differs, F.lit(False))).select(
            *KEY, F.greatest("from_date", F.lit(following)).alias("from_date"), "to_date", "held", "stored")
        first = active.agg(F.min("from_date")).first()[0]
    return no_change if out is None else out


def apply_changes(accepted: DataFrame, changes: DataFrame) -> DataFrame:
    """The accepted sightings after ``refold``'s changes."""
    gone = changes.filter("NOT added").select(*ACCEPTED_COLUMNS)
    kept = accepted.select(*ACCEPTED_COLUMNS).join(gone, ACCEPTED_COLUMNS, "left_anti")
    return kept.unionByName(changes.filter("added").select(*ACCEPTED_COLUMNS))


def rewrite_changed(accepted: DataFrame, changes: DataFrame, path: str) -> list[dt.date]:
    """Write the changed dates of the accepted log (``path/run_date=<d>``) again; others stay as they are.

    The dates are calendar days, newest first: what is left half done by a
    failure is found again by the next ``refold`` of the same late sightings.
    """
    changes = reliable_checkpoint(changes)
    dates = sorted((r.run_date for r in changes.select("run_date").distinct().collect()), reverse=True)
    if not dates:
        return []
    # read before anything is overwritten
    now = reliable_checkpoint(apply_changes(accepted.filter(F.col("run_date").isin(dates)), changes))
    for d in dates:
        now.filter(F.col("run_date") == F.lit(d)).select(*KEY).write.mode("overwrite").parquet(f"{path}/run_date={d}")
    return dates


def save_bucketed(rows: DataFrame, table: str, n_buckets: int, mode: str = "append") -> None:
    """Store the ledger as a table bucketed on the anti-join key (digest_type, link).

    Partitioned by ``first_seen`` so prune-on-read skips expired days; bucketed
    so the per-run anti-join reads the ledger already hash-partitioned and only
    the run's articles are shuffled.
    """
    (rows.select(*LEDGER_COLUMNS).write.mode(mode).format("parquet")
     .partitionBy("first_seen").bucketBy(n_buckets, "digest_type", "link")
     .sortBy("digest_type", "link").saveAsTable(table))


def read_bucketed(spark, table: str) -> DataFrame:
    return spark.table(table)
