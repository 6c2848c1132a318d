"""Run-history queries: the searchable per-day index, runs of a day, lookups.

Inputs are ``digest_runs`` rows (``id, run_date, digest_type, source_count,
item_count, markdown, trends_raw, feature_pitch_raw, created_at``).
"""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedweave.functions.markdown import JS_WS_CHARS
from feedweave.operators.common import dense_ordinal
from feedweave.session import reliable_checkpoint

# Dashboard conventions.
INDEX_LIMIT = 400
DISPLAY_TZ = "America/Chicago"
DATE_SHAPE = r"^\d{4}-\d{2}-\d{2}\z"
MAX_SAFE_INTEGER = 9007199254740991
TYPE_LABELS = {"press": "Press Highlights", "org": "Org Watch"}


def run_time_label(col="created_at") -> Column:
    """Local wall-clock label ``hh:mm AM`` in the display zone."""
    c = F.col(col) if isinstance(col, str) else col
    return F.date_format(F.from_utc_timestamp(c, DISPLAY_TZ), "hh:mm a")


def like_pattern(term: str) -> str | None:
    """The pattern of a search term, None if the term is empty."""
    t = (term or "").strip(JS_WS_CHARS)
    if t == "":
        return None
    return "%" + re.sub(r"\\(.)", lambda m: m[0] if m[1] in "%_\\" else m[1], t, flags=re.DOTALL) + "%"


def search(runs: DataFrame, term: str = "") -> DataFrame:
    """Runs matching a search term in markdown or date text.

    The term is trimmed (JavaScript whitespace); ``%`` and ``_`` inside it stay
    live wildcards.  A backslash before ``%``, ``_`` or a backslash escapes it;
    before any other character it stands for that character alone.
    """
    like = like_pattern(term)
    if like is None:
        return runs
    return runs.filter(F.col("markdown").ilike(like)
                       | F.col("run_date").cast("string").ilike(like))


def day_summary(runs: DataFrame) -> DataFrame:
    """Per-date counts of runs and items by type, only over the given runs."""
    press = F.col("digest_type") == "press"
    org = F.col("digest_type") == "org"
    return runs.groupBy("run_date").agg(
        F.count_if(press).cast("int").alias("press_runs"),
        F.count_if(org).cast("int").alias("org_runs"),
        F.coalesce(F.sum(F.when(press, F.col("item_count"))), F.lit(0)).cast("int").alias("press_items"),
        F.coalesce(F.sum(F.when(org, F.col("item_count"))), F.lit(0)).cast("int").alias("org_items"),
    )


def date_index(runs: DataFrame, term: str = "", limit: int = INDEX_LIMIT, found: DataFrame | None = None) -> DataFrame:
    """Dates with at least one matching run, newest first, at most ``limit``.

    The index never reads ``markdown`` unless a term is given (column pruning).
    Of runs kept as chunks, one with a matching chunk matches, and counts once.
    ``found``: the matching runs, where an index has them (``search_index``).
    """
    found = search(runs, term) if found is None else found
    if "chunk_no" in runs.columns:
        found = run_heads(runs).join(found.select("id").distinct(), "id", "left_semi") if found is not runs else run_heads(runs)
    summary = day_summary(found)
    top = summary.orderBy(F.col("run_date").desc()).limit(limit)
    return top.select(F.col("run_date").cast("string").alias("run_date"),
                      "press_runs", "org_runs", "press_items", "org_items")


def valid_date_text(col) -> Column:
    """Shape check plus a real calendar date (an impossible date matches nothing)."""
    c = F.col(col) if isinstance(col, str) else col
    return c.rlike(DATE_SHAPE) & F.try_to_date(c, "yyyy-MM-dd").isNotNull()


def valid_run_id(col) -> Column:
    """Digits only, a safe integer, greater than zero."""
    c = F.col(col) if isinstance(col, str) else col
    in_range = c.try_cast("decimal(38,0)").between(1, MAX_SAFE_INTEGER)
    return F.coalesce(c.rlike(r"^\d+\z") & in_range, F.lit(False))


def day_ranks(runs: DataFrame) -> DataFrame:
    """Per-day display fields of every run, without its texts.

    ``show_time``: more than one run of that type on that date.  ``display_rank``:
    press before org, newest first within a type.  A date has few runs and there
    are many dates, so both come from windows over ``run_date`` on one shuffle
    of narrow rows.
    """
    order = [(F.col("digest_type") == "press").desc(), F.col("created_at").desc(),
             F.col("id").desc()]
    day = Window.partitionBy("run_date")
    ranked = (runs.select("id", "run_date", "digest_type", "source_count", "item_count", "created_at")
              .withColumn("display_rank", F.row_number().over(day.orderBy(*order)).cast("bigint"))
              .withColumn("_n_runs", F.count(F.lit(1)).over(Window.partitionBy("run_date", "digest_type"))))
    return ranked.select(
        "id", F.col("run_date").cast("string").alias("run_date"), "digest_type", "source_count", "item_count",
        run_time_label().alias("run_time"), (F.col("_n_runs") > 1).alias("show_time"), "display_rank")


def runs_for_dates(runs: DataFrame) -> DataFrame:
    """``day_ranks`` with the runs' texts, which join by id and are in no window."""
    texts = runs.select("id", "markdown", "trends_raw", "feature_pitch_raw")
    return day_ranks(runs).join(texts, "id").select(
        "id", "run_date", "digest_type", "source_count", "item_count", "markdown", "trends_raw", "feature_pitch_raw",
        "run_time", "show_time", "display_rank")


def runs_for_date(runs: DataFrame, run_date: str) -> DataFrame:
    """Runs of one date (the dashboard's point lookup); invalid input gives no rows."""
    ok = F.lit(run_date).rlike(DATE_SHAPE) & F.try_to_date(F.lit(run_date), "yyyy-MM-dd").isNotNull()
    one = runs.filter(ok & (F.col("run_date") == F.try_to_date(F.lit(run_date), "yyyy-MM-dd")))
    return runs_for_dates(one)


def lookup_runs(requests: DataFrame, runs: DataFrame, raw_col: str = "raw_id") -> DataFrame:
    """Resolve raw id strings to runs: validate, then left join."""
    checked = requests.select(
        raw_col, valid_run_id(raw_col).alias("valid"),
        F.when(valid_run_id(raw_col), F.col(raw_col).cast("bigint")).alias("id"))
    # only valid ids are joined: the invalid ones, all NULL, would meet in one task
    found = checked.filter("valid").join(runs, "id", "left")
    return found.unionByName(checked.filter("not valid"), allowMissingColumns=True)


def previous_run(runs: DataFrame) -> DataFrame:
    """Each run's previous run of the same type by (run_date, created_at, id).

    Ordinals per type are computed without a per-type window, then the
    previous run is an equi-join on (type, ordinal - 1): a balanced shuffle.
    """
    order = [F.col("run_date").asc(), F.col("created_at").asc(), F.col("id").asc()]
    seq = dense_ordinal(runs.select("id", "digest_type", "run_date", "created_at"),
                        ["digest_type"], order, "seq")
    prev = seq.select("digest_type", (F.col("seq") + 1).alias("seq"),
                      F.col("id").alias("prev_id"), F.col("run_date").alias("prev_run_date"))
    return seq.join(prev, ["digest_type", "seq"], "left")


def latest_run(runs: DataFrame) -> DataFrame:
    """Newest run per type (G5): a map-side ``max_by`` instead of sort + limit per type."""
    key = F.struct("run_date", "created_at", "id")
    return runs.groupBy("digest_type").agg(
        F.max_by("id", key).alias("id"), F.max_by("run_date", key).alias("run_date"))


def active_dates(requests: DataFrame, index: DataFrame) -> DataFrame:
    """Requested date if it is in the (bounded) index, else the newest indexed date.

    ``index`` is a ``date_index`` result, so it holds at most ``INDEX_LIMIT`` rows
    and is broadcast.
    """
    idx = F.broadcast(index)
    newest = index.agg(F.max("run_date")).scalar()
    hit = requests.join(idx.select(F.col("run_date").alias("requested"),
                                   F.lit(True).alias("_hit")), "requested", "left")
    resolved = hit.select(
        "requested",
        F.when(F.col("_hit"), F.col("requested")).otherwise(newest).alias("active_date"))
    return resolved.join(idx.withColumnRenamed("run_date", "active_date"), "active_date", "left")


def type_labels(spark) -> DataFrame:
    return spark.createDataFrame(list(TYPE_LABELS.items()), "digest_type string, label string")


def run_labels(runs: DataFrame) -> DataFrame:
    """Display label, export file name and meta line per run."""
    labels = type_labels(runs.sparkSession)
    j = runs.join(F.broadcast(labels), "digest_type", "left")
    return j.select(
        "id", "digest_type", "label",
        F.concat(F.col("run_date").cast("string"), F.lit("-"), F.col("digest_type"),
                 F.lit("-digest.docx")).alias("file_name"),
        F.format_string("%d items fetched · %d sources", F.col("item_count"),
                        F.col("source_count")).alias("meta"),
    )


def _count_label(items, n_runs) -> Column:
    return F.when(n_runs > 0, F.format_string(
        "%d items across %d run%s", items, n_runs,
        F.when(n_runs > 1, F.lit("s")).otherwise(F.lit("")))).otherwise(F.lit("—"))


def _badge(prefix, items, n_runs) -> Column:
    return F.when(n_runs > 0, F.concat(
        F.lit(prefix + " · "), items.cast("string"),
        F.when(n_runs > 1, F.format_string(" (%d runs)", n_runs)).otherwise(F.lit(""))))


def day_summary_labels(index: DataFrame) -> DataFrame:
    """Per-day header and sidebar badge texts."""
    pr, orr = F.col("press_runs"), F.col("org_runs")
    return index.select(
        "run_date",
        _count_label(F.col("press_items"), pr).alias("press_label"),
        _count_label(F.col("org_items"), orr).alias("org_label"),
        _badge("Press", F.col("press_items"), pr).alias("press_badge"),
        _badge("Org", F.col("org_items"), orr).alias("org_badge"),
    )


def constraint_violations(runs: DataFrame) -> DataFrame:
    """Violations per table rule before a write (J5): one row per rule."""
    required = ["run_date", "digest_type", "source_count", "item_count", "markdown", "created_at"]
    aggs = [F.count_if(F.col(c).isNull()).alias(f"not_null_{c}") for c in required]
    aggs.append(F.count_if(~F.col("digest_type").isin("press", "org")).alias("type_check"))
    aggs.append(F.count(F.lit(1)).alias("_rows"))
    counts = runs.agg(*aggs)
    dup = (runs.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
           .agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0))).scalar())
    wide = counts.withColumn("unique_id", dup)
    rules = [f"not_null_{c}" for c in required] + ["type_check", "unique_id"]
    stack = ", ".join(f"'{r}', cast({r} as bigint)" for r in rules)
    return wide.selectExpr(f"stack({len(rules)}, {stack}) as (rule, violations)")


# ---------------------------------------------------------------- sinks

RUN_COLUMNS = ["id", "run_date", "digest_type", "source_count", "item_count", "markdown",
               "trends_raw", "feature_pitch_raw", "created_at", "chunk_no", "n_chunks"]


def with_run_ids(runs: DataFrame, batch_id: int, created_at) -> DataFrame:
    """Stable run ids and creation time for an append.

    ``id`` is a hash of (type, run date, batch id) folded into the safe-integer
    range the dashboard accepts, so re-writing a batch yields the same ids.
    """
    h = F.xxhash64(F.col("digest_type"), F.col("run_date").cast("string"), F.lit(int(batch_id)))
    run_id = F.pmod(h, F.lit(MAX_SAFE_INTEGER)) + 1
    return runs.withColumn("id", run_id).withColumn(
        "created_at", F.lit(str(created_at)).cast("timestamp"))


def append_runs(runs: DataFrame, path: str) -> None:
    """Write runs into the history table, ``run_date`` and ``digest_type`` folders.

    Only the folders of the given runs are written.  Other runs of such a
    folder (a second run of a day) stay; ids are stable, so writing a batch
    again replaces its own runs.  A run's chunks are rows of their own.
    """
    from feedweave.schemas import DIGEST_RUN, conform
    new = runs.select(*[c for c in RUN_COLUMNS if c in runs.columns])
    # calendar days of one batch
    days = [r.run_date for r in new.select("run_date").distinct().collect()]
    try:
        there = runs.sparkSession.read.schema(DIGEST_RUN).parquet(path).filter(F.col("run_date").isin(days))
        others = there.join(new.select("run_date", "digest_type").distinct(), ["run_date", "digest_type"], "left_semi").join(
            new.select("id").distinct(), "id", "left_anti")
        if not others.isEmpty():
            # read before the folders are overwritten
            new = reliable_checkpoint(conform(new, DIGEST_RUN).unionByName(conform(others, DIGEST_RUN)))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise  # else the first runs
    (new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("run_date", "digest_type").parquet(path))


def run_heads(runs: DataFrame) -> DataFrame:
    """One row per run of a history table that holds a row per chunk: the first chunk's."""
    return runs.filter(F.coalesce(F.col("chunk_no"), F.lit(0)) == 0)


def read_runs(spark, path: str) -> DataFrame:
    """History table with additive schema evolution: older files lack new columns.

    The schema is given, so no footers are read to plan; what a file lacks is NULL.
    """
    from feedweave.schemas import DIGEST_RUN, conform
    return conform(spark.read.schema(DIGEST_RUN).parquet(path), DIGEST_RUN)


def memory_latest(log: DataFrame) -> DataFrame:
    """Latest memory per type from an append-only log (J4): ``max_by`` on (updated_at, request_id)."""
    key = F.struct("updated_at", "request_id")
    return log.groupBy("digest_type").agg(F.max_by("memory", key).alias("memory"),
                                          F.max("updated_at").alias("updated_at"))


def append_memory(log_rows: DataFrame, path: str) -> None:
    """Append memory revisions (``digest_type, request_id, memory, updated_at``)."""
    log_rows.write.mode("append").parquet(path)


def read_history_jdbc(spark, url: str, table: str, properties: dict, schema=None,
                      partition_column: str | None = None, lower_bound=None, upper_bound=None,
                      num_partitions: int | None = None) -> DataFrame:
    """History tables kept in a database (A6): a partitioned ``read.jdbc``.

    With ``partition_column`` (e.g. ``id``) and bounds the read is split into
    ``num_partitions`` parallel range queries instead of one.  The result is
    conformed to ``schema`` (default: the run table) so the operators above
    apply unchanged.
    """
    from feedweave.schemas import DIGEST_RUN, conform
    if partition_column:
        df = spark.read.jdbc(url, table, column=partition_column, lowerBound=lower_bound,
                             upperBound=upper_bound, numPartitions=num_partitions,
                             properties=properties)
    else:
        df = spark.read.jdbc(url, table, properties=properties)
    return conform(df, schema or DIGEST_RUN)
