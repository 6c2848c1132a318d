"""Ingest pass: landed entries -> fresh, gated, ordered articles.

Step order matters (cap -> cutoff -> source filter -> in-run dedup -> sort ->
ledger anti-join -> gate):

* the per-source cap counts raw feed positions, including entries rejected later;
* an entry key is claimed only by an entry that passed cutoff and filter, so a
  stale first copy does not hide a later valid one;
* the in-run key is lower-cased (link, else id, else title); the ledger key is the
  stripped link with case kept, and empty links never match the ledger.

All digest types run in one keyed plan: settings are a broadcast dimension joined
on ``digest_type`` instead of a loop over types.

Expected entry columns: ``digest_type, source_idx, pos, org, category,
source_name, source_filter, link, entry_id, title, summary, description,
author, pub_ts``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedweave.functions import text as tx
from feedweave.operators import ledger as ledger_ops
from feedweave.operators.common import (bounded_broadcast, date_lit, dense_ordinal,
                                       sized_broadcast, ts_lit)
from feedweave.session import reliable_checkpoint

ARTICLE_COLUMNS = ["digest_type", "source_idx", "pos", "org", "category", "source_name",
                   "title", "summary", "link", "published", "pub_ts"]

# Feed order inside a pass: source order, then position in the feed.
FEED_ORDER = ["source_idx", "pos"]


def with_settings(entries: DataFrame, settings: DataFrame) -> DataFrame:
    """Attach per-type settings; types without settings drop out (inner join)."""
    cols = ["digest_type", "days_back", "max_items_per_source", "min_items_to_send"]
    return entries.join(sized_broadcast(settings.select(*cols)), "digest_type", "inner")


def cap_per_source(df: DataFrame, cap=None) -> DataFrame:
    """Keep the first ``cap`` raw entries of each feed.

    ``pos`` is the 0-based feed position, so this is a plain filter and needs
    no window or shuffle.  ``cap`` defaults to the type's ``max_items_per_source``.
    """
    limit = F.col("max_items_per_source") if cap is None else F.lit(cap)
    return df.filter(F.col("pos") < limit)


def recency_cutoff(df: DataFrame, as_of) -> DataFrame:
    """Drop entries dated before ``as_of - days_back``; keep boundary and undated rows."""
    cutoff = F.timestamp_add("DAY", -F.col("days_back"), ts_lit(as_of))
    return df.filter(F.col("pub_ts").isNull() | (F.col("pub_ts") >= cutoff))


def source_filter(df: DataFrame) -> DataFrame:
    """Wire-feed term filter on raw author/summary/description/title (C4)."""
    hay = tx.filter_haystack("author", "summary", "description", "title")
    return df.filter(tx.passes_source_filter("source_filter", hay))


def with_entry_key(df: DataFrame) -> DataFrame:
    return df.withColumn("entry_key", tx.entry_key("link", "entry_id", "title"))


def in_run_dedup(df: DataFrame) -> DataFrame:
    """First copy wins within a pass, by (source order, feed position) (F1).

    ``row_number() ... = 1`` directly above the window lets Spark insert a
    partial ``WindowGroupLimit`` before the shuffle, so even a key shared by a
    third of all rows ships at most one row per map partition.
    """
    keyed = df if "entry_key" in df.columns else with_entry_key(df)
    w = Window.partitionBy("digest_type", "entry_key").orderBy(*FEED_ORDER)
    return (keyed.withColumn("_rn", F.row_number().over(w))
            .filter(F.col("_rn") == 1).drop("_rn"))


def project_articles(df: DataFrame) -> DataFrame:
    """Article shape: stripped title/link, cleaned summary, date label."""
    return df.select(
        "digest_type", "source_idx", "pos", "org", "category", "source_name",
        tx.py_strip(F.coalesce(F.col("title"), F.lit(""))).alias("title"),
        tx.clean_html(tx.summary_fallback("summary", "description")).alias("summary"),
        tx.py_strip(F.coalesce(F.col("link"), F.lit(""))).alias("link"),
        tx.published_label("pub_ts").alias("published"),
        "pub_ts",
        *[c for c in ("min_items_to_send", "entry_key") if c in df.columns],
    )


def drop_seen(articles: DataFrame, ledger: DataFrame) -> DataFrame:
    """Left-anti join on (digest_type, link) with the live ledger.

    Empty links never match, and hashing them all as ``''`` would send every
    link-less item to one reducer.  They are salted instead: the join key of an
    empty link is a per-row value (NUL + feed position, or a row hash) that no
    ledger link can equal, so those rows spread over all partitions and always survive, in a
    single join with no second pass over the input.
    """
    if {"source_idx", "pos"} <= set(articles.columns):
        spread = F.concat(F.col("source_idx").cast("string"), F.lit(":"), F.col("pos").cast("string"))
    else:
        spread = F.xxhash64(*articles.columns).cast("string")
    salt = F.concat(F.lit("\u0000"), spread)
    keyed = articles.withColumn("_fw_key", F.when(F.col("link") == "", salt)
                                .otherwise(F.col("link")))
    seen = (ledger.filter(F.col("link") != "")
            .select("digest_type", F.col("link").alias("_fw_key")))
    return keyed.join(seen, ["digest_type", "_fw_key"], "left_anti").drop("_fw_key")


def type_counts(df: DataFrame) -> DataFrame:
    """Rows per digest type, aggregated map-side (at most one row per configured type)."""
    return df.groupBy("digest_type").agg(F.count(F.lit(1)).alias("n_items"))


def min_items_gate(df: DataFrame, n_types: int | None = None) -> DataFrame:
    """A pass below ``min_items_to_send`` produces nothing.

    ``n_types`` (rows in the settings table) bounds the per-type counts, so
    they are broadcast without a sizing job.
    """
    counts = bounded_broadcast(type_counts(df), n_types)
    return (df.join(counts, "digest_type", "inner")
            .filter(F.col("n_items") >= F.col("min_items_to_send"))
            .drop("n_items"))


def newest_first(df: DataFrame, name: str = "item_no", n_types: int | None = None) -> DataFrame:
    """Item ordinal per type: newest first, undated last, ties in feed order."""
    order = [F.col("pub_ts").desc_nulls_last(), F.col("source_idx").asc(), F.col("pos").asc()]
    return dense_ordinal(df, ["digest_type"], order, name, max_groups=n_types)


def fresh_candidates(entries: DataFrame, settings: DataFrame, ledger: DataFrame, as_of,
                     dedup_days: int = 7) -> DataFrame:
    """The pass before the gate: cap, cutoff, filter, dedup, ledger anti-join (lazy)."""
    df = with_settings(entries, settings)
    df = cap_per_source(df)
    df = recency_cutoff(df, as_of)
    df = source_filter(df)
    # Key from the raw fields, then project: the dedup and anti-join shuffles
    # carry the cleaned 600-character summary instead of the whole raw text.
    arts = project_articles(with_entry_key(df))
    arts = in_run_dedup(arts).drop("entry_key")
    return drop_seen(arts, ledger_ops.live(ledger, as_of, dedup_days))


def fresh_items(entries: DataFrame, settings: DataFrame, ledger: DataFrame, as_of,
                dedup_days: int = 7, ordered: bool = True) -> DataFrame:
    """Entry 1 of the daily job up to the curation request, for every type at once."""
    n_types = settings.count()  # configuration rows: one per digest type
    arts = fresh_candidates(entries, settings, ledger, as_of, dedup_days)
    # The gate needs per-type counts of the very rows it filters.  Evaluated as
    # two branches, the whole pass would run twice (column pruning makes the
    # branches' exchanges differ, so none is reused); the fresh set is small
    # next to the input, so it is materialised once (reliable checkpoint) and
    # both the counts and the filter read it.  The gate keeps or drops whole
    # types, so numbering before it leaves the surviving ordinals unchanged.
    if ordered:
        arts = newest_first(arts, n_types=n_types)       # checkpoints internally
    else:
        arts = reliable_checkpoint(arts)
    return min_items_gate(arts, n_types).drop("min_items_to_send")


def step_counts(entries: DataFrame, settings: DataFrame, ledger: DataFrame, as_of,
                dedup_days: int = 7) -> DataFrame:
    """Rows left after each step, per type (a diagnostics table, one row per type and step)."""
    base = with_settings(entries, settings)
    steps = [("all", base)]
    capped = cap_per_source(base)
    steps.append(("cap", capped))
    recent = recency_cutoff(capped, as_of)
    steps.append(("cutoff", recent))
    filtered = source_filter(recent)
    steps.append(("source_filter", filtered))
    deduped = in_run_dedup(filtered)
    steps.append(("in_run_dedup", deduped))
    fresh = drop_seen(project_articles(deduped), ledger_ops.live(ledger, as_of, dedup_days))
    steps.append(("anti_join", fresh))
    out = None
    for i, (label, d) in enumerate(steps):
        c = type_counts(d).select("digest_type", F.lit(i).alias("step_no"),
                                  F.lit(label).alias("step"), "n_items")
        out = c if out is None else out.unionByName(c)
    return out
