"""Document assembly: headers, ordered item blocks, request texts, pass totals.

Ordered text aggregation never builds one string per digest type: a type's
lines are cut into chunks, and each chunk is aggregated on its own.

* ``sized_text`` cuts by bytes (distributed running totals of the lines'
  lengths); each chunk has the separator that stands before it as ``lead``, so
  ``lead`` and ``text`` of all chunks, in order, are the single text.  The daily
  job's requests are these chunks.
* ``chunked_text`` cuts by ``chunk_size`` consecutive items; a separator at the
  seam of two chunks is in neither.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedweave.functions.text import py_strip
from feedweave.operators.common import running_total, sized_broadcast
from feedweave.session import reliable_checkpoint

# Header, block and request wording of the two digest types.
ORG_TITLE = "# Org News Digest — "
PRESS_TITLE = "# Press Highlights — "
ORG_EMPTY_BODY = "_No new items found across monitored sources for this period._"
PRESS_EMPTY_BODY = "_No new releases were found in the last 24 hours._"
NO_SUMMARY = "(no summary provided)"
RULE = "=" * 60
NO_PREVIOUS = "(none — this is the first digest of this type)"
NO_MEMORY = "(none yet — this is the first run)"
PREFS_INTRO = "PERSONAL PREFERENCES (prioritize these above all else):"

# What a digest of each type is called, and whom it is for, in the instruction of a comparison.
DIGEST_CONTEXT = {
    "org": ("an org news digest for a freelance journalist covering aging, senior care, and elder health",
            "read by a freelance journalist and content creator who pitches consumer and trade outlets. "
            "Items are grouped by organisation, each with consumer and trade story angles already noted."),
    "press": ("a press-release highlights digest",
              "read by a freelance writer curating morning press-release highlights across health, wellness, "
              "food, lifestyle, and consumer categories."),
}

CHUNK_SIZE = 50
# UTF-8 bytes of text after which a new chunk begins.
CHUNK_BYTES = 40_000


def digest_header(digest_type, run_date, source_count, item_count) -> Column:
    """Header prepended to a digest, plus the empty-input body when there are no items."""
    t = F.col(digest_type) if isinstance(digest_type, str) else digest_type
    d = F.col(run_date) if isinstance(run_date, str) else run_date
    sc = F.col(source_count).cast("string")
    ic = F.col(item_count).cast("string")
    org = F.concat(F.lit(ORG_TITLE), F.date_format(d, "MMMM yyyy"), F.lit("\n**Run date:** "),
                   F.date_format(d, "yyyy-MM-dd"), F.lit(" | **Sources monitored:** "), sc,
                   F.lit(" | **Items fetched:** "), ic, F.lit("\n\n---\n\n"),
                   F.when(F.col(item_count) == 0, F.lit(ORG_EMPTY_BODY)).otherwise(F.lit("")))
    press = F.concat(F.lit(PRESS_TITLE), F.date_format(d, "MMMM dd, yyyy"),
                     F.lit("\n**Sources monitored:** "), sc, F.lit(" | **Items fetched:** "), ic,
                     F.lit("\n\n---\n\n"),
                     F.when(F.col(item_count) == 0, F.lit(PRESS_EMPTY_BODY)).otherwise(F.lit("")))
    return F.when(t == "org", org).otherwise(press)


def org_item_line(i="item_no") -> Column:
    """One ``[Item i]`` entry with seven labelled lines and a blank line."""
    summary = F.when(F.coalesce(F.col("summary"), F.lit("")) == "", F.lit(NO_SUMMARY)) \
        .otherwise(F.col("summary"))
    return F.concat(
        F.lit("[Item "), F.col(i).cast("string"), F.lit("]\n"),
        F.lit("Org: "), F.col("org"), F.lit("\n"),
        F.lit("Category: "), F.col("category"), F.lit("\n"),
        F.lit("Source: "), F.col("source_name"), F.lit("\n"),
        F.lit("Title: "), F.col("title"), F.lit("\n"),
        F.lit("Published: "), F.col("published"), F.lit("\n"),
        F.lit("Link: "), F.col("link"), F.lit("\n"),
        F.lit("Summary: "), summary, F.lit("\n\n"))


def press_item_line() -> Column:
    """``[source] title`` / summary / link (E5); items are joined with a blank line."""
    return F.concat(F.lit("["), F.col("source_name"), F.lit("] "), F.col("title"), F.lit("\n"),
                    F.col("summary"), F.lit("\n"), F.col("link"))


def index_line() -> Column:
    """All-items index line ``- [Title](link) — org | published``."""
    return F.concat(F.lit("- ["), F.col("title"), F.lit("]("), F.col("link"), F.lit(") — "),
                    F.col("org"), F.lit(" | "), F.col("published"))


def chunked_text(df: DataFrame, group_cols: list[str], ordinal_col: str, line: Column,
                 sep: str = "", chunk_size: int = CHUNK_SIZE) -> DataFrame:
    """Ordered text per group, as chunks of at most ``chunk_size`` consecutive lines.

    ``ordinal_col`` must number rows 1..n inside each group.  Output:
    ``group..., chunk_no, first_no, last_no, n_lines, text``.
    """
    chunk = F.floor((F.col(ordinal_col) - 1) / chunk_size).cast("int")
    rows = df.select(*group_cols, chunk.alias("chunk_no"),
                     F.col(ordinal_col).alias("_no"), line.alias("_line"))
    agg = rows.groupBy(*group_cols, "chunk_no").agg(
        F.array_sort(F.collect_list(F.struct("_no", "_line"))).alias("_parts"),
        F.min("_no").alias("first_no"), F.max("_no").alias("last_no"),
        F.count(F.lit(1)).alias("n_lines"))
    return agg.select(*group_cols, "chunk_no", "first_no", "last_no", "n_lines",
                      F.array_join(F.transform("_parts", lambda p: p["_line"]), sep).alias("text"))


def items_blocks(articles: DataFrame, chunk_size: int = CHUNK_SIZE) -> DataFrame:
    """Per-type item blocks in final order: org shape for ``org``, press shape otherwise.

    ``articles`` must carry ``item_no`` (``ingest.newest_first``).
    """
    org = chunked_text(articles.filter(F.col("digest_type") == "org"), ["digest_type"],
                       "item_no", org_item_line(), "", chunk_size)
    press = chunked_text(articles.filter(F.col("digest_type") != "org"), ["digest_type"],
                         "item_no", press_item_line(), "\n\n", chunk_size)
    return org.unionByName(press)


def all_items_index(articles: DataFrame, chunk_size: int = CHUNK_SIZE) -> DataFrame:
    """Every item of a pass as one index line, grouped by org, in final order.

    Chunks follow the pass order: chunk ``k`` of an org holds its items with
    ``item_no`` in ``[k*chunk_size+1, (k+1)*chunk_size]``, so no group exceeds
    ``chunk_size`` lines even for an org holding most of the pass, and an org's
    index is its chunks in ``chunk_no`` order.
    """
    chunk = F.floor((F.col("item_no") - 1) / chunk_size).cast("int")
    rows = articles.select("digest_type", "org", chunk.alias("chunk_no"),
                           F.col("item_no").alias("_no"), index_line().alias("_line"))
    agg = rows.groupBy("digest_type", "org", "chunk_no").agg(
        F.array_sort(F.collect_list(F.struct("_no", "_line"))).alias("_parts"),
        F.min("_no").alias("first_no"), F.max("_no").alias("last_no"),
        F.count(F.lit(1)).alias("n_lines"))
    return agg.select("digest_type", "org", "chunk_no", "first_no", "last_no", "n_lines",
                      F.array_join(F.transform("_parts", lambda p: p["_line"]), "\n").alias("text"))


def sized_text(df: DataFrame, group_cols: list[str], order_cols: list[str], line: Column, sep: str = "",
               budget: int = CHUNK_BYTES, whole: str | None = None, number: str | None = None) -> DataFrame:
    """Ordered text per group in chunks by size: ``group..., chunk_no, n_lines, n_bytes, lead, text``.

    A line belongs to chunk ``floor(bytes before it / budget)``, so a chunk is
    shorter than the budget and one line.  Lines with one value of ``whole``
    (consecutive in the order) stay in one chunk if they fit the budget; more
    than that is cut like single lines, so a chunk is always shorter than two
    budgets and a line.  ``chunk_no`` ascends with the text, may leave numbers
    out, and begins with 0.  ``number``: its least and largest value in a chunk
    are ``first_no`` and ``last_no``.
    """
    others = [c for c in dict.fromkeys([whole, number]) if c and c not in order_cols and c not in group_cols]
    rows = df.select(*group_cols, *order_cols, *others, line.alias("_line"))
    rows = rows.withColumn("_size", (F.octet_length("_line") + len(sep.encode())).cast("bigint"))
    placed = running_total(rows, group_cols, order_cols, "_size", "_start")
    at = F.col("_start")
    if whole:
        units = placed.groupBy(*group_cols, whole).agg(F.min("_start").alias("_first"), F.sum("_size").alias("_all"))
        placed = placed.join(sized_broadcast(units), [*group_cols, whole])
        at = F.when(F.col("_all") <= budget, F.col("_first")).otherwise(at)
    numbered = placed.withColumn("chunk_no", F.floor(at / budget).cast("int"))
    ends = [F.min(number).alias("first_no"), F.max(number).alias("last_no")] if number else []
    agg = numbered.groupBy(*group_cols, "chunk_no").agg(
        F.array_sort(F.collect_list(F.struct("_start", "_line"))).alias("_parts"), *ends, F.count(F.lit(1)).alias("n_lines"))
    text = F.array_join(F.transform("_parts", lambda p: p["_line"]), sep)
    return agg.select(*group_cols, "chunk_no", *(["first_no", "last_no"] if number else []), "n_lines",
                      F.octet_length(text).alias("n_bytes"), F.when(F.col("chunk_no") > 0, F.lit(sep)).otherwise(F.lit("")).alias("lead"),
                      text.alias("text"))


def sized_blocks(articles: DataFrame, budget: int = CHUNK_BYTES) -> DataFrame:
    """Item blocks of every type in final order, cut by size (E4, E5): org shape for ``org``, press shape otherwise."""
    def of(rows, line, sep):
        return sized_text(rows, ["digest_type"], ["item_no"], line, sep, budget, number="item_no")
    org = of(articles.filter(F.col("digest_type") == "org"), org_item_line(), "")
    press = of(articles.filter(F.col("digest_type") != "org"), press_item_line(), "\n\n")
    return org.unionByName(press)


def sized_index(articles: DataFrame, budget: int = CHUNK_BYTES) -> DataFrame:
    """Every item of a pass as one index line, orgs by name, an org's items in final order.

    An org whose lines fit the budget is never split.
    """
    return sized_text(articles, ["digest_type"], ["org", "item_no"], index_line(), "\n", budget, whole="org")


def curation_requests(blocks: DataFrame, totals: DataFrame, run_date: str,
                      preferences: str = "", system: str = "") -> DataFrame:
    """Request text per (type, chunk) around the item blocks.

    Org: "write the digest for <date>", total items of the pass, rules of 60 ``=`` around the
    block.  Press: the optional preferences section, then the releases.
    ``request_id`` is ``<run_date>-<type>-<chunk>``; ``system`` is the caller's
    instruction text (configuration, not built here).
    """
    prefs = f"\n\n{PREFS_INTRO}\n{preferences}\n" if preferences else ""
    j = blocks.join(sized_broadcast(totals.select("digest_type", "item_count")), "digest_type")
    org_user = F.concat(
        F.lit(f"Please write the internal org news digest for {run_date}.\n\n"),
        F.lit("Total items to process: "), F.col("item_count").cast("string"), F.lit("\n\n"),
        F.lit(RULE + "\n"), F.col("text"), F.lit(RULE))
    long_date = dt.date.fromisoformat(str(run_date)[:10]).strftime("%B %d, %Y")
    press_user = F.concat(F.lit(f"Today is {long_date}.\n{prefs}\n"), F.col("text"))
    request_id = F.concat_ws("-", F.lit(run_date), F.col("digest_type"),
                             F.col("chunk_no").cast("string"))
    return j.select(
        request_id.alias("request_id"), "digest_type", "chunk_no", "first_no", "last_no",
        F.lit(system).alias("system"),
        F.when(F.col("digest_type") == "org", F.lit(16000)).otherwise(F.lit(8000)).alias("max_tokens"),
        F.when(F.col("digest_type") == "org", org_user).otherwise(press_user).alias("user_text"))


def usable_outcome(outcome="outcome") -> Column:
    """Whether a response's body may be stored; a missing one may not."""
    return F.coalesce(F.col(outcome).isin("ok", "truncated"), F.lit(False))


def digest_chunks(responses: DataFrame, keys: list[str]) -> DataFrame:
    """Markdown of each chunk of the given passes: ``keys..., chunk_no, markdown``.

    ``responses``: ``keys..., digest_type, chunk_no, body, header``.  Chunk 0
    begins with the header, later ones with the blank line between bodies (org
    bodies are stripped), so the chunks of a pass in order are its whole text.
    """
    body = F.when(F.col("digest_type") == "org", py_strip(F.col("body"))).otherwise(F.col("body"))
    lead = F.when(F.col("chunk_no") == 0, F.col("header")).otherwise(F.lit("\n\n"))
    return responses.select(*keys, "chunk_no", F.concat(lead, body).alias("markdown"))


def digest_rows(headers: DataFrame, responses: DataFrame, totals: DataFrame, run_date: str) -> DataFrame:
    """Run rows of the passes whose every request has a usable response (J1): one a chunk.

    ``headers``: ``digest_type, header``; ``responses``: ``digest_type, chunk_no,
    body, outcome``, one per request; ``totals``: ``source_count, item_count``.
    Which passes are done is decided on narrow rows; no row or group holds more
    than one response.  A type with a missing, refused, empty or failed
    response gets no row.
    """
    done = (responses.groupBy("digest_type")
            .agg(F.bool_and(usable_outcome()).alias("_done"), F.count(F.lit(1)).cast("int").alias("n_chunks"))
            .filter("_done").drop("_done"))
    passes = done.join(headers, "digest_type").join(totals, "digest_type")
    # one row for each configured type
    whole = responses.join(sized_broadcast(passes), "digest_type")
    return digest_chunks(whole, ["digest_type", "n_chunks", "source_count", "item_count"]).select(
        F.lit(str(run_date)[:10]).cast("date").alias("run_date"), "digest_type", "chunk_no", "n_chunks",
        "source_count", "item_count", "markdown")


def with_whole_md5(rows: DataFrame, keys: list[str], order_col: str, md5_col: str, name: str) -> DataFrame:
    """Add ``name``: the md5 of the chunk digests ``md5_col`` of a run (``keys``), joined in the order of ``order_col``.

    It changes with any chunk that is lost, repeated, altered or out of order.
    Only digests meet; the chunks' texts never come together in one value.
    """
    fixed = reliable_checkpoint(rows)
    parts = F.array_sort(F.collect_list(F.struct(order_col, md5_col)))
    whole = fixed.groupBy(*keys).agg(F.md5(F.array_join(F.transform(parts, lambda p: p[md5_col]), "")).alias(name))
    return fixed.join(sized_broadcast(whole), keys).select(*rows.columns, name)


def with_context(template: str, digest_type="digest_type") -> Column:
    """The instruction ``template`` with ``{label}`` and ``{context}`` of the row's type (B16); no text for other types."""
    t = F.col(digest_type) if isinstance(digest_type, str) else digest_type
    out = F.lit("") if "{label}" in template or "{context}" in template else F.lit(template)
    for name, (label, context) in DIGEST_CONTEXT.items():
        out = F.when(t == name, F.lit(template.replace("{label}", label).replace("{context}", context))).otherwise(out)
    return out


def comparison_requests(runs: DataFrame, previous: DataFrame, memory: DataFrame,
                        system: str = "") -> DataFrame:
    """Request per run comparing it with its previous digest and the type's memory.

    ``previous``: ``id, prev_id`` (``history.previous_run``); ``memory``: one row per
    type (``memory_latest``).  Missing or empty inputs get the "(none ...)" texts.
    ``system`` may name its type's ``{label}`` and ``{context}``.
    """
    prev_md = runs.select(F.col("id").alias("prev_id"), F.col("markdown").alias("prev_markdown"))
    j = (runs.select("id", "digest_type", "markdown")
         .join(previous.select("id", "prev_id"), "id", "left")
         .join(prev_md, "prev_id", "left")
         .join(sized_broadcast(memory.select("digest_type", "memory")), "digest_type", "left"))
    user = F.concat(
        F.lit(RULE + "\nNEW DIGEST (just written):\n\n"), F.coalesce(F.col("markdown"), F.lit("")),
        F.lit("\n\n" + RULE + "\nPREVIOUS DIGEST:\n\n"),
        F.coalesce(F.when(F.col("prev_markdown") != "", F.col("prev_markdown")), F.lit(NO_PREVIOUS)),
        F.lit("\n\n" + RULE + "\nDIGEST MEMORY:\n\n"),
        F.coalesce(F.when(F.col("memory") != "", F.col("memory")), F.lit(NO_MEMORY)),
        F.lit("\n" + RULE))
    return j.select(F.concat(F.lit("cmp-"), F.col("id").cast("string")).alias("request_id"),
                    "id", "digest_type", "prev_id", with_context(system).alias("system"),
                    F.lit(3072).alias("max_tokens"), user.alias("user_text"))


def source_status(sources: DataFrame, accepted: DataFrame) -> DataFrame:
    """Accepted items per fetched source, zero shown as ``nothing new``."""
    counts = accepted.groupBy("digest_type", "source_idx").agg(F.count(F.lit(1)).alias("n_items"))
    j = sources.join(counts, ["digest_type", "source_idx"], "left")
    n = F.coalesce(F.col("n_items"), F.lit(0))
    return j.select("digest_type", "source_idx", "source_name", n.alias("n_items"),
                    F.when(n > 0, F.format_string("%d item(s)", n))
                    .otherwise(F.lit("nothing new")).alias("status"))


def pass_totals(sources: DataFrame, fresh: DataFrame, settings: DataFrame | None = None) -> DataFrame:
    """``source_count`` (every configured source with a feed URL) and ``item_count`` per run.

    Without ``settings`` only passes that have items are reported.  With
    ``settings`` the gate decides: a pass is written when its item count
    reaches ``min_items_to_send`` (so a threshold of 0 writes empty runs).
    """
    sc = sources.groupBy("digest_type").agg(F.count(F.lit(1)).cast("int").alias("source_count"))
    ic = fresh.groupBy("digest_type").agg(F.count(F.lit(1)).cast("int").alias("item_count"))
    if settings is None:
        return sc.join(ic, "digest_type", "inner")
    gate = sized_broadcast(settings.select("digest_type", "min_items_to_send"))
    out = (sc.join(ic, "digest_type", "left").join(gate, "digest_type", "inner")
           .withColumn("item_count", F.coalesce(F.col("item_count"), F.lit(0))))
    return (out.filter(F.col("item_count") >= F.col("min_items_to_send"))
            .select("digest_type", "source_count", "item_count"))
