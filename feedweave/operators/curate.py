"""Deterministic curation: rule scores, top-k with a floor, categories, themes.

The original hands selection to a language model; these are the data jobs the
selection instructions describe.  A few rules (a preferences file) are compiled
into one array literal and evaluated inside the projection; rules of a table, of
any number, are found by ``term_match``.  Rule kinds:

* ``prefer`` / ``seek`` / ``less`` — add ``weight`` when the term occurs;
* ``skip`` — drop the item when a skip term occurs and no ``prefer`` term does;
* ``category`` — the first matching rule by ``priority`` names the category.

Terms match as case-insensitive substrings of ``title + ' ' + summary``.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedweave.functions import text as tx
from feedweave.operators import term_match
from feedweave.operators.common import dense_ordinal
from feedweave.session import reliable_checkpoint

# Target size of a curated pass (at most 20, aim for 15).
PICK_MAX = 20
PICK_AIM = 15
PICK_LEAST = 10
#: Terms are letter runs of at least so many characters, everywhere.
TERM_LETTERS = 4
THEMES_TOP = 5
MEMORY_MAX = 12
TERM_SPLIT = r"[^\p{L}]+"


def rules_literal(rules: Iterable[dict]) -> Column:
    """Array literal ``array<struct<kind,term,label,weight,priority>>`` from config rows."""
    rows = list(rules)
    return F.array(*[F.struct(
        F.lit(r["kind"]).alias("kind"), F.lit(str(r.get("term", "")).lower()).alias("term"),
        F.lit(r.get("label")).cast("string").alias("label"),
        F.lit(int(r.get("weight", 0))).alias("weight"),
        F.lit(int(r.get("priority", 0))).alias("priority")) for r in rows]) if rows else \
        F.array().cast("array<struct<kind:string,term:string,label:string,weight:int,priority:int>>")


def haystack(title="title", summary="summary") -> Column:
    return F.lower(F.concat_ws(" ", F.coalesce(F.col(title), F.lit("")),
                               F.coalesce(F.col(summary), F.lit(""))))


def score_items(items: DataFrame, rules: Iterable[dict]) -> DataFrame:
    """Add ``score`` and ``dropped`` (K1)."""
    # the text is lowered once a row, and the rules are walked once
    start = F.struct(F.lit(0).alias("score"), F.lit(False).alias("skip"), F.lit(False).alias("prefer"))

    def step(acc, r):
        hit = F.contains(F.col("_hay"), r["term"])
        return F.struct(
            (acc["score"] + F.when(hit & r["kind"].isin("prefer", "seek", "less"), r["weight"])
             .otherwise(F.lit(0))).alias("score"),
            (acc["skip"] | (hit & (r["kind"] == "skip"))).alias("skip"),
            (acc["prefer"] | (hit & (r["kind"] == "prefer"))).alias("prefer"))

    found = (items.withColumn("_hay", haystack())
             .withColumn("_found", F.aggregate(rules_literal(rules), start, step)))
    return found.select(*items.columns, F.col("_found.score").alias("score"),
                        (F.col("_found.skip") & ~F.col("_found.prefer")).alias("dropped"))


def rule_terms(rules: DataFrame, **of_term: Column) -> DataFrame:
    """``term, of_term...`` of the lower-case terms of ``rules`` (``schemas.RULE``); ``of_term`` are aggregates over the rules of a term."""
    each = rules.groupBy(F.lower(F.coalesce("term", F.lit(""))).alias("term")).agg(F.max("term").alias("_any"), *(c.alias(name) for name, c in of_term.items()))
    return each.filter(F.col("_any").isNotNull()).drop("_any")


def by_word(inside: list[DataFrame], first: list[Column], again: list[Column]) -> DataFrame:
    """A row a word: the aggregates ``first`` over the slices of ``term_match.in_words``, one after the other, then ``again`` over theirs.

    Checkpointed, so that one slice is broadcast at a time, and Spark can split
    the join with the texts' words at a word that most of them have.
    """
    slices = [reliable_checkpoint(s.groupBy("word").agg(*first)) for s in inside]
    return slices[0] if len(slices) == 1 else reliable_checkpoint(reduce(DataFrame.unionByName, slices).groupBy("word").agg(*again))


def score_by_table(items: DataFrame, rules: DataFrame, keys: tuple[str, ...] = ("digest_type", "item_no")) -> DataFrame:
    """``score_items`` with the rules of a table (K1); ``keys`` name an item.

    A term counts once an item, in however many of its words it is: the weights
    of an item's words come to it as arrays and are told apart there.
    """
    k = list(keys)
    weight = F.when(F.col("kind").isin("prefer", "seek", "less"), F.coalesce("weight", F.lit(0))).otherwise(F.lit(0))
    each = rule_terms(rules, _weight=F.sum(weight), _skips=F.bool_or(F.col("kind") == "skip"), _prefers=F.bool_or(F.col("kind") == "prefer"))
    words, inside, rest = term_match.in_words(items.select(*k, haystack().alias("_hay")), "_hay", k, each, ("_weight", "_skips", "_prefers"))
    kinds = (F.bool_or("_skips").alias("_skips"), F.bool_or("_prefers").alias("_prefers"))
    weights = F.collect_list(F.when(F.col("_weight") != 0, F.struct("term", "_weight"))).alias("_terms")
    of_word = by_word(inside, [weights, *kinds], [F.flatten(F.collect_list("_terms")).alias("_terms"), *kinds])
    n = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    met = words.join(of_word, "word").drop("word").repartition(n, *k).withColumn("_of", F.explode_outer("_terms"))
    once = met.groupBy(*k, "_text", F.col("_of.term").alias("term")).agg(F.max(F.col("_of._weight") * F.col("_times")).alias("_weight"), *kinds)
    hits = once.select(*k, "_weight", "_skips", "_prefers").unionByName(rest.select(*k, "_weight", "_skips", "_prefers")).groupBy(*k).agg(
        F.coalesce(F.sum("_weight"), F.lit(0)).cast("int").alias("_score"), *kinds)
    j = items.join(hits, k, "left")
    return j.select(*items.columns, F.coalesce("_score", F.lit(0)).alias("score"),
                    F.coalesce(F.col("_skips") & ~F.col("_prefers"), F.lit(False)).alias("dropped"))


def categorise_by_table(picks: DataFrame, rules: DataFrame, default: str = "General",
                        keys: tuple[str, ...] = ("digest_type", "item_no")) -> DataFrame:
    """``categorise`` with the rules of a table (K3); the rules are numbered in their order, and the least number leads."""
    k = list(keys)
    each = rule_terms(rules.filter(F.col("kind") == "category"), _first=F.min(F.struct("priority", "label")))
    each = reliable_checkpoint(each.orderBy("_first")).withColumn("_no", F.monotonically_increasing_id())
    words, inside, rest = term_match.in_words(picks.select(*k, haystack().alias("_hay")), "_hay", k, each, ("_no",))
    least = [F.min("_no").alias("_no")]
    hits = words.join(by_word(inside, least, least), "word").select(*k, "_no").unionByName(rest.select(*k, "_no"))
    best = hits.groupBy(*k).agg(*least).join(each.select("_no", F.col("_first.label").alias("_label")), "_no").drop("_no")
    return picks.join(best, k, "left").withColumn("category", F.coalesce("_label", F.lit(default))).drop("_label")


def top_with_floor(scored: DataFrame, group_cols=("digest_type",)) -> DataFrame:
    """Keep ``least(20, greatest(15, #positive))`` best items per group, never under 10 while items exist (K2).

    Items that a skip rule dropped rank after all others and only fill up to
    ``PICK_LEAST``.  Ranking is by score, then the pass order ``item_no``.  At
    most ``PICK_MAX`` items can be kept, so ``row_number() <= PICK_MAX`` (a
    literal bound) lets Spark cut every map partition to 20 rows per group
    before the shuffle (partial ``WindowGroupLimit``); positives and kept items
    are counted within those 20, where the best come first.
    """
    g = list(group_cols)
    w = Window.partitionBy(*g).orderBy(F.col("dropped").asc(), F.col("score").desc(), F.col("item_no").asc())
    ranked = (scored.withColumn("pick_rank", F.row_number().over(w).cast("bigint"))
              .filter(F.col("pick_rank") <= PICK_MAX))
    whole = Window.partitionBy(*g)
    positive = F.count_if(~F.col("dropped") & (F.col("score") > 0)).over(whole)
    live = F.count_if(~F.col("dropped")).over(whole)
    target = F.greatest(F.least(live, F.greatest(F.lit(PICK_AIM), positive)), F.lit(PICK_LEAST))
    return ranked.withColumn("_target", target).filter(F.col("pick_rank") <= F.col("_target")).drop("_target")


def categorise(picks: DataFrame, rules: Iterable[dict], default: str = "General") -> DataFrame:
    """Category of each pick: the matching ``category`` rule with the lowest priority (K3)."""
    cat_rules = [r for r in rules if r["kind"] == "category"]
    hits = F.filter(rules_literal(cat_rules), lambda r: F.contains(F.col("_hay"), r["term"]))
    best = F.array_min(F.transform(hits, lambda r: F.struct(r["priority"].alias("p"),
                                                             r["label"].alias("l"))))
    return (picks.withColumn("_hay", haystack())
            .withColumn("category", F.coalesce(best["l"], F.lit(default))).drop("_hay"))


def category_counts(categorised: DataFrame) -> DataFrame:
    """Categories with at least one pick (others are omitted)."""
    return categorised.groupBy("digest_type", "category").agg(
        F.count(F.lit(1)).alias("n_picks"), F.min("pick_rank").alias("first_rank"))


def org_groups(picks: DataFrame) -> DataFrame:
    """Picks grouped by org; orgs without picks are omitted from the body."""
    return picks.groupBy("digest_type", "org").agg(
        F.count(F.lit(1)).alias("n_picks"), F.min("pick_rank").alias("best_rank"))


def terms(df: DataFrame, text_col: str, key_cols: list[str], min_len: int = TERM_LETTERS) -> DataFrame:
    """Distinct lower-cased letter runs of at least ``min_len`` characters per row."""
    words = F.filter(F.array_distinct(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))),
                                              TERM_SPLIT)),
                     lambda w: F.length(w) >= min_len)
    return df.select(*key_cols, F.explode(words).alias("term"))


def with_whole_text(articles: DataFrame, entries: DataFrame) -> DataFrame:
    """Articles with ``text``: the title and the whole cleaned summary of their entry, which ``summary`` cuts."""
    whole = entries.select("digest_type", "source_idx", "pos", F.concat_ws(
        " ", F.coalesce("title", F.lit("")), tx.clean_html(tx.summary_fallback("summary", "description"), None)).alias("text"))
    return articles.join(whole, ["digest_type", "source_idx", "pos"])


def theme_candidates(items: DataFrame, min_len: int = TERM_LETTERS) -> DataFrame:
    """Terms shared by at least two items from at least two orgs, per type.

    Terms are those of ``text`` (``with_whole_text``) where the items have it, else
    of title and summary.  Counted in two steps: items for each term and org,
    combined before the shuffle and spread by the org, so a term that every
    item has is in no single task; then orgs, a row each.
    """
    whole = items.withColumn("_text", F.col("text") if "text" in items.columns else F.concat_ws(" ", "title", "summary"))
    t = terms(whole, "_text", ["digest_type", "item_no", "org"], min_len)
    by_org = t.groupBy("digest_type", "term", "org").agg(F.count(F.lit(1)).alias("n"))
    agg = by_org.groupBy("digest_type", "term").agg(
        F.sum("n").alias("n_items"), F.count("org").alias("n_orgs"))
    return agg.filter((F.col("n_items") >= 2) & (F.col("n_orgs") >= 2))


def cross_item_themes(items: DataFrame, top: int = THEMES_TOP, min_len: int = TERM_LETTERS) -> DataFrame:
    """Top cross-item themes per type by item count (K4).

    The ``rn <= k`` filter sits right above the window, so Spark limits each map
    partition to k rows per type before the shuffle.
    """
    cand = theme_candidates(items, min_len)
    w = Window.partitionBy("digest_type").orderBy(F.col("n_items").desc(), F.col("term").asc())
    return (cand.withColumn("theme_rank", F.row_number().over(w))
            .filter(F.col("theme_rank") <= top))


def run_sequence(runs: DataFrame) -> DataFrame:
    """``seq`` = 1..n per type in (run_date, created_at, id) order."""
    order = [F.col("run_date").asc(), F.col("created_at").asc(), F.col("id").asc()]
    return dense_ordinal(runs.select("id", "digest_type", "run_date", "created_at"),
                         ["digest_type"], order, "seq")


def run_continuity(runs: DataFrame, min_len: int = TERM_LETTERS) -> DataFrame:
    """Per consecutive pair of runs of a type: term continuing / new / dropped (K5).

    Each run's terms are emitted once for its own place and once for the next
    run's; one aggregate on (type, seq, term) tells which of the two held it.
    """
    seq = run_sequence(runs)
    run_terms = terms(runs.join(seq.select("id", "seq"), "id"), "markdown",
                      ["digest_type", "seq"], min_len)
    place = F.explode(F.array(
        F.struct(F.col("seq").alias("seq"), F.lit(True).alias("cur")),
        F.struct((F.col("seq") + 1).alias("seq"), F.lit(False).alias("cur"))))
    both = run_terms.select("digest_type", "term", place.alias("at")).select("digest_type", "at.seq", "term", "at.cur")
    held = both.groupBy("digest_type", "seq", "term").agg(
        F.bool_or("cur").alias("_cur"), F.bool_or(~F.col("cur")).alias("_prev"))
    existing = seq.select("digest_type", "seq").filter(F.col("seq") > 1)
    j = held.join(existing, ["digest_type", "seq"], "left_semi")
    status = (F.when(F.col("_cur") & F.col("_prev"), F.lit("continuing"))
              .when(F.col("_cur"), F.lit("new")).otherwise(F.lit("dropped")))
    return j.select("digest_type", "seq", "term", status.alias("status"))


def thread_memory(runs: DataFrame, as_of, stale_days: int = 14, top: int = MEMORY_MAX,
                  min_len: int = TERM_LETTERS) -> DataFrame:
    """Established (>= 2 runs) vs emerging threads, stale ones dropped, top ``top`` per type (K6)."""
    t = terms(runs, "markdown", ["digest_type", "id", "run_date"], min_len)
    agg = t.groupBy("digest_type", "term").agg(
        F.count(F.lit(1)).alias("n_runs"), F.max("run_date").alias("last_seen"))
    fresh = agg.filter(F.col("last_seen") >= F.date_sub(F.lit(str(as_of)[:10]).cast("date"),
                                                        stale_days))
    w = Window.partitionBy("digest_type").orderBy(F.col("n_runs").desc(), F.col("last_seen").desc(),
                                                  F.col("term").asc())
    ranked = fresh.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)
    return ranked.withColumn("status", F.when(F.col("n_runs") >= 2, F.lit("established"))
                             .otherwise(F.lit("emerging")))


def unpitched(candidates: DataFrame, pitched: DataFrame) -> DataFrame:
    """Candidate themes not yet in the pitch log (K7)."""
    return candidates.join(pitched.select("digest_type", "term").distinct(), ["digest_type", "term"],
                           "left_anti")


def index_audit(items: DataFrame, doc_urls: DataFrame, run_col: str = "run_id") -> DataFrame:
    """Input items whose link is absent from their run's generated document (K8)."""
    linked = items.filter(F.col("link") != "")
    urls = doc_urls.select(run_col, F.col("url").alias("link"))
    return linked.join(urls, [run_col, "link"], "left_anti")


def kept_counts(items: DataFrame, doc_urls: DataFrame, run_col: str = "run_id") -> DataFrame:
    """Fetched vs kept items per run; kept = link present in the document (K9)."""
    urls = doc_urls.select(run_col, F.col("url").alias("link"))
    kept = (items.filter(F.col("link") != "").join(urls, [run_col, "link"], "left_semi")
            .groupBy(run_col).agg(F.count(F.lit(1)).alias("kept")))
    fetched = items.groupBy(run_col).agg(F.count(F.lit(1)).alias("fetched"))
    return fetched.join(kept, run_col, "left").select(
        run_col, "fetched", F.coalesce(F.col("kept"), F.lit(0)).alias("kept"))
