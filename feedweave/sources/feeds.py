"""Landed feed documents (RSS 2.0 / Atom) to entry rows.

Layout: ``<landing>/digest_type=<t>/source_idx=<i>/<file>``; Spark's partition
discovery supplies both keys.  Each file is read whole, split into ``<item>`` /
``<entry>`` fragments (so one malformed item or a truncated tail does not lose
the intact entries before it), and each fragment is parsed with ``from_xml``.
``pos`` is the fragment's position in its feed, so per-source caps are plain
filters.  A file that yields no fragment and is not a closed feed document is
reported ``malformed``; it never fails the job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedweave.functions import text as tx

FRAGMENT_RE = r"(?s)<(item|entry)(?:\s[^>]*)?>.*?</\1>"

# HTML entities that feeds use and XML doesn't define.
HTML_ENTITIES = {"nbsp": 160, "copy": 169, "reg": 174, "eacute": 233, "ndash": 8211, "mdash": 8212, "lsquo": 8216,
                 "rsquo": 8217, "ldquo": 8220, "rdquo": 8221, "bull": 8226, "hellip": 8230, "trade": 8482}

RSS_ITEM_DDL = ("title string, link string, guid string, author string, `dc:creator` string, "
                "description string, `content:encoded` string, pubDate string, `dc:date` string")
ATOM_ENTRY_DDL = ("id string, title string, summary string, content string, "
                  "link array<struct<_href:string,_rel:string>>, author struct<name:string>, "
                  "published string, updated string, created string")


def read_landed(spark: SparkSession, landing_dir: str) -> DataFrame:
    """One row per landed file: ``digest_type, source_idx, path, value``."""
    return (spark.read.option("recursiveFileLookup", False).text(landing_dir, wholetext=True)
            .withColumn("path", F.col("_metadata.file_path"))
            .withColumn("source_idx", F.col("source_idx").cast("int")))


def feed_status(docs: DataFrame) -> DataFrame:
    """Per file: entry fragments, those of them that can't be parsed, and ``ok`` / ``empty`` / ``malformed`` (A4)."""
    v = F.col("value")
    frags = F.regexp_extract_all(v, F.lit(FRAGMENT_RE), 0)
    closed = v.rlike(r"(?s)</rss>\s*$") | v.rlike(r"(?s)</feed>\s*$") | v.rlike(r"(?s)</rdf:RDF>\s*$")
    each = _parsed(docs.select("digest_type", "source_idx", "path", closed.alias("closed"), F.explode_outer(frags).alias("frag")))
    n, bad = F.col("n_entries"), F.col("n_bad")
    return (each.groupBy("digest_type", "source_idx", "path", "closed")
            .agg(F.count("frag").alias("n_entries"), F.count_if(F.col("frag").isNotNull() & ~F.col("good")).alias("n_bad"))
            .select("digest_type", "source_idx", "path", n.cast("int").alias("n_entries"), bad.cast("int").alias("n_bad"),
                    F.when(n > bad, F.lit("ok")).when((n == 0) & F.col("closed"), F.lit("empty"))
                    .otherwise(F.lit("malformed")).alias("status")))


def _repaired(frag: Column) -> Column:
    """The fragment with entities that XML doesn't define as references."""
    for name, code in HTML_ENTITIES.items():
        frag = F.replace(frag, F.lit(f"&{name};"), F.lit(f"&#{code};"))
    # any other ampersand that starts no reference stands for itself
    return F.regexp_replace(frag, r"&(?!(?:amp|lt|gt|quot|apos|#[0-9]+|#[xX][0-9A-Fa-f]+);)", "&amp;")


def _parsed(frags: DataFrame) -> DataFrame:
    """Add ``r`` (an RSS item) or ``a`` (an Atom entry), and ``good``: whether the fragment could be parsed.

    Each fragment is parsed once, and a second time, repaired, only if it isn't
    well formed.  The parses are the outputs of generators: as plain columns
    they would be computed again for every field that is read from them.
    """
    is_item = F.col("frag").startswith("<item")
    options = {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"}

    def parse(frag: Column) -> Column:
        return F.struct(F.when(is_item, F.from_xml(frag, RSS_ITEM_DDL + ", _bad string", options)).alias("r"),
                        F.when(~is_item, F.from_xml(frag, ATOM_ENTRY_DDL + ", _bad string", options)).alias("a"))

    bad = lambda p: F.coalesce(p["r"]["_bad"], p["a"]["_bad"]).isNotNull()
    once = frags.select("*", F.explode(F.array(parse(F.col("frag")))).alias("_first"))
    again = F.when(bad(F.col("_first")), parse(_repaired(F.col("frag")))).otherwise(F.col("_first"))
    both = once.select("*", F.explode(F.array(again)).alias("_told"))
    told = F.col("_told")
    return both.select(*frags.columns, told["r"].alias("r"), told["a"].alias("a"),
                       (~bad(told) & (told["r"].isNotNull() | told["a"].isNotNull())).alias("good"))


def _fragments(docs: DataFrame) -> DataFrame:
    """One row per item or entry; ``pos`` counts over all files of a source, in path order."""
    path = F.col("path") if "path" in docs.columns else F.lit("").alias("path")
    files = docs.select("digest_type", "source_idx", path,
                        F.regexp_extract_all("value", F.lit(FRAGMENT_RE), 0).alias("_frags"))
    # narrow rows: one per file, without its text
    w = (Window.partitionBy("digest_type", "source_idx").orderBy("path")
         .rowsBetween(Window.unboundedPreceding, -1))
    before = files.select("digest_type", "source_idx", "path", F.size("_frags").alias("_n")).groupBy(
        "digest_type", "source_idx", "path").agg(F.sum("_n").alias("_n")).select(
        "digest_type", "source_idx", "path", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    each = files.select("digest_type", "source_idx", "path", F.posexplode("_frags").alias("_at", "frag"))
    return each.join(before, ["digest_type", "source_idx", "path"]).select(
        "digest_type", "source_idx", (F.col("_at") + F.col("_before")).cast("int").alias("pos"), "frag")


def _or_null(c):
    return F.when(F.trim(c) != "", c)


def parse_entries(docs: DataFrame) -> DataFrame:
    """Entry rows in feed order from RSS items and Atom entries (A3).

    Fields follow common feed-reader conventions: RSS ``description`` (else
    ``content:encoded``) is the summary, ``guid`` the id and, unless it says that
    it is no permalink, the link of an item without one, ``pubDate`` the published
    date; Atom uses ``summary`` (else ``content``), the ``alternate`` (else first)
    link href and ``author/name``.  A fragment that can't be parsed is dropped
    (``feed_status`` counts it), and never becomes a blank article.
    """
    frag = F.col("frag")
    both = _parsed(_fragments(docs)).filter("good")
    links = F.col("a.link")
    alt = F.filter(links, lambda l: F.coalesce(l["_rel"], F.lit("alternate")) == "alternate")
    no_permalink = frag.rlike(r"""<guid[^>]*isPermaLink\s*=\s*["']false["']""")
    rss_link = F.coalesce(_or_null(F.col("r.link")), F.when(~no_permalink, F.col("r.guid")))
    rss_text = F.coalesce(_or_null(F.col("r.description")), F.col("r.`content:encoded`"))
    atom_text = F.coalesce(_or_null(F.col("a.summary")), F.col("a.content"))
    pick = lambda r, a: F.when(F.col("r").isNotNull(), r).otherwise(a)
    out = both.select(
        "digest_type", "source_idx", "pos",
        pick(rss_link, F.coalesce(F.element_at(alt, 1)["_href"], F.element_at(links, 1)["_href"])).alias("link"),
        pick(F.col("r.guid"), F.col("a.id")).alias("entry_id"),
        pick(F.col("r.title"), F.col("a.title")).alias("title"),
        pick(F.coalesce(F.col("r.author"), F.col("r.`dc:creator`")), F.col("a.author.name")).alias("author"),
        pick(rss_text, atom_text).alias("summary"), pick(rss_text, atom_text).alias("description"),
        pick(F.col("r.pubDate"), F.col("a.published")).alias("published"),
        pick(F.col("r.`dc:date`"), F.col("a.updated")).alias("updated"), F.col("a.created").alias("created"))
    return out.withColumn("pub_ts", tx.entry_date("published", "updated", "created"))


def feed_entries(docs: DataFrame, sources: DataFrame) -> DataFrame:
    """Entries joined with their (fetchable, defaulted) source attributes.

    ``sources`` is a configuration table; the join is planned by Spark (AQE
    turns it into a broadcast when it is small).
    """
    src = sources.select("digest_type", "source_idx", "source_name", "org", "category",
                         "source_filter")
    return parse_entries(docs).join(src, ["digest_type", "source_idx"], "inner")
