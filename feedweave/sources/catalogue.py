"""Configuration scans: source catalogues, pass settings, preferences text.

Catalogue files are JSON objects with a ``sources`` array; array order is kept
as ``source_idx`` because source order decides in-run dedup winners.  Settings
files hold a top-level ``dedup_days`` and one object per digest type.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedweave.functions.text import py_strip

# Defaults applied when a key is absent.
UNKNOWN_SOURCE = "Unknown source"
DEFAULT_DEDUP_DAYS = 7

SOURCE_SCHEMA = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("org", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("feed_url", T.StringType()),
    T.StructField("source_filter", T.ArrayType(T.StringType())),
    T.StructField("_disabled", T.BooleanType()),
    T.StructField("_section", T.StringType()),
    T.StructField("verified", T.BooleanType()),
    T.StructField("notes", T.StringType()),
])

CATALOGUE_SCHEMA = T.StructType([T.StructField("sources", T.ArrayType(SOURCE_SCHEMA))])

TYPE_SETTINGS_DDL = ("days_back int, max_items_per_source int, min_items_to_send int, "
                     "model string")


def read_catalogue(spark: SparkSession, path: str | list[str], digest_type: str | Column | None = None) -> DataFrame:
    """One row per catalogue entry with ``source_idx`` = position in the array (A1).

    ``digest_type`` names the pass; when omitted it is taken from the name of
    each file (``.../<digest_type>_sources.json``), else from its parent directory
    (``.../<digest_type>/sources.json``), or left NULL.  ``path`` may be a list.
    """
    raw = (spark.read.schema(CATALOGUE_SCHEMA).option("multiLine", True).json(path)
           .withColumn("_file", F.col("_metadata.file_path")))
    rows = raw.select("_file", F.posexplode("sources").alias("source_idx", "s")).select(
        "_file", F.col("source_idx").cast("int").alias("source_idx"), "s.*")
    if digest_type is None:
        own = F.regexp_extract("_file", r"/([^/]+)_sources\.json$", 1)
        folder = F.regexp_extract("_file", r"/([^/]+)/[^/]+$", 1)
        dtype = F.coalesce(F.when(own != "", own), F.when(folder != "", folder))
    elif isinstance(digest_type, str):
        dtype = F.lit(digest_type)
    else:
        dtype = digest_type
    return rows.withColumn("digest_type", dtype).drop("_file")


def active_sources(catalogue: DataFrame) -> DataFrame:
    """Entries that have a ``feed_url`` key; disabled ones stay (they are counted) (B1)."""
    return catalogue.filter(F.col("feed_url").isNotNull())


def with_source_defaults(catalogue: DataFrame) -> DataFrame:
    """Absent-key defaults: name, org -> name, '' category / url, [] filter (B2)."""
    name = F.coalesce(F.col("name"), F.lit(UNKNOWN_SOURCE))
    return catalogue.select(
        "digest_type", "source_idx",
        name.alias("source_name"),
        F.coalesce(F.col("org"), name).alias("org"),
        F.coalesce(F.col("category"), F.lit("")).alias("category"),
        F.coalesce(F.col("feed_url"), F.lit("")).alias("feed_url"),
        F.coalesce(F.col("source_filter"), F.array().cast("array<string>")).alias("source_filter"),
        F.coalesce(F.col("_disabled"), F.lit(False)).alias("disabled"),
        F.col("_section").isNotNull().alias("is_section"),
    )


def fetchable_sources(sources: DataFrame) -> DataFrame:
    """Drop section markers, disabled sources and empty URLs before any entry is read."""
    return sources.filter(~F.col("is_section") & ~F.col("disabled") & (F.col("feed_url") != ""))


def read_settings(spark: SparkSession, path: str) -> DataFrame:
    """One row per digest type from a settings JSON object (A2).

    Keys starting with ``_`` are comments.  ``dedup_days`` defaults to 7.
    """
    doc = spark.read.text(path, wholetext=True)
    kv = doc.select(F.from_json("value", "map<string,string>").alias("m"))
    dedup = F.coalesce(F.col("m")["dedup_days"].cast("int"), F.lit(DEFAULT_DEDUP_DAYS))
    entries = kv.select(dedup.alias("dedup_days"), F.explode("m").alias("digest_type", "v"))
    typed = entries.filter(~F.col("digest_type").startswith("_")
                           & F.col("v").startswith("{"))
    parsed = typed.select("digest_type", "dedup_days",
                          F.from_json("v", TYPE_SETTINGS_DDL).alias("s"))
    return parsed.select("digest_type", "s.days_back", "s.max_items_per_source",
                         "s.min_items_to_send", "s.model", "dedup_days")


def read_preferences(spark: SparkSession, path: str) -> str:
    """Free-text preferences, stripped; ``''`` when the file is absent (A5)."""
    try:
        row = spark.read.text(path, wholetext=True).select(py_strip("value").alias("v")).first()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return ""  # no preferences
    return (row.v or "") if row else ""
