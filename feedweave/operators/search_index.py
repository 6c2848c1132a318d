"""History search by an inverted index of trigrams.

``build`` keeps, for every run, the distinct trigrams of its lower-cased
markdown as rows ``(trigram, id, run_date)``, stored by a hash of the trigram
(``slot`` folders) and sorted by trigram, so a lookup reads a few row groups of
a few folders.  Counts of runs for each trigram are kept beside them.

``search`` takes a term as ``history.search`` does.  What must stand literally
in a match are the pattern's parts between wildcards; of their trigrams the
rarest are intersected, and ``ilike`` decides on the runs that have them all.
Only those bodies are read.  A pattern without a literal part of three
characters falls back to the scan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedweave.operators import history
from feedweave.operators.common import sized_broadcast
from feedweave.session import reliable_checkpoint

SLOTS = 64
# Trigrams whose lists are intersected.
RAREST = 4
# Runs whose ids go into the scan's filter; more are joined.
FILTER_IDS = 1000

_POSTING = "trigram string, id bigint, run_date date, slot int"
_COUNT = "trigram string, n bigint, slot int"


@dataclass(frozen=True)
class Index:
    path: str
    slots: int = SLOTS


def trigrams(text: Column) -> Column:
    """Distinct runs of three characters of the lower-cased text, in time linear in its length."""
    chars = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), ""), lambda c: c != "")
    # side by side instead of by position: a lambda would split the text again for every character
    beside = F.arrays_zip(chars, F.slice(chars, 2, F.greatest(F.size(chars) - 1, F.lit(0))), F.slice(chars, 3, F.greatest(F.size(chars) - 2, F.lit(0))))
    three = F.transform(beside, lambda z: F.concat(z["0"], z["1"], z["2"]))
    return F.array_distinct(F.filter(three, lambda t: t.isNotNull()))


def _slot(trigram: Column, slots: int) -> Column:
    return F.pmod(F.xxhash64(trigram), F.lit(slots)).cast("int")


def build(runs: DataFrame, path: str, slots: int = SLOTS) -> Index:
    """Index runs (``id, run_date, markdown``) into a new folder."""
    return add(Index(path, slots), runs)


def add(index: Index, runs: DataFrame) -> Index:
    """Index more runs.  A run indexed again keeps its entries: the search counts distinct trigrams and looks at the bodies."""
    each = runs.select("id", "run_date", F.explode(trigrams(F.col("markdown"))).alias("trigram")).withColumn("slot", _slot(F.col("trigram"), index.slots))
    each = reliable_checkpoint(each.distinct())
    # a slot holds many trigrams, a hot trigram many runs: ranges of (slot, trigram, id) spread both
    (each.repartitionByRange("slot", "trigram", "id").sortWithinPartitions("slot", "trigram", "id")
     .write.mode("append").partitionBy("slot").parquet(f"{index.path}/postings"))
    (each.groupBy("slot", "trigram").agg(F.count(F.lit(1)).alias("n")).repartitionByRange("slot", "trigram")
     .sortWithinPartitions("slot", "trigram").write.mode("append").partitionBy("slot").parquet(f"{index.path}/counts"))
    return index


def literal_parts(pattern: str) -> list[str]:
    """The parts of a LIKE pattern (backslash escapes) that stand literally in every match."""
    parts, own, i = [], "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            own += pattern[i + 1]
            i += 1
        elif c in "%_":
            parts.append(own)
            own = ""
        else:
            own += c
        i += 1
    return [p for p in [*parts, own] if p]


def needed(spark: SparkSession, pattern: str, slots: int = SLOTS) -> list[tuple[str, int]]:
    """Trigrams, with their slots, that every body matching the pattern has; lower-cased and cut as the bodies are."""
    low = spark.range(1).select(F.lower(F.lit(pattern))).first()[0]
    parts = literal_parts(low)
    if not parts:
        return []
    cut = spark.createDataFrame([(p,) for p in parts], "part string").select(F.explode(trigrams(F.col("part"))).alias("trigram")).distinct()
    return [(r["trigram"], r["slot"]) for r in cut.withColumn("slot", _slot(F.col("trigram"), slots)).collect()]


def _lists(spark: SparkSession, path: str, schema: str, wanted: list[tuple[str, int]]) -> DataFrame:
    """Rows of the trigrams, from their slots and row groups only."""
    rows = spark.read.schema(schema).parquet(path)
    return rows.filter(F.col("slot").isin(sorted({s for _, s in wanted})) & F.col("trigram").isin([t for t, _ in wanted]))


def candidates(spark: SparkSession, index: Index, term: str) -> DataFrame | None:
    """``id, run_date`` of the runs whose markdown may match; None if the index can't tell."""
    pattern = history.like_pattern(term)
    wanted = needed(spark, pattern, index.slots) if pattern else []
    if not wanted:
        return None
    n = {r["trigram"]: r["n"] for r in _lists(spark, f"{index.path}/counts", _COUNT, wanted).groupBy("trigram").agg(F.sum("n").alias("n")).collect()}
    rarest = sorted(wanted, key=lambda t: (n.get(t[0], 0), t))[:RAREST]
    rows = _lists(spark, f"{index.path}/postings", _POSTING, rarest)
    if any(t not in n for t, _ in wanted):
        return rows.select("id", "run_date").limit(0)  # one that no run has
    return (rows.groupBy("id", "run_date").agg(F.count_distinct("trigram").alias("n")).filter(F.col("n") == len(rarest)).select("id", "run_date"))


def search(runs: DataFrame, index: Index, term: str = "") -> DataFrame:
    """``history.search(runs, term)`` by the index; the bodies that are read are the candidates'.

    A few candidates go as a filter into the scan (folders of their dates, row
    groups of their ids); more are joined.  Dates that match the term by their
    text need no body.
    """
    pattern = history.like_pattern(term)
    if pattern is None:
        return runs
    spark = runs.sparkSession
    found = candidates(spark, index, term)
    if found is None:
        return history.search(runs, term)
    found = reliable_checkpoint(found)
    some = found.limit(FILTER_IDS + 1).collect()
    if len(some) <= FILTER_IDS:
        near = runs.filter(F.col("run_date").isin(sorted({r["run_date"] for r in some})) & F.col("id").isin(sorted({r["id"] for r in some}))) if some else runs.limit(0)
    else:
        near = runs.join(sized_broadcast(found.select("id")), "id", "left_semi")
    dated = F.coalesce(F.col("run_date").cast("string").ilike(pattern), F.lit(False))
    # a run is in one part only
    return near.filter(F.col("markdown").ilike(pattern) & ~dated).select(*runs.columns).unionByName(runs.filter(dated))
