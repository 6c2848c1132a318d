"""URL filter by a tree of path templates, in DataFrame operations only.

Per host, path segments that vary become wildcards: by form (numbers, long
codes) and by statistics (a node most of whose children are seen once). The
tree's nodes hold how many of their URLs a rule has labelled, and how many of
those as blocked. Under each parent, branches whose blocked shares don't differ
by more than chance (a Hoeffding bound, as in state merging) are merged and
share their counts; branches without labels merge with them too. A template's
purity is its blocked share, smoothed towards that of the same template over
all hosts, which is smoothed towards its parent there, up to the root.
Templates whose purity reaches the threshold are rejected.

Counts are combined by (host, path form) before any join, so a host that holds
a third of all URLs is a few rows a task. Paths have any depth: a node is known
by the digest of its path, and a template's purity is one fold over its nodes.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedweave.llm.batches import written


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The rules of the query's contract.
RULES = (Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"), Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"))

#: A node with at least so many children, on average seen at most so often, has variable children.
VARIABLE_CHILDREN, VARIABLE_MEAN = 20, 2.0
#: Error probability of the merge test; weight of the smoothing; purity from which a template is rejected.
MERGE_ALPHA, SMOOTHING, THRESHOLD = 0.05, 4.0, 0.5

_SEP = "/"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first :// (A-Z in lower case) and path without query and fragment; both empty without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _by_rule(rules: tuple[Rule, ...], value) -> Column:
    """value(rule) of the longest rule that fits; null if none does."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        out = F.when(fits, F.lit(value(r))).otherwise(out)
    return out


def _forms(path: Column) -> Column:
    """The path's segments with numbers and long codes replaced by wildcards."""
    parts = F.filter(F.split(path, _SEP), lambda s: s != "")
    return F.transform(parts, lambda s: F.regexp_replace(F.when(s.rlike(r"^(?=.*[0-9])[0-9A-Fa-f-]{12,}$"), F.lit("<x>")).otherwise(s), "[0-9]+", "<n>"))


def _node(forms: str, level: str) -> Column:
    """The node that the first segments lead to: a digest, so that the nodes of a deep path don't each carry it."""
    return F.expr(f"md5(array_join(slice({forms}, 1, {level}), '{_SEP}'))")


def _merged(nodes: DataFrame, parent: list[str]) -> DataFrame:
    """Nodes with l_eff and b_eff: of all branches of their parent that don't differ from it, or else their own."""
    whole = nodes.groupBy(*parent).agg(F.sum("l").alias("all_l"), F.sum("b").alias("all_b"))
    width = math.sqrt(0.5 * math.log(2 / MERGE_ALPHA))
    alike = (F.col("l") == 0) | (F.abs(F.col("b") / F.col("l") - F.col("all_b") / F.col("all_l")) <= width * (1 / F.sqrt("l") + 1 / F.sqrt("all_l")))
    tested = nodes.join(whole, parent).withColumn("alike", alike)
    pool = tested.where("alike").groupBy(*parent).agg(F.sum("l").alias("pl"), F.sum("b").alias("pb"))
    return tested.join(pool, parent, "left").select(*nodes.columns, F.when(F.col("alike"), F.col("pl")).otherwise(F.col("l")).alias("l_eff"), F.when(F.col("alike"), F.col("pb")).otherwise(F.col("b")).alias("b_eff"))


def filter_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "page_id", url_col: str = "url", threshold: float = THRESHOLD, smoothing: float = SMOOTHING) -> DataFrame:
    """One row per page: id, host, path, rule, verdict, template.

    Null urls and urls without :// have an empty host and path and are judged
    like any other host. Null ids and repeated rows pass through; repeated rows
    count as often as they appear. Without any labelled URL the purity is a
    half, which the threshold of a half rejects. A path of any number of
    segments is judged by all of them. Other columns are not read; an empty
    table gives an empty result.
    """
    host, path = host_and_path(F.col(url_col).cast("string"))
    urls = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    urls = urls.withColumns({"rule": _by_rule(rules, lambda r: r.text), "said": _by_rule(rules, lambda r: r.verdict), "forms": _forms(F.col("path"))})

    shapes = urls.groupBy("host", "forms").agg(F.count(F.lit(1)).alias("n"), F.count("said").alias("l"), F.sum(F.when(F.col("said") == "block", 1).otherwise(0)).cast("long").alias("b"))
    shapes = written(shapes.withColumn("shape", F.md5(F.concat_ws(_SEP, F.col("host"), F.array_join("forms", _SEP)))), "url-shapes")
    # children that vary: one row for each node and child, then for each node
    levels = shapes.select("host", "shape", "forms", "n", F.explode(F.sequence(F.lit(1), F.greatest(F.size("forms"), F.lit(1)))).alias("k")).where(F.col("k") <= F.size("forms"))
    levels = levels.select("host", "shape", "n", "k", _node("forms", "k - 1").alias("parent"), F.expr("forms[k - 1]").alias("form"))
    child = levels.groupBy("host", "k", "parent", "form").agg(F.sum("n").alias("n"))
    vary = child.groupBy("host", "k", "parent").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("n")).where((F.col("c") >= VARIABLE_CHILDREN) & (F.col("n") <= VARIABLE_MEAN * F.col("c"))).select("host", "k", "parent", F.lit(True).alias("varies"))
    named = levels.join(vary, ["host", "k", "parent"], "left").select("shape", F.struct("k", F.when(F.col("varies"), F.lit("<any>")).otherwise(F.col("form")).alias("form")).alias("part"))
    # as many parts as the path has segments
    templates = named.groupBy("shape").agg(F.expr("transform(array_sort(collect_list(part)), x -> x.form)").alias("template"))
    shapes = shapes.join(templates, "shape", "left").withColumn("template", F.coalesce("template", F.array().cast("array<string>")))
    shapes = written(shapes.withColumn("node", _node("template", "size(template)")), "url-templates")

    nodes = shapes.select("host", "l", "b", "template", F.explode(F.sequence(F.lit(0), F.size("template"))).alias("k")).select(
        "host", "k", _node("template", "k").alias("node"), F.when(F.col("k") > 0, _node("template", "k - 1")).otherwise(F.lit("")).alias("parent"), "l", "b")
    nodes = written(nodes.groupBy("host", "k", "node", "parent").agg(F.sum("l").alias("l"), F.sum("b").alias("b")), "url-nodes")

    # the same templates over all hosts: purity from the root down, along each template's nodes
    everywhere = _merged(nodes.groupBy("k", "node", "parent").agg(F.sum("l").alias("l"), F.sum("b").alias("b")), ["k", "parent"]).select("k", "node", "l_eff", "b_eff")
    ends = shapes.groupBy("node").agg(F.first("template").alias("template")).withColumnRenamed("node", "end")
    steps = ends.select("end", "template", F.explode(F.sequence(F.lit(0), F.size("template"))).alias("k")).select("end", "k", _node("template", "k").alias("node"))
    steps = steps.join(everywhere, ["k", "node"]).groupBy("end").agg(F.array_sort(F.collect_list(F.struct("k", "b_eff", "l_eff"))).alias("steps"))
    known = steps.select(F.col("end").alias("node"), F.aggregate("steps", F.lit(0.5), lambda above, x: (x["b_eff"] + smoothing * above) / (x["l_eff"] + smoothing)).alias("p"))
    own = _merged(nodes, ["host", "k", "parent"]).join(known, "node").select("host", "node", ((F.col("b_eff") + smoothing * F.col("p")) / (F.col("l_eff") + smoothing)).alias("purity"))
    judged = shapes.join(own, ["host", "node"]).select("host", "forms", F.array_join("template", _SEP).alias("path_form"), "purity")
    out = urls.join(judged, ["host", "forms"])
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("said", F.when(F.col("purity") >= threshold, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), F.concat(F.lit(_SEP), "path_form").alias("template"))
