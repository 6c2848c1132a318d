"""Merkle manifest of a dataset: levels built once and stored, proofs folded by a recursive query.

A row's leaf is the digest of its fields. The leaves of a source ascend by id;
every ``fan`` consecutive nodes of a level become the digest of their digests,
until one is left, the source's subroot. The subroots, ordered by source, make
the top tree in the same way; its last node is the root.

1. Leaves are numbered within their source by range partitions and offsets, so
   a source that has a third of all rows is in no single task. Runs of ``fan``
   leaves are grouped, then runs of nodes level by level; each level is
   written. A run's row has its own key, its children's digests, its place in
   the run above, and that run's key: its parent link.
2. The leaves of one run share every sibling above the run, so they ascend in
   one row. ``WITH RECURSIVE`` joins these rows with the run that they reach,
   appends the siblings there to the proof and folds each leaf's digest with
   them. Of a run with many leaves below it, there are as many copies as keep
   ``RUNS_PER_COPY`` rows at one key, so the upper levels are no hot keys.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedweave.llm.batches import written
from feedweave.operators.common import dense_ordinal, sized_broadcast

#: Consecutive nodes that become one.
FAN = 16
#: Climbing rows (of up to FAN leaves each) that meet one copy of a run.
RUNS_PER_COPY = 4096

#: The tree of the subroots; sources have tags that start with 0 (null) or 1.
_TOP = ""


def digest(*fields: Column) -> Column:
    """Lowercase hex SHA-256 of the fields, one after the other: ``-`` for null, else UTF-8 byte count, ``:`` and value."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*(F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts)), 256)


@dataclass(frozen=True)
class Manifest:
    """runs: the rows that climb, one for each run of leaves; nodes: stored runs with parent links; trees: number of sources."""

    runs: DataFrame
    nodes: DataFrame
    trees: int


def _joined(hashes: Column) -> Column:
    """Digests, kept as 32 bytes each, as the hex text that is hashed."""
    return F.array_join(F.transform(hashes, lambda h: F.lower(F.hex(h))), "")


def _hashed(hashes: Column) -> Column:
    return F.unhex(F.sha2(_joined(hashes), 256))


def _above(level: Column, trees: int, fan: int) -> list[Column]:
    """Key of the run above a node and the node's place in it; null above the root. Reads tag, idx, width and pos."""
    inside, last = F.col("width") > 1, (F.col("tag") != _TOP) & F.lit(trees > 1)

    def pick(a: Column, b: Column, name: str) -> Column:
        return F.when(inside, a).when(last, b).alias(name)

    return [pick(F.col("tag"), F.lit(_TOP), "up_tag"), pick(level + 1, F.lit(1), "up_level"), pick(F.expr(f"idx div {fan}"), F.expr(f"pos div {fan}"), "up_idx"),
            pick(F.col("idx") % fan, F.col("pos") % fan, "place").cast("int").alias("place")]


def _levels(base: DataFrame, width: int, fan: int, name: str) -> list[DataFrame]:
    """The written levels above base (tag, idx, hash, width, pos, runs), which holds at most ``width`` nodes a tree."""
    out, now, level = [], base, 0
    while width > 1:
        level += 1
        kids = F.array_sort(F.collect_list(F.struct("idx", "hash")))
        up = now.where("width > 1").groupBy("tag", F.expr(f"idx div {fan}").alias("up")).agg(
            kids.alias("kids"), F.first("width").alias("width"), F.first("pos").alias("pos"), F.sum("runs").alias("runs"))
        now = written(up.select("tag", F.lit(level).alias("level"), F.col("up").alias("idx"), _hashed(F.col("kids.hash")).alias("hash"),
                                F.col("kids.hash").alias("kids"), F.expr(f"(width + {fan - 1}) div {fan}").alias("width"), "pos", "runs"), f"merkle-{name}-{level}")
        out.append(now)
        width = -(-width // fan)
    return out


def build(docs: DataFrame, recorded: Column, held: Column | None = None, source_col: str = "source", id_col: str = "doc_id", fan: int = FAN) -> Manifest | None:
    """The manifest over ``recorded``, the digest of each row; ``held`` is the digest of the row as it is now (the same, if None). None for an empty table.

    Sources ascend with null first, then by UTF-8 bytes; ids ascend with null
    first; rows that repeat an id ascend by digest, so repeated rows of one
    content may change places without effect. Texts are hashed where they are
    read, however long; only digests move.
    """
    if fan < 2:
        raise ValueError("a run has two nodes at least")
    tag = F.when(F.col(source_col).isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col(source_col).cast("string")))
    rows = docs.select(tag.alias("tag"), F.col(id_col).alias("id"), F.unhex(recorded).alias("leaf"), (F.lit(None).cast("binary") if held is None else F.when(held != recorded, F.unhex(held))).alias("held"), F.monotonically_increasing_id().alias("row"))
    leaves = dense_ordinal(written(rows, "merkle-leaves"), ["tag"], [F.col("id").asc_nulls_first(), F.col("leaf"), F.coalesce("held", "leaf"), F.col("row")], name="n")
    run = written(leaves.groupBy("tag", F.expr(f"(n - 1) div {fan}").alias("run")).agg(F.array_sort(F.collect_list(F.struct("n", "id", "leaf", "held"))).alias("kids")), "merkle-runs")
    sizes = run.groupBy("tag").agg(F.max(F.element_at("kids", -1)["n"]).alias("leaves"))
    sources = written(dense_ordinal(sizes.withColumn("all", F.lit(0)), ["all"], [F.col("tag")], name="pos", max_groups=1).select("tag", "leaves", (F.col("pos") - 1).alias("pos")), "merkle-sources")
    trees, most = sources.agg(F.count(F.lit(1)), F.max("leaves")).first()
    if not trees:
        return None

    # a run of two leaves or more is a node; a lone leaf stands for itself
    lone = F.col("leaves") == 1
    run = run.join(sized_broadcast(sources), "tag").select(
        "tag", F.col("run").alias("idx"), "kids", "pos", lone.alias("lone"), F.expr(f"(leaves + {fan - 1}) div {fan}").alias("width"), F.lit(1).cast("long").alias("runs"),
        F.when(lone, F.col("kids")[0]["leaf"]).otherwise(_hashed(F.col("kids.leaf"))).alias("hash"))
    run = written(run, "merkle-first")
    narrow = ("tag", "idx", "hash", "width", "pos", "runs")
    above = _levels(run.select(*narrow), -(-most // fan), fan, "level")
    # numbers of levels count from the runs of leaves, which are level 1
    nodes = [x.withColumn("level", F.col("level") + 1) for x in above]
    subroots = run.where("width = 1").select(*narrow)
    for x in nodes:
        subroots = subroots.unionByName(x.where("width = 1").select(*narrow))
    top = subroots.select(F.lit(_TOP).alias("tag"), F.col("pos").alias("idx"), "hash", F.lit(trees).cast("long").alias("width"), "pos", "runs")
    nodes += _levels(top, trees, fan, "top")

    spark = docs.sparkSession
    stored = spark.createDataFrame([], "tag string, level int, idx long, hash binary, kids array<binary>, width long, pos long, runs long")
    for x in nodes:
        stored = stored.unionByName(x.select(*stored.columns))
    links = _above(F.col("level"), trees, fan)
    copies = F.ceil(F.col("runs") / RUNS_PER_COPY).cast("int")
    busy = sized_broadcast(stored.where(F.col("runs") > RUNS_PER_COPY).select(F.col("tag").alias("up_tag"), F.col("level").alias("up_level"), F.col("idx").alias("up_idx"), copies.alias("up_copies")))

    def linked(df: DataFrame) -> DataFrame:
        return df.join(busy, ["up_tag", "up_level", "up_idx"], "left").withColumn("up_copies", F.coalesce("up_copies", F.lit(1)))

    nodes = linked(stored.select("tag", "level", "idx", "hash", "kids", F.greatest(copies, F.lit(1)).alias("copies"), *links))
    first = linked(run.select("tag", "idx", "kids", "lone", "hash", *_above(F.lit(1), trees, fan)))
    return Manifest(first, written(nodes, "merkle-nodes"), trees)


def _around(hashes: str, place: str, fan: int) -> tuple[str, str]:
    """The digests before and after a place."""
    return f"slice({hashes}, 1, {place})", f"slice({hashes}, {place} + 2, {fan})"


def _text(hashes: str) -> str:
    return f"array_join(transform({hashes}, h -> lower(hex(h))), '')"


def climb(manifest: Manifest, fan: int = FAN) -> DataFrame:
    """One row per leaf: id, leaf, subroot, root, proof (its siblings' digests joined, level by level, left to right), folded_root, verified.

    folded_root is recomputed from the held digest and the recorded siblings;
    verified tells whether it is the root. Digests move as 32 bytes each and
    become hex text where they are hashed or returned; a held digest that is
    the recorded one isn't stored twice.
    """
    spark = manifest.runs.sparkSession
    left, right = _around("kids.leaf", "i", fan)
    start = written(manifest.runs.selectExpr(
        "tag AS own_tag", "idx AS own_idx", "xxhash64(tag, idx) AS own",
        f"transform(kids, (k, i) -> CASE WHEN lone THEN coalesce(k.held, k.leaf) ELSE unhex(sha2(concat({_text(left)}, lower(hex(coalesce(k.held, k.leaf))), {_text(right)}), 256)) END) AS folded",
        "CAST(NULL AS binary) AS subroot", "hash AS root", "CAST(array() AS array<binary>) AS proof", "up_tag", "up_level", "up_idx", "CAST(pmod(xxhash64(tag, idx), up_copies) AS int) AS up_copy", "place"), "merkle-start")
    copied = manifest.nodes.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    left, right = _around("n.kids", "c.place", fan)
    ascended = spark.sql(f"""
        WITH RECURSIVE climb(own_tag, own_idx, own, folded, subroot, root, proof, up_tag, up_level, up_idx, up_copy, place) AS (
            SELECT * FROM {{start}}
            UNION ALL
            SELECT own_tag, own_idx, own, transform(folded, f -> unhex(sha2(concat({_text('l')}, lower(hex(f)), {_text('r')}), 256))), subroot, root, concat(proof, l, r), up_tag, up_level, up_idx, up_copy, place
            FROM (SELECT c.own_tag, c.own_idx, c.own, c.folded, c.proof, {left} AS l, {right} AS r, n.hash AS root,
                         coalesce(c.subroot, CASE WHEN c.up_tag = '{_TOP}' THEN n.kids[c.place] END) AS subroot,
                         n.up_tag, n.up_level, n.up_idx, CAST(pmod(c.own, n.up_copies) AS int) AS up_copy, n.place
                  FROM climb c JOIN {{nodes}} n ON n.tag = c.up_tag AND n.level = c.up_level AND n.idx = c.up_idx AND n.copy = c.up_copy))
        SELECT own_tag, own_idx, folded, coalesce(subroot, root) AS subroot, root, proof FROM climb WHERE up_tag IS NULL LIMIT ALL""", start=start, nodes=copied)
    ascended = written(ascended, "merkle-climbed")
    found = manifest.runs.select(F.col("tag").alias("own_tag"), F.col("idx").alias("own_idx"), "kids", "lone").join(ascended, ["own_tag", "own_idx"])
    found = found.selectExpr("kids", "folded", "root AS top", "lower(hex(subroot)) AS subroot", "lower(hex(root)) AS root", f"{_text('proof')} AS proof")
    each = found.select("*", F.posexplode("kids").alias("i", "kid"))
    left, right = _around("kids.leaf", "i", fan)
    return each.selectExpr("kid.id AS id", "lower(hex(kid.leaf)) AS leaf", "subroot", "root", f"concat({_text(left)}, {_text(right)}, proof) AS proof", "lower(hex(folded[i])) AS folded_root", "folded[i] = top AS verified")


def verify_documents(docs: DataFrame, fan: int = FAN) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row of docs (doc_id, source, lang, n_chars, text).

    Where 5 divides crc32 of the decimal doc_id, the held text is the recorded
    one with A-Z lower-cased: a text that has any isn't verified. Null ids and
    null texts are held as recorded. A table of one row has an empty proof, and
    its leaf is the root. Other columns are not read. An empty table gives an
    empty result.
    """
    kept = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    recorded = digest(*kept, F.col("text"))
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    manifest = build(docs, recorded, F.when(tampered, digest(*kept, lowered)).otherwise(recorded), fan=fan)
    names = ("leaf", "subroot", "root", "proof_sha256", "folded_root")
    if manifest is None:
        return docs.limit(0).select("doc_id", *(F.lit("").alias(c) for c in names), F.lit(True).alias("verified"))
    return climb(manifest, fan).select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root", "verified")
