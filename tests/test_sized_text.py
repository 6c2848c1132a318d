"""Text cut by size: the chunks, each after its lead, are the single text."""

import random

import pytest
from pyspark.sql import functions as F

from feedweave.operators import assemble, common


def articles(spark, seed=1, n=80):
    rnd = random.Random(seed)
    rows = []
    for t in ("org", "press"):
        for i in range(n):
            org = "Big" if rnd.random() < 0.4 else f"o{rnd.randrange(12)}"
            rows.append((t, i + 1, org, "c", f"src-{org}", f"Título {i}", rnd.choice([None, "", "s" * rnd.randrange(300)]) or "", f"https://x/{i}", "Jan 1"))
    return spark.createDataFrame(rows, "digest_type string, item_no long, org string, category string, source_name string, title string, summary string, link string, published string").repartition(5)


def joined(chunks, t):
    rows = sorted((r for r in chunks if r.digest_type == t), key=lambda r: r.chunk_no)
    assert rows[0].chunk_no == 0 and rows[0].lead == ""
    return "".join(r.lead + r.text for r in rows)


@pytest.mark.parametrize("budget", [1, 700, 10**9])
def test_blocks(spark, budget):
    arts = articles(spark)
    chunks = assemble.sized_blocks(arts, budget).collect()
    lines = {t: [r.line for r in arts.filter(F.col("digest_type") == t).orderBy("item_no").select(
        (assemble.org_item_line() if t == "org" else assemble.press_item_line()).alias("line")).collect()] for t in ("org", "press")}
    assert joined(chunks, "org") == "".join(lines["org"])
    assert joined(chunks, "press") == "\n\n".join(lines["press"])
    longest = max(len(x.encode()) for v in lines.values() for x in v) + 2
    assert all(r.n_bytes == len(r.text.encode()) < budget + longest for r in chunks)
    assert sum(r.n_lines for r in chunks) == 160
    for r in chunks:
        assert r.last_no - r.first_no + 1 == r.n_lines
    assert len(chunks) == (160 if budget == 1 else 2) or budget == 700 and len(chunks) > 10


@pytest.mark.parametrize("budget", [1, 400, 10**9])
def test_index_keeps_orgs_whole(spark, budget):
    arts = articles(spark)
    chunks = assemble.sized_index(arts, budget).collect()
    rows = arts.select("digest_type", "org", "item_no", assemble.index_line().alias("line")).collect()
    for t in ("org", "press"):
        own = sorted((r.org, r.item_no, r.line) for r in rows if r.digest_type == t)
        assert joined(chunks, t) == "\n".join(x[2] for x in own)
        for org in {r[0] for r in own}:
            mine = [x[2] for x in own if x[0] == org]
            held = [c for c in chunks if c.digest_type == t and any(m in c.text.split("\n") for m in mine)]
            if sum(len(m.encode()) + 1 for m in mine) <= budget:
                assert len(held) == 1
    longest = max(len(r.line.encode()) for r in rows) + 1
    assert all(r.n_bytes < 2 * budget + longest for r in chunks)


def test_running_total_over_many_partitions(spark):
    rnd = random.Random(3)
    rows = [(g, i, rnd.randrange(0, 9)) for g in "ab" for i in range(200)]
    rnd.shuffle(rows)
    got = common.running_total(spark.createDataFrame(rows, "g string, i int, w bigint").repartition(7), ["g"], ["i"], "w", "before").collect()
    for r in got:
        assert r.before == sum(w for g, i, w in rows if g == r.g and i < r.i)


def test_of_nothing(spark):
    assert assemble.sized_blocks(articles(spark).limit(0)).count() == 0
