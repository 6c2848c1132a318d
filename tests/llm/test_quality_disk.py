"""What the quality model and written tables leave on disk."""

from __future__ import annotations

import math
import random
import time

from pyspark.sql import functions as F

from feedweave.llm import batches, quality_lm

from . import samples


def test_what_a_written_table_shuffled_is_freed(llm):
    files = lambda: {f for f in llm.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n") if "shuffle_" in f}
    before, option = files(), llm.conf.get(batches._FREED)
    got = batches.written(llm.range(5000).groupBy((F.col("id") % 100).alias("k")).count(), "counts")
    until = time.time() + 10
    while files() - before and time.time() < until:
        time.sleep(0.2)
    assert not files() - before and llm.conf.get(batches._FREED) == option
    assert got.count() == 100


def test_slices_are_scored_in_parts(llm, monkeypatch):
    rng = random.Random(12)
    rows = [(i, " ".join(samples.words(rng, rng.choice([1, 20, 60])))) for i in range(120)] + [(500, None), (7, "again"), (7, "again")]
    docs = samples.documents(llm, rows).repartition(3)
    labels = llm.createDataFrame([(i, int(i % 3 > 0)) for i in range(120)], "doc_id long, quality int")
    tables, plain = [], batches.written
    monkeypatch.setattr(quality_lm, "written", lambda df, name: tables.append(name) or plain(df, name))
    found = []
    for size in (quality_lm.PART_BYTES, 1):
        monkeypatch.setattr(quality_lm, "PART_BYTES", size)
        found.append(sorted(map(tuple, quality_lm.judge(docs, labels).collect()), key=repr))
    assert tables.count("sums") == quality_lm.PARTS
    same = lambda a, b: a == b or a is not None and b is not None and math.isclose(a, b, rel_tol=1e-9)
    by_id = lambda rows: sorted(rows, key=lambda r: (r[0], r[2], r[1]))
    for a, b in zip(*map(by_id, found), strict=True):
        assert a[:3] == b[:3] and same(a[3], b[3]) and same(a[4], b[4]) and a[5] == b[5]


def test_keys_are_packed_by_their_distances():
    keys = [0, 5, 5, 1 << 47, (1 << 48) - 1, 3 << 60]
    packed = quality_lm._pack(quality_lm.np.array(keys, dtype=quality_lm.np.uint64))
    assert quality_lm._unpack(packed).tolist()[:5] == keys[:5] and int(quality_lm._unpack(packed)[5]) & int(quality_lm._MASK) == 0
    even = quality_lm.np.arange(10_000, dtype=quality_lm.np.uint64) << quality_lm.np.uint64(20)
    assert len(quality_lm._pack(even)) < 1000 and (quality_lm._unpack(quality_lm._pack(even)) == even).all()
