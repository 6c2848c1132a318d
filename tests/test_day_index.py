"""The day index kept up to date equals the full aggregate; rules observed by the write equal a count of the rows."""

import datetime as dt
import glob
import random

import pytest

from feedweave.operators import checks, day_index, history

SCHEMA = "id long, run_date date, digest_type string, item_count int, created_at timestamp, markdown string"


def runs(seed, n=120):
    rnd = random.Random(seed)
    return [(i, dt.date(2024, 1, 1) + dt.timedelta(rnd.randrange(15)), rnd.choice(["org", "press", "other"]), rnd.choice([0, 3, 9, None]),
             dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i), "text") for i in range(n)]


def test_batches_repeats_and_late_days(spark, scratch_dir):
    rows, path = runs(1), f"{scratch_dir}/index"
    rnd = random.Random(2)
    df = lambda x: spark.createDataFrame(x, SCHEMA)
    seen = set()
    for _ in range(4):
        batch = rnd.sample(rows, 50)
        seen |= {r[0] for r in batch}
        for _ in range(rnd.choice([1, 2])):  # some batches twice
            day_index.update(df(batch + batch[:5]), path)
        want = [tuple(r) for r in history.date_index(df([r for r in rows if r[0] in seen])).collect()]
        assert [tuple(r) for r in day_index.read(spark, path).collect()] == want
    assert [tuple(r) for r in day_index.read(spark, path, 3).collect()] == want[:3]
    # a corrected run replaces itself, and only its day is written
    files = {d: glob.glob(f"{path}/days/run_date={d}/part-*") for d in {r[1] for r in rows}}
    fixed = next(r for r in rows if r[0] in seen and r[2] == "org")
    day_index.update(df([(*fixed[:3], 77, fixed[4] + dt.timedelta(1), "t")]), path)
    changed = [(*r[:3], 77, *r[4:]) if r[0] == fixed[0] else r for r in rows if r[0] in seen]
    assert [tuple(r) for r in day_index.read(spark, path).collect()] == [tuple(r) for r in history.date_index(df(changed)).collect()]
    assert all(glob.glob(f"{path}/days/run_date={d}/part-*") == f for d, f in files.items() if d != fixed[1])


def test_nothing_to_merge(spark, scratch_dir):
    day_index.update(spark.createDataFrame([], SCHEMA), f"{scratch_dir}/index")
    assert day_index.read(spark, f"{scratch_dir}/index").count() == 0


@pytest.mark.parametrize("table", list(checks.RULES))
def test_rules_are_counted_by_the_write(spark, scratch_dir, table):
    rules = checks.RULES[table]
    rnd = random.Random(3)
    columns = list(dict.fromkeys([*rules.key, *rules.required, "digest_type"]))
    rows = [tuple(rnd.choice([None, "a", "b"]) if c != "digest_type" else rnd.choice(["org", "press", "x", None]) for c in columns) for _ in range(60)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns)).repartition(3)
    found = {rule: n for _, rule, n in checks.write_checked(df, table, lambda x: x.write.parquet(f"{scratch_dir}/{table}"))}
    at = {c: i for i, c in enumerate(columns)}
    want = {f"not_null_{c}": sum(r[at[c]] is None for r in rows) for c in rules.required}
    want["type_check"] = sum(r[at["digest_type"]] == "x" for r in rows)
    want[f"unique_{'_'.join(rules.key)}"] = len(rows) - len({tuple(r[at[k]] for k in rules.key) for r in rows})
    assert found == want
    assert sorted(map(str, spark.read.parquet(f"{scratch_dir}/{table}").collect())) == sorted(map(str, df.collect()))


def test_rules_of_an_empty_write(spark, scratch_dir):
    df = spark.createDataFrame([], "id long, run_date date, digest_type string, source_count int, item_count int, markdown string, created_at timestamp")
    assert all(n == 0 for _, _, n in checks.write_checked(df, "runs", lambda x: x.write.parquet(f"{scratch_dir}/empty")))
