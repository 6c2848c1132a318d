"""Every query of the feed operators plans without Python evaluation or all-pairs joins."""

from feedweave.plans.queries import QUERIES
from feedweave.session import ensure_checkpoint_dir

FORBIDDEN = ("BroadcastNestedLoopJoin", "CartesianProduct", "BatchEvalPython", "ArrowEvalPython",
             "FlatMapGroupsInPandas", "MapInPandas", "PythonUDF")


def test_no_python_or_all_pairs_joins(spark):
    bad = {}
    ensure_checkpoint_dir(spark)
    for name, fn in QUERIES.items():
        df = fn(spark, "/root/testdata/sf0.001")
        plan = df._jdf.queryExecution().executedPlan().toString()
        hits = [f for f in FORBIDDEN if f in plan]
        if hits:
            bad[name] = hits
    assert bad == {}
