"""The ingest step counts published in FIXTURES.md §2.1 (sf0.01)."""

from feedweave.operators import ingest
from feedweave.sources import fixtures as fx

SF01 = "/root/testdata/sf0.01"

# FIXTURES.md §2.1, sf0.01 rows after each step.
EXPECTED = {
    "org": [700, 560, 293, 175, 172, 150],
    "press": [300, 300, 89, 89, 89, 63],
}


def test_step_counts_match_fixture_table(spark):
    counts = ingest.step_counts(fx.feed_items(spark, SF01), fx.settings(spark),
                                fx.seen_ledger(spark, SF01), fx.AS_OF)
    got = {}
    for r in counts.orderBy("digest_type", "step_no").collect():
        got.setdefault(r.digest_type, []).append(r.n_items)
    assert got == EXPECTED
