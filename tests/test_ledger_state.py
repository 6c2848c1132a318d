"""The ledger as keyed state of a stream, and late days worked in by key, against the whole replay."""

import datetime as dt
import glob
import os
import random

import pytest

from feedweave.operators import ledger
from feedweave.streaming import ledger_state

D0 = dt.date(2024, 1, 1)
SCHEMA = "digest_type string, link string, run_date date"


def rows(seed, days=40, links=12, chance=0.3):
    rnd = random.Random(seed)
    return [(t, f"https://s/{n}", D0 + dt.timedelta(d)) for t in ("org", "press") for n in range(links) for d in range(days) if rnd.random() < chance]


def plain(sightings, dedup_days):
    out = []
    for key in {r[:2] for r in sightings}:
        held = None
        for d in sorted({r[2] for r in sightings if r[:2] == key}):
            if held is None or (d - held).days > dedup_days:
                held = d
                out.append((*key, d))
    return sorted(out)


def got(df):
    return sorted((r.digest_type, r.link, r.run_date) for r in df.collect())


@pytest.mark.parametrize("late_days, files", [(1, 3), (3, 1)])
def test_stream_equals_replay_for_any_order_of_open_days(spark, scratch_dir, late_days, files):
    log, accepted, state = (os.path.join(scratch_dir, x) for x in ("log", "accepted", "state"))
    sightings = rows(1, days=12, links=6)
    rnd = random.Random(2)
    # blocks of late_days days, their rows in any order over two files; a link-less row and a repeat among them
    for first in range(0, 12, late_days):
        block = [r for r in sightings if first <= (r[2] - D0).days < first + late_days]
        rnd.shuffle(block)
        for part in (block[::2], [*block[1::2], *block[:1], ("org", "", D0 + dt.timedelta(first))]):
            ledger_state.land(spark.createDataFrame(part, SCHEMA).coalesce(1), log)
    q = ledger_state.start_ledger_stream(spark, log, accepted, state, 7, late_days, files)
    q.awaitTermination(600)
    assert q.exception() is None
    open_from = D0 + dt.timedelta(12 - late_days)
    closed = [r for r in plain(sightings, 7) if r[2] < open_from]
    assert got(ledger_state.read_accepted(spark, accepted)) == closed  # open days wait
    # the same state goes on, closes the last days, and forgets keys that suppress nothing more
    ledger_state.heartbeat(spark, log, D0 + dt.timedelta(60))
    q = ledger_state.start_ledger_stream(spark, log, accepted, state, 7, late_days, files)
    q.awaitTermination(600)
    assert got(ledger_state.read_accepted(spark, accepted)) == plain(sightings, 7)
    assert ledger_state.state_rows(q) == 0 and ledger_state.late_rows(q) == 0


def test_late_rows_are_counted_and_worked_in(spark, scratch_dir):
    log, accepted, state = (os.path.join(scratch_dir, x) for x in ("log", "accepted", "state"))
    sightings = rows(3)
    late = [r for r in sightings if r[1] == "https://s/4" and (r[2] - D0).days in range(5, 12)] + [("org", "https://new", D0 + dt.timedelta(9))]
    on_time = [r for r in sightings if r not in late]
    ledger_state.land(spark.createDataFrame(on_time, SCHEMA).coalesce(1), log)
    ledger_state.heartbeat(spark, log, D0 + dt.timedelta(60))
    ledger_state.start_ledger_stream(spark, log, accepted, state).awaitTermination(600)
    assert got(ledger_state.read_accepted(spark, accepted)) == plain(on_time, 7)

    came = spark.createDataFrame(late, SCHEMA)
    ledger_state.land(came.coalesce(1), log)
    q = ledger_state.start_ledger_stream(spark, log, accepted, state)
    q.awaitTermination(600)
    assert ledger_state.late_rows(q) == len(late)
    assert got(ledger_state.read_accepted(spark, accepted)) == plain(on_time, 7)

    files = {d: sorted(glob.glob(f"{accepted}/run_date={d}/part-*")) for d in (D0 + dt.timedelta(n) for n in range(40))}
    changed = ledger_state.absorb_late(spark, log, accepted, came)
    want = plain([*on_time, *late], 7)
    assert got(ledger_state.read_accepted(spark, accepted)) == want
    differ = {r[2] for r in set(want) ^ set(plain(on_time, 7))}
    assert set(changed) == differ and len(differ) < 20
    assert all(sorted(glob.glob(f"{accepted}/run_date={d}/part-*")) == f for d, f in files.items() if d not in differ)
    assert ledger_state.absorb_late(spark, log, accepted, came) == []  # once more: nothing to do


@pytest.mark.parametrize("seed, dedup_days, span", [(5, 7, None), (6, 0, 3), (7, 2, 1), (8, 7, 8)])
def test_refold_equals_a_full_replay(spark, seed, dedup_days, span):
    sightings = rows(seed)
    rnd = random.Random(seed)
    late = [r for r in sightings if rnd.random() < 0.1]
    on_time = [r for r in sightings if r not in late]
    df = lambda x: spark.createDataFrame(x, SCHEMA)
    before = df(plain(on_time, dedup_days))
    changes = ledger.refold(df(sightings), before, df(late), dedup_days, span)
    assert got(ledger.apply_changes(before, changes)) == plain(sightings, dedup_days)
    told = sorted((r.digest_type, r.link, r.run_date, r.added) for r in changes.collect())
    old, new = set(plain(on_time, dedup_days)), set(plain(sightings, dedup_days))
    assert told == sorted([(*r, True) for r in new - old] + [(*r, False) for r in old - new])


def test_a_rewrite_that_broke_off_is_found_again(spark, scratch_dir):
    """Newest days are written first: with some of them written, the same late rows give the rest."""
    sightings = rows(9)
    late = [r for r in sightings if r[1] in ("https://s/1", "https://s/2") and (r[2] - D0).days < 9]
    on_time = [r for r in sightings if r not in late]
    old, new = plain(on_time, 7), plain(sightings, 7)
    changed = sorted({r[2] for r in set(old) ^ set(new)})
    df = lambda x: spark.createDataFrame(x, SCHEMA)
    for cut in (changed[-1], changed[len(changed) // 2]):
        half = [r for r in old if r[2] < cut] + [r for r in new if r[2] >= cut]
        assert got(ledger.apply_changes(df(half), ledger.refold(df(sightings), df(half), df(late), 7, 4))) == new


def test_refold_of_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    some = spark.createDataFrame([("org", "x", D0)], SCHEMA)
    assert ledger.refold(some, some, empty).count() == 0
    assert got(ledger.apply_changes(empty, ledger.refold(some, empty, some))) == [("org", "x", D0)]
