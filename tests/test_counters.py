"""The fold and its readers against a plain sequential fold, and golden cases."""

import random

import pytest
from pyspark.sql import functions as F

from capwindow.operators import counters, oplog, snapshot
from capwindow.plans import choose
from capwindow.schema import OPS


def plain_fold(rows):
    state, out = {}, {}
    for lsn, pos, op, key, bs, t in sorted(rows):
        value, last = state.get((key, bs), (0, None))
        if op == "DEL":
            out[lsn, pos] = int((key, bs) in state)
            state.pop((key, bs), None)
            continue
        value = 1 if last is None or last < t - t % bs else value + 1
        state[key, bs] = (value, t)
        out[lsn, pos] = value
    return out, state


def random_log(seed, n=600, keys=4, monotone=False):
    rng, t, rows = random.Random(seed), 1000, []
    for lsn in rng.sample(range(1, 5 * n), n):
        rows.append([lsn, 0, "DEL" if rng.random() < 0.15 else "INCR", f"k{rng.randrange(keys)}", rng.choice([60, 600]), 0])
    rows.sort()
    for row in rows:
        t = t + rng.randrange(30) if monotone else max(0, t + rng.randrange(-90, 120))
        row[5] = t
    return [tuple(r) for r in rows]


def results(df):
    return {(r.lsn, r.pos): r.result for r in df.collect()}


@pytest.mark.parametrize("seed", range(3))
def test_folds_equal_plain_fold(spark, seed):
    rows = random_log(seed)
    ops = spark.createDataFrame(rows, OPS)
    want, _ = plain_fold(rows)
    assert results(counters.fold(ops)) == want
    for span in (7, 200, 10**6):
        assert results(counters.fold_chunked(ops, span)) == want
    assert results(choose.planned_fold(ops, hot_rows=10)) == want


@pytest.mark.parametrize("seed", range(3))
def test_monotone_fold(spark, seed):
    rows = random_log(seed, monotone=True)
    ops = spark.createDataFrame(rows, OPS)
    assert choose.is_monotone(ops)
    assert results(counters.fold_monotone(ops)) == plain_fold(rows)[0]


def test_snapshot_and_recovery(spark):
    rows = random_log(5)
    ops = spark.createDataFrame(rows, OPS)
    want, _ = plain_fold(rows)
    for lsn in (0, 700, 1500, 10**6):
        snap = snapshot.snapshot_at(ops, lsn)
        _, state = plain_fold([r for r in rows if r[0] <= lsn])
        assert {(r.key, r.batch_size): (r.value, r.tx_at) for r in snap.collect()} == state
        assert results(snapshot.recover(snap, ops, lsn)) == {k: v for k, v in want.items() if k[0] > lsn}


@pytest.mark.parametrize(
    "steps, want",
    [
        ([("INCR", 0), ("INCR", 59), ("INCR", 60), ("INCR", 61)], [1, 2, 1, 2]),
        ([("INCR", 65), ("INCR", 50), ("INCR", 66)], [1, 2, 1]),
        ([("INCR", 10), ("INCR", 11), ("DEL", 11), ("INCR", 12), ("DEL", 12), ("DEL", 12)], [1, 2, 1, 1, 1, 0]),
    ],
)
def test_golden_logs(spark, steps, want):
    ops = spark.createDataFrame([(i, 0, op, "k", 60, t) for i, (op, t) in enumerate(steps, 1)], OPS)
    got = results(counters.fold(ops))
    assert [got[i, 0] for i in range(1, len(steps) + 1)] == want


def test_reads_lapse_and_missing_keys_are_zero(spark):
    ops = spark.createDataFrame([(1, 0, "INCR", "a", 60, 10)], OPS)
    probes = spark.createDataFrame([("a", 60), ("b", 60)], "key string, bs bigint")
    for now, value in ((59, 1), (60, 0)):
        assert {r.key: r.value for r in counters.get_many(probes, ops, now).collect()} == {"a": value, "b": 0}


def test_empty_log(spark):
    ops = spark.createDataFrame([], OPS)
    for df in (counters.fold(ops), counters.fold_chunked(ops, 5), counters.watch_changes(ops), snapshot.snapshot_at(ops, 3), counters.commit_places(ops, 3, 5)):
        assert df.isEmpty()


def test_lsn_assignment_is_dense(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("x")).repartition(5)
    assert [(r.x, r.lsn) for r in oplog.assign_lsn(df, "x").orderBy("lsn").collect()] == [(i, i + 1) for i in range(1000)]


def test_gc_keeps_within_the_grace(spark):
    ops = spark.createDataFrame([(1, 0, "INCR", "a", 60, 20)], OPS)
    assert snapshot.live_after(ops, 119).count() == 1
    assert snapshot.live_after(ops, 120).count() == 0
