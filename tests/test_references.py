import datetime as dt
import random

from pyspark.sql import functions as F

from tessera.operators import references as op

T0 = dt.datetime(2026, 1, 1)


def at(h):
    return T0 + dt.timedelta(hours=h)


def brute(refs, rows, gone):
    out = []
    for i, k, t in refs:
        if k is None:
            continue
        past = [(x, 0) for kk, x in rows if kk == k and x is not None and (t is None or x <= t)] + [(x, 1) for kk, x in gone if kk == k and x is not None and (t is None or x <= t)]
        out.append((i, not past or max(past)[1] == 1))
    return sorted(out)


def run(spark, refs, rows, gone):
    changes = op.changes(spark.createDataFrame(rows, "key string, ts timestamp"), spark.createDataFrame(gone, "key string, ts timestamp"))
    df = spark.createDataFrame(refs, "id int, key string, ts timestamp")
    return sorted((r.id, r.orphan) for r in op.orphans(df, changes).collect()), changes, df


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(op, "SPREAD", 7)  # so that slices are spread
    rng = random.Random(5)
    key = lambda: "hot" if rng.random() < 0.35 else f"k{rng.randrange(12)}"
    when = lambda: None if rng.random() < 0.03 else at(rng.randrange(24 * 12))
    rows, gone = [(key(), when()) for _ in range(90)], [(key(), when()) for _ in range(60)]
    refs = [(i, None if rng.random() < 0.05 else key(), when()) for i in range(400)]
    got, changes, df = run(spark, refs, rows, gone)
    assert got == brute(refs, rows, gone)
    signed = {(r.key, r.ts): r.delta for r in op.deltas(changes).collect()}
    assert set(signed.values()) <= {1, -1}
    for k in {k for k, _ in signed}:
        total = 0
        for t in sorted(t for kk, t in signed if kk == k):
            total += signed[k, t]
            assert total in (0, 1)
    now = {r.key: (r.refs, r.existence) for r in op.standing(df, changes).collect()}
    assert now["hot"][0] == sum(1 for r in refs if r[1] == "hot")


def test_ties_and_repeats(spark):
    rows, gone = [("a", at(1)), ("a", at(1)), ("b", at(1))], [("a", at(1)), ("b", at(2))]
    refs = [(1, "a", at(1)), (2, "b", at(1)), (2, "b", at(1)), (3, "b", at(2)), (4, "b", at(0)), (5, "c", None)]
    assert run(spark, refs, rows, gone)[0] == [(1, True), (2, False), (2, False), (3, True), (4, True), (5, True)]


def test_empty_and_clashing_names(spark):
    none = spark.createDataFrame([], "key string, ts timestamp")
    changes = op.changes(none, none)
    assert op.orphans(spark.createDataFrame([], "key string, ts timestamp"), changes).count() == 0
    odd = spark.createDataFrame([("a", at(1), 1, 2, 3, 4, 5, True)], "key string, ts timestamp, slice int, salt int, stands int, kind int, at int, orphan boolean")
    row = op.orphans(odd.withColumn("row", F.lit(7)), changes).collect()[0]
    assert row.orphan and row.slice == 1 and row.row == 7 and row.at == 5
