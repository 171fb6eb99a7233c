"""The bitemporal ledger against a replay of the snapshots, one epoch after another."""

import random

import pytest
from pyspark.sql import functions as F

from adstrata.operators.history import OPEN, bitemporal_ledger, extend_ledger, observed_states, packed, listing_ledger, unpacked


def replay(rows, upto):
    """The versions known after epoch ``upto`` by plain code: (entity, from, to, state)."""
    out = set()
    for e in {r[0] for r in rows if r[0] is not None}:
        at = {}
        for entity, t, seq, state, epoch in sorted((r for r in rows if r[0] == e and r[1] is not None and r[4] <= upto), key=lambda r: r[2]):
            at[t] = state
        versions, last = [], object()
        for t in sorted(at):
            if at[t] != last:
                versions.append((t, at[t]))
                last = at[t]
        for i, (t, s) in enumerate(versions):
            out.add((e, t, versions[i + 1][0] if i + 1 < len(versions) else OPEN, s))
    return out


def frame(spark, rows):
    df = spark.createDataFrame(rows, "entity long, at long, seq long, v string, epoch int")
    return df.withColumn("noise", F.lit("x")).withColumn("state_", F.lit(1))


def ledger_of(spark, rows, slice_us):
    return bitemporal_ledger(frame(spark, rows), "entity", "at", "seq", ["v"], F.col("epoch"), slice_us)


def believed(ledger, epoch):
    """The rows of a ledger that hold in an epoch."""
    return {
        (r.entity, r.valid_from, r.valid_to, r.state.v) for r in ledger.collect()
        if r.recorded_from <= epoch and (r.recorded_to == OPEN or r.recorded_to > epoch)
    }


@pytest.mark.parametrize("slice_us", [1, 7, 1000])
def test_ledger_equals_replay(spark, slice_us):
    rnd = random.Random(slice_us)
    rows = [(rnd.choice([1, 1, 1, 2, 3, None]), rnd.choice([None, *range(25)]), seq, rnd.choice(["a", "b", None]), seq * 3 // 120) for seq in range(120)]
    rows += rows[:10]
    ledger = ledger_of(spark, rows, slice_us).cache()
    for epoch in range(3):
        assert believed(ledger, epoch) == replay(rows, epoch)


def test_late_update_splits_and_supersedes(spark):
    rows = [(1, 10, 0, "a", 0), (1, 30, 1, "a", 0), (1, 20, 2, "b", 1)]
    got = {(r.valid_from, r.valid_to, r.state.v, r.recorded_from, r.recorded_to) for r in ledger_of(spark, rows, 5).collect()}
    assert got == {(10, OPEN, "a", 0, 1), (10, 20, "a", 1, OPEN), (20, 30, "b", 1, OPEN), (30, OPEN, "a", 1, OPEN)}


def test_empty_and_null(spark):
    assert ledger_of(spark, [], 5).count() == 0
    assert ledger_of(spark, [(None, 1, 1, "a", 0), (1, None, 2, "a", 0)], 5).count() == 0


def test_extending_equals_building(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice([1, 2, 3]), rnd.randrange(20), seq, rnd.choice(["a", "b", None]), seq // 40) for seq in range(80)]
    whole = ledger_of(spark, rows, 4)
    shape = lambda rs: frame(spark, rs).select("entity", "at", "seq", F.struct("v").alias("state"))
    first = ledger_of(spark, [r for r in rows if r[4] == 0], 4)
    grown = extend_ledger(first, shape([r for r in rows if r[4] == 0]), shape([r for r in rows if r[4] == 1]), 1, 4)
    flat = lambda df: sorted((r.entity, r.valid_from, r.valid_to, r.state.v or "", r.recorded_from, r.recorded_to) for r in df.collect())
    assert flat(grown) == flat(whole)


def test_failed_fetches_do_not_count(spark):
    o = spark.createDataFrame([(1, 1, None, None, None, "AB"), (2, 1, "t", None, None, "aB"), (3, 1, None, None, 5.0, None)], "id long, listing_id long, title string, description string, price_eur double, content_hash string")
    got = observed_states(o.withColumn("captured_at", F.lit("2024-01-01").cast("timestamp"))).orderBy("id").collect()
    assert [(r.id, r.hash) for r in got] == [(2, "ab"), (3, None)]


def test_packing_round_trip(spark):
    texts = ["", "00ff", "abc", "zz", "č", "0", None, "ab" * 40, "61"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", unpacked(packed(F.col("t"))).alias("u"), packed(F.col("t")).alias("p"))
    rows = df.collect()
    assert [r.u for r in rows] == texts and len({None if r.p is None else bytes(r.p) for r in rows}) == len(texts)


@pytest.mark.parametrize("slice_us, late", [(1, 25), (6, 25), (1000, 25), (6, 3)])
def test_every_arrival_is_recorded(spark, slice_us, late):
    rnd = random.Random(slice_us + late)
    # ``late``: how far behind the newest moment a row may be
    rows = [(rnd.choice([1, 1, 1, 2, 3, None]), rnd.choice([None, *range(max(0, seq // 6 - late), seq // 6 + 1)]), seq, rnd.choice(["a", "b", None]), seq) for seq in range(150)]
    ledger = ledger_of(spark, rows + rows[:10], slice_us).cache()
    for seq in range(150):
        assert believed(ledger, seq) == replay(rows, seq)
    keys = [(r.entity, r.valid_from, r.valid_to, r.state.v, r.recorded_from) for r in ledger.collect()]
    ended = {(r.entity, r.valid_from, r.valid_to, r.state.v, r.recorded_to) for r in ledger.collect()}
    assert len(keys) == len(set(keys)) <= 3 * len(rows) and not ended & set(keys)


def test_a_late_row_next_to_the_row_it_splits_is_recorded(spark):
    rows = [(1, 1, 10, "a"), (2, 1, 30, "b"), (3, 1, 20, "c"), *[(i, 2, i, "z") for i in range(100, 400)]]
    o = spark.createDataFrame(rows, "id long, listing_id long, s long, content_hash string")
    o = o.select("id", "listing_id", F.timestamp_seconds("s").alias("captured_at"), F.lit("t").alias("title"), F.lit("d").alias("description"), F.lit(1).cast("decimal(12,2)").alias("price_eur"), "content_hash")
    got = {(r.valid_from // 10**6, r.valid_to // 10**6, r.state.hash, r.recorded_from, r.recorded_to) for r in listing_ledger(o).filter("entity = 1").collect()}
    assert got == {(10, OPEN, "a", 1, 2), (10, 30, "a", 2, 3), (30, OPEN, "b", 2, OPEN), (10, 20, "a", 3, OPEN), (20, 30, "c", 3, OPEN)}
