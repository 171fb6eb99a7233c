"""Components, survivors and intake against plain code, with nulls, ties, repeats and hot groups."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from adstrata.llm import components, intake, survivors
from tests.test_resolution import roots


def pairs(df, *c):
    return sorted(tuple(r[x] for x in c) for r in df.collect())


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rnd = random.Random(seed)
    edges = [(rnd.randrange(80), rnd.randrange(80), "x") for _ in range(45)]
    edges += [(200 + i, 201 + i, "x") for i in range(40)] + [(500, 501 + i, "x") for i in range(60)] + [(None, 1, "x"), (7, None, "x"), (9, 9, "x")]
    df = spark.createDataFrame(edges, "a long, b long, node string")
    want = roots([e[:2] for e in edges])
    assert {r.node: r.group_id for r in components.components(df.unionByName(df)).collect()} == want


def test_components_of_nothing(spark):
    df = spark.createDataFrame([(1, 1), (None, 2)], "a long, b long")
    assert components.components(df).count() == 0
    assert components.components(df.limit(0)).columns == ["node", "group_id"]


def test_links(spark):
    t = lambda n: None if n is None else dt.datetime(2024, 1, n)
    rows = [
        (1, 1, 2, "merge", None, None, t(1)), (2, 2, 1, "distinct", None, None, t(2)),  # the later decision
        (3, 3, 4, "distinct", " SAME ", t(1), t(1)), (4, 4, 3, "merge", "different", None, t(9)),  # a null time is earliest
        (5, 5, 6, " Merge", "", None, None), (6, 7, 7, "merge", None, None, t(1)), (7, None, 7, "merge", None, None, t(1)),
        (8, 8, 9, None, None, None, t(1)), (9, 10, 11, "distinct", None, None, t(3)), (10, 10, 11, "merge", None, None, t(3)),  # a tie: the higher id
    ]
    df = spark.createDataFrame(rows, "id long, listing_a long, listing_b long, decision string, human_label string, labeled_at timestamp, created_at timestamp")
    assert pairs(components.decided_links(df), "a", "b") == [(3, 4), (5, 6), (10, 11)]


LISTING = "id long, cluster_id long, source string, category string, first_seen timestamp, last_seen timestamp, value string"


def test_survivors(spark):
    d = lambda y, m=1: dt.datetime(y, m, 1)
    rows = [
        (3, 1, "s", "stan", d(2024, 2), d(2024, 5), "x"), (2, 1, "t", "kuca", d(2024, 2), d(2024, 4), "x"), (4, 1, None, " - ", d(1970), d(2024, 9), "x"), (5, 1, "s", "stan", d(2024), d(2023), "x"),
        (7, 2, "s", None, None, None, "x"), (6, 2, "s", "--", d(2030), d(2024), "x"), (6, 2, "s", "--", d(2030), d(2024), "x"),
        (8, 3, "s", "stan", d(2024), d(2024), "x"), (8, 3, "s", "stan", d(2024), d(2024), "x"), (9, None, "s", "stan", d(2024), d(2024), "x"),
        (10, 4, "s", "a", d(2024), d(2024), "x"), (11, 4, "s", "b", d(2024), d(2024), "x"),
    ]
    got = survivors.cluster_survivors(spark.createDataFrame(rows, LISTING))
    assert pairs(got, "cluster_id", "canonical_listing_id", "category_listing_id") == [(1, 2, 3), (2, 6, -1), (4, 10, 10)]
    assert survivors.cluster_survivors(spark.createDataFrame([], LISTING)).count() == 0


def discovered(claims, rounds=20):
    """Truth discovery by plain code, for fields without an order."""
    claims = sorted({c for c in claims if None not in (c[0], c[1], c[2], c[4])}, key=str)
    trust = {(f, s): 0.8 for e, f, v, s, m in claims}
    for _ in range(rounds):
        votes = {}
        for e, f, v, s, m in claims:
            votes.setdefault((e, f), {}).setdefault(v, [0.0, m])
            votes[e, f][v][0] += trust[f, s]
            votes[e, f][v][1] = min(votes[e, f][v][1], m)
        truth = {k: min(vs, key=lambda v: (-round(vs[v][0], 9), vs[v][1])) for k, vs in votes.items()}
        new = {}
        for key in trust:
            own = [c for c in claims if (c[1], c[3]) == key]
            new[key] = max(0.05, (sum(truth[c[0], c[1]] == c[2] for c in own) + 1) / (len(own) + 2))
        done = max(abs(new[k] - trust[k]) for k in trust) < 1e-3
        trust = new
        if done:
            break
    votes = {}
    for e, f, v, s, m in claims:
        votes.setdefault((e, f), {}).setdefault(v, [0.0, m])
        votes[e, f][v][0] += trust[f, s]
        votes[e, f][v][1] = min(votes[e, f][v][1], m)
    return {k: min(vs, key=lambda v: (-round(vs[v][0], 9), vs[v][1])) for k, vs in votes.items()}, trust


@pytest.mark.parametrize("seed", range(2))
def test_truth_discovery_learns_whom_to_trust(spark, seed):
    rnd = random.Random(seed)
    claims = []
    for e in range(30):
        for m, s in enumerate(["good", "fair", "bad", "bad2"]):
            right = rnd.random() < {"good": 0.95, "fair": 0.8, "bad": 0.3, "bad2": 0.3}[s]
            claims.append((e, "f", "right" if right else rnd.choice(["w1", "w2"]), s, e * 10 + m))
    claims += [(None, "f", "x", "good", 1), (1, "f", None, "good", 1)]
    df = spark.createDataFrame([(*c[:4], None, c[4]) for c in claims], "entity long, field string, value string, source string, rank long, member long")
    truths, trust = survivors.discover(df.unionByName(df))
    want, want_trust = discovered(claims)
    assert {(r.entity, r.field): r.value for r in truths.collect()} == want
    got = {r.source: r.reliability for r in trust.collect()}
    assert got == pytest.approx({s: v for (_, s), v in want_trust.items()}) and got["good"] > got["bad"]


def accepted(batches, keys, share=0.5):
    of, sets, index, out = {}, {}, [], set()
    for no, i in batches:
        if no is not None and i is not None:
            of[i] = min(no, of.get(i, no))
    for i, t, v in keys:
        if None not in (i, t, v):
            sets.setdefault(i, set()).add((t, v.strip(" ").lower()))
    for i in sorted(of, key=lambda x: (of[x], x)):
        s = sets.get(i, set())
        met = [a for a in index if s and len(s & sets.get(a, set())) >= share * len(s | sets.get(a, set()))]
        out |= {(a, i) for a in met}
        if not met:
            index.append(i)
    return out, set(index)


@pytest.mark.parametrize("seed, common, settings", [(0, 100, {}), (1, 3, {"bucket_rows": 40}), (2, 3, {"solo_edges": 0, "bucket_rows": 90}), (3, 0, {"broadcast_bands": 0})])
def test_intake(spark, seed, common, settings):
    rnd = random.Random(seed)
    batches = [(rnd.randint(1, 4), i) for i in range(120)] + [(2, 5), (None, 500), (1, None)] + [(rnd.randint(1, 4), rnd.randrange(120)) for _ in range(20)]
    keys = []
    for i in range(118):  # two records have no keys
        base = rnd.randrange(14)
        own = {rnd.randrange(10 * base, 10 * base + 10) for _ in range(rnd.randint(1, 9))}
        keys += [(i, "k", f" K{x} ") for x in own] + [(i, "hot", "h")] * (i % 3 == 0) + [(i, "k", f"k{next(iter(own))}")]
    keys += [(3, None, "x"), (3, "k", None), (None, "k", "x")]
    b = spark.createDataFrame(batches, "batch_no int, listing_id long")
    k = spark.createDataFrame(keys, "listing_id long, key_type string, key_value string")
    decisions, matches = intake.deduplicated(b, k, common=common, **settings)
    want, kept = accepted(batches, keys)
    assert set(pairs(matches, "a", "b")) == want and matches.count() == len(want)
    assert {r.record for r in decisions.collect() if r.accepted} == kept


def test_intake_of_copies_and_chains(spark):
    # one group of copies holds most rows; a chain in which every second record is rejected
    keys = [(i, "k", str(x)) for i in range(40) for x in range(6)] + [(100 + i, "c", str(x)) for i in range(12) for x in range(i, i + 6)]
    batches = [(1 + i % 2, i) for i in range(40)] + [(1, 100 + i) for i in range(12)]
    b, k = spark.createDataFrame(batches, "batch_no int, listing_id long"), spark.createDataFrame(keys, "listing_id long, key_type string, key_value string")
    decisions, matches = intake.deduplicated(b, k)
    want, kept = accepted(batches, keys)
    assert set(pairs(matches, "a", "b")) == want and {r.record for r in decisions.collect() if r.accepted} == kept
    decisions, matches = intake.deduplicated(b.limit(0), k)
    assert decisions.count() == 0 and matches.count() == 0
    decisions, matches = intake.deduplicated(b, k.limit(0))
    assert decisions.filter("accepted").count() == 52 and matches.count() == 0


@pytest.mark.parametrize("per_row, solo", [(0.5, 1000), (64, 1000), (64, 2)])
def test_intake_of_near_copies(spark, per_row, solo):
    # near copies that are no copies, whose first record trails another one in a bucket; few comparisons are allowed
    keys = [(i, "k", str(x)) for i in range(10, 60) for x in range(8)] + [(i, "own", str(i)) for i in range(10, 60)]
    keys += [(1, "k", "0"), (1, "z", "1"), (1, "z", "2"), (1, "z", "3")] + [(100 + i, "c", str(x)) for i in range(20) for x in range(i, i + 6)]
    batches = [(1, i) for i in [1, *range(10, 60), *range(100, 120)]]
    b, k = spark.createDataFrame(batches, "batch_no int, listing_id long"), spark.createDataFrame(keys, "listing_id long, key_type string, key_value string")
    decisions, matches = intake.deduplicated(b, k, common=5, pairs_per_row=per_row, solo_edges=solo)
    want, kept = accepted(batches, keys)
    assert set(pairs(matches, "a", "b")) == want and {r.record for r in decisions.collect() if r.accepted} == kept


def _record(i):
    return [(i, "k", f"{i}-{x}") for x in range(5)] + [(i, "hot", "h")] * (i % 3 == 0)


def test_intake_opened_again_reads_only_matching_buckets(spark, tmp_path):
    keys_of = lambda ids: spark.createDataFrame([k for i in ids for k in _record(i)], "listing_id long, key_type string, key_value string")
    batch_of = lambda rows: spark.createDataFrame(rows, "batch_no int, listing_id long")
    probe, read = keys_of([10**6]), []
    for n in (300, 1200):
        path = str(tmp_path / f"index-{n}")
        rows = [(1 + (i >= 40) + (i >= n // 2), i) for i in range(n)]
        intake.deduplicated(batch_of(rows), keys_of(range(n)), common=20, path=path, bucket_rows=50)
        index = intake.IntakeIndex(spark, path)
        assert index.state["records"] == n and index.state["last"] == 3 and index.state["generation"] > 0
        bands = index._bands(index._signatures(intake.record_keys(probe).withColumn("batch_no", F.lit(9)), None).withColumn("first", F.col("record")))
        buckets = [r[0] for r in bands.select("bucket").distinct().collect()]
        known = index.known(buckets)
        assert "PartitionFilters: [bucket" in known._jdf.queryExecution().toString()
        read.append(known.count())
        # the key that was common only later is no band key of what is laid out since
        assert index.known().groupBy("band").count().agg(F.max("count")).first()[0] < n // 3
    assert read[1] < 3 * read[0] and read[1] < 900
    # a later batch goes through the index that is there: copies of old records are rejected by it
    more = spark.createDataFrame([k for i in range(5) for k in [(5000 + i, t, v) for _, t, v in _record(i)]], "listing_id long, key_type string, key_value string")
    decisions, matches = intake.deduplicated(batch_of([(1, 0), (4, 5000), (4, 5001), (4, 7000)]), more, path=str(tmp_path / "index-300"))
    assert {(r.a, r.b) for r in matches.filter("b >= 5000").collect()} == {(0, 5000), (1, 5001)}
    assert {r.record: r.accepted for r in decisions.collect()} == {0: True, 5000: False, 5001: False, 7000: True}
