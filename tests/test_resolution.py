"""Scoring, candidates and clusters against pinned scenarios and plain code."""

import random

import pytest
from pyspark.sql import functions as F

from adstrata.catalog import resolve
from adstrata.functions import text
from adstrata.operators import clusters, matching

COLUMNS = "listing_id long, area_m2 double, price_eur double, rooms double, floor string, loc string, seller_type string, seller_name string, phone string, clean_text string"
A = (1, 64.3, 189000.0, 2.0, "2", "tresnjevka", "private", "Ivan H.", "385912345678", "svijetao stan s pogledom na park i velikim balkonom")


def score(spark, a, b, bits=None):
    feats = spark.createDataFrame([a, b], COLUMNS).withColumn("place", F.col("loc"))
    images = None if bits is None else spark.createDataFrame([(a[0], bits[0]), (b[0], bits[1])], "listing_id long, bits array<long>")
    return matching.scored(spark.createDataFrame([(a[0], b[0])], "a long, b long"), feats, images).first()


def changed(**what):
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    row = dict(zip(names, A, strict=True)) | {"listing_id": 2} | what
    return tuple(row[n] for n in names)


@pytest.mark.parametrize("other, bits, want, decision", [
    (changed(), None, 0.30 + 0.05 + 0.45 + 0.35 + 0.12 + 0.18 + 0.05 + 0.05, "merge"),
    (changed(), ([7, 1 << 40], [7, 3 << 40]), 0.55 + 0.30 + 0.05 + 0.45 + 0.35 + 0.12 + 0.18 + 0.05 + 0.05, "merge"),
    (changed(loc="maksimir"), None, 0.30 + 0.05 + 0.45 + 0.35 + 0.12 + 0.05 + 0.05, "distinct"),
    (changed(floor="5", phone=None, seller_name=None, clean_text="posve drugi opis"), ([7], [7]), 0.25 + 0.30 - 0.45 + 0.12 + 0.05, "distinct"),
    (changed(area_m2=90.0, price_eur=None, rooms=3.0, floor=None, phone=None, clean_text=""), None, -0.25 - 0.20 + 0.05, "distinct"),
    (changed(phone=None, clean_text="posve drugi opis", floor="attic", seller_name="x"), ([7, 1 << 40], [7, 3 << 40]), 0.55 + 0.30 - 0.45 + 0.12 + 0.05, "review"),
    (changed(area_m2=None, price_eur=None, rooms=None, floor=None, phone=None, seller_name=None, clean_text="", loc=""), None, 0.0, "distinct"),
])
def test_score(spark, other, bits, want, decision):
    got = score(spark, A, other, bits)
    assert (got.score, got.decision) == (pytest.approx(want, abs=1e-9), decision)


def test_blocking_keys(spark):
    o = spark.createDataFrame(
        [(1, 1, "t", "dugačak opis stana", 100000.4, 65.0, 2.0, "2", "Hrvatska, Zagreb", None, "private", "S", "0912345678"), (2, 2, None, None, None, 0.0, None, None, None, None, None, None, None)],
        "id long, listing_id long, title string, description string, price_eur double, area_m2 double, rooms double, floor string, location_raw string, location_norm string, seller_type string, seller_name string, seller_phone string",
    ).withColumn("captured_at", F.lit("2024-01-01").cast("timestamp"))
    keys = {tuple(r) for r in matching.blocking_keys(matching.features(o), with_text=False).collect()}
    assert keys == {(1, "area_city", "65|zagreb"), (1, "area_band", "6|zagreb"), (1, "price_place", "100000|zagreb"), (1, "phone", "385912345678")}
    bands = matching.blocking_keys(matching.features(o)).filter("key_type = 'text_band'")
    assert bands.count() == 16 and bands.filter("listing_id = 2").count() == 0


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_candidates_keep_every_pair_of_a_large_block(spark, block):
    rnd = random.Random(block)
    rows = [(i, "k", str(rnd.randrange(6))) for i in range(40)] + [(i, "hot", "h") for i in range(25)] + [(3, "k", "0")] * 2
    keys = spark.createDataFrame(rows, "listing_id long, key_type string, key_value string")
    held = {}
    for i, t, v in rows:
        held.setdefault((t, v), set()).add(i)
    want = {(a, b) for s in held.values() for a in s for b in s if a < b}
    assert {tuple(r) for r in matching.candidate_pairs(keys, block=block).collect()} == want
    touched = spark.createDataFrame([(5,)], "listing_id long")
    assert {tuple(r) for r in matching.candidate_pairs(keys, touched, block).collect()} == {p for p in want if 5 in p}


def test_candidates_share_a_key_of_any_type(spark, tmp_path):
    kinds = ["area_city", "area_band", "price_place", "phone", "phash_band", "text_band"]
    rows = [(10 * i + j, t, v) for i, t in enumerate(kinds) for j, v in ((1, " Key"), (2, "key "), (3, "other"))] + [(91, "phone", "x"), (92, "text_band", "x")]
    spark.createDataFrame(rows, "listing_id long, key_type string, key_value string").write.parquet(f"{tmp_path}/blocking_keys.parquet")
    spark.createDataFrame([(1, 1), (2, 32), (2, 33), (2, 42)], "batch_no int, listing_id long").write.parquet(f"{tmp_path}/intake_batches.parquet")
    assert {tuple(r) for r in resolve.candidate_pairs(spark, str(tmp_path)).collect()} == {(10 * i + 1, 10 * i + 2) for i in range(6)}
    assert {tuple(r) for r in resolve.touched_pairs(spark, str(tmp_path)).collect()} == {(31, 32), (41, 42)}


def roots(edges):
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            top[y] = x
    return {x: find(x) for x in top}


@pytest.mark.parametrize("seed", range(3))
def test_connected(spark, seed):
    rnd = random.Random(seed)
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(35)] + [(100 + i, 101 + i) for i in range(20)] + [(None, 1), (7, 7)]
    got = {r.node: r.root for r in clusters.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == roots(edges)


def test_no_edges(spark):
    assert clusters.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_rebuilt_names_flags_and_splits(spark):
    listings = spark.createDataFrame([(i, c) for i, c in [(1, 9), (2, 9), (3, 9), (4, 9), (5, None), (6, None), *[(10 + i, None) for i in range(6)]]], "id long, cluster_id long").withColumn("first_seen", F.lit(None).cast("timestamp"))
    links = spark.createDataFrame([(1, 2), (3, 4), (5, 6), *[(10 + i, 11 + i) for i in range(5)]], "a long, b long")
    was = spark.createDataFrame([(9, "confirmed")], "id long, status string")
    assigned, groups = clusters.rebuilt(links, listings, was)
    of = {r.listing_id: r.cluster_id for r in assigned.collect()}
    # the group of the lower root keeps the id, the split-off one gets a new one
    assert of[1] == of[2] == 9 and of[3] == of[4] != 9 and len({of[1], of[3], of[5], of[10]}) == 4
    by = {r.cluster_id: (r.size, r.status, r.canonical_listing_id) for r in groups.collect()}
    assert by[9] == (2, "confirmed", 1) and by[of[10]] == (6, "flagged", 10) and by[of[5]] == (2, "auto", 5)


def test_labels_hold(spark):
    pairs = spark.createDataFrame([(1, 2, "merge", None), (3, 4, "review", "same")], "listing_a long, listing_b long, decision string, human_label string")
    labels = spark.createDataFrame([(2, 1, "different", 1), (1, 2, "same", 0), (8, 7, "different", 1)], "listing_a long, listing_b long, label string, at int")
    got = {(r.listing_a, r.listing_b): (r.decision, r.human_label) for r in clusters.relabelled(pairs, labels).collect()}
    assert got == {(1, 2): ("merge", "different"), (3, 4): ("review", "same"), (7, 8): ("distinct", "different")}
    assert {tuple(r) for r in clusters.effective_links(spark.createDataFrame([(1, 2, " Merge", ""), (3, 4, "distinct", "SAME "), (5, 6, "merge", "different")], "listing_a long, listing_b long, decision string, human_label string")).collect()} == {(1, 2), (3, 4)}


def test_pairs_and_labels_in_either_order(spark, tmp_path):
    schema = "listing_a long, listing_b long, decision string, human_label string"
    pairs = spark.createDataFrame([(2, 1, "merge", " "), (4, 3, "review", "same"), (5, 6, "merge", None)], schema)
    labels = spark.createDataFrame([(1, 2, "different", 1), (6, 5, "same", 0), (5, 6, "", 1)], "listing_a long, listing_b long, label string, at int")
    got = {(r.listing_a, r.listing_b): (r.decision, r.human_label) for r in clusters.relabelled(pairs, labels).collect()}
    assert got == {(1, 2): ("merge", "different"), (3, 4): ("review", "same"), (5, 6): ("merge", "same")}
    rows = [(1, 2, 1, "merge", "Same", 10), (2, 2, 1, "review", "different", 20), (3, 1, 2, "merge", None, None), (4, 2, 1, " Distinct", " ", None), (5, 8, 7, "merge", None, None), (6, 9, 9, "merge", "same", 1), (7, 3, 4, "x", " ", None), (8, 6, 5, "x", "SAME", None)]
    table = spark.createDataFrame(rows, "id long, listing_a long, listing_b long, decision string, human_label string, s long")
    table.withColumn("labeled_at", F.timestamp_seconds("s")).drop("s").write.parquet(f"{tmp_path}/dedup_pairs.parquet")
    got = {(r.listing_a, r.listing_b): (r.decision, r.human_label) for r in resolve.relabelled(spark, str(tmp_path)).collect()}
    assert got == {(1, 2): ("distinct", "different"), (7, 8): ("merge", None), (3, 4): ("x", None), (5, 6): ("merge", "same")}


def test_near_hashes_finds_every_pair(spark):
    rnd = random.Random(2)
    base = [rnd.getrandbits(63) for _ in range(6)]
    bits = [b ^ sum(1 << i for i in rnd.sample(range(63), rnd.randrange(9))) for b in base for _ in range(8)] + [base[0], base[0]]
    df = spark.createDataFrame([*enumerate(bits), (99, None)], "id long, bits long")
    first = {}
    for i, b in enumerate(bits):
        first.setdefault(b, i)
    want = {(min(x, y), max(x, y), (a ^ b).bit_count()) for a, x in first.items() for b, y in first.items() if x != y and (a ^ b).bit_count() <= 7}
    assert {tuple(r) for r in matching.near_hashes(df).collect()} == want and want
    with pytest.raises(ValueError):
        matching.near_hashes(df, near=8)


@pytest.mark.parametrize("near, bands, radius", [(8, 9, 0), (8, 5, 1), (20, 8, 2), (20, 21, 0)])
def test_near_hashes_is_complete_at_larger_distances(spark, near, bands, radius):
    rnd = random.Random(near + bands)
    base = [rnd.getrandbits(63) for _ in range(4)]
    bits = [b ^ sum(1 << i for i in rnd.sample(range(63), n)) for b in base for n in [0, 1, 7, 8, 8, 9, 12, 16, 20, 20, 21]]
    bits += [b - (1 << 63) for b in base]
    apart = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count()
    want = {(x, y, apart(a, b)) for x, a in enumerate(bits) for y, b in enumerate(bits) if x < y and apart(a, b) <= near}
    assert any(d == near for _, _, d in want)
    df = spark.createDataFrame(list(enumerate(bits)), "id long, bits long")
    assert {tuple(r) for r in matching.near_hashes(df, near, bands, radius).collect()} == want
    with pytest.raises(ValueError):
        matching.near_hashes(df, bands * (radius + 1), bands, radius)


def test_near_hashes_query_reaches_twenty_bits(spark, tmp_path):
    rnd = random.Random(4)
    one = [rnd.choice([-1.0, 1.0]) for _ in range(64)]
    flipped = lambda places: [-x if i in places else x for i, x in enumerate(one)]
    spread = [8 * i + j for i in range(8) for j in range(3)]
    rows = [(1, one), (2, flipped(spread[:8])), (3, flipped(spread[4:])), (4, flipped(range(64)))]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert {tuple(r) for r in resolve.near_hashes(spark, str(tmp_path)).collect()} == {(1, 2, 8), (1, 3, 20), (2, 3, 20)}


def test_pair_jaccard_reads_the_whole_text(spark, tmp_path):
    texts = {1: "Svijetao stan s pogledom na park\nZvati iza 17 h", 2: "Svijetao stan s balkonom i garažom\nZvati iza 17 h", 3: "Kuća uz more, potpuno obnovljena", 4: "abc", 5: None}
    sellers = {1: "A", 2: "A", 3: "B", 4: "B", 5: "B"}
    rows = [(i, i, "Isti naslov", t, sellers[i]) for i, t in texts.items()]
    o = spark.createDataFrame(rows, "id long, listing_id long, title string, description string, seller_name string")
    nothing = {"price_eur": "decimal(12,2)", "area_m2": "decimal(8,2)", "rooms": "decimal(4,1)", "floor": "string", "location_norm": "string", "location_raw": "string", "seller_phone": "string", "seller_type": "string", "content_hash": "string"}
    o = o.withColumns({c: F.lit(None).cast(t) for c, t in nothing.items()} | {"captured_at": F.timestamp_seconds("id")})
    o.write.parquet(f"{tmp_path}/observations.parquet")
    spark.createDataFrame([("A", "Zvati iza 17 h")], "seller_name string, snippet string").write.parquet(f"{tmp_path}/seller_boilerplate.parquet")
    pairs = [(a, b) for a in texts for b in texts if a < b]
    spark.createDataFrame(pairs, "listing_a long, listing_b long").write.parquet(f"{tmp_path}/dedup_pairs.parquet")
    plain = {1: "svijetao stan s pogledom na park", 2: "svijetao stan s balkonom i garazom", 3: "kuca uz more, potpuno obnovljena", 4: "abc", 5: ""}
    cut = {i: {t[k : k + 5] for k in range(max(1, len(t) - 4))} if t else set() for i, t in plain.items()}
    want = {(a, b, round(len(cut[a] & cut[b]) / len(cut[a] | cut[b]), 6) if cut[a] and cut[b] else 0.0) for a, b in pairs}
    assert 0 < max(j for _, _, j in want) < 1
    assert {tuple(r) for r in resolve.pair_jaccard(spark, str(tmp_path)).collect()} == want


def test_shingles_by_one_pass(spark):
    texts = ["", "a", "abcd", "abcde", "ab\ncdef", "🏠🏠 stan 🏠🏠 stan", "x" * 30, "čćžšđ čćžšđ"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.shingles(F.col("t")).alias("s")).collect()
    for r in got:
        want = {r.t[k : k + 5] for k in range(max(1, len(r.t) - 4))} if r.t else set()
        assert set(r.s) == want and len(r.s) == len(want)


def test_large_blocks_and_pairs_hold_every_link(spark):
    rows = [(i, "k", str(i // 3)) for i in range(12)] + [(i, "hot", "h") for i in range(9)] + [(None, "k", "1"), (1, None, "h"), (1, "hot", None), (2, "hot", "h")]
    keys = spark.createDataFrame(rows, "listing_id long, key_type string, key_value string")
    pairs = {tuple(r) for r in matching.candidate_pairs(keys, most=3).collect()}
    assert pairs == {(a, b) for a in range(12) for b in range(a + 1, 12) if a // 3 == b // 3}
    assert sorted((r.key_type, r.size, r.listing_id) for r in matching.large_blocks(keys, 3).collect()) == [("hot", 9, i) for i in range(9)]
    touched = spark.createDataFrame([(10,)], "listing_id long")
    assert matching.large_blocks(keys, 3, touched).count() == 0
    assert {tuple(r) for r in matching.candidate_pairs(keys, touched, most=3).collect()} == {(9, 10), (10, 11)}


def test_dedup_run(spark):
    """Keys, pairs, evidence and decisions in one run: near copies merge, a labelled pair keeps its decision, only touched pairs are scored anew."""
    ad = lambda i, area, phone, words, place="tresnjevka": (i, i, "t", words, 189000.0, area, 2.0, "2", place, place, "private", "S", phone)
    rows = [
        ad(1, 64.3, "0912345678", "svijetao stan s pogledom na park"), ad(2, 64.3, "0912345678", "svijetao stan s pogledom na park"),
        ad(3, 64.3, "0912345678", "svijetao stan s pogledom na park", "maksimir"), ad(4, 120.0, None, "kuca uz more, potpuno obnovljena", "split"), ad(5, None, None, None, None),
    ]
    o = spark.createDataFrame(rows, "id long, listing_id long, title string, description string, price_eur double, area_m2 double, rooms double, floor string, location_raw string, location_norm string, seller_type string, seller_name string, seller_phone string")
    o = o.withColumn("captured_at", F.lit("2024-01-01").cast("timestamp"))
    images = spark.createDataFrame([(1, [7, 1 << 40]), (4, [7])], "listing_id long, bits array<long>")
    got = {(r.a, r.b): (r.decision, r.img_match_count) for r in matching.dedup_run(o, hashes_of=images).collect()}
    assert got == {(1, 2): ("merge", 0), (1, 3): ("distinct", 0), (2, 3): ("distinct", 0), (1, 4): ("distinct", 1)}
    stored = spark.createDataFrame([(1, 2, "distinct", " different "), (8, 9, "merge", None)], "a long, b long, decision string, human_label string")
    touched = spark.createDataFrame([(2,), (None,)], "listing_id long")
    again = {(r.a, r.b): (r.decision, r.human_label, r.text_jaccard) for r in matching.dedup_run(o, hashes_of=images, touched=touched, stored=stored).collect()}
    assert again == {(1, 2): ("distinct", "different", 1.0), (2, 3): ("distinct", None, 1.0), (8, 9): ("merge", None, None)}
    assert matching.dedup_run(o.limit(0)).count() == 0


def odd_ads(spark, n=90):
    """Observations and image hashes: one phone for a third of the listings, odd texts and numbers, several images."""
    rnd = random.Random(5)
    words = ["stan", "kuća", "pogled", "na more", "𝒜𝒷 𝒸 park", "balkon", "garaža", "novogradnja", "mir", "žurno"]
    texts = [None, "", "abc", "𝒜𝒷", "abcd", "abcde", *(" ".join(rnd.choices(words, k=6)) for _ in range(12))]
    pick = lambda *of: rnd.choice(of)
    rows = [
        (i, i, "t", pick(*texts), pick(None, 0.0, 100000.0, 100150.0, 102000.0), pick(None, 0.0, 50.0, 50.1, 64.3, 64.35, 66.0), pick(None, 2.0, 3.0), pick(None, "2", "3. kat", "potkrovlje"),
         pick(None, "Split", "Zagreb"), pick(None, "", "split", "zagreb"), pick(None, "agency", "private"), pick(None, "", "S", "T"), "0912345678" if i % 3 == 0 else pick(None, "0951111222"))
        for i in range(n)
    ]
    o = spark.createDataFrame(rows, "id long, listing_id long, title string, description string, price_eur double, area_m2 double, rooms double, floor string, location_raw string, location_norm string, seller_type string, seller_name string, seller_phone string")
    shown = [7, 6, -1, 1 << 40, (1 << 40) + 255, -(1 << 63)]
    images = spark.createDataFrame([(i, rnd.choices(shown, k=rnd.randrange(4))) for i in range(n) if i % 5], "listing_id long, bits array<long>")
    return o.withColumn("captured_at", F.lit("2024-01-01").cast("timestamp")), images


def in_steps(o, images, touched=None):
    feats = matching.features(o)
    return matching.scored(matching.candidate_pairs(matching.blocking_keys(feats, hashes_of=images), touched), feats, images)


@pytest.mark.parametrize("block", [4, 1000])
def test_dedup_touched_shuffles_listings_and_not_pairs(spark, block):
    """The rows are those of the steps one by one, but nothing is shuffled or joined once it is a pair."""
    o, images = odd_ads(spark)
    touched = spark.createDataFrame([(i,) for i in (0, 0, 3, 4, 6, 17, 30, 31, 60, None, 999)], "listing_id long")
    run = matching.dedup_run(o, hashes_of=images, touched=touched, block=block)
    after = run._jdf.queryExecution().executedPlan().toString().split("MapInArrow")
    assert len(after) > 1 and "Exchange" not in after[0] and "Join" not in after[0]
    got = sorted(map(str, run.drop("human_label").collect()))
    assert len(got) > 100 and got == sorted(map(str, in_steps(o, images, touched).collect()))


def test_dedup_clusters_links_are_the_merges_of_all_pairs(spark):
    """Pairs that no text could make a merge are left out before their texts are compared; those left are all the merges."""
    o, images = odd_ads(spark)
    links = matching.dedup_run(o, hashes_of=images, columns=[], merges_only=True, block=7)
    want = sorted((r.a, r.b) for r in in_steps(o, images).filter("decision = 'merge'").collect())
    assert want and sorted((r.a, r.b) for r in links.collect()) == want
    with pytest.raises(ValueError):
        matching.dedup_run(o, stored=links, merges_only=True)


@pytest.mark.parametrize("block", [4, 1000])
def test_dedup_run_shuffles_listings_and_not_pairs(spark, block):
    """As for touched listings; each pair comes once, with only the evidence that is asked for."""
    o, images = odd_ads(spark)
    run = matching.dedup_run(o, hashes_of=images, block=block)
    after = run._jdf.queryExecution().executedPlan().toString().split("MapInArrow")
    assert len(after) > 1 and "Exchange" not in after[0] and "Join" not in after[0]
    want = in_steps(o, images).collect()
    assert len(want) > 1000 and sorted(map(str, run.drop("human_label").collect())) == sorted(map(str, want))
    asked = matching.dedup_run(o, hashes_of=images, columns=["text_jaccard"], block=block)
    assert asked.columns == ["a", "b", "text_jaccard", "decision", "human_label"]
    assert sorted(tuple(r)[:4] for r in asked.collect()) == sorted((r.a, r.b, r.text_jaccard, r.decision) for r in want)
