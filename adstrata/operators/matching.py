"""Finding duplicate ads: blocking keys, candidate pairs, scored evidence and decisions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adstrata.functions import hashes, numbers, text
from adstrata.operators import blocks
from adstrata.operators.current import current_state
from adstrata.plans.scratch import written


def features(observations: DataFrame, snippets: DataFrame | None = None) -> DataFrame:
    """The latest observation of each listing with what scoring reads: place, numbers as doubles, phone, floor, clean text.

    ``snippets``: (seller_name, snippet) taken out of the descriptions of that seller; a
    description of which nothing is left counts whole.
    """
    now = current_state(observations, ["price_eur", "area_m2", "rooms", "floor", "location_norm", "location_raw", "seller_phone", "seller_type", "seller_name", "description"])
    if snippets is not None:
        per_seller = snippets.filter("seller_name IS NOT NULL AND snippet IS NOT NULL").groupBy("seller_name").agg(F.array_sort(F.collect_set("snippet")).alias("snippets"))
        now = now.join(per_seller, "seller_name", "left")
    else:
        now = now.withColumn("snippets", F.array().cast("array<string>"))
    clean = F.nullif(text.without_snippets(F.col("description"), F.col("snippets")), F.lit(""))
    number = lambda c: F.nullif(F.col(c).cast("double"), F.lit(0.0)).alias(c)
    place = F.coalesce(F.col("location_norm"), text.location_key(F.col("location_raw")), F.lit(""))
    return now.select(
        "listing_id", number("price_eur"), number("area_m2"), number("rooms"), place.alias("place"), text.fold(F.col("location_norm")).alias("loc"),
        numbers.parse_floor(F.col("floor")).alias("floor"), numbers.normalize_phone(F.col("seller_phone")).alias("phone"), "seller_type", "seller_name",
        F.coalesce(clean, "description", F.lit("")).alias("clean_text"),
    )


def blocking_keys(feats: DataFrame, with_text: bool = True, hashes_of: DataFrame | None = None) -> DataFrame:
    """(listing_id, key_type, key_value): cheap keys that likely duplicates share, each once.

    ``hashes_of`` (listing_id, bits: array of image hashes) adds the bands of each hash. Whole-number keys round half to even. A 0 or missing number, an unusable phone and an
    empty text give no key.
    """
    if hashes_of is not None:
        feats = feats.join(hashes_of.select("listing_id", "bits"), "listing_id", "left")
    keys = _keys(text.fold(F.col("clean_text")) if with_text else None, hashes_of is not None)
    return feats.select("listing_id", F.inline(keys)).filter("key_value IS NOT NULL").distinct()


def _keys(folded: Column | None, with_bits: bool) -> Column:
    """The keys of a row of features as an array of (key_type, key_value), with nulls and repeats: also of the text ``folded`` and of the image hashes ``bits``."""
    whole = lambda c: F.bround(c, 0).cast("bigint").cast("string")
    at = lambda value: F.concat(value, F.lit("|"), F.col("place"))
    area, price = F.col("area_m2"), F.col("price_eur")
    key = lambda kind, value: F.struct(F.lit(kind).alias("key_type"), value.alias("key_value"))
    keys = F.array(
        key("area_city", at(whole(area))),
        key("area_band", at(F.floor(area / 10).cast("string"))),
        key("area_band", at(whole(area / 10))),
        key("price_place", at(whole(price))),
        key("phone", F.col("phone")),
    )
    if folded is not None:
        bands = text.text_bands(text.minhash(text.shingles(folded)))
        keys = F.concat(keys, F.transform(bands, lambda b: key("text_band", b)))
    if with_bits:
        bands = F.flatten(F.transform(F.coalesce("bits", F.array().cast("array<bigint>")), lambda h: hashes.hash_bands(h)))
        keys = F.concat(keys, F.transform(bands, lambda b: key("phash_band", b)))
    return keys


def _held(keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The distinct keys of the listings, and (key_type, key_value, size) of those that several listings share."""
    held = keys.select("listing_id", "key_type", "key_value").filter("listing_id IS NOT NULL AND key_type IS NOT NULL AND key_value IS NOT NULL").distinct()
    return held, held.groupBy("key_type", "key_value").agg(F.count("*").alias("size")).filter("size > 1")


def large_blocks(keys: DataFrame, most: int, touched: DataFrame | None = None) -> DataFrame:
    """(key_type, key_value, size, listing_id): the members of the keys that more than ``most`` listings share.

    With ``candidate_pairs(keys, most=most)`` they hold every link, in rows that grow with
    the keys and not with the square of a block. With ``touched`` only blocks that hold one of those.
    """
    held, size = _held(keys)
    large = size.filter(F.col("size") > most)
    if touched is not None:
        asked = held.join(touched.select("listing_id").distinct(), "listing_id", "left_semi").select("key_type", "key_value").distinct()
        large = large.join(asked, ["key_type", "key_value"], "left_semi")
    return held.join(large, ["key_type", "key_value"]).select("key_type", "key_value", "size", "listing_id")


def candidate_pairs(keys: DataFrame, touched: DataFrame | None = None, block: int = 1000, most: int | None = None) -> DataFrame:
    """(a, b), a < b: the listings that share a key; with ``touched`` (listing_id) only pairs with one of those.

    With ``most`` only keys that at most so many listings share give pairs; ``large_blocks``
    gives the others as blocks, since the pairs of a key that a share of all listings hold
    grow with the square of the data.

    A block of up to ``block`` listings meets itself in one join. A larger one is cut into
    parts of about that size, and each part meets each other part in a task of its own, so
    no task gets the whole block; every pair of it is still found. With ``touched``, only
    the touched listings of a block meet each of its parts.
    """
    held, size = _held(keys)
    if most is not None:
        size = size.filter(F.col("size") <= most)
    sized = held.join(size, ["key_type", "key_value"])
    parts = F.ceil(F.col("size") / block).cast("int")
    part = F.pmod(F.xxhash64("listing_id"), parts).cast("int")
    sized = sized.withColumn("parts", parts).withColumn("part", part)
    pair = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    if touched is not None:
        ids = touched.select("listing_id").distinct()
        asked = sized.join(ids, "listing_id", "left_semi").select(F.col("listing_id").alias("a"), "key_type", "key_value", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        others = sized.select(F.col("listing_id").alias("b"), "key_type", "key_value", "part")
        return asked.join(others, ["key_type", "key_value", "part"]).filter("a <> b").select(*pair).distinct()
    meets = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct(F.least(F.col("part"), j).alias("low"), F.greatest(F.col("part"), j).alias("high")))
    spread = sized.select("listing_id", "key_type", "key_value", "part", F.explode(meets).alias("meet"))
    left = spread.filter("part = meet.low").select(F.col("listing_id").alias("a"), "key_type", "key_value", "meet")
    right = spread.filter("part = meet.high").select(F.col("listing_id").alias("b"), "key_type", "key_value", "meet")
    met = left.join(right, ["key_type", "key_value", "meet"]).filter("a <> b")
    return met.select(*pair).distinct()


@dataclass(frozen=True)
class Weights:
    """What each kind of evidence adds, in thousandths, so that sums are exact; and the two thresholds."""

    images_two: int = 550
    images_one: int = 250
    area_exact: int = 300
    area_exact_round: int = 120
    area_close: int = 100
    area_off: int = -250
    floor_off: int = -450
    floor_same: int = 50
    phone: int = 450
    text_near: int = 350
    text_close: int = 150
    price_exact: int = 120
    price_close: int = 80
    trio: int = 180
    rooms_same: int = 50
    rooms_off: int = -200
    seller: int = 50
    merge_at: int = 750
    review_at: int = 450


def scored(pairs: DataFrame, feats: DataFrame, hashes_of: DataFrame | None = None, w: Weights | None = None) -> DataFrame:
    """``pairs`` (a, b) with their evidence, ``score`` and ``decision`` (merge, review, distinct).

    ``hashes_of``: (listing_id, bits: array of 64-bit image hashes). Unknown values give no
    evidence either way; different known places always mean distinct. Pairs with a listing
    that has no observation are left out.
    """
    w = w or Weights()
    named = pairs.select(F.explode(F.array("a", "b")).alias("listing_id")).distinct()
    feats = feats.join(named, "listing_id", "left_semi")
    f = feats if hashes_of is None else feats.join(hashes_of, "listing_id", "left")
    f = f.withColumn("bits", F.coalesce("bits", F.array().cast("array<bigint>")) if hashes_of is not None else F.array().cast("array<bigint>"))
    # a shingle as the hash of its text: eight bytes in the shuffles instead of the text itself
    f = f.withColumn("shingled", F.transform(text.shingles(text.fold(F.col("clean_text"))), lambda t: F.xxhash64(t))).drop("clean_text")
    side = lambda s: f.select(F.col("listing_id").alias(s), F.struct(*[c for c in f.columns if c != "listing_id"]).alias(f"_{s}"))
    p = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    A, B = lambda c: F.col(f"_a.{c}"), lambda c: F.col(f"_b.{c}")
    both = lambda c: A(c).isNotNull() & B(c).isNotNull()
    gap = lambda c: F.abs(A(c) - B(c)) / F.greatest(A(c), B(c))
    p = p.withColumns({
        "location_conflict": (A("loc") != "") & (B("loc") != "") & (A("loc") != B("loc")),
        "img_match_count": hashes.count_matches(A("bits"), B("bits")),
        "area_precise": numbers.is_precise(A("area_m2")) & numbers.is_precise(B("area_m2")),
        "floor_conflict": F.coalesce(A("floor") != B("floor"), F.lit(False)),
        "phone_match": F.coalesce(A("phone") == B("phone"), F.lit(False)),
        "jaccard": text.jaccard(A("shingled"), B("shingled")),
        "same_seller": F.coalesce((A("seller_name") == B("seller_name")) & (A("seller_name") != ""), F.lit(False)),
    })
    true = lambda c: F.coalesce(c, F.lit(False))
    area_gap, price_gap = F.when(both("area_m2"), gap("area_m2")), F.when(both("price_eur"), gap("price_eur"))
    near = F.when(both("area_m2"), F.abs(A("area_m2") - B("area_m2")))
    trio = true(price_gap <= 0.002) & true(area_gap <= 0.02) & true(A("rooms") == B("rooms")) & (A("loc") != "") & (A("loc") == B("loc")) & ~F.col("floor_conflict")
    agencies = true(A("seller_type") == "agency") & true(B("seller_type") == "agency")
    pick = lambda *cases: F.coalesce(*[F.when(c, F.lit(v)) for c, v in cases], F.lit(0))
    terms = [
        pick((F.col("img_match_count") >= 2, w.images_two), (F.col("img_match_count") == 1, w.images_one)),
        pick(((near <= 0.15) & F.col("area_precise"), w.area_exact), (near <= 0.15, w.area_exact_round), (area_gap <= 0.02, w.area_close), (area_gap <= 0.06, 0), (area_gap > 0.06, w.area_off)),
        pick((F.col("floor_conflict"), w.floor_off), (A("floor") == B("floor"), w.floor_same)),
        pick((F.col("phone_match") & ~agencies, w.phone)),
        pick((F.col("jaccard") >= 0.8, w.text_near), (F.col("jaccard") >= 0.5, w.text_close)),
        pick((price_gap <= 0.002, w.price_exact), (price_gap <= 0.03, w.price_close)),
        pick((F.col("exact_trio"), w.trio)),
        pick((A("rooms") == B("rooms"), w.rooms_same), (A("rooms") != B("rooms"), w.rooms_off)),
        pick((F.col("same_seller"), w.seller)),
    ]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    p = p.withColumn("exact_trio", trio).withColumn("points", total)
    decision = (
        F.when(F.col("location_conflict"), "distinct").when(F.col("points") >= w.merge_at, "merge").when(F.col("points") >= w.review_at, "review").otherwise("distinct")
    )
    return p.select(
        "a", "b", "location_conflict", "img_match_count", "area_precise", F.round(near, 2).alias("area_delta"), "floor_conflict", "phone_match",
        F.round("jaccard", 3).alias("text_jaccard"), F.round(price_gap, 4).alias("price_delta_pct"), "exact_trio", "same_seller",
        (F.col("points") / 1000).alias("score"), decision.alias("decision"),
    )


def _keyed(observations: DataFrame, snippets: DataFrame | None, hashes_of: DataFrame | None) -> DataFrame:
    """What ``blocks`` compares listings by, written once: features, folded text, image hashes, and the distinct keys as 64-bit hashes."""
    feats = features(observations, snippets).withColumn("text", text.fold(F.col("clean_text")))
    none = F.array().cast("array<bigint>")
    f = feats.withColumn("bits", none) if hashes_of is None else feats.join(hashes_of.select("listing_id", "bits"), "listing_id", "left").withColumn("bits", F.coalesce("bits", none))
    keys = F.filter(_keys(F.col("text"), hashes_of is not None), lambda k: k["key_value"].isNotNull())
    agency = F.coalesce(F.col("seller_type") == "agency", F.lit(False)).alias("agency")
    kept = f.select(
        "listing_id", "price_eur", "area_m2", "rooms", "loc", "floor", "phone", "seller_name", agency, numbers.is_precise(F.col("area_m2")).alias("precise"), "bits", "text",
        F.array_distinct(F.transform(keys, lambda k: F.xxhash64(k["key_type"], k["key_value"]))).alias("keys"),
    )
    return written(kept, "features")


EVIDENCE = ["location_conflict", "img_match_count", "area_precise", "area_delta", "floor_conflict", "phone_match", "text_jaccard", "price_delta_pct", "exact_trio", "same_seller", "score", "decision"]


def dedup_run(
    observations: DataFrame, snippets: DataFrame | None = None, hashes_of: DataFrame | None = None, touched: DataFrame | None = None,
    stored: DataFrame | None = None, w: Weights | None = None, columns: Sequence[str] = EVIDENCE, merges_only: bool = False, block: int = 1000,
) -> DataFrame:
    """The pair rows after one run over the listings: keys, candidate pairs, evidence, decision; ``scored`` columns and human_label.

    With ``touched`` (listing_id) only pairs with one of those are found and scored, and the
    other rows of ``stored`` stay as they are. ``stored`` (a, b, decision, human_label) are the
    rows before the run: a pair that a person labelled keeps its decision and label, its
    evidence is refreshed. Null ids have no row; no listings give no pairs.

    The rows are those of ``scored(candidate_pairs(blocking_keys(…)))``, made block by block
    (``blocks``): listings are shuffled, about once for each block they are in, and pairs are
    not. Evidence has the ``columns`` named, decision always. ``merges_only`` gives the pairs
    that merge alone: the text of a pair that it can't make one isn't compared.
    """
    if merges_only and stored is not None:
        raise ValueError("a pair that was stored may be decided otherwise")
    made = {"area_delta": "near", "price_delta_pct": "price_gap", "score": "points", "decision": "choice"}
    rows = blocks.cells(_keyed(observations, snippets, hashes_of), touched, block)
    columns = [c for c in EVIDENCE if c in {*columns, "decision"}]
    found = blocks.compared(rows, asdict(w or Weights()), [made.get(c, c) for c in columns], merges_only)
    choice = F.element_at(F.array(F.lit("distinct"), F.lit("review"), F.lit("merge")), F.col("choice").cast("int") + 1)
    final = {"area_delta": F.round("near", 2), "price_delta_pct": F.round("price_gap", 4), "score": F.col("points") / 1000, "decision": choice}
    fresh = found.select("a", "b", *[final.get(c, F.col(c)).alias(c) for c in columns])
    if stored is None:
        return fresh.withColumn("human_label", F.lit(None).cast("string"))
    label = F.nullif(F.trim("human_label"), F.lit(""))
    known = stored.select("a", "b", F.col("decision").alias("was"), label.alias("human_label"))
    kept = F.when(F.col("human_label").isNotNull(), F.col("was")).otherwise(F.coalesce("decision", "was"))
    return fresh.join(known, ["a", "b"], "full_outer").withColumn("decision", kept).drop("was")


def near_hashes(hashed: DataFrame, near: int = 7, bands: int = 8, radius: int = 0) -> DataFrame:
    """(a, b, distance): all hashes (id, bits) within ``near`` bits.

    Of two hashes within ``near`` bits some band differs in at most ``near // bands``
    bits; each is looked up under every band that differs from its own in at most
    ``radius`` bits, so ``near`` must be less than ``bands * (radius + 1)``. Equal hashes
    are one class: its least id stands for it.
    """
    if near >= bands * (radius + 1):
        raise ValueError("hashes that differ in as many bits may have no band within the radius")
    classes = hashed.filter("bits IS NOT NULL").groupBy("bits").agg(F.min("id").alias("id"))
    ends = [64 * i // bands for i in range(bands + 1)]
    part = lambda i: F.shiftrightunsigned("bits", ends[i]).bitwiseAND(F.lit((1 << (ends[i + 1] - ends[i])) - 1).cast("bigint"))
    changed = lambda i: F.array(*[F.lit(sum(1 << k for k in at)).cast("bigint") for n in range(radius + 1) for at in combinations(range(ends[i + 1] - ends[i]), n)])
    own = F.array(*[F.struct(F.lit(i).alias("band"), part(i).alias("value")) for i in range(bands)])
    around = lambda i: F.transform(changed(i), lambda m: F.struct(F.lit(i).alias("band"), part(i).bitwiseXOR(m).alias("value")))
    probes = F.flatten(F.array(*[around(i) for i in range(bands)]))
    left = classes.select(F.col("id").alias("a"), F.col("bits").alias("bits_a"), F.inline(probes))
    right = classes.select(F.col("id").alias("b"), F.col("bits").alias("bits_b"), F.inline(own))
    distance = hashes.hash_distance(F.col("bits_a"), F.col("bits_b")).cast("bigint")
    return left.join(right, ["band", "value"]).filter("a < b").select("a", "b", distance.alias("distance")).filter(F.col("distance") <= near).distinct()
