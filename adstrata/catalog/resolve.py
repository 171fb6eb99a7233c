"""Queries of text and number functions, duplicate finding, clusters and upserts."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adstrata.functions import hashes, numbers, text, urls
from adstrata.operators import clusters, current, matching
from adstrata.sources import html_pages, json_records, stores
from adstrata.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def fold_text(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "observations")
    return o.select("id", text.fold(F.col("location_raw")).alias("folded"), text.location_key(F.col("location_raw")).alias("place"), F.lower(text.unaccent(F.col("seller_name"))).alias("seller"))


def parsed_numbers(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "observations")
    written = F.concat(F.replace(F.format_number("area_m2", 2), F.lit("."), F.lit("_")), F.lit(" m²"))
    return o.select(
        "id", numbers.parse_floor(F.col("floor")).alias("floor"), numbers.floor_number(F.col("floor")).cast("string").alias("floor_num"), numbers.normalize_phone(F.col("seller_phone")).alias("phone"),
        numbers.parse_area(F.concat(F.replace(F.col("area_m2").cast("string"), F.lit("."), F.lit(",")), F.lit(" m²"))).alias("area"), numbers.is_precise(F.col("area_m2").cast("double")).alias("is_precise"),
        numbers.grouped_number(F.translate(written, ",_", ".,")).alias("grouped"),
    )


def stripped_snippets(spark: SparkSession, d: str) -> DataFrame:
    """The latest description of each listing without the snippets known of its seller."""
    snippets = table(spark, d, "seller_boilerplate")
    per_seller = snippets.filter("seller_name IS NOT NULL").groupBy("seller_name").agg(F.array_sort(F.collect_set("snippet")).alias("snippets"))
    now = current.current_state(table(spark, d, "observations"), ["seller_name", "description"]).join(per_seller, "seller_name", "left")
    return now.select("listing_id", text.without_snippets(F.col("description"), F.col("snippets")).alias("clean"))


def text_signatures(spark: SparkSession, d: str) -> DataFrame:
    """MinHash signatures and band labels of every listing's text."""
    feats = matching.features(table(spark, d, "observations"))
    sig = text.minhash(text.shingles(text.fold(F.col("clean_text"))))
    return feats.select("listing_id", sig.alias("signature")).withColumn("bands", text.text_bands(F.col("signature")))


def blocking_keys(spark: SparkSession, d: str) -> DataFrame:
    return matching.blocking_keys(matching.features(table(spark, d, "observations")), with_text=False)


def blocking_keys_text(spark: SparkSession, d: str) -> DataFrame:
    return matching.blocking_keys(matching.features(table(spark, d, "observations")))


def _stored_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "blocking_keys").select("listing_id", "key_type", F.lower(F.trim("key_value")).alias("key_value"))


MOST = 20


def candidate_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The pairs of listings that share a stored key of any type that at most MOST listings have; ``candidate_blocks`` has the rest."""
    return matching.candidate_pairs(_stored_keys(spark, d), block=200, most=MOST)


def candidate_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The members of every stored key that more than MOST listings share."""
    return matching.large_blocks(_stored_keys(spark, d), MOST)


def _last_batch(spark: SparkSession, d: str) -> DataFrame:
    batches = table(spark, d, "intake_batches")
    return batches.join(F.broadcast(batches.agg(F.max("batch_no").alias("batch_no"))), "batch_no").select("listing_id")


def touched_pairs(spark: SparkSession, d: str) -> DataFrame:
    """As ``candidate_pairs``, only pairs with a listing of the last batch."""
    return matching.candidate_pairs(_stored_keys(spark, d), _last_batch(spark, d), most=MOST)


def touched_blocks(spark: SparkSession, d: str) -> DataFrame:
    """As ``candidate_blocks``, only blocks with a listing of the last batch."""
    return matching.large_blocks(_stored_keys(spark, d), MOST, _last_batch(spark, d))


def _stored_pairs(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "dedup_pairs").filter("listing_a <> listing_b")
    return p.select(F.least("listing_a", "listing_b").alias("a"), F.greatest("listing_a", "listing_b").alias("b")).distinct()


def pair_scores(spark: SparkSession, d: str) -> DataFrame:
    """Evidence, score and decision of every pair that dedup_pairs compared, from the listings' latest texts and numbers."""
    feats = matching.features(table(spark, d, "observations"), table(spark, d, "seller_boilerplate"))
    out = matching.scored(_stored_pairs(spark, d), feats, _image_hashes(spark, d))
    return out.select(*[F.col(c).cast("bigint").alias(c) if t == "int" else F.col(c) for c, t in out.dtypes])


def _image_hashes(spark: SparkSession, d: str) -> DataFrame:
    """(listing_id, bits): the sign hashes of the embeddings as the images of the listings; listings a multiple of their number apart show the same one."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("image"), hashes.sign_bits(F.col("embedding")).alias("bits"))
    ads = current.distinct_listings(table(spark, d, "listings")).select(F.col("id").alias("listing_id")).distinct()
    number = F.broadcast(e.agg(F.count("*").alias("images")))  # one row
    shown = ads.crossJoin(number).withColumn("image", F.pmod("listing_id", "images"))
    return shown.join(e, "image").groupBy("listing_id").agg(F.array_sort(F.collect_set("bits")).alias("bits"))


def _run(spark: SparkSession, d: str, touched: DataFrame | None = None, **how: Any) -> DataFrame:
    return matching.dedup_run(table(spark, d, "observations"), table(spark, d, "seller_boilerplate"), _image_hashes(spark, d), touched, **how)


def dedup_run(spark: SparkSession, d: str) -> DataFrame:
    """Every pair that a full run finds by any key, with its evidence and decision."""
    return _run(spark, d, columns=["img_match_count", "text_jaccard", "score"]).select("a", "b", F.col("img_match_count").cast("bigint").alias("img_match_count"), "text_jaccard", "score", "decision")


def dedup_touched(spark: SparkSession, d: str) -> DataFrame:
    """As ``dedup_run``, after a change of the listings of the last batch alone."""
    return _run(spark, d, _last_batch(spark, d), columns=["score"]).select("a", "b", "score", "decision")


def dedup_clusters(spark: SparkSession, d: str) -> DataFrame:
    """The clusters that a full run ends in: pairs, evidence, decisions, groups."""
    links = _run(spark, d, columns=[], merges_only=True)
    _, groups = clusters.rebuilt(links, table(spark, d, "listings"), table(spark, d, "clusters"))
    return groups.select("cluster_id", "size", "status", "canonical_listing_id")


def pair_jaccard(spark: SparkSession, d: str) -> DataFrame:
    """Exact similarity of five-character shingles of the whole texts of the pairs compared, each the latest description without its seller's known snippets."""
    feats = matching.features(table(spark, d, "observations"), table(spark, d, "seller_boilerplate"))
    said = feats.select("listing_id", text.fold(F.col("clean_text")).alias("t"))
    met = _stored_pairs(spark, d).join(said.toDF("a", "ta"), "a").join(said.toDF("b", "tb"), "b")
    met = met.select("a", "b", text.shingles(F.col("ta")).alias("sa"), text.shingles(F.col("tb")).alias("sb"))
    return met.select("a", "b", F.round(text.jaccard(F.col("sa"), F.col("sb")), 6).alias("jaccard"))


def image_hashes(spark: SparkSession, d: str) -> DataFrame:
    """The sign bits of every embedding as a 64-bit hash, with its bands."""
    e = table(spark, d, "embeddings").select("vec_id", hashes.sign_bits(F.col("embedding")).alias("bits"))
    return e.select("vec_id", "bits", F.array_join(hashes.hash_bands(F.col("bits")), ",").alias("bands"))


def near_hashes(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of embeddings whose sign hashes differ in at most 20 bits: of eight bands one then differs in at most two."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), hashes.sign_bits(F.col("embedding")).alias("bits"))
    return matching.near_hashes(e, near=20, bands=8, radius=2)


def cluster_groups(spark: SparkSession, d: str) -> DataFrame:
    """Clusters rebuilt from the links of the pair rows, with their size and status."""
    links = clusters.effective_links(table(spark, d, "dedup_pairs"))
    _, groups = clusters.rebuilt(links, table(spark, d, "listings"), table(spark, d, "clusters"))
    return groups.select("cluster_id", "size", "status", "canonical_listing_id")


def cluster_roots(spark: SparkSession, d: str) -> DataFrame:
    return clusters.connected(clusters.effective_links(table(spark, d, "dedup_pairs")))


def review_queue(spark: SparkSession, d: str) -> DataFrame:
    top = clusters.review_queue(table(spark, d, "dedup_pairs"), table(spark, d, "listings"))
    return top.select("id", "listing_a", "listing_b", F.round(F.col("score").cast("double"), 4).alias("score"), "url_a", "url_b")


def relabelled(spark: SparkSession, d: str) -> DataFrame:
    """The pairs after their own labels, read as label events, are applied to the unlabelled rest."""
    label = F.nullif(F.lower(F.trim("human_label")), F.lit(""))
    p = table(spark, d, "dedup_pairs").filter("listing_a <> listing_b").withColumn("label", label)
    events = p.filter("label IS NOT NULL").select("listing_a", "listing_b", "label", F.col("labeled_at").alias("at"))
    ordered = p.filter("label IS NULL").withColumns(clusters.ordered_pair())
    bare = ordered.groupBy("listing_a", "listing_b").agg(F.max_by(F.lower(F.trim("decision")), "id").alias("decision")).withColumn("human_label", F.lit(None).cast("string"))
    return clusters.relabelled(bare, events)


def append_unseen(spark: SparkSession, d: str) -> DataFrame:
    """The contents that the second half of the observations adds to the first."""
    o = table(spark, d, "observations").select("id", "listing_id", F.lower("content_hash").alias("content_hash"))
    half = F.broadcast(o.agg(((F.min("id") + F.max("id")) / 2).alias("half")))
    o = o.crossJoin(half)
    new = o.filter("id > half").groupBy("listing_id", "content_hash").agg(F.min("id").alias("id"))
    return stores.unseen(o.filter("id <= half"), new, ["listing_id", "content_hash"]).select("id", "listing_id", "content_hash")


def append_changed(spark: SparkSession, d: str) -> DataFrame:
    """The observations whose price or area differs from the one before."""
    o = table(spark, d, "observations").select("id", "listing_id", "captured_at", "price_eur", "area_m2")
    return stores.changed(o.limit(0), o, "listing_id", ["price_eur", "area_m2"], ["captured_at", "id"]).select("id", "listing_id")


def content_hashes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "observations").select("id", hashes.content_hash(["title", "rooms", "floor", "location_raw"]).alias("hash"))


def upsert_listings(spark: SparkSession, d: str) -> DataFrame:
    """Listings after every observation is taken as a sighting of its listing."""
    ads = current.distinct_listings(table(spark, d, "listings"))
    seen = table(spark, d, "observations").groupBy("listing_id").agg(F.max("captured_at").alias("last_seen"))
    sightings = seen.join(ads.select(F.col("id").alias("listing_id"), "source", "source_id"), "listing_id").withColumn("url", F.lit(None).cast("string")).drop("listing_id")
    out = stores.seen_listings(ads, sightings)
    return out.select("id", "source", "source_id", "url", F.coalesce(F.unix_micros("first_seen"), F.lit(-1)).alias("first_seen"), F.unix_micros("last_seen").alias("last_seen"))


def replaced_keys(spark: SparkSession, d: str) -> DataFrame:
    """The stored keys with those of the listings of the last batch replaced by their phone keys alone."""
    k = table(spark, d, "blocking_keys").distinct()
    batches = table(spark, d, "intake_batches")
    last = batches.join(F.broadcast(batches.agg(F.max("batch_no").alias("batch_no"))), "batch_no").select("listing_id").distinct()
    return stores.replaced(k, k.join(last, "listing_id", "left_semi").filter("key_type = 'phone'"), "listing_id")


def absent_listings(spark: SparkSession, d: str) -> DataFrame:
    """The active listings that no observation of the last quarter of the record saw, for the sources that had any."""
    ads = current.distinct_listings(table(spark, d, "listings"))
    o = table(spark, d, "observations").select("id", "listing_id")
    late = o.crossJoin(F.broadcast(o.agg((F.max("id") - (F.max("id") - F.min("id")) / 4).alias("from")))).filter("id >= from").select("listing_id").distinct()
    sightings = ads.join(late, ads.id == late.listing_id, "left_semi").select("source", "source_id")
    return stores.absent(ads.filter("active"), sightings, ["source", "source_id"], "source").select("id", "source")


def place_positions(spark: SparkSession, d: str) -> DataFrame:
    """The parts of each observation's place with their first position."""
    parts = table(spark, d, "observations").select("id", F.split("location_raw", ", ").alias("parts"))
    return stores.positions(parts, "id", "parts").select("id", "item", F.col("position").cast("bigint").alias("position"))


SPEC = json_records.RecordSpec(
    fields={"source_id": "id", "title": "ad.title", "price_eur": "ad.price", "location_parts": "ad.place", "images": "ad.images", "seller_is_company": "seller.company"},
    image_url="https://img.example/{value}.jpg", detail_url="https://ads.example/{source_id}", min_plausible_price=100.0, max_images=2,
)


def json_map(spark: SparkSession, d: str) -> DataFrame:
    """Every observation written as a record of a JSON endpoint and mapped back."""
    o = table(spark, d, "observations")
    ad = F.struct(
        F.col("title"), F.replace(F.col("price_eur").cast("string"), F.lit("."), F.lit(",")).alias("price"), F.split("location_raw", ", ").alias("place"),
        F.array(F.lit("a"), F.lit("b"), F.lit("c")).alias("images"),
    )
    seller = F.struct((F.col("seller_type") == "agency").alias("company"))
    record = F.to_json(F.struct("id", ad.alias("ad"), seller.alias("seller")))
    out = json_records.mapped(o.select(record.alias("record")), "record", SPEC)
    return out.select("source_id", "title", "price_eur", "price_placeholder", "url", F.array_join("images", ",").alias("images"), "seller_type", "location_raw", "location_specific")


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """Every document as an HTML page."""
    escape = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    doc = table(spark, d, "documents").filter("text IS NOT NULL")
    html = F.concat(
        F.lit("<html><head><title>x</title><script>var a = 1;</script></head><body><h1 class='t'>Doc "), F.col("doc_id").cast("string"), F.lit("</h1><ul><li>Source:</li><li>"),
        F.coalesce("source", F.lit("none")), F.lit("</li></ul><a class='ad' href='/oglas/"), F.col("doc_id").cast("string"), F.lit("?x=1'>more</a><p>"), escape(F.col("text")), F.lit("</p></body></html>"),
    )
    return doc.select("doc_id", "source", "text", html.alias("html"))


def html_fields(spark: SparkSession, d: str) -> DataFrame:
    specs = {"title": html_pages.FieldSpec(selector="h1.t"), "number": html_pages.FieldSpec(selector="body h1", regex=r"(\d+)"), "source": html_pages.FieldSpec(label="Source")}
    got = _pages(spark, d).select("doc_id", html_pages.extracted(F.col("html"), specs, html_pages.LinkSpec("a.ad", base="https://ads.example")).alias("f"))
    first = F.try_element_at("f.links", F.lit(1))
    return got.select("doc_id", "f.title", "f.number", "f.source", first["source_id"].alias("source_id"), first["url"].alias("url"))


def visible_text(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("doc_id", html_pages.visible_text(F.col("html")).alias("text"))


def page_urls(spark: SparkSession, d: str) -> DataFrame:
    """The address of the third page of every listing's address in each way of paging, the request for its id, and the shape of the address."""
    ads = current.distinct_listings(table(spark, d, "listings"))
    json_of = F.to_json(F.struct(F.lit(1).alias("page"), F.col("source_id").alias("id")))
    blob = F.concat(F.col("url"), F.lit("?q="), F.url_encode(F.url_encode(json_of)))
    third = lambda url, **how: urls.page_urls(url, F.lit(3), **how)
    return ads.select(
        "id", third(F.col("url")).alias("by_param"), third(F.col("url"), mode="path_suffix", start_at=0).alias("by_path"), third(blob, mode="json_param", param="q", double_encoded=True).alias("by_json"),
        urls.request_urls("https://ads.example/api", {"id": F.col("source_id"), "sort": "new", "none": ""}, F.lit(3)).alias("request"), urls.url_shape(F.col("url")).alias("shape"),
    )


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    fold_text, parsed_numbers, stripped_snippets, text_signatures, blocking_keys, blocking_keys_text, candidate_pairs, candidate_blocks, touched_pairs, touched_blocks, pair_scores, pair_jaccard, dedup_run, dedup_touched, dedup_clusters, image_hashes,
    near_hashes, cluster_groups, cluster_roots, review_queue, relabelled, append_unseen, append_changed, content_hashes, upsert_listings, replaced_keys, absent_listings, place_positions,
    json_map, html_fields, visible_text, page_urls,
)}

_FOLD = "trim(regexp_replace(lower(replace(strip_accents(translate({}, 'đĐ', 'dD')), 'ß', 'ss')), '\\s+', ' ', 'g'))"
_NOW = "now_ AS (SELECT * FROM observations WHERE listing_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY listing_id ORDER BY captured_at DESC NULLS LAST, id DESC) = 1)"
_PLACE = f"list_filter(list_transform(string_split({{0}}, ','), lambda x: {_FOLD.format('x')}), lambda p: p NOT IN ('', 'hrvatska', 'croatia'))[-1]"
_DIGITS = "ltrim(regexp_replace({}, '\\D', '', 'g'), '0')"
_PHONE = f"CASE WHEN {{0}} <> '' AND length(CASE WHEN {{0}} LIKE '385%' THEN {{0}} ELSE '385' || {{0}} END) >= 11 THEN CASE WHEN {{0}} LIKE '385%' THEN {{0}} ELSE '385' || {{0}} END END".format(_DIGITS.format("seller_phone"))
_FLOOR = "CASE " + " ".join(f"WHEN contains({_FOLD.format('floor')}, '{w}') THEN '{v}'" for w, v in numbers.FLOOR_WORDS) + f" ELSE try_cast(nullif(regexp_extract({_FOLD.format('floor')}, '(-?\\d+)', 1), '') AS BIGINT)::VARCHAR END"
_PAIRS = "pairs AS (SELECT DISTINCT least(listing_a, listing_b) AS a, greatest(listing_a, listing_b) AS b FROM dedup_pairs WHERE listing_a <> listing_b)"
_LINKS = """link AS (SELECT listing_a AS a, listing_b AS b FROM dedup_pairs WHERE listing_a <> listing_b
  AND CASE WHEN nullif(lower(trim(human_label)), '') IS NOT NULL THEN lower(trim(human_label)) = 'same' ELSE lower(trim(decision)) = 'merge' END),
edge AS (SELECT a AS x, b AS y FROM link UNION SELECT b, a FROM link),
reach(x, y) AS (SELECT x, x FROM edge UNION SELECT r.x, e.y FROM reach r JOIN edge e ON e.x = r.y)"""
_BITS = "list_sum(list_transform(range(1, 64), lambda i: CASE WHEN embedding[i] > 0 THEN 1::HUGEINT << (i - 1) ELSE 0::HUGEINT END))"
_SIGNED = f"({_BITS} - CASE WHEN embedding[64] > 0 THEN 9223372036854775808::HUGEINT ELSE 0::HUGEINT END)::BIGINT"
_LAST = "last_ AS (SELECT DISTINCT listing_id FROM intake_batches WHERE batch_no = (SELECT max(batch_no) FROM intake_batches))"
_KEYS = """k AS (SELECT DISTINCT listing_id, key_type, lower(trim(key_value)) AS key_value FROM blocking_keys WHERE listing_id IS NOT NULL AND key_type IS NOT NULL AND key_value IS NOT NULL),
sized AS (SELECT *, count(*) OVER (PARTITION BY key_type, key_value) AS size FROM k)"""
_CAND = f"""{_KEYS},
cand AS (SELECT DISTINCT x.listing_id AS a, y.listing_id AS b FROM sized x JOIN sized y ON x.key_type = y.key_type AND x.key_value = y.key_value AND x.listing_id < y.listing_id WHERE x.size <= {MOST})"""
_LARGE = f"SELECT key_type, key_value, size, listing_id FROM sized WHERE size > {MOST}"

SQL = {
    "fold_text": f"SELECT id, coalesce({_FOLD.format('location_raw')}, '') AS folded, {_PLACE.format('location_raw')} AS place, lower(replace(strip_accents(translate(seller_name, 'đĐ', 'dD')), 'ß', 'ss')) AS seller FROM observations",
    "parsed_numbers": f"SELECT id, {_FLOOR} AS floor, try_cast({_FLOOR} AS INT)::VARCHAR AS floor_num, {_PHONE} AS phone, area_m2::DOUBLE AS area, coalesce(abs(area_m2::DOUBLE - round_even(area_m2::DOUBLE, 0)) > 0.05, false) AS is_precise, area_m2::DOUBLE AS grouped FROM observations",
    "blocking_keys": f"""WITH {_NOW},
f AS (SELECT listing_id, nullif(price_eur::DOUBLE, 0) AS price, nullif(area_m2::DOUBLE, 0) AS area, coalesce(location_norm, {_PLACE.format('location_raw')}, '') AS place, {_PHONE} AS phone FROM now_)
SELECT DISTINCT listing_id, key_type, key_value FROM (
  SELECT listing_id, 'area_city' AS key_type, round_even(area, 0)::BIGINT || '|' || place AS key_value FROM f
  UNION ALL SELECT listing_id, 'area_band', floor(area / 10)::BIGINT || '|' || place FROM f
  UNION ALL SELECT listing_id, 'area_band', round_even(area / 10, 0)::BIGINT || '|' || place FROM f
  UNION ALL SELECT listing_id, 'price_place', round_even(price, 0)::BIGINT || '|' || place FROM f
  UNION ALL SELECT listing_id, 'phone', phone FROM f) WHERE key_value IS NOT NULL""",
    "candidate_pairs": f"WITH {_CAND} SELECT a, b FROM cand",
    "candidate_blocks": f"WITH {_KEYS} {_LARGE}",
    "touched_blocks": f"WITH {_KEYS}, {_LAST} {_LARGE} AND (key_type, key_value) IN (SELECT (key_type, key_value) FROM k WHERE listing_id IN (SELECT listing_id FROM last_))",
    "touched_pairs": f"WITH {_CAND}, {_LAST} SELECT a, b FROM cand WHERE a IN (SELECT listing_id FROM last_) OR b IN (SELECT listing_id FROM last_)",
    "image_hashes": f"""WITH h AS (SELECT vec_id, {_SIGNED} AS bits FROM embeddings),
u AS (SELECT vec_id, bits, CASE WHEN bits < 0 THEN bits::HUGEINT + 18446744073709551616::HUGEINT ELSE bits::HUGEINT END AS un FROM h)
SELECT vec_id, bits, array_to_string(list_transform(range(0, 4), lambda i: i || ':' || printf('%04x', ((un >> (i * 16)::INT) % 65536)::INT)), ',') AS bands FROM u""",
    "near_hashes": f"""WITH c AS (SELECT min(vec_id) AS id, bits FROM (SELECT vec_id, {_SIGNED} AS bits FROM embeddings) GROUP BY bits)
SELECT x.id AS a, y.id AS b, bit_count(xor(x.bits, y.bits))::BIGINT AS distance FROM c x JOIN c y ON x.id < y.id WHERE bit_count(xor(x.bits, y.bits)) <= 20""",
    "cluster_roots": f"WITH RECURSIVE {_LINKS} SELECT x AS node, min(y) AS root FROM reach GROUP BY x",
    "review_queue": """WITH top AS (SELECT id, listing_a, listing_b, score FROM dedup_pairs
  WHERE lower(trim(decision)) = 'review' AND coalesce(trim(human_label), '') = '' ORDER BY score DESC NULLS LAST, id LIMIT 50),
ads AS (SELECT DISTINCT id, url FROM listings)
SELECT t.id, listing_a, listing_b, round(score::DECIMAL(20,9), 4)::DOUBLE AS score, x.url AS url_a, y.url AS url_b FROM top t LEFT JOIN ads x ON x.id = listing_a LEFT JOIN ads y ON y.id = listing_b""",
    "relabelled": """WITH p AS (SELECT id, least(listing_a, listing_b) AS a, greatest(listing_a, listing_b) AS b, lower(trim(decision)) AS decision,
  nullif(lower(trim(human_label)), '') AS label, labeled_at FROM dedup_pairs WHERE listing_a <> listing_b),
e AS (SELECT a, b, arg_max(label, (coalesce(epoch_us(labeled_at), -1), label)) AS label FROM p WHERE label IS NOT NULL GROUP BY ALL),
u AS (SELECT a, b, arg_max(decision, id) AS decision FROM p WHERE label IS NULL GROUP BY ALL)
SELECT coalesce(u.a, e.a) AS listing_a, coalesce(u.b, e.b) AS listing_b,
       coalesce(decision, CASE WHEN label = 'same' THEN 'merge' ELSE 'distinct' END) AS decision, label AS human_label
FROM u FULL JOIN e ON u.a = e.a AND u.b = e.b""",
    "append_unseen": """WITH o AS (SELECT id, listing_id, lower(content_hash) AS content_hash, (min(id) OVER () + max(id) OVER ()) / 2.0 AS half FROM observations),
n AS (SELECT listing_id, content_hash, min(id) AS id FROM o WHERE id > half GROUP BY ALL)
SELECT id, listing_id, content_hash FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE id <= half AND o.listing_id = n.listing_id AND o.content_hash = n.content_hash)""",
    "append_changed": """WITH o AS (SELECT id, listing_id, price_eur, area_m2, row_number() OVER w AS n, lag(price_eur) OVER w AS p, lag(area_m2) OVER w AS a
  FROM observations WINDOW w AS (PARTITION BY listing_id ORDER BY captured_at, id))
SELECT id, listing_id FROM o WHERE n = 1 OR price_eur IS DISTINCT FROM p OR area_m2 IS DISTINCT FROM a""",
    "content_hashes": """SELECT id, sha256('floor=' || coalesce('''' || floor || '''', 'null') || '|location_raw=' || coalesce('''' || location_raw || '''', 'null')
  || '|rooms=' || coalesce('''' || rooms || '''', 'null') || '|title=' || coalesce('''' || title || '''', 'null')) AS hash FROM observations""",
    "upsert_listings": """WITH ads AS (SELECT DISTINCT * FROM listings), s AS (SELECT listing_id, max(captured_at) AS seen FROM observations GROUP BY 1)
SELECT id, source, source_id, url, coalesce(epoch_us(first_seen), -1) AS first_seen, epoch_us(greatest(last_seen, seen)) AS last_seen FROM ads LEFT JOIN s ON s.listing_id = id""",
    "replaced_keys": f"""WITH {_LAST}, k AS (SELECT DISTINCT * FROM blocking_keys), n AS (SELECT * FROM k WHERE key_type = 'phone' AND listing_id IN (SELECT listing_id FROM last_))
SELECT * FROM k WHERE listing_id NOT IN (SELECT listing_id FROM n) UNION ALL SELECT * FROM n""",
    "absent_listings": """WITH ads AS (SELECT DISTINCT * FROM listings),
s AS (SELECT DISTINCT listing_id FROM observations WHERE id >= (SELECT max(id) - (max(id) - min(id)) / 4.0 FROM observations))
SELECT id, source FROM ads WHERE active AND id NOT IN (SELECT listing_id FROM s WHERE listing_id IS NOT NULL)
  AND source IN (SELECT source FROM ads WHERE id IN (SELECT listing_id FROM s))""",
    "place_positions": """WITH p AS (SELECT id, unnest(string_split(location_raw, ', ')) AS item, generate_subscripts(string_split(location_raw, ', '), 1) - 1 AS position FROM observations)
SELECT id, item, min(position)::BIGINT AS position FROM p GROUP BY ALL""",
    "json_map": """SELECT id::VARCHAR AS source_id, title, CASE WHEN price_eur >= 100 THEN price_eur::DOUBLE END AS price_eur, coalesce(price_eur < 100, false) AS price_placeholder,
  'https://ads.example/' || id AS url, 'https://img.example/a.jpg,https://img.example/b.jpg' AS images,
  CASE WHEN seller_type = 'agency' THEN 'agency' WHEN seller_type IS NOT NULL THEN 'private' END AS seller_type,
  nullif(location_raw, '') AS location_raw, string_split(location_raw, ', ')[-1] AS location_specific FROM observations""",
    "html_fields": """SELECT doc_id, 'Doc ' || doc_id AS title, doc_id::VARCHAR AS number, coalesce(source, 'none') AS source, doc_id::VARCHAR AS source_id, 'https://ads.example/oglas/' || doc_id || '?x=1' AS url
FROM documents WHERE text IS NOT NULL""",
    "page_urls": """SELECT id, url || '?page=3' AS by_param, rtrim(url, '/') || '/2' AS by_path,
  url || '?q=' || url_encode(url_encode('{"page":3,"id":"' || source_id || '"}')) AS by_json, 'https://ads.example/api?id=' || url_encode(source_id) || '&sort=new&page=3' AS request,
  regexp_replace(regexp_replace(url, '[a-z0-9]+(?:-[a-z0-9]+){2,}', 'SLUG', 'g'), '\\d+', 'N', 'g') AS shape FROM (SELECT DISTINCT * FROM listings)""",
}
