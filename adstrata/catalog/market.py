"""Queries of current state, price history, search, ended ads and the summary."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adstrata.operators import current, ended, search
from adstrata.sources.tables import table

AS_OF = "2025-06-01 00:00:00"
Query = Callable[[SparkSession, str], DataFrame]


def _both(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, d, "listings"), table(spark, d, "observations")


def _doubles(df: DataFrame) -> DataFrame:
    """Decimals as doubles, times as microseconds, other counts as 64-bit integers: what both engines print alike."""
    out = []
    for c, kind in df.dtypes:
        x = F.col(c)
        if kind.startswith("decimal"):
            x = x.cast("double")
        elif kind == "timestamp":
            x = F.unix_micros(c)
        elif kind == "int":
            x = x.cast("bigint")
        out.append(x.alias(c))
    return df.select(*out)


def current_state(spark: SparkSession, d: str) -> DataFrame:
    return _doubles(current.current_state(table(spark, d, "observations"), ["title", "price_eur", "area_m2", "location_norm"]))


def price_history(spark: SparkSession, d: str) -> DataFrame:
    return _doubles(current.cluster_price_history(*_both(spark, d)).select("cluster_id", "listing_id", "observation_id", "captured_at", "price_eur", "price_per_m2"))


def price_changes(spark: SparkSession, d: str) -> DataFrame:
    return _doubles(current.cluster_price_changes(current.cluster_price_history(*_both(spark, d))))


def price_drops(spark: SparkSession, d: str) -> DataFrame:
    out = current.price_drops(*_both(spark, d), as_of=AS_OF, days=365)
    points = F.array_join(F.transform("price_history", lambda p: F.concat_ws(":", F.unix_micros(p["captured_at"]).cast("string"), (p["price_eur"] * 100).cast("bigint").cast("string"), p["listing_id"].cast("string"))), ",")
    return _doubles(out.select("cluster_id", "listing_id", "source", "url", "title", "first_price", "latest_price", "change_pct", "change_eur", "listing_count", points.alias("price_history")))


def reposts(spark: SparkSession, d: str) -> DataFrame:
    out = current.repost_points(current.cluster_price_history(*_both(spark, d)))
    return out.groupBy("cluster_id").agg(F.count_if("reposted").alias("reposts"))


def _search(**what) -> Query:
    def query(spark: SparkSession, d: str) -> DataFrame:
        page = search.search(*_both(spark, d), search.Search(**what))
        return _doubles(page.select("listing_id", "group_key", "source", "title", "price_eur", "area_m2", "price_per_m2", "duplicate_count"))

    return query


def search_pages(spark: SparkSession, d: str) -> DataFrame:
    found = search.collapsed(search.matching(search.listing_view(*_both(spark, d)), search.Search()))
    return search.page_counts(found)


def hidden_groups(spark: SparkSession, d: str) -> DataFrame:
    """The properties left after an anti-join with those of which any ad is in a flagged cluster."""
    listings, observations = _both(spark, d)
    flagged = table(spark, d, "clusters").filter("status = 'flagged'").select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("group_key"))
    return search.matching(search.listing_view(listings, observations), search.Search(active_only=False), flagged).select("listing_id", "group_key")


def siblings(spark: SparkSession, d: str) -> DataFrame:
    return search.cluster_siblings(search.listing_view(*_both(spark, d)))


def detail_history(spark: SparkSession, d: str) -> DataFrame:
    return _doubles(search.detail_history(*_both(spark, d)))


def fulltext_rank(spark: SparkSession, d: str) -> DataFrame:
    found = search.matching(search.listing_view(*_both(spark, d), with_text=True), search.Search(q="Cijena stan", active_only=False))
    return found.select("listing_id", F.round("rank", 6).alias("rank"))


def area_medians(spark: SparkSession, d: str) -> DataFrame:
    return ended.area_medians(search.listing_view(*_both(spark, d))).select("location_raw", F.round("median_price_per_m2", 4).alias("median_price_per_m2"))


def _ended(sort: str, **what) -> Query:
    def query(spark: SparkSession, d: str) -> DataFrame:
        feed = ended.ended_feed(ended.ended_listings(*_both(spark, d)), AS_OF, sort=sort, days=3650, **what)
        return _doubles(feed.select("listing_id", "status_reason", "price_eur", "first_price", "last_price", "price_change_pct", "days_listed", "vs_area_median_pct", "still_listed_elsewhere"))

    return query


def stats_summary(spark: SparkSession, d: str) -> DataFrame:
    listings, observations = _both(spark, d)
    changes = current.cluster_price_changes(current.cluster_price_history(listings, observations))
    return _doubles(ended.summary(listings, observations, table(spark, d, "dedup_pairs"), changes, AS_OF))


def field_coverage(spark: SparkSession, d: str) -> DataFrame:
    """How many observations of each source's listings fill each field, and the shapes of its addresses."""
    listings, observations = _both(spark, d)
    ads = current.distinct_listings(listings).select(F.col("id").alias("listing_id"), "source")
    filled = [F.count(c).alias(c) for c in ("title", "description", "price_eur", "area_m2", "rooms", "floor", "location_raw", "seller_name", "seller_phone")]
    return observations.join(ads, "listing_id").groupBy("source").agg(F.count("*").alias("observations"), *filled)


FACET_SOURCES = ("krovnik", "oglasnik-mora", "stanovnica", "kvadrat-plus", "nekret-burza")
SEARCHES = {
    "search_newest": {},
    "search_oldest": {"sort": "oldest"},
    "search_cheapest": {"sort": "price_asc", "has_price": True},
    "search_dearest": {"sort": "price_desc"},
    "search_per_m2": {"sort": "price_per_m2"},
    "search_per_m2_desc": {"sort": "price_per_m2_desc", "page": 2},
    "search_largest": {"sort": "area_desc", "collapse_duplicates": False, "active_only": False},
    "search_smallest": {"sort": "area_asc", "page_size": 20},
    "search_facets": {"min_price": 50000, "max_price": 900000, "min_area": 20, "max_area": 300, "rooms": 2.0, "seller_type": "agency", "source": FACET_SOURCES, "active_only": False},
    "search_location": {"location": "borov", "active_only": False, "sort": "oldest", "page_size": 200},
    "search_words": {"q": "Cijena stan", "active_only": False, "sort": "newest", "page_size": 200},
    "search_relevance": {"q": "Cijena stan", "active_only": False, "sort": "relevance", "page_size": 200},
    "search_relevance_of_nothing": {"sort": "relevance"},
}
ENDED = {
    "ended_recent": ("recent", {}),
    "ended_fastest": ("fastest", {"hide_still_listed": False}),
    "ended_slowest": ("slowest", {"reason": "deleted"}),
    "ended_best_value": ("best_value", {"min_price": 50000}),
    "ended_biggest_drop": ("biggest_drop", {"max_days_listed": 60}),
    "ended_cheapest": ("price_asc", {"max_price": 300000, "page": 2, "page_size": 20}),
    "ended_dearest": ("price_desc", {"source": ("krovnik", "stanovnica")}),
}

QUERIES: dict[str, Query] = {
    "current_state": current_state, "price_history": price_history, "price_changes": price_changes, "price_drops": price_drops, "reposts": reposts,
    **{k: _search(**v) for k, v in SEARCHES.items()},
    "search_pages": search_pages, "hidden_groups": hidden_groups, "siblings": siblings, "detail_history": detail_history, "fulltext_rank": fulltext_rank,
    "area_medians": area_medians, **{k: _ended(s, **v) for k, (s, v) in ENDED.items()}, "stats_summary": stats_summary, "field_coverage": field_coverage,
}

_R = "round(({})::DECIMAL(30,9), {})::DOUBLE"
_ADS = "ads AS (SELECT DISTINCT * FROM listings)"
_NOW = "now_ AS (SELECT * FROM observations WHERE listing_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY listing_id ORDER BY captured_at DESC NULLS LAST, id DESC) = 1)"
_PPM = _R.format("o.price_eur / o.area_m2", 2)
_VIEW = f"""{_ADS}, {_NOW},
view_ AS (
  SELECT l.id AS listing_id, l.cluster_id, l.source, l.url, l.active, l.status, l.status_reason, l.first_seen, l.last_seen, l.removed_at,
         o.title, o.description, o.price_eur, o.area_m2, o.rooms, o.location_raw, o.seller_type,
         CASE WHEN o.area_m2 > 0 THEN {_PPM} END AS price_per_m2,
         coalesce('c' || l.cluster_id, 'l' || l.id) AS group_key
  FROM ads l JOIN now_ o ON o.listing_id = l.id)"""
_HISTORY = f"""{_ADS},
hist AS (
  SELECT l.cluster_id, o.listing_id, o.id AS observation_id, o.captured_at, o.price_eur, l.source, l.url,
         CASE WHEN o.area_m2 > 0 THEN {_PPM} END AS price_per_m2
  FROM observations o JOIN ads l ON l.id = o.listing_id WHERE o.price_eur IS NOT NULL AND l.cluster_id IS NOT NULL)"""
_CHANGES = f"""{_HISTORY},
raw AS (
  SELECT cluster_id, count(DISTINCT listing_id) AS listing_count, count(DISTINCT price_eur) AS price_points,
         min(captured_at) AS first_seen, max(captured_at) AS last_seen,
         arg_min(price_eur, (captured_at, observation_id)) AS first_price, arg_max(price_eur, (captured_at, observation_id)) AS latest_price,
         min(price_eur) AS min_price, max(price_eur) AS max_price
  FROM hist GROUP BY cluster_id HAVING count(DISTINCT price_eur) > 1),
changes AS (SELECT *, {_R.format("(latest_price - first_price) * 100 / nullif(first_price, 0)", 2)} AS change_pct FROM raw)"""
_SORT_SQL = {
    "newest": "first_seen DESC NULLS LAST, listing_id DESC", "oldest": "first_seen ASC NULLS LAST, listing_id",
    "price_asc": "nullif(price_eur, 0) ASC NULLS LAST, listing_id", "price_desc": "nullif(price_eur, 0) DESC NULLS LAST, listing_id",
    "price_per_m2": "nullif(price_per_m2, 0) ASC NULLS LAST, listing_id", "price_per_m2_desc": "nullif(price_per_m2, 0) DESC NULLS LAST, listing_id",
    "area_desc": "nullif(area_m2, 0) DESC NULLS LAST, listing_id", "area_asc": "nullif(area_m2, 0) ASC NULLS LAST, listing_id",
}
_SORT_SQL["relevance"] = f"rank DESC NULLS LAST, {_SORT_SQL['newest']}"
_PLAIN = "lower(replace(strip_accents(translate({}, 'đĐ', 'dD')), 'ß', 'ss'))"
_TOKENS = "regexp_extract_all(" + _PLAIN.format("coalesce(title, '') || ' ' || coalesce(description, '')") + r", '[\p{L}\p{N}]+')"

_RANK = f"len(list_filter({_TOKENS}, lambda x: x IN ('cijena', 'stan'))) / len({_TOKENS})"


def _search_sql(s: search.Search) -> str:
    where = ["TRUE"]
    where += [f"price_eur >= {s.min_price}"] * (s.min_price is not None) + [f"price_eur <= {s.max_price}"] * (s.max_price is not None)
    where += [f"area_m2 >= {s.min_area}"] * (s.min_area is not None) + [f"area_m2 <= {s.max_area}"] * (s.max_area is not None)
    where += [f"source IN {tuple(s.source)}"] * bool(s.source) + [f"rooms = {s.rooms}"] * (s.rooms is not None)
    where += [f"seller_type = '{s.seller_type}'"] * bool(s.seller_type) + ["active"] * s.active_only + ["price_eur IS NOT NULL"] * s.has_price
    where += [f"{_PLAIN.format('location_raw')} LIKE '%{s.location}%'"] * bool(s.location)
    where += [f"list_has_all({_TOKENS}, ['cijena', 'stan'])"] * bool(s.q)
    return f"""
WITH {_VIEW},
found AS (SELECT *, {_RANK if s.q else "0.0"} AS rank, count(*) OVER (PARTITION BY group_key) AS duplicate_count,
                 row_number() OVER (PARTITION BY group_key ORDER BY first_seen ASC NULLS LAST, listing_id) AS rn
          FROM view_ WHERE {" AND ".join(where)})
SELECT listing_id, group_key, source, title, price_eur::DOUBLE AS price_eur, area_m2::DOUBLE AS area_m2, price_per_m2, duplicate_count
FROM found WHERE {"rn = 1" if s.collapse_duplicates else "TRUE"}
ORDER BY {_SORT_SQL[s.sort]} LIMIT {s.page_size} OFFSET {(s.page - 1) * s.page_size}"""


_MEDIAN = """med AS (SELECT location_raw, median(CASE WHEN area_m2 > 0 THEN (price_eur / area_m2)::DOUBLE END) AS median_price_per_m2
        FROM view_ WHERE price_eur IS NOT NULL AND location_raw IS NOT NULL GROUP BY location_raw)"""


def _ended_sql(sort: str, what: dict) -> str:
    order = {
        "recent": "ended_at DESC NULLS LAST, listing_id DESC", "fastest": "days_listed ASC NULLS LAST, listing_id", "slowest": "days_listed DESC NULLS LAST, listing_id",
        "best_value": "vs_area_median_pct ASC NULLS LAST, listing_id", "biggest_drop": "price_change_pct ASC NULLS LAST, listing_id",
        "price_asc": _SORT_SQL["price_asc"], "price_desc": _SORT_SQL["price_desc"],
    }[sort]
    where = [f"ended_at >= TIMESTAMPTZ '{AS_OF}+00' - INTERVAL 3650 DAY"]
    where += [f"source IN {what.get('source')}"] * ("source" in what) + [f"status_reason = '{what.get('reason')}'"] * ("reason" in what)
    where += [f"price_eur >= {what.get('min_price')}"] * ("min_price" in what) + [f"price_eur <= {what.get('max_price')}"] * ("max_price" in what)
    where += [f"days_listed <= {what.get('max_days_listed')}"] * ("max_days_listed" in what) + ["NOT still_listed_elsewhere"] * what.get("hide_still_listed", True)
    size = what.get("page_size", 50)
    return f"""
WITH {_VIEW}, {_MEDIAN},
prices AS (SELECT listing_id, arg_min(price_eur, (captured_at, id)) AS first_price, arg_max(price_eur, (captured_at, id)) AS last_price
           FROM observations WHERE price_eur IS NOT NULL GROUP BY listing_id),
live AS (SELECT DISTINCT cluster_id FROM ads WHERE status = 'active' AND cluster_id IS NOT NULL),
gone AS (
  SELECT v.*, p.first_price, p.last_price, coalesce(v.removed_at, v.last_seen) AS ended_at,
         {_R.format("(p.last_price - p.first_price) * 100 / nullif(p.first_price, 0)", 2)} AS price_change_pct,
         {_R.format("CASE WHEN v.first_seen IS NOT NULL THEN greatest(0, (epoch_us(coalesce(v.removed_at, v.last_seen)) - epoch_us(v.first_seen)) / 86400000000.0) END", 1)} AS days_listed,
         CASE WHEN median_price_per_m2 > 0 AND price_per_m2 > 0 THEN {_R.format("(price_per_m2 - median_price_per_m2) / median_price_per_m2 * 100", 1)} END AS vs_area_median_pct,
         (live.cluster_id IS NOT NULL) AS still_listed_elsewhere
  FROM view_ v LEFT JOIN prices p USING (listing_id) LEFT JOIN med USING (location_raw) LEFT JOIN live ON live.cluster_id = v.cluster_id
  WHERE v.status = 'gone')
SELECT listing_id, status_reason, price_eur::DOUBLE AS price_eur, first_price::DOUBLE AS first_price, last_price::DOUBLE AS last_price,
       price_change_pct, days_listed, vs_area_median_pct, still_listed_elsewhere
FROM gone WHERE {" AND ".join(where)} ORDER BY {order} LIMIT {size} OFFSET {(what.get("page", 1) - 1) * size}"""


SQL = {
    "current_state": f"WITH {_NOW} SELECT listing_id, id, epoch_us(captured_at) AS captured_at, title, price_eur::DOUBLE AS price_eur, area_m2::DOUBLE AS area_m2, location_norm FROM now_",
    "price_history": f"WITH {_HISTORY} SELECT cluster_id, listing_id, observation_id, epoch_us(captured_at) AS captured_at, price_eur::DOUBLE AS price_eur, price_per_m2 FROM hist",
    "price_changes": f"""WITH {_CHANGES} SELECT cluster_id, listing_count, price_points, epoch_us(first_seen) AS first_seen, epoch_us(last_seen) AS last_seen,
  first_price::DOUBLE AS first_price, latest_price::DOUBLE AS latest_price, min_price::DOUBLE AS min_price, max_price::DOUBLE AS max_price, change_pct FROM changes""",
    "price_drops": f"""WITH {_CHANGES}, {_NOW},
drops AS (SELECT * FROM changes WHERE change_pct <= -2.0 AND last_seen >= TIMESTAMPTZ '{AS_OF}+00' - INTERVAL 365 DAY ORDER BY change_pct, cluster_id LIMIT 50),
rep AS (SELECT cluster_id, id AS listing_id, source, url FROM ads WHERE cluster_id IN (SELECT cluster_id FROM drops)
        QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY active DESC NULLS LAST, last_seen DESC NULLS LAST, id) = 1),
points AS (SELECT cluster_id, string_agg(epoch_us(captured_at) || ':' || (price_eur * 100)::BIGINT || ':' || listing_id, ',' ORDER BY captured_at, observation_id) AS price_history FROM hist GROUP BY cluster_id)
SELECT d.cluster_id, r.listing_id, r.source, r.url, n.title, first_price::DOUBLE AS first_price, latest_price::DOUBLE AS latest_price, change_pct,
       (latest_price - first_price)::DOUBLE AS change_eur, listing_count, price_history
FROM drops d JOIN rep r USING (cluster_id) LEFT JOIN now_ n ON n.listing_id = r.listing_id LEFT JOIN points USING (cluster_id)""",
    "reposts": f"""WITH {_HISTORY}, p AS (SELECT cluster_id, listing_id, lag(listing_id) OVER (PARTITION BY cluster_id ORDER BY captured_at, observation_id) AS before FROM hist)
SELECT cluster_id, count(*) FILTER (WHERE before <> listing_id) AS reposts FROM p GROUP BY cluster_id""",
    **{k: _search_sql(search.Search(**v)) for k, v in SEARCHES.items()},
    "search_pages": f"WITH {_VIEW}, g AS (SELECT DISTINCT group_key FROM view_ WHERE active) SELECT count(*) AS total, ceil(count(*) / 50.0)::BIGINT AS pages FROM g",
    "hidden_groups": f"WITH {_VIEW} SELECT listing_id, group_key FROM view_ v WHERE NOT EXISTS (SELECT 1 FROM clusters c WHERE c.status = 'flagged' AND 'c' || c.id = v.group_key)",
    "siblings": f"""WITH {_VIEW}, n AS (SELECT cluster_id, count(DISTINCT listing_id) AS n FROM view_ WHERE cluster_id IS NOT NULL GROUP BY cluster_id)
SELECT DISTINCT v.listing_id, v.cluster_id, coalesce(n, 1) AS duplicate_count FROM view_ v LEFT JOIN n USING (cluster_id)""",
    "detail_history": f"""WITH {_ADS} SELECT coalesce('c' || l.cluster_id, 'l' || l.id) AS group_key, o.id AS observation_id, epoch_us(captured_at) AS captured_at, price_eur::DOUBLE AS price_eur, o.listing_id
FROM observations o JOIN ads l ON l.id = o.listing_id WHERE price_eur IS NOT NULL""",
    "fulltext_rank": f"""WITH {_VIEW}, t AS (SELECT listing_id, {_TOKENS} AS tokens FROM view_)
SELECT listing_id, {_R.format("len(list_filter(tokens, lambda x: x IN ('cijena', 'stan'))) / len(tokens)", 6)} AS rank FROM t WHERE list_has_all(tokens, ['cijena', 'stan'])""",
    "area_medians": f"WITH {_VIEW}, {_MEDIAN} SELECT location_raw, {_R.format('median_price_per_m2', 4)} AS median_price_per_m2 FROM med",
    **{k: _ended_sql(s, v) for k, (s, v) in ENDED.items()},
    "stats_summary": f"""WITH {_CHANGES},
l AS (SELECT count(*) AS listings, count(*) FILTER (WHERE active) AS active_listings, count(*) FILTER (WHERE status = 'gone') AS gone_listings,
             count(DISTINCT cluster_id) AS clusters, (SELECT string_agg(source, ',' ORDER BY source) FROM (SELECT DISTINCT source FROM ads)) AS sources, epoch_us(max(last_seen)) AS last_seen FROM ads),
dup AS (SELECT coalesce(sum(n - 1), 0)::BIGINT AS duplicates FROM (SELECT count(*) AS n FROM ads WHERE cluster_id IS NOT NULL GROUP BY cluster_id)),
o AS (SELECT count(*) AS observations, count(price_eur) AS priced_observations FROM observations),
p AS (SELECT count(*) FILTER (WHERE lower(trim(decision)) = 'merge') AS merge_rows,
             count(*) FILTER (WHERE lower(trim(decision)) = 'review' AND human_label IS NULL) AS review_rows, count(human_label) AS labelled_rows FROM dedup_pairs),
d AS (SELECT count(*) FILTER (WHERE change_pct < 0 AND last_seen >= TIMESTAMPTZ '{AS_OF}+00' - INTERVAL 30 DAY) AS drops_30d FROM changes)
SELECT * FROM l, dup, o, p, d""",
    "field_coverage": f"""WITH {_ADS} SELECT source, count(*) AS observations, count(title) AS title, count(description) AS description, count(price_eur) AS price_eur, count(area_m2) AS area_m2,
  count(rooms) AS rooms, count(floor) AS floor, count(location_raw) AS location_raw, count(seller_name) AS seller_name, count(seller_phone) AS seller_phone
FROM observations o JOIN ads l ON l.id = o.listing_id GROUP BY source""",
}
