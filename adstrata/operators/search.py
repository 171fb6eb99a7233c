"""Faceted and full-text search with duplicate collapsing."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from adstrata.functions import text
from adstrata.operators.current import current_state, distinct_listings, price_per_m2

PAGE_SIZE, MAX_PAGE_SIZE = 50, 200


@dataclass(frozen=True)
class Search:
    """What to look for; None and empty leave a facet open. A range or equality never matches a null."""

    q: str | None = None
    source: Sequence[str] = ()
    min_price: float | None = None
    max_price: float | None = None
    min_area: float | None = None
    max_area: float | None = None
    rooms: float | None = None
    location: str | None = None
    seller_type: str | None = None
    active_only: bool = True
    has_price: bool = False
    collapse_duplicates: bool = True
    sort: str = "newest"
    page: int = 1
    page_size: int = PAGE_SIZE


def _known(c: str) -> Column:
    return F.nullif(F.col(c), F.lit(0))


SORTS = {
    "newest": lambda: [F.col("first_seen").desc_nulls_last(), F.col("listing_id").desc()],
    "oldest": lambda: [F.col("first_seen").asc_nulls_last(), F.col("listing_id").asc()],
    "price_asc": lambda: [_known("price_eur").asc_nulls_last(), F.col("listing_id").asc()],
    "price_desc": lambda: [_known("price_eur").desc_nulls_last(), F.col("listing_id").asc()],
    "price_per_m2": lambda: [_known("price_per_m2").asc_nulls_last(), F.col("listing_id").asc()],
    "price_per_m2_desc": lambda: [_known("price_per_m2").desc_nulls_last(), F.col("listing_id").asc()],
    "area_desc": lambda: [_known("area_m2").desc_nulls_last(), F.col("listing_id").asc()],
    "area_asc": lambda: [_known("area_m2").asc_nulls_last(), F.col("listing_id").asc()],
    "relevance": lambda: [F.col("rank").desc_nulls_last(), F.col("first_seen").desc_nulls_last(), F.col("listing_id").desc()],
}


SHOWN = ["title", "price_eur", "area_m2", "rooms", "floor", "location_raw", "location_norm", "seller_type", "seller_name", "seller_phone"]


def listing_view(listings: DataFrame, observations: DataFrame, with_text: bool = False) -> DataFrame:
    """Each listing with its latest observation, price per m², and the key of its property (its cluster, else itself).

    Descriptions, by far the widest column, are only read ``with_text``.
    """
    ads = distinct_listings(listings).withColumnRenamed("id", "listing_id").drop("category")
    shown = current_state(observations, [*SHOWN, *["description"] * with_text]).drop("id")
    key = F.coalesce(F.concat(F.lit("c"), F.col("cluster_id").cast("string")), F.concat(F.lit("l"), F.col("listing_id").cast("string")))
    return ads.join(shown, "listing_id").withColumns({"price_per_m2": price_per_m2(), "group_key": key})


def matching(view: DataFrame, s: Search, hidden: DataFrame | None = None) -> DataFrame:
    """The rows of ``view`` that ``s`` looks for, with ``rank``; properties in ``hidden`` (group_key) are left out."""
    out = view
    ranges = [("price_eur", s.min_price, s.max_price), ("area_m2", s.min_area, s.max_area)]
    for column, low, high in ranges:
        if low is not None:
            out = out.filter(F.col(column) >= low)
        if high is not None:
            out = out.filter(F.col(column) <= high)
    if s.source:
        out = out.filter(F.col("source").isin(list(s.source)))
    if s.rooms is not None:
        out = out.filter(F.col("rooms") == s.rooms)
    if s.seller_type:
        out = out.filter(F.col("seller_type") == s.seller_type)
    if s.active_only:
        out = out.filter("active")
    if s.has_price:
        out = out.filter("price_eur IS NOT NULL")
    if s.location:
        out = out.filter(text.like_folded(F.col("location_raw"), s.location))
    rank = F.lit(0.0)
    if s.q:
        tokens = text.words(F.concat_ws(" ", "title", "description"))
        out = out.withColumn("__tokens", tokens).filter(text.has_words(F.col("__tokens"), s.q))
        rank = text.rank_words(F.col("__tokens"), s.q)
    out = out.withColumn("rank", rank).drop("__tokens")
    if hidden is not None:
        out = out.join(hidden.select("group_key").distinct(), "group_key", "left_anti")
    return out


def collapsed(found: DataFrame, collapse: bool = True) -> DataFrame:
    """``found`` with ``duplicate_count``, the matching ads of the property; with ``collapse`` only the earliest of them stays."""
    group = W.partitionBy("group_key")
    counted = found.withColumn("duplicate_count", F.count("*").over(group))
    if not collapse:
        return counted
    first = F.row_number().over(group.orderBy(F.col("first_seen").asc_nulls_last(), "listing_id"))
    return counted.withColumn("__rn", first).filter("__rn = 1").drop("__rn")


def search(listings: DataFrame, observations: DataFrame, s: Search, hidden: DataFrame | None = None) -> DataFrame:
    """One page of results in order. ``relevance`` without words to look for means ``newest``."""
    found = collapsed(matching(listing_view(listings, observations, bool(s.q)), s, hidden), s.collapse_duplicates)
    return paged(found, s.sort if s.q or s.sort != "relevance" else "newest", s.page, s.page_size)


def paged(found: DataFrame, sort: str, page: int = 1, page_size: int = PAGE_SIZE, sorts: dict = SORTS) -> DataFrame:
    """The rows of one page under a named order."""
    size = max(1, min(page_size, MAX_PAGE_SIZE))
    return found.orderBy(*sorts[sort]()).offset((max(page, 1) - 1) * size).limit(size)


def page_counts(found: DataFrame, page_size: int = PAGE_SIZE) -> DataFrame:
    """One row: total matches and number of pages."""
    size = max(1, min(page_size, MAX_PAGE_SIZE))
    return found.agg(F.count("*").alias("total")).withColumn("pages", F.ceil(F.col("total") / size).cast("bigint"))


def cluster_siblings(view: DataFrame, listings: DataFrame | None = None) -> DataFrame:
    """(listing_id, cluster_id, duplicate_count): each listing with its cluster and how many listings that has, 1 without a cluster.

    The siblings of a listing are the other rows of its cluster: a row per listing says it
    for all of them, where lists of siblings would grow with the square of a cluster. With
    ``listings`` (listing_id) only the clusters of those are given.
    """
    rows = view.select("listing_id", "cluster_id").distinct()
    if listings is not None:
        asked = rows.join(listings.select("listing_id").distinct(), "listing_id", "left_semi")
        alone = asked.filter("cluster_id IS NULL")
        rows = rows.join(asked.select("cluster_id").distinct(), "cluster_id", "left_semi").select("listing_id", "cluster_id").unionByName(alone)
    sizes = rows.filter("cluster_id IS NOT NULL").groupBy("cluster_id").agg(F.count("*").alias("n"))
    return rows.join(sizes, "cluster_id", "left").select("listing_id", "cluster_id", F.coalesce("n", F.lit(1).cast("bigint")).alias("duplicate_count"))


def detail_history(listings: DataFrame, observations: DataFrame) -> DataFrame:
    """Per property (cluster, or listing without one) its priced observations: group_key, captured_at, price_eur, listing_id."""
    ads = distinct_listings(listings).select(F.col("id").alias("listing_id"), "cluster_id")
    key = F.coalesce(F.concat(F.lit("c"), F.col("cluster_id").cast("string")), F.concat(F.lit("l"), F.col("listing_id").cast("string")))
    return observations.filter("price_eur IS NOT NULL").join(ads, "listing_id").select(
        key.alias("group_key"), F.col("id").alias("observation_id"), "captured_at", "price_eur", "listing_id"
    )
