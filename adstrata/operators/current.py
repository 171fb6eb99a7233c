"""The latest state of each ad and what its price did.

Per-key picks are ``max_by`` / ``min_by`` aggregates on (time, id): every map task sends
one row per key, however many rows a key has. They carry the row as one value, which
hides unused columns from the optimizer, so callers name the columns they need.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adstrata.functions.numbers import ratio


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], largest: bool = True) -> DataFrame:
    """One row per key: the one whose ``order`` is largest (nulls least) or, with ``largest`` false, smallest."""
    by = F.struct(*order)
    row = F.struct(*[c for c in df.columns if c not in keys])
    pick = (F.max_by if largest else F.min_by)(row, by)
    return df.groupBy(*keys).agg(pick.alias("__row")).select(*keys, "__row.*")


def current_state(observations: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """The latest observation of each listing, all of it or listing_id, captured_at, id and ``columns``.

    Ties of time go to the higher id; null listings are left out.
    """
    seen = observations.filter("listing_id IS NOT NULL")
    if columns is not None:
        seen = seen.select("listing_id", "captured_at", "id", *[c for c in columns if c not in ("listing_id", "captured_at", "id")])
    return top_per_key(seen, ["listing_id"], ["captured_at", "id"])


def price_per_m2() -> Column:
    """Price by area to two places; null where the area is null or not positive."""
    return F.when(F.col("area_m2") > 0, ratio(F.col("price_eur"), F.col("area_m2"), 2))


def distinct_listings(listings: DataFrame) -> DataFrame:
    """Listings that were delivered twice, alike in all columns, once."""
    return listings.distinct()


def cluster_price_history(listings: DataFrame, observations: DataFrame) -> DataFrame:
    """Every priced observation of every listing in a cluster."""
    members = distinct_listings(listings).filter("cluster_id IS NOT NULL").select(F.col("id").alias("listing_id"), "cluster_id", "source", "url")
    priced = observations.filter("price_eur IS NOT NULL").select(F.col("id").alias("observation_id"), "listing_id", "captured_at", "price_eur", "area_m2")
    return priced.join(members, "listing_id").withColumn("price_per_m2", price_per_m2())


def cluster_price_changes(history: DataFrame) -> DataFrame:
    """Per cluster with more than one price: first, latest, least and greatest price and the change in percent (null if the first is 0)."""
    at = F.struct("captured_at", "observation_id")
    agg = history.groupBy("cluster_id").agg(
        F.count_distinct("listing_id").alias("listing_count"),
        F.count_distinct("price_eur").alias("price_points"),
        F.min("captured_at").alias("first_seen"), F.max("captured_at").alias("last_seen"),
        F.min_by("price_eur", at).alias("first_price"), F.max_by("price_eur", at).alias("latest_price"),
        F.min("price_eur").alias("min_price"), F.max("price_eur").alias("max_price"),
    ).filter("price_points > 1")
    return agg.withColumn("change_pct", ratio((F.col("latest_price") - F.col("first_price")) * 100, F.col("first_price"), 2))


def price_drops(
    listings: DataFrame, observations: DataFrame, as_of: str, min_drop_pct: float = 2.0, days: int = 90,
    min_price: float | None = None, max_price: float | None = None, limit: int = 50,
) -> DataFrame:
    """The ``limit`` clusters whose price fell most, each with a representative ad and its price history.

    The top k is taken before the joins, so they only see k clusters; ties go to the lower
    cluster. The representative is active if one is, then the most recently seen, then
    the lowest id. The history is an array of (captured_at, price_eur, listing_id) in order.
    """
    history = cluster_price_history(listings, observations)
    changes = cluster_price_changes(history).filter(
        (F.col("change_pct") <= -min_drop_pct) & (F.col("last_seen") >= F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(days)))
    )
    if min_price is not None:
        changes = changes.filter(F.col("latest_price") >= min_price)
    if max_price is not None:
        changes = changes.filter(F.col("latest_price") <= max_price)
    drops = changes.orderBy("change_pct", "cluster_id").limit(limit)
    few = F.broadcast(drops.select("cluster_id"))  # at most ``limit`` rows
    ads = distinct_listings(listings).join(few, "cluster_id").select("cluster_id", F.col("id").alias("listing_id"), "source", "url", "active", F.col("last_seen").alias("ad_last_seen"))
    rep = top_per_key(ads, ["cluster_id"], ["active", "ad_last_seen", -F.col("listing_id")]).select("cluster_id", "listing_id", "source", "url")
    shown = current_state(observations.join(F.broadcast(rep.select("listing_id")), "listing_id"), ["title", "location_raw", "area_m2"]).drop("id", "captured_at")
    points = history.join(few, "cluster_id").groupBy("cluster_id").agg(
        F.array_sort(F.collect_list(F.struct("captured_at", "observation_id", "price_eur", "listing_id"))).alias("points")
    )
    slim = F.transform("points", lambda p: F.struct(p["captured_at"].alias("captured_at"), p["price_eur"].alias("price_eur"), p["listing_id"].alias("listing_id")))
    return (
        drops.join(rep, "cluster_id").join(shown, "listing_id", "left").join(points, "cluster_id", "left")
        .withColumn("change_eur", F.col("latest_price") - F.col("first_price")).withColumn("price_history", slim).drop("points")
    )


def repost_points(history: DataFrame) -> DataFrame:
    """The history with ``reposted``: whether another listing of the cluster held the price before."""
    from pyspark.sql import Window as W

    w = W.partitionBy("cluster_id").orderBy("captured_at", "observation_id")
    before = F.lag("listing_id").over(w)
    return history.withColumn("reposted", before.isNotNull() & (before != F.col("listing_id")))
