"""Ads that ended, with what their price did and how it compares locally; and the summary of all tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adstrata.functions.numbers import ratio
from adstrata.operators.current import distinct_listings
from adstrata.operators.search import listing_view, paged


def area_medians(view: DataFrame) -> DataFrame:
    """Per raw location the exact median price per m² of the latest priced observation of every listing there."""
    per_m2 = F.when(F.col("area_m2") > 0, (F.col("price_eur") / F.col("area_m2")).cast("double"))
    priced = view.filter("price_eur IS NOT NULL AND location_raw IS NOT NULL")
    return priced.groupBy("location_raw").agg(F.median(per_m2).alias("median_price_per_m2"))


def ended_listings(listings: DataFrame, observations: DataFrame) -> DataFrame:
    """Every ended ad: first and last price and the change, days listed, the local median and the distance from it, still listed elsewhere."""
    view = listing_view(listings, observations)
    at = F.struct("captured_at", "id")
    prices = observations.filter("price_eur IS NOT NULL").groupBy("listing_id").agg(
        F.min_by("price_eur", at).alias("first_price"), F.max_by("price_eur", at).alias("last_price")
    )
    live = distinct_listings(listings).filter("status = 'active' AND cluster_id IS NOT NULL").groupBy("cluster_id").agg(F.count_distinct("id").alias("live"))
    gone = view.filter("status = 'gone'").join(prices, "listing_id", "left").join(area_medians(view), "location_raw", "left").join(live, "cluster_id", "left")
    ended = F.coalesce("removed_at", "last_seen")
    days = F.greatest(F.lit(0.0), (F.unix_micros(ended) - F.unix_micros("first_seen")) / 86400e6)
    med = F.col("median_price_per_m2")
    return gone.withColumns({
        "ended_at": ended,
        "price_change_pct": ratio((F.col("last_price") - F.col("first_price")) * 100, F.col("first_price"), 2),
        "days_listed": F.round(F.when(F.col("first_seen").isNotNull(), days), 1),
        "vs_area_median_pct": F.when((med > 0) & (F.col("price_per_m2") > 0), F.round((F.col("price_per_m2") - med) / med * 100, 1)),
        # an ended ad is not among the live ones, so any live one is another
        "still_listed_elsewhere": F.coalesce(F.col("live") > 0, F.lit(False)),
    }).drop("live")


ENDED_SORTS = {
    "recent": lambda: [F.col("ended_at").desc_nulls_last(), F.col("listing_id").desc()],
    "fastest": lambda: [F.col("days_listed").asc_nulls_last(), F.col("listing_id").asc()],
    "slowest": lambda: [F.col("days_listed").desc_nulls_last(), F.col("listing_id").asc()],
    "best_value": lambda: [F.col("vs_area_median_pct").asc_nulls_last(), F.col("listing_id").asc()],
    "biggest_drop": lambda: [F.col("price_change_pct").asc_nulls_last(), F.col("listing_id").asc()],
    "price_asc": lambda: [F.nullif("price_eur", F.lit(0)).asc_nulls_last(), F.col("listing_id").asc()],
    "price_desc": lambda: [F.nullif("price_eur", F.lit(0)).desc_nulls_last(), F.col("listing_id").asc()],
}


def ended_feed(
    ended: DataFrame, as_of: str, days: int = 365, source: Sequence[str] = (), reason: str | None = None, min_price: float | None = None,
    max_price: float | None = None, max_days_listed: float | None = None, hide_still_listed: bool = True, sort: str = "recent", page: int = 1, page_size: int = 50,
) -> DataFrame:
    """One page of the ads that ended within ``days`` before ``as_of``."""
    out = ended.filter(F.col("ended_at") >= F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(days)))
    if source:
        out = out.filter(F.col("source").isin(list(source)))
    if reason:
        out = out.filter(F.col("status_reason") == reason)
    if min_price is not None:
        out = out.filter(F.col("price_eur") >= min_price)
    if max_price is not None:
        out = out.filter(F.col("price_eur") <= max_price)
    if max_days_listed is not None:
        out = out.filter(F.col("days_listed") <= max_days_listed)
    if hide_still_listed:
        out = out.filter(~F.col("still_listed_elsewhere"))
    return paged(out, sort, page, page_size, ENDED_SORTS)


def summary(listings: DataFrame, observations: DataFrame, pairs: DataFrame, changes: DataFrame, as_of: str) -> DataFrame:
    """One row of counts over all tables: each table is aggregated once, the one-row results are put side by side."""
    ads = distinct_listings(listings)
    l = ads.agg(  # noqa: E741
        F.count("*").alias("listings"), F.count_if("active").alias("active_listings"), F.count_if(F.col("status") == "gone").alias("gone_listings"),
        F.count_distinct("cluster_id").alias("clusters"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"), F.max("last_seen").alias("last_seen"),
    )
    dup = ads.filter("cluster_id IS NOT NULL").groupBy("cluster_id").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))
    o = observations.agg(F.count("*").alias("observations"), F.count("price_eur").alias("priced_observations"))
    word = F.lower(F.trim("decision"))
    p = pairs.agg(F.count_if(word == "merge").alias("merge_rows"), F.count_if((word == "review") & F.col("human_label").isNull()).alias("review_rows"), F.count("human_label").alias("labelled_rows"))
    since = F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(30))
    d = changes.agg(F.count_if((F.col("change_pct") < 0) & (F.col("last_seen") >= since)).alias("drops_30d"))
    out = l
    for one_row in (dup, o, p, d):
        out = out.crossJoin(F.broadcast(one_row))
    return out
