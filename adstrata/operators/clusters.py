"""Clusters of duplicate ads from decided pairs, with stable identifiers and a guard against runaways."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adstrata.plans.scratch import drop, written

RUNAWAY = 5


def connected(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, root): the least node of the component of every node of ``edges`` (a, b), by alternating stars.

    A large-star step hooks every node's greater neighbours to the least node it knows, a
    small-star step hooks the lesser ones; the edges end as one star per component in
    O(log² n) rounds. Null ends and loops are left out; no edges give an empty table.
    """
    live = written(edges.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), "stars")
    for _ in range(max_rounds):
        both = live.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(live.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = both.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("m"))
        large = both.filter("y > x").join(least, "x").select(F.col("m").alias("u"), F.col("y").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v").select(F.col("m").alias("u"), F.explode(F.array("u", "v")).alias("v")).filter("u <> v").distinct()
        after = written(small, "stars")
        same = after.join(live, ["u", "v"], "left_anti").isEmpty() and live.join(after, ["u", "v"], "left_anti").isEmpty()
        drop(live)
        live = after
        if same:
            stars = live.select(F.col("v").alias("node"), F.col("u").alias("root"))
            return stars.unionByName(live.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())
    raise RuntimeError(f"no end after {max_rounds} rounds")


def effective_links(pairs: DataFrame) -> DataFrame:
    """(a, b) of the pair rows (listing_a, listing_b, decision, human_label) that link: a label decides where there is one."""
    label = F.nullif(F.lower(F.trim("human_label")), F.lit(""))
    linked = F.when(label.isNotNull(), label == "same").otherwise(F.lower(F.trim("decision")) == "merge")
    return pairs.filter(linked).select(F.col("listing_a").alias("a"), F.col("listing_b").alias("b"))


def rebuilt(links: DataFrame, listings: DataFrame, clusters: DataFrame | None = None, runaway: int = RUNAWAY) -> tuple[DataFrame, DataFrame]:
    """(assignments, clusters) after grouping linked listings.

    assignments: listing_id, cluster_id, for listings of a group of at least two. A group
    keeps the least cluster id its members have, if no group with a lower root claims it;
    else it is named by the highest id so far plus its rank. clusters: cluster_id, size,
    status (flagged above ``runaway`` members; confirmed stays confirmed; else auto),
    canonical_listing_id (earliest first_seen, then lowest id).
    """
    from pyspark.sql import Window as W

    ads = listings.select(F.col("id").alias("node"), "cluster_id", "first_seen").distinct().groupBy("node").agg(F.min("cluster_id").alias("old"), F.min("first_seen").alias("first_seen"))
    members = connected(links).join(ads, "node")
    groups = members.groupBy("root").agg(F.count("*").alias("size"), F.min("old").alias("wish"), F.min(F.struct(F.coalesce("first_seen", F.lit("9999-12-31").cast("timestamp")).alias("t"), "node"))["node"].alias("canonical_listing_id")).filter("size > 1")
    claim = groups.filter("wish IS NOT NULL").groupBy("wish").agg(F.min("root").alias("root"))
    named = groups.join(claim.select("root", F.lit(True).alias("keeps")), "root", "left").withColumn("kept", F.when(F.col("keeps"), F.col("wish")))
    top = listings.agg(F.coalesce(F.max("cluster_id"), F.lit(0)).alias("top"))  # one row
    # New ids: a hash slice gives each group its place without sorting all of them in one task.
    slices = 256
    fresh = named.filter("kept IS NULL").withColumn("slice", F.pmod(F.xxhash64("root"), F.lit(slices)))
    sizes = fresh.groupBy("slice").agg(F.count("*").alias("n"))
    base = sizes.select("slice", F.coalesce(F.sum("n").over(W.orderBy("slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))  # at most 256 rows
    numbered = fresh.join(F.broadcast(base), "slice").withColumn("rank", F.row_number().over(W.partitionBy("slice").orderBy("root")))
    new = numbered.crossJoin(F.broadcast(top)).withColumn("cluster_id", F.col("top") + F.col("base") + F.col("rank"))
    columns = ["root", "cluster_id", "size", "canonical_listing_id"]
    done = named.filter("kept IS NOT NULL").withColumn("cluster_id", F.col("kept")).select(columns).unionByName(new.select(columns))
    assigned = members.join(done.select("root", "cluster_id"), "root").select(F.col("node").alias("listing_id"), "cluster_id")
    was = F.lit(None).cast("string")
    if clusters is not None:
        done = done.join(clusters.select(F.col("id").alias("cluster_id"), F.col("status").alias("was")).distinct(), "cluster_id", "left")
        was = F.col("was")
    status = F.when(F.col("size") > runaway, "flagged").when(was == "confirmed", "confirmed").otherwise("auto")
    return assigned, done.select("cluster_id", "size", status.alias("status"), "canonical_listing_id")


def review_queue(pairs: DataFrame, listings: DataFrame, limit: int = 50) -> DataFrame:
    """The ``limit`` undecided pairs without a label, highest score first (ties: lower id), with both ads' addresses."""
    open_ = pairs.filter((F.lower(F.trim("decision")) == "review") & (F.coalesce(F.trim("human_label"), F.lit("")) == ""))
    top = open_.orderBy(F.col("score").desc_nulls_last(), "id").limit(limit).select("id", "listing_a", "listing_b", "score")
    ads = listings.select("id", "url").distinct()
    a, b = ads.toDF("listing_a", "url_a"), ads.toDF("listing_b", "url_b")
    return top.join(a, "listing_a", "left").join(b, "listing_b", "left")


def ordered_pair() -> dict[str, Column]:
    """listing_a and listing_b, the lower id first."""
    return {"listing_a": F.least("listing_a", "listing_b"), "listing_b": F.greatest("listing_a", "listing_b")}


def relabelled(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """``pairs`` (listing_a, listing_b, decision, human_label, …) after label events (listing_a, listing_b, label, at): the latest label of a pair holds.

    Either may name a pair in either order; the result has the lower id first. A blank
    label is none. A pair that has a label keeps its decision; one that pairs doesn't hold
    is added with the decision its label means.
    """
    said = labels.filter("trim(label) <> ''").withColumns(ordered_pair()).groupBy("listing_a", "listing_b").agg(F.max_by("label", F.struct("at", "label")).alias("label"))
    joined = pairs.withColumns(ordered_pair()).join(said, ["listing_a", "listing_b"], "full_outer")
    means = F.when(F.col("label") == "same", "merge").otherwise("distinct")
    held = F.when(F.trim("human_label") != "", F.col("human_label"))
    return joined.withColumns({"human_label": F.coalesce("label", held), "decision": F.coalesce("decision", means)}).drop("label")
