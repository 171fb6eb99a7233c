"""Best representative of each duplicate group: iterative truth discovery.

A claim says that a source gives a field of an entity a value. The operator
alternates two estimates until they settle: the support of each value is the sum
of its claims' votes, a vote being the reliability of the claim's source in that
field times the claim's prior; and a source's reliability is the share of its
votes that went to the best supported values.

A field may have an order of preference (the most recent, the most trusted). Its
first claim then gets a prior of 1 and the other n - 1 claims FLOOR / (n + 1), so
that no sum of votes outweighs it and votes only settle the reliabilities. A field
without an order is decided by the votes alone.

Scale: claims are first combined to one row per entity, field, value and source;
the rounds work on those. Large entities are only inputs of combining aggregates.
The table of reliabilities has a row per field and source; it is broadcast when it
has at most BROADCAST_ROWS rows and joined by shuffle beyond that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adstrata.plans.scratch import drop, written

FLOOR = 0.05
BROADCAST_ROWS = 100_000


def discover(claims: DataFrame, max_rounds: int = 20, tolerance: float = 1e-3) -> tuple[DataFrame, DataFrame]:
    """(truths, reliabilities) of ``claims``: entity, field, value, source, rank, member.

    ``rank`` orders the claims of a field by preference, the least first (null: the
    field has no order); ``member`` is the record that claims. truths: entity, field,
    value, member (the first by rank, then the lowest, of those that claim the value),
    support. reliabilities: field, source, reliability.

    Nulls: claims without entity, field, member or value are left out; a null source is
    a source of its own. Ties of support go to the value whose first member is first.
    Repeated claims of one member count once. No claims give empty tables.
    """
    usable = claims.filter("entity IS NOT NULL AND field IS NOT NULL AND value IS NOT NULL AND member IS NOT NULL")
    usable = usable.select("entity", "field", "value", F.coalesce("source", F.lit("")).alias("source"), "rank", "member").distinct()
    first = F.min(F.struct("rank", "member"))
    grouped = usable.groupBy("entity", "field", "value", "source").agg(F.count("*").alias("n"), first.alias("first"), F.count("rank").alias("ranked"))
    whole = grouped.groupBy("entity", "field").agg(
        F.sum("n").alias("all"), F.min("first").alias("best"), (F.sum("ranked") > 0).alias("ordered")
    )
    low = F.lit(FLOOR) / (F.col("all") + 1)
    has_best = (F.col("first") == F.col("best")).cast("int")
    prior = F.when(F.col("ordered"), has_best + (F.col("n") - has_best) * low).otherwise(F.col("n").cast("double"))
    votes = written(grouped.join(whole, ["entity", "field"]).select("entity", "field", "value", "source", "first", "n", prior.alias("prior")), "votes")
    trust = written(votes.select("field", "source").distinct().withColumn("reliability", F.lit(0.8)), "trust")
    few = trust.count() <= BROADCAST_ROWS
    for _ in range(max_rounds):
        truths = _best(votes, trust, few)
        agreed = votes.join(truths.select("entity", "field", F.col("value").alias("true")), ["entity", "field"])
        hit = F.sum(F.when(F.col("value") == F.col("true"), F.col("n")).otherwise(0))
        rated = agreed.groupBy("field", "source").agg(((hit + 1) / (F.sum("n") + 2)).alias("share"))
        new = written(rated.select("field", "source", F.greatest(F.lit(FLOOR), "share").alias("reliability")), "trust")
        moved = new.join(trust.withColumnRenamed("reliability", "old"), ["field", "source"]).agg(F.max(F.abs(F.col("reliability") - F.col("old")))).first()[0]
        drop(trust)
        trust = new
        if moved is None or moved < tolerance:
            break
    return _best(votes, trust, few), trust


def _best(votes: DataFrame, trust: DataFrame, few: bool) -> DataFrame:
    weighed = votes.join(F.broadcast(trust) if few else trust, ["field", "source"])
    support = weighed.groupBy("entity", "field", "value").agg(
        F.sum(F.col("reliability") * F.col("prior")).alias("support"), F.min("first").alias("first")
    )
    # the least of (-support, first): most support, then the value whose first member comes first
    top = F.min(F.struct((-F.round("support", 9)).alias("minus"), "first", "value")).alias("t")
    return support.groupBy("entity", "field").agg(top).select(
        "entity", "field", F.col("t.value").alias("value"), F.col("t.first.member").alias("member"), (-F.col("t.minus")).alias("support")
    )


def usable_first_seen() -> Column:
    """``first_seen`` where it is neither null, nor before 2000, nor after the row's ``last_seen``; else null."""
    good = (F.col("first_seen") >= F.lit("2000-01-01 00:00:00").cast("timestamp")) & (F.col("first_seen") <= F.col("last_seen"))
    return F.when(good, F.col("first_seen"))


def known_category() -> Column:
    """``category`` without blanks around it where it holds more than blanks and hyphens; else null."""
    return F.when(F.col("category").rlike(r"[^\s-]"), F.trim("category"))


def listing_claims(listings: DataFrame, category_by_vote: bool = False) -> DataFrame:
    """What each listing claims of its cluster: when the property was first seen and its category.

    Earlier ``first_seen`` and later ``last_seen`` come first; with ``category_by_vote``
    the category has no order and the votes decide it.
    """
    seen = F.unix_micros(usable_first_seen())
    base = listings.filter("cluster_id IS NOT NULL AND id IS NOT NULL")
    last = F.coalesce(F.unix_micros("last_seen"), F.lit(-(2**62)))
    claim = lambda field, value, rank: F.struct(F.lit(field).alias("field"), value.cast("string").alias("value"), rank.cast("bigint").alias("rank"))
    said = F.explode(F.array(claim("first_seen", seen, seen), claim("category", known_category(), F.lit(None) if category_by_vote else -last)))
    return base.select(F.col("cluster_id").alias("entity"), "source", F.col("id").alias("member"), said.alias("c")).select(
        "entity", "c.field", "c.value", "source", "c.rank", "member"
    )


def cluster_survivors(listings: DataFrame, category_by_vote: bool = False) -> DataFrame:
    """One row per cluster of at least two listings: cluster_id, canonical_listing_id, category_listing_id, category, listings.

    Where no member has a usable ``first_seen`` the lowest id survives; where none knows
    a category, category_listing_id is -1 and category null. Clusters that are null or of
    one listing (delivered once or more) have no row.
    """
    groups = listings.filter("cluster_id IS NOT NULL AND id IS NOT NULL").groupBy("cluster_id").agg(
        F.min("id").alias("lowest"), F.max("id").alias("highest"), F.count_distinct("id").alias("listings")
    ).filter("lowest < highest")
    truths, trust = discover(listing_claims(listings, category_by_vote))
    field = lambda f, *cols: truths.filter(F.col("field") == f).select(F.col("entity").alias("cluster_id"), *cols)
    seen = field("first_seen", F.col("member").alias("seen_by"))
    kind = field("category", F.col("member").alias("kind_by"), F.col("value").alias("category"))
    return groups.join(seen, "cluster_id", "left").join(kind, "cluster_id", "left").select(
        "cluster_id", F.coalesce("seen_by", "lowest").alias("canonical_listing_id"), F.coalesce("kind_by", F.lit(-1).cast("bigint")).alias("category_listing_id"), "category", "listings"
    )
