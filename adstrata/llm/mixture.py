"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in shuffled order. A document's virtual finish
time is the number of its source's tokens up to and with it, divided by the source's
weight; taking documents by finish time gives every source tokens in proportion to its
weight, for as long as it has any. A source that runs out is queued again, up to its cap.
The documents are taken until the next one would exceed the budget.

Scale: a source may hold a third of all rows, so its running sum is cut into
``slices`` by the shuffle hash: sums within a slice, plus the sums of the slices before
it. The queue is written once. The cut is found by ranges of finish time: ``slices`` equal
ones say by their sums in which the budget ends, and that one is cut again, until it holds
at most ``sort_rows`` rows, which one task sorts; so no weight, however small, makes a range
large. Documents of one source never end at the same time, so a range that can't be cut
holds a row for each source and turn at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from adstrata.plans.scratch import written


def targets_of(targets: DataFrame) -> DataFrame:
    """(source, share, repeats): identical rows once; several different rows of a source add their shares, the highest cap holds.

    A null or negative share is 0, a null ``max_repeats`` 1, a negative one 0; a null source is left out.
    """
    rows = targets.select("source", "target_share", "max_repeats").distinct().filter("source IS NOT NULL")
    share = F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0))
    return rows.groupBy("source").agg(
        F.sum(share).alias("share"), F.max(F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0))).alias("repeats")
    )


def _sums_before(rows: DataFrame, keys: list[str], part: str, amount: Column) -> DataFrame:
    """(keys, part, base): of each part of a key, the amount in the parts before it."""
    sums = rows.groupBy(*keys, part).agg(F.sum(amount).alias("amount"))
    window = W.partitionBy(*keys).orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    return sums.select(*keys, part, F.coalesce(F.sum("amount").over(window), F.lit(0)).alias("base"))


def queued(sized: DataFrame, targets: DataFrame, slices: int = 1024, seed: int = 17) -> DataFrame:
    """(doc_id, source, tokens, weight, whole, upto, repeats, budget): each document that may be taken, in its source's queue.

    ``upto``: the source's tokens up to and with the document; ``whole``: all its tokens;
    ``weight``: its share, scaled over the sources with documents; ``budget``: half of the
    tokens of all documents, those of other sources and of none included.
    """
    sized = sized.select("doc_id", "source", "tokens")
    total = sized.agg((F.coalesce(F.sum("tokens"), F.lit(0)) / 2).alias("budget"))
    own = sized.filter("source IS NOT NULL AND tokens > 0").join(targets_of(targets), "source")
    source = own.groupBy("source").agg(F.sum("tokens").alias("whole"), F.first("share").alias("share"))
    scaled = source.crossJoin(F.broadcast(source.agg(F.sum("share").alias("all")))).select(
        "source", "whole", (F.col("share") / F.nullif(F.col("all"), F.lit(0.0))).alias("weight")
    )
    shuffled = own.withColumn("h", F.xxhash64("doc_id", F.lit(seed))).withColumn("slice", F.pmod(F.shiftright("h", 20), F.lit(slices)))
    running = F.sum("tokens").over(W.partitionBy("source", "slice").orderBy("h", "doc_id").rowsBetween(W.unboundedPreceding, 0))
    base = _sums_before(shuffled, ["source"], "slice", F.col("tokens"))
    upto = shuffled.withColumn("inside", running).join(base, ["source", "slice"])
    return (
        upto.join(scaled, "source").filter("weight > 0 AND repeats > 0").crossJoin(F.broadcast(total))
        .select("doc_id", "source", "tokens", "weight", "whole", (F.col("base") + F.col("inside")).alias("upto"), "repeats", "budget")
    )


def mixture(sized: DataFrame, targets: DataFrame, slices: int = 1024, seed: int = 17, sort_rows: int = 100_000) -> DataFrame:
    """(doc_id, source, tokens, copies): the documents of the mixture and how often each is used.

    ``sized``: doc_id, source, tokens; ``targets``: source, target_share, max_repeats.
    Documents without tokens, of other sources and of no source stay out. Ties of finish
    time are taken by source, then document. No documents or targets give an empty table.
    """
    queue = queued(sized, targets, slices, seed)
    # no source can give more than the budget, which bounds the copies that can matter
    most = F.least(F.col("repeats"), F.ceil(F.col("budget") / F.col("whole")) + 1).cast("int")
    copies = queue.select("*", F.explode(F.sequence(F.lit(0), most - 1)).alias("turn"))
    finish = (F.col("turn") * F.col("whole") + F.col("upto")) / F.col("weight")
    timed = written(copies.select("doc_id", "source", "tokens", finish.alias("finish"), "budget"), "timed")
    left = timed.agg(F.min("finish"), F.max("finish"), F.max("budget"), F.count("*"), F.sum("tokens")).first()
    low, high, budget, rows, tokens = left
    counted = timed.groupBy("doc_id", "source", "tokens").agg(F.count("*").alias("copies"))
    if rows == 0 or tokens <= budget:
        return counted
    # ``before``: surely within the budget; ``cell``: where it ends, narrowed until one task can sort it
    before, cell = F.lit(False), F.lit(True)
    ranges = max(2, slices)  # of two or more ranges the least and the greatest time are in different ones, so each round cuts
    while rows > sort_rows and high > low:
        width = (high - low) / ranges
        if low + width <= low:  # all at one time, as far as numbers tell
            break
        place = F.least(F.lit(ranges - 1), F.floor((F.col("finish") - F.lit(low)) / F.lit(width))).cast("int")
        sums = timed.filter(cell).groupBy(place.alias("place")).agg(F.sum("tokens"), F.count("*"), F.min("finish"), F.max("finish")).orderBy("place").collect()  # at most ``slices`` rows
        for at, held, n, first, last in sums:
            if held > budget:
                break
            budget -= held
        before, cell = before | (cell & (place < at)), cell & (place == at)
        low, high, rows = first, last, n
    order = W.orderBy("finish", "source", "doc_id").rowsBetween(W.unboundedPreceding, 0)
    last = timed.filter(cell).withColumn("taken", F.sum("tokens").over(order)).filter(F.col("taken") <= budget).drop("taken")
    return timed.filter(before).unionByName(last).groupBy("doc_id", "source", "tokens").agg(F.count("*").alias("copies"))


def shares(mixed: DataFrame, sized: DataFrame, targets: DataFrame) -> DataFrame:
    """What each target source was to give and gave: source, target_share (scaled over the sources with documents; null for the others), docs, copies, tokens, share."""
    given = mixed.groupBy("source").agg(F.count("*").alias("docs"), F.sum("copies").alias("copies"), F.sum(F.col("copies") * F.col("tokens")).alias("tokens"))
    there = sized.filter("source IS NOT NULL AND tokens > 0").select("source").distinct().withColumn("there", F.lit(True))
    wanted = targets_of(targets).join(there, "source", "left").withColumn("counted", F.when(F.col("there"), F.col("share")))
    sums = wanted.agg(F.sum("counted").alias("all")).crossJoin(given.agg(F.sum("tokens").alias("mixed")))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return wanted.drop("share").join(given, "source", "left").crossJoin(F.broadcast(sums)).select(
        "source", (F.col("counted") / F.col("all")).alias("target_share"), zero("docs"), zero("copies"), zero("tokens"),
        (F.coalesce("tokens", F.lit(0)) / F.col("mixed")).alias("share"),
    )
