"""Consolidating pairwise matches into groups: connected components by random contraction.

Each round gives the vertices a fresh random order (a hash with the round's seed),
hooks every vertex to the least of itself and its neighbours, relabels the edges
by the hooks and drops loops and repeats. In expectation at least a quarter of the
vertices go each round, whatever the shape of the graph, so long chains and stars
take O(log n) rounds. The hooks of the rounds are then expanded backwards.

Scale: hubs are only ever inputs of ``min`` aggregates (combined map-side); every
state is a written table in the shared folder, so lineage stays short and the loss
of an executor costs no round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adstrata.plans.scratch import drop, written


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 200) -> DataFrame:
    """(node, group_id) for every node with an edge to another one; group_id is the least node of its component.

    Nulls: edges with a null end are left out. Loops and repeated or reversed edges
    change nothing; other columns are ignored. No edges give an empty table.
    """
    ends = edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).filter(
        F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))
    )
    live = written(ends.distinct(), "edges")
    hooks: list[DataFrame] = []
    while not live.isEmpty():
        if len(hooks) == max_rounds:
            raise RuntimeError(f"{max_rounds} rounds did not contract the graph")
        key = lambda c, seed=len(hooks): F.struct(F.xxhash64(c, F.lit(seed)).alias("h"), c.alias("n"))
        u, v = F.col("u"), F.col("v")
        both = live.select(F.explode(F.array(F.struct(u.alias("x"), v.alias("y")), F.struct(v.alias("x"), u.alias("y")))).alias("e"))
        least = both.groupBy(F.col("e.x").alias("x")).agg(F.min(key(F.col("e.y"))).alias("k"))
        hook = written(least.select("x", F.least(F.col("k"), key(F.col("x")))["n"].alias("to")), "hook")
        hooks.append(hook)
        left = hook.select(F.col("x").alias("u"), F.col("to").alias("tu"))
        right = hook.select(F.col("x").alias("v"), F.col("to").alias("tv"))
        moved = live.join(left, "u").join(right, "v").filter("tu <> tv")
        after = written(moved.select(F.least("tu", "tv").alias("u"), F.greatest("tu", "tv").alias("v")).distinct(), "edges")
        drop(live)
        live = after
    drop(live)
    if not hooks:
        return ends.select(F.col("u").alias("node"), F.col("v").alias("group_id")).limit(0)
    root: DataFrame | None = None
    for hook in reversed(hooks):
        if root is None:
            step = hook.select("x", F.col("to").alias("root"))
        else:
            step = hook.join(root.withColumnsRenamed({"x": "to"}), "to", "left").select("x", F.coalesce("root", "to").alias("root"))
        step = written(step, "root")
        drop(hook, *([root] if root is not None else []))
        root = step
    least = root.groupBy("root").agg(F.min(F.least("x", "root")).alias("group_id"))
    return root.join(least, "root").select(F.col("x").alias("node"), "group_id")


def decided_links(pairs: DataFrame) -> DataFrame:
    """(a, b), a < b: the listings that the rows of ``pairs`` link, labels before decisions.

    All rows of two listings, in either order, count together: the label with the
    latest ``labeled_at`` decides, else the decision with the latest ``created_at``;
    a null time is the earliest, ties go to the higher ``id``. Words are read without
    blanks around them and ignoring case, an empty label is none. Rows with a null
    listing, and of a listing with itself, are left out.
    """
    word = lambda c: F.lower(F.trim(c))
    p = pairs.select(
        F.least("listing_a", "listing_b").alias("a"), F.greatest("listing_a", "listing_b").alias("b"),
        word("decision").alias("decision"), F.nullif(word("human_label"), F.lit("")).alias("label"),
        "labeled_at", "created_at", "id",
    ).filter("listing_a IS NOT NULL AND listing_b IS NOT NULL AND listing_a <> listing_b")
    said = p.groupBy("a", "b").agg(
        F.max_by("label", F.when(F.col("label").isNotNull(), F.struct("labeled_at", "id"))).alias("label"),
        F.max_by("decision", F.struct("created_at", "id")).alias("decision"),
    )
    linked = F.when(F.col("label").isNotNull(), F.col("label") == "same").otherwise(F.col("decision") == "merge")
    return said.filter(linked).select("a", "b")
