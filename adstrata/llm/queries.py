"""Queries of the training-data operators, and their SQL where SQL can say it on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adstrata.llm import boilerplate, components, encodings, intake, lookalikes, mixture, survivors, tokens
from adstrata.llm.oracle import SQL  # noqa: F401
from adstrata.plans.scratch import written
from adstrata.sources.tables import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The surviving listing of each cluster and the member that knows its category best."""
    return survivors.cluster_survivors(table(spark, d, "listings")).select("cluster_id", "canonical_listing_id", "category_listing_id")


def p2_voted(spark: SparkSession, d: str) -> DataFrame:
    """Survivors with the category that the reliability-weighted votes of all members support most."""
    return survivors.cluster_survivors(table(spark, d, "listings"), category_by_vote=True)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Each rejected listing with every listing accepted before it that it matches."""
    _, matches = intake.deduplicated(table(spark, d, "intake_batches"), table(spark, d, "blocking_keys"))
    return matches.select(F.least("a", "b").alias("listing_a"), F.greatest("a", "b").alias("listing_b"))


def p3_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Every listing with its batch and whether it was accepted."""
    decisions, _ = intake.deduplicated(table(spark, d, "intake_batches"), table(spark, d, "blocking_keys"))
    return decisions.select(F.col("record").alias("listing_id"), F.col("batch_no").cast("bigint").alias("batch_no"), "accepted")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """The lines that recur in the ads of one seller, and whether a snippet names them."""
    blocks = boilerplate.boilerplate_blocks(table(spark, d, "observations"), "seller_name", "listing_id", "description")
    known = boilerplate.known_lines(table(spark, d, "seller_boilerplate"), "seller_name", "snippet").withColumn("known", F.lit(1))
    return blocks.join(known, ["source", "line"], "left").select(
        F.col("source").alias("seller_name"), "line", F.coalesce("known", F.lit(0)).cast("bigint").alias("known")
    )


def p4_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The blocks of boilerplate: each recurring line with its support and the least line of its block."""
    blocks = boilerplate.boilerplate_blocks(table(spark, d, "observations"), "seller_name", "listing_id", "description")
    return blocks.withColumnRenamed("source", "seller_name")


def p4_cleaned(spark: SparkSession, d: str) -> DataFrame:
    """Every observation's description without the occurrences of its seller's blocks."""
    docs = table(spark, d, "observations").select("id", "listing_id", "seller_name", "description")
    blocks = boilerplate.boilerplate_blocks(docs, "seller_name", "listing_id", "description")
    out = boilerplate.without_boilerplate(docs, "seller_name", "listing_id", "description", blocks)
    return out.select(F.col("id").alias("observation_id"), "cleaned", "removed")


def _observed_texts(spark: SparkSession, d: str) -> DataFrame:
    """(observation_id, field, text) of every non-null title and description."""
    both = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in ("title", "description")])
    return table(spark, d, "observations").select(F.col("id").alias("observation_id"), F.inline(both)).filter("text IS NOT NULL")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The titles and descriptions written with look-alike characters."""
    return lookalikes.cases(_observed_texts(spark, d)).select("observation_id", "field")


def p5_forms(spark: SparkSession, d: str) -> DataFrame:
    """Every title and description with look-alikes, in its one plain form."""
    return lookalikes.cases(_observed_texts(spark, d)).select("observation_id", "field", "form", F.array_join("kinds", ",").alias("kinds"))


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    """Titles and descriptions that look the same, grouped by their skeleton."""
    return lookalikes.groups(_observed_texts(spark, d))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """The group of every listing that the pair outcomes link to another one."""
    links = components.decided_links(table(spark, d, "dedup_pairs"))
    return components.components(links).select(F.col("node").alias("listing_id"), "group_id")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    """The token ids of every document."""
    return tokens.encoded(table(spark, d, "documents"))


def _sized(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, source, tokens) of every document, written once: encoding is the costly part."""
    return written(tokens.encoded(table(spark, d, "documents"), ["doc_id", "source"], count_only=True), "sized")


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    """The documents of the mixture and how often each is used."""
    return mixture.mixture(_sized(spark, d), table(spark, d, "mix_targets"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """The share that each source was to have in the mixture and the share it reached."""
    sized, targets = _sized(spark, d), table(spark, d, "mix_targets")
    return mixture.shares(mixture.mixture(sized, targets), sized, targets)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """The documents with a passage that was decoded with a wrong encoding."""
    return encodings.garbled_documents(table(spark, d, "documents")).select("doc_id")


def p9_repaired(spark: SparkSession, d: str) -> DataFrame:
    """The garbled documents with their text restored where it can be."""
    return encodings.repaired(table(spark, d, "documents"))


QUERIES = {"p2_found": p2_found, "p2_voted": p2_voted, "p3_found": p3_found, "p3_decisions": p3_decisions, "p4_found": p4_found, "p4_blocks": p4_blocks, "p4_cleaned": p4_cleaned, "p5_found": p5_found, "p5_forms": p5_forms, "p5_groups": p5_groups, "p6_found": p6_found, "p7_ids": p7_ids, "p8_mixture": p8_mixture, "p8_shares": p8_shares, "p9_found": p9_found, "p9_repaired": p9_repaired}
