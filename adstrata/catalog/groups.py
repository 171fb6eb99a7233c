"""Queries of the roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adstrata.operators import current, rollup
from adstrata.sources.tables import table

RANKS = ["active", "missing", "gone"]


def cluster_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Per property: whether any ad is active, the status that ranks highest, and the reasons its ads give."""
    ads = current.distinct_listings(table(spark, d, "listings"))
    key = F.coalesce(F.concat(F.lit("c"), F.col("cluster_id").cast("string")), F.concat(F.lit("l"), F.col("id").cast("string")))
    out = ads.groupBy(key.alias("group_key")).agg(
        rollup.any_true("active").alias("any_active"), rollup.any_true(F.col("status") == "gone").alias("any_gone"), rollup.worst("status", RANKS).alias("worst"),
        rollup.evidence_map("id", "status_reason").alias("reasons"),
    )
    shown = F.transform(F.map_entries("reasons"), lambda e: F.concat(e["key"].cast("string"), F.lit("="), e["value"]))
    return out.withColumn("reasons", F.array_join(shown, ","))


def stale_texts(spark: SparkSession, d: str) -> DataFrame:
    """The listings whose latest description differs from their first one, or that had none."""
    o = table(spark, d, "observations").filter("listing_id IS NOT NULL")
    first = current.top_per_key(o.select("listing_id", "captured_at", "id", "description"), ["listing_id"], ["captured_at", "id"], largest=False)
    seen = first.filter("description IS NOT NULL").select("listing_id", F.substring(F.sha2("description", 256), 1, 32).alias("text_hash"))
    return rollup.stale(current.current_state(o, ["description"]), seen, "listing_id", "description").select("listing_id", "id")


def quoted_places(spark: SparkSession, d: str) -> DataFrame:
    """Whether the place of each listing's latest observation really stands in its title."""
    now = current.current_state(table(spark, d, "observations"), ["location_norm", "location_raw"])
    return now.select("listing_id", rollup.quoted(F.col("location_norm"), F.lower(F.col("location_raw"))).alias("is_quoted"))


QUERIES = {"cluster_rollup": cluster_rollup, "stale_texts": stale_texts, "quoted_places": quoted_places}

_FOLD = "trim(regexp_replace(strip_accents(lower({})), '\\s+', ' ', 'g'))"
_NOW = "now_ AS (SELECT * FROM observations WHERE listing_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY listing_id ORDER BY captured_at DESC NULLS LAST, id DESC) = 1)"
SQL = {
    "cluster_rollup": """WITH ads AS (SELECT DISTINCT * FROM listings)
SELECT coalesce('c' || cluster_id, 'l' || id) AS group_key, bool_or(active) AS any_active, bool_or(status = 'gone') AS any_gone,
  CASE max(CASE status WHEN 'gone' THEN 3 WHEN 'missing' THEN 2 WHEN 'active' THEN 1 END) WHEN 3 THEN 'gone' WHEN 2 THEN 'missing' WHEN 1 THEN 'active' END AS worst,
  coalesce(string_agg(id || '=' || status_reason, ',' ORDER BY id) FILTER (WHERE status_reason IS NOT NULL), '') AS reasons
FROM ads GROUP BY 1""",
    "stale_texts": f"""WITH {_NOW},
first_ AS (SELECT listing_id, description FROM observations WHERE listing_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY listing_id ORDER BY captured_at NULLS FIRST, id) = 1)
SELECT n.listing_id, n.id FROM now_ n LEFT JOIN first_ f ON f.listing_id = n.listing_id AND f.description IS NOT NULL
WHERE trim(n.description) <> '' AND n.description IS DISTINCT FROM f.description""",
    "quoted_places": f"""WITH {_NOW} SELECT listing_id, coalesce({_FOLD.format("location_norm")} <> '' AND contains({_FOLD.format("lower(location_raw)")}, {_FOLD.format("location_norm")}), false) AS is_quoted FROM now_""",
}
