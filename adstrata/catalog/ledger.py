"""Queries of the attribute history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adstrata.operators.history import OPEN, bitemporal_ledger, extend_ledger, listing_ledger, observed_states
from adstrata.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """The versions of each listing as the ledger holds them now."""
    now = listing_ledger(table(spark, d, "observations")).filter(F.col("recorded_to") == OPEN)
    return now.select(
        F.col("entity").alias("listing_id"), F.col("valid_from").alias("valid_from_us"), F.col("valid_to").alias("valid_to_us")
    )


def p1_ledger(spark: SparkSession, d: str) -> DataFrame:
    """The whole bitemporal ledger, superseded rows included; recorded time is the id of the observation that brought or superseded a row."""
    return listing_ledger(table(spark, d, "observations")).select(
        F.col("entity").alias("listing_id"), F.col("valid_from").alias("valid_from_us"), F.col("valid_to").alias("valid_to_us"),
        F.col("state.price_eur").cast("double").alias("price_eur"), F.col("state.hash").alias("content_hash"),
        F.col("recorded_from").cast("bigint").alias("recorded_from"), F.col("recorded_to").cast("bigint").alias("recorded_to"),
    )


def p1_extended(spark: SparkSession, d: str) -> DataFrame:
    """The ledger of the first two thirds of the record, extended by the rest as one more epoch that touches only the listings it names."""
    o = table(spark, d, "observations")
    cut = o.agg((F.min("id") + (F.max("id") - F.min("id")) * 2 / 3).alias("cut"))  # one row
    seen = observed_states(o).filter("listing_id IS NOT NULL AND at IS NOT NULL").crossJoin(F.broadcast(cut))
    shape = lambda df: df.select(F.col("listing_id").alias("entity"), "at", F.col("id").alias("seq"), F.struct("price_eur", "hash").alias("state"))
    early, late = seen.filter("id <= cut"), seen.filter("id > cut")
    first = bitemporal_ledger(early, "listing_id", "at", "id", ["price_eur", "hash"], F.lit(0))
    out = extend_ledger(first, shape(early), shape(late), 1)
    return out.select(
        F.col("entity").alias("listing_id"), F.col("valid_from").alias("valid_from_us"), F.col("valid_to").alias("valid_to_us"),
        F.col("state.price_eur").cast("double").alias("price_eur"), F.col("state.hash").alias("content_hash"),
        F.col("recorded_from").cast("bigint").alias("recorded_from"), F.col("recorded_to").cast("bigint").alias("recorded_to"),
    )


_SEEN = """
seen AS (
  SELECT listing_id, epoch_us(captured_at) AS t_us, id, price_eur, lower(content_hash) AS hash
  FROM observations
  WHERE (title IS NOT NULL OR description IS NOT NULL OR price_eur IS NOT NULL)
    AND listing_id IS NOT NULL AND captured_at IS NOT NULL)
"""

QUERIES = {"p1_found": p1_found, "p1_ledger": p1_ledger, "p1_extended": p1_extended}

SQL = {
    "p1_found": f"""
WITH {_SEEN},
point AS (SELECT * FROM seen QUALIFY row_number() OVER (PARTITION BY listing_id, t_us ORDER BY id DESC) = 1),
marked AS (
  SELECT *, row_number() OVER w AS n, lag(price_eur) OVER w AS p0, lag(hash) OVER w AS h0
  FROM point WINDOW w AS (PARTITION BY listing_id ORDER BY t_us)),
start AS (SELECT * FROM marked WHERE n = 1 OR price_eur IS DISTINCT FROM p0 OR hash IS DISTINCT FROM h0)
SELECT listing_id, t_us AS valid_from_us,
       coalesce(lead(t_us) OVER (PARTITION BY listing_id ORDER BY t_us), -1) AS valid_to_us
FROM start""",
    "p1_ledger": f"""
WITH {_SEEN},
turn AS (SELECT listing_id, id AS view, row_number() OVER (PARTITION BY listing_id ORDER BY id) AS turn, lead(id) OVER (PARTITION BY listing_id ORDER BY id) AS after FROM seen),
viewed AS (SELECT v.turn, v.view, v.after, s.* FROM turn v JOIN seen s ON s.listing_id = v.listing_id AND s.id <= v.view),
point AS (SELECT * FROM viewed QUALIFY row_number() OVER (PARTITION BY listing_id, turn, t_us ORDER BY id DESC) = 1),
marked AS (
  SELECT *, row_number() OVER w AS n, lag(price_eur) OVER w AS p0, lag(hash) OVER w AS h0
  FROM point WINDOW w AS (PARTITION BY listing_id, turn ORDER BY t_us)),
start AS (SELECT * FROM marked WHERE n = 1 OR price_eur IS DISTINCT FROM p0 OR hash IS DISTINCT FROM h0),
version AS (
  SELECT turn, view, after, listing_id, t_us AS valid_from_us,
         coalesce(lead(t_us) OVER (PARTITION BY listing_id, turn ORDER BY t_us), -1) AS valid_to_us, price_eur, hash
  FROM start),
runs AS (
  SELECT *, turn - row_number() OVER (PARTITION BY listing_id, valid_from_us, valid_to_us, price_eur, hash ORDER BY turn) AS run
  FROM version)
SELECT listing_id, valid_from_us, valid_to_us, price_eur::DOUBLE AS price_eur, hash AS content_hash,
       min(view)::BIGINT AS recorded_from, coalesce(arg_max(coalesce(after, -1), turn), -1)::BIGINT AS recorded_to
FROM runs GROUP BY listing_id, valid_from_us, valid_to_us, price_eur, hash, run""",
    "p1_extended": f"""
WITH {_SEEN},
cut AS (SELECT min(id) + (max(id) - min(id)) * 2 / 3.0 AS cut FROM observations),
viewed AS (SELECT v.view AS turn, v.view, v.after, s.* FROM seen s, cut, (VALUES (0, 1), (1, -1)) v(view, after) WHERE v.view = 1 OR s.id <= cut),
point AS (SELECT * FROM viewed QUALIFY row_number() OVER (PARTITION BY listing_id, turn, t_us ORDER BY id DESC) = 1),
marked AS (
  SELECT *, row_number() OVER w AS n, lag(price_eur) OVER w AS p0, lag(hash) OVER w AS h0
  FROM point WINDOW w AS (PARTITION BY listing_id, turn ORDER BY t_us)),
start AS (SELECT * FROM marked WHERE n = 1 OR price_eur IS DISTINCT FROM p0 OR hash IS DISTINCT FROM h0),
version AS (
  SELECT turn, view, after, listing_id, t_us AS valid_from_us,
         coalesce(lead(t_us) OVER (PARTITION BY listing_id, turn ORDER BY t_us), -1) AS valid_to_us, price_eur, hash
  FROM start),
runs AS (
  SELECT *, turn - row_number() OVER (PARTITION BY listing_id, valid_from_us, valid_to_us, price_eur, hash ORDER BY turn) AS run
  FROM version)
SELECT listing_id, valid_from_us, valid_to_us, price_eur::DOUBLE AS price_eur, hash AS content_hash,
       min(view)::BIGINT AS recorded_from, coalesce(arg_max(coalesce(after, -1), turn), -1)::BIGINT AS recorded_to
FROM runs GROUP BY listing_id, valid_from_us, valid_to_us, price_eur, hash, run""",
}
