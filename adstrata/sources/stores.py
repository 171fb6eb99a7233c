"""Keyed upserts without a lakehouse format: each is a join of what is stored with what comes in.

A result is a new version of the table; ``Versioned`` keeps the versions as parquet
directories with a pointer that a reader follows, so a failed write is never seen;
``Growing`` keeps a folder for each batch added.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adstrata.functions.hashes import content_hash
from adstrata.operators.current import top_per_key
from adstrata.plans.scratch import delete, file_of, put_text, read_text


def upserted(stored: DataFrame, incoming: DataFrame, keys: Sequence[str], update: dict[str, Column | str], order: Sequence[str] = ()) -> DataFrame:
    """``stored`` after an upsert: new keys are added, known ones get the columns of ``update``.

    In ``update`` ``old.x`` and ``new.x`` are the stored and the incoming value; other
    columns keep the stored value, or take the incoming one for a new key (null if the
    input lacks it). Of several incoming rows of a key the last by ``order`` counts.
    Rows with a null key never match and are added as they are.
    """
    if order:
        named = incoming.filter(" AND ".join(f"{k} IS NOT NULL" for k in keys))
        bare = incoming.filter(" OR ".join(f"{k} IS NULL" for k in keys))
        incoming = top_per_key(named, keys, order).select(*incoming.columns).unionByName(bare)
    o, n = stored.withColumn("__o", F.lit(True)).alias("old"), incoming.withColumn("__n", F.lit(True)).alias("new")
    match = F.lit(True)
    for k in keys:
        match = match & (F.col(f"old.{k}") == F.col(f"new.{k}"))
    joined = o.join(n, match, "full_outer")
    hit, fresh = F.col("__n").isNotNull() & F.col("__o").isNotNull(), F.col("__o").isNull()
    out = []
    for c in stored.columns:
        came = F.col(f"new.{c}") if c in incoming.columns else F.lit(None)
        kept = F.when(fresh, came).otherwise(F.col(f"old.{c}"))
        if c in update:
            value = F.expr(update[c]) if isinstance(update[c], str) else update[c]
            kept = F.when(hit, value).otherwise(kept)
        out.append(kept.cast(stored.schema[c].dataType).alias(c))
    return joined.select(*out)


def seen_listings(stored: DataFrame, sightings: DataFrame) -> DataFrame:
    """Listings after sightings (source, source_id, url, last_seen): the later time and the new address hold, first_seen stays."""
    return upserted(
        stored, sightings.withColumn("first_seen", F.col("last_seen")), ["source", "source_id"],
        {"last_seen": "greatest(old.last_seen, new.last_seen)", "url": "coalesce(new.url, old.url)"}, ["last_seen", "url"],
    )


def unseen(stored: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The incoming rows whose key is not stored, each key once (insert-ignore)."""
    return incoming.dropDuplicates(list(keys)).join(stored.select(*keys).distinct(), list(keys), "left_anti")


def changed(stored: DataFrame, incoming: DataFrame, key: str, columns: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The incoming rows whose content differs from the key's row before them, stored rows included; a return to an older content counts."""
    from pyspark.sql import Window as W

    both = stored.withColumn("__new", F.lit(False)).unionByName(incoming.withColumn("__new", F.lit(True)), allowMissingColumns=True)
    hashed = both.withColumn("__hash", content_hash(columns))
    before = F.lag("__hash").over(W.partitionBy(key).orderBy(*order))
    return hashed.withColumn("__before", before).filter(F.col("__new") & ~F.col("__hash").eqNullSafe(F.col("__before"))).select(*incoming.columns)


def replaced(stored: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """``stored`` with all rows of the incoming keys replaced by the incoming rows (delete, then insert)."""
    return stored.join(incoming.select(key).distinct(), key, "left_anti").unionByName(incoming.distinct())


def absent(stored: DataFrame, sightings: DataFrame, keys: Sequence[str], scope: str) -> DataFrame:
    """The stored rows not sighted, for the values of ``scope`` that have sightings; one without any is left alone."""
    covered = stored.join(sightings.select(scope).distinct(), scope, "left_semi")
    return covered.join(sightings.select(*keys).distinct(), list(keys), "left_anti")


def positions(df: DataFrame, key: str, items: str) -> DataFrame:
    """(key, position, item): the items of an array with their 0-based place, the first place of each."""
    spread = df.select(key, F.posexplode(items).alias("position", "item")).filter("item IS NOT NULL")
    return spread.groupBy(key, "item").agg(F.min("position").alias("position"))


class Versioned:
    """A table at ``path`` as whole versions; ``write`` publishes one by renaming a pointer file into place.

    The version before stays for readers that follow it still; older ones are deleted.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _versions(self) -> list[str]:
        text = read_text(self.spark, f"{self.path}/CURRENT")
        return text.split() if text else []

    def version(self) -> str | None:
        return next(iter(self._versions()), None)

    def read(self) -> DataFrame | None:
        v = self.version()
        return None if v is None else self.spark.read.parquet(f"{self.path}/{v}")

    def write(self, df: DataFrame) -> str:
        v, before = f"v-{uuid.uuid4().hex}", self._versions()
        df.write.parquet(f"{self.path}/{v}")
        put_text(self.spark, f"{self.path}/CURRENT", "\n".join([v, *before[:1]]))
        for old in before[1:]:
            delete(self.spark, f"{self.path}/{old}")
        return v


class Growing:
    """A table at ``path`` of one folder per batch; writing a batch again replaces its folder, so a batch never counts twice.

    A folder counts once the job that wrote it has left its _SUCCESS file.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def put(self, df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def batches(self, below: int | None = None) -> list[int]:
        """The numbers of the whole batches, those below ``below`` only if it is given."""
        at, fs = file_of(self.spark, self.path)
        found = [s.getPath() for s in fs.listStatus(at)] if fs.exists(at) else []
        whole = [int(p.getName()[6:]) for p in found if p.getName().startswith("batch=") and fs.exists(file_of(self.spark, f"{p}/_SUCCESS")[0])]
        return sorted(b for b in whole if below is None or b < below)

    def read(self, below: int | None = None) -> DataFrame | None:
        numbers = self.batches(below)
        return self.spark.read.parquet(*[f"{self.path}/batch={b}" for b in numbers]) if numbers else None
