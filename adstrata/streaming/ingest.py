"""Streams of snapshots: appended once per content, and folded into the batch operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from adstrata.sources.stores import Growing, unseen


def landing(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 100) -> DataFrame:
    """Parquet files as they land in ``path``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def once_per_content(stream: DataFrame, time: str = "captured_at", keys: tuple[str, ...] = ("listing_id", "content_hash"), late: str = "7 days") -> DataFrame:
    """``stream`` with each key once within the watermark ``late``; the state of older keys is dropped."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))


def counts_per_day(stream: DataFrame, time: str = "captured_at", late: str = "2 days") -> DataFrame:
    """Snapshots per day of valid time; a day is final once the watermark has passed it."""
    from pyspark.sql import functions as F

    days = stream.withWatermark(time, late).groupBy(F.window(time, "1 day").alias("w"))
    return days.agg(F.count("*").alias("snapshots")).select(F.col("w.start").alias("day"), "snapshots")


def appended(stream: DataFrame, store: Growing, checkpoint: str, keys: tuple[str, ...] = ("listing_id", "content_hash")) -> StreamingQuery:
    """Append the unseen contents of what is there now to ``store``, a folder per micro-batch, and stop.

    A micro-batch that is run again replaces its own folder: it is compared with the
    batches before it, so it adds what it added the first time. History is read by its
    keys alone and never written again.
    """

    def fold(batch: DataFrame, number: int) -> None:
        stored = store.read(below=number)
        store.put(batch.dropDuplicates(list(keys)) if stored is None else unseen(stored, batch, keys), number)

    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def folded(stream: DataFrame, step: Callable[[DataFrame], None], checkpoint: str) -> StreamingQuery:
    """Run a batch operator on every micro-batch of what is there now."""
    return stream.writeStream.foreachBatch(lambda batch, _: step(batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
