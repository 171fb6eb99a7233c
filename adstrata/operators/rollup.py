"""Rolling rows up to their group: flags, ranked words, evidence maps; and rows whose text changed since it was looked at."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adstrata.functions.text import fold_marks


def any_true(c: Column | str) -> Column:
    """Whether the flag is true in any row; null only if it is null in all."""
    return F.bool_or(c)


def worst(c: Column | str, ranks: Sequence[str]) -> Column:
    """The word of ``ranks`` (mildest first) that ranks highest in the group; other words don't count; null if there is none."""
    order = F.array(*[F.lit(r) for r in ranks])
    place = F.nullif(F.array_position(order, F.col(c) if isinstance(c, str) else c), F.lit(0))
    return F.try_element_at(order, F.max(place).cast("int"))


def evidence_map(key: Column | str, value: Column | str) -> Column:
    """A map of each key to its value, for the rows that have one; of several values of a key the greatest; in order of key."""
    key, value = (F.col(x) if isinstance(x, str) else x for x in (key, value))
    pairs = F.array_sort(F.collect_set(F.when(value.isNotNull() & key.isNotNull(), F.struct(key.alias("k"), value.alias("v")))))
    last = F.filter(pairs, lambda p, i: ~F.coalesce(F.get(pairs, i + 1)["k"] == p["k"], F.lit(False)))
    return F.map_from_entries(last)


def quoted(quote: Column, text: Column) -> Column:
    """Whether a quote really stands in a text, both lower case, without accents and squeezed; an empty or null quote never does."""
    return (fold_marks(quote) != "") & F.contains(fold_marks(text), fold_marks(quote))


def stale(rows: DataFrame, seen: DataFrame, key: str, text: str, hash_: str = "text_hash") -> DataFrame:
    """The rows with a text whose key isn't in ``seen`` (key, text_hash), or whose text's hash (32 digits of SHA-256) differs from the one there."""
    now = rows.filter(F.col(text).isNotNull() & (F.trim(text) != "")).withColumn("__now", F.substring(F.sha2(F.col(text), 256), 1, 32))
    known = seen.groupBy(key).agg(F.max(hash_).alias("__then"))
    return now.join(known, key, "left").filter(~F.col("__now").eqNullSafe(F.col("__then"))).drop("__now", "__then")
