"""Content hashes and 64-bit perceptual hashes, as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

NEAR = 8


def content_hash(columns: Sequence[str]) -> Column:
    """SHA-256 over the named columns in order of name; a null differs from an empty text."""
    parts = [F.concat(F.lit(f"{c}="), F.coalesce(F.concat(F.lit("'"), F.col(c).cast("string"), F.lit("'")), F.lit("null"))) for c in sorted(columns)]
    return F.sha2(F.concat_ws("|", *parts), 256)


def bits_of_hex(c: Column) -> Column:
    """A hash of 16 hex digits as a 64-bit integer; null for null and for the empty (unusable) hash."""
    return F.when(c != "", F.conv(c, 16, -10).cast("bigint"))


def sign_bits(vector: Column, size: int = 64) -> Column:
    """A 64-bit hash of a vector: bit i is set where element i is positive."""
    pick = lambda i: F.when(F.get(vector, F.lit(i)) > 0, F.shiftleft(F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint"))
    out = pick(0)
    for i in range(1, size):
        out = out.bitwiseOR(pick(i))
    return out


def hash_distance(a: Column, b: Column) -> Column:
    """How many bits differ."""
    return F.bit_count(a.bitwiseXOR(b))


def hash_bands(bits: Column, bands: int = 4) -> Column:
    """The hash in ``bands`` parts, labelled by their number from the low end; close hashes share one."""
    width = 64 // bands
    part = lambda i: F.concat(F.lit(f"{i}:"), F.lpad(F.lower(F.hex(F.shiftrightunsigned(bits, i * width).bitwiseAND(F.lit((1 << width) - 1)))), width // 4, F.lit("0")))
    return F.array(*[part(i) for i in range(bands)])


def count_matches(a: Column, b: Column, near: int = NEAR) -> Column:
    """How many hashes of ``a``, in order, find a hash of ``b`` within ``near`` bits that no earlier one took."""
    none = F.array().cast("array<int>")
    places = lambda used, h: F.filter(
        F.transform(b, lambda x, i: F.when((hash_distance(x, h) <= near) & ~F.array_contains(used, i), i)), lambda i: i.isNotNull()
    )
    used = F.aggregate(a, none, lambda used, h: F.concat(used, F.slice(places(used, h), 1, 1)))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(used)).otherwise(0)
