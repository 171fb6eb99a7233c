"""Numbers in text, as column expressions. What can't be read is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from adstrata.functions.text import fold

# Words for a floor, the first that a text contains counts.
FLOOR_WORDS = [
    ("podrum", "-2"), ("suteren", "-1"), ("prizemlje", "0"), ("prvi", "1"), ("drugi", "2"), ("treci", "3"),
    ("cetvrti", "4"), ("peti", "5"), ("sesti", "6"), ("sedmi", "7"), ("osmi", "8"), ("deveti", "9"), ("deseti", "10"),
    ("potkrovlje", "attic"), ("penthouse", "attic"), ("tavan", "attic"),
]
COUNTRY_PREFIX = "385"
PHONE_DIGITS = 11


def lenient_number(c: Column) -> Column:
    """A number with a decimal point or comma."""
    return F.replace(c, F.lit(","), F.lit(".")).try_cast("double")


def parse_area(c: Column) -> Column:
    """The first number in a text without its blanks."""
    first = F.regexp_extract(F.replace(c.cast("string"), F.lit(" "), F.lit("")), r"(\d+(?:[.,]\d+)?)", 1)
    return F.replace(first, F.lit(","), F.lit(".")).try_cast("double")


def is_precise(area: Column) -> Column:
    """Whether an area is more than 0.05 off a whole number; false for null."""
    return F.coalesce(F.abs(area - F.rint(area)) > 0.05, F.lit(False))


def parse_floor(c: Column) -> Column:
    """The floor as text: a number, or 'attic'."""
    t = fold(c.cast("string"))
    named = F.lit(None).cast("string")
    for word, value in reversed(FLOOR_WORDS):
        named = F.when(F.contains(t, F.lit(word)), F.lit(value)).otherwise(named)
    digits = F.regexp_extract(t, r"(-?\d+)", 1)
    return F.coalesce(named, digits.try_cast("bigint").cast("string"))


def floor_number(c: Column) -> Column:
    """The floor as an integer; null for an attic."""
    return parse_floor(c).try_cast("int")


def normalize_phone(c: Column) -> Column:
    """The digits of a number with the country's prefix and no leading zeros; null if fewer than PHONE_DIGITS."""
    digits = F.ltrim(F.regexp_replace(c, r"\D", ""), F.lit("0"))
    full = F.when(digits.startswith(COUNTRY_PREFIX), digits).otherwise(F.concat(F.lit(COUNTRY_PREFIX), digits))
    return F.when((digits != "") & (F.length(full) >= PHONE_DIGITS), full)


def grouped_number(c: Column, decimal: str = "comma") -> Column:
    """A number written with grouping marks; ``decimal`` says whether a comma or a point decides."""
    kept = F.regexp_replace(c, r"[^\d.,-]", "")
    plain = F.replace(F.replace(kept, F.lit("."), F.lit("")), F.lit(","), F.lit(".")) if decimal == "comma" else F.replace(kept, F.lit(","), F.lit(""))
    return plain.try_cast("double")


def ratio(a: Column, b: Column, digits: int) -> Column:
    """a / b rounded half up, as a double; null where b is 0 or null."""
    return F.round((a / F.nullif(b, F.lit(0))).cast("double"), digits)
