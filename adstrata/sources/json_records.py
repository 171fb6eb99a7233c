"""Semi-structured records: dotted paths, typed mapping, and pages of a JSON endpoint landed as files."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adstrata.functions.numbers import lenient_number


def json_path(dotted: str) -> str:
    """``a.b.0`` as a JSON path, $.a.b[0]."""
    return "$" + "".join(f"[{p}]" if p.isdigit() else f"['{p}']" for p in dotted.split("."))


def dig(record: Column, dotted: str) -> Column:
    """The value at a dotted path of a JSON text, as text; null where any step is missing."""
    return F.get_json_object(record, json_path(dotted))


@dataclass(frozen=True)
class RecordSpec:
    """Where the fields of a record are; ``min_plausible_price``: a lower positive price is a placeholder and becomes null."""

    fields: Mapping[str, str]
    image_url: str | None = None
    detail_url: str | None = None
    min_plausible_price: float = 0.0
    max_images: int | None = None
    numeric: tuple[str, ...] = field(default=("price_eur", "area_m2", "rooms", "previous_price", "reduction_pct", "price_per_m2"))

    def __post_init__(self) -> None:
        if "source_id" not in self.fields:
            raise ValueError("fields: source_id is missing")


def mapped(records: DataFrame, record: str, spec: RecordSpec) -> DataFrame:
    """``records`` with the typed fields of its JSON text column ``record``.

    Missing fields are null. A list of places is joined by ', ' and its last one is the
    specific location. ``{value}`` and ``{field}`` in the URL templates are filled in.
    """
    raw = F.col(record)
    at = {name: dig(raw, path) for name, path in spec.fields.items()}
    none = F.lit(None).cast("string")
    get = lambda name: at.get(name, none)
    parts = F.filter(F.from_json(get("location_parts"), "array<string>"), lambda p: F.coalesce(p, F.lit("")) != "")
    raw_place = F.coalesce(get("location_raw"), get("location_parts"))
    has_parts = F.coalesce(F.size(parts) > 0, F.lit(False))
    images = F.coalesce(F.from_json(get("images"), "array<string>"), F.array().cast("array<string>"))
    if spec.max_images:
        images = F.slice(images, 1, spec.max_images)
    if spec.image_url:
        images = F.transform(images, lambda i: F.replace(F.lit(spec.image_url), F.lit("{value}"), i))
    url = F.lit(spec.detail_url).cast("string")
    for name in spec.fields:
        if spec.detail_url and "{" + name + "}" in spec.detail_url:
            url = F.replace(url, F.lit("{" + name + "}"), F.coalesce(get(name), F.lit("")))
    price = lenient_number(get("price_eur"))
    placeholder = F.coalesce(price < spec.min_plausible_price, F.lit(False)) if spec.min_plausible_price > 0 else F.lit(False)
    company = get("seller_is_company").try_cast("boolean") if "seller_is_company" in at else None
    seller = get("seller_type") if company is None else F.when(company, "agency").when(~company, "private")
    out = {name: (lenient_number(get(name)) if name in spec.numeric else get(name)) for name in spec.fields if name not in ("location_parts", "images", "seller_is_company")}
    out |= {
        "price_eur": F.when(~placeholder, price), "price_placeholder": placeholder, "url": url, "images": images, "seller_type": seller,
        "location_raw": F.when(has_parts, F.array_join(parts, ", ")).otherwise(raw_place), "location_specific": F.when(has_parts, F.try_element_at(parts, F.lit(-1))).otherwise(raw_place),
    }
    return records.select(*[c for c in records.columns if c != record], *[v.alias(k) for k, v in out.items()])


def landed_pages(spark: SparkSession, path: str, records_path: str = "data") -> DataFrame:
    """(file, record): the records of landed pages, one JSON document a file, each record as JSON text.

    A page whose records are no list, or that isn't JSON, raises; an empty page has none.
    """
    pages = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("page"))
    found = dig(F.col("page"), records_path)
    rows = F.from_json(found, "array<string>", {"mode": "FAILFAST"})
    checked = F.when(found.startswith("["), rows).otherwise(F.raise_error(F.concat(F.lit(f"no list at {records_path} in "), F.col("file"))))
    return pages.select("file", F.explode(checked).alias("record"))


def last_page(page: Column, records_path: str = "data", next_path: str | None = None, stop: str = "-1") -> Column:
    """Whether a page is the last: its next page is missing or ``stop``; without such a path, it has no records."""
    if next_path:
        following = dig(page, next_path)
        return F.coalesce(following == stop, F.lit(True))
    return F.coalesce(F.json_array_length(dig(page, records_path)) == 0, F.lit(True))
