"""Addresses of result pages, as column expressions."""

from __future__ import annotations

import json
import re
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def page_urls(url: Column, page: Column, mode: str = "query_param", param: str = "page", start_at: int = 1, json_key: str = "page", double_encoded: bool = False) -> Column:
    """The address of result page ``page`` (1 is ``url`` itself), the rest of it as it is written; null for a null address or page.

    query_param: the number is a parameter, set where it stands or put at the end;
    path_suffix: it follows the path; json_param: it is a key of a JSON object in a
    parameter that is URL-encoded once or twice. An address that doesn't fit, and any
    other mode, comes back as it is.
    """
    number = page.cast("bigint") + (start_at - 1)
    text = number.cast("string")
    name = re.escape(param)
    holds = url.rlike(rf"[?&]{name}=")
    if mode == "path_suffix":
        moved = F.concat(F.rtrim(url, F.lit("/")), F.lit("/"), text)
    elif mode == "query_param":
        address, fragment = F.substring_index(url, "#", 1), F.regexp_extract(url, "#.*$", 0)
        glue = F.when(address.rlike(r"[?&]$"), "").when(address.contains("?"), "&").otherwise("?")
        added = F.concat(address, glue, F.lit(f"{param}="), text, fragment)
        moved = F.when(holds, F.regexp_replace(url, F.lit(rf"([?&]{name}=)[^&#]*"), F.concat(F.lit("$1"), text))).otherwise(added)
    elif mode == "json_param":
        packed = F.regexp_extract(url, rf"[?&]{name}=([^&#]*)", 1)
        for _ in range(1 + double_encoded):
            packed = F.try_url_decode(F.replace(packed, F.lit("+"), F.lit("%2B")))
        packed = F.pandas_udf(lambda objects, values: _with_key(objects, json_key, values), "string")(packed, F.coalesce(number, F.lit(0)))
        for _ in range(1 + double_encoded):
            packed = F.replace(F.url_encode(packed), F.lit("+"), F.lit("%20"))
        moved = F.regexp_replace(url, F.lit(rf"([?&]{name}=)[^&#]*"), F.concat(F.lit("$1"), packed))
        moved = F.when(holds, F.coalesce(moved, url)).otherwise(url)
    else:
        moved = url
    return F.when(page <= 1, url).when(page > 1, moved)


def _with_key(objects: pd.Series, key: str, values: pd.Series) -> pd.Series:
    """JSON objects with ``key`` set, other keys in their order; null for what is no object."""

    def one(text: str | None, value: int) -> str | None:
        try:
            held = json.loads(text or "null")
        except ValueError:
            return None
        return json.dumps({**held, key: int(value)}, separators=(",", ":")) if isinstance(held, dict) else None

    return pd.Series(map(one, objects, values), dtype=object)


def request_urls(base: str, params: dict[str, Column | str], page: Column, page_param: str = "page", start_at: int = 1) -> Column:
    """The address of one page of a JSON endpoint: ``base`` with encoded parameters; null and empty ones are left out, and the page comes last."""
    pair = lambda k, v: F.concat(F.lit(f"{k}="), F.url_encode(v.cast("string")))
    given = {k: F.lit(v) if isinstance(v, str) else v for k, v in params.items()}
    pairs = [pair(k, F.nullif(v.cast("string"), F.lit(""))) for k, v in given.items() if k != page_param]
    query = F.concat_ws("&", *pairs, pair(page_param, page.cast("bigint") + (start_at - 1)))
    return F.concat(F.lit(base), F.lit("&" if "?" in base else "?"), query)


def absolute(href: str, base: str) -> str:
    """``href`` as an absolute address under ``base``."""
    return urljoin(base + "/", href)


def url_shape(url: Column) -> Column:
    """An address with numbers as N and long slugs as SLUG, to count addresses of a kind."""
    return F.regexp_replace(F.regexp_replace(url, r"[a-z0-9]+(?:-[a-z0-9]+){2,}", "SLUG"), r"\d+", "N")
