"""Text functions as column expressions: folding, tokens, shingles, similarity, MinHash.

All are built-in expressions, so they stay inside the JVM. A null text gives null
unless stated otherwise.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import cache
from zlib import crc32

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SHINGLE = 5
SIGNATURE = 64
BAND_ROWS = 4


@cache
def _bases(compatible: bool) -> tuple[str, str]:
    """By rule: the accented (and, if ``compatible``, styled) characters that stand for one plain character, and those."""
    form = "NFKD" if compatible else "NFD"
    given, plain = [], []
    for code in [*range(0xA0, 0x2000), *(range(0x2000, 0xFFFF) if compatible else ()), *(range(0x1D400, 0x1D800) if compatible else ())]:
        if 0xD800 <= code <= 0xDFFF:
            continue
        c = chr(code)
        base = "".join(x for x in unicodedata.normalize(form, c) if not unicodedata.combining(x))
        if len(base) == 1 and base != c:
            given.append(c)
            plain.append(base)
    # đ and Đ have no decomposition
    return "".join(given) + "đĐ", "".join(plain) + "dD"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, evaluated once: inside a lambda a plain expression would be evaluated for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def unaccent(c: Column) -> Column:
    """``c`` without accents, letters in their case; ß becomes ss, đ becomes d."""
    return F.replace(F.regexp_replace(F.translate(c, *_bases(False)), r"\p{M}+", ""), F.lit("ß"), F.lit("ss"))


def fold(c: Column) -> Column:
    """Lower case, no accents, styled and full-width letters plain, white space of any kind as single blanks; null as ''.

    Characters that stand for several (ligatures, fractions) stay; ``fold_exact`` takes those apart too.
    """
    plain = F.replace(F.regexp_replace(F.translate(c, *_bases(True)), r"\p{M}+", ""), F.lit("ß"), F.lit("ss"))
    return F.coalesce(F.trim(F.regexp_replace(F.lower(plain), r"(?U)\s+", " ")), F.lit(""))


def fold_marks(c: Column) -> Column:
    """As ``fold``, but đ and ß are letters of their own: the form in which a quotation is compared with its source; null as ''."""
    given, plain = (x[:-2] for x in _bases(True))  # without đ and Đ
    bare = F.regexp_replace(F.translate(F.lower(c), given, plain), r"\p{M}+", "")
    return F.coalesce(F.trim(F.regexp_replace(bare, r"(?U)\s+", " ")), F.lit(""))


def _folded(texts: pd.Series) -> pd.Series:
    table = str.maketrans({"đ": "d", "Đ": "D", "ß": "ss"})

    def one(t: str | None) -> str:
        if not t:
            return ""
        parts = unicodedata.normalize("NFKD", t.translate(table))
        return " ".join("".join(x for x in parts if not unicodedata.combining(x)).lower().split())

    return texts.map(one)


def fold_exact(c: Column) -> Column:
    """``fold`` with Unicode's whole compatibility decomposition; an Arrow function, for parity checks."""
    return F.pandas_udf(_folded, "string")(c)


def squeezed(c: Column) -> Column:
    """Runs of white space as one blank, none around."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def location_key(c: Column) -> Column:
    """The narrowest place of a comma-separated location, folded; country names don't count; null if nothing is left."""
    parts = F.filter(F.transform(F.split(c, ","), fold), lambda p: ~p.isin("", "hrvatska", "croatia"))
    return F.try_element_at(parts, F.lit(-1))


def words(c: Column) -> Column:
    """The words of a text for full-text search: runs of letters and digits, unaccented, in lower case."""
    return F.regexp_extract_all(F.lower(unaccent(F.coalesce(c, F.lit("")))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def has_words(tokens: Column, query: str) -> Column:
    """Whether every word of ``query`` is among ``tokens``."""
    return F.forall(words(F.lit(query)), lambda w: F.array_contains(tokens, w))


def rank_words(tokens: Column, query: str) -> Column:
    """Occurrences of the query's words per word of the text; 0 for an empty text."""
    hits = let(words(F.lit(query)), lambda q: F.size(F.filter(tokens, lambda t: F.array_contains(q, t))))
    return F.coalesce(hits / F.nullif(F.size(tokens), F.lit(0)), F.lit(0.0))


def like_folded(c: Column, part: str) -> Column:
    """Whether ``c`` contains ``part`` without regard to accents and case; % and _ in it match any run and any character."""
    return F.like(F.lower(unaccent(c)), F.concat(F.lit("%"), F.lower(unaccent(F.lit(part))), F.lit("%")))


def shingles(folded: Column, k: int = SHINGLE) -> Column:
    """The distinct runs of ``k`` characters of a folded text; a shorter text is one shingle, an empty one has none."""

    def runs(t: Column) -> Column:
        # one pass over the text: cutting it place by place takes time that grows with the square of its length
        cut = F.array_distinct(F.regexp_extract_all(t, F.lit(f"(?s)(?=(.{{{k}}}))."), 1))
        return F.when(F.length(t) < k, F.filter(F.array(t), lambda x: x != "")).otherwise(cut)

    return let(folded, runs)


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all elements of two sets; 0 if either is empty."""
    common = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - common
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(common / F.nullif(either, F.lit(0)))


def minhash(sh: Column, size: int = SIGNATURE, name: str = "adstrata") -> Column:
    """``size`` minima of the shingles' CRC-32 under different masks; an empty set has an empty signature."""
    masks = F.array(*[F.lit(crc32(f"{name}-{i}".encode())).cast("bigint") for i in range(size)])
    minima = lambda hs: F.transform(masks, lambda m: F.array_min(F.transform(hs, lambda h: h.bitwiseXOR(m))))
    none = F.array().cast("array<bigint>")
    return let(F.transform(sh, lambda s: F.crc32(s.cast("binary"))), lambda hs: F.when(F.size(hs) == 0, none).otherwise(minima(hs)))


def text_bands(signature: Column, size: int = SIGNATURE, rows: int = BAND_ROWS) -> Column:
    """One label per ``rows`` minima: its offset and the minima; similar texts share at least one."""
    offsets = F.array(*[F.lit(i) for i in range(0, size - rows + 1, rows)])
    none = F.array().cast("array<string>")

    def labels(sig: Column) -> Column:
        part = lambda o: F.concat_ws("-", F.transform(F.slice(sig, o + 1, rows), lambda x: x.cast("string")))
        return F.when(F.size(sig) == 0, none).otherwise(F.transform(offsets, lambda o: F.concat(o.cast("string"), F.lit(":"), part(o))))

    return let(signature, labels)


def without_snippets(c: Column, snippets: Column) -> Column:
    """``c`` with every snippet, the longest first, replaced by a blank, and squeezed; a null list takes nothing out."""
    usable = F.filter(F.coalesce(snippets, F.array().cast("array<string>")), lambda s: s != "")
    ordered = F.array_sort(usable, lambda x, y: F.when(F.length(x) != F.length(y), F.length(y) - F.length(x)).when(x < y, -1).when(x > y, 1).otherwise(0))
    return squeezed(F.aggregate(ordered, F.coalesce(c, F.lit("")), lambda t, s: F.replace(t, s, F.lit(" "))))
