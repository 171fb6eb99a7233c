"""Visually identical text with different characters: skeletons over a table of look-alikes.

The skeleton of a text is found by decomposing it, replacing every character by its
prototype and decomposing again; texts that look the same have the same skeleton and
are grouped by it. Prototypes come from two places: by rule from Unicode's own data
(styled and full-width variants, ligatures, space characters, invisible characters)
and, for letters of other alphabets, from the table below. Skeletons are kept in
composed form, which makes a text of plain characters its own skeleton: the JVM
finds those by one regular expression, and only the rest goes through Python.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adstrata.plans.scratch import written

# Letters of other alphabets and the Latin letters they look like.
CYRILLIC_LIKE = "аеорсухіјѕԁһԛԝѵАВЕЅІЈКМНОРСТУХЗԌԚԜ"
CYRILLIC_AS = "aeopcyxijsdhqwvABESIJKMHOPCTYX3GQW"
GREEK_LIKE = "ονιαρυκητεωΑΒΕΖΗΙΚΜΝΟΡΤΥΧ"
GREEK_AS = "oviapukntewABEZHIKMNOPTYX"
ARMENIAN_LIKE = "օսոհցյզՕՍՏԼ"
ARMENIAN_AS = "ounhgjqOUSL"
COPTIC_LIKE = "ⲟⲣⲥⲞⲢⲤⲎⲒⲔⲘⲚⲦⲬⲨ"
COPTIC_AS = "opcOPCHIKMNTXY"
CHEROKEE_LIKE = "ᎠᎡᎢᎥᎪᎫᎬᎳᎷᎻᎽᏀᏃᏏᏔᏕᏙᏚᏞᏟᏢᏦᏴ"
CHEROKEE_AS = "DRTiAJEWMHYGZbWSVSLCPKB"
# Only in skeletons: small forms of Latin capitals, by which a Cyrillic word would be read as a Latin one.
SMALL_LIKE = "кмтнвб"
SMALL_AS = "kmthb6"
CROATIAN_LIKE = "ÐƉɖ"
CROATIAN_AS = "ĐĐđ"
# Characters without width or shape.
INVISIBLE = "­͏؜ᅟᅠ឴឵᠎​‌‍‎‏‪‫‬‭‮⁠⁡⁢⁣⁤⁦⁧⁨⁩﻿"

_FOREIGN = dict(zip(CYRILLIC_LIKE + GREEK_LIKE + ARMENIAN_LIKE + COPTIC_LIKE + CHEROKEE_LIKE, CYRILLIC_AS + GREEK_AS + ARMENIAN_AS + COPTIC_AS + CHEROKEE_AS, strict=True))
_SMALL = dict(zip(SMALL_LIKE, SMALL_AS, strict=True))
_CROATIAN = dict(zip(CROATIAN_LIKE, CROATIAN_AS, strict=True))
_STYLES = ("<font>", "<wide>", "<narrow>", "<circle>")
_SCRIPTS = ("LATIN", "CYRILLIC", "GREEK", "ARMENIAN", "CHEROKEE", "COPTIC")


@cache
def variants() -> dict[str, str]:
    """By rule: every styled letter, digit or sign, and every character for two Latin letters, with what it stands for."""
    out = {}
    for code in range(0x80, sys.maxunicode + 1):
        c = chr(code)
        parts = unicodedata.decomposition(c).split()
        if not parts or parts[0][0] != "<" or unicodedata.category(c)[0] == "Z":
            continue
        plain = unicodedata.normalize("NFKC", c)
        styled = parts[0] in _STYLES and (parts[0] != "<circle>" or plain.isalnum() and plain.isascii())
        two = parts[0] == "<compat>" and c.isalpha() and len(plain) > 1 and all(x.isalpha() and _script(x) == "LATIN" for x in plain)
        if (styled or two) and plain != c:
            out[c] = plain
    return out


@cache
def spaces() -> str:
    """Every space character but the ordinary one."""
    return "".join(c for c in map(chr, range(0x80, 0x3001)) if unicodedata.category(c) == "Zs")


@cache
def _script(c: str) -> str:
    return unicodedata.name(c, "").split(" ")[0].replace("FULLWIDTH", "LATIN")


# The ranges that ordinary text of this kind is made of; they hold no character of variants(), spaces() or INVISIBLE.
ORDINARY = [(0x00, 0x9F), (0xA1, 0xAC), (0xAE, 0xCF), (0xD1, 0x131), (0x134, 0x148), (0x14A, 0x17E), (0x400, 0x47F), (0x2010, 0x2024), (0x2026, 0x2027), (0x2030, 0x205E), (0x20A0, 0x20C0)]
OTHER_ALPHABETS = r"[\x{370}-\x{58f}\x{13a0}-\x{13ff}\x{1f00}-\x{1fff}\x{2c80}-\x{2cff}]"


def _unusual(text: Column) -> Column:
    """Whether ``text`` has a character outside ORDINARY: one class, so the JVM reads the text once."""
    return text.rlike("[^" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ORDINARY) + "]")


def _suspect(text: Column) -> Column:
    """Whether ``text`` may hold a case: it may find more, never fewer."""
    latin, other = r"\p{IsLatin}", OTHER_ALPHABETS
    mixed = rf"{latin}{other}|{other}{latin}|\p{{IsGreek}}\p{{IsCyrillic}}|\p{{IsCyrillic}}\p{{IsGreek}}"
    return _unusual(text) | (text.rlike(other) & text.rlike(mixed))


def _shaped(text: Column) -> Column:
    """Whether the skeleton of ``text`` may differ from it."""
    return _unusual(text) | text.rlike(OTHER_ALPHABETS)


# A letter with the marks of the combining blocks after it.
_MARKED = re.compile(r"\w[\u0300-\u036f\u0483-\u0487\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\u3099\u309a]+")
_LETTERS = re.compile(r"[^\W\d_](?:[^\W\d_]|[̀-ͯ])*")


@cache
def _patterns() -> dict[str, re.Pattern]:
    hidden = "[" + INVISIBLE + "]"
    return {
        "styled": re.compile("[" + re.escape("".join(variants())) + "]"),
        "invisible": re.compile(rf"\w[̀-ͯ]*{hidden}|{hidden}\w"),
        "space": re.compile("[" + spaces() + "]"),
        "croatian": re.compile("[" + CROATIAN_LIKE + "]"),
    }


def kinds(text: str) -> list[str]:
    """Which kinds of look-alikes ``text`` holds: styled, pieces, invisible, space, croatian, mixed."""
    found = [k for k, p in _patterns().items() if p.search(text)]
    if any(len(unicodedata.normalize("NFC", m)) < len(m) for m in _MARKED.findall(text)):
        found.append("pieces")
    if any(len(_scripts(w)) > 1 for w in _LETTERS.findall(text)):
        found.append("mixed")
    return found


def _scripts(word: str) -> set[str]:
    if word.isascii():
        return {"LATIN"}
    return {s for c in set(word) if c.isalpha() and (s := _script(c)) in _SCRIPTS}


@cache
def _plain_table() -> dict[int, str]:
    return {ord(c): s for c, s in variants().items()} | {ord(c): " " for c in spaces()} | {ord(c): s for c, s in _CROATIAN.items()}


@cache
def _skeleton_table() -> dict[int, str | None]:
    return _plain_table() | {ord(c): None for c in INVISIBLE + "︎️"} | {ord(c): s for c, s in (_FOREIGN | _SMALL).items()}


def skeleton(text: str) -> str:
    """Decompose, replace every character by its prototype, decompose again; in composed form."""
    table = _skeleton_table()
    once = unicodedata.normalize("NFD", unicodedata.normalize("NFC", text).translate(table))
    return unicodedata.normalize("NFC", once.translate(table))


def one_form(text: str) -> str:
    """``text`` with plain characters for look-alikes; words wholly in another alphabet and emoji stay."""
    hidden = re.compile(rf"(?<=\w)[{INVISIBLE}]+|(?<=[̀-ͯ])[{INVISIBLE}]+|[{INVISIBLE}]+(?=\w)")
    t = unicodedata.normalize("NFC", hidden.sub("", text).translate(_plain_table()))
    return _LETTERS.sub(_one_alphabet, t)


def _one_alphabet(m: re.Match) -> str:
    word = m.group()
    if len(_scripts(word)) < 2:
        return word
    latin = word.translate({ord(c): s for c, s in _FOREIGN.items()})
    if len(_scripts(latin)) == 1:
        return latin
    back = {ord(s): c for c, s in reversed(list(zip(CYRILLIC_LIKE, CYRILLIC_AS, strict=True)))}
    cyrillic = word.translate(back)
    return cyrillic if len(_scripts(cyrillic)) == 1 else latin


_OUT = "kinds array<string>, skeleton string, form string"


def _looks(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in texts:
        rows = [(kinds(t), skeleton(t), one_form(t)) if t is not None else (None, None, None) for t in batch]
        yield pd.DataFrame(rows, columns=["kinds", "skeleton", "form"])


def _look(text: Column) -> Column:
    return F.pandas_udf(_looks, _OUT)(text)


def with_looks(texts: DataFrame, text: str = "text") -> DataFrame:
    """``texts`` with ``kinds`` (of look-alikes, empty if none), ``skeleton`` and ``form`` (its one plain form).

    A null text has nulls; an empty one is its own skeleton and form. Columns of these
    names in ``texts`` are replaced. Texts without an unusual character never leave the JVM.
    """
    texts = texts.drop(*[c for c in ("kinds", "skeleton", "form") if c != text])
    unusual = texts.filter(_shaped(F.col(text)))
    plain = texts.filter(~F.coalesce(_shaped(F.col(text)), F.lit(False)))
    looked = unusual.withColumn("__l", _look(F.col(text))).select(*texts.columns, "__l.kinds", "__l.skeleton", "__l.form")
    none = F.when(F.col(text).isNotNull(), F.array().cast("array<string>"))
    return looked.unionByName(plain.withColumns({"kinds": none, "skeleton": F.col(text), "form": F.col(text)}))


def cases(texts: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``texts`` that hold a look-alike, with the columns of ``with_looks``."""
    texts = texts.drop(*[c for c in ("kinds", "skeleton", "form") if c != text])
    suspect = texts.filter(_suspect(F.col(text)))
    looked = suspect.withColumn("__l", _look(F.col(text))).select(*texts.columns, "__l.kinds", "__l.skeleton", "__l.form")
    return looked.filter(F.array_contains("kinds", "mixed") | (F.size("kinds") > 0) & (F.col(text) != F.col("skeleton")))


def groups(texts: DataFrame, text: str = "text") -> DataFrame:
    """One row per skeleton that several different texts share: skeleton, variants, rows, form (the commonest plain form, then the least).

    Texts are first counted, so a text that a third of the rows repeat is one row; null texts are in no group.
    """
    counted = texts.filter(F.col(text).isNotNull()).groupBy(F.col(text).alias("text")).agg(F.count("*").alias("n"))
    looked = with_looks(written(counted, "texts"))  # else both halves would read and count all texts
    forms = looked.groupBy("skeleton", "form").agg(F.sum("n").alias("n"), F.count("*").alias("variants"))
    best = F.min(F.struct((-F.col("n")).alias("m"), "form"))["form"].alias("form")
    return forms.groupBy("skeleton").agg(F.sum("variants").alias("variants"), F.sum("n").alias("rows"), best).filter("variants > 1")
