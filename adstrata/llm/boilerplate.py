"""Lines repeated across one source's documents: found by their graph, taken out of each document.

Every document is a path through its lines. Nodes (lines of one source, in one
form) and edges (lines that follow one another) are weighted by the number of
different documents that hold them; nodes and edges of high support are kept, and
the connected components of what is left are the source's blocks of boilerplate.

Scale: texts are first reduced to one per source, document and wording. Support is
counted by combining aggregates, so a source with a third of all rows is spread
over its lines. Every kept line is in at least ``share`` of the source's documents,
so a source keeps at most 1 / share times its mean number of lines per document:
that bounds each source's graph, which is why its components can be found in one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def line_form(line: Column) -> Column:
    """A line in the form that is compared: blanks squeezed, digits as ``#``, lower case, no blanks around it."""
    squeezed = F.regexp_replace(F.regexp_replace(line, "[ \\t\\r]+", " "), "[0-9]+", "#")
    return F.trim(F.lower(squeezed))


def wordings(docs: DataFrame, source: str, doc: str, text: str) -> DataFrame:
    """(source, doc, text): each wording of each document once; rows with a null in any of them are left out."""
    return docs.select(F.col(source).alias("source"), F.col(doc).alias("doc"), F.col(text).alias("text")).filter(
        "source IS NOT NULL AND doc IS NOT NULL AND text IS NOT NULL"
    ).distinct()


def _lines(worded: DataFrame) -> DataFrame:
    """(source, doc, forms): the non-empty lines of each wording, in order and in one form."""
    forms = F.filter(F.transform(F.split("text", "\n"), line_form), lambda x: x != "")
    return worded.select("source", "doc", forms.alias("forms"))


def boilerplate_lines(docs: DataFrame, source: str, doc: str, text: str, least_docs: int = 4, share: float = 0.25) -> DataFrame:
    """The nodes kept: source, line, docs (documents with the line), of (documents of the source with a text).

    A line is kept that at least ``least_docs`` documents and ``share`` of the source's
    documents with a non-null text hold, over all their wordings. A line repeated in a
    document counts once. Null sources, documents and texts are left out; an empty text
    counts as a document without lines. No rows give an empty table.
    """
    worded = wordings(docs, source, doc, text)
    in_docs = _lines(worded).select("source", "doc", F.explode(F.array_distinct("forms")).alias("line")).distinct()
    held = in_docs.groupBy("source", "line").agg(F.count("*").alias("docs")).filter(F.col("docs") >= least_docs)
    size = _sizes(docs, source, doc, text)
    return held.join(size, "source").filter(F.col("docs") >= F.lit(share) * F.col("of"))


def _sizes(docs: DataFrame, source: str, doc: str, text: str) -> DataFrame:
    named = docs.filter(F.col(text).isNotNull()).select(F.col(source).alias("source"), F.col(doc).alias("doc"))
    return named.filter("source IS NOT NULL AND doc IS NOT NULL").distinct().groupBy("source").agg(F.count("*").alias("of"))


def _block_ids(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out: dict[str, list] = {"source": [], "line": [], "block": []}
        for source, lines, edges in zip(batch["source"], batch["lines"], batch["edges"]):
            top = {x: x for x in lines}

            def find(x: str, top: dict = top) -> str:
                while top[x] != x:
                    top[x] = top[top[x]]
                    x = top[x]
                return x

            for e in edges if edges is not None else []:
                a, b = sorted((find(e["a"]), find(e["b"])))
                top[b] = a
            least: dict[str, str] = {}
            for x in lines:
                least[find(x)] = min(x, least.get(find(x), x))
            for x in lines:
                out["source"].append(source)
                out["line"].append(x)
                out["block"].append(least[find(x)])
        yield pd.DataFrame(out)


def boilerplate_blocks(docs: DataFrame, source: str, doc: str, text: str, least_docs: int = 4, share: float = 0.25) -> DataFrame:
    """The kept lines with their block: source, line, docs, of, block (the block's least line).

    Two kept lines belong to one block if at least ``least_docs`` documents and ``share``
    of the source's documents hold them one after the other; empty lines between them
    don't count. Every kept line is in a block, if need be its own.
    """
    kept = boilerplate_lines(docs, source, doc, text, least_docs, share)
    by_source = kept.groupBy("source").agg(F.collect_set("line").alias("lines"), F.first("of").alias("of"))
    pairs = F.array_distinct(
        F.filter(
            F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("forms") - 1)), lambda i: F.struct(F.get("forms", i - 1).alias("a"), F.get("forms", i).alias("b"))),
            lambda p: F.array_contains("lines", p["a"]) & F.array_contains("lines", p["b"]) & (p["a"] != p["b"]),
        )
    )
    follow = _lines(wordings(docs, source, doc, text)).filter(F.size("forms") > 1).join(by_source, "source")
    edges = (
        follow.select("source", "doc", "of", F.explode(pairs).alias("p")).distinct()
        .groupBy("source", "p", "of").agg(F.count("*").alias("n"))
        .filter((F.col("n") >= least_docs) & (F.col("n") >= F.lit(share) * F.col("of")))
        .groupBy("source").agg(F.collect_set("p").alias("edges"))
    )
    graphs = by_source.select("source", "lines").join(edges, "source", "left")
    blocks = graphs.mapInPandas(_block_ids, "source string, line string, block string")
    return kept.join(blocks, ["source", "line"])


def without_boilerplate(docs: DataFrame, source: str, doc: str, text: str, kept: DataFrame) -> DataFrame:
    """``docs`` with the columns ``cleaned`` (the text without its source's kept lines) and ``removed`` (lines taken out).

    ``kept`` has source and line. Lines that stay keep their wording; a null text stays
    null, a text of a null source stays as it is.
    """
    by_source = kept.groupBy("source").agg(F.collect_set("line").alias("__kept"))
    joined = docs.join(by_source.withColumnRenamed("source", "__source"), F.col(source) == F.col("__source"), "left")
    lines = F.split(text, "\n")
    stay = F.filter(lines, lambda x: ~F.array_contains("__kept", line_form(x)))
    cleaned = F.when(F.col("__kept").isNull(), F.col(text)).otherwise(F.array_join(stay, "\n"))
    removed = F.when(F.col(text).isNull() | F.col("__kept").isNull(), 0).otherwise(F.size(lines) - F.size(stay))
    return joined.withColumns({"cleaned": cleaned, "removed": removed.cast("bigint")}).drop("__kept", "__source")


def known_lines(snippets: DataFrame, source: str, snippet: str) -> DataFrame:
    """(source, line): the lines of the snippets known so far, in the form that is compared."""
    form = F.explode(F.transform(F.split(snippet, "\n"), line_form)).alias("line")
    return snippets.select(F.col(source).alias("source"), form).filter("source IS NOT NULL AND line <> ''").distinct()
