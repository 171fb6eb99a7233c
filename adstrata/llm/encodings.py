"""Garbled text from wrong character encodings: found and repaired by expectation-maximization.

A word of a record was either written as it stands or went through a chain of
encodings: encoded in one, decoded in another, once or several times. Chains are
latent. A source (with its field) has a share of words for each chain; a word read
back through a chain is as likely as the form it gives is common in clean text.

The E step gives every word the posterior of each chain from the chain's share in the
sources that hold the word and from how often the repaired and the given form stand in
clean text. The M step pools the posteriors into the shares again, over different words
(a word that a third of the records repeat counts once) and without the word in question
itself, so a chain that only one word speaks for has no support, and weak evidence in
many records adds up. Sound clean counts come out of the same posteriors. Records are
then judged and repaired by the posteriors of their words.

Characters that hardly a correct text of this kind holds (C1 controls, U+FFFD) are evidence:
a word with one is unlikely as it stands, and besides the chains that restore it, it may
have gone through one that lost characters; that chain is latent like the others, with
shares of its own. Where it is the likeliest, the commonest clean word that fits around
the losses is put in. Chains deeper than LAYERS of UTF-8 aren't tried; such a word is
still found if one of its outer layers can be peeled.

Scale: one JVM pass over the texts finds the words with characters beyond ASCII; the
rounds work on the vocabulary of those, by joins and combining aggregates. Nothing but
the shares per source and chain, whose number is bounded by sources times chains, is ever
small by design, and nothing is collected.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from adstrata.plans.scratch import drop, observed, written, written_counted

# The encodings that chains are made of.
ENCODINGS = ["cp1252", "cp1250", "iso8859_2", "cp437", "cp852", "cp850", "mac_roman", "mac_latin2", "cp1251", "koi8_r", "cp866", "iso8859_5"]
LAYERS = 4
LOST = "lost"
# Fixed value: ASCII signs and digits, as a character class.
AROUND = r"!-@\[-`{-~"
_BEYOND = re.compile(r"[^\x00-\x7f]+")
_HARD = re.compile("[\x80-\x9f�]")


@cache
def _decoding(name: str) -> list[str]:
    """The characters of the 256 bytes; a byte without one stands for the control character of its number."""
    out = []
    for b in range(256):
        try:
            out.append(bytes([b]).decode(name))
        except UnicodeDecodeError:
            out.append(chr(b))
    return out


@cache
def _encoding(name: str) -> dict[str, int]:
    """The byte of each character beyond ASCII; C1 controls pass through, and cp1252 also reads as Latin-1."""
    table = {c: b for b, c in enumerate(_decoding(name)) if b > 127}
    for b in range(128, 256 if name == "cp1252" else 160):
        table.setdefault(chr(b), b)
    return table


@cache
def _swaps() -> list[tuple[str, dict[int, str], frozenset[str]]]:
    """For each pair of single-byte encodings: its name, what to read each character as, and the characters it knows."""
    return [
        (f"{true}>{wrong}", {ord(c): _decoding(true)[b] for c, b in _encoding(wrong).items()}, frozenset(_encoding(wrong)))
        for true in ENCODINGS for wrong in ENCODINGS if true != wrong
    ]


def _peeled(word: str) -> Iterator[tuple[str, str]]:
    """(encoding, form): the word read as UTF-8 that was decoded in each single-byte encoding, where all of it can be."""
    for name in ENCODINGS:
        table = _encoding(name)
        try:
            yield name, _BEYOND.sub(lambda m, t=table: bytes(t[c] for c in m.group()).decode("utf-8"), word)
        except (KeyError, UnicodeDecodeError):
            continue


def _sound(form: str) -> bool:
    """Whether all characters beyond ASCII are letters, marks, numbers, signs or the no-break space."""
    return all(unicodedata.category(c)[0] in "LMNPS" or c in "\xa0­‍" for c in form if c > "\x7f") and not _HARD.search(form)


def candidates(word: str) -> list[tuple[str, str, float, bool]]:
    """(chain, form, bonus, only UTF-8) of every chain that explains ``word``, up to LAYERS of UTF-8 and one swap of single bytes.

    The bonus is the logarithm of how unlikely it is that a word chances to be well-formed UTF-8.
    """
    layers, edge = {word: ""}, {word: ""}
    for _ in range(LAYERS):
        deeper = {}
        for form, chain in edge.items():
            for name, peeled in _peeled(form):
                if peeled not in layers and peeled not in deeper:
                    deeper[peeled] = f"{chain}utf8>{name} "
        layers |= deeper
        edge = {f: c for f, c in deeper.items() if not f.isascii()}
    beyond = sum(c > "\x7f" for c in word)
    out, seen = [], set(layers)
    for form, chain in layers.items():
        bonus = min(12.0, 3.0 * max(1, beyond - sum(c > "\x7f" for c in form))) if chain else 0.0
        if chain and _sound(form):
            out.append((chain.strip(), form, bonus, True))
        need = {c for c in form if c > "\x7f"}
        for name, table, known in _swaps():
            if need and need <= known:
                swapped = form.translate(table)
                if swapped not in seen and _sound(swapped):
                    seen.add(swapped)
                    out.append((f"{chain}{name}", swapped, bonus, False))
    return out


def _explain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for at in range(0, len(batch), 500):
            rows = [(w, *c) for w in batch["word"].iloc[at : at + 500] for c in candidates(w)]
            yield pd.DataFrame(rows, columns=["word", "chain", "form", "bonus", "utf8"])


def odd_words(docs: DataFrame, doc_id: str, source: str, text: str) -> DataFrame:
    """(doc_id, source, word): the different words of each text that have a character beyond ASCII, without ASCII signs and digits around them."""
    found = F.regexp_extract_all(text, F.lit(r"[^ \t\r\n]*[^\x00-\x7f \t\r\n][^ \t\r\n]*"), F.lit(0))
    bare = F.transform(found, lambda w: F.regexp_replace(w, f"^[{AROUND}]+|[{AROUND}]+$", ""))
    words = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(source, F.lit("")).alias("source"), F.explode(F.array_distinct(bare)).alias("word"))
    return words.filter("word <> ''")


def _hard(word: Column) -> Column:
    return word.rlike(r"[\x{80}-\x{9f}\x{fffd}]")


def judged_words(words: DataFrame, tolerance: float = 0.01, most_rounds: int = 50, words_a_task: int = 2000) -> DataFrame:
    """(word, garbled, form) of every garbled word: its posterior, and its likeliest repaired form (null where none is known).

    ``words``: source, word; one row per record and word. Rounds end when no posterior moves
    by ``tolerance`` any more; ``most_rounds`` without an end are an error.
    """
    held = written(words.groupBy("source", "word").agg(F.count("*").alias("n")), "held")
    count, n_words = written_counted(held.groupBy("word").agg(F.sum("n").alias("n")).withColumn("hard", _hard(F.col("word"))), "count")
    # by number of words, not by bytes: a word costs thousands of trials
    explained = count.select("word").repartition(max(1, -(-n_words // words_a_task))).mapInPandas(_explain, "word string, chain string, form string, bonus double, utf8 boolean")
    forms = count.select(F.col("word").alias("form"), F.col("n").alias("n_form"))
    # A form that no record holds only counts where it comes from well-formed UTF-8.
    known = explained.join(forms, "form", "left").filter("n_form IS NOT NULL OR utf8").join(count, "word")
    known = known_written = written(known.withColumn("n_form", F.coalesce("n_form", F.lit(0))), "known")
    # ... and if all its characters are ones that the corpus holds.
    characters = lambda c: F.explode(F.array_distinct(F.split(F.regexp_replace(c, r"[\x00-\x7f]", ""), ""))).alias("c")
    alphabet = count.filter(~F.col("hard")).select(characters(F.col("word"))).distinct()
    strange = known.filter("n_form = 0").select("form").distinct().select("form", characters(F.col("form"))).join(alphabet, "c", "left_anti").select("form").distinct()
    lost = count.filter("hard").select("word", F.lit(LOST).alias("chain"), F.lit(None).cast("string").alias("form"), F.lit(1.0).alias("bonus"), F.lit(True).alias("utf8"), F.lit(0).cast("bigint").alias("n_form"), "n", "hard")
    known = known.join(strange, "form", "left_anti").unionByName(lost)
    size = held.groupBy("source").agg(F.count("*").alias("size"))
    sized = written(held.withColumnRenamed("n", "n_here").join(size, "source"), "sized")
    likely = (F.col("bonus") > 0) | ((F.col("n_form") >= 20 * F.col("n")) & (F.col("n_form") >= 5))
    first = known.groupBy("word", "n", "hard").agg(F.max(likely).alias("likely"))
    p = F.when(F.col("hard"), 0.99).when(F.col("likely"), 0.9).otherwise(0.0)
    guess = known.join(first.select("word", p.alias("p")), "word").withColumn(
        "weight", (F.col("n_form") + F.col("utf8").cast("int")) * F.exp("bonus")
    )
    all_of = F.sum("weight").over(W.partitionBy("word"))
    post = written(guess.withColumn("q", F.coalesce(F.col("p") * F.col("weight") / F.nullif(all_of, F.lit(0.0)), F.lit(0.0))).select(*known.columns, "q"), "post")
    for _ in range(most_rounds):
        clean = post.groupBy("word").agg(F.greatest(F.lit(0.0), 1 - F.sum("q")).alias("is_clean"))
        of_form = clean.select(F.col("word").alias("form"), F.col("is_clean").alias("form_clean"))
        # tables of the vocabulary grow with the data: they meet by merging, and the driver holds none of them
        by_source = held.join(post.filter("q > 0").select("word", "chain", "q").hint("merge"), "word").groupBy("source", "chain").agg(F.sum("q").alias("of_source"))
        by_chain = post.groupBy("chain").agg(F.sum("q").alias("of_chain"))
        share = (F.greatest(F.lit(0.0), F.coalesce("of_source", F.lit(0.0)) - F.col("q")) + 5 * F.greatest(F.lit(0.0), F.col("of_chain") - F.col("q")) / F.lit(max(1, n_words))) / (F.col("size") + 5)
        spread = (
            sized.join(post.select("word", "chain", "q", "n").hint("merge"), "word")
            .join(by_source, ["source", "chain"], "left").join(by_chain, "chain")
        )
        prior = spread.groupBy("word", "chain").agg(F.sum(share * F.col("n_here") / F.col("n")).alias("prior"))
        scored = post.withColumnRenamed("q", "was").join(prior.hint("merge"), ["word", "chain"]).join(clean.hint("merge"), "word").join(of_form.hint("merge"), "form", "left")
        floor = F.when(F.col("utf8"), 1e-4).otherwise(1e-9)
        x = F.greatest("prior", floor) * (F.col("n_form") * F.coalesce("form_clean", F.lit(1.0)) + F.col("utf8").cast("int")) * F.exp("bonus")
        null = (F.col("n") * F.col("is_clean") + 0.5) * F.when(F.col("hard"), 1e-6).otherwise(1.0)
        scored = scored.withColumn("x", x)
        q = F.col("x") / (F.sum("x").over(W.partitionBy("word")) + null)
        move = Observation()
        after = written(scored.withColumn("q", q).observe(move, F.max(F.abs(F.col("q") - F.col("was"))).alias("most")).select(*post.columns), "post")
        drop(post)
        post = after
        if (observed(move).get("most") or 0.0) < tolerance:
            break
    else:
        raise RuntimeError(f"posteriors still move after {most_rounds} rounds")
    read = F.when(F.col("chain") != LOST, F.col("q"))
    best = post.groupBy("word").agg(F.sum("q").alias("garbled"), F.coalesce(F.sum(read), F.lit(0.0)).alias("read"), F.max_by("form", F.when(read.isNotNull(), F.struct(read.alias("q"), "form"))).alias("form"))
    gap = lambda w: F.regexp_replace(w, r"[^\x00-\x7f]", "�")
    fitting = (
        count.filter(~F.col("hard")).join(best.filter("garbled > 0.5").select("word"), "word", "left_anti")
        .groupBy(gap(F.col("word")).alias("gaps")).agg(F.max_by("word", F.struct("n", "word")).alias("fits"))
    )
    lost = count.filter(F.col("word").contains("�")).select("word", gap(F.col("word")).alias("gaps")).join(fitting, "gaps").select("word", "fits")
    bad = best.filter("garbled > 0.5").join(lost, "word", "left")
    out = written(bad.select("word", "garbled", F.coalesce(F.when(F.col("read") > 0.5, F.col("form")), "fits").alias("form")), "bad")
    drop(held, count, known_written, sized, post)
    return out


def garbled_documents(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """(doc_id, words): the garbled documents with their garbled words, an array of (word, form, garbled).

    Null, empty and ASCII texts are never garbled; a null source is a source of its own;
    rows that repeat a document's id count as one document. No rows give an empty table.
    """
    words = written(odd_words(docs, doc_id, source, text), "words")
    bad = judged_words(words)
    hit = words.join(bad, "word")
    return hit.groupBy("doc_id").agg(F.collect_set(F.struct("word", "form", "garbled")).alias("words"))


def _replaced(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    token = re.compile(r"[^ \t\r\n]+")
    strip = "".join(chr(c) for c in range(33, 127) if not chr(c).isalpha())
    for texts, words in batches:
        out = []
        for text, bad in zip(texts, words, strict=True):
            form = {b["word"]: b["form"] for b in bad if b["form"] is not None}

            def whole(m: re.Match, form: dict = form) -> str:
                bare = m.group().strip(strip)
                return m.group().replace(bare, form[bare], 1) if bare in form else m.group()

            out.append(token.sub(whole, text))
        yield pd.Series(out)


def repaired(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """(doc_id, repaired, unresolved) of each garbled document: its text with every garbled word in its likeliest form, and how many words have none."""
    found = garbled_documents(docs, doc_id, source, text)
    joined = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).filter("text IS NOT NULL").join(found, "doc_id")
    left = F.size(F.filter("words", lambda w: w["form"].isNull())).cast("bigint")
    return joined.select("doc_id", F.pandas_udf(_replaced, "string")("text", "words").alias("repaired"), left.alias("unresolved"))
