"""Boilerplate, look-alikes, tokens, mixtures and encodings against plain code and round trips."""

import random
import re
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from adstrata.llm import boilerplate, encodings, lookalikes, mixture, tokens

FORM = lambda x: re.sub("[0-9]+", "#", re.sub("[ \t\r]+", " ", x)).lower().strip(" ")


def test_boilerplate(spark):
    rnd = random.Random(1)
    foot = ["Zvati  iza 17 h", "(c) Kuca 5", "Hvala"]
    docs = []
    for i in range(12):
        body = ["opis " + chr(97 + i) * rnd.randint(1, 9) for _ in range(3)]
        docs.append(("A", i, "\r\n".join([*body, *foot[: 2 + i % 2], ""]), i))
        docs.append(("A", i, "\n".join([*body, *foot[:2], foot[0].upper()]), i))
        docs.append(("B", i % 3, "isto\nisto", i))
    docs += [("A", 99, None, 1), (None, 5, "isto", 1), ("A", None, "isto", 1), ("C", 1, "", 1)]
    df = spark.createDataFrame(docs, "seller string, doc long, body string, source long")
    held, of = {}, {}
    for s, d, t, _ in docs:
        if None not in (s, d, t):
            of.setdefault(s, set()).add(d)
            for line in {FORM(x) for x in t.split("\n")} - {""}:
                held.setdefault((s, line), set()).add(d)
    want = {k for k, v in held.items() if len(v) >= 4 and len(v) >= 0.25 * len(of[k[0]])}
    kept = boilerplate.boilerplate_blocks(df, "seller", "doc", "body")
    rows = kept.collect()
    assert {(r.source, r.line) for r in rows} == want == {("A", FORM(x)) for x in foot}
    block = {r.line: r.block for r in rows}
    assert block["zvati iza # h"] == block["(c) kuca #"]
    clean = boilerplate.without_boilerplate(df, "seller", "doc", "body", kept.select("source", "line"))
    assert clean.columns == [*df.columns, "cleaned", "removed"]
    for r in clean.collect():
        if r.body is None or r.seller != "A":
            assert r.cleaned == r.body and r.removed == 0
        else:
            stay = [x for x in r.body.split("\n") if ("A", FORM(x)) not in want]
            assert r.cleaned == "\n".join(stay) and r.removed == len(r.body.split("\n")) - len(stay)
    assert boilerplate.boilerplate_blocks(df.limit(0), "seller", "doc", "body").count() == 0


CASES = {
    "Ｓｔａｎ": "Stan", "𝗣𝗥𝗢𝗗": "PROD", "ǉubav": "ljubav", "ﬁn": "fin", "čaša": "čaša", "ku​ća": "kuća", "﻿stan": "stan", "stan 5": "stan 5", "a　b": "a b",
    "сtan": "ctan", "Μjesto": "Mjesto", "Ðurđevac": "Đurđevac", "Стaн": "Стан", "10 m": "10 m",
}
PLAIN = ["čaša 5 m²", "½ … № 5′", "Ελλάς", "Стан у центру", "👨‍👩‍👧 ❤️", "“kuća” – ‘x’", "a ​ b", "", "Straße", "tab\tnl\r\n"]


def test_lookalikes(spark):
    rows = [(i, t, "k") for i, t in enumerate([*CASES, *PLAIN, None])]
    df = spark.createDataFrame(rows, "id int, text string, kinds string")
    found = {r.text: r for r in lookalikes.cases(df).collect()}
    assert set(found) == set(CASES)
    assert {t: r.form for t, r in found.items()} == CASES
    looked = {r.text: r for r in lookalikes.with_looks(df).collect()}
    assert len(looked) == len(rows) and looked[None].skeleton is None
    for t in [*CASES, *PLAIN]:
        assert looked[t].skeleton == lookalikes.skeleton(t) and looked[t].kinds == lookalikes.kinds(t)
    assert lookalikes.cases(df.limit(0)).count() == 0


def test_a_mixed_word_is_a_case_without_a_prototype(spark):
    mixed = ["kлad", "stжn", "sտan", "Ꮙila", "ⲫin", "soбa", "гλ"]
    df = spark.createDataFrame([(t,) for t in [*mixed, "клад", "stan 5"]], "text string")
    assert sorted(r.text for r in lookalikes.cases(df).collect()) == sorted(mixed)


def test_other_alphabets_have_the_skeleton_of_their_looks(spark):
    alike = {"stօn": "ston", "ᎠᎪN": "DAN", "ⲟpⲥ": "opc", "sτan": "stan", "ηova": "nova", "eмa": "ema", "тoк": "tok"}
    for t, plain in alike.items():
        assert lookalikes.skeleton(t) == plain and "mixed" in lookalikes.kinds(t)
        df = spark.createDataFrame([(t,), (plain,)], "text string")
        assert [r.variants for r in lookalikes.groups(df).collect()] == [2]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="abčćđžÐАаеΑο ǆﬁ́̌​­Ａ𝗔5 ²½-", max_size=12), min_size=1, max_size=60))
def test_the_jvm_filter_loses_no_case(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert sorted(r.text for r in lookalikes.cases(df).collect()) == sorted(t for t in texts if lookalikes.kinds(t))
    assert {(r.text, r.skeleton) for r in lookalikes.with_looks(df).collect()} == {(t, lookalikes.skeleton(t)) for t in texts}


def test_no_ordinary_range_holds_a_case():
    for c in [*lookalikes.variants(), *lookalikes.spaces(), *lookalikes.INVISIBLE]:
        assert not any(a <= ord(c) <= b for a, b in lookalikes.ORDINARY)


def test_equal_looks_are_grouped(spark):
    df = spark.createDataFrame([("kuća",), ("kuća",), ("ku​ća",), ("kuća",), ("stan",), (None,)], "text string")
    assert [(r.variants, r.rows, r.form) for r in lookalikes.groups(df).collect()] == [(3, 4, "kuća")]


def library(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_vocabulary())
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_tokens(spark):
    texts = ["", "Prodaje se stan, 65 m² i’m don't <|endoftext|>", "aaaa aaaaaaaaa", "  \n\n x\t ", "стан 近駅 👨‍👩‍👧 �\x80", "dugo " * 20000, "A" * 5000, "x y"]
    df = spark.createDataFrame([*enumerate(texts), (90, None), (91, None), (0, "")], "doc_id long, text string").withColumn("ids", F.lit(1))
    rows = tokens.encoded(df).collect()
    got = {r.doc_id: list(r.ids) for r in rows}
    assert len(rows) == len(texts) + 3 and got[90] == [] and got[91] == []
    assert [got[i] for i in range(len(texts))] == library(texts)
    sizes = {r.doc_id: r.tokens for r in tokens.encoded(df, count_only=True).collect()}
    assert sizes == {k: len(v) for k, v in got.items()}
    assert tokens.encoded(df.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=8))
def test_tokens_of_any_text(texts):
    encoder = tokens.PairIndexEncoder(tokens.read_vocabulary(tokens.default_vocabulary()))
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    assigned = [t for t in texts if all(unicodedata.category(c) != "Cn" for c in t)]
    assert [list(x) for x in encoder.encode(assigned)] == library(assigned)


def mixed(sized, targets):
    """Weighted fair queueing by plain code: (copies by document, tokens by source)."""
    import collections

    rows = {t for t in targets if t[0] is not None}
    share, cap = collections.Counter(), {}
    for s, w, r in rows:
        share[s] += max(w or 0.0, 0.0)
        cap[s] = max(cap.get(s, 0), 1 if r is None else max(r, 0))
    own = collections.defaultdict(list)
    for d, s, n in sized:
        if s in share and n > 0:
            own[s].append((d, n))
    return share, cap, own, sum(n for _, _, n in sized) / 2


@pytest.mark.parametrize("slices", [1, 16])
def test_mixture(spark, slices):
    rnd = random.Random(slices)
    sized = [(i, rnd.choice(["a", "a", "a", "b", "c", None, "x"]), rnd.choice([0, 5, 20, 300])) for i in range(400)]
    targets = [("a", 0.2, 1), ("b", 0.5, 3), ("b", 0.5, 3), ("c", 0.2, None), ("d", 0.3, 1), ("e", 0.0, None), (None, 0.1, 1)]
    s = spark.createDataFrame([(*x, 1) for x in sized], "doc_id long, source string, tokens long, share int")
    t = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    out = mixture.mixture(s, t, slices, sort_rows=3)
    got = {r.doc_id: r for r in out.collect()}
    share, cap, own, budget = mixed(sized, targets)
    assert all(1 <= r.copies <= cap[r.source] and r.tokens > 0 for r in got.values())
    total = sum(r.copies * r.tokens for r in got.values())
    assert budget - 300 < total <= budget
    # replay: the order of finish times, source by source
    queue = {(r.doc_id): r for r in mixture.queued(s, t, slices).collect()}
    for src in "abc":
        upto = sorted(q.upto for q in queue.values() if q.source == src)
        sums = sorted(n for _, n in own[src])
        assert upto[-1] == sum(sums) and len(upto) == len(sums)
    copies = sorted(((k * q.whole + q.upto) / q.weight, q.source, q.doc_id) for q in queue.values() for k in range(q.repeats))
    taken, want = 0, {}
    for _, _, d in copies:
        if taken + queue[d].tokens > budget:
            break
        taken += queue[d].tokens
        want[d] = want.get(d, 0) + 1
    assert {d: r.copies for d, r in got.items()} == want
    report = {r.source: r for r in mixture.shares(out, s, t).collect()}
    assert report["b"].target_share == pytest.approx(0.5 / 0.9) and report["d"].target_share is None and report["d"].tokens == 0
    assert sum(r.share for r in report.values()) == pytest.approx(1)
    assert mixture.mixture(s.limit(0), t).count() == 0 and mixture.mixture(s, t.limit(0)).count() == 0


CHAINS = [("utf-8", "cp1252"), ("utf-8", "cp1250"), ("utf-8", "mac_roman"), ("utf-8", "cp437"), ("cp1250", "latin-1"), ("cp852", "cp1250")]


def test_encodings_restore_what_they_find(spark):
    rnd = random.Random(3)
    words = "čiste vlasničke knjige žbuka u hodniku čeka popravak ključ ima susjed kuća površine više već plaćena šišmiša Žabište mogućnost đak lođa pričuva mjesečna".split()
    clean, garbled = {}, {}
    for i in range(600):
        clean[i] = " ".join(rnd.choice(words) for _ in range(25)) + "."
    for i, (true, wrong) in enumerate(CHAINS * 8):
        t = " ".join(rnd.choice([w for w in words if not w.isascii()]) for _ in range(12))
        good = t.encode(true)
        try:
            garbled[1000 + i] = (good.decode(wrong), t)
        except UnicodeDecodeError:
            continue
    italian = {2000 + i: "La qualità è buona, perciò il prezzo più alto. È a 400 m dal centro" for i in range(30)}
    other = {3000: None, 3001: "", 3002: "plain", 3003: "Það er æskilegt að hringja", 3004: "ÅRSAVGIFT PÅ GÅNG, Åtta minuter från ån", 3005: "cijena 5 � i klju�", 3006: "近駅 マンション", 3007: "Сјајна РАСПОРЕД ПОЉЕ Ђурђевац", 3008: "5\x80 u 1990"}
    texts = clean | {k: v[0] for k, v in garbled.items()} | italian | other
    rows = [(k, t, "s" if k % 3 else None, "w") for k, t in texts.items()]
    df = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string, source string, word string")
    found = {r.doc_id for r in encodings.garbled_documents(df).collect()}
    assert found == set(garbled) | {3005, 3008}
    fixed = {r.doc_id: r.repaired for r in encodings.repaired(df).collect()}
    assert {k: fixed[k] for k in garbled} == {k: v[1] for k, v in garbled.items()}
    assert fixed[3005].endswith("ključ")
    assert encodings.garbled_documents(df.limit(0)).count() == 0
