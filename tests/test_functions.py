"""Text, number and hash functions against plain Python and pinned values."""

import string
import unicodedata
from urllib.parse import quote
from zlib import crc32

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from adstrata.functions import hashes, numbers, text, urls


def one(spark, kind, value, *columns):
    row = spark.createDataFrame([(value,)], f"x {kind}").select(*[c(F.col("x")).alias(str(i)) for i, c in enumerate(columns)]).first()
    return row[0] if len(columns) == 1 else list(row)


def many(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}").select("i", f(F.col("x")).alias("y")).orderBy("i").collect()
    return [r.y for r in rows]


def test_fold(spark):
    given_ = ["Trešnjevka", "  ĐURĐEVAC  Straße ", None, "", "Ｓｔａｎ", "čaj", "Ελλάς"]
    assert many(spark, given_, text.fold) == ["tresnjevka", "durdevac strasse", "", "", "stan", "caj", "ελλας"]
    assert many(spark, given_, text.fold_exact) == ["tresnjevka", "durdevac strasse", "", "", "stan", "caj", "ελλας"]


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=string.ascii_letters + " čćžšđČĆŽŠĐßäöüéèñ\t\n,.-", max_size=30), min_size=1, max_size=40))
def test_fold_agrees_with_exact(spark, texts):
    assert many(spark, texts, text.fold) == many(spark, texts, text.fold_exact)


def test_places_and_words(spark):
    assert many(spark, ["Hrvatska, Zagreb, Trešnjevka", "Croatia", "", None, "Split,"], text.location_key) == ["tresnjevka", None, None, None, "split"]
    assert one(spark, "string", "Veliki STAN, vrt 2", text.words) == ["veliki", "stan", "vrt", "2"]
    assert many(spark, ["vrt i garaža", "vrt", None], lambda c: text.has_words(text.words(c), "GARAZA vrt")) == [True, False, False]
    assert many(spark, ["Žabište Donje", "zab", None], lambda c: text.like_folded(c, "zab%don")) == [True, False, None]


def test_numbers(spark):
    assert many(spark, ["65,50 m²", "65.5 m2", "1.250,50", "none", None], numbers.parse_area) == [65.5, 65.5, 1.25, None, None]
    assert many(spark, ["drugi kat", "2", "prizemlje", "visoko prizemlje", "potkrovlje", "-1. kat", "?", None, ""], numbers.parse_floor) == ["2", "2", "0", "0", "attic", "-1", None, None, None]
    assert many(spark, ["091/234-5678", "+385 91 234 5678", "12", "", None], numbers.normalize_phone) == ["385912345678", "385912345678", None, None, None]
    assert many(spark, ["189.500,50 €", "x", None], numbers.grouped_number) == [189500.5, None, None]
    assert many(spark, ["189,500.50"], lambda c: numbers.grouped_number(c, "point")) == [189500.5]
    assert many(spark, [64.3, 65.0, 65.02, None], numbers.is_precise, "double") == [True, False, False, False]
    assert many(spark, ["1,5", "", "x", None], numbers.lenient_number) == [1.5, None, None, None]


def shingle_set(t):
    return [] if not t else [t] if len(t) < 5 else list(dict.fromkeys(t[i : i + 5] for i in range(len(t) - 4)))


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab čž😀", max_size=20), min_size=1, max_size=20))
def test_shingles_and_minhash(spark, texts):
    assert many(spark, texts, text.shingles) == [shingle_set(t) for t in texts]
    masks = [crc32(f"adstrata-{i}".encode()) for i in range(64)]
    want = [[min(crc32(s.encode()) ^ m for s in shingle_set(t)) for m in masks] if t else [] for t in texts]
    got = many(spark, texts, lambda c: text.minhash(text.shingles(c)))
    assert got == want
    bands = many(spark, texts, lambda c: text.text_bands(text.minhash(text.shingles(c))))
    assert bands == [[f"{o}:{'-'.join(map(str, s[o : o + 4]))}" for o in range(0, 64, 4)] if s else [] for s in want]


def test_snippets(spark):
    df = spark.createDataFrame([("a FOO  b FOO BAR c", ["FOO", "FOO BAR", ""]), ("x", None), (None, ["y"])], "t string, s array<string>")
    assert [r[0] for r in df.select(text.without_snippets(F.col("t"), F.col("s"))).collect()] == ["a b c", "x", ""]


def test_perceptual_hashes(spark):
    df = spark.createDataFrame([("ff00aa11bb22cc33", "ff00aa11bb22cc32"), ("", None)], "a string, b string")
    rows = df.select(hashes.bits_of_hex(F.col("a")).alias("x"), hashes.bits_of_hex(F.col("b")).alias("y"))
    got = rows.select(hashes.hash_distance(F.col("x"), F.col("y")).alias("d"), hashes.hash_bands(F.col("x")).alias("b")).collect()
    assert got[0].d == 1 and got[0].b == ["0:cc33", "1:bb22", "2:aa11", "3:ff00"] and got[1].d is None
    m = spark.createDataFrame([([1, 2, 255], [3, 0]), ([1], []), (None, [1])], "a array<long>, b array<long>")
    # 1 takes the first of b, 2 the second, 255 has none left
    assert [r[0] for r in m.select(hashes.count_matches(F.col("a"), F.col("b"))).collect()] == [2, 0, 0]


def test_content_hash_tells_null_from_empty(spark):
    df = spark.createDataFrame([("a", None), ("a", ""), (None, None)], "x string, y string").select(hashes.content_hash(["y", "x"]).alias("h"))
    assert df.distinct().count() == 3


JSON = "https://x.example/s?q=%7B%22page%22%3A1%2C%22to%22%3A%225%22%7D&z=1"


@pytest.mark.parametrize("args, want", [
    (("https://x.example/s?a=1&page=9", 1), "https://x.example/s?a=1&page=9"),
    (("https://x.example/s?a=1&page=9", 3), "https://x.example/s?a=1&page=3"),
    (("https://x.example/s?page=1&a=x", 4), "https://x.example/s?page=4&a=x"),
    (("https://x.example/s?mypage=1#f", 4), "https://x.example/s?mypage=1&page=4#f"),
    (("https://x.example/s/", 3, "path_suffix", "page", 0), "https://x.example/s/2"),
    ((JSON, 2, "json_param", "q"), "https://x.example/s?q=%7B%22page%22%3A2%2C%22to%22%3A%225%22%7D&z=1"),
    (("https://x.example/s?q=nojson", 2, "json_param", "q"), "https://x.example/s?q=nojson"),
    (("https://x.example/s", 2, "json_param", "q"), "https://x.example/s"),
    (("https://x.example/s", 2, "next_link"), "https://x.example/s"),
])
def test_page_urls(spark, args, want):
    url, page, *how = args
    options = dict(zip(("mode", "param", "start_at"), how))
    df = spark.createDataFrame([(url, page), (None, page), (url, None)], "u string, p int")
    assert [r[0] for r in df.select(urls.page_urls(F.col("u"), F.col("p"), **options)).collect()] == [want, None, None]


def test_page_urls_of_json_encoded_twice(spark):
    packed = quote(quote('{"b":[1,"x y+z"],"page":1,"a":{"page":7},"f":false}', safe=""), safe="")
    df = spark.createDataFrame([(f"https://x.example/s?z=1&q={packed}#top",), ("https://x.example/s?q=%7B%",)], "u string")
    good, bad = [r[0] for r in df.select(urls.page_urls(F.col("u"), F.lit(4), "json_param", "q", double_encoded=True)).collect()]
    assert good == "https://x.example/s?z=1&q=" + quote(quote('{"b":[1,"x y+z"],"page":4,"a":{"page":7},"f":false}', safe=""), safe="") + "#top"
    assert bad == "https://x.example/s?q=%7B%"


def test_request_urls(spark):
    df = spark.createDataFrame([("a b", 2), (None, 1)], "t string, p int")
    made = urls.request_urls("https://x.example/api", {"text": F.col("t"), "on": F.lit(True), "page": "9"}, F.col("p"), start_at=0)
    assert [r[0] for r in df.select(made).collect()] == ["https://x.example/api?text=a+b&on=true&page=1", "https://x.example/api?on=true&page=0"]


def test_unaccent_keeps_case_and_compatibility_forms():
    given_, plain = text._bases(False)
    assert len(given_) == len(plain) and "Ｓ" not in given_ and unicodedata.normalize("NFD", "Č")[0] == plain[given_.index("Č")]


def test_fold_marks_keeps_letters_of_their_own(spark):
    df = spark.createDataFrame([("ĐAČKI  Straße\u00a0Ａ",), (None,), ("đ",)], "t string")
    assert [r[0] for r in df.select(text.fold_marks(F.col("t"))).collect()] == ["đacki straße a", "", "đ"]
