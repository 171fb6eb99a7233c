"""Upserts, JSON and HTML records, streams."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from adstrata.sources import html_pages, json_records, stores
from adstrata.streaming import ingest


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols or df.columns) for r in df.collect())


def test_upsert(spark):
    old = spark.createDataFrame([(1, "s", "a", "u1", 5), (2, "s", "b", "u2", 5)], "id int, source string, source_id string, url string, seen int")
    new = spark.createDataFrame([("s", "a", "v1", 7), ("s", "a", "v2", 9), ("s", "c", "w", 3), (None, "d", "n", 1), (None, "d", "n", 1)], "source string, source_id string, url string, seen int")
    got = stores.upserted(old, new, ["source", "source_id"], {"seen": "greatest(old.seen, new.seen)", "url": F.col("new.url")}, ["seen"])
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted([(1, "s", "a", "v2", 9), (2, "s", "b", "u2", 5), (None, "s", "c", "w", 3), (None, None, "d", "n", 1), (None, None, "d", "n", 1)], key=key)


def test_insert_ignore_replace_and_absent(spark):
    old = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    new = spark.createDataFrame([(1, "x"), (1, "z"), (1, "z"), (3, "w")], "k int, v string")
    assert rows(stores.unseen(old, new, ["k", "v"])) == [(1, "z"), (3, "w")]
    assert rows(stores.replaced(old, new, "k")) == [(1, "x"), (1, "z"), (2, "y"), (3, "w")]
    ads = spark.createDataFrame([("s", 1), ("s", 2), ("t", 3)], "source string, id int")
    assert rows(stores.absent(ads, spark.createDataFrame([("s", 1)], "source string, id int"), ["source", "id"], "source")) == [("s", 2)]
    assert rows(stores.absent(ads, ads.limit(0), ["source", "id"], "source")) == []
    many = spark.createDataFrame([(1, ["b", "a", "b", None])], "k int, items array<string>")
    assert rows(stores.positions(many, "k", "items"), "item", "position") == [("a", 1), ("b", 0)]


def test_changed_counts_a_return(spark):
    old = spark.createDataFrame([(1, 1, 10.0)], "k int, t int, p double")
    new = spark.createDataFrame([(1, 2, 10.0), (1, 3, 11.0), (1, 4, 10.0), (2, 1, None), (2, 2, None)], "k int, t int, p double")
    assert [(r.k, r.t) for r in stores.changed(old, new, "k", ["p"], ["t"]).orderBy("k", "t").collect()] == [(1, 3), (1, 4), (2, 1)]


def test_versions(spark, tmp_path):
    store = stores.Versioned(spark, str(tmp_path / "t"))
    assert store.read() is None
    store.write(spark.range(3))
    store.write(spark.range(5))
    assert store.read().count() == 5
    store.write(spark.range(7))
    assert store.read().count() == 7 and len(list((tmp_path / "t").glob("v-*"))) == 2
    grown = stores.Growing(spark, str(tmp_path / "g"))
    assert grown.read() is None and grown.batches() == []
    for batch, n in ((0, 3), (1, 5), (1, 2)):
        grown.put(spark.range(n), batch)
    assert grown.read().count() == 5 and grown.read(below=1).count() == 3
    (tmp_path / "g" / "batch=1" / "_SUCCESS").unlink()
    assert grown.batches() == [0]


def test_json_records(spark, tmp_path):
    spec = json_records.RecordSpec(
        fields={"source_id": "id", "title": "a.t", "price_eur": "p", "location_parts": "loc", "images": "im.0", "seller_is_company": "co"},
        image_url="i/{value}", detail_url="d/{source_id}/{title}", min_plausible_price=10.0, max_images=1,
    )
    records = ['{"id":1,"a":{"t":"x"},"p":"12,5","loc":["H","","Z"],"im":[["q","r"]],"co":true}', '{"id":2,"p":1}', "{}", None]
    got = json_records.mapped(spark.createDataFrame([(r,) for r in records], "r string"), "r", spec).collect()
    assert got[0].asDict() == {"source_id": "1", "title": "x", "price_eur": 12.5, "location_raw": "H, Z", "location_specific": "Z", "images": ["i/q"], "seller_type": "agency", "price_placeholder": False, "url": "d/1/x"}
    assert (got[1].price_eur, got[1].price_placeholder, got[1].images, got[1].url) == (None, True, [], "d/2/")
    assert got[2].source_id is None and got[3].price_placeholder is False
    with pytest.raises(ValueError):
        json_records.RecordSpec(fields={})
    (tmp_path / "p1.json").write_text('{"data": [{"id": 1}, {"id": 2}], "next": 2}')
    (tmp_path / "p2.json").write_text('{"data": [], "next": -1}')
    assert json_records.landed_pages(spark, str(tmp_path)).count() == 2
    pages = spark.read.text(str(tmp_path), wholetext=True).select(json_records.last_page(F.col("value"), next_path="next").alias("a"), json_records.last_page(F.col("value")).alias("b"))
    assert rows(pages) == [(False, False), (True, True)]
    (tmp_path / "p3.json").write_text('{"data": {"id": 1}}')
    with pytest.raises(Exception, match="no list"):
        json_records.landed_pages(spark, str(tmp_path)).count()


PAGE = """<html><head><title>no</title><style>x</style></head><body><h1 class="t big">A &amp; B</h1><div id=d><p>one</p><p class=x>two words<br>more</p></div>
<ul><li>Rooms:</li><li>3</li><li>Area: 65,5 m2</li></ul><a class=card href="/ad/7?x=1" data-id=q>go</a><a class=card href="u/8/">go</a><a class=card>none</a><img src=a.png><img src=b.png><script>s()</script></body></html>"""


def test_html(spark):
    S = html_pages.FieldSpec
    specs = {
        "title": S("h1.t"), "longest": S("#d p", longest=True), "first": S("p.x", first_line=True), "rooms": S(label="Rooms"), "area": S(label="area", regex=r"[\d,]+"), "none": S("h2"),
        "kind": S(one_of=(("h2", "bad"), ("div p", "good"))), "images": S("img", attr="src", multiple=1), "link": S("a[data-id=q]", attr="href"), "cut": S("h1", regex="(Z)"),
    }
    df = spark.createDataFrame([(PAGE,), (None,), ("",)], "h string")
    a, b, c = df.select(html_pages.fields(F.col("h"), specs).alias("f")).select("f.*").collect()
    assert a.asDict() == {"title": "A & B", "longest": "two wordsmore", "first": "two words", "rooms": "3", "area": "65,5", "none": None, "kind": "good", "images": ["a.png"], "link": "/ad/7?x=1", "cut": None}
    assert set(b.asDict().values()) == {None} and c.images == []
    got = df.select(html_pages.links(F.col("h"), "a.card", base="https://e.x", id_attr="data-id").alias("l"), html_pages.visible_text(F.col("h")).alias("v")).collect()
    assert [(x.source_id, x.url) for x in got[0].l] == [("q", "https://e.x/ad/7?x=1"), ("8", "https://e.x/u/8/")]
    assert got[0].v == "A & B one two words more Rooms: 3 Area: 65,5 m2 go go none" and got[1].v is None and got[2].v == ""


def test_stream_appends_each_content_once(spark, tmp_path):
    schema = "listing_id long, content_hash string, captured_at timestamp"
    at = dt.datetime(2024, 1, 1)
    landing = str(tmp_path / "in")
    store = stores.Growing(spark, str(tmp_path / "out"))
    put = lambda data: spark.createDataFrame(data, schema).write.mode("append").parquet(landing)
    put([(1, "a", at), (1, "a", at), (2, "b", at)])
    struct = spark.createDataFrame([], schema).schema
    run = lambda: ingest.appended(ingest.landing(spark, landing, struct), store, str(tmp_path / "cp")).awaitTermination()
    run()
    put([(1, "a", at), (3, "c", at)])
    run()
    assert rows(store.read(), "listing_id", "content_hash") == [(1, "a"), (2, "b"), (3, "c")]
    stream = ingest.once_per_content(ingest.landing(spark, landing, struct))
    q = stream.writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("once").count() == 3
    days = ingest.counts_per_day(ingest.landing(spark, landing, struct))
    assert days.isStreaming and days.columns == ["day", "snapshots"]
    q = ingest.folded(ingest.landing(spark, landing, struct), lambda b: None, str(tmp_path / "cp3"))
    q.awaitTermination()
