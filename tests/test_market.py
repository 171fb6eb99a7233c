"""Current state, drops, search and ended ads on hand-made tables: ties, nulls, empty tables."""

import datetime as dt

from adstrata.operators import current, ended, search

T = [dt.datetime(2024, 1, d) for d in range(1, 29)]
OBS = "id long, listing_id long, captured_at timestamp, title string, description string, price_eur decimal(12,2), area_m2 decimal(8,2), rooms decimal(4,1), floor string, floor_num int, location_raw string, location_norm string, seller_type string, seller_name string, seller_phone string, content_hash string"
ADS = "id long, source string, source_id string, url string, category string, cluster_id long, first_seen timestamp, last_seen timestamp, active boolean, removed_at timestamp, status string, status_reason string"


def obs(spark, rows):
    from decimal import Decimal

    full = [(i, l, t, title, "tekst", None if p is None else Decimal(p), None if a is None else Decimal(a), None, None, None, loc, None, None, None, None, None) for i, l, t, title, p, a, loc in rows]
    return spark.createDataFrame(full, OBS)


def ads(spark, rows):
    return spark.createDataFrame([(i, "s", str(i), f"u{i}", None, c, f, l, act, rem, st, None) for i, c, f, l, act, rem, st in rows], ADS)


def test_latest_breaks_ties_by_id(spark):
    o = obs(spark, [(1, 7, T[0], "a", 1, 1, "x"), (3, 7, T[1], "c", 1, 1, "x"), (2, 7, T[1], "b", 1, 1, "x"), (4, None, T[2], "n", 1, 1, "x")])
    assert [(r.listing_id, r.title) for r in current.current_state(o).collect()] == [(7, "c")]


def test_drops(spark):
    o = obs(spark, [(1, 1, T[0], "a", 100, 10, "x"), (2, 2, T[5], "b", 90, 0, "x"), (3, 3, T[0], "c", 0, 1, "x"), (4, 3, T[1], "c", 5, 1, "x"), (5, 4, T[0], "d", 100, 1, "x"), (6, 4, T[1], "d", 99, 1, "x")])
    l = ads(spark, [(1, 50, T[0], T[9], False, None, "gone"), (2, 50, T[5], T[8], True, None, "active"), (2, 50, T[5], T[8], True, None, "active"), (3, 60, T[0], T[1], True, None, "active"), (4, 70, T[0], T[1], True, None, "active")])  # noqa: E741
    got = current.price_drops(l, o, "2024-02-01", days=90).collect()
    # a first price of 0 has no percentage; a fall of 1 % is too small
    assert [(r.cluster_id, float(r.change_pct), r.listing_id, r.listing_count, len(r.price_history)) for r in got] == [(50, -10.0, 2, 2, 2)]
    assert current.price_drops(l, o, "2024-02-01", days=90, max_price=50).count() == 0
    assert current.price_drops(l.limit(0), o.limit(0), "2024-02-01").count() == 0
    again = current.repost_points(current.cluster_price_history(l, o)).filter("cluster_id = 50 AND reposted").collect()
    assert [r.listing_id for r in again] == [2]


def test_search_collapses_counts_and_sorts(spark):
    o = obs(spark, [(1, 1, T[0], "Vrt", 300, 10, "Žabište"), (2, 2, T[0], "vrt", 200, 10, "X"), (3, 3, T[0], "kuća", None, None, None), (4, 4, T[0], "vrt", 0, 5, "zabiste")])
    l = ads(spark, [(1, 9, T[3], T[9], True, None, "active"), (2, 9, T[1], T[9], True, None, "active"), (3, None, T[2], T[9], True, None, "active"), (4, None, None, T[9], False, None, "gone")])  # noqa: E741
    page = lambda **k: [(r.listing_id, r.duplicate_count) for r in search.search(l, o, search.Search(**k)).collect()]
    assert page() == [(3, 1), (2, 2)]
    assert page(sort="price_asc", active_only=False) == [(2, 2), (3, 1), (4, 1)]
    assert page(min_price=250) == [(1, 1)]  # counted over what matches
    assert page(q="VRT", active_only=False, sort="relevance", collapse_duplicates=False) == [(1, 2), (2, 2), (4, 1)]
    assert page(location="zab", active_only=False) == [(1, 1), (4, 1)]
    assert page(page_size=1, page=2) == [(2, 2)]
    hidden = spark.createDataFrame([("c9",)], "group_key string")
    assert [r.listing_id for r in search.search(l, o, search.Search(), hidden).collect()] == [3]
    view = search.listing_view(l, o)
    rows = {(1, 9, 2), (2, 9, 2), (3, None, 1), (4, None, 1)}
    assert {tuple(r) for r in search.cluster_siblings(view).collect()} == rows
    asked = spark.createDataFrame([(2,), (4,), (None,)], "listing_id long")
    assert {tuple(r) for r in search.cluster_siblings(view, asked).collect()} == rows - {(3, None, 1)}


def test_ended(spark):
    o = obs(spark, [(1, 1, T[0], "a", 100, 10, "x"), (2, 1, T[4], "a", 80, 10, "x"), (3, 2, T[0], "b", 300, 10, "x"), (4, 3, T[0], "c", None, 10, None)])
    l = ads(spark, [(1, 9, T[0], T[5], False, T[7], "gone"), (2, 9, T[0], T[5], True, None, "active"), (3, None, T[3], T[1], False, None, "gone")])  # noqa: E741
    got = {r.listing_id: r for r in ended.ended_listings(l, o).collect()}
    assert (float(got[1].price_change_pct), got[1].days_listed, got[1].median_price_per_m2, float(got[1].vs_area_median_pct), got[1].still_listed_elsewhere) == (-20.0, 7.0, 19.0, -57.9, True)
    assert (got[3].price_change_pct, got[3].days_listed, got[3].vs_area_median_pct, got[3].still_listed_elsewhere) == (None, 0.0, None, False)
    assert [r.listing_id for r in ended.ended_feed(ended.ended_listings(l, o), "2024-02-01").collect()] == [3]
    assert [r.listing_id for r in ended.ended_feed(ended.ended_listings(l, o), "2024-02-01", hide_still_listed=False, sort="biggest_drop").collect()] == [1, 3]
