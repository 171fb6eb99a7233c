"""The pairs of listings that share a key, found and compared where the block is, so that no pair is ever shuffled.

A pair row carries what both sides are compared by; shuffled once per pair, it takes disk with
the square of a block. Here the listings travel instead: one row for each block a listing is
in, a large block in parts that meet pairwise in cells. A pair that shares several keys comes
out of the first of them alone: a row knows the blocks its listing has before this one (larger
blocks come first), and a pair that has one of those in common is left to it. Keys with the
same members are one block. Comparing a pair is arithmetic over numbered values in numpy;
``matching.scored`` says the same of pairs that are given.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adstrata.functions.hashes import NEAR
from adstrata.functions.text import SHINGLE

LEFT, RIGHT, TWICE = 1, 2, 4
ROWS, PAIRS = 1000, 1 << 19  # rows gathered before small cells are worked on; pairs compared at a time
FREQUENT = 24  # texts with a shingle, from which on it is counted by a product of matrices
WORDS, FOUND = 1 << 18, 1 << 22  # words of bits compared, and rare shingles counted, at a time


def cells(keyed: DataFrame, touched: DataFrame | None = None, block: int = 1000) -> DataFrame:
    """A row of ``keyed`` (listing_id, keys: array of distinct key hashes, …) for each cell its listing is in: its columns, block, cell, side and earlier.

    A block is the least key of those with the same two or more members, known by their number
    and two 64-bit sums of their hashed ids; cells of a block are of at most about ``block``
    rows a side. ``side``: LEFT and RIGHT rows of a cell meet; of two rows that are both TWICE
    only the lower id is taken as the left one. With ``touched`` (listing_id) only its
    listings are LEFT, and blocks without one of them are left out.
    """
    each = keyed.select("listing_id", F.explode("keys").alias("key"))
    asked = F.lit(0)
    if touched is not None:
        keyed = keyed.join(touched.select("listing_id").filter("listing_id IS NOT NULL").distinct().withColumn("asked", F.lit(1)), "listing_id", "left").withColumn("asked", F.coalesce("asked", F.lit(0)))
        each = keyed.select("listing_id", F.explode("keys").alias("key"), "asked")
        asked = F.col("asked")
    members = [F.bit_xor(F.xxhash64("listing_id")).alias("x"), F.bit_xor(F.xxhash64(F.lit("y"), "listing_id")).alias("y")]
    shared = each.groupBy("key").agg(F.count("*").alias("size"), F.sum(asked).alias("asked"), *members).filter("size > 1" if touched is None else "size > 1 AND asked > 0")
    blocks = shared.groupBy("size", "asked", "x", "y").agg(F.min("key").alias("key")).select("key", "size", F.col("asked").alias("of"))
    of = each.select("listing_id", "key").join(blocks, "key").groupBy("listing_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("order"), "key", "of"))).alias("blocks"))
    rows = keyed.drop("keys").join(of, "listing_id")
    rows = rows.select(*[c for c in rows.columns if c != "blocks"], F.transform("blocks", lambda b: b["key"]).alias("all"), F.posexplode("blocks").alias("at", "b"))
    parts = F.ceil(-F.col("b.order") / block).cast("int")
    rows = rows.withColumns({"earlier": F.slice("all", 1, F.col("at")), "parts": parts, "part": F.pmod(F.xxhash64("listing_id"), parts).cast("int")})
    cell = lambda low, high, side: F.struct((low * F.col("parts") + high).cast("int").alias("cell"), side.cast("int").alias("side"))
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    part = F.col("part")
    if touched is None:
        side = lambda p: F.when(p == part, LEFT | RIGHT | TWICE).when(part < p, LEFT).otherwise(RIGHT)
        meets = F.transform(upto(F.col("parts")), lambda p: cell(F.least(part, p), F.greatest(part, p), side(p)))
    else:
        lefts = F.ceil(F.col("b.of") / block).cast("int")
        own = F.pmod(F.xxhash64("listing_id"), lefts).cast("int")
        twice = F.when(F.col("asked") == 1, TWICE).otherwise(0)
        left = F.transform(upto(F.col("parts")), lambda p: cell(own, p, F.lit(LEFT | TWICE)))
        meets = F.concat(F.when(F.col("asked") == 1, left).otherwise(F.filter(left, lambda x: F.lit(False))), F.transform(upto(lefts), lambda p: cell(p, part, twice + RIGHT)))
    kept = [c for c in keyed.columns if c not in ("keys", "asked")]
    return rows.select(*kept, F.col("b.key").alias("block"), "earlier", F.inline(meets)).repartition("block", "cell").sortWithinPartitions("block", "cell")


def compared(rows: DataFrame, weights: dict[str, int], columns: Sequence[str], merges_only: bool = False) -> DataFrame:
    """The pairs (a, b) of the cells with the ``columns`` asked for of the evidence, and points; with ``merges_only`` only those that merge."""
    types = {
        "location_conflict": "boolean", "img_match_count": "int", "area_precise": "boolean", "near": "double", "floor_conflict": "boolean", "phone_match": "boolean",
        "text_jaccard": "double", "price_gap": "double", "exact_trio": "boolean", "same_seller": "boolean", "points": "int", "choice": "tinyint",
    }
    names = [c for c in types if c in columns]
    schema = "a bigint, b bigint" + "".join(f", {c} {types[c]}" for c in names)
    arrow = {"boolean": pa.bool_(), "int": pa.int32(), "double": pa.float64(), "tinyint": pa.int8()}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_cells(batches):
            for found in _pairs(_Rows(rows), weights, "text_jaccard" in names, merges_only):
                got = [pa.array(found[c]) for c in ("a", "b")]
                for c in names:
                    # a value that is not known is masked, not NaN
                    v, mask = found[c] if isinstance(found[c], tuple) else (found[c], None)
                    got.append(pa.array(v, type=arrow[types[c]], mask=mask))
                yield pa.RecordBatch.from_arrays(got, names=["a", "b", *names])

    return rows.mapInArrow(run, schema)


def _whole_cells(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The sorted rows in tables of whole cells: large cells alone, small ones together."""
    held: list[pa.RecordBatch] = []
    last, rows = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        block, cell = (batch.column(c).to_numpy() for c in ("block", "cell"))
        cuts = np.flatnonzero((block[1:] != block[:-1]) | (cell[1:] != cell[:-1])) + 1
        if last is not None and last != (block[0], cell[0]):
            cuts = np.concatenate([[0], cuts])
        begin = 0
        for k, cut in enumerate(cuts):
            ahead = (cuts[k + 1] if k + 1 < len(cuts) else batch.num_rows) - cut
            if rows + cut - begin and (rows + cut - begin + ahead > ROWS):
                yield pa.Table.from_batches([*held, batch.slice(begin, cut - begin)])
                held, rows, begin = [], 0, cut
        held.append(batch.slice(begin))
        rows += batch.num_rows - begin
        last = (block[-1], cell[-1])
    if held:
        yield pa.Table.from_batches(held)


class _Rows:
    """The rows of some cells as arrays, texts (those with codes) by number."""

    def __init__(self, t: pa.Table) -> None:
        whole = lambda c: t.column(c).combine_chunks()
        flat = lambda c: c.chunk(0) if isinstance(c, pa.ChunkedArray) else c

        def number(c: str, empty: bool) -> np.ndarray:
            coded = flat(whole(c)).dictionary_encode()
            codes = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int32)
            blank = coded.dictionary.index("").as_py() if not empty and len(coded.dictionary) else -1
            return np.where(codes == blank, -1, codes) if blank >= 0 else codes

        def double(c: str) -> tuple[np.ndarray, np.ndarray]:
            col = flat(whole(c))
            return col.fill_null(0.0).to_numpy(zero_copy_only=False), col.is_valid().to_numpy(zero_copy_only=False)

        self.id = flat(whole("listing_id")).to_numpy()
        self.side = flat(whole("side")).to_numpy()
        block, cell = (flat(whole(c)).to_numpy() for c in ("block", "cell"))
        self.cell = np.concatenate([[0], np.cumsum((block[1:] != block[:-1]) | (cell[1:] != cell[:-1]))])
        self.loc, self.seller = number("loc", False), number("seller_name", False)
        self.floor, self.phone = number("floor", True), number("phone", True)
        self.price, self.area, self.rooms = double("price_eur"), double("area_m2"), double("rooms")
        self.agency, self.precise = (flat(whole(c)).to_numpy(zero_copy_only=False) for c in ("agency", "precise"))
        texts = flat(whole("text")).dictionary_encode()
        self.text, self.texts = texts.indices.to_numpy(), texts.dictionary
        self.earlier = _lists(flat(whole("earlier")))
        places, bits = _lists(flat(whole("bits")))
        n = np.bincount(places, minlength=len(self.id))
        self.bits, self.has = np.zeros((len(self.id), max(1, n.max())), np.int64), np.arange(max(1, n.max())) < n[:, None]
        self.bits[self.has] = bits


def _lists(c: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) of the elements of a list column; nulls have none."""
    places, values = pc.list_parent_indices(c), pc.list_flatten(c)
    known = values.is_valid()
    return places.filter(known).to_numpy().astype(np.int64), values.filter(known).to_numpy()


def _products(left: np.ndarray, left_of: np.ndarray, right: np.ndarray, right_of: np.ndarray, groups: int, at_once: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) of the members of left and right with the same group, about ``at_once`` at a time."""
    order = np.argsort(right_of, kind="stable")
    right = right[order]
    size = np.bincount(right_of, minlength=groups)
    begin = np.cumsum(size) - size
    n = size[left_of]
    ends = np.cumsum(n)
    at = 0
    while at < len(left):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + at_once, "right")))
        m = n[at:to]
        base = np.cumsum(m) - m
        place = np.arange(m.sum()) + np.repeat(begin[left_of[at:to]] - base, m)
        yield np.repeat(left[at:to], m), right[place]
        at = to


def _met_before(r: _Rows) -> np.ndarray:
    """The sorted codes (row * rows + row) of the left and right rows of a cell that have an earlier block in common."""
    row, key = r.earlier
    n = len(r.id)
    if not len(row):
        return np.empty(0, np.int64)
    code = pd.factorize(key)[0].astype(np.int64)
    group = pd.factorize(r.cell[row] * (code.max() + 1) + code)[0]
    side = r.side[row]
    a, b = (side & LEFT) > 0, (side & RIGHT) > 0
    found = [np.unique(i * n + j) for i, j in _products(row[a], group[a], row[b], group[b], int(group.max()) + 1, PAIRS * 4)]
    return np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)


def _pairs(r: _Rows, w: dict[str, int], jaccard: bool, merges_only: bool) -> Iterator[dict]:
    n = len(r.id)
    before = _met_before(r)
    rows = np.arange(n)
    a, b = (r.side & LEFT) > 0, (r.side & RIGHT) > 0
    likeness = _Likeness(r.texts)
    for i, j in _products(rows[a], r.cell[a], rows[b], r.cell[b], int(r.cell[-1]) + 1, PAIRS):
        keep = np.where((r.side[i] & r.side[j] & TWICE) > 0, r.id[i] < r.id[j], r.id[i] != r.id[j])
        i, j = i[keep], j[keep]
        if len(before):
            code = i * n + j
            place = np.minimum(np.searchsorted(before, code), len(before) - 1)
            keep = before[place] != code
            i, j = i[keep], j[keep]
        if len(i):
            found = _evidence(r, i, j, w, likeness, merges_only)
            if len(found["a"]):
                yield found


def _evidence(r: _Rows, i: np.ndarray, j: np.ndarray, w: dict[str, int], likeness: _Likeness, merges_only: bool) -> dict:
    """As ``matching.scored``. A comparison with NaN goes as in Spark, where it equals itself and is more than any number."""
    same = lambda c: (c[i] == c[j]) & (c[i] >= 0)
    known = lambda c: (c[i] >= 0) & (c[j] >= 0)
    conflict = known(r.loc) & (r.loc[i] != r.loc[j])
    if merges_only:
        keep = ~conflict
        i, j, conflict = i[keep], j[keep], conflict[keep]
    both = lambda c: c[1][i] & c[1][j]

    def gap(c: tuple[np.ndarray, np.ndarray], off: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return off / np.maximum(c[0][i], c[0][j])

    has_area, has_price, has_rooms = both(r.area), both(r.price), both(r.rooms)
    with np.errstate(invalid="ignore"):
        near, price_off = np.abs(r.area[0][i] - r.area[0][j]), np.abs(r.price[0][i] - r.price[0][j])
    area_gap, price_gap = gap(r.area, near), gap(r.price, price_off)
    x, y = r.rooms[0][i], r.rooms[0][j]
    rooms_same = has_rooms & ((x == y) | (np.isnan(x) & np.isnan(y)))
    precise = r.precise[i] & r.precise[j]
    floor_same, phone, seller, loc_same = same(r.floor), same(r.phone), same(r.seller), same(r.loc)
    floor_off = known(r.floor) & ~floor_same
    price_exact, area_close = has_price & (price_gap <= 0.002), has_area & (area_gap <= 0.02)
    trio = price_exact & area_close & rooms_same & loc_same & ~floor_off
    images = _image_matches(r, i, j)
    exact = has_area & (near <= 0.15)
    points = np.select([images >= 2, images == 1], [w["images_two"], w["images_one"]], 0)
    points += np.select([exact & precise, exact, area_close, has_area & ~(area_gap <= 0.06)], [w["area_exact"], w["area_exact_round"], w["area_close"], w["area_off"]], 0)
    points += floor_off * w["floor_off"] + floor_same * w["floor_same"] + (phone & ~(r.agency[i] & r.agency[j])) * w["phone"]
    points += np.select([price_exact, has_price & (price_gap <= 0.03)], [w["price_exact"], w["price_close"]], 0)
    points += trio * w["trio"] + rooms_same * w["rooms_same"] + (has_rooms & ~rooms_same) * w["rooms_off"] + seller * w["seller"]
    found = {
        "i": i, "j": j, "location_conflict": conflict, "img_match_count": images, "area_precise": precise, "near": near, "no_area": ~has_area, "floor_conflict": floor_off,
        "phone_match": phone, "price_gap": price_gap, "no_price": ~has_price, "exact_trio": trio, "same_seller": seller, "points": points,
    }
    if merges_only:  # no text can lift the others
        keep = points + max(w["text_near"], w["text_close"], 0) >= w["merge_at"]
        found = {c: v[keep] for c, v in found.items()}
    common, either = likeness(r.text[found["i"]], r.text[found["j"]])
    likely = common / np.maximum(either, 1)
    found["points"] = found["points"] + np.select([likely >= 0.8, likely >= 0.5], [w["text_near"], w["text_close"]], 0)
    # of fractions the third place is rounded half up exactly
    found["text_jaccard"] = ((2000 * common + either) // np.maximum(2 * either, 1)) / 1000
    found["choice"] = np.where(found["location_conflict"], 0, np.select([found["points"] >= w["merge_at"], found["points"] >= w["review_at"]], [2, 1], 0)).astype(np.int8)
    if merges_only:
        keep = found["choice"] == 2
        found = {c: v[keep] for c, v in found.items()}
    x, y = r.id[found["i"]], r.id[found["j"]]
    return found | {"a": np.minimum(x, y), "b": np.maximum(x, y), "near": (found["near"], found["no_area"]), "price_gap": (found["price_gap"], found["no_price"])}


def _image_matches(r: _Rows, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """As ``hashes.count_matches``: the hashes of the lower id take, in order, the first close one of the other that is free."""
    low = r.id[i] < r.id[j]
    x, y = np.where(low, i, j), np.where(low, j, i)
    count = np.zeros(len(i), np.int32)
    some = np.flatnonzero(r.has[x, 0] & r.has[y, 0])
    if not len(some):
        return count
    x, y = x[some], y[some]
    free, got = r.has[y], np.zeros(len(some), np.int32)
    for k in range(r.bits.shape[1]):
        close = free & r.has[x, k][:, None] & (np.bitwise_count((r.bits[x, k][:, None] ^ r.bits[y]).view(np.uint64)) <= NEAR)
        hit = close.any(1)
        free[hit, close[hit].argmax(1)] = False
        got += hit
    count[some] = got
    return count


class _Likeness:
    """Shared and all shingles of two texts out of a list of folded texts."""

    def __init__(self, texts: pa.Array) -> None:
        self.texts, self.bits = texts, None

    def _number(self) -> None:
        texts = self.texts.to_pylist()
        count = len(texts)
        length = np.array([len(t) for t in texts], np.int64)
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        of, code = np.empty(0, np.int64), np.empty(0, np.int64)
        if len(points) >= SHINGLE:
            seen = np.zeros(int(points.max()) + 1, bool)
            seen[points] = True
            letter = (np.cumsum(seen) - 1)[points]
            letters = int(seen.sum())
            run, kinds = letter, letters
            for k in range(1, SHINGLE):  # numbered anew where the next letter wouldn't fit
                if kinds * letters >= 1 << 62:
                    run, names = pd.factorize(run)
                    kinds = len(names)
                run, kinds = run[:-1].astype(np.int64) * letters + letter[k:], kinds * letters
            text = np.repeat(np.arange(count), length)
            whole = text[: len(run)] == text[SHINGLE - 1 :]
            of, code = text[: len(run)][whole], run[whole]
        short = np.flatnonzero((length > 0) & (length < SHINGLE))  # one shingle each, which no other text has
        of, code = np.concatenate([of, short]), np.concatenate([code, -1 - short])
        number, names = pd.factorize(code)
        once = pd.unique(of * max(1, len(names)) + number)
        of, number = once // max(1, len(names)), once % max(1, len(names))
        self.size = np.bincount(of, minlength=count)
        texts_with = np.bincount(number, minlength=len(names))
        shared = texts_with[number] > 1
        self.of, self.number, self.texts_with = of[shared], number[shared], texts_with
        self.bits = False

    def _packed(self) -> None:
        kinds, column = np.unique(self.number, return_inverse=True)
        flags = np.zeros((len(self.size), -(-max(1, len(kinds)) // 64) * 64), bool)
        flags[self.of, column] = True
        self.bits = np.packbits(flags, axis=1).view(np.uint64)

    def _table(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """How many shingles each of the texts ``left`` shares with each of ``right``."""
        many = self.texts_with[self.number] >= FREQUENT
        kinds, column = np.unique(self.number[many], return_inverse=True)
        common = np.zeros((len(left), len(right)), np.float32)
        places = []
        for texts in (left, right):
            p = np.full(len(self.size), -1)
            p[texts] = np.arange(len(texts))
            places.append(p[self.of])
        for begin in range(0, len(kinds), 4096):
            width = min(4096, len(kinds) - begin)
            both = []
            for p, texts in zip(places, (left, right), strict=True):
                m = np.zeros((len(texts), width), np.float32)
                row = p[many]
                here = (row >= 0) & (column >= begin) & (column < begin + width)
                m[row[here], column[here] - begin] = 1
                both.append(m)
            common += both[0] @ both[1].T
        common = common.astype(np.int64)
        few = ~many
        x, y = few & (places[0] >= 0), few & (places[1] >= 0)
        for i, j in _products(places[0][x], self.number[x], places[1][y], self.number[y], len(self.texts_with), FOUND):
            common += np.bincount(i * len(right) + j, minlength=common.size).reshape(common.shape)
        return common

    def __call__(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(shared, all) for the texts numbered x and y; (0, 0) if either is empty."""
        if not len(x):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        if self.bits is None:
            self._number()
        left, right = pd.unique(x), pd.unique(y)
        if len(x) > 4096 and 4 * len(x) > len(left) * len(right):
            at_left, at_right = np.zeros(len(self.size), np.int64), np.zeros(len(self.size), np.int64)
            at_left[left], at_right[right] = np.arange(len(left)), np.arange(len(right))
            common = self._table(left, right)[at_left[x], at_right[y]]
        else:
            if self.bits is False:
                self._packed()
            step = max(1, WORDS // self.bits.shape[1])
            common = np.concatenate([np.bitwise_count(self.bits[x[k : k + step]] & self.bits[y[k : k + step]]).sum(1, dtype=np.int64) for k in range(0, len(x), step)])
        alike = x == y  # a text's own shingles that no other has aren't counted above
        common = np.where(alike, self.size[x], common)
        either = np.where((self.size[x] == 0) | (self.size[y] == 0), 0, self.size[x] + self.size[y] - common)
        return common, either
