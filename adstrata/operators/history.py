"""History of changing attributes: a bitemporal ledger built by a sweep over valid time.

A snapshot says what an entity's attributes were at one moment (valid time) and
arrived at some point of the record (recorded time). The ledger holds one row per
version and period of belief: ``valid_from`` .. ``valid_to`` is the period the
version held, ``recorded_from`` .. ``recorded_to`` the epochs of the record in
which that was the best knowledge. A late snapshot splits the interval it falls
into; the row it supersedes keeps its values and only gets a ``recorded_to``. An
epoch may be a load or, as for listings, the arrival of a single row: a new point
changes at most the row of the version before it, its own and that of the point after
it, so there are at most three rows for each point, whatever the number of epochs.

Scale: an entity may hold a third of all rows, so its valid time is cut into slices of
``slice_us``, and a slice is what a task keeps in memory; points come to it by a
sort, in order of arrival. Two things cross slices, and both are sent on as changes
alone: the state a slice begins with (only from changes that a later slice lives to
see) and the first version after it. They are found by a pass over an entity's changes in
order of arrival that keeps a row per slice. So no step holds an entity's points, and
what one task streams of it is its slices and its late changes.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from adstrata.plans.scratch import written

DAY_US = 86_400_000_000
OPEN = -1

_LEDGER = ["entity", "valid_from", "valid_to", "state", "recorded_from", "recorded_to"]


def _points(snapshots: DataFrame) -> DataFrame:
    """(entity, at, state): what is known at each moment, the highest ``seq`` winning; combined map-side."""
    return snapshots.groupBy("entity", "at").agg(F.max_by("state", "seq").alias("state"))


def _starts(points: DataFrame, slice_us: int) -> DataFrame:
    """The points at which a version begins: the first, and each whose state differs from the one before."""
    p = points.withColumn("slice", F.floor(F.col("at") / F.lit(slice_us)))
    inside = W.partitionBy("entity", "slice").orderBy("at")
    p = p.withColumn("n", F.row_number().over(inside)).withColumn("before", F.lag("state").over(inside))
    edges = p.groupBy("entity", "slice").agg(F.max_by("state", "at").alias("last"))
    previous = edges.select(
        "entity", "slice",
        F.lag("last").over(W.partitionBy("entity").orderBy("slice")).alias("carried"),
        F.lag(F.lit(True)).over(W.partitionBy("entity").orderBy("slice")).alias("has_carried"),
    )
    joined = p.join(previous, ["entity", "slice"])
    first = F.col("n") == 1
    prev = F.when(first, F.col("carried")).otherwise(F.col("before"))
    begins = (first & F.col("has_carried").isNull()) | ~F.col("state").eqNullSafe(prev)
    return joined.filter(begins).select("entity", "slice", "at", "state")


def _periods(starts: DataFrame) -> DataFrame:
    """Add ``valid_to``: the start of the entity's next version, or OPEN."""
    inside = W.partitionBy("entity", "slice").orderBy("at")
    s = starts.withColumn("next", F.lead("at").over(inside))
    edges = s.groupBy("entity", "slice").agg(F.min("at").alias("first"))
    after = edges.select(
        "entity", "slice", F.lead("first").over(W.partitionBy("entity").orderBy("slice")).alias("carried")
    )
    return s.join(after, ["entity", "slice"]).select(
        "entity", F.col("at").alias("valid_from"), F.coalesce("next", "carried", F.lit(OPEN)).alias("valid_to"), "state"
    )


def _in_groups(df: DataFrame, key: list[str], order: list[str], step: Callable[[Iterator[tuple]], Iterator[tuple]], out: list[str]) -> DataFrame:
    """``df`` by ``key`` and in ``order`` through ``step``, which takes the other columns of a group's rows and gives those of ``out``.

    Columns keep their type, new ones are 64-bit integers. A task streams its groups; a state is a tuple.
    """
    kinds, names, width = dict(df.dtypes), [*key, *[c for c in df.columns if c not in key]], len(key)
    schema = ", ".join(f"{c} {kinds.get(c, 'bigint')}" for c in [*key, *out])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types: dict = {}

        def rows() -> Iterator[tuple]:
            for b in batches:
                types.update((f.name, f.type) for f in b.schema)
                yield from zip(*[list(zip(*[x.to_pylist() for x in c.flatten()])) if n == "state" else c.to_pylist() for n, c in zip(names, b.columns)])

        def column(name: str, values: tuple) -> pa.Array:
            kind = types.get(name, pa.int64())
            if name != "state":
                return pa.array(values, kind)
            return pa.StructArray.from_arrays([pa.array(v, kind.field(i).type) for i, v in enumerate(zip(*values))], fields=[kind.field(i) for i in range(kind.num_fields)])

        def batch(made: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([column(n, v) for n, v in zip([*key, *out], zip(*made))], names=[*key, *out])

        made: list[tuple] = []
        for k, group in groupby(rows(), lambda r: r[:width]):
            for m in step(r[width:] for r in group):
                made.append((*k, *m))
                if len(made) == 10_000:
                    yield batch(made)
                    made = []
        if made:
            yield batch(made)

    return df.select(*names).repartition(*key).sortWithinPartitions(*key, *order).mapInArrow(run, schema)


def _carried(rows: Iterable[tuple]) -> Iterator[tuple]:
    """(slice, epoch, state): the state each slice of an entity begins with, whenever it changes, from the last states (slice, epoch, state) in order of epoch."""
    last: dict = {}
    order: list = []
    given: dict = {}
    for epoch, group in groupby(rows, lambda r: r[1]):
        hit = set()
        for j, _, state in group:
            if j not in last:
                insort(order, j)
            last[j] = state
            hit.add(j)
        after = {order[i] for i in (bisect_right(order, j) for j in hit) if i < len(order)}
        for k in sorted(hit | after):
            i = bisect_left(order, k)
            if i and given.get(k) != last[order[i - 1]]:
                given[k] = last[order[i - 1]]
                yield k, epoch, given[k]


def _following(rows: Iterable[tuple]) -> Iterator[tuple]:
    """(slice, epoch, next): the first version after each slice of an entity, whenever it changes, from the slices' first versions (slice, epoch, first or null) in order of epoch."""
    first: dict = {}
    order: list = []
    given: dict = {}
    for epoch, group in groupby(rows, lambda r: r[1]):
        hit = set()
        for j, _, at in group:
            hit.add(j)
            if at is None:
                if first.pop(j, None) is not None:
                    order.remove(j)
            else:
                if j not in first:
                    insort(order, j)
                first[j] = at
        before = {order[i - 1] for i in (bisect_left(order, j) for j in hit) if i}
        for k in sorted(before | (hit & first.keys())):
            i = bisect_right(order, k)
            now = first[order[i]] if i < len(order) else OPEN
            if given.get(k) != now:
                given[k] = now
                yield k, epoch, now


def swept(rows: Iterable[tuple]) -> Iterator[tuple]:
    """What one slice gives, from its ``rows`` (epoch, is_point, seq, at, state) in order of epoch, changes of the carried state before points.

    (1, valid_from, valid_to, state, recorded_from, recorded_to) is a ledger row, with
    OPEN for a version that outlasts the slice or the record; (0, first, null, null,
    epoch, null) says which version of the slice is the first one from an epoch on.
    """
    points: list = []
    starts: list = []
    known: dict = {}  # at: (seq, state)
    live: dict = {}  # start: (valid_to, state, recorded_from)
    carried = first = None

    def settle(k: int) -> None:
        """Let point ``k`` begin a version or not."""
        t = points[k]
        begins = known[t][1] != (known[points[k - 1]][1] if k else carried)
        j = bisect_left(starts, t)
        if begins != (j < len(starts) and starts[j] == t):
            if begins:
                starts.insert(j, t)
            else:
                del starts[j]

    for epoch, group in groupby(rows, lambda r: r[0]):
        touched: set = set()
        for _, is_point, seq, at, state in group:
            if not is_point:
                carried = state
                changed = range(min(1, len(points)))
            else:
                if at in known and (seq < known[at][0] or known[at][1] == state):
                    known[at] = (max(seq, known[at][0]), known[at][1])
                    continue
                if at not in known:
                    insort(points, at)
                known[at] = (seq, state)
                i, s = bisect_left(points, at), bisect_left(starts, at)
                if s:
                    touched.add(starts[s - 1])
                changed = range(i, min(i + 2, len(points)))
            for k in changed:
                touched.add(points[k])
                settle(k)
        for t in touched:
            j = bisect_right(starts, t)
            now = (starts[j] if j < len(starts) else OPEN, known[t][1]) if j and starts[j - 1] == t else None
            was = live.get(t)
            if was and was[:2] == now:
                continue
            if was:
                yield 1, t, *was, epoch
                del live[t]
            if now:
                live[t] = (*now, epoch)
        if first != (starts[0] if starts else None):
            first = starts[0] if starts else None
            yield 0, first, None, (None,) * len(state), epoch, None
    for t, row in live.items():
        yield 1, t, *row, OPEN


def bitemporal_ledger(snapshots: DataFrame, entity: str, at: str, seq: str, state: Sequence[str | Column], epoch: Column, slice_us: int = DAY_US) -> DataFrame:
    """The ledger of ``snapshots``: entity, valid_from, valid_to, state, recorded_from, recorded_to.

    ``at``: valid time in microseconds; ``seq``: order of arrival; ``epoch``: a number that
    says when a row was recorded, of any range, ``seq`` itself for instance. A row with
    ``recorded_to`` = -1 is current; one with ``valid_to`` = -1 is open; ``recorded_to`` of
    others is the epoch that superseded them.

    Nulls: rows without entity, time, order or epoch are left out; null attribute values are
    values. Ties: of several snapshots at one moment the highest ``seq`` counts;
    repeated rows add nothing. An empty table gives an empty ledger.
    """
    number = lambda c, name: c.cast("bigint").alias(name)
    points = snapshots.select(
        F.col(entity).alias("entity"), number(F.floor(F.col(at) / slice_us), "slice"), number(epoch, "epoch"), number(F.col(seq), "seq"), number(F.col(at), "at"), F.struct(*state).alias("state")
    ).filter("entity IS NOT NULL AND at IS NOT NULL AND seq IS NOT NULL AND epoch IS NOT NULL")
    points = written(points, "points")
    # The last state of each slice, whenever it changes and until it changes again.
    arrival = W.partitionBy("entity", "slice").orderBy("epoch", "seq")
    place = F.struct("at", "seq")
    lasts = points.withColumn("most", F.max(place).over(arrival.rowsBetween(W.unboundedPreceding, -1))).filter(F.col("most").isNull() | (place > F.col("most")))
    lasts = lasts.withColumn("until", F.lead("epoch").over(arrival)).filter("until IS NULL OR until > epoch")
    opened = lasts.groupBy("entity", "slice").agg(F.min("epoch").alias("opened"))
    later = W.partitionBy("entity").orderBy("slice").rowsBetween(1, W.unboundedFollowing)
    seen_by = opened.select("entity", "slice", "opened", F.min("opened").over(later).alias("seen_from"))
    useful = lasts.join(seen_by, ["entity", "slice"]).filter("epoch = opened OR (seen_from IS NOT NULL AND (until IS NULL OR until > seen_from))")
    carried = _in_groups(useful.select("entity", "slice", "epoch", "state"), ["entity"], ["epoch", "slice"], _carried, ["slice", "epoch", "state"])
    none = F.lit(None).cast("bigint")
    given = carried.select("entity", "slice", "epoch", F.lit(0).cast("bigint").alias("is_point"), none.alias("seq"), none.alias("at"), "state")
    rows = points.select("entity", "slice", "epoch", F.lit(1).cast("bigint").alias("is_point"), "seq", "at", "state").unionByName(given)
    local = written(_in_groups(rows, ["entity", "slice"], ["epoch", "is_point", "seq"], swept, ["is_row", "valid_from", "valid_to", "state", "recorded_from", "recorded_to"]), "local")
    firsts = local.filter("is_row = 0").select("entity", "slice", F.col("recorded_from").alias("epoch"), F.col("valid_from").alias("at"))
    following = _in_groups(firsts, ["entity"], ["epoch", "slice"], _following, ["slice", "epoch", "at"])
    closed = local.filter(F.expr("is_row = 1") & (F.col("valid_to") != OPEN))
    return closed.select(*_LEDGER).unionByName(_ended(local.filter(F.expr("is_row = 1") & (F.col("valid_to") == OPEN)), following))


def _ended(lasting: DataFrame, following: DataFrame) -> DataFrame:
    """The rows that outlast their slice, cut where what follows the slice changes: both are steps over the epochs."""
    row = F.struct("valid_from", "state", "recorded_to").alias("row")
    steps = lasting.select("entity", "slice", F.col("recorded_from").alias("epoch"), row, F.lit(None).cast("bigint").alias("next"))
    changes = following.select("entity", "slice", "epoch", F.lit(None).cast(steps.schema["row"].dataType).alias("row"), F.col("at").alias("next"))
    at = W.partitionBy("entity", "slice").orderBy("epoch")
    both = steps.unionByName(changes).groupBy("entity", "slice", "epoch").agg(F.any_value("row", True).alias("row"), F.any_value("next", True).alias("next"))
    both = both.select("entity", "epoch", F.last("row", True).over(at).alias("row"), F.last("next", True).over(at).alias("valid_to"), F.lead("epoch").over(at).alias("after"))
    ends = F.col("row.recorded_to")
    to = F.when(ends == OPEN, F.coalesce("after", F.lit(OPEN))).otherwise(F.least("after", ends))
    held = both.filter(F.col("row").isNotNull() & ((ends == OPEN) | (ends > F.col("epoch"))))
    return held.select("entity", "row.valid_from", "valid_to", "row.state", F.col("epoch").alias("recorded_from"), to.alias("recorded_to"))


def extend_ledger(ledger: DataFrame, log: DataFrame, updates: DataFrame, epoch: int, slice_us: int = DAY_US) -> DataFrame:
    """``ledger`` after one more epoch of ``updates``, touching only the entities they name.

    ``log`` and ``updates`` have the columns entity, at, seq, state; ``log`` is what
    was recorded before. Rows that no longer hold get ``recorded_to`` = ``epoch``,
    rows that now hold are appended; no row is overwritten or lost.
    """
    touched = updates.select("entity").distinct()
    seen = log.join(touched, "entity", "left_semi").select("entity", "at", "seq", "state").unionByName(
        updates.select("entity", "at", "seq", "state")
    )
    now = _periods(_starts(_points(seen), slice_us)).select(
        "entity", "valid_from", "valid_to", "state", F.lit(True).alias("holds")
    )
    marked = ledger.join(touched.withColumn("is_touched", F.lit(True)), "entity", "left")
    live = F.col("recorded_to") == OPEN
    current = marked.filter(live & F.col("is_touched").isNotNull()).drop("is_touched")
    rest = marked.filter(~(live & F.col("is_touched").isNotNull())).select(*_LEDGER)
    keys = ["entity", "valid_from", "valid_to", "state"]
    same = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) if k == "state" else F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys]
    both = current.alias("o").join(now.alias("n"), same[0] & same[1] & same[2] & same[3], "full_outer")
    pick = [F.coalesce(f"o.{k}", f"n.{k}").alias(k) for k in keys]
    changed = both.select(
        *pick,
        F.coalesce(F.col("o.recorded_from"), F.lit(epoch)).alias("recorded_from"),
        F.when(F.col("n.holds").isNull(), epoch).otherwise(OPEN).alias("recorded_to"),
    )
    return rest.unionByName(changed)


def observed_states(observations: DataFrame) -> DataFrame:
    """The usable snapshots of listings: listing_id, at (microseconds), id, price_eur, hash.

    A fetch that left title, description and price all null says nothing and is left out.
    """
    said = F.col("title").isNotNull() | F.col("description").isNotNull() | F.col("price_eur").isNotNull()
    return observations.filter(said).select(
        "listing_id", F.unix_micros("captured_at").alias("at"), "id", "price_eur", F.lower("content_hash").alias("hash")
    )


def packed(hash_: Column) -> Column:
    """A text as bytes, two hex digits in one; ``unpacked`` gives the text back. Half the bytes in every shuffle."""
    is_hex = hash_.rlike("^([0-9a-f][0-9a-f])+$")
    return F.when(is_hex, F.concat(F.unhex(F.lit("01")), F.unhex(hash_))).otherwise(F.concat(F.unhex(F.lit("00")), F.encode(hash_, "utf-8")))


def unpacked(bytes_: Column) -> Column:
    """The text of ``packed`` bytes."""
    rest = F.substring(bytes_, 2, 2**31 - 1)
    return F.when(F.substring(bytes_, 1, 1) == F.unhex(F.lit("01")), F.lower(F.hex(rest))).otherwise(F.decode(rest, "utf-8"))


def observed_states(observations: DataFrame) -> DataFrame:
    """The usable snapshots of listings: listing_id, at (microseconds), id, price_eur, hash.

    A fetch that left title, description and price all null says nothing and is left out.
    """
    said = F.col("title").isNotNull() | F.col("description").isNotNull() | F.col("price_eur").isNotNull()
    return observations.filter(said).select(
        "listing_id", F.unix_micros("captured_at").alias("at"), "id", "price_eur", F.lower("content_hash").alias("hash")
    )


def packed(hash_: Column) -> Column:
    """A text as bytes, two hex digits in one; ``unpacked`` gives the text back. Half the bytes in every shuffle."""
    is_hex = hash_.rlike("^([0-9a-f][0-9a-f])+$")
    return F.when(is_hex, F.concat(F.unhex(F.lit("01")), F.unhex(hash_))).otherwise(F.concat(F.unhex(F.lit("00")), F.encode(hash_, "utf-8")))


def unpacked(bytes_: Column) -> Column:
    """The text of ``packed`` bytes."""
    rest = F.substring(bytes_, 2, 2**31 - 1)
    return F.when(F.substring(bytes_, 1, 1) == F.unhex(F.lit("01")), F.lower(F.hex(rest))).otherwise(F.decode(rest, "utf-8"))


def listing_ledger(observations: DataFrame, slice_us: int = 7 * DAY_US) -> DataFrame:
    """The ledger of ``price_eur`` and ``content_hash`` of each listing, recorded by ``id``, the order of arrival."""
    seen = observed_states(observations).withColumn("hash", packed(F.col("hash")))
    ledger = bitemporal_ledger(seen, "listing_id", "at", "id", ["price_eur", "hash"], F.col("id"), slice_us)
    return ledger.withColumn("state", F.struct(F.col("state.price_eur").alias("price_eur"), unpacked(F.col("state.hash")).alias("hash")))
