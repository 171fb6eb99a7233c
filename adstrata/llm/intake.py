"""Deduplicating new batches against all history with a persisted index of minwise keys.

A record is a set of keys. Two records match when they share at least ``share`` of
all their distinct keys (Jaccard). The keys of a record are put in a fixed minwise
order: by hash, the keys known to be common last. Two records that match must share a
key among the first n - ceil(share * n) + 1 of either one's n keys, so only those
band keys are indexed, and a probe of a new record's band keys finds every match:
nothing is lost to chance. Candidates are verified on the whole signatures.

The index is a table in the shared folder, under a path by which a later run opens it
again: a row per band key and accepted record, with its signature, so that a probe that
meets a band can verify at once. Rows lie in a folder per hash bucket of the band, sorted
by band. A batch lists the buckets of its own bands and reads only those; the rows whose
band it has are picked out in the scan, before anything is shuffled. What it accepts is
appended. Whenever the accepted records have doubled, the index is laid out anew: the
number of buckets grows with it, so that a bucket holds about ``bucket_rows`` rows at any
size, and the order of the keys is taken from their counts in all of it, so that a key
which became common no longer is a band key. So every record is laid out again a number
of times that is logarithmic in the history, and never compared again.

Skew: a key held by more than ``common`` records is common; it comes last in the order, so
it is a band key only of records made mostly of common keys, and those match one another
or differ by rare keys. Any order is right, this one is fast. Exact copies within a batch
are one class, whose least record stands for them; the others stay rows of their own.
Within a batch, the first pending record of each bucket is the bucket's leader; while the
buckets hold more than ``pairs_per_row`` comparisons per band row, leaders decide most
records in rounds of one comparison per band key. Only the rest is compared pair by pair,
so a large group of near copies never meets itself. What then is open is taken in order:
in rounds, until at most ``solo_edges`` pairs are left, which one task takes in one pass
(their number is checked; both ways give the same result).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adstrata.plans.scratch import delete, drop, fresh_path, observed, put_text, read_text, written, written_counted

_BAND_ROW = "band bigint, record bigint, sig array<bigint>, batch int, bucket int"


def record_keys(keys: DataFrame) -> DataFrame:
    """(record, key): each record's distinct keys as hashes of type and value, values without blanks around them and ignoring case.

    Rows with a null record, type or value are left out.
    """
    key = F.xxhash64("key_type", F.lower(F.trim("key_value")))
    return keys.filter("listing_id IS NOT NULL AND key_type IS NOT NULL AND key_value IS NOT NULL").select(
        F.col("listing_id").alias("record"), key.alias("key")
    ).distinct()


def _rejected_in_order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The records that the edges (a accepted or pending, b pending, a < b) reject when they are taken in order of b."""
    edges = pd.concat([pd.DataFrame({"a": [], "b": []}, dtype="int64"), *batches]).sort_values("b")
    refused: set[int] = set()
    for a, b in zip(edges["a"].to_numpy(), edges["b"].to_numpy(), strict=True):
        if a not in refused:
            refused.add(b)
    yield pd.DataFrame({"record": sorted(refused)}, dtype="int64")


class IntakeIndex:
    """The accepted records. ``admit`` takes the next batch; ``share`` is the least Jaccard similarity of a match.

    ``path`` is a folder that all executors share; an index found there is opened, with the
    settings it was made with. Without a path the index is one of this run. A batch that
    failed half way leaves the state as it was and can be admitted again.
    """

    def __init__(
        self, spark: SparkSession, path: str | None = None, share: float = 0.5, common: int = 100, bucket_rows: int = 200_000,
        pairs_per_row: int = 64, solo_edges: int = 1_000_000, broadcast_bands: int = 1_000_000,
    ):
        self.spark, self.path = spark, (path or fresh_path(spark, "intake")).rstrip("/")
        self.pairs_per_row, self.solo_edges, self.broadcast_bands = pairs_per_row, solo_edges, broadcast_bands
        known = read_text(spark, f"{self.path}/STATE")
        self.state = json.loads(known) if known else {
            "share": share, "common": common, "bucket_rows": bucket_rows, "generation": 0, "buckets": 1,
            "batches": 0, "since": 0, "last": None, "records": 0, "laid_out": 0, "rows": 0,  # since: the first batch folder of the generation
        }
        self.share = self.state["share"]

    def _at(self, name: str, generation: int | None = None) -> str:
        return f"{self.path}/{name}-{self.state['generation'] if generation is None else generation}"

    def known(self, buckets: list[int] | None = None) -> DataFrame | None:
        """The index rows (band, record, sig, bucket) in ``buckets``, of all if None; None while there are none."""
        s = self.state
        if not s["records"]:
            return None
        rows = self.spark.read.schema(_BAND_ROW).option("basePath", self._at("bands")).parquet(*[f"{self._at('bands')}/batch={b}" for b in range(s["since"], s["batches"])])
        return rows.drop("batch") if buckets is None else rows.drop("batch").filter(F.col("bucket").isin(buckets))

    def matches(self) -> DataFrame:
        """(a, b) of all batches: each rejected record b with each record a accepted before it that it matches."""
        paths = [f"{self.path}/matches/batch={b}" for b in range(self.state["batches"])]
        schema = T.StructType([T.StructField(c, T.LongType()) for c in ("a", "b")])
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _order(self, keyed: DataFrame, generation: int) -> None:
        """Fix the order of keys of a generation: the common keys of ``keyed`` with their counts."""
        held = keyed.groupBy("key").agg(F.count("*").alias("held")).filter(F.col("held") > self.state["common"])
        held.write.mode("overwrite").parquet(self._at("common", generation))

    def _signatures(self, keyed: DataFrame, generation: int | None = None) -> DataFrame:
        """(batch_no, record, sig): the keys in minwise order. The mix makes an order that the key's own hash doesn't give."""
        ranked = keyed.join(self.spark.read.schema("key bigint, held bigint").parquet(self._at("common", generation)), "key", "left")
        order = F.struct(F.coalesce("held", F.lit(0)).alias("held"), F.xxhash64("key", F.lit(7)).alias("h"), "key")
        return ranked.groupBy("batch_no", "record").agg(F.array_sort(F.collect_list(order)).alias("o")).select("batch_no", "record", F.col("o.key").alias("sig"))

    def _bands(self, ready: DataFrame, buckets: int | None = None) -> DataFrame:
        """(batch_no, band, record, sig, bucket): a row per band key of each class; the signature goes with it, so that a probe needs nothing else."""
        n = F.size("sig")
        prefix = F.slice("sig", F.lit(1), n - F.ceil(F.lit(self.share) * n - 1e-9).cast("int") + 1)
        rows = ready.filter("record = first").select("batch_no", F.explode(prefix).alias("band"), "record", "sig")
        return rows.withColumn("bucket", F.pmod("band", F.lit(buckets or self.state["buckets"])).cast("int"))

    def _matching(self, new: DataFrame, known: DataFrame) -> DataFrame:
        """(a, b): the matches of records b of the band rows ``new`` with records a of the band rows ``known``.

        Signatures are in one order, so the first key that two of them share is a band key
        of both if they match: a pair is verified and given at that band alone.
        """
        left = new.select("band", F.col("record").alias("b"), F.col("sig").alias("sb"))
        right = known.select("band", F.col("record").alias("a"), F.col("sig").alias("sa"))
        m, n, share = F.size("sa"), F.size("sb"), F.lit(self.share)
        met = left.join(right, "band").filter((n >= share * m) & (m >= share * n) & (F.col("a") != F.col("b")))
        met = met.select("a", "b", "band", (m + n).alias("sum"), F.array_intersect("sa", "sb").alias("common"))
        held = F.size("common")
        return met.filter((F.get("common", F.lit(0)) == F.col("band")) & (held >= share * (F.col("sum") - held))).select("a", "b")

    def _prepared(self, keyed: DataFrame) -> tuple[DataFrame, dict]:
        """(batch_no, record, sig, first) of the records of ``keyed`` (batch_no, record, key), written; and what each batch holds.

        ``first`` is the least record of the batch with the same signature. Per batch: its
        band rows, the comparisons in its buckets, and how many records are copies.
        """
        signed = written(self._signatures(keyed), "signed")
        least = signed.groupBy("batch_no", "sig").agg(F.min("record").alias("first"))
        ready = written(signed.join(least, ["batch_no", "sig"]), "ready")
        drop(signed)
        in_bucket = self._bands(ready).groupBy("batch_no", "band").agg(F.count("*").alias("n"))
        rows = in_bucket.groupBy("batch_no").agg(F.sum("n").alias("rows"), F.sum(F.col("n") * F.col("n")).alias("pairs"))
        copies = ready.groupBy("batch_no").agg(F.count_if(F.col("record") != F.col("first")).alias("copies"))
        return ready, {r.batch_no: r for r in rows.join(copies, "batch_no").collect()}  # one row a batch

    def admit(self, keyed: DataFrame) -> None:
        """Take the batches of ``keyed`` (batch_no, record, key) in order, records of a batch in ascending order; ``matches`` grows.

        What has no row in ``matches`` is accepted. A record must not have been admitted
        before; one without a key never comes here and matches nothing.
        """
        numbers = sorted(r[0] for r in keyed.select("batch_no").distinct().collect())  # one row a batch
        ready = None
        for no in numbers:
            if not self.state["batches"]:
                self._order(keyed.filter(F.col("batch_no") == no), 0)
            elif self.state["records"] >= 2 * max(self.state["laid_out"], 1):
                self._lay_out()
                if ready is not None:
                    drop(ready)
                ready = None
            if ready is None:
                ready, held = self._prepared(keyed.filter(F.col("batch_no") >= no))
            self._admit(ready.filter(F.col("batch_no") == no), no, held[no])
        if ready is not None:
            drop(ready)

    def _admit(self, batch: DataFrame, no: int, held: Row) -> None:
        s = self.state
        bands = self._bands(batch)
        old, n_old = self._probe(bands, held.rows)
        accepted = rejected = None  # written records that are decided
        if n_old:
            rejected = written(old.select(F.col("b").alias("record")).distinct(), "rejected")
        left, pairs = held.rows, held.pairs  # before the probe, so at least what is left
        if pairs > self.pairs_per_row * left:
            left, pairs = self._left(bands, accepted, rejected)
        while left and pairs > self.pairs_per_row * left:
            accepted, rejected = self._lead(bands, accepted, rejected)
            left, pairs = self._left(bands, accepted, rejected)
        live = _without(bands, rejected)
        met, n_met = written_counted(self._matching(bands, live), "met")
        if n_met:
            rejected = self._settled(met, accepted, rejected)
        found = met.withColumn("old", F.lit(False)) if rejected is None else _without(_only(met, rejected, "b"), rejected, "a").withColumn("old", F.lit(False))
        if n_old:
            found = found.unionByName(old.withColumn("old", F.lit(True)))
        if held.copies:
            # Copies of an accepted class are rejected by its first record; copies of a rejected one by what was accepted before them.
            copies = batch.select("first", "record")
            theirs = copies.join(found.withColumnRenamed("b", "first"), "first").filter(F.col("old") | (F.col("a") < F.col("record"))).select("a", F.col("record").alias("b"))
            own = _without(copies.filter("record <> first"), rejected, "first").select(F.col("first").alias("a"), F.col("record").alias("b"))
            found = theirs.unionByName(own)
        else:
            found = found.filter("old OR a < b").select("a", "b")
        found.write.mode("overwrite").parquet(f"{self.path}/matches/batch={s['batches']}")
        rows, records = self._append(_without(bands, rejected), s["generation"], s["batches"])
        self._publish(s | {"batches": s["batches"] + 1, "records": s["records"] + records, "rows": s["rows"] + rows, "last": no, "laid_out": s["laid_out"] or records})
        drop(*[x for x in (met, old, accepted, rejected) if x is not None])

    def _append(self, took: DataFrame, generation: int, batch: int) -> tuple[int, int]:
        """Write band rows by bucket as a batch of a generation: their number and that of their records."""
        seen = Observation()
        # a record has one row whose band is the first key of its signature
        watched = took.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(F.col("band") == F.get("sig", F.lit(0))).alias("records"))
        by_bucket = watched.select("band", "record", "sig", "bucket").repartition("bucket").sortWithinPartitions("bucket", "band")
        by_bucket.write.mode("overwrite").partitionBy("bucket").parquet(f"{self._at('bands', generation)}/batch={batch}")
        counts = observed(seen)
        return counts.get("rows", 0), counts.get("records", 0)

    def _publish(self, state: dict) -> None:
        put_text(self.spark, f"{self.path}/STATE", json.dumps(state))
        self.state = state

    def _lay_out(self) -> None:
        """Begin a generation: all band rows anew, in the order that the counts of all accepted records give, in as many buckets as they fill."""
        s = self.state
        old, generation = s["generation"], s["generation"] + 1
        keyed = self.known().filter(F.col("band") == F.get("sig", F.lit(0))).select(F.lit(0).alias("batch_no"), "record", F.explode("sig").alias("key"))
        self._order(keyed, generation)
        buckets = -(-s["rows"] // s["bucket_rows"])
        rows, records = self._append(self._bands(self._signatures(keyed, generation).withColumn("first", F.col("record")), buckets), generation, s["batches"] - 1)
        since = s["batches"] - 1
        self._publish(s | {"generation": generation, "buckets": buckets, "since": since, "rows": rows, "records": records, "laid_out": records})
        for name in ("bands", "common"):
            delete(self.spark, self._at(name, old))

    def _probe(self, bands: DataFrame, n_bands: int) -> tuple[DataFrame | None, int]:
        """The matches of the batch with the index, written, and their number: only buckets of the batch's bands are read."""
        if not self.state["records"]:
            return None, 0
        buckets = None
        if self.state["buckets"] > 1:
            buckets = [r[0] for r in bands.select("bucket").distinct().collect()]  # at most as many as the index has
        # up to a bound, what is known isn't shuffled: its rows meet the batch in the scan's own stage
        new = F.broadcast(bands) if n_bands <= self.broadcast_bands else bands
        return written_counted(self._matching(new, self.known(buckets)), "old")

    def _lead(self, bands: DataFrame, accepted: DataFrame | None, rejected: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        """One round: a pending record that leads all its buckets has no earlier match and is accepted; those that match an accepted leader are rejected."""
        pending = _without(_without(bands, rejected), accepted)
        led = pending.join(pending.groupBy("band").agg(F.min("record").alias("leader")), "band")
        clear = led.groupBy("record").agg(F.max(F.col("leader") != F.col("record")).alias("behind")).filter("NOT behind").select("record")
        now = written(clear if accepted is None else clear.unionByName(accepted), "accepted")
        first = led.filter("leader = record").join(now, "record", "left_semi")
        beaten = self._matching(led.filter("leader <> record"), first).select(F.col("b").alias("record")).distinct()
        gone = written(beaten if rejected is None else beaten.unionByName(rejected), "rejected")
        drop(*[x for x in (accepted, rejected) if x is not None])
        return now, gone

    def _left(self, bands: DataFrame, accepted: DataFrame | None, rejected: DataFrame | None) -> tuple[int, int]:
        """How many band rows are pending, and how many comparisons with the batch their buckets hold."""
        pending = _without(_without(bands, rejected), accepted).groupBy("band").agg(F.count("*").alias("pending"))
        every = bands.groupBy("band").agg(F.count("*").alias("all"))
        row = pending.join(every, "band").agg(F.coalesce(F.sum("pending"), F.lit(0)), F.coalesce(F.sum(F.col("pending") * F.col("all")), F.lit(0))).first()
        return row[0], row[1]

    def _settled(self, met: DataFrame, accepted: DataFrame | None, rejected: DataFrame | None) -> DataFrame:
        """All rejected records of the batch, written: what is still pending is taken in order, by the earlier live records it met."""
        edges, open_ = written_counted(_without(_without(met.filter("a < b"), rejected, "b"), accepted, "b"), "edges")
        taken = accepted
        while open_ > self.solo_edges:
            waits = edges.select(F.col("b").alias("record")).distinct()
            sure = edges.select(F.col("a").alias("record")).distinct().join(waits, "record", "left_anti")
            now = written(sure if taken is None else sure.unionByName(taken), "taken")
            beaten = _only(edges, now, "a").select(F.col("b").alias("record")).distinct()
            gone = written(beaten if rejected is None else beaten.unionByName(rejected), "rejected")
            fewer, open_ = written_counted(_without(_without(edges, gone, "b"), gone, "a"), "edges")
            drop(edges, *[x for x in (rejected, taken) if x is not None and x is not accepted])
            edges, rejected, taken = fewer, gone, now
        last = edges.select("a", "b").coalesce(1).mapInPandas(_rejected_in_order, "record bigint")  # at most solo_edges rows
        out = written(last if rejected is None else last.unionByName(rejected), "rejected")
        drop(edges, *[x for x in (rejected, taken) if x is not None and x is not accepted])
        return out


def _without(rows: DataFrame, records: DataFrame | None, column: str = "record") -> DataFrame:
    return rows if records is None else rows.join(records.select(F.col("record").alias(column)), column, "left_anti")


def _only(rows: DataFrame, records: DataFrame, column: str) -> DataFrame:
    return rows.join(records.select(F.col("record").alias(column)), column, "left_semi")


def deduplicated(batches: DataFrame, keys: DataFrame, share: float = 0.5, common: int = 100, path: str | None = None, **settings: int) -> tuple[DataFrame, DataFrame]:
    """(decisions, matches) of all batches, taken in order of ``batch_no`` through one index.

    A record belongs to the lowest batch it appears under; repeated rows add nothing, rows
    with a null batch or listing are left out. Records without keys are accepted and match
    nothing. decisions: record, batch_no, accepted; matches: a, b (a accepted before b).
    With the ``path`` of an index that took batches before, only later ones are admitted.
    """
    first = batches.filter("batch_no IS NOT NULL AND listing_id IS NOT NULL").groupBy(F.col("listing_id").alias("record")).agg(F.min("batch_no").alias("batch_no"))
    first = written(first, "batch_of")
    index = IntakeIndex(batches.sparkSession, path, share, common, **settings)
    last = index.state["last"]
    new = first if last is None else first.filter(F.col("batch_no") > last)
    keyed = written(record_keys(keys).join(new, "record").select("batch_no", "record", "key"), "keyed")
    index.admit(keyed)
    drop(keyed)
    matches = index.matches()
    refused = matches.select(F.col("b").alias("record")).distinct().withColumn("refused", F.lit(True))
    decisions = first.join(refused, "record", "left").select("record", "batch_no", F.col("refused").isNull().alias("accepted"))
    return decisions, matches
