"""Encoding of a whole corpus with a public byte-level BPE tokenizer.

The words of a partition's texts are kept once each. Over the words that are new in a
batch a pair occurrence index is built: for each adjacent pair of tokens all the
positions at which it stands. The ranks of the pairs present are taken in ascending
order; applying one merges its pair at all its positions at once and updates only the
lists of the pairs to the left and right of them. A merge can only make pairs of
higher rank, so one ascending pass ends at what greedy merging word by word gives.

Scale: encoding is a map over partitions without a shuffle. What a task holds is one
Arrow batch and at most ``CACHE_WORDS`` encoded words, after which its cache starts
afresh. The vocabulary (a file of a few MB, its size checked) reaches the executors as
a broadcast variable, so only the driver reads it.
"""

from __future__ import annotations

import heapq
import json
import os
from array import array
from collections.abc import Iterable, Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CACHE_WORDS = 200_000
MAX_FILE_MB = 64
# Fixed value: the rule by which byte-level BPE of this family cuts text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_vocabulary() -> str:
    """The path of byte_bpe_50k.json: of $ADSTRATA_TOKENIZERS, or of the installed public tokenizers."""
    return os.path.join(os.environ.get("ADSTRATA_TOKENIZERS", "/opt/tokenizers"), "byte_bpe_50k.json")


def _byte_names() -> dict[str, int]:
    """The character by which the vocabulary file writes each byte, by rule: a printable one stands for itself, the others follow from 256 on."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


def read_vocabulary(path: str) -> dict:
    """{"bytes": the id of each byte, "merges": {(left id, right id): (rank, merged id)}} of a byte-level BPE file."""
    if os.path.getsize(path) > MAX_FILE_MB << 20:
        raise ValueError(f"{path} is larger than {MAX_FILE_MB} MB")
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    ids = model["vocab"]
    names = _byte_names()
    byte_ids = [0] * 256
    for name, b in names.items():
        byte_ids[b] = ids[name]
    merges = {}
    for rank, pair in enumerate(model["merges"]):
        left, right = pair if isinstance(pair, list) else pair.split(" ")
        merges[ids[left], ids[right]] = (rank, ids[left + right])
    return {"bytes": byte_ids, "merges": merges}


class PairIndexEncoder:
    """Encodes texts word by word; words are encoded together, through the pair occurrence index."""

    def __init__(self, vocabulary: dict):
        self._bytes = np.array(vocabulary["bytes"], dtype=np.int32)
        self._merges = vocabulary["merges"]
        self._split = regex.compile(WORDS)
        self._known: dict[str, array] = {}

    def encode(self, texts: Iterable[str | None]) -> list[array]:
        """The ids of each text; a null or empty text has none. Strings like special tokens are ordinary text."""
        words = [self._split.findall(t) if t else [] for t in texts]
        new = {w for ws in words for w in ws if w not in self._known}
        if new:
            self._learn(list(new))
        known = self._known
        out = [array("i", chain.from_iterable(map(known.__getitem__, ws))) for ws in words]
        if len(known) > CACHE_WORDS:
            self._known = {}
        return out

    def _learn(self, words: list[str]) -> None:
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        ends = np.cumsum([len(r) for r in raw])
        token = self._bytes[np.frombuffer(b"".join(raw), dtype=np.uint8)].tolist()
        size = len(token)
        after = list(range(1, size + 1))
        before = list(range(-1, size - 1))
        for e in ends.tolist():
            after[e - 1] = -1
            if e < size:
                before[e] = -1
        merges, index, ranks = self._merges, {}, []
        for i, j in enumerate(after):
            if j >= 0:
                pair = (token[i], token[j])
                at = index.get(pair)
                if at is not None:
                    at.append(i)
                elif pair in merges:
                    index[pair] = [i]
                    ranks.append((merges[pair][0], pair))
        heapq.heapify(ranks)
        while ranks:
            rank, pair = heapq.heappop(ranks)
            left, right = pair
            merged = merges[pair][1]
            positions = index.pop(pair)
            positions.sort()
            for i in positions:
                j = after[i]
                if token[i] != left or j < 0 or token[j] != right:
                    continue
                k = after[j]
                token[i], token[j], after[i] = merged, -1, k
                if k >= 0:
                    before[k] = i
                    self._note(index, ranks, (merged, token[k]), i)
                h = before[i]
                if h >= 0:
                    self._note(index, ranks, (token[h], merged), h)
        start = 0
        for w, e in zip(words, ends.tolist(), strict=True):
            self._known[w] = array("i", [t for t in token[start:e] if t >= 0])
            start = e

    def _note(self, index: dict, ranks: list, pair: tuple[int, int], at: int) -> None:
        held = index.get(pair)
        if held is not None:
            held.append(at)
        elif (m := self._merges.get(pair)) is not None:
            index[pair] = [at]
            heapq.heappush(ranks, (m[0], pair))


def _slices(batch: pa.RecordBatch, rows: int = 500) -> Iterator[pa.RecordBatch]:
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def encoded(docs: DataFrame, keep: Sequence[str] = ("doc_id",), text: str = "text", vocabulary: str | None = None, count_only: bool = False) -> DataFrame:
    """The columns ``keep`` of every row of ``docs`` and ids, or with ``count_only`` tokens, the number of ids.

    ``vocabulary``: path of the tokenizer's file. Null and empty texts have an empty list;
    repeated rows and null ids are kept as they are; other columns are left out.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(read_vocabulary(vocabulary or default_vocabulary()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PairIndexEncoder(shared.value)
        for batch in batches:
            for part in _slices(batch):
                lists = encoder.encode(part.column(part.num_columns - 1).to_pylist())
                sizes = np.array([len(x) for x in lists], dtype=np.int64)
                if count_only:
                    out = pa.array(sizes)
                else:
                    offsets = np.zeros(len(sizes) + 1, dtype=np.int32)
                    np.cumsum(sizes, out=offsets[1:])
                    flat = np.frombuffer(b"".join(x.tobytes() for x in lists), dtype=np.int32)
                    out = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], out], names=[*part.schema.names[:-1], name])

    name, kind = ("tokens", T.LongType()) if count_only else ("ids", T.ArrayType(T.IntegerType()))
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField(name, kind)])
    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(run, schema)
