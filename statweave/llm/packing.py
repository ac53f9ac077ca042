"""Packing of documents into windows of a fixed number of tokens, by best-fit decreasing.

Each document's ids are cut into full windows and one rest. Rests of one length are interchangeable, so
best-fit decreasing needs only how many there are of each length (at most the window's size of numbers,
whatever the corpus). The driver packs those numbers: a segment tree over remaining capacity finds the
tightest open windows, and runs of equal pieces are placed at once. The plan that comes back says, for a run
of ranks within a length, which windows and offsets they get; every piece then looks up its own rank.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statweave.llm.bpe import encoder
from statweave.llm.common import bound_batches, materialise, sliced_batches

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part long, nth long"


class TightestFit:
    """Segment tree indexed by remaining capacity; holds how many windows are open at each."""

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, capacity: int, n: int) -> None:
        at = capacity + self.leaves
        while at:
            self.count[at] += n
            at >>= 1

    def find(self, least: int) -> int | None:
        """The smallest capacity of at least least that an open window has."""
        at = least + self.leaves
        while not self.count[at]:
            while at & 1:  # a right child has nothing further right below its parent
                at >>= 1
            if not at:
                return None
            at += 1
        while at < self.leaves:
            at = 2 * at if self.count[2 * at] else 2 * at + 1
        return at - self.leaves


def plan_windows(counts: dict[int, int], window: int) -> tuple[np.ndarray, int]:
    """Best-fit decreasing of counts[length] pieces. Returns rows (length, first rank, first window, pieces a
    window, first offset), sorted by length and first rank, and the number of windows."""
    tree = TightestFit(window)
    open_: dict[int, list[tuple[int, int]]] = {}  # capacity: runs (first window, number)
    rows, windows = [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            capacity = tree.find(length)
            if capacity is None:
                each = window // length
                first, n = windows, -(-left // each)
                windows += n
                capacity = window
            else:
                each = capacity // length
                first, n = open_[capacity].pop()
                tree.add(capacity, -n)
                need = -(-left // each)
                if need < n:
                    open_[capacity].append((first + need, n - need))
                    tree.add(capacity, n - need)
                    n = need
            rows.append((length, rank, first, each, window - capacity))
            placed = min(left, n * each)
            full, over = divmod(placed, each)
            left, rank = left - placed, rank + placed
            for start, number, used in ((first, full, each), (first + full, int(over > 0), over)):
                rest = capacity - used * length
                if number and rest:
                    open_.setdefault(rest, []).append((start, number))
                    tree.add(rest, number)
    return np.array(sorted(rows), np.int64).reshape(-1, 5), windows


def _pieces(window: int, end_id: int, path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).whole
        ranks: Counter[int] = Counter()
        names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "nth")
        for batch in sliced_batches(batches):
            rows = []
            for doc_id, text, part in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "part")), strict=True):
                ids = np.append(encode(text or ""), np.uint32(end_id)).astype("<u4")
                for at in range(0, ids.size, window):
                    size = min(window, ids.size - at)
                    rows.append((doc_id, at, size, zlib.crc32(ids[at : at + size]), ids.size, part, ranks[size]))
                    ranks[size] += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=list(names))

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 1024, end_id: int = 0, tokenizer: str | None = None) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts are the end id alone. Repeated rows are packed each by itself; among pieces of one
    length any order is as good. An empty table gives an empty result; very long texts are cut into full
    windows and a rest; other columns, whatever their names, are ignored.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.spark_partition_id().cast("long").alias("part"))
    pieces = materialise(source.mapInArrow(_pieces(window, end_id, tokenizer), PIECES), "pieces")
    per_part = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = materialise(per_part.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))), "ranks")
    counts = {r["length"]: r["n"] for r in base.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    rows, _ = plan_windows(counts, window)
    starts = {length: np.searchsorted(rows[:, 0], [length, length + 1]) for length in counts}
    held = spark.sparkContext.broadcast((rows, starts))

    @F.arrow_udf("struct<sequence_id: long, offset: long>")
    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        rows, starts = held.value
        size, rank = length.to_numpy(), rank.to_numpy()
        found = np.empty(size.size, np.int64)
        for s in np.unique(size):
            i, j = starts[int(s)]
            here = size == s
            found[here] = i + np.searchsorted(rows[i:j, 1], rank[here], side="right") - 1
        nth = rank - rows[found, 1]
        each = rows[found, 3]
        return pa.StructArray.from_arrays([pa.array(rows[found, 2] + nth // each), pa.array(rows[found, 4] + nth % each * size)], names=["sequence_id", "offset"])

    ranked = pieces.join(base.drop("n"), ["length", "part"]).withColumn("at", place(F.col("length"), F.col("nth") + F.col("base")))
    return ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "at.sequence_id", "at.offset")
