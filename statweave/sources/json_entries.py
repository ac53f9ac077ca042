"""One huge JSON object or array, read by many tasks and written by many.

Spark's text reader cuts a file at commas, so it splits any file by byte ranges and reads it from any store. Whether a
comma parts two entries depends on all that stands before it; but how a block of the file changes the state (inside a
string or not, and how deep) is known from the block alone. A first pass finds that for each block, a running sum over
the blocks gives each its state at the start, and a second pass cuts the blocks into entries. Entries that go over the
end of a block are put together by block.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from statweave.session import cut_lineage

_ESCAPED = re.compile(r"\\.", re.S)
_BLOCKS = "file string, block long, quotes long, outside long, inside long, pieces long"
_PIECES = "file string, block long, nth long, starts boolean, ends boolean, text string"


def _depths(fragment: str) -> tuple[int, int, int]:
    """Quotation marks, and by how much the fragment goes deeper if it begins outside a string, and if inside one."""
    parts = (_ESCAPED.sub("", fragment) if "\\" in fragment else fragment).split('"')
    depth = [0, 0]
    for i, part in enumerate(parts):
        if part:
            depth[i & 1] += part.count("{") + part.count("[") - part.count("}") - part.count("]")
    return len(parts) - 1, depth[0], depth[1]


def _fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], str]]:
    for batch in batches:
        yield from zip(zip(batch.column("file").to_pylist(), batch.column("block").to_pylist(), strict=True), batch.column("value").to_pylist(), strict=True)


def _changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each block its quotation marks and the depths it adds, begun outside and inside a string."""
    at, quotes, depth, n = None, 0, [0, 0], 0
    for key, fragment in _fragments(batches):
        if key != at:
            if at:
                yield _block(at, quotes, depth, n)
            at, quotes, depth, n = key, 0, [0, 0], 0
        marks, *deeper = _depths(fragment)
        for begun in (0, 1):
            depth[begun] += deeper[(begun + quotes) & 1]
        quotes, n = quotes + marks, n + 1
    if at:
        yield _block(at, quotes, depth, n)


def _block(at: tuple[str, int], quotes: int, depth: list[int], n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x]) for x in (*at, quotes, *depth, n)], [c.split()[0] for c in _BLOCKS.split(", ")])


def _cut(starts: dict[tuple[str, int], tuple[bool, int]]):
    """Pieces of entries: whole ones, and those that begin or end in another block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, out, nth = None, [], [], 0
        inside, depth, fresh = False, 0, True

        def piece(ends: bool) -> None:
            nonlocal held, nth, fresh
            text = ",".join(held)
            if ends and depth == 0:  # the end of the whole object or array
                text = text.rstrip()[:-1]
            if text.strip() or not (fresh and ends):
                out.append((*at, nth, fresh, ends, text))
            held, nth, fresh = [], nth + 1, True

        for key, fragment in _fragments(batches):
            if key != at:
                if held:
                    piece(False)
                at, held, nth = key, [], 0
                inside, depth = starts[key]
                fresh = not inside and depth <= 1
            if depth == 0 and not inside:  # the beginning of the whole
                marks, *deeper = _depths(fragment)
                opened = re.match(r"[\s﻿]*[{\[]", fragment)
                held.append(fragment[opened.end() :] if opened else fragment)
            else:
                marks, *deeper = _depths(fragment)
                held.append(fragment)
            depth += deeper[inside]
            inside ^= bool(marks & 1)
            if not inside and depth <= 1:
                piece(True)
            if len(out) >= 1000:
                yield _pieces(out)
                out = []
        if held:
            piece(False)
        if out:
            yield _pieces(out)

    return run


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], [c.split()[0] for c in _PIECES.split(", ")])


def entries(spark: SparkSession, path: str) -> DataFrame:
    """file and text of each entry of the JSON object or array in each file at path: of an object a key and its value,
    of an array a value. An empty file, object or array has none; what isn't JSON gives texts that don't parse. No task
    holds more than a block of a file and an entry; the driver gets a few numbers for each block."""
    parts = spark.read.text(path, lineSep=",").select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    blocks = cut_lineage(parts.mapInArrow(_changes, _BLOCKS))
    order = Window.partitionBy("file").orderBy("block")
    before = lambda c: F.coalesce(F.sum(c).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = blocks.withColumn("begun", F.pmod(before("quotes"), F.lit(2)) == 1).withColumn("deeper", F.when(F.col("begun"), F.col("inside")).otherwise(F.col("outside")))
    starts = {(r.file, r.block): (r.begun, r.depth) for r in within.select("file", "block", "begun", before("deeper").alias("depth")).toLocalIterator()}
    pieces = cut_lineage(parts.mapInArrow(_cut(starts), _PIECES))
    whole = pieces.where("starts and ends").select("file", "text")
    broken = pieces.where("not (starts and ends)")
    # a piece that starts an entry begins a group; the others continue the group before them
    groups = broken.select("file", "block", "nth", F.sum(F.col("starts").cast("int")).over(Window.partitionBy("file").orderBy("block", "nth")).alias("group"))
    joined = broken.join(groups, ["file", "block", "nth"]).groupBy("file", "group").agg(F.array_sort(F.collect_list(F.struct("block", "nth", "text"))).alias("p"))
    text = F.array_join(F.transform("p", lambda p: p["text"]), ",")
    return whole.unionByName(joined.select("file", text.alias("text")))


def object_of(spark: SparkSession, path: str, value: str) -> DataFrame:
    """key and value (of a stated type) of the JSON objects at path."""
    one = F.from_json(F.concat(F.lit("{"), "text", F.lit("}")), f"map<string, {value}>")
    return entries(spark, path).select(F.explode(one).alias("key", "value"))


def array_of(spark: SparkSession, path: str, value: str) -> DataFrame:
    """value (of a stated type) of the JSON arrays at path."""
    return entries(spark, path).select(F.explode(F.from_json(F.concat(F.lit("["), "text", F.lit("]")), f"array<{value}>")).alias("value"))


def _lines(first: str, last: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun = False
        for batch in batches:
            rows = batch.column(0).to_pylist()
            if rows:
                lines = [("," if begun or i else first) + row for i, row in enumerate(rows)]
                begun = True
                yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], ["value"])
        if begun:
            yield pa.RecordBatch.from_arrays([pa.array([last])], ["value"])

    return run


def write_object(df: DataFrame, key: Column, value: Column, path: str) -> None:
    """Rows as JSON objects, one for each task that has any, an entry a line; each task writes and commits its own
    file. Rows with a null key are left out."""
    name = F.regexp_extract(F.to_json(F.array(key.cast("string"))), r"(?s)^\[(.*)\]$", 1)
    df.where(key.isNotNull()).select(F.concat(name, F.lit(": "), F.coalesce(F.to_json(value), F.lit("null"))).alias("value")).mapInArrow(_lines("{\n", "}"), "value string").write.text(path)


def write_array(df: DataFrame, value: Column, path: str) -> None:
    """Values as JSON arrays, one for each task that has any, a value a line."""
    df.select(F.to_json(value).alias("value")).mapInArrow(_lines("[\n", "]"), "value string").write.text(path)
