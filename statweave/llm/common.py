"""Shared helpers: durable intermediate tables, bounded joins, Arrow text buffers."""

from __future__ import annotations

import atexit
import gc
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes and rows of text that a Python worker works on at once; a longer text is worked on alone, in blocks.
SLICE_BYTES, SLICE_ROWS = 1 << 20, 1000
#: Bytes of an Arrow batch, at most, or of one row; of a batch the JVM and a Python worker each hold a few copies.
ARROW_BYTES = 8 << 20
#: Bytes of a text that a pass over it holds its temporaries for.
BLOCK = 1 << 18

_tables: list[str] = []


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, which spark.checkpoint.dir names. Only where all runs on one
    machine may the setting be missing; a local folder is made then and recorded in it. On a cluster that folder
    would be another one for every executor, so a missing setting is an error there."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="statweave-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and rereads it: lineage is cut, and a lost executor costs
    only the reading of files."""
    path = f"{work_dir(df.sparkSession)}/statweave/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _tables:
        atexit.register(release)
    _tables.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tables() -> list[str]:
    """The intermediate tables that stand, oldest first."""
    return list(_tables)


def release(paths: list[str] | None = None) -> None:
    """Deletes intermediate tables, all by default; the frames that read them must be done with."""
    spark = SparkSession.getActiveSession()
    paths = list(_tables) if paths is None else paths
    _tables[:] = [p for p in _tables if p not in set(paths)]
    if spark is None or spark.sparkContext._jsc is None:  # without a session only local folders can be reached
        for p in paths:
            if p.startswith("file:"):
                shutil.rmtree(p.removeprefix("file://").removeprefix("file:"), ignore_errors=True)
        return
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)


def collect_garbage(spark: SparkSession) -> None:
    """Lets go of finished plans: Python's cycles hold frames in the JVM, and only when the JVM collects them
    does Spark's cleaner remove their shuffle files and broadcasts from the executors."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's bound on the bytes of Arrow batches to ARROW_BYTES, if it is higher. Plans read it when they
    run, so it stays; every operator here sets the same, and none raises it."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    number, unit = re.fullmatch(r"\s*(\d+)\s*([a-z]?)b?\s*", spark.conf.get(key).lower()).groups()
    if int(number) << {"": 0, "b": 0, "k": 10, "m": 20}.get(unit, 30) > ARROW_BYTES:
        spark.conf.set(key, str(ARROW_BYTES))


def free_name(taken: list[str], name: str) -> str:
    """name, with underscores before it until no column in taken is called so, whatever the case."""
    lower = {x.lower() for x in taken}
    while name.lower() in lower:
        name = f"_{name}"
    return name


def fold(col: Column, modulus: int) -> Column:
    """crc32 of the value as text, by a modulus; the folds of every learner here."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % modulus


def attach_group(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, hot_groups: int = 1000) -> DataFrame:
    """Joins each row to its group's one row, on key. Groups of more than total/hot_groups rows number at
    most hot_groups, so they are broadcast with that proven bound and their rows never shuffle; every other
    key holds at most that share of the rows, whatever their number."""
    limit = total // hot_groups
    hot = groups.where(F.col(size) > limit)
    marked = rows.join(F.broadcast(hot), key, "left")
    heavy = marked.where(F.col(size).isNotNull())
    light = marked.where(F.col(size).isNull()).select(*rows.columns).join(groups.where(F.col(size) <= limit).hint("shuffle_merge"), key)
    return heavy.unionByName(light)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its row offsets, without a Python object per row. Null is empty."""
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    offsets = np.frombuffer(column.buffers()[1], dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if not len(column) or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def text_slices(column: pa.Array, most: int = SLICE_BYTES, rows: int = SLICE_ROWS) -> Iterator[tuple[int, int]]:
    """Runs of rows, first and beyond last, with at most so many bytes of text; a longer text is a run of its own."""
    n = len(column)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    ends = np.frombuffer(column.buffers()[1], dtype=kind)[column.offset : column.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    at = 0
    while at < n:
        stop = min(at + rows, max(at + 1, int(np.searchsorted(ends, ends[at] + most, side="right")) - 1))
        yield at, stop
        at = stop


def by_slices(fn: Callable[[pa.Array], pa.Array], most: int = SLICE_BYTES) -> Callable[[pa.Array], pa.Array]:
    """fn over a text column, called for runs of its rows, so that its memory is bounded by their bytes whatever
    the size of the Arrow batch."""

    def run(column: pa.Array) -> pa.Array:
        parts = [fn(column.slice(i, j - i)) for i, j in text_slices(column, most)]
        return fn(column) if not parts else parts[0] if len(parts) == 1 else pa.concat_arrays(parts)

    return run


def sliced_batches(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in runs of rows with at most so many bytes of text; empty ones are left out."""
    for batch in batches:
        for i, j in text_slices(batch.column(column), most):
            yield batch.slice(i, j - i)


_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def byte_pieces(text: bytes, most: int = SLICE_BYTES) -> Iterator[bytes]:
    """text in pieces that end after white space, at the first place beyond so many bytes; none for no text."""
    at = 0
    while at < len(text):
        found = _SPACE.search(text, at + most)
        stop = found.end() if found else len(text)
        yield text[at:stop]
        at = stop


_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.frombuffer(data.tobytes().translate(_LOWER), np.uint8)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word [^\\x20\\x09-\\x0D]+; a row's end ends its last word."""
    first = np.unique(offsets[:-1])
    starts, ends = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for p in range(0, data.size, BLOCK):
        q = min(data.size, p + BLOCK)
        inside = np.zeros(q - p + 2, bool)  # from the byte before the block to the one after it
        chunk = data[max(p - 1, 0) : q + 1]
        at = 1 if p == 0 else 0
        inside[at : at + chunk.size] = (chunk != 32) & ((chunk < 9) | (chunk > 13))
        before, here, after = inside[:-2].copy(), inside[1:-1], inside[2:].copy()
        i, j = np.searchsorted(first, [p, q])
        before[first[i:j] - p] = False
        i, j = np.searchsorted(first, [p + 1, q + 1])
        after[first[i:j] - 1 - p] = False
        starts.append(np.flatnonzero(here & ~before) + p)
        ends.append(np.flatnonzero(here & ~after) + p + 1)
    begin = np.concatenate(starts)
    return begin, np.concatenate(ends), np.searchsorted(offsets[1:], begin, side="right")


_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


@lru_cache
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out, out=out)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span, spans in order and apart: differences of one running polynomial, so a batch
    costs a few passes over its bytes and no Python call for a word. Equal bytes give equal hashes in every batch
    and task. Temporaries are held for one block at a time, however long the data or a span."""
    out = np.zeros(starts.size, np.uint64)
    if not starts.size:
        return out
    turn = np.zeros(starts.size, np.uint64)  # inverse powers, which take a span's place out of its hash
    up, down = _powers(int(_BASE), BLOCK + 1), _powers(int(_INVERSE), BLOCK + 1)
    carry, scale, back = (np.array([x], np.uint64) for x in (0, 1, 1))
    for p in range(0, int(ends[-1]), BLOCK):
        q = min(data.size, p + BLOCK)
        run = np.empty(q - p + 1, np.uint64)
        run[0] = 0
        np.cumsum((data[p:q].astype(np.uint64) + np.uint64(1)) * up[: q - p], out=run[1:])
        run = run * scale + carry
        i, j = np.searchsorted(starts, [p, q])
        out[i:j] -= run[starts[i:j] - p]
        turn[i:j] = down[starts[i:j] - p] * back
        i, j = np.searchsorted(ends, [p, q], side="right")
        out[i:j] += run[ends[i:j] - p]
        carry, scale, back = run[-1:], scale * up[BLOCK : BLOCK + 1], back * down[BLOCK : BLOCK + 1]
    return mix64(out * turn + (ends - starts).astype(np.uint64))


def grouped_sum(values: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, weights=values, minlength=n)[:n]


def tokenizer_path(path: str | None = None) -> str:
    """The byte-level BPE vocabulary file; each machine resolves the default from its own installation."""
    if path and os.path.exists(path):
        return path
    import public_tokenizers

    return public_tokenizers.path(os.path.basename(path) if path else "byte_bpe_50k.json")
