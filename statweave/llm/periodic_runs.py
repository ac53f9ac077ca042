"""Periodic runs of words: an array of word ids is compared with itself at every lag up to a third of its length.

Stretches of equal words q apart are stretches of period q. Lags are taken an octave at a time, as one array
operation over a matrix of lags and places. A stretch that makes a run of period q covers at least 2q places, so
only every m-th place is compared at first, m a prime of at most a quarter of the octave's first lag: the stretch
then shows as eight equal places in a row. Where it does, every place between is compared and the true stretches are
run-length coded, so no run is missed and an octave costs a few times the document's length.

A document of up to LONG_BYTES is scanned where it is read. The octaves of longer ones are dealt out to all machines.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import as_strided
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statweave.llm.common import bound_batches, materialise, sliced_batches, span_hashes, text_buffers, word_spans

#: Words of a run, at least, and repeats of its period.
MIN_LENGTH, MIN_EXPONENT = 24, 3
#: Bytes of a text whose octaves of lags are dealt out.
LONG_BYTES = 1 << 20
#: Places compared at once.
AREA = 1 << 20
#: Words joined at once.
JOIN_WORDS = 1 << 16

Arrange = Callable[[int | None, int], np.ndarray | None]
_END = np.uint64(1 << 63)  # no word's id, which have 63 bits
RUN = "struct<start: bigint, length: bigint, period: bigint>"
SCHEMA = f"doc_id long, n_words long, runs array<{RUN}>, collapsed string"


def octaves(n: int) -> list[tuple[int, int]]:
    """First lag and the one beyond the last, for all lags that a run in n words can have."""
    if n < MIN_LENGTH:
        return []
    beyond, out, first = n // MIN_EXPONENT + 1, [], 1
    while first < beyond:
        last = max(8, 2 * first)
        out.append((first, min(last, beyond)))
        first = last
    return out


def _step(first: int) -> int:
    """The largest prime of at most a quarter of the octave's first lag; 1 below 16."""
    at = first // 4
    while at > 1 and (at == 2 or any(at % k == 0 for k in range(2, int(at**0.5) + 1))):
        at -= 1
    return max(1, at)


def _factors(q: int) -> Iterator[int]:
    k = 2
    while k * k <= q:
        if q % k == 0:
            yield k
            while q % k == 0:
                q //= k
        k += 1
    if q > 1:
        yield q


def _stretches(equal: np.ndarray, least: int) -> list[tuple[int, int]]:
    """First place and the one beyond the last of each stretch of at least so many true places."""
    edges = np.flatnonzero(np.diff(np.concatenate(([False], equal, [False])).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    long = ends - starts >= least
    return list(zip(starts[long].tolist(), ends[long].tolist(), strict=True))


def _outside(low: int, high: int, zones: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out = []
    for a, b in sorted(zones):
        if b > low and a < high:
            if a > low:
                out.append((low, a))
            low = max(low, b)
    return [*out, (low, high)] if low < high else out


def scan(ids: np.ndarray, ranges: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Runs (start, length, period) of the word ids whose period is a lag of one of the octaves."""
    n, found, known = ids.size, [], []
    if not ranges:
        return found
    padded = np.full(n + ranges[-1][1] + ranges[-1][1] // 4 + 8, _END, np.uint64)
    np.right_shift(ids, np.uint64(1), out=padded[:n])
    for first, last in ranges:
        # a longer lag that is a multiple of a run's period finds that run again, as long as it holds three of them
        known = [k for k in known if k[2] - k[1] >= MIN_EXPONENT * first]
        step, q = _step(first), first
        while q < last:
            places = -(-(n - q) // step)
            if places < 8:
                break
            rows = min(last - q, max(1, AREA // places))
            hit = as_strided(padded[q:], (rows, places), (8, 8 * step)) == padded[: places * step : step]
            hit = hit[:, :-1] & hit[:, 1:]
            hit = hit[:, :-2] & hit[:, 2:]
            hit = hit[:, :-4] & hit[:, 4:]
            for row in np.flatnonzero(hit.any(axis=1)).tolist():
                _scan_lag(padded, n, q + row, step, hit[row], known, found)
            q += rows
    return found


def _scan_lag(padded: np.ndarray, n: int, q: int, step: int, eights: np.ndarray, known: list, found: list) -> None:
    """Adds the runs of period q to found, and every stretch of period q to known with its smallest period."""
    least = max(MIN_LENGTH - q, (MIN_EXPONENT - 1) * q)
    zones = [(s, e - q) for p, s, e in known if q % p == 0 and e - q > s]
    for a, b in _stretches(eights, 1):
        # the places sampled before and after are unequal, so no stretch goes beyond them
        for low, high in _outside(max(0, (a - 1) * step + 1), min(n - q, (b + 7) * step), zones):
            if high - low < least:
                continue
            for s, e in _stretches(padded[low:high] == padded[low + q : high + q], least):
                start, end, period = low + s, low + e + q, q
                for f in _factors(q):  # over three periods long, so its smallest period divides q
                    while period % f == 0 and np.array_equal(padded[start : end - period // f], padded[start + period // f : end]):
                        period //= f
                known.append((period, start, end))
                if period == q:
                    found.append((start, end - start, q))


def runs_of(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """All runs of the word ids, by start, then period."""
    return sorted(scan(ids, octaves(ids.size)), key=lambda r: (r[0], r[2]))


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray | None:
    """The words outside every run, or among its first period; None if all are."""
    if not runs:
        return None
    edge = np.zeros(n + 1, np.int32)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.flatnonzero(np.cumsum(edge[:n]) == 0)


def _joined(data: memoryview, starts: np.ndarray, ends: np.ndarray, order: np.ndarray | None) -> bytes:
    n, parts = (starts if order is None else order).size, []
    for i in range(0, n, JOIN_WORDS):
        some = slice(i, i + JOIN_WORDS) if order is None else order[i : i + JOIN_WORDS]
        parts.append(b" ".join([data[s:e] for s, e in zip(starts[some].tolist(), ends[some].tolist(), strict=True)]))
    return b" ".join(parts)


def _words(batch: pa.RecordBatch, arrange: Arrange | None) -> Iterator[tuple]:
    """For each row its id, the bytes, starts and ends of its words in them, their order or None, and their ids."""
    data, offsets = text_buffers(batch.column("text"))
    starts, ends, rows = word_spans(data, offsets)
    ids = span_hashes(data, starts, ends)
    cuts = np.searchsorted(rows, np.arange(batch.num_rows + 1))
    del rows
    for i, doc_id in enumerate(batch.column("doc_id").to_pylist()):
        a, b = cuts[i], cuts[i + 1]
        order = arrange(doc_id, int(b - a)) if arrange else None
        yield doc_id, memoryview(data), starts[a:b], ends[a:b], order, ids[a:b] if order is None else ids[a:b][order]


def _result(rows: list[tuple]) -> pa.RecordBatch:
    """rows: id, number of words, runs, collapsed text as bytes."""
    flat = [run for r in rows for run in r[2]]
    run = pa.StructArray.from_arrays([pa.array([f[k] for f in flat], pa.int64()) for k in range(3)], ["start", "length", "period"])
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(r[2]) for r in rows]))), pa.int32()), run)
    text = pa.array([r[3] for r in rows], pa.large_binary()).cast(pa.large_string()).cast(pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), lists, text], ["doc_id", "n_words", "runs", "collapsed"])


def _collapsed(word: tuple, runs: list[tuple[int, int, int]]) -> tuple:
    doc_id, data, starts, ends, order, ids = word
    kept = kept_words(ids.size, runs)
    if kept is not None:
        order = kept if order is None else order[kept]
    return doc_id, ids.size, runs, _joined(data, starts, ends, order)


def _scan_in_place(arrange: Arrange | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced_batches(batches):
            yield _result([_collapsed(word, runs_of(word[5])) for word in _words(batch, arrange)])

    return run


def _ranges(arrange: Arrange | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids = next(_words(batch.slice(i, 1), arrange))[5]
                for low, high in octaves(ids.size):
                    yield pa.RecordBatch.from_arrays([batch.column("rid").slice(i, 1), pa.array([low], pa.int64()), pa.array([high], pa.int64()), pa.array([memoryview(ids)], pa.binary())], ["rid", "low", "high", "ids"])

    return run


def _scan_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            rid, low, high = (batch.column(c)[i].as_py() for c in ("rid", "low", "high"))
            runs = scan(np.frombuffer(batch.column("ids")[i].as_buffer(), np.uint64), [(low, high)])
            yield pa.RecordBatch.from_arrays([pa.array([x] * len(runs) if k == 0 else [r[k - 1] for r in runs], pa.int64()) for k, x in enumerate((rid, 0, 0, 0))], ["rid", "start", "length", "period"])


def _collapse_long(arrange: Arrange | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                word = next(_words(batch.slice(i, 1), arrange))
                runs = sorted(((r["start"], r["length"], r["period"]) for r in batch.column("runs")[i].as_py() or []), key=lambda r: (r[0], r[2]))
                yield _result([_collapsed(word, runs)])

    return run


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", arrange: Arrange | None = None, long_bytes: int = LONG_BYTES) -> DataFrame:
    """One row for each input row: doc_id, n_words, runs (start, length, period; by start, then period), and collapsed,
    the words joined by one space without those that lie in a run after its first period.

    A run is a stretch of consecutive words with smallest period q, of at least 24 words and 3 periods, that no
    neighbouring word extends. Runs may overlap. Null, empty and blank texts have no words, no runs and an empty text;
    a null id stays; repeated rows each have their own result; an empty table gives an empty result; other columns,
    whatever their names, are ignored.

    arrange: gives for an id and a number of words the words to take, by number, or None for all as they are. Words are
    known by 63-bit hashes; a collision would make two words one. Texts of more than long_bytes are written as a table,
    their octaves shuffle with their word ids, and their runs come back by a join on the row; all others stay where they
    are read.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    long = F.octet_length("text") > long_bytes
    short = rows.where(~long).mapInArrow(_scan_in_place(arrange), SCHEMA)
    table = materialise(rows.where(long).withColumn("rid", F.monotonically_increasing_id()), "long_texts")
    ranges = table.select("rid", "doc_id", "text").mapInArrow(_ranges(arrange), "rid long, low long, high long, ids binary")
    found = ranges.repartition("rid", "low").mapInArrow(_scan_ranges, "rid long, start long, length long, period long")
    found = found.groupBy("rid").agg(F.collect_list(F.struct("start", "length", "period")).alias("runs"))
    return short.unionByName(table.join(found, "rid", "left").select("doc_id", "text", "runs").mapInArrow(_collapse_long(arrange), SCHEMA))


def repeated_tail(doc_id: int | None, n: int) -> np.ndarray | None:
    """Of every tenth document by its id's hash, a tail that repeats its first words; a null id leaves all as it is."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    return np.where(at >= a, a + (at - a) % p, at)


def strongest(runs: Column) -> Column:
    """The run with the greatest length in periods, of those the first by start, then period; null without runs."""

    def better(best: Column, run: Column) -> Column:
        left, right = run["length"] * best["period"], best["length"] * run["period"]
        return best.isNull() | (left > right) | ((left == right) & (F.struct(run["start"], run["period"]) < F.struct(best["start"], best["period"])))

    return F.aggregate(runs, F.lit(None).cast(RUN), lambda best, run: F.when(better(best, run), run).otherwise(best))


def run_digests(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the strongest run, and digests of all runs and of the collapsed text, of periodic_runs()' rows."""
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    best = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), strongest(F.col("runs")).alias("best"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    return best.select("doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("(1000 * best.length) div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
