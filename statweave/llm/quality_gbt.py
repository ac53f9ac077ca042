"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics of a whole batch of texts are computed on its bytes at once. Trees are grown on the driver from
a bounded sample of labelled rows, then flattened into arrays, so a batch walks a tree by a few array lookups
for each level.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statweave.llm.common import BLOCK, bound_batches, by_slices, fold, grouped_sum, mix64, span_hashes, text_buffers, word_spans

#: Most labelled rows that are learned from.
TRAIN_ROWS = 20_000
TREES, DEPTH, BINS, RATE, LEAST_LEAF, RIDGE = 80, 5, 64, 0.1, 20, 1.0

_GROUPS = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "space": b" \t\n\x0b\x0c\r", "line": b"\n", "stop": b".", "comma": b",;:", "shout": b"!?",
    "symbol": b"#*$%&<>@^~=+_\\/", "bar": b"|", "bracket": b"()[]{}", "quote": b"\"'`", "dash": b"-",
}
FEATURES = (
    "log_bytes", "log_words", "log_lines", *_GROUPS, "high", "control", "word_length", "longest_word", "distinct_words", "repeated_windows", "dup_lines", "line_words", "bare_words", "capital_words", "ended_words", "most_common_word",
)


_MEMBERS = np.zeros((256, len(_GROUPS) + 2))
for _k, _chars in enumerate(_GROUPS.values()):
    _MEMBERS[list(_chars), _k] = 1
_MEMBERS[128:, -2] = 1  # high
_MEMBERS[:32, -1] = 1 - _MEMBERS[:32, :-2].max(axis=1)  # control
_LETTER = bytes(int(b >= 128 or 48 <= b <= 57 or 97 <= (b | 32) <= 122) for b in range(256))


def byte_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How often each row has each byte."""
    out = np.zeros((len(offsets) - 1, 256))
    for i, (p, q) in enumerate(itertools.pairwise(offsets.tolist())):
        for at in range(p, q, BLOCK):
            out[i] += np.bincount(data[at : min(q, at + BLOCK)], minlength=256)
    return out


def _repeats(keys: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For keys within rows: the distinct keys, the occurrences of keys found twice or more, and the most
    occurrences of one key, for each row. A row's number takes the place of the keys' lowest bits."""
    most = np.zeros(n)
    if not keys.size:
        return most, most, most
    bits = np.uint64(max(1, n - 1).bit_length())
    run = np.sort((rows.astype(np.uint64) << (np.uint64(64) - bits)) | (keys >> bits))
    first = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
    size = np.diff(np.append(first, run.size))
    row = (run[first] >> (np.uint64(64) - bits)).astype(np.int64)
    del run
    begin = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    most[row[begin]] = np.maximum.reduceat(size, begin)
    return np.bincount(row, minlength=n).astype(np.float64), grouped_sum(np.where(size > 1, size, 0), row, n), most


def windows(hashes: np.ndarray, rows: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each run of so many words within a row, and its row."""
    last = width - 1
    if hashes.size < width:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = hashes[: hashes.size - last].copy()
    for k in range(1, width):
        total *= np.uint64(0x9E3779B97F4A7C15)
        total += hashes[k : hashes.size - last + k]
    inside = rows[last:] == rows[: rows.size - last]
    return mix64(total[inside]), rows[last:][inside]


def statistics(text: pa.Array) -> np.ndarray:
    """FEATURES of each text; null counts as empty, and an empty text has zeros."""
    data, offsets = text_buffers(text)
    n = len(offsets) - 1
    size = np.maximum(np.diff(offsets), 1).astype(np.float64)
    shares = byte_counts(data, offsets) @ _MEMBERS
    out = dict(zip((*_GROUPS, "high", "control"), shares.T / size, strict=True))
    lines = shares[:, list(_GROUPS).index("line")] + 1
    starts, ends, rows = word_spans(data, offsets)
    words = np.bincount(rows, minlength=n)[:n].astype(np.float64)
    some = np.maximum(words, 1)
    for name in ("word_length", "longest_word", "bare_words", "capital_words", "ended_words"):
        out[name] = np.zeros(n)
    if starts.size:
        begin = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        lengths = ends - starts
        out["word_length"][rows[begin]] = np.add.reduceat(lengths, begin)
        out["longest_word"][rows[begin]] = np.log1p(np.maximum.reduceat(lengths, begin))
        del lengths
        bare = np.maximum.reduceat(np.frombuffer(data.tobytes().translate(_LETTER), np.uint8), starts) == 0
        head, last = data[starts], data[ends - 1]
        out["bare_words"] = grouped_sum(bare, rows, n)
        out["capital_words"] = grouped_sum((head >= 65) & (head <= 90), rows, n)
        out["ended_words"] = grouped_sum((last == 46) | (last == 33) | (last == 63), rows, n)
        for name in ("word_length", "bare_words", "capital_words", "ended_words"):
            out[name] = out[name] / some
    hashes = span_hashes(data, starts, ends)
    del starts, ends
    distinct, _, common = _repeats(hashes, rows, n)
    _, repeated, _ = _repeats(*windows(hashes, rows), n)
    del hashes, rows
    # lines by their bytes, empty ones left out
    edge = np.unique(np.concatenate([offsets[:-1], np.flatnonzero(data == 10) + 1]))
    edge = edge[edge < data.size]
    stop = np.append(edge[1:], data.size)
    line_rows = np.searchsorted(offsets[1:], edge, side="right")
    stop = np.where(data[stop - 1] == 10, stop - 1, stop) if edge.size else stop
    real = stop > edge
    line_distinct, _, _ = _repeats(span_hashes(data, edge[real], stop[real]), line_rows[real], n)
    real_lines = np.maximum(np.bincount(line_rows[real], minlength=n)[:n], 1)
    out["log_bytes"], out["log_words"], out["log_lines"] = np.log1p(np.diff(offsets)), np.log1p(words), np.log1p(lines)
    out["distinct_words"], out["repeated_windows"], out["most_common_word"] = distinct / some, repeated / some, common / some
    out["dup_lines"], out["line_words"] = 1 - line_distinct / real_lines, np.log1p(words / lines)
    x = np.stack([out[name] for name in FEATURES], axis=1)
    x[np.diff(offsets) == 0] = 0
    return x


@dataclass
class Forest:
    """Trees as arrays [tree, node]: the feature and edge that a node tests, and the value of a leaf. Node i has
    the children 2i + 1 (at most the edge) and 2i + 2."""

    base: float
    feature: np.ndarray
    edge: np.ndarray
    value: np.ndarray
    depth: int

    def probability(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, edge, value in zip(self.feature, self.edge, self.value, strict=True):
            node = np.zeros(len(x), np.intp)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > edge[node])
            total += value[node]
        return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def fit_forest(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE, least: int = LEAST_LEAF, ridge: float = RIDGE) -> Forest:
    """Gradient boosting of the logistic loss. Features are cut into bins once; each level of a tree adds up
    one histogram of gradients by node, feature and bin. Without rows every probability is a half."""
    n, m = x.shape
    nodes = 2 ** (depth + 1) - 1
    share = np.clip(y.mean(), 0.001, 0.999) if n else 0.5
    forest = Forest(float(np.log(share / (1 - share))), np.zeros((0, nodes), np.int64), np.zeros((0, nodes)), np.zeros((0, nodes)), depth)
    if not n or y.min() == y.max():
        return forest
    edges = np.stack([np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1]) for j in range(m)])
    binned = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(m)], axis=1)
    offset = binned + np.arange(m) * bins
    total, made = np.full(n, forest.base), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        gradient, curve = y - p, p * (1 - p)
        feature, edge, value = np.zeros(nodes, np.int64), np.full(nodes, np.inf), np.zeros(nodes)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            low, count = 2**level - 1, 2**level
            key = ((at - low)[:, None] * (m * bins) + offset).ravel()
            hist = [np.bincount(key, np.repeat(w, m), count * m * bins).reshape(count, m, bins).cumsum(axis=2) for w in (gradient, curve, np.ones(n))]
            g, h, c = (z[..., :-1] for z in hist)
            g1, h1, c1 = (z[..., -1:] for z in hist)
            gain = g**2 / (h + ridge) + (g1 - g) ** 2 / (h1 - h + ridge) - g1**2 / (h1 + ridge)
            gain = np.where((c >= least) & (c1 - c >= least), gain, 0).reshape(count, -1)
            best = gain.argmax(axis=1)
            good = gain[np.arange(count), best] > 1e-9
            j, b = best // (bins - 1), best % (bins - 1)
            feature[low : low + count] = np.where(good, j, 0)
            edge[low : low + count] = np.where(good, edges[j, b], np.inf)  # no split: all go left
            at = 2 * at + 1 + (x[np.arange(n), feature[at]] > edge[at])
        leaf_g, leaf_h = np.bincount(at, gradient, nodes), np.bincount(at, curve, nodes)
        value = rate * leaf_g / (leaf_h + ridge)
        total += value[at]
        made.append((feature, edge, value))
    return Forest(forest.base, *(np.stack(a) for a in zip(*made, strict=True)), depth)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 5, held_out: int = 0, train_rows: int = TRAIN_ROWS) -> Forest:
    """Fits on at most train_rows labelled rows outside the held-out fold, those whose ids hash least.

    The sample's ids are chosen in the labels alone and broadcast, at most train_rows of them, so no text is
    moved; statistics are computed on the executors. Of an id labelled more than once the larger label counts.
    """
    bound_batches(docs.sparkSession)
    named = labels.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("int").alias("label")).where("id is not null and label is not null")
    chosen = named.where(fold(F.col("id"), folds) != held_out).groupBy("id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(train_rows)
    chosen = docs.sparkSession.createDataFrame(chosen.toPandas(), "id long, label int")

    def run(text: pa.Array) -> pa.Array:
        x = statistics(text)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))

    @F.arrow_udf("array<double>")
    def measure(text: pa.Array) -> pa.Array:
        return by_slices(run)(text)

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).join(F.broadcast(chosen), "id")
    got = rows.select("id", "label", measure("text").alias("x")).dropDuplicates(["id"]).orderBy("id").limit(train_rows).toPandas()
    x = np.array(got["x"].tolist(), np.float64).reshape(-1, len(FEATURES))
    return fit_forest(x, got["label"].to_numpy().astype(np.float64))


def scorer(forest: Forest):
    """A column function from a text to its probability of quality 1."""

    def run(text: pa.Array) -> pa.Array:
        return pa.array(forest.probability(statistics(text)))

    @F.arrow_udf("double")
    def column(text: pa.Array) -> pa.Array:
        return by_slices(run)(text)

    return column


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 5, held_out: int = 0, threshold: float = 0.3, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """One row for each input row: doc_id, held_out, score, predicted.

    Only texts make a score. Null and empty texts have zeros for statistics and get a score too; repeated
    rows score alike; empty documents give an empty result, and without labels every score is a half; other
    columns, whatever their names, are ignored.
    """
    run = scorer(train(docs, labels, id_col, text_col, label_col, folds, held_out, train_rows))
    out = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), (fold(F.col(f"`{id_col}`"), folds) == held_out).alias("held_out"), run(F.col(f"`{text_col}`").cast("string")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
