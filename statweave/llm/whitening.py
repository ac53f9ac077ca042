"""Whitening of embeddings: exact covariances by digit-slice matrix products, then an eigendecomposition.

Entries become whole numbers. Each task cuts them, less their mean's whole part, into limbs of 16 bits; the products of
limb matrices are sums below 2^53, so float64 BLAS makes them without rounding. The products are put together as
big integers, cut into planes that Spark can add as longs, and merged by a grouped sum. The driver gets one exact number
for each pair of dimensions and decomposes the matrix.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statweave.llm.common import bound_batches, materialise

#: c becomes floor(SCALE * c) + SHIFT; SCALE * c is held within LARGEST either way.
SCALE, SHIFT, LARGEST = 64, 1_000_000, float(1 << 53)
#: Components that are returned, and dimensions that a vector may have.
COMPONENTS, MAX_DIMS = 16, 1024
#: Bits of a limb and of a plane, planes, and rows of one product: 2 * 16 bits and 2^20 rows stay below 2^53.
LIMB, PLANE, PLANES, PRODUCT_ROWS = 16, 40, 4, 1 << 20
#: A component with less than this share of the first one's variance can't be told from none in double precision.
LEAST_SHARE = 1e-11


def whole_numbers(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """vec_id and x, an array of longs, of the rows whose vector is usable."""
    vec = F.col(f"`{vec_col}`").cast("array<double>")
    usable = vec.isNotNull() & F.forall(vec, lambda c: F.coalesce(F.abs(c) < F.lit(float("inf")), F.lit(False)))  # NaN is above infinity
    x = F.transform(vec, lambda c: F.floor(F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), c * SCALE))) + SHIFT)
    return rows.where(usable).select(F.col(f"`{id_col}`").alias("vec_id"), x.alias("x"))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """The rows of a list column of equal lengths."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)


def limbs(z: np.ndarray) -> list[np.ndarray]:
    """z as digits of LIMB bits, lowest first, as float64; the last one is signed."""
    out = []
    while z.size and max(abs(int(z.min())), abs(int(z.max()))) >= 1 << (LIMB - 1):
        out.append((z & ((1 << LIMB) - 1)).astype(np.float64))
        z = z >> LIMB
    return [*out, z.astype(np.float64)]


def exact_gram(z: np.ndarray) -> np.ndarray:
    """z' z of whole numbers, as Python's integers."""
    total = np.zeros((z.shape[1], z.shape[1]), object)
    for i in range(0, len(z), PRODUCT_ROWS):
        digits = limbs(z[i : i + PRODUCT_ROWS])
        for a, left in enumerate(digits):
            for b in range(a, len(digits)):
                product = (left.T @ digits[b]).astype(np.int64).astype(object)
                total += (product if a == b else product + product.T) << (LIMB * (a + b))
    return total


def planes(values: np.ndarray) -> list[np.ndarray]:
    """Python's integers as PLANES longs each, lowest first; the last one is signed."""
    out, low = [], (1 << PLANE) - 1
    for _ in range(PLANES - 1):
        out.append((values & low).astype(np.int64))
        values = values >> PLANE
    return [*out, values.astype(np.int64)]


def _from_planes(row) -> int:
    return sum(int(row[f"p{k}"]) << (PLANE * k) for k in range(PLANES))


def _merged(parts: DataFrame, *keys: str) -> dict[tuple, int]:
    """The exact sums of the tasks' parts by key. There are as many keys as entries of one matrix, at most."""
    sums = parts.groupBy(*keys).agg(*[F.sum(f"p{k}").alias(f"p{k}") for k in range(PLANES)])
    return {tuple(r[k] for k in keys): _from_planes(r) for r in sums.toLocalIterator()}


def _sums(dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(dims, object)
        for batch in batches:
            x = matrix(batch.column("x"), dims)
            low = (1 << 27) - 1
            total += (x & low).sum(axis=0).astype(object) + ((x >> 27).sum(axis=0).astype(object) << 27)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims, dtype=np.int32)), *map(pa.array, planes(total))], ["i", *(f"p{k}" for k in range(PLANES))])

    return run


def _grams(pivot: np.ndarray):
    dims = len(pivot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims), object)
        for batch in batches:
            total += exact_gram(matrix(batch.column("x"), dims) - pivot)
        i, j = np.triu_indices(dims)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), *map(pa.array, planes(total[i, j]))], ["i", "j", *(f"p{k}" for k in range(PLANES))])

    return run


@dataclass(frozen=True)
class Whitening:
    """What whitens a vector of dims whole numbers. sums are over the n distinct vectors; their mean is pivot + rest / n.
    axes has a component in each column, divided by the root of its variance, 0 without any; explained is its share."""

    n: int
    sums: tuple[int, ...]
    axes: np.ndarray
    explained: np.ndarray

    @property
    def pivot(self) -> np.ndarray:
        return np.array([s // self.n for s in self.sums], np.int64)

    @property
    def rest(self) -> np.ndarray:
        return np.array([s % self.n for s in self.sums], np.int64)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.pivot) - self.rest / self.n) @ self.axes

    def deviations(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict[int, int]]:
        """For each row the sum of squares of n * x - sums, as a long; whether it fits one; and those that don't."""
        y = self.n * (x - self.pivot) - self.rest
        out = (y * y).sum(axis=1)  # wraps only where the sum is too large for a long
        fits = (((x - self.pivot) * float(self.n) - self.rest) ** 2).sum(axis=1) < 9e18
        large = {}
        for i in np.flatnonzero(~fits).tolist():
            exact = sum((self.n * v - s) ** 2 for v, s in zip(x[i].tolist(), self.sums, strict=True))
            fits[i] = exact < 1 << 63
            if not fits[i]:
                large[i] = exact
        return out, fits, large


def fit(distinct: DataFrame, dims: int, components: int = COMPONENTS) -> Whitening:
    """distinct: x, each vector once. Two passes: the sums, then the products of what is left after the mean's whole
    part; the rest of the mean is taken out exactly by n * sum(z z') - r r', which is n * n times the covariance."""
    n = distinct.count()
    sums = _merged(distinct.mapInArrow(_sums(dims), "i int, p0 long, p1 long, p2 long, p3 long"), "i")
    sums = tuple(sums[(i,)] for i in range(dims))
    start = Whitening(n, sums, np.zeros((dims, 0)), np.zeros(0))
    products = _merged(distinct.mapInArrow(_grams(start.pivot), "i int, j int, p0 long, p1 long, p2 long, p3 long"), "i", "j")
    rest, cov, trace = [s % n for s in sums], np.zeros((dims, dims)), 0
    for (i, j), g in products.items():
        exact = n * g - rest[i] * rest[j]
        cov[i, j] = cov[j, i] = exact / (n * n)
        trace += exact if i == j else 0
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values, kind="stable")[:components]
    values, vectors = values[order], vectors[:, order]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(order))])
    some = values > LEAST_SHARE * max(float(values[0]), 0.0)
    scale = np.where(some, 1 / np.sqrt(np.where(some, values, 1.0)), 0.0)
    whole = trace / (n * n)
    return Whitening(n, sums, vectors * scale, np.where(some, values / whole, 0.0) if whole else np.zeros(len(order)))


def _moments(model: Whitening):
    dims, k = model.axes.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, square = 0, np.zeros(k), np.zeros((k, k))
        for batch in batches:
            w = model.whitened(matrix(batch.column("x"), dims))
            m = len(w)
            if not m:
                continue
            own = w.mean(axis=0)
            shift = own - mean
            square += (w - own).T @ (w - own) + np.outer(shift, shift) * (n * m / (n + m))
            n, mean = n + m, mean + shift * (m / (n + m))
        i, j = np.triu_indices(k)
        columns = [i.astype(np.int32), j.astype(np.int32), np.full(len(i), float(n)), n * mean[i], n * mean[j], n * mean[i] * mean[j], square[i, j]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["i", "j", "n", "a", "b", "ab", "square"])

    return run


def identity_error(distinct: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened vectors' covariance less the identity, over components with variance.
    Products are centred on each task's mean; the tasks' means are brought together by a grouped sum."""
    parts = distinct.mapInArrow(_moments(model), "i int, j int, n double, a double, b double, ab double, square double")
    cov = (F.sum("square") + F.sum("ab") - F.sum("a") * F.sum("b") / F.sum("n")) / F.sum("n")
    some = [k for k in range(model.axes.shape[1]) if model.explained[k] > 0]
    off = parts.where(F.col("i").isin(some) & F.col("j").isin(some)).groupBy("i", "j").agg(F.abs(cov - F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0)).alias("off"))
    return off.agg(F.max("off")).first()[0] or 0.0


def _rows(model: Whitening, error: float):
    dims, k = model.axes.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("x"), dims)
            m = len(x)
            deviation, fits, large = model.deviations(x)
            take = pa.array(np.repeat(np.arange(m), k))
            exact = pa.array([None if fits[i] else str(large[i]) for i in range(m)], pa.string())
            columns = [
                batch.column("vec_id").take(take), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n)), pa.array(deviation, mask=~fits).take(take),
                pa.array(model.whitened(x).reshape(-1)), pa.array(np.tile(model.explained, m)), pa.array(np.full(m * k, error)), exact.take(take),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_exact"])

    return run


def whiten(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """For each usable row and component, of which there are at most so many and as many as dimensions: vec_id,
    component (1 has the greatest variance), n, deviation, whitened, explained, identity_error and deviation_exact.

    Rows whose vector is null, or holds null or non-finite entries, are left out. Each distinct vector of whole numbers
    counts once in the fit, so copies, however many, weigh nothing; they are told apart by a grouping that combines
    within tasks first. Shorter vectors are continued with zeros; more than MAX_DIMS dimensions are an error. A
    component of no variance (under LEAST_SHARE of the first one's) has whitened and explained 0 and doesn't enter
    identity_error. deviation is null beyond a long's range, and deviation_exact then holds its digits, else null. Ids
    may be null or repeated; a table without usable rows gives an empty result; other columns, whatever their names,
    are ignored. The driver gets one number for each pair of dimensions.
    """
    spark = rows.sparkSession
    bound_batches(spark)
    table = whole_numbers(rows, id_col, vec_col)
    dims = table.agg(F.max(F.size("x"))).first()[0] or 0
    if dims > MAX_DIMS:
        raise ValueError(f"vectors of {dims} dimensions; at most {MAX_DIMS} are taken")
    kind = dict(table.dtypes)["vec_id"]
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact string"
    if not dims:
        return spark.createDataFrame([], schema)
    table = table.withColumn("x", F.concat("x", F.array_repeat(F.lit(SHIFT).cast("long"), F.lit(dims) - F.size("x"))))
    distinct = materialise(table.select("x").distinct(), "distinct_vectors")
    model = fit(distinct, dims, components)
    return table.mapInArrow(_rows(model, identity_error(distinct, model)), schema)
