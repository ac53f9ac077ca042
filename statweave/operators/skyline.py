"""The Pareto front: rows that no other row beats."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Partitions whose fronts are merged into one, at each step of the tree.
FAN_IN = 8
#: Points that are compared at once with the front.
TILE = 512


def front(points: np.ndarray) -> np.ndarray:
    """The places of the points, of least values, that no point beats: none is as small everywhere and smaller once.
    Equal points stay together. What beats a point comes before it in the order of all columns, so one pass in that order,
    which compares only with what has been kept, finds them."""
    order = np.lexsort(points.T)
    kept = np.empty(0, dtype=np.int64)
    for at in range(0, len(order), TILE):
        some = order[at : at + TILE]
        for rest in range(0, len(kept), TILE):
            some = some[~_beaten(points[some], points[kept[rest : rest + TILE]])]
        kept = np.concatenate([kept, some[~_beaten(points[some], points[some])]])
    return np.sort(kept)


def _beaten(points: np.ndarray, by: np.ndarray) -> np.ndarray:
    no_worse, better = np.ones((len(points), len(by)), dtype=bool), np.zeros((len(points), len(by)), dtype=bool)
    for mine, theirs in zip(points.T, by.T, strict=True):
        no_worse &= theirs <= mine[:, None]
        better |= theirs < mine[:, None]
    return (no_worse & better).any(axis=1)


def pareto_front(rows: DataFrame, least: list[str], most: list[str]) -> DataFrame:
    """The rows of which no other is as good in all columns and better in one; least are better when smaller, most when
    greater. Rows with a null or no number there are left out; equal ones stay together.

    Each task keeps its own front, eight of which are merged by a task of the next step, so nothing but fronts moves; a
    task holds the front that it works out and one batch. Columns are compared as doubles.
    """
    named = [*least, *most]
    rows = rows.where(" and ".join(f"`{c}` is not null and not isnan(double(`{c}`))" for c in named))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            points = np.column_stack([held.column(c).cast(pa.float64()).to_numpy() * (1 if i < len(least) else -1) for i, c in enumerate(named)])
            held = held.take(pa.array(front(points)))
        if held is not None:
            yield from held.to_batches()

    out = rows.mapInArrow(local, rows.schema)
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while width > 1:
        width = -(-width // FAN_IN)
        out = out.repartition(width, F.spark_partition_id() % width).mapInArrow(local, rows.schema)
    return out
