"""Connected components over a table of links, by alternating large-star and small-star steps.

Every step is a grouped minimum and a join whose hot keys are broadcast with a proven bound, so a node with
very many links doesn't overload a task. The steps' tables go to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from statweave.llm.common import attach_group, materialise


def _star(links: DataFrame, total: int) -> DataFrame:
    """links (u, v), each with the least v of its u as m; size is for attach_group."""
    groups = links.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("size"))
    return attach_group(links, groups, "u", "size", total)


def _written(edges: DataFrame) -> tuple[DataFrame, int, int]:
    """edges, written, with how many there are and a sum of their hashes, both found while writing."""
    seen = Observation()
    counted = edges.distinct().observe(seen, F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("check"))
    table = materialise(counted, "edges")
    found = seen.get  # nothing where the optimiser saw that there are no rows
    return table, found.get("n") or 0, int(found.get("check") or 0)


def connected_components(links: DataFrame, max_rounds: int = 100) -> DataFrame:
    """links: a, b (long). Returns node, root for every linked node; root is the least node it reaches.

    Repeated links, self-links and an empty table are fine; null ends are ignored.
    """
    edges, total, check = _written(links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    before = None
    for _ in range(max_rounds):
        if not total or (total, check) == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = total, check
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, 2 * total).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        large = materialise(large.where("u <> v").distinct(), "large")
        small = _star(large, total)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        edges, total, check = _written(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")
