"""A category tree searched breadth first, and the choice of its articles by their likeness to anchors.

Order matters: the queue holds categories in the order of their parents and of the listings, an article belongs to the
first category that lists it, and the search ends after the category with which there are enough articles. A
category's place in the queue is the path of listing positions that leads to it, which sorts as the queue does, so each
level is a join and needs no numbering.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statweave.functions import text as T
from statweave.operators import retrieval as R
from statweave.session import cut_lineage

#: Takes a frame of keys; returns key, item, position (and perhaps error).
Listing = Callable[[DataFrame], DataFrame]


def listing(table: DataFrame) -> Listing:
    """A listing from a table of key, item, position."""
    return lambda keys: keys.join(table, "key").select("key", "item", "position")


def crawl(roots: DataFrame, pages: Listing, subcategories: Listing, skip: tuple[str, ...] = (), max_depth: int = 3, max_articles: int = 30_000) -> DataFrame:
    """roots (category, position): title, depth, category and place of every article found. Categories whose name holds
    one of skip, in any case, are neither asked for nor searched; those seen before aren't searched again, so cycles
    end. max_articles ends the search between two categories, so there can be a few more."""
    spark = roots.sparkSession
    named = lambda df: df.where(~T.contains_any(F.col("category"), skip)) if skip else df
    first = lambda df: df.groupBy("category").agg(F.min("path").alias("path"))
    level = cut_lineage(named(first(roots.select("category", F.array(F.col("position").cast("long")).alias("path")))))
    seen = level.select("category")
    found = spark.createDataFrame([], "title string, depth long, category string, path array<long>, position long")
    total = 0
    for depth in range(max_depth + 1):
        listed = pages(level.select(F.col("category").alias("key"))).where("item is not null")
        new = listed.join(level, listed["key"] == level["category"]).groupBy(F.col("item").alias("title")).agg(F.min(F.struct("path", "position", "category")).alias("at"))
        new = cut_lineage(new.join(found.select("title"), "title", "left_anti").select("title", F.lit(depth).cast("long").alias("depth"), "at.category", "at.path", "at.position"))
        more = new.count()
        if total + more >= max_articles:  # in a window over this level's categories alone, and once
            counts = new.groupBy("category", "path").agg(F.count(F.lit(1)).alias("n"))
            before = F.coalesce(F.sum("n").over(Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
            kept = counts.withColumn("before", before).where(F.col("before") + total < max_articles).select("category")
            found = found.unionByName(new.join(kept, "category", "left_semi"))
            break
        found, total = found.unionByName(new), total + more
        if depth == max_depth:
            break
        children = subcategories(level.select(F.col("category").alias("key"))).where("item is not null")
        deeper = children.join(level.withColumnRenamed("category", "key"), "key").select(F.col("item").alias("category"), F.concat("path", F.array(F.col("position").cast("long"))).alias("path"))
        level = cut_lineage(named(first(deeper)).join(seen, "category", "left_anti"))
        if level.isEmpty():
            break
        seen = seen.unionByName(level.select("category"))
    return found.select("title", "depth", "category", F.concat("path", F.array("position")).alias("place"))


def scored(candidates: DataFrame, anchors: DataFrame) -> DataFrame:
    """candidates (title, depth, category, place, vector) and anchors (vector): score, the cosine to the anchors' mean to
    four places, zero for a zero vector."""
    of = R.centroid_scores(candidates.select(F.col("title").alias("id"), "vector"), anchors)
    return candidates.drop("vector").join(of.withColumnRenamed("id", "title"), "title")


def accepted(scored_: DataFrame, threshold: float = 0.65, target: int = 10_000) -> DataFrame:
    """Those that reach the threshold, best first, at most target; equal scores stay in the order of the crawl: rank,
    title, score, depth, category."""
    order = [F.desc("score"), F.size("place"), "place"]
    rows = scored_.where(F.col("score") >= threshold).orderBy(*order).limit(target)
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long")).select("rank", "title", "score", "depth", "category")


def most_common(rows: DataFrame, column: str, first: list, n: int | None = None) -> DataFrame:
    """Values and how often each occurs, most frequent first; equal counts by where a value is first seen."""
    counts = rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*first)).alias("__first")).orderBy(F.desc("n"), "__first")
    return (counts if n is None else counts.limit(n)).select(column, "n")
