"""Vector retrieval over query tables: exact top-k, exclusion, gating, two-hop expansion, contexts."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_, or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statweave.functions.vectors import cosine
from statweave.session import cut_lineage

#: Bytes of query vectors that are broadcast at once; more queries are searched in blocks.
QUERY_BYTES = 32 << 20
#: Queries and rows whose distances a task holds at once: 16 MB of them.
TILE = 1448


def metadata_condition(where: dict) -> Column:
    """A filter over metadata columns, to be applied before ranking. Keys are columns with a value (equality) or
    {"$eq" | "$ne" | "$in" | "$nin": ...}; "$and" and "$or" hold lists of filters; keys beside each other all
    must hold. A null doesn't equal any value, so "$ne" and "$nin" keep it."""
    parts = []
    for key, want in where.items():
        if key in ("$and", "$or"):
            parts.append(reduce(and_ if key == "$and" else or_, map(metadata_condition, want)))
            continue
        for op, value in (want if isinstance(want, dict) else {"$eq": want}).items():
            if op not in ("$eq", "$ne", "$in", "$nin"):
                raise ValueError(f"unknown operator {op}")
            held = F.coalesce(F.col(key).isin(*(value if op in ("$in", "$nin") else [value])), F.lit(False))
            parts.append(~held if op in ("$ne", "$nin") else held)
    return reduce(and_, parts, F.lit(True))


def renamed_filter(where: dict | None, names: dict[str, str]) -> dict | None:
    """The same filter over columns of other names, inside "$and" and "$or" too."""
    if where is None:
        return None
    return {names.get(k, k): [renamed_filter(x, names) for x in v] if k in ("$and", "$or") else v for k, v in where.items()}


def exclude(index: DataFrame, column: str, held_out: DataFrame) -> DataFrame:
    """Rows whose column is not in the held-out set; null stays."""
    return index.join(held_out.select(F.col(held_out.columns[0]).alias(column)).distinct(), column, "left_anti")


def cosine_topk(queries: DataFrame, index: DataFrame, k: int, query_bytes: int = QUERY_BYTES, later_first: bool = False) -> DataFrame:
    """queries (qid long, vector), index (id long, vector): qid, id, distance, rank of each query's k nearest.

    One block of queries goes to every task, which multiplies it with batches of the index and keeps k rows a
    query; only those rows shuffle for the final ranking. Queries beyond query_bytes make further blocks.
    Ties go to the smaller id, or with later_first to the larger; a zero vector is at distance 1. A vector that is null
    or holds a null, as a failed embedding leaves it, is found by no query and finds nothing; all others have one length.
    """
    spark = queries.sparkSession
    queries, index = (df.where(usable(F.col("vector"))) for df in (queries, index))
    n = queries.count()
    width = queries.select(F.max(F.size("vector"))).first()[0] or 1
    block = max(1, query_bytes // (8 * width))
    out = None
    numbered = queries if n <= block else queries.withColumn("block", F.pmod(F.xxhash64("qid"), F.lit(-(-n // block) * 2)))
    blocks = [numbered] if n <= block else [numbered.where(F.col("block") == b) for b in range(-(-n // block) * 2)]
    for part in blocks:
        rows = part.select("qid", F.col("vector").cast("array<double>")).toArrow()
        if not rows.num_rows:
            continue
        vectors = np.array(rows.column("vector").to_pylist(), np.float64)
        held = spark.sparkContext.broadcast((rows.column("qid").to_numpy(), _unit(vectors)))
        near = index.select("id", F.col("vector").cast("array<double>").alias("vector")).mapInArrow(_nearest(held, k, later_first), "qid long, id long, distance double")
        out = near if out is None else out.unionByName(near)
    if out is None:
        return spark.createDataFrame([], "qid long, id long, distance double, rank long")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("distance", F.desc("id") if later_first else "id")).cast("long")
    return out.withColumn("rank", rank).where(F.col("rank") <= k)


def usable(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull())


def _unit(x: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, length, out=np.zeros_like(x), where=length > 0)


def _nearest(held, k: int, later_first: bool):
    """Each task's k nearest of every query, found a tile of queries and rows at a time: of a tile what is no farther
    than its k-th nearest, and no farther than the k-th so far, is merged with what was found before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qid, queries = held.value
        near, ids, rows = np.full((len(qid), k), np.inf), np.zeros((len(qid), k), np.int64), 0
        for batch in batches:
            names = batch.column("id").to_numpy()
            column = batch.column("vector")
            x = _unit(column.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, queries.shape[1])))
            rows += len(x)
            for i in range(0, len(x), TILE):
                for j in range(0, len(qid), TILE):
                    _merge(near[j : j + TILE], ids[j : j + TILE], 1 - queries[j : j + TILE] @ x[i : i + TILE].T, names[i : i + TILE], k, later_first)
        if rows:
            found = near < np.inf
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qid, found.sum(axis=1))), pa.array(ids[found]), pa.array(near[found])], names=["qid", "id", "distance"])

    return run


def _merge(near: np.ndarray, ids: np.ndarray, distance: np.ndarray, names: np.ndarray, k: int, later_first: bool) -> None:
    most = near[:, -1]
    if distance.shape[1] > k:
        most = np.minimum(most, np.partition(distance, k - 1, axis=1)[:, k - 1])
    row, column = np.nonzero(distance <= most[:, None])
    touched = np.unique(row)
    old = near[touched] < np.inf
    row = np.concatenate([np.repeat(touched, old.sum(axis=1)), row])
    d = np.concatenate([near[touched][old], distance[row[old.sum() :], column]])
    name = np.concatenate([ids[touched][old], names[column]])
    order = np.lexsort((-name if later_first else name, d, row))
    row, d, name = row[order], d[order], name[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    row, d, name, place = (v[place < k] for v in (row, d, name, place))
    near[row, place], ids[row, place] = d, name


def gate(hits: DataFrame, queries: DataFrame, most: float | None) -> DataFrame:
    """All queries with how many hits are near enough; none left means the query falls back to no context."""
    kept = hits if most is None else hits.where(F.col("distance") <= most)
    counted = kept.groupBy("qid").agg(F.count(F.lit(1)).alias("kept"))
    return queries.select("qid").distinct().join(counted, "qid", "left").select("qid", F.coalesce("kept", F.lit(0)).alias("kept"), F.col("kept").isNull().alias("zero_shot"))


def numbered_context(hits: DataFrame, document: str, *keys: str) -> DataFrame:
    """keys (qid by default) and context: the documents by rank, each after its number."""
    lines = F.array_sort(F.collect_list(F.struct("rank", F.concat(F.lit("["), F.col("rank"), F.lit("] "), F.col(document)).alias("line"))))
    keys = keys or ("qid",)
    return hits.groupBy(*keys).agg(lines.alias("l")).select(*keys, F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("context"))


def prose_context(hits: DataFrame, document: str, prefix: str = "According to the available data, ") -> DataFrame:
    """The facts as sentences in order: a leading article in lower case, no trailing dots, joined, one dot."""
    plain = F.regexp_replace(F.regexp_replace(F.col(document), "^The ", "the "), r"\.+$", "")
    lines = F.array_sort(F.collect_list(F.struct("rank", plain.alias("line"))))
    return hits.groupBy("qid").agg(lines.alias("l")).select("qid", F.concat(F.lit(prefix), F.array_join(F.transform("l", lambda x: x["line"]), ". "), F.lit(".")).alias("context"))


def retrieved(hits: DataFrame, document: str, *keys: str) -> DataFrame:
    """keys (qid by default) and retrieved: the documents by rank."""
    keys = keys or ("qid",)
    lines = F.array_sort(F.collect_list(F.struct("rank", F.col(document).alias("line"))))
    return hits.groupBy(*keys).agg(F.transform(lines, lambda x: x["line"]).alias("retrieved"))


def adjacency(triples: DataFrame, most: int) -> DataFrame:
    """Each subject's first triples (id, subject, document) by id, with their place (at) from 1: what an index keeps beside
    it, so that a subject with very many never meets every query with all of them."""
    at = F.row_number().over(Window.partitionBy("subject").orderBy("id"))
    return triples.select("id", "subject", "document").withColumn("at", at).where(F.col("at") <= most)


def two_hop(hits: DataFrame, triples: DataFrame, k: int, adjacent: DataFrame | None = None) -> DataFrame:
    """hits (qid, id, rank) and further triples (id, subject, document) with a hit's subject, at most 3k by id;
    hop one first, documents once, the first k: qid, document, rank.

    Of a subject, a query can use its first 3k triples and as many more as it has hits, which are left out. adjacent, if
    given, is an adjacency of that many at least; without it, that of the hits' subjects is worked out."""
    # a few rows for each query, looked at three times: the search behind them runs once
    first = cut_lineage(hits.join(triples, "id").select("qid", "id", "rank", "subject", "document"))
    subjects = first.select("qid", "subject").distinct()
    most = 3 * k + (first.groupBy("qid", "subject").count().agg(F.max("count")).first()[0] or 0)
    if adjacent is None:
        adjacent = adjacency(triples.join(first.select("subject").distinct(), "subject", "left_semi"), most)
    more = subjects.join(adjacent.where(F.col("at") <= most).drop("at"), "subject").join(first.select("qid", "id"), ["qid", "id"], "left_anti")
    more = more.withColumn("pos", F.row_number().over(Window.partitionBy("qid").orderBy("id"))).where(F.col("pos") <= 3 * k)
    both = first.select("qid", "document", F.lit(1).alias("hop"), F.col("rank").cast("int").alias("pos")).unionByName(more.select("qid", "document", F.lit(2).alias("hop"), "pos"))
    once = both.groupBy("qid", "document").agg(F.min(F.struct("hop", "pos")).alias("at"))
    ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("at", "document")).cast("long"))
    return ranked.where(F.col("rank") <= k).select("qid", "document", F.col("at.hop").cast("long").alias("hop"), "rank")


def centroid(vectors: DataFrame, *keys: str) -> DataFrame:
    """Elementwise mean by key: keys, pos, value; partial sums before the shuffle."""
    return vectors.select(*keys, F.posexplode("vector").alias("pos", "x")).groupBy(*keys, F.col("pos").cast("long").alias("pos")).agg(F.avg(F.col("x").cast("double")).alias("value"))


def centroid_scores(candidates: DataFrame, anchors: DataFrame) -> DataFrame:
    """id, score: cosine to the mean anchor, one vector whatever the number of anchors."""
    middle = centroid(anchors).groupBy().agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"]).alias("middle"))
    return candidates.join(F.broadcast(middle)).select("id", F.round(cosine(F.col("vector"), F.col("middle")), 4).alias("score"))


def first_hits(hits: DataFrame, n: int) -> DataFrame:
    """The n best of each query by rank, ranked anew."""
    order = Window.partitionBy("qid").orderBy("rank", *[c for c in hits.columns if c not in ("qid", "rank")])
    return hits.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= n)
