"""From documents to packed sequences: language, quality, exact copies, near copies, packing.

Each stage works on all that the one before it kept. Its result is written and read again before the next
stage is called, so a stage's intermediate tables are deleted when the next begins.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statweave.llm import common, exact_dedup, langid, packing, quality_gbt, simhash

#: Below this score a language is not taken as known, and the document goes; texts unlike all learned ones score 0.
LEAST_LANGUAGE_SCORE = 0.2
#: Documents with a lower probability of quality go.
LEAST_QUALITY = 0.3
#: Rows that a stage drops by a broadcast, at most; more of them are dropped by a shuffled join.
BROADCAST_ROWS = 200_000

_before: list[str] = []


def _stage(function: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        common.release(_before)
        common.collect_garbage(spark)
        standing = set(common.tables())
        out = function(spark, docs, sf_dir)
        _before[:] = [t for t in common.tables() if t not in standing]
        return out

    return run


@_stage
def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is recognised.

    Null texts and texts without a letter go, as do those unlike all learned languages; without labelled rows
    nothing is recognised and all go. Repeated rows and ties fare alike, ids don't matter, other columns stay as
    they are, whatever their names, and an empty table stays empty.
    """
    predict = langid.predictor(langid.train(docs))
    name = common.free_name(docs.columns, "found")
    found = docs.withColumn(name, predict(F.col("text")))
    return found.where((F.col(name)["lang"] != langid.UNKNOWN) & (F.col(name)["score"] >= LEAST_LANGUAGE_SCORE)).drop(name)


@_stage
def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the quality classifier accepts.

    Null and empty texts are scored like any other, as texts without words; without labels every score is a half
    and all stay. Repeated rows and ties fare alike, other columns stay as they are, whatever their names, and an
    empty table stays empty.
    """
    score = quality_gbt.scorer(quality_gbt.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    name = common.free_name(docs.columns, "found")
    return docs.withColumn(name, score(F.col("text"))).where(F.col(name) >= LEAST_QUALITY).drop(name)


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs, written with a number for each row, and that column's name, which is none of docs'."""
    name = common.free_name(docs.columns, "row")
    return common.materialise(docs.withColumn(name, F.monotonically_increasing_id()), "numbered"), name


def _without(rows: DataFrame, name: str, dropped: DataFrame) -> DataFrame:
    """rows less those whose number is in dropped. Few numbers are broadcast, after they are counted, so that no
    text moves; more are joined by a shuffle."""
    dropped = common.materialise(dropped.select(F.col("rid").alias(name)), "dropped")
    few = dropped.count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(dropped) if few else dropped.hint("shuffle_merge"), name, "left_anti").drop(name)


@_stage
def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of texts equal without white space: that with the most characters, of
    those the least id, nulls last, of repeated rows the first.

    Null, empty and blank texts are one group. Other columns stay as they are, whatever their names, and an empty
    table stays empty.
    """
    rows, name = _numbered(docs)
    return _without(rows, name, exact_dedup.exact_dedup(rows, row_col=name).where("not kept"))


@_stage
def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group linked by SimHash: that of the smallest id, nulls last, of rows of one id
    the first.

    Groups are known by a fingerprint of theirs, not by an id, so unlike texts with null or equal ids all stay.
    Texts without words are one group. Other columns stay as they are, whatever their names, and an empty table
    stays empty.
    """
    rows, name = _numbered(docs)
    groups = common.materialise(simhash.simhash_groups(rows, row_col=name), "near_groups")
    kept = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("best")).select("best.rid")
    return _without(rows, name, groups.join(kept, "rid", "left_anti"))


@_stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows of 1024 tokens, in packing.pack's columns.

    Null and empty texts are the end id alone, repeated rows are packed each by itself, ids may be null, other
    columns are left out, whatever their names, and an empty table has no pieces.
    """
    return packing.pack(docs)


STAGES = [("language", known_language), ("quality", good_quality), ("exact_dedup", without_copies), ("near_dedup", without_near_copies), ("packing", packed)]
ORACLE_SQL = None  # three stages are models or searches that SQL doesn't express


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    last: list[str] = []
    for name, stage in STAGES:
        docs = common.materialise(stage(spark, docs, sf_dir), name)
        common.release(last)
        last = common.tables()[-1:]
    common.release(_before)
    return docs
