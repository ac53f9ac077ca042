"""Resumable processing: new files are taken once, finished keys are never done again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from statweave.sources.files import exists


def process_new_files(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, key: str, step: Callable[[DataFrame], DataFrame]) -> None:
    """Runs step over the JSON files in source that came since the last call and appends to target. A batch
    that is run again after a failure leaves out keys that target already holds without an error."""

    def batch(rows: DataFrame, _: int) -> None:
        if exists(spark, target):
            rows = rows.join(_good(spark.read.parquet(target)).select(key), key, "left_anti")
        step(rows).write.mode("append").parquet(target)

    stream = spark.readStream.schema(schema).json(source).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    stream.trigger(availableNow=True).start().awaitTermination()


def checkpointed(work: DataFrame, key: str, path: str, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """step over the rows of work whose key the checkpoint at path doesn't hold without an error, appended to it; returns
    all that it holds for work's keys, of a key that was tried again the good row. A call that is cut short is taken up by
    the next; finish deletes the checkpoint when the result is safe elsewhere."""
    spark = work.sparkSession
    left = work
    if exists(spark, path):
        done = spark.read.parquet(path)
        left = work.join(_good(done).select(key).distinct(), key, "left_anti")
    if not left.isEmpty():
        step(left).write.mode("append").parquet(path)
    if not exists(spark, path):
        return step(left)  # nothing to do, in step's columns
    held = spark.read.parquet(path)
    return _good(held).join(work.select(key).distinct(), key, "left_semi").dropDuplicates([key])


def _good(rows: DataFrame) -> DataFrame:
    return rows.where("error is null") if "error" in rows.columns else rows


def finish(spark: SparkSession, path: str) -> None:
    """Deletes a checkpoint, if there is one."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
