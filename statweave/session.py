"""A session with the settings that the engine is designed for."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "statweave", master: str | None = None, **settings: str) -> SparkSession:
    """Adaptive execution with skew-join splitting and partition coalescing; other settings can be overridden."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC", "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in (defaults | settings).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_tables: list[str] = []


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names, deleted by release_tables, at the latest when Python
    ends. Only where the setting is missing, and all runs on one machine, is a local folder taken; on a cluster, where
    each executor would see another folder, that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="statweave-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if not _tables:
        atexit.register(release_tables)
    _tables.append(f"{folder.rstrip('/')}/statweave-loop/{name}{uuid.uuid4().hex}")
    return _tables[-1]


def cut_lineage(df: DataFrame) -> DataFrame:
    """df, written as a table in the shared folder and read again, so that a loop's plan stays small, nothing is worked
    out twice and a lost executor costs no recomputation."""
    path = shared_path(df.sparkSession, "")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release_tables() -> None:
    """Deletes what is at shared paths; frames that read it must be done with."""
    spark = SparkSession.getActiveSession()
    paths, _tables[:] = list(_tables), []
    if spark is None or spark.sparkContext._jsc is None:  # without a session only local folders can be reached
        for p in paths:
            if p.startswith("file:"):
                shutil.rmtree(p.removeprefix("file://").removeprefix("file:"), ignore_errors=True)
        return
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)
