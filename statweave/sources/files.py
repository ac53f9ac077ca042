"""Readers and writers of the engine's file formats; all through Spark, so any store that Spark reads will do."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, FractionalType, NumericType

from statweave.functions import text as T
from statweave.session import cut_lineage
from statweave.sources.json_entries import array_of, object_of, write_object

CORPUS = "struct<sentences: array<string>, full_text: string, sentence_count: bigint, text_length: bigint>"
TRIPLE = "subject string, relation string, object string, source_topic string, source_sentences string, extraction_method string"
RESULT = (
    "query string, model string, method string, answer string, retrieved_triples array<struct<document: string, subject: string, relation: string, object: string, source_topic: string, source: string>>, "
    "top_k int, granularity string, latency_ms double, token_usage map<string, bigint>, error string, context string, retrieval_ms double, generation_ms double"
)
BENCHMARK = "id bigint, question string, gold_triple struct<subject: string, relation: string, object: string>, gold_numbers array<string>, source_topic string"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder, in whatever store the path names."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def topics(spark: SparkSession, path: str, *others: str, distinct: bool = False) -> DataFrame:
    """One trimmed title a line, blank lines dropped, from the first of the paths that there is."""
    found = next((p for p in (path, *others) if exists(spark, p)), path)
    out = spark.read.text(found).select(T.strip(F.col("value")).alias("topic")).where("topic <> ''")
    return out.distinct() if distinct else out


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """The relations of a schema file, in its order: position, relation, description, example, and the line that names
    the relation in a prompt."""
    kind = "struct<relations: array<struct<name: string, description: string, example: string>>>"
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", kind)["relations"]).alias("position", "r"))
    line = F.concat(F.lit("- "), "r.name", F.lit(": "), "r.description", F.lit(" (e.g., "), "r.example", F.lit(")"))
    return rows.select("position", F.col("r.name").alias("relation"), "r.description", "r.example", line.alias("line"))


def vocabulary_prompt(vocabulary_: DataFrame) -> str:
    """All relations' lines, in order; a schema has a few dozen."""
    return "\n".join(r.line for r in vocabulary_.orderBy("position").collect())


@dataclass(frozen=True)
class Domain:
    """What a crawl starts from and leaves out."""

    roots: tuple[str, ...]
    anchors: tuple[str, ...]
    skip: tuple[str, ...]

    def overlaid(self, text: str | None) -> Domain:
        """With the settings of a domain's JSON file, where there is one: other roots or anchors, patterns that are no
        longer skipped, and patterns that are skipped besides."""
        given = json.loads(text) if text else {}
        kept = [p for p in self.skip if p not in given.get("unskip", ())]
        return Domain(tuple(given.get("root_categories", self.roots)), tuple(given.get("anchor_titles", self.anchors)), (*kept, *given.get("extra_skip", ())))


def domain(spark: SparkSession, path: str, default: Domain) -> Domain:
    return default.overlaid(spark.read.text(path, wholetext=True).first().value if exists(spark, path) else None)


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """JSON objects keyed by topic, a file of any size read by many tasks."""
    return object_of(spark, path, CORPUS).select(F.col("key").alias("topic"), "value.*")


def write_corpus(corpus_: DataFrame, path: str) -> None:
    """A corpus (topic, sentences, full_text, sentence_count, text_length) as JSON objects keyed by topic, one a task."""
    entry = F.struct("sentences", "full_text", "sentence_count", "text_length")
    replaced(corpus_.sparkSession, path, lambda p: write_object(corpus_, F.col("topic"), entry, p))


def flat_sentences(corpus_: DataFrame) -> DataFrame:
    return corpus_.select("topic", F.posexplode("sentences").alias("pos", "sentence"))


def triples(spark: SparkSession, path: str, source: str = "llm") -> DataFrame:
    """JSON lines, one triple each; lines that don't parse are dropped."""
    rows = spark.read.text(path).select(F.from_json("value", TRIPLE).alias("t")).select("t.*")
    return rows.where("coalesce(subject, relation, object) is not null").withColumn("source", F.lit(source))


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def table_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, multiLine=True, escape='"')


def held_out_topics(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of titles."""
    return array_of(spark, path, "string").select(F.col("value").alias("topic")).distinct()


def file_name() -> Column:
    """The name of a row's file, or of the log's folder where a log is a folder of part files."""
    path = F.col("_metadata.file_path")
    return F.coalesce(F.nullif(F.regexp_extract(path, r"([^/]+\.jsonl)/[^/]*$", 1), F.lit("")), F.regexp_extract(path, "([^/]+)$", 1))


def results(spark: SparkSession, directory: str, aliases: dict[str, str] | None = None) -> DataFrame:
    """All result logs of a directory; method and model come from the name, split at its last underscore, and
    old method names can be mapped to new ones."""
    rows = spark.read.schema(RESULT).json(f"{directory}/*.jsonl").withColumn("file", file_name())
    part = lambda i: F.regexp_extract("file", r"^(.*)_([^_]+)\.jsonl$", i)
    method = part(1)
    if aliases:
        method = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv]), part(1)), part(1))
    return rows.where(F.col("file").contains("_")).withColumns({"method": method, "model": part(2)}).drop("file")


def replaced(spark: SparkSession, path: str, write: Callable[[str], object]) -> None:
    """Writes beside path and renames, so that path holds all of the old or all of the new, and the old stays if the
    writing fails; a crash between the two renames leaves the old under its other name. What is written may be read
    from path."""
    jvm = spark.sparkContext._jvm
    at, new, old = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"))
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        write(new.toString())
        there = store.exists(at)
        if there and not store.rename(at, old):
            raise OSError(f"{path} can't be renamed")
        if not store.rename(new, at):
            if there:
                store.rename(old, at)
            raise OSError(f"{new.toString()} can't be renamed")
        store.delete(old, True)
    finally:
        store.delete(new, True)


def write_jsonl(df: DataFrame, path: str) -> None:
    """One JSON object a line, in place of what stood there."""
    replaced(df.sparkSession, path, lambda p: df.write.json(p))


def append_results(df: DataFrame, path: str) -> None:
    """More records of a result log; a record without an error has no such field, as Spark leaves nulls out."""
    df.write.mode("append").json(path)


def purge_errors(spark: SparkSession, path: str, schema: str = RESULT) -> int:
    """Rewrites a result log without the records that have an error or don't parse, if there are any, and says how
    many lines went."""
    if not exists(spark, path):
        return 0
    rows = spark.read.text(path).where(T.strip(F.col("value")) != "").withColumn("r", F.from_json("value", schema))
    bad = F.col("r").isNull() | F.col("r.error").isNotNull() | F.col("r.query").isNull()
    lost = rows.where(bad).count()
    if lost:
        replaced(spark, path, lambda p: rows.where(~bad).select("value").write.text(p))
    return lost


def size(spark: SparkSession, path: str) -> int:
    """Bytes of all files at path; their contents are not read."""
    return spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0] or 0


def positions(df: DataFrame, *order: str) -> DataFrame:
    """df with position, the 0-based place of each row in a stated order. Each range of the order is numbered by a task
    of its own, after the sizes of the ranges before it, so no task holds all rows."""
    rows = cut_lineage(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    sizes = {r["__part"]: r["count"] for r in rows.groupBy("__part").count().collect()}
    before, starts = 0, []
    for part in sorted(sizes):
        starts.append((part, before))
        before += sizes[part]
    nth = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    known = df.sparkSession.createDataFrame(starts, "__part int, __start long")
    return rows.withColumn("__nth", nth).join(F.broadcast(known), "__part").withColumn("position", F.col("__start") + F.col("__nth")).drop("__part", "__nth", "__start")


def index_rows(triples_: DataFrame, document: Column, *order: str, cut: int = 500) -> DataFrame:
    """What a vector index holds of triples, besides the vectors: id (by position in the stated order, tid by default),
    document, and the metadata, with objects cut and missing sources filled. Where the order leaves rows equal, which
    comes first is open, and with it their ids."""
    rows = positions(triples_, *(order or ("tid",)))
    source = F.coalesce("source", F.lit("llm")) if "source" in triples_.columns else F.lit("llm")
    return rows.select(
        F.concat(F.lit("t_"), F.col("position").cast("string")).alias("id"), document.alias("document"), "subject", "relation", F.substring(F.col("object").cast("string"), 1, cut).alias("object"),
        F.coalesce("source_topic", F.lit("")).alias("source_topic"), source.alias("source"),
    )


def write_index(df: DataFrame, path: str, by: str = "source_topic") -> int:
    """A vector index, made anew: its files are grouped by topic, so that a filter on topics skips files, and rows are
    added by all tasks at once. Returns how many it holds."""
    replaced(df.sparkSession, path, lambda p: df.repartitionByRange(by).sortWithinPartitions(by).write.parquet(p))
    return df.sparkSession.read.parquet(path).count()


def cached_vectors(texts: DataFrame, column: str, path: str, embed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """texts with vector, from the cache at path; texts that it lacks are embedded and added to it first. embed takes a
    frame of the column's distinct texts and adds vector, which is null where the service failed; those are not kept."""
    spark = texts.sparkSession
    wanted = texts.select(F.col(column).alias("text")).where("text is not null").distinct()
    if exists(spark, path):
        wanted = wanted.join(spark.read.parquet(path).select("text"), "text", "left_anti")
    new = cut_lineage(embed(wanted).select("text", "vector")).where("vector is not null")  # the service is asked once
    if not new.isEmpty():
        new.write.mode("append").parquet(path)
    if not exists(spark, path):
        return texts.withColumn("vector", F.lit(None).cast("array<double>"))
    return texts.join(spark.read.parquet(path).select(F.col("text").alias(column), "vector"), column, "left")


def write_graph(chunks: DataFrame, entities: DataFrame, relationships: DataFrame, path: str) -> dict[str, int]:
    """The three tables of a custom graph, each replaced as a whole; says how many rows each has."""
    counts = {}
    for name, df in (("chunks", chunks), ("entities", entities), ("relationships", relationships)):
        replaced(df.sparkSession, f"{path}/{name}", lambda p, df=df: df.write.parquet(p))
        counts[name] = df.sparkSession.read.parquet(f"{path}/{name}").count()
    return counts


def _columns(df: DataFrame, widths: dict[str, int]) -> dict[str, str]:
    """Each column's conversion: numbers stand to the right."""
    number = {f.name for f in df.schema if isinstance(f.dataType, NumericType)}
    return {n: f"%{w}s" if n in number else f"%-{w}s" for n, w in widths.items()}


def report_head(df: DataFrame, widths: dict[str, int]) -> list[str]:
    """A report's heading and the rule below it."""
    head = " ".join(form % n for n, form in _columns(df, widths).items())
    return [head, "-" * len(head)]


def report_rows(df: DataFrame, widths: dict[str, int], decimals: int = 4) -> DataFrame:
    """df with line: the row in columns of fixed width. Nulls are a dash, fractions have so many decimals, longer texts
    are cut, longer numbers aren't."""
    kinds = {f.name: f.dataType for f in df.schema}

    def cell(name: str) -> Column:
        value = F.col(f"`{name}`")
        if isinstance(kinds[name], FractionalType) and not isinstance(kinds[name], DecimalType):
            value = F.format_string(f"%.{decimals}f", T.half_even(value.cast("double"), decimals))
        elif not isinstance(kinds[name], NumericType):
            value = F.substring(value.cast("string"), 1, widths[name])
        return F.when(F.col(f"`{name}`").isNull(), "-").otherwise(value.cast("string"))

    return df.withColumn("line", F.format_string(" ".join(_columns(df, widths).values()), *map(cell, widths)))


def report_lines(df: DataFrame, widths: dict[str, int], decimals: int = 4) -> list[str]:
    """A whole report, for aggregates: heading, rule, and df's rows in their order."""
    return report_head(df, widths) + [r.line for r in report_rows(df, widths, decimals).select("line").collect()]


def index_where(spark: SparkSession, path: str, condition: str | Column, limit: int | None = None, order: str = "id") -> DataFrame:
    """Rows without their vectors, the first of them by order where there is a limit; the scan leaves vectors out."""
    rows = spark.read.parquet(path)
    rows = rows.select(*[c for c in rows.columns if c != "vector"]).where(condition)
    return rows if limit is None else rows.orderBy(order).limit(limit)


def write_json(df: DataFrame, path: str) -> None:
    """A report as one indented JSON array in one text file; for aggregates, whose rows one task holds."""
    rows = df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"pretty": "true"}).alias("row"))
    whole = rows.agg(F.concat(F.lit("["), F.coalesce(F.array_join(F.sort_array(F.collect_list("row")), ",\n"), F.lit("")), F.lit("]")).alias("value"))
    replaced(df.sparkSession, path, lambda p: whole.coalesce(1).write.text(p))


def write_tsv(df: DataFrame, path: str, by: str = "title") -> None:
    """Tab-separated rows sorted by a column, over as many files as the sort makes; their names are in order."""
    df.orderBy(by).write.mode("overwrite").option("header", "false").option("emptyValue", "").csv(path, sep="\t")


def write_topics(topics_: DataFrame, path: str, backup: str) -> None:
    """One title a line, in order. What stood at path is kept at backup, once: a later call leaves the backup alone."""
    spark = topics_.sparkSession
    if exists(spark, path) and not exists(spark, backup):
        spark.read.text(path).write.text(backup)
    rows = topics_.select(F.col("topic").alias("value")).orderBy("value")
    replaced(spark, path, lambda p: rows.write.text(p))
