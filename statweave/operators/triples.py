"""Triples: extraction, validation, wording, normalisation, de-duplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statweave.functions import text as T
from statweave.session import cut_lineage

LEVELS = {"fine": "The %2$s of %1$s is %3$s.", "medium": "%1$s - %2$s: %3$s", "coarse": "%1$s: %2$s=%3$s"}


def statistical_sentences(corpus: DataFrame, text: str, *keys: str) -> DataFrame:
    """keys, pos (0-based among all sentences), sentence."""
    rows = corpus.select(*keys, F.posexplode(T.sentences(F.col(text))).alias("pos", "sentence"))
    return rows.where(T.is_statistical(F.col("sentence"))).withColumn("pos", F.col("pos").cast("long"))


def first_n(rows: DataFrame, keys: list[str], order: list, n: int, name: str = "rn") -> DataFrame:
    """The first n rows of each key in a stated order, with their 1-based rank."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")).where(F.col(name) <= n)


def sentence_batches(rows: DataFrame, key: str, order: str, sentence: str, most: int = 20, size: int = 5) -> DataFrame:
    """The first sentences of each key in batches, each joined by line feeds in order."""
    ranked = first_n(rows, [key], [order], most).withColumn("batch", F.floor((F.col("rn") - 1) / size).cast("long"))
    parts = F.array_sort(F.collect_list(F.struct("rn", sentence)))
    return ranked.groupBy(key, "batch").agg(F.array_join(F.transform(parts, lambda x: x[sentence]), "\n").alias("sentences"), F.count(F.lit(1)).alias("n"))


def work_list(corpus: DataFrame, done: DataFrame, key: str = "topic", count: str = "sentence_count") -> DataFrame:
    """What is still to be done: topics with sentences that are not among the done."""
    return corpus.where(F.col(count) > 0).join(done.select(key), key, "left_anti")


def with_numbers(triples: DataFrame) -> DataFrame:
    """Triples whose object holds a number."""
    return triples.where(F.size(T.extract_numbers(F.col("object"))) > 0)


def validate(raw: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Rows with all three parts, a known relation, and a digit in the object. The vocabulary is a fixed
    schema of a few dozen rows, hence broadcast."""
    whole = raw.where("subject is not null and relation is not null and object is not null")
    return whole.where(F.col("object").cast("string").rlike("[0-9]")).join(F.broadcast(vocabulary.select("relation").distinct()), "relation", "left_semi")


def parse_generated(answers: DataFrame, column: str, *keys: str) -> DataFrame:
    """Triples in generated text: fenced or plain JSON, an array whose elements are judged one by one. An element that
    is no object or lacks a part is left out; text that is no JSON or another thing than an array gives none."""
    elements = F.from_json(T.fenced_json(F.col(column)), "array<string>")
    rows = answers.select(*keys, F.explode(elements).alias("element")).select(*keys, F.from_json("element", "map<string, string>").alias("t"))
    parts = ("subject", "relation", "object")
    for part in parts:
        rows = rows.where(F.map_contains_key("t", part))
    return rows.select(*keys, *[F.col("t")[part].alias(part) for part in parts])


def verbalise(level: str = "fine") -> Column:
    return F.format_string(LEVELS[level], F.col("subject"), F.col("relation"), F.col("object"))


def coarse_documents(triples: DataFrame) -> DataFrame:
    """One document for each topic: its facts in order."""
    facts = F.array_sort(F.collect_list(F.struct("tid", F.concat("relation", F.lit(": "), "object").alias("fact"))))
    grouped = triples.groupBy("source_topic").agg(facts.alias("facts"), F.count(F.lit(1)).cast("string").alias("triple_count"))
    joined = F.array_join(F.transform("facts", lambda x: x["fact"]), " | ")
    return grouped.select("source_topic", F.concat("source_topic", F.lit(": "), joined).alias("document"), F.lit("MULTI").alias("relation"), "triple_count")


def paragraph_chunks(docs: DataFrame, key: str, text: str, separator: str = "\n\n", least: int = 50, most: int = 1024) -> DataFrame:
    """Paragraphs over least characters, cut at most; chunk_idx counts all paragraphs."""
    parts = docs.select(key, F.posexplode(F.split(text, separator)).alias("chunk_idx", "chunk"))
    return parts.withColumn("chunk", T.strip(F.col("chunk"))).where(F.length("chunk") > least).select(key, F.col("chunk_idx").cast("string").alias("chunk_idx"), F.substring("chunk", 1, most).alias("chunk"))


def normalization_map(triples: DataFrame, numeric: bool = False) -> DataFrame:
    """original, normalized: each entity to the shortest (then least) variant of its canonical key, or to its
    normalised form; identities left out. Objects with digits only take part with numeric, as keys drop signs."""
    objects = triples.select(F.col("object").alias("entity"))
    if not numeric:
        objects = objects.where(~F.col("entity").rlike("[0-9]"))
    entities = triples.select(F.col("subject").alias("entity")).unionByName(objects).where("entity is not null").distinct()
    keyed = entities.withColumn("norm", T.normalize_string(F.col("entity"))).withColumn("key", T.canonical_key(F.col("entity")))
    best = keyed.where("key <> ''").groupBy("key").agg(F.min(F.struct(F.length("norm").alias("n"), F.col("norm").alias("best"))).alias("m"))
    return keyed.join(best, "key", "left").select(F.col("entity").alias("original"), F.coalesce("m.best", "norm").alias("normalized")).where("original <> normalized")


def rewrite(triples: DataFrame, mapping: DataFrame) -> DataFrame:
    """Subjects and objects through the mapping, which is worked out once for both."""
    out, mapping = triples, cut_lineage(mapping)
    for column in ("subject", "object"):
        side = mapping.select(F.col("original").alias(column), F.col("normalized").alias("to"))
        out = out.join(side, column, "left").withColumn(column, F.coalesce("to", column)).drop("to")
    return out.select(*triples.columns)


def dedupe(triples: DataFrame, order: str = "tid") -> DataFrame:
    """The first of each (subject, relation, object): a partial aggregate, so hot facts combine before a shuffle."""
    rest = [c for c in triples.columns if c not in ("subject", "relation", "object")]
    first = F.min_by(F.struct(*rest), F.col(order)).alias("first")
    return triples.groupBy("subject", "relation", "object").agg(first).select("subject", "relation", "object", *[f"first.{c}" for c in rest])


def resolve_aliases(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """Each entity's target by the alias of least priority number, else itself."""
    best = aliases.groupBy("alias").agg(F.min_by("target", F.struct("priority", "target")).alias("target"))
    return entities.join(best, entities["entity"] == best["alias"], "left").select("entity", F.coalesce("target", "entity").alias("resolved"))


def related_topics(links: DataFrame, topics: DataFrame) -> DataFrame:
    """links (topic, link) whose target is another topic, whatever the case, in the topics' own casing."""
    known = topics.groupBy(F.lower("topic").alias("low")).agg(F.min("topic").alias("object"))
    found = links.withColumn("low", F.lower("link")).join(known, "low").where(F.lower("topic") != F.col("low"))
    return found.select(F.col("topic").alias("subject"), F.lit("RelatedTo").alias("relation"), "object", F.col("topic").alias("source_topic")).distinct()
