"""Answering methods over a table of questions: retrieval is relational, generation one stage.

Each returns the questions with method, answer, error and latency_ms, and the context where there is one.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statweave.operators import graph as G
from statweave.operators import retrieval as R
from statweave.operators import triples as K
from statweave.session import cut_lineage
from statweave.sources import files
from statweave.sources import services as V


#: What stands for facts where none could be had.
NO_FACTS = "(No reference facts available)"


#: The methods that check their drafts: the word of a check that rejects, and what is checked.
CHECKS = {"conli": ("CONTRADICTED", "draft"), "cove": ("INCORRECT", "claims")}


def prompt(grounded: Column | None = None) -> Column:
    """What a question (question, context) is asked as; without a context, or where it isn't to be grounded, alone."""
    alone = F.concat(F.lit("Question: "), "question")
    if grounded is None:
        return alone
    return F.when(grounded & F.col("context").isNotNull(), F.concat(F.lit("Context:\n"), "context", F.lit("\n\n"), alone)).otherwise(alone)


def _ask(questions: DataFrame, context: DataFrame | None, call: V.Generator, method: str, temperature: float | None = None) -> DataFrame:
    q = questions if context is None else questions.join(context, "qid", "left")
    text = prompt() if context is None else prompt(F.lit(True))
    return V.generate(q.withColumn("prompt", text), "prompt", V.tuned(call, temperature)).withColumn("method", F.lit(method))


def _hits(questions: DataFrame, index: DataFrame, embed: V.Embedder | None, k: int, most: float | None, where: dict | None = None, later_first: bool = False) -> DataFrame:
    """The nearest rows of the index that pass the filter, at most most away. Questions that have vectors keep them."""
    allowed = index if where is None else index.where(R.metadata_condition(where))
    vectors = questions.select("qid", "vector") if "vector" in questions.columns else cut_lineage(V.embed(questions.select("qid", "question"), "question", embed))
    near = R.cosine_topk(vectors.where("vector is not null").select("qid", "vector"), allowed.select("id", "vector"), k, later_first=later_first)
    near = near if most is None else near.where(F.col("distance") <= most)
    return near.join(allowed.drop("vector"), "id")


def _context(hits: DataFrame, *keys: str) -> DataFrame:
    """The numbered facts, and the list of them, from hits that are looked at once."""
    hits = cut_lineage(hits.select(*(keys or ("qid",)), "rank", "document"))
    return R.numbered_context(hits, "document", *keys).join(R.retrieved(hits, "document", *keys), [*(keys or ("qid",))])


def zero_shot(questions: DataFrame, call: V.Generator, temperature: float | None = None) -> DataFrame:
    return _ask(questions, None, call, "zero_shot", temperature)


def kg_retrieval(
    questions: DataFrame, index: DataFrame | dict[str, DataFrame], embed: V.Embedder | None, call: V.Generator, k: int = 5, most: float | None = None, rerank: V.Reranker | None = None, method: str = "kg_retrieval",
    where: dict | None = None, granularity: str = "fine", temperature: float | None = None,
) -> DataFrame:
    """index: id, vector, document and metadata, or one for each granularity. where is a filter on the metadata, applied
    before ranking. Questions without anything near enough are asked alone."""
    index = index[granularity] if isinstance(index, dict) else index
    hits = _hits(questions, index, embed, k, most, where)
    if rerank is not None:
        hits = V.rerank(hits.join(questions.select("qid", "question"), "qid"), "question", "document", rerank, k)
    return _ask(questions, _context(hits), call, method, temperature)


def chunk_index(corpus: DataFrame, embed: V.Embedder, path: str, topic: str = "topic", text: str = "full_text") -> DataFrame:
    """The index of a corpus's paragraphs at path (id, vector, document, topic, chunk_idx), made when it is first asked
    for."""
    spark = corpus.sparkSession
    if not files.exists(spark, path):
        chunks = K.paragraph_chunks(corpus, topic, text).select(F.col(topic).alias("topic"), "chunk_idx", F.col("chunk").alias("document"))
        rows = files.positions(chunks.withColumn("at", F.col("chunk_idx").cast("int")), "topic", "at").withColumnRenamed("position", "id").drop("at")
        files.write_index(V.embed(rows, "document", embed), path, "topic")
    return spark.read.parquet(path)


def standard_rag(questions: DataFrame, chunks: DataFrame, embed: V.Embedder | None, call: V.Generator, k: int = 5, where: dict | None = None, temperature: float | None = None) -> DataFrame:
    """Retrieval over paragraphs. A filter on the facts' topics is one on the paragraphs' topics."""
    hits = _hits(questions, chunks, embed, k, None, R.renamed_filter(where, {"source_topic": "topic"}))
    return _ask(questions, _context(hits), call, "standard_rag", temperature)


def graph_retrieval(questions: DataFrame, index: DataFrame, embed: V.Embedder | None, call: V.Generator, k: int = 50, most: float | None = None, where: dict | None = None, temperature: float | None = None) -> DataFrame:
    """Facts near the question and those of the same subjects; the filter holds for both."""
    seeds = _hits(questions, index, embed, max(k // 2, 10), most, where).select("qid", "id", "rank")
    allowed = index if where is None else index.where(R.metadata_condition(where))
    return _ask(questions, _context(R.two_hop(seeds, allowed.drop("vector"), k)), call, "graph_rag", temperature)


def community_retrieval(questions: DataFrame, entities: DataFrame, reports: DataFrame, embed: V.Embedder, call: V.Generator, k: int = 10, most_reports: int = 5, units: DataFrame | None = None, each: int = 3, most_facts: int = 10) -> DataFrame:
    """entities: id, vector, entity, community; reports: community, summary; units: unit, text, entity_ids. The
    communities of the nearest entities, by their best entity, then the first text units of each entity."""
    near = cut_lineage(_hits(questions, entities.withColumn("document", F.col("entity")), embed, k, None, later_first=True))
    best = near.groupBy("qid", "community").agg(F.min("rank").alias("rank"))
    found = R.first_hits(best, most_reports).join(reports, "community")
    context = R.numbered_context(found, "summary")
    if units is not None:
        named = near.groupBy("qid", "entity").agg(F.min("rank").alias("at"))
        facts = named.join(G.membership_facts(named, units, each).withColumnRenamed("rank", "nth"), "entity")
        facts = facts.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("at", "entity", "nth")).cast("long")).where(F.col("rank") <= most_facts)
        facts = R.numbered_context(facts, "text").withColumnRenamed("context", "facts")
        titled = lambda title, name: F.concat(F.lit(f"{title}:\n"), name)
        context = context.join(facts, "qid", "full").select("qid", F.concat_ws("\n\n", titled("Community Summaries", "context"), titled("Relevant Facts", "facts")).alias("context"))
    return _ask(questions, context, call, "community")


def hybrid_retrieval(questions: DataFrame, entities: DataFrame, relations: DataFrame, chunks: DataFrame, embed: V.Embedder, call: V.Generator, k: int = 10) -> DataFrame:
    """The nearest entities, the nearest relations and the chunks of either, as one context in that order.
    entities: id, vector, entity, document; relations: id, vector, src, dst, document; chunks: entity, document."""
    near = _hits(questions, entities, embed, k, None)
    tied = _hits(questions, relations, embed, k, None)
    named = near.select("qid", "entity", "rank").unionByName(tied.select("qid", F.explode(F.array("src", "dst")).alias("entity"), (F.col("rank") + k).alias("rank")))
    text = named.groupBy("qid", "entity").agg(F.min("rank").alias("rank")).join(chunks, "entity").groupBy("qid", "document").agg(F.min("rank").alias("rank"))
    part = lambda df, n: df.select("qid", "document", F.lit(n).alias("part"), F.col("rank").alias("at"))
    found = part(near, 0).unionByName(part(tied, 1)).unionByName(part(R.first_hits(text.withColumn("rank", F.col("rank").cast("long")), k), 2))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("part", "at", "document")).cast("long"))
    return _ask(questions, R.numbered_context(ranked, "document"), call, "hybrid")


def verified(questions: DataFrame, index: DataFrame | None, embed: V.Embedder | None, draft: V.Generator, verify: V.Generator, revise: V.Generator, k: int = 5, where: dict | None = None) -> DataFrame:
    """Draft, check against retrieved facts, revise only what the check calls CONTRADICTED. Without an index, or where
    nothing is found, a placeholder stands for the facts."""
    first = zero_shot(questions, draft).select("qid", "question", F.col("answer").alias("draft"))
    if index is None:
        context = first.select("qid", F.lit(None).cast("string").alias("context"), F.lit(None).cast("array<string>").alias("retrieved"))
    else:
        context = _context(_hits(questions, index, embed, k, None, where))
    return checked(first.join(context, "qid", "left"), "conli", verify, revise)


def self_verified(questions: DataFrame, draft: V.Generator, verify: V.Generator, revise: V.Generator, extract: V.Generator | None = None) -> DataFrame:
    """Draft, extract its claims (by draft's generator where no other is given), check them alone, refine only
    what the check calls INCORRECT."""
    first = zero_shot(questions, draft).select("qid", "question", F.col("answer").alias("draft"), F.lit(None).cast("string").alias("context"), F.lit(None).cast("array<string>").alias("retrieved"))
    return checked(first, "cove", verify, revise, extract or draft)


def rejected(verdict: Column, word: str) -> Column:
    """Whether a check's answer holds the word that rejects."""
    return F.contains(verdict, F.lit(word))


def checked(drafts: DataFrame, method: str, verify: V.Generator, revise: V.Generator, extract: V.Generator | None = None) -> DataFrame:
    """drafts (question, draft, context, and other columns, which stay) with method, answer, error and latency_ms: a
    checking method's second half. Its drafts, or the claims that extract lists of them, are checked against the context
    or what stands for it, and only rejected drafts go to revise."""
    word, subject = CHECKS[method]
    columns = drafts.columns
    if subject == "claims":
        listed = F.concat(F.lit("List the factual claims of this answer, one a line.\nAnswer: "), "draft")
        drafts = V.generate(drafts.withColumn("prompt", listed), "prompt", extract or revise).select(*columns, F.col("answer").alias("claims"))
    facts = F.coalesce("context", F.lit(NO_FACTS))
    asked = V.generate(drafts.withColumn("prompt", F.concat(F.lit("Facts:\n"), facts, F.lit("\nAnswer: " if subject == "draft" else "\nClaims: "), subject)), "prompt", verify)
    asked = cut_lineage(asked.withColumnRenamed("answer", "verdict").drop("error", "latency_ms"))
    wrong = F.coalesce(rejected(F.col("verdict"), word), F.lit(False))
    again = F.concat(F.lit("Context:\n"), facts, F.lit("\n\nQuestion: "), "question", F.lit("\nFirst answer: "), "draft", F.lit("\nTo be corrected: "), "verdict")
    again = V.generate(asked.where(wrong).withColumn("prompt", again), "prompt", revise)
    kept = asked.where(~wrong).withColumns({"answer": F.col("draft"), "error": F.lit(None).cast("string"), "latency_ms": F.lit(0.0)})
    out = again.unionByName(kept).withColumn("method", F.lit(method))
    return out.drop(*{"claims"} - set(columns))


def compared_indexes(questions: DataFrame, indexes: dict[str, tuple[DataFrame, dict | None]], embed: V.Embedder | None, call: V.Generator, k: int = 5) -> DataFrame:
    """The same retrieval, without reranking, over several indexes, each with its own filter or none: a held-out filter
    belongs to the own one only. The method of an answer ends in its index's name."""
    parts = [kg_retrieval(questions, index, embed, call, k, where=where, method=f"kg_retrieval_{name}") for name, (index, where) in indexes.items()]
    return reduce(DataFrame.unionByName, parts)


METHODS: dict[str, Callable[..., DataFrame]] = {"zero_shot": zero_shot, "kg_retrieval": kg_retrieval, "standard_rag": standard_rag, "graph_rag": graph_retrieval, "community": community_retrieval, "hybrid": hybrid_retrieval, "conli": verified, "cove": self_verified}


def run(method: str, *args: object, **settings: object) -> DataFrame:
    if method not in METHODS:
        raise ValueError(f"unknown method {method}")
    return METHODS[method](*args, **settings)
