"""Experiments as grids: every cell of settings meets every question, and all cells are answered in one plan.

A grid's log is a folder of JSON lines, a folder below for each cell's label. A run first takes errors out of the log,
then answers what it lacks and appends it, so a run that was cut short goes on where it stopped.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable
from dataclasses import dataclass, fields
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statweave.functions import metrics as M
from statweave.operators import evaluation as E
from statweave.operators import retrieval as R
from statweave.plans import answering as A
from statweave.sources import files
from statweave.sources import services as V

TEMPERATURES = (0.0, 0.1, 0.3, 0.5, 0.7, 1.0)
THRESHOLDS = (0.15, 0.20, 0.25, 0.30, 0.35, None)
RECORD = "query string, method string, answer string, retrieved array<string>, latency_ms double, error string"


@dataclass(frozen=True)
class Cell:
    """The settings of one run over all questions. A seed tells runs apart; only services that heed one are given it."""

    method: str
    model: str = "offline"
    mode: str = "held_out"
    granularity: str = "fine"
    top_k: int = 5
    threshold: float | None = None
    rerank: bool = True
    temperature: float | None = None
    seed: int = 0

    @property
    def label(self) -> str:
        return "_".join(f"{f.name}={getattr(self, f.name)}" for f in fields(self))


def grid(**settings: tuple) -> list[Cell]:
    """All combinations of the settings given, each a tuple of values."""
    return [Cell(**dict(zip(settings, values, strict=True))) for values in itertools.product(*settings.values())]


SETTINGS = {"method": "string", "model": "string", "mode": "string", "granularity": "string", "top_k": "int", "threshold": "double", "rerank": "boolean", "temperature": "double", "seed": "int"}


def with_cells(questions: DataFrame, cells: list[Cell]) -> DataFrame:
    """Every question with every cell's label and settings; the cells are the caller's list."""
    structs = [F.struct(F.lit(c.label).alias("label"), *[F.lit(getattr(c, n)).cast(kind).alias(n) for n, kind in SETTINGS.items()]) for c in cells]
    return questions.withColumn("__cell", F.explode(F.array(*structs))).select(*questions.columns, "__cell.*")


@dataclass
class Services:
    """What cells are answered with. indexes: one for each granularity; chunks: of paragraphs. embed may be missing where
    questions have vectors."""

    indexes: dict[str, DataFrame]
    generate: V.Generator
    embed: V.Embedder | None = None
    rerank: V.Reranker | None = None
    chunks: DataFrame | None = None
    verify: V.Generator | None = None
    self_verify: V.Generator | None = None
    held_out: dict | None = None

    def where(self, mode: str) -> dict | None:
        return self.held_out if mode == "held_out" else None


def _search(need: DataFrame, cells: list[Cell], s: Services) -> DataFrame:
    """label, qid, rank, document for the cells that retrieve: each index is searched once for all cells that share it,
    as deep as the deepest of them."""
    parts = []
    shared = lambda c: (c.method == "standard_rag", c.method == "graph_rag", c.granularity, c.mode)
    for (rag, graph, granularity, mode), group in itertools.groupby(sorted(cells, key=shared), shared):
        group = list(group)
        labels = [c.label for c in group]
        index = s.chunks if rag else s.indexes[granularity]
        where = R.renamed_filter(s.where(mode), {"source_topic": "topic"}) if rag else s.where(mode)
        mine = need.where(F.col("label").isin(labels))
        asked = mine.select("qid", *[c for c in ("question", "vector") if c in need.columns]).dropDuplicates(["qid"])
        depth = max(max(c.top_k // 2, 10) if graph else c.top_k for c in group)
        near = A.cut_lineage(A._hits(asked, index, s.embed, depth, None, where))
        limit = F.greatest(F.floor(F.col("top_k") / 2), F.lit(10)) if graph else F.col("top_k")
        hits = mine.drop("vector").join(near.select("qid", "id", "rank", "distance", "document"), "qid").where((F.col("rank") <= limit) & (F.col("threshold").isNull() | (F.col("distance") <= F.col("threshold"))))
        if graph:
            allowed = index if where is None else index.where(R.metadata_condition(where))
            seeds = hits.select(F.struct("label", "qid").alias("qid"), "id", "rank")
            for k in sorted({c.top_k for c in group}):
                some = [c.label for c in group if c.top_k == k]
                found = R.two_hop(seeds.where(F.col("qid.label").isin(some)), allowed.select("id", "subject", "document"), k)
                parts.append(found.select("qid.label", "qid.qid", "rank", "document"))
            continue
        plain = hits
        if s.rerank is not None and not rag:
            both = hits.where("rerank")
            plain = hits.where("not rerank").select("label", "qid", "rank", "document").unionByName(V.rerank(both, "question", "document", s.rerank, keys=("label", "qid")).select("label", "qid", "rank", "document"))
        parts.append(plain.select("label", "qid", "rank", "document"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


RETRIEVING = ("kg_retrieval", "standard_rag", "graph_rag", "conli")


def answer_cells(need: DataFrame, cells: list[Cell], s: Services) -> DataFrame:
    """need: every question of every cell that is to be answered, with the cell's settings. One stage drafts all answers;
    the methods that check their drafts have two more, over their own rows alone."""
    searching = [c for c in cells if c.method in RETRIEVING]
    rows = need.drop("vector")
    if searching:
        context = A._context(_search(need, searching, s), "label", "qid")
        rows = rows.join(context, ["label", "qid"], "left")
    else:
        rows = rows.withColumns({"context": F.lit(None).cast("string"), "retrieved": F.lit(None).cast("array<string>")})
    checking = F.col("method").isin(*A.CHECKS)
    rows = rows.withColumn("prompt", A.prompt(~checking))
    heeded = [n for n, by in (("temperature", "at"), ("seed", "seeded")) if hasattr(s.generate, by)]
    kinds = sorted({tuple(getattr(c, n) for n in heeded) for c in cells}, key=lambda k: [(x is not None, x or 0) for x in k])
    parts = []
    for kind in kinds:  # a service is asked once for each of its settings
        chosen = dict(zip(heeded, kind, strict=True))
        own = [F.col(n).eqNullSafe(F.lit(x).cast(SETTINGS[n])) for n, x in chosen.items()] if len(kinds) > 1 else []
        parts.append(V.generate(reduce(DataFrame.where, own, rows), "prompt", V.tuned(s.generate, chosen.get("temperature"), chosen.get("seed"))))
    drafts = parts[0]
    for part in parts[1:]:
        drafts = drafts.unionByName(part)
    columns = ["label", "qid", F.col("question").alias("query"), "method", "answer", "retrieved", "latency_ms", "error"]
    methods = {c.method for c in cells} & set(A.CHECKS)
    if not methods:
        return drafts.select(*columns)
    drafts = A.cut_lineage(drafts)
    out = drafts.where(~checking).select(*columns)
    for method in sorted(methods):
        own = drafts.where(F.col("method") == method).select("label", "qid", "question", "context", "retrieved", F.col("answer").alias("draft"))
        out = out.unionByName(A.checked(own, method, s.verify if method == "conli" else s.self_verify, s.generate).select(*columns))
    return out


def read_log(questions: DataFrame, path: str) -> DataFrame:
    return questions.sparkSession.read.schema(f"{RECORD}, label string").json(path)


def run(questions: DataFrame, cells: list[Cell], path: str, answer: Callable[[DataFrame, list[Cell]], DataFrame]) -> DataFrame:
    """Answers every question (qid, question) of every cell that the log at path doesn't hold yet, appends that to the
    log, and returns the whole log with the cells' settings. Records with an error are taken out first and so tried
    again."""
    spark = questions.sparkSession
    need = with_cells(questions, cells)
    if files.exists(spark, path):
        purge(questions, path)
        need = need.join(read_log(questions, path).select("label", F.col("query").alias("question")).distinct(), ["label", "question"], "left_anti")
    need = A.cut_lineage(need)
    left = {r["label"] for r in need.select("label").distinct().collect()}
    if left:
        answer(need, [c for c in cells if c.label in left]).select("label", "query", "method", "answer", "retrieved", "latency_ms", "error").write.mode("append").partitionBy("label").json(path)
    settings = spark.createDataFrame([(c.label, *(getattr(c, n) for n in SETTINGS)) for c in cells], ", ".join(f"{n} {kind}" for n, kind in {"label": "string", **SETTINGS}.items()))
    return read_log(questions, path).drop("method").join(F.broadcast(settings), "label")


def purge(questions: DataFrame, path: str) -> int:
    """Rewrites a grid's log without the records that have an error or don't parse; how many went."""
    spark = questions.sparkSession
    rows = read_log(questions, path)
    bad = F.col("error").isNotNull() | F.col("query").isNull()
    lost = rows.where(bad).count()
    if lost:
        files.replaced(spark, path, lambda p: rows.where(~bad).write.partitionBy("label").json(p))
    return lost


def scores(log: DataFrame, gold: DataFrame) -> DataFrame:
    """The log's good records with the gold of their question (question, gold_numbers), and nem, nf1, fp, substring_nem and
    how many facts were retrieved."""
    gold = gold if "id" in gold.columns else gold.withColumn("id", F.lit(0))
    rows = E.with_gold(log.where("error is null").withColumnRenamed("query", "question"), gold)
    a, g = F.col("answer"), F.col("gold_numbers")
    return rows.withColumns({"nem": M.nem(a, g), "nf1": M.nf1(a, g), "fp": M.fp(a, g), "substring_nem": M.substring_nem(a, g), "facts": F.greatest(F.coalesce(F.size("retrieved"), F.lit(0)), F.lit(0))})


def summary(scored: DataFrame, *keys: str) -> DataFrame:
    return scored.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(c), 6).alias(c) for c in ("nem", "nf1", "fp")])


def held_out_against_full(scored: DataFrame) -> DataFrame:
    """For each method and model the accuracy with held-out facts, with all, and the difference; a cell without answers
    counts as 0."""
    return E.delta(scored, ["method", "model"], "mode", "held_out", "full_index", "nem").select("method", "model", F.col("first").alias("held_out"), F.col("second").alias("full_index"), F.round(F.col("second") - F.col("first"), 6).alias("delta"))


def over_seeds(scored: DataFrame) -> DataFrame:
    """granularity, top_k: the mean over seeds of each run's accuracy, how many seeds, and their spread."""
    runs = scored.groupBy("granularity", "top_k", "seed").agg(F.avg("nem").alias("nem"))
    return runs.groupBy("granularity", "top_k").agg(F.count(F.lit(1)).alias("seeds"), F.round(F.avg("nem"), 6).alias("nem"), F.round(F.stddev_pop("nem"), 6).alias("spread"))


def by_threshold(scored: DataFrame) -> DataFrame:
    """For each method, model and threshold: accuracy by substring, facts kept on average, the share of questions without
    any. Sorted with the runs without a threshold last; a threshold of 0 counts as none there."""
    order = F.when(F.coalesce("threshold", F.lit(0.0)) == 0, 999.0).otherwise(F.col("threshold"))
    out = scored.groupBy("method", "model", "threshold").agg(
        F.round(F.avg("substring_nem"), 4).alias("nem"), F.round(F.avg("facts"), 1).alias("avg_facts"), F.round(F.avg((F.col("facts") == 0).cast("double")), 4).alias("zero_share"), F.count(F.lit(1)).alias("n")
    )
    return out.orderBy("method", "model", order)


def by_temperature(scored: DataFrame, method: str = "kg_retrieval", against: str = "zero_shot") -> DataFrame:
    return E.delta(scored.where(F.col("method").isin(method, against)), ["temperature"], "method", method, against, "nem")
