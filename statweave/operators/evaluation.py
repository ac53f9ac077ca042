"""Scoring of result logs: summaries, breakdowns, error taxonomy, attribution, sweeps, pairing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from statweave.functions import metrics as M
from statweave.functions import text as T
from statweave.session import cut_lineage

#: Rows of either side that a part of the join with gold holds, on average, at most.
PART_ROWS = 250_000


def with_gold(results: DataFrame, gold: DataFrame, order: str | None = "id", n: int | None = None) -> DataFrame:
    """Results with the gold of their question; of gold rows for one question the last counts. n: how many results there
    are, where that is known.

    Both sides are shuffled by question into as many parts as the session states, or more where there are many rows (both
    sides are counted first), which adaptive execution doesn't join up again: gold is never gathered on the driver, and
    what a task sorts doesn't grow with the tables."""
    rest = [c for c in gold.columns if c != "question"]
    rows = max(results.count() if n is None else n, gold.count())
    parts = max(int(gold.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // PART_ROWS))
    results, gold = results.repartition(parts, "question"), gold.repartition(parts, "question")
    last = gold.groupBy("question").agg(F.max_by(F.struct(*rest), F.col(order)).alias("g")).select("question", *[f"g.{c}" for c in rest if c != order])
    return results.join(last.hint("merge"), "question")


def percentile_index(rows: DataFrame, keys: list[str], value: str, share: float, name: str) -> DataFrame:
    """keys, n and the value at 0-based index floor(share * n) of each group's sorted values; nulls left out.

    Approximate percentiles, whose error in rank is bounded, bracket the index; what lies below is only counted
    and equal values are one row, so that even a group with most of the rows leaves little to sort."""
    error = 1e-4
    rows = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("__v"))
    bounds = F.percentile_approx("__v", [max(0.0, share - 2 * error), min(1.0, share + 2 * error)], round(1 / error))
    groups = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), bounds.alias("__b"))
    # a row for each group; by its files' size alone the other side may look smaller than it is
    inside = rows.join(F.broadcast(groups), keys).where(F.col("__v") <= F.col("__b")[1])
    counts = inside.groupBy(*keys, "n", F.when(F.col("__v") >= F.col("__b")[0], F.col("__v")).alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
    upto = F.sum("__c").over(Window.partitionBy(*keys).orderBy(F.asc_nulls_first("__v")).rowsBetween(Window.unboundedPreceding, 0))
    return counts.withColumn("__u", upto).where(F.col("__u") > F.floor(share * F.col("n"))).groupBy(*keys).agg(F.first("n").alias("n"), F.min("__v").alias(name))


def summary(scored: DataFrame, *keys: str) -> DataFrame:
    """n, NEM, NF1, FP, mean and indexed 95th percentile of latency, mean of non-zero tokens, by keys."""
    gold, answer = F.col("gold_numbers"), F.col("answer")
    # a few numbers a row, looked at three times: answers are joined and scored once
    rows = cut_lineage(scored.select(*keys, "latency_ms", "tokens", M.nem(answer, gold).alias("nem"), M.nf1(answer, gold).alias("nf1"), M.fp(answer, gold).alias("fp")))
    means = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_evaluated"), *[F.round(F.avg(c), 6).alias(c) for c in ("nem", "nf1", "fp")],
        F.round(F.avg("latency_ms"), 4).alias("latency_mean_ms"), F.round(F.avg(F.nullif("tokens", F.lit(0))), 4).alias("tokens_mean"),
    )
    return means.join(percentile_index(rows, [*keys], "latency_ms", 0.95, "latency_p95_ms").drop("n"), [*keys], "left")


def by_relation(scored: DataFrame) -> DataFrame:
    """Accuracy of each relation and, last, OVERALL."""
    rows = scored.select("relation", M.nem(F.col("answer"), F.col("gold_numbers")).alias("nem"))
    return rows.rollup("relation").agg(F.grouping("relation").alias("total"), F.count(F.lit(1)).alias("n"), F.sum("nem").cast("long").alias("correct"), F.round(F.avg("nem"), 6).alias("accuracy")).select(F.when(F.col("total") == 1, "OVERALL").otherwise(F.col("relation")).alias("relation"), "n", "correct", "accuracy")


def relation_examples(scored: DataFrame, order: str, n: int = 3) -> DataFrame:
    """The first n answers of each relation in the log's order: the question and the answer cut short, the gold, the score."""
    rank = F.row_number().over(Window.partitionBy("relation").orderBy(order)).cast("long")
    rows = scored.withColumn("nth", rank).where(F.col("nth") <= n)
    return rows.select("relation", "nth", F.substring("question", 1, 100).alias("question"), F.array_join("gold_numbers", ", ").alias("gold"), F.substring("answer", 1, 150).alias("answer"), M.nem(F.col("answer"), F.col("gold_numbers")).alias("nem"))


def whole_text(column: Column, kind: DataType) -> Column:
    """All text in a value of that type, fields of structs and elements of arrays and maps in order; nulls left out."""
    if isinstance(kind, StructType):
        return F.concat_ws(" ", *[whole_text(column[f.name], f.dataType) for f in kind])
    if isinstance(kind, ArrayType):
        return F.array_join(F.transform(column, lambda x: whole_text(x, kind.elementType)), " ")
    if isinstance(kind, MapType):
        return F.array_join(F.transform(F.map_values(column), lambda x: whole_text(x, kind.valueType)), " ")
    return column.cast("string")


def error_class(retrieved: Column | None = None) -> Column:
    """correct, else by whether a gold token was retrieved and whether the answer has numbers at all. retrieved: the text
    of what was retrieved."""
    retrieved = F.array_join("retrieved", " ") if retrieved is None else retrieved
    found = F.coalesce(F.arrays_overlap(F.col("gold_numbers"), T.extract_numbers(retrieved)), F.lit(False))
    return (
        F.when(M.nem(F.col("answer"), F.col("gold_numbers")) >= 1, "correct")
        .when(~found, "retrieval_failure")
        .when(F.size(T.extract_numbers(F.col("answer"))) == 0, "injection_failure")
        .otherwise("hallucination_despite_injection")
    )


def error_taxonomy(results: DataFrame, gold: DataFrame) -> DataFrame:
    """Counts, and shares of all results, matched or not. What was retrieved may be texts, or facts with all their metadata:
    a gold number in any field counts as retrieved."""
    total = results.count()  # also says into how many parts the results go
    kind = error_class(whole_text(F.col("retrieved"), results.schema["retrieved"].dataType))
    counted = with_gold(results, gold, n=total).groupBy(kind.alias("category")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select("category", "n", F.round(F.col("n") / F.lit(total), 6).alias("fraction"))


def attribution(scored: DataFrame, *keys: str) -> DataFrame:
    """For each result: 0-based rank of the retrieved text that shares most numbers with the answer (the first
    of several; null without any), how many, and the rank of the first that has a gold number."""
    said, gold = T.rounded(T.numbers(T.extract_numbers(F.col("answer")))), T.rounded(T.numbers(F.col("gold_numbers")))
    seen = F.transform("retrieved", lambda d: T.rounded(T.numbers(T.extract_numbers(d))))
    rows = scored.withColumns({"said": said, "gold": gold, "seen": seen})
    overlap = F.transform("seen", lambda s, i: F.struct(F.size(F.array_intersect(s, F.col("said"))).alias("n"), (-i).alias("back")))
    rows = rows.withColumn("best", F.array_max(overlap)).withColumn("gold_rank", F.array_position(F.transform("seen", lambda s: F.arrays_overlap(s, F.col("gold"))), True) - 1)
    hit = F.col("best.n") > 0
    return rows.select(*(keys or ("model", "method", "question")), F.when(hit, -F.col("best.back")).cast("long").alias("best_rank"), F.when(hit, F.col("best.n")).otherwise(0).cast("long").alias("overlap"), F.when(F.col("gold_rank") >= 0, F.col("gold_rank")).cast("long").alias("gold_rank"))


def attribution_summary(scored: DataFrame, *keys: str) -> DataFrame:
    """keys, how many results there are and have facts; in percent of those, how many answers come from a fact and how
    often the gold is among the facts; the mean 0-based rank of the facts that answers come from, and in percent how
    often that is the first, and one of the first three."""
    rows = scored.where("error is null").withColumn("__has", F.size("retrieved") > 0)
    found = attribution(rows, *keys, "__has")
    share = lambda hits, of: F.round(100 * F.try_divide(hits, of), 1)
    has, got = F.count_if("__has"), F.count("best_rank")
    return found.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), has.alias("has_triples"), share(got, has).alias("attributed_pct"), share(F.count("gold_rank"), has).alias("gold_in_context_pct"),
        F.round(F.avg("best_rank"), 2).alias("mean_rank"), share(F.count_if(F.col("best_rank") == 0), got).alias("rank_1_pct"), share(F.count_if(F.col("best_rank") < 3), got).alias("rank_top3_pct"),
    )


def tolerance_sweep(scored: DataFrame, tolerances: tuple[float, ...] = (0.005, 0.01, 0.02, 0.05)) -> DataFrame:
    """Macro average over models of NEM at each tolerance, by method; one pass over the rows."""
    cells = F.explode(F.array(*[F.struct(F.lit(t).alias("tolerance"), M.nem(F.col("answer"), F.col("gold_numbers"), t).alias("nem")) for t in tolerances]))
    rows = scored.select("model", "method", cells.alias("c")).select("model", "method", "c.*")
    means = rows.groupBy("model", "method", "tolerance").agg(F.avg("nem").alias("nem"))
    return means.groupBy("method", "tolerance").agg(F.round(F.avg("nem"), 6).alias("nem"))


def score_vectors(scored: DataFrame, order: str) -> DataFrame:
    """model, method, question, nem (0 or 1): errors left out, the last row of a question counts."""
    ok = scored.where("error is null").withColumn("nem", M.nem(F.col("answer"), F.col("gold_numbers")).cast("int"))
    return ok.groupBy("model", "method", "question").agg(F.max_by("nem", F.col(order)).alias("nem"))


def paired(vectors: DataFrame, a: str, b: str) -> DataFrame:
    """model, question, x, y: both methods' scores of the questions that both answered."""
    one, two = (vectors.where(F.col("method") == m).select("model", "question", F.col("nem").alias(c)) for m, c in ((a, "x"), (b, "y")))
    return one.join(two, ["model", "question"])


def aligned(vectors: DataFrame, methods: list[str]) -> DataFrame:
    """Questions that every method answered, with a column for each."""
    return vectors.groupBy("model", "question").pivot("method", methods).agg(F.first("nem")).dropna(subset=methods)


def delta(results: DataFrame, keys: list[str], condition: str, a: object, b: object, value: str) -> DataFrame:
    """a minus b of a value over the grid of keys, 0 for cells without rows."""
    cells = results.groupBy(*keys).agg(*[F.coalesce(F.round(F.avg(F.when(F.col(condition) == v, F.col(value))), 6), F.lit(0.0)).alias(n) for v, n in ((a, "first"), (b, "second"))])
    return cells.withColumn("delta", F.round(F.col("first") - F.col("second"), 6))


def stratified_sample(items: DataFrame, stratum: str, key: str, n: int, seed: int) -> DataFrame:
    """At most n items: an equal quota of each stratum by seeded hash, topped up from the rest. Only the ids
    of strata, a fixed vocabulary, are counted on the driver."""
    strata = items.select(stratum).distinct().count()
    quota = max(1, n // max(1, strata))
    order = [F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), F.col(key)]
    ranked = items.withColumn("rn", F.row_number().over(Window.partitionBy(stratum).orderBy(*order)))
    ranked = ranked.where(F.col("rn") <= n)  # no more of a stratum can be taken; tasks drop the rest before the shuffle
    return ranked.orderBy((F.col("rn") > quota).cast("int"), *order).limit(n).drop("rn")
