"""The answering methods' shared parts, and the error classes over facts with metadata."""

from __future__ import annotations

from pyspark.sql import functions as F

from statweave.operators import evaluation as E
from statweave.plans import answering as A
from statweave.plans import experiments as N
from statweave.sources import services as V


def test_prompts_are_the_same_in_methods_and_grids(spark):
    rows = spark.createDataFrame([(1, "q?", "[1] a"), (2, "r?", None)], "qid long, question string, context string")
    got = rows.select("qid", A.prompt().alias("alone"), A.prompt(F.lit(True)).alias("grounded"), A.prompt(F.lit(False)).alias("not_grounded")).orderBy("qid").collect()
    assert [tuple(r)[1:] for r in got] == [("Question: q?", "Context:\n[1] a\n\nQuestion: q?", "Question: q?"), ("Question: r?",) * 3]
    questions = spark.createDataFrame([(1, "q?")], "qid long, question string")
    alone = A.zero_shot(questions, list).first()
    s = N.Services({}, list)
    cells = N.grid(method=("zero_shot",))
    grid = N.answer_cells(N.with_cells(questions.withColumn("vector", F.lit(None).cast("array<double>")), cells), cells, s).first()
    assert alone.answer == grid.answer == "Question: q?"


def _always(word):
    return lambda prompts: [word] * len(prompts)


def test_only_rejected_drafts_are_revised(spark):
    drafts = spark.createDataFrame([(1, "q", "good", "[1] good"), (2, "q", "bad", "[1] good"), (3, "q", "bad", None)], "qid long, question string, draft string, context string")
    verify = V.supporting_verifier()
    out = {r.qid: r for r in A.checked(drafts, "conli", verify, list).collect()}
    assert out[1].answer == "good" and out[1].latency_ms == 0
    assert out[2].answer.startswith("Context:\n[1] good\n\nQuestion: q\nFirst answer: bad\nTo be corrected: CONTRADICTED")
    assert A.NO_FACTS in out[3].answer
    # the word of the other method doesn't reject
    assert all(r.answer == r.draft for r in A.checked(drafts, "cove", _always("CONTRADICTED"), list, _always("c")).collect())
    out = A.checked(drafts, "cove", _always("INCORRECT"), list, _always("c"))
    assert "claims" not in out.columns and all("To be corrected: INCORRECT" in r.answer for r in out.collect())


def test_checks_take_no_drafts(spark):
    none = spark.createDataFrame([], "qid long, question string, draft string, context string")
    for method in A.CHECKS:
        assert A.checked(none, method, list, list).count() == 0


def test_error_classes_read_every_field(spark):
    kind = "array<struct<document: string, object: string, more: struct<topics: array<string>, page: int>, tags: map<string, string>>>"
    fact = lambda **kv: {"document": None, "object": None, "more": {"topics": None, "page": None}, "tags": None} | kv
    found = [
        [fact(document="it is 42")],
        [fact(object="about 42 USD")],
        [fact(more={"topics": ["x", None, "of 42"], "page": None})],
        [fact(more={"topics": [], "page": 42})],
        [fact(tags={"42": "x"}), fact(tags={"a": "42"})],
        [fact(tags={"42": "only a name"})],
        [fact(), None],
        [],
        None,
    ]
    rows = spark.createDataFrame([(i, f"q{i}", "no number", f) for i, f in enumerate(found)], f"rid long, question string, answer string, retrieved {kind}")
    gold = spark.createDataFrame([(i, f"q{i}", ["42"]) for i in range(len(found))], "id long, question string, gold_numbers array<string>")
    got = {r.category: r.n for r in E.error_taxonomy(rows, gold).collect()}
    assert got == {"injection_failure": 5, "retrieval_failure": 4}
    none = spark.createDataFrame([], rows.schema)
    assert E.error_taxonomy(none, gold).count() == 0


def test_error_classes_of_texts_and_answers(spark):
    rows = spark.createDataFrame(
        [(1, "q", "it is 42", ["42"]), (1, "q", "it is 7", ["has 42"]), (1, "q", "none", ["has 42", None]), (1, "q", "7", []), (1, "other", "42", ["42"])],
        "rid long, question string, answer string, retrieved array<string>",
    )
    gold = spark.createDataFrame([(1, "q", ["42"])], "id long, question string, gold_numbers array<string>")
    got = {r.category: (r.n, r.fraction) for r in E.error_taxonomy(rows, gold).collect()}
    assert got == {"correct": (1, 0.2), "hallucination_despite_injection": (1, 0.2), "injection_failure": (1, 0.2), "retrieval_failure": (1, 0.2)}


def test_gold_is_never_broadcast(spark):
    """Gold that looks small by its files is joined by a shuffle, in parts that are not joined up again."""
    gold = spark.range(50).selectExpr("id", "concat('q', id) as question", "array(cast(id as string)) as gold_numbers")
    rows = spark.range(150).selectExpr("concat('q', id % 50) as question", "cast(id % 50 as string) as answer", "'m' as method", "cast(id as double) as latency_ms", "id as tokens")
    joined = E.with_gold(rows, gold)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert joined.count() == 150 and joined.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert "Broadcast" not in plan(joined)
    # of the rows' side and the groups' side only the groups may be
    assert "BuildLeft" not in plan(E.percentile_index(rows.limit(5), ["method"], "latency_ms", 0.95, "p"))
    got = E.summary(joined, "method").first()
    assert (got.n_evaluated, got.nem, got.latency_p95_ms) == (150, 1.0, 142.0)


def test_parts_of_the_gold_join_grow_with_the_rows(spark, monkeypatch):
    """However many rows there are on either side, a task of the join, and of what is worked out from it, holds few."""
    gold = spark.range(50).selectExpr("id", "concat('q', id) as question", "array(cast(id as string)) as gold_numbers")
    rows = spark.range(150).selectExpr(
        "concat('q', id % 50) as question", "concat('m', id % 3) as method", "cast(id % 50 as string) as answer", "if(id % 10 = 0, 'e', null) as error", "array(concat('has ', id % 50), 'and 7') as retrieved"
    )
    session = int(spark.conf.get("spark.sql.shuffle.partitions"))
    few = sorted(map(str, E.with_gold(rows, gold).collect()))
    summary = sorted(map(str, E.attribution_summary(E.with_gold(rows, gold), "method").collect()))
    monkeypatch.setattr(E, "PART_ROWS", 10)
    joined = E.with_gold(rows, gold)
    assert joined.rdd.getNumPartitions() == 15 > session and sorted(map(str, joined.collect())) == few
    assert E.with_gold(rows.limit(5), gold).rdd.getNumPartitions() == 5 > session  # more gold than results
    assert E.with_gold(rows.limit(0), gold.limit(0)).count() == 0
    found = E.attribution_summary(joined, "method")
    assert "hashpartitioning(question#" in (plan := found._jdf.queryExecution().executedPlan().toString()) and ", 15)" in plan
    assert sorted(map(str, found.collect())) == summary


def test_error_classes_are_counted_in_small_parts(spark, monkeypatch):
    """Shares are of all results, matched or not, and no other join is needed for their number."""
    gold = spark.range(50).selectExpr("id", "concat('q', id) as question", "array(cast(id as string)) as gold_numbers")
    rows = spark.range(200).selectExpr("concat('q', id % 100) as question", "cast(id % 100 as string) as answer", "array(concat('has ', id)) as retrieved")
    monkeypatch.setattr(E, "PART_ROWS", 10)
    found = E.error_taxonomy(rows, gold)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(question#" in plan and ", 20)" in plan and "Broadcast" not in plan and "NestedLoop" not in plan
    assert [tuple(r) for r in found.collect()] == [("correct", 100, 0.5)]
