"""Quality rules as weak supervision, in DataFrame operations only.

Each rule votes for or against a document or abstains. Expectation-maximisation over the table of vote
patterns (at most 3 to the power of the number of rules, whatever the corpus) estimates how often each rule
votes which way on good and on bad documents; a document's posterior probability of being good replaces the
demand that it pass every rule.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statweave.llm.common import materialise

WORD_GAP = "[\\x20\\x09-\\x0D]+"
WINDOW = 5


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the counts that rules look at, over whole texts (null text: no words)."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    a = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\x0c\r"))) > 0)
    a = a.select("doc_id", "text", F.array_remove(F.split("text", WORD_GAP), "").alias("words"), lines.alias("lines"))
    a = a.select(
        "doc_id", "words",
        F.size("words").alias("n"),
        F.length(F.array_join("words", "")).alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).alias("n_symbols"),
        F.regexp_count("text", F.lit("\\p{L}")).alias("letters"),
        F.regexp_count("text", F.lit("\\p{Lu}")).alias("capitals"),
        F.regexp_count("text", F.lit("[!?]")).alias("shouts"),
        F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.size(F.filter("words", lambda x: ~F.rlike(x, F.lit("[\\p{L}\\p{N}]")))).alias("bare"),
        F.size(F.filter("lines", lambda x: F.rlike(x, F.lit("[.!?\"'):;,]\\s*$")))).alias("ended"),
    )
    at = lambda i, k: F.get("words", i + k)
    windows = F.when(F.col("n") >= WINDOW, F.transform(F.sequence(F.lit(0), F.greatest(F.col("n") - WINDOW, F.lit(0))), lambda i: F.xxhash64(*[at(i, k) for k in range(WINDOW)])))
    a = a.withColumn("windows", F.coalesce(windows, F.array().cast("array<bigint>")))
    # only texts with a repeated window pay for the sort that finds where the repeats are
    some = F.size("windows") > F.size(F.array_distinct("windows"))
    a = a.withColumn("sorted", F.when(some, F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda j, k: F.coalesce(F.get("sorted", j)["h"] == F.get("sorted", j + k)["h"], F.lit(False))
    found = F.filter(F.sequence(F.lit(0), F.size("sorted") - 1), lambda j: F.when(j > 0, same(j, -1)).otherwise(F.lit(False)) | same(j, 1))
    a = a.withColumn("starts", F.when(F.col("sorted").isNotNull(), F.sort_array(F.transform(found, lambda j: F.get("sorted", j)["i"]))))
    # each repeated window covers what lies before the next one's start, and at most its own words
    cover = F.transform(F.sequence(F.lit(0), F.size("starts") - 1), lambda j: F.least(F.lit(WINDOW), F.coalesce(F.get("starts", j + 1) - F.get("starts", j), F.lit(WINDOW))))
    repeats = F.when(F.col("starts").isNotNull(), F.aggregate(cover, F.lit(0), lambda x, y: x + y)).otherwise(0)
    long = lambda c: F.col(c).cast("long").alias(c)
    return a.select("doc_id", F.col("n").cast("long").alias("n_words"), long("word_chars"), long("n_symbols"), long("n_dup_lines"), repeats.cast("long").alias("n_repeat_words"), long("letters"), long("capitals"), long("shouts"), long("n_lines"), long("bare"), long("ended"))


@dataclass(frozen=True)
class Rule:
    """Votes 1 (good) or 2 (bad), else abstains with 0; bad wins where both hold."""

    name: str
    good: str
    bad: str


#: Conditions on the columns of measures().
RULES = (
    Rule("length", "n_words >= 30", "n_words < 10"),
    Rule("repeats", "100 * n_repeat_words <= 5 * n_words", "100 * n_repeat_words > 20 * n_words"),
    Rule("symbols", "100 * n_symbols <= word_chars", "100 * n_symbols > 5 * word_chars"),
    Rule("dup_lines", "10 * n_dup_lines <= n_lines", "10 * n_dup_lines > 3 * n_lines"),
    Rule("word_length", "word_chars between 3 * n_words and 12 * n_words", "word_chars < 2 * n_words or word_chars > 20 * n_words"),
    Rule("letters", "100 * letters >= 85 * word_chars", "100 * letters < 70 * word_chars"),
    Rule("capitals", "100 * capitals <= 10 * letters", "100 * capitals > 40 * letters"),
    Rule("shouts", "1000 * shouts <= 5 * word_chars", "1000 * shouts > 30 * word_chars"),
    Rule("bare_words", "100 * bare <= 2 * n_words", "100 * bare > 10 * n_words"),
    Rule("line_ends", "100 * ended >= 70 * n_lines", "100 * ended < 30 * n_lines"),
)


def votes(rule: Rule) -> Column:
    return F.when(F.expr(rule.bad), 2).when(F.expr(rule.good), 1).otherwise(0)


def pattern(rules: tuple[Rule, ...]) -> Column:
    """The votes as one number, with a digit to base 3 for each rule."""
    total = F.lit(0)
    for rule in rules:
        total = total * 3 + votes(rule)
    return total


@dataclass
class VoteModel:
    """prior: probability of good. rates[label][rule][vote]: probability of a vote; label 0 is bad."""

    prior: float
    rates: list[list[list[float]]]

    def posterior(self, vote: list[int]) -> float:
        log = [math.log(1 - self.prior), math.log(self.prior)]
        for label in (0, 1):
            for rule, v in enumerate(vote):
                log[label] += math.log(self.rates[label][rule][v])
        return 1 / (1 + math.exp(max(-700, min(700, log[0] - log[1]))))


def unpack(code: int, n: int) -> list[int]:
    out = []
    for _ in range(n):
        code, v = divmod(code, 3)
        out.append(v)
    return out[::-1]


#: What is believed of a rule before any document is seen, as probabilities of abstaining, voting good and
#: voting bad, on bad and on good documents: a bad document trips few rules, a good one hardly any.
BELIEF = ((0.35, 0.35, 0.30), (0.35, 0.645, 0.005))


def fit_votes(counts: dict[int, int], n_rules: int, rounds: int = 200, prior: float = 0.85, strength: float = 0.2) -> VoteModel:
    """Expectation-maximisation over vote patterns. It starts from BELIEF, which fixes what the labels mean,
    and holds to it as to strength times as many documents as there are, shared out by the prior."""
    model = VoteModel(prior, [[list(side) for _ in range(n_rules)] for side in BELIEF])
    table = [(unpack(code, n_rules), n) for code, n in sorted(counts.items())]
    total = sum(counts.values())
    weight = [max(1.0, strength * total * share) for share in (1 - prior, prior)]
    for _ in range(rounds if total else 0):
        mass = [[[weight[label] * x for x in BELIEF[label]] for _ in range(n_rules)] for label in (0, 1)]
        good = weight[1]
        for vote, n in table:
            p = model.posterior(vote)
            good += n * p
            for rule, v in enumerate(vote):
                mass[1][rule][v] += n * p
                mass[0][rule][v] += n * (1 - p)
        new = VoteModel(good / (total + sum(weight)), [[[x / sum(m) for x in m] for m in side] for side in mass])
        moved, model = abs(new.prior - model.prior), new
        if moved < 1e-9:
            break
    return model


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, threshold: float = 0.5) -> DataFrame:
    """One row for each input row: doc_id, the counts, base_failed, n_good and n_bad votes, posterior, kept.

    kept: not base_failed and a posterior of at least threshold. Null and empty texts have no words and fail.
    Repeated rows each get their own result; an empty table gives an empty result; other columns, whatever
    their names, are ignored. What goes to the driver is one count for each vote pattern seen.
    """
    table = materialise(measures(docs, id_col, text_col).withColumn("pattern", pattern(rules)), "measures")
    counts = {r["pattern"]: r["n"] for r in table.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).collect()}
    model = fit_votes(counts, len(rules))
    spark = docs.sparkSession
    known = spark.createDataFrame([(code, *(lambda v: (v.count(1), v.count(2), model.posterior(v)))(unpack(code, len(rules)))) for code in counts], "pattern int, n_good int, n_bad int, posterior double")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = table.join(F.broadcast(known), "pattern", "left")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (F.col("posterior") >= threshold)).alias("kept"), "n_good", "n_bad", "posterior")
