"""A benchmark of questions from triples: a seeded, stratified sample, a question for each, and its gold figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statweave.functions import text as T
from statweave.operators import evaluation as E
from statweave.operators import triples as K
from statweave.session import cut_lineage
from statweave.sources import files
from statweave.sources import services as V
from statweave.streaming import resume

PROMPT = ("Write one natural question whose answer is the figure of this fact, without giving the figure away.\nSubject: ", "\nRelation: ", "\nFigure: ")


def template_questions() -> V.Generator:
    """Offline: asks for the relation of the subject that a prompt names."""

    def ask(prompts: list[str]) -> list[str]:
        fields = [dict(line.split(": ", 1) for line in (p or "").splitlines() if ": " in line) for p in prompts]
        return [f"What is the {f.get('Relation', '')} of {f.get('Subject', '')}?" for f in fields]

    return ask


def build(triples: DataFrame, n: int, seed: int, call: V.Generator, checkpoint: str) -> DataFrame:
    """id, question, subject, relation, object, gold_numbers, source_topic of n triples whose object holds a number, all
    relations alike as far as they go, in a seeded order. Questions that are asked for go to the checkpoint, so a run
    that was cut short asks only for the others; it is deleted when the benchmark is complete. A question that the
    service gives no answer for is left out of the result and stays to be asked."""
    spark = triples.sparkSession
    chosen = E.stratified_sample(K.with_numbers(triples.where("tid is not null")), "relation", "tid", n, seed)
    chosen = chosen.withColumn("shuffled", F.md5(F.concat(F.lit(f"order{seed}:"), F.col("tid").cast("string"))))
    numbered = cut_lineage(files.positions(chosen, "shuffled", "tid").drop("shuffled").withColumnRenamed("position", "id"))
    subject, relation, figure = PROMPT
    prompt = F.concat(F.lit(subject), "subject", F.lit(relation), "relation", F.lit(figure), "object")
    ask = lambda rows: V.generate(rows.withColumn("prompt", prompt), "prompt", call).select("tid", F.col("answer").alias("question"), "error")
    asked = cut_lineage(resume.checkpointed(numbered, "tid", checkpoint, ask).select("tid", "question"))
    out = numbered.join(asked, "tid").select("id", "question", "subject", "relation", "object", T.extract_numbers(F.col("object")).alias("gold_numbers"), F.coalesce("source_topic", F.lit("")).alias("source_topic"))
    if asked.count() == numbered.count():
        resume.finish(spark, checkpoint)
    return out
