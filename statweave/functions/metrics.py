"""Numeric-accuracy metrics of an answer against gold number tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from statweave.functions.text import extract_numbers, half_even, numbers, rounded


def close(pred: Column, gold: Column, tolerance: Column | float) -> Column:
    """Relative error at most tolerance; a gold zero needs a zero."""
    return F.when(gold == 0, pred == 0).otherwise(F.abs(pred - gold) / F.abs(gold) <= tolerance)


def nem(answer: Column, gold: Column, tolerance: Column | float = 0.01) -> Column:
    """1.0 if any number of the answer is close to any gold number."""
    pred = numbers(extract_numbers(answer))
    return F.exists(numbers(gold), lambda g: F.exists(pred, lambda p: close(p, g, tolerance))).cast("double")


def substring_nem(answer: Column, gold: Column) -> Column:
    return F.exists(gold, lambda g: F.contains(answer, g)).cast("double")


def nf1(answer: Column, gold: Column) -> Column:
    """F1 of the sets of rounded numbers; without gold tokens 1 if the answer has none either, else 0."""
    pred, real = rounded(numbers(extract_numbers(answer))), rounded(numbers(gold))
    hit = F.size(F.array_intersect(pred, real))
    precision, recall = F.try_divide(hit, F.size(pred)), F.try_divide(hit, F.size(real))
    score = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))
    return F.when(F.size(gold) == 0, (F.size(extract_numbers(answer)) == 0).cast("double")).otherwise(score)


def fp(answer: Column, gold: Column) -> Column:
    """Share of the answer's numbers, repeats included, in the gold set; 1.0 for an answer without numbers."""
    pred, real = F.transform(numbers(extract_numbers(answer)), lambda x: half_even(x)), rounded(numbers(gold))
    hit = F.size(F.filter(pred, lambda p: F.array_contains(real, p)))
    return F.when(F.size(pred) == 0, 1.0).otherwise(hit / F.size(pred))
