"""Significance and agreement."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def mcnemar(pairs: DataFrame, *keys: str) -> DataFrame:
    """The 2x2 counts of x, y and the exact two-sided binomial p of the discordant pairs, in log space."""
    cell = lambda x, y: F.count_if((F.col("x") == x) & (F.col("y") == y))
    t = pairs.groupBy(*keys).agg(cell(1, 1).alias("n11"), cell(1, 0).alias("n10"), cell(0, 1).alias("n01"), cell(0, 0).alias("n00"))
    return t.withColumn("p", F.round(exact_binomial(F.col("n10"), F.col("n01")), 5))


def contrasts(vectors: DataFrame, named: dict[str, tuple[str, str]]) -> DataFrame:
    """For each named pair of methods, over all models pooled: contrast, the 2x2 counts, exact p, and delta, the
    difference of means. vectors: model, method, question, nem; read and shuffled once for all pairs."""
    arms = [(name, side, method) for name, pair in named.items() for side, method in zip("xy", pair, strict=True)]
    arm = F.array(*[F.struct(F.lit(name).alias("contrast"), F.lit(side).alias("side"), F.lit(method).alias("of")) for name, side, method in arms])
    rows = vectors.select("model", "question", "nem", F.explode(F.filter(arm, lambda a: a["of"] == F.col("method"))).alias("arm")).select("*", "arm.contrast", "arm.side")
    side = lambda s: F.max(F.when(F.col("side") == s, F.col("nem"))).alias(s)
    pairs = rows.groupBy("contrast", "model", "question").agg(side("x"), side("y")).dropna(subset=["x", "y"])
    n = F.col("n11") + F.col("n10") + F.col("n01") + F.col("n00")
    return mcnemar(pairs, "contrast").withColumn("delta", F.round((F.col("n10") - F.col("n01")) / n, 6))


def binomial_p(b: int, c: int) -> float:
    """min(1, 2 P(X <= min(b, c))), X binomial with b + c trials at a half; 1 without trials. Terms are summed from the
    largest down, each from the one before it; they shrink faster than a bell curve, so some fifty standard deviations
    of them hold the sum to the last digit, whatever the counts."""
    n, k = b + c, min(b, c)
    if not n:
        return 1.0
    i = np.arange(k, max(0, k - 100 - int(25 * math.sqrt(n))), -1, dtype=np.float64)
    first = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + n * math.log(0.5)
    rest = np.exp(np.cumsum(np.log(i) - np.log(n - i + 1))).sum()
    return min(1.0, 2 * math.exp(first) * (1 + rest))


@F.arrow_udf(DoubleType())
def exact_binomial(b: pa.Array, c: pa.Array) -> pa.Array:
    return pa.array([binomial_p(x, y) for x, y in zip(b.to_pylist(), c.to_pylist(), strict=True)], pa.float64())


def stars(p: str) -> Column:
    return F.when(F.col(p) < 0.001, "***").when(F.col(p) < 0.01, "**").when(F.col(p) < 0.05, "*").otherwise("")


def bonferroni(tests: DataFrame, *ps: str, alpha: float = 0.05) -> DataFrame:
    """Each comparison's p values against alpha over the number of comparisons: alpha, and significant and stars, for
    several tests of a comparison with the name of the p value after them."""
    ps = ps or ("p",)
    total = tests.agg(F.count(F.lit(1)).alias("__m"))
    out = tests.join(F.broadcast(total))  # one row
    for p in ps:
        end = "" if len(ps) == 1 else f"_{p}"
        out = out.withColumns({f"significant{end}": F.col(p) < F.lit(alpha) / F.col("__m"), f"stars{end}": stars(p)})
    return out.withColumn("alpha", F.round(F.lit(alpha) / F.col("__m"), 6)).drop("__m")


#: Groups whose sums a task holds at once.
HELD_GROUPS = 50


def paired_bootstrap(pairs: DataFrame, keys: list[str], rounds: int = 10_000, seed: int = 42) -> DataFrame:
    """keys, n, delta, low, high, p, significant: Poisson bootstrap of the mean difference of scores x and y, of any kind.

    In a replicate each pair counts a Poisson(1) number of times, so pairs of equal difference count a Poisson(their
    number) of times together; what is drawn is that, from a generator seeded by the key and the difference, whatever
    the partitions. A task's sums are a fixed vector of replicates for each key, which Spark adds up. Pairs with a null
    score are left out; a replicate that draws nothing counts as no difference."""
    rows = pairs.where("x is not null and y is not null").select(*keys, (F.col("x").cast("double") - F.col("y").cast("double")).alias("d"))
    counts = rows.groupBy(*keys, "d").agg(F.count(F.lit(1)).alias("n"))
    numbered = counts.withColumn("seed", F.xxhash64(F.lit(seed), *keys, "d")).withColumn("group", F.xxhash64(*keys))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for group, d, n, own in zip(*(batch.column(c).to_pylist() for c in ("group", "d", "n", "seed")), strict=True):
                if group not in held and len(held) == HELD_GROUPS:
                    yield from map(_replicates, held.items())
                    held = {}
                times = np.random.default_rng(own & (1 << 64) - 1).poisson(n, rounds)
                sums = held.setdefault(group, np.zeros((2, rounds)))
                sums += [times * d, times]
        yield from map(_replicates, held.items())

    drawn = numbered.select("group", "d", "n", "seed").mapInArrow(draw, "group long, replicate int, total double, times double")
    means = drawn.groupBy("group", "replicate").agg(F.coalesce(F.try_divide(F.sum("total"), F.sum("times")), F.lit(0.0)).alias("mean"))
    at = lambda share: F.get("means", F.lit(int(share * rounds)))
    share = lambda test: F.size(F.filter("means", test)) / rounds
    ends = means.groupBy("group").agg(F.sort_array(F.collect_list("mean")).alias("means")).select(
        "group", at(0.025).alias("low"), at(0.975).alias("high"), F.least(F.lit(1.0), 2 * F.least(share(lambda m: m <= 0), share(lambda m: m >= 0))).alias("p")
    )
    whole = numbered.groupBy("group", *keys).agg(F.sum("n").alias("n"), (F.sum(F.col("d") * F.col("n")) / F.sum("n")).alias("delta"))
    return whole.join(ends, "group").select(*keys, "n", "delta", "low", "high", "p", ((F.col("low") > 0) | (F.col("high") < 0)).alias("significant"))


def _replicates(held: tuple[int, np.ndarray]) -> pa.RecordBatch:
    group, (total, times) = held
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(total), group)), pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total), pa.array(times)], ["group", "replicate", "total", "times"])


def kappa(ratings: DataFrame, a: str, b: str) -> DataFrame:
    """Cohen's kappa of two raters: n, agreement, expected, kappa, interpretation; 1 if chance agrees always, 0
    without rows. Everything comes from the confusion counts."""
    cells = ratings.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    rows, columns = cells.groupBy(F.col("a").alias("v")).agg(F.sum("n").alias("x")), cells.groupBy(F.col("b").alias("v")).agg(F.sum("n").alias("y"))
    chance = rows.join(columns, "v").agg(F.coalesce(F.sum(F.col("x").cast("double") * F.col("y")), F.lit(0.0)).alias("chance"))
    totals = cells.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(F.col("a") == F.col("b"), F.col("n"))), F.lit(0)).alias("same"))
    t = totals.join(F.broadcast(chance)).select("n", F.coalesce(F.try_divide("same", "n"), F.lit(0.0)).alias("po"), F.coalesce(F.try_divide("chance", F.col("n").cast("double") * F.col("n")), F.lit(0.0)).alias("pe"))
    value = F.when(F.col("n") == 0, 0.0).when(F.col("pe") == 1, 1.0).otherwise((F.col("po") - F.col("pe")) / (1 - F.col("pe")))
    out = t.withColumn("kappa", F.round(value, 6))
    band = F.when(F.col("kappa") >= 0.81, "Almost perfect").when(F.col("kappa") >= 0.61, "Substantial").when(F.col("kappa") >= 0.41, "Moderate").when(F.col("kappa") >= 0.21, "Fair").otherwise("Slight/Poor")
    return out.select("n", F.round("po", 6).alias("agreement"), F.round("pe", 6).alias("expected"), "kappa", band.alias("interpretation"))


def both_annotators(one: DataFrame, two: DataFrame, *scores: str) -> DataFrame:
    """Samples that both annotators rated: sample_id, and for each score two columns that end in _a and _b. A sample that
    an annotator rated twice counts once, by the larger scores."""
    of = lambda df, end: df.groupBy("sample_id").agg(*[F.max(s).alias(f"{s}_{end}") for s in scores])
    return of(one, "a").join(of(two, "b"), "sample_id")


def annotation_buckets(ratings: DataFrame, a: str, b: str, good: float = 1.5, fair: float = 0.5, top: int = 2) -> DataFrame:
    """How many items are good, fair or bad by the two scores' mean, how many both rate top, how many disagree by 2."""
    mean = (F.col(a) + F.col(b)) / 2
    return ratings.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(mean >= good).alias("good"), F.count_if((mean >= fair) & (mean < good)).alias("fair"), F.count_if(mean < fair).alias("bad"),
        F.count_if((F.col(a) == top) & (F.col(b) == top)).alias("strict"), F.count_if(F.abs(F.col(a) - F.col(b)) >= 2).alias("disagreements"),
    )


def validity(ratings: DataFrame, *scores: str, least: float = 1.5) -> DataFrame:
    """n, and the share of items whose mean is at least least in every score, in percent to one place."""
    valid = F.lit(True)
    for s in scores:
        valid = valid & ((F.col(f"{s}_a") + F.col(f"{s}_b")) / 2 >= least)
    return ratings.agg(F.count(F.lit(1)).alias("n"), F.round(100 * F.avg(valid.cast("double")), 1).alias("valid_pct"))


def disagreements(ratings: DataFrame, score: str, least: int = 2) -> DataFrame:
    """sample_id and both scores where they differ by least or more."""
    return ratings.where(F.abs(F.col(f"{score}_a") - F.col(f"{score}_b")) >= least).select("sample_id", F.col(f"{score}_a").alias("a"), F.col(f"{score}_b").alias("b"))
