"""Language identification in two steps: family first, then the languages within it.

Linear support vector machines look at hashed letter n-grams. The first decide the family, one against the
rest; within a family one machine for each pair of languages votes. Both are trained on the driver from a
bounded sample of each language.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statweave.llm.common import BLOCK, bound_batches, by_slices, fold, text_buffers

#: Closely related languages, by ISO 639-1 code; any other language is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb".split(), "romance": "fr es it pt ro ca gl oc la".split(), "slavic": "ru uk be pl cs sk bg sr hr sl mk".split(),
    "uralic": "fi et hu".split(), "turkic": "tr az kk uz ky tk".split(), "indic": "hi ur bn mr gu pa ne".split(), "semitic": "ar he am mt".split(),
}
#: Most rows of a language that are learned from, and of all languages together; where there are so many languages
#: that this bound bites, each has its equal share, of one row at least.
TRAIN_ROWS, ALL_ROWS = 800, 12_800
DIMENSIONS = 4096
UNKNOWN = "und"


def family_of(language: str) -> str:
    base = language.lower().replace("_", "-").split("-")[0]
    return next((name for name, members in FAMILIES.items() if base in members), f"own:{language}")


_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def gram_counts(text: pa.Array) -> np.ndarray:
    """For each row, how often each hashed n-gram occurs: two, three and four bytes over letters and the spaces
    between words. Temporaries are held for one block of bytes at a time, however long a text."""
    data, offsets = text_buffers(text)
    n = len(offsets) - 1
    counts = np.zeros((n, DIMENSIONS), np.float32)
    letters = np.frombuffer(data.tobytes().translate(_LETTERS), np.uint8)
    for p in range(0, data.size, BLOCK):
        q = min(data.size, p + BLOCK)
        part = letters[p : q + 3].astype(np.uint32)
        edges = np.clip(offsets, p, p + part.size)
        rows = np.repeat(np.arange(n), np.diff(edges))
        first, last = int(rows[0]), int(rows[-1]) + 1
        code, found = part, []
        for width in (2, 3, 4):
            code = (code[:-1] << np.uint32(8)) | part[width - 1 :]
            m = min(q - p, code.size)
            inside = (rows[:m] == rows[width - 1 : width - 1 + m]) & ((code[:m] & np.uint32(0xFFFF)) != 0x2020)
            mixed = (code[:m][inside] + np.uint32(width)) * np.uint32(2654435761)
            found.append((rows[:m][inside] - first) * DIMENSIONS + (mixed >> np.uint32(20)).astype(np.int64))
        counts[first:last] += np.bincount(np.concatenate(found), minlength=(last - first) * DIMENSIONS).reshape(-1, DIMENSIONS)
    return counts


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def vectors(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Square roots of n-gram shares, so that each row has length one, and the rows' numbers of n-grams."""
    counts = gram_counts(text)
    size = counts.sum(axis=1)
    return np.sqrt(counts / np.maximum(size[:, None], 1)), size


def profile(x: np.ndarray) -> np.ndarray:
    """Logarithms of the mean n-gram shares of rows, smoothed."""
    return np.log(np.square(x).mean(axis=0) + 0.1 / DIMENSIONS).astype(np.float32)


def likeness(x: np.ndarray, size: np.ndarray, usual: np.ndarray, middle: float) -> np.ndarray:
    """How far the mean log-share of a row's n-grams lies above the language's middle; short rows, whose mean
    says little, are drawn towards it."""
    return (np.square(x) @ usual - middle) * np.sqrt(size / (size + 100))


def familiar(x: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, float, float]:
    """A language's profile, its middle, and the least likeness that its texts have: three times as far below the
    middle as the lowest hundredth of the labelled rows, each half held against the other half's profile."""
    if len(x) < 2:
        return profile(x), 0.0, -np.inf
    half = np.arange(len(x)) % 2 == 0
    own = np.zeros(len(x))
    for a in (half, ~half):
        own[a] = np.square(x[a]) @ profile(x[~a])
    middle = float(np.median(own))
    least = np.quantile((own - middle) * np.sqrt(size / (size + 100)), 0.01, method="lower")
    return profile(x), middle, float(3 * least)


def fit_svm(x: np.ndarray, positive: np.ndarray, cost: float = 20.0, rounds: int = 150) -> np.ndarray:
    """Weights and, last, the bias of a linear machine: squared hinge loss, the classes weighing alike, by
    accelerated gradient steps."""
    n = len(x)
    y = np.where(positive, 1, -1).astype(np.float32)
    weight = np.where(positive, 0.5 / max(1, positive.sum()), 0.5 / max(1, n - positive.sum())).astype(np.float32) * cost
    w = momentum = np.zeros(x.shape[1] + 1, np.float32)
    step = 1 / (1 + 2 * cost * 2)
    t = 1.0
    for _ in range(rounds):
        slack = weight * y * np.maximum(0, 1 - y * (x @ momentum[:-1] + momentum[-1]))
        new = momentum - step * (momentum - 2 * np.append(slack @ x, slack.sum()))
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        momentum = (new + (t - 1) / after * (new - w)).astype(np.float32)
        w, t = new.astype(np.float32), after
    return w


@dataclass
class Identifier:
    families: list[str]
    members: dict[str, list[str]]
    family_weights: np.ndarray  # a row for each family
    pair_weights: dict[tuple[str, str], np.ndarray] = field(default_factory=dict)
    known: dict[str, tuple[np.ndarray, float, float]] = field(default_factory=dict)  # by language, from familiar()

    def predict(self, text: pa.Array) -> tuple[list[str], np.ndarray]:
        names, scores = np.full(len(text), UNKNOWN, object), np.zeros(len(text))
        known = np.array([has_letter(t or "") for t in text.to_pylist()], bool)
        if not self.families or not known.any():
            return names.tolist(), scores
        plain, size = vectors(text)
        x = np.hstack([plain, np.ones((len(plain), 1), np.float32)])
        margins = x @ self.family_weights.T
        best = margins.argmax(axis=1)
        sure = _squash(margins.max(axis=1) - (np.sort(margins, axis=1)[:, -2] if len(self.families) > 1 else -1))
        for k, family in enumerate(self.families):
            here = np.flatnonzero((best == k) & known)
            languages = self.members[family]
            votes = np.zeros((here.size, len(languages)))
            margin = np.zeros((here.size, len(languages)))
            for i, j in itertools.combinations(range(len(languages)), 2):
                m = x[here] @ self.pair_weights[languages[i], languages[j]]
                votes[:, i] += m >= 0
                votes[:, j] += m < 0
                margin[:, i] += m
                margin[:, j] -= m
            rank = votes + 0.5 * np.tanh(margin)  # margins break ties of votes
            chosen = rank.argmax(axis=1)
            names[here] = np.array(languages, object)[chosen]
            own = _squash(margin[np.arange(here.size), chosen] / max(1, len(languages) - 1) * 2) if len(languages) > 1 else 1.0
            scores[here] = sure[here] * own
            for j, language in enumerate(languages):  # a text unlike all that was learned is in none of the languages
                rows = here[chosen == j]
                usual, middle, least = self.known[language]
                scores[rows[likeness(plain[rows], size[rows], usual, middle) < least]] = 0
        return names.tolist(), scores


def _squash(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-2 * np.clip(margin, -15, 15)))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, held_out: int = 2, train_rows: int = TRAIN_ROWS) -> Identifier:
    """Fits on at most train_rows rows of each language outside the held-out fold, and ALL_ROWS in all, those whose
    id, text and row number hash least. A threshold for the language leaves about twice as many, so that the texts
    that are sorted to choose them are few; the driver holds them as one matrix of at most 210 MB."""
    spark = docs.sparkSession
    bound_batches(spark)
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"))
    source = source.where(fold(F.col("id"), folds) != held_out).where("lang is not null and text is not null and text <> ''")
    counts = spark.createDataFrame(source.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect(), "lang string, n long")
    each = max(1, min(train_rows, ALL_ROWS // max(1, counts.count())))
    # of repeated rows each has a number of its own, so that none is taken for all
    share = F.pmod(F.xxhash64("id", "text", F.monotonically_increasing_id()), F.lit(1 << 30)) / float(1 << 30)

    def run(text: pa.Array) -> pa.Array:
        x, size = vectors(text)
        rows, at = np.nonzero(x)
        offsets = pa.array(np.searchsorted(rows, np.arange(len(x) + 1)).astype(np.int32))
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(offsets, pa.array(at.astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(x[rows, at])), pa.array(size)], names=["at", "n", "size"])

    @F.arrow_udf("struct<at: array<int>, n: array<float>, size: float>")
    def measure(text: pa.Array) -> pa.Array:
        return by_slices(run)(text)

    # few more than are wanted pass the threshold, and the first of them are taken
    near = source.withColumn("share", share).join(F.broadcast(counts), "lang").where(F.col("share") * F.col("n") < 2 * each + 20)
    first = F.row_number().over(Window.partitionBy("lang").orderBy("share", F.xxhash64("id", "text")))
    chosen = near.withColumn("nth", first).where(F.col("nth") <= each)
    got = chosen.select("lang", "nth", measure("text").alias("x")).toArrow().combine_chunks().sort_by([("lang", "ascending"), ("nth", "ascending")])  # the same sums whatever the order of arrival
    languages = np.array(got.column("lang").to_pylist(), object)
    x = np.zeros((len(languages), DIMENSIONS), np.float32)
    size = np.zeros(len(languages), np.float32)
    for i, row in enumerate(got.column("x").combine_chunks() if got.num_rows else []):
        x[i, row["at"].values.to_numpy()] = row["n"].values.to_numpy()
        size[i] = row["size"].as_py()
    del got
    names = sorted(set(languages))
    members: dict[str, list[str]] = {}
    for name in names:
        members.setdefault(family_of(name), []).append(name)
    families = sorted(members)
    kin = np.array([family_of(v) for v in languages], object)
    weights = np.stack([fit_svm(x, kin == f) for f in families]) if families else np.zeros((0, DIMENSIONS + 1), np.float32)
    model = Identifier(families, members, weights, known={name: familiar(x[languages == name], size[languages == name]) for name in names})
    for names in members.values():
        for a, b in itertools.combinations(names, 2):
            own = (languages == a) | (languages == b)
            model.pair_weights[a, b] = fit_svm(x[own], languages[own] == a)
    return model


def predictor(model: Identifier):
    """A column function from a text to struct(lang, score)."""

    def run(text: pa.Array) -> pa.Array:
        names, scores = model.predict(text)
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["lang", "score"])

    @F.arrow_udf("struct<lang: string, score: double>")
    def column(text: pa.Array) -> pa.Array:
        return by_slices(run)(text)

    return column


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, held_out: int = 2, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """One row for each input row: doc_id, held_out, lang_pred, score (0 to 1).

    Only texts make a prediction. A text whose n-grams are unlike those of its language's labelled rows scores 0:
    it is in none of the learned languages. A text that is null or has no letter is "und" with score 0, as is every
    text where no language could be learned; repeated rows are predicted alike; an empty table gives an empty
    result; other columns, whatever their names, are ignored.
    """
    run = predictor(train(docs, id_col, text_col, lang_col, folds, held_out, train_rows))
    out = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), (fold(F.col(f"`{id_col}`"), folds) == held_out).alias("held_out"), run(F.col(f"`{text_col}`").cast("string")).alias("p"))
    return out.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))
