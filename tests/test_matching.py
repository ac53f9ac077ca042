"""Containment by grams, and the bootstrap of any score, against brute force."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from statweave.operators import containing as I
from statweave.operators import statistics as S


@pytest.mark.parametrize("seed", [1, 2])
def test_containment_by_brute_force(spark, seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "ab", "b", "the", "é", "ba\nb", "", "x"])
    texts = [" ".join(word() for _ in range(rng.randrange(40))) for _ in range(60)] + [None, "", "ab"]
    texts += texts[:3]
    needles = [None, "", "a", "zz", "ab", " ", "é x", "b the"]
    for _ in range(80):
        text = rng.choice(texts[:60])
        i = rng.randrange(len(text) + 1)
        needles.append(text[i : i + rng.randrange(25)] + rng.choice(["", "", "q"]))
    items = spark.createDataFrame([(i % 70, n) for i, n in enumerate(needles)], "item int, needle string")
    docs = spark.createDataFrame([(i % 50, t) for i, t in enumerate(texts)], "doc int, text string")
    got = Counter(map(tuple, I.containment(items, docs, "item", "needle", "doc", "text").collect()))
    assert got == Counter((i % 70, j % 50) for i, n in enumerate(needles) for j, t in enumerate(texts) if n and t is not None and n in t)
    assert I.containment(items.limit(0), docs, "item", "needle", "doc", "text").count() == I.containment(items, docs.limit(0), "item", "needle", "doc", "text").count() == 0


def test_characters_are_looked_at_once_for_each_word(spark, monkeypatch):
    """Short needles are looked for by characters in the different words of all texts, not in every text."""
    seen, plain = [], I._by_grams
    monkeypatch.setattr(I, "_by_grams", lambda needles, texts: (seen.append(sorted(r.text for r in texts.collect())), plain(needles, texts))[1])
    docs = spark.range(50).selectExpr("id as doc", "concat('the lake of', repeat(' the', int(id)), if(id = 7, ' lakes', '')) as text")
    items = spark.createDataFrame([(0, "ake"), (1, "e l"), (2, "of"), (3, "akes"), (4, " "), (5, "he the"), (6, "zz"), (7, " of the"), (8, "e of t"), (9, "e zz t"), (10, "lake of the the the")], "item int, needle string")
    got = Counter(r.item for r in I.containment(items, docs, "item", "needle", "doc", "text").collect())
    assert got == {0: 50, 1: 50, 2: 50, 3: 1, 4: 50, 5: 48, 7: 49, 8: 49, 10: 47}
    assert sorted(map(len, seen)) == [4, 50] and ["lake", "lakes", "of", "the"] in seen  # all texts for the long needle alone


@pytest.mark.parametrize("kind", ["binary", "tenths", "real"])
def test_bootstrap_of_any_score(spark, kind):
    rng = np.random.default_rng(3)
    x, y = rng.random(300), rng.random(300) - 0.06
    if kind != "real":
        x, y = (np.round(v * (10 if kind == "tenths" else 1)) / (10 if kind == "tenths" else 1) for v in (x, y))
    rows = [("m", float(a), float(b)) for a, b in zip(x, y, strict=True)] + [("m", None, 1.0), ("n", 0.5, 0.5), ("n", 0.25, 0.25)]
    pairs = spark.createDataFrame(rows, "model string, x double, y double")
    found = {r.model: r for r in S.paired_bootstrap(pairs, ["model"]).collect()}
    d = np.sort((x - y)[rng.integers(0, 300, (10_000, 300))].mean(axis=1))
    got, error = found["m"], (x - y).std() / 300**0.5
    assert got.n == 300 and got.delta == pytest.approx((x - y).mean())
    assert abs(got.low - d[250]) < 0.15 * error and abs(got.high - d[9750]) < 0.15 * error
    assert got.p == pytest.approx(min(1, 2 * min((d <= 0).mean(), (d >= 0).mean())), abs=0.02) and got.significant == (got.low > 0 or got.high < 0)
    assert tuple(found["n"])[1:] == (2, 0.0, 0.0, 0.0, 1.0, False)
    again = {r.model: r for r in S.paired_bootstrap(pairs.repartition(5), ["model"]).collect()}
    assert again["m"].low == pytest.approx(got.low, abs=1e-12) and again["m"].p == got.p
