"""Stateful streams, table functions, calls side by side, bounded adjacency, the Pareto front and exact rounding."""

from __future__ import annotations

import datetime as dt
import random
import time

import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from statweave.functions import table_functions
from statweave.functions import text as T
from statweave.operators import retrieval as R
from statweave.operators import skyline as Y
from statweave.operators import triples as K
from statweave.plans import round_trips
from statweave.sources import services as V
from statweave.streaming import once

HOUR = 3_600_000
SCHEMA = "key string, ts timestamp, error boolean, body string"


def at(hours: float) -> dt.datetime:
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=hours)


def test_records_are_taken_once_and_failures_come_back(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "progress"))

    def feed(*rows):
        spark.createDataFrame([(k, at(h), e, b) for k, h, e, b in rows], SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        once.run_available(once.take_once(stream, "2 hours", 3 * HOUR, 20 * HOUR), out, checkpoint)
        found = spark.read.parquet(out).collect()
        return sorted((r.key, r.status, r.body, r.tries) for r in found)

    # a: twice good; b: failed; c: failed, then good; null keys and nulls in other columns
    first = feed(("a", 1, False, "a1"), ("a", 0, False, "a0"), ("b", 0, True, "b0"), ("c", 0, True, "c0"), ("c", 1, None, None), (None, 1, False, "none"), ("d", 4, True, "d4"))
    assert first == [("a", "taken", "a0", 0), ("c", "taken", None, 0)]
    # the watermark is at 8 hours: b has waited, d too; repeats of a and late rows change nothing
    second = feed(("a", 9, False, "a9"), ("e", 1, False, "late"), ("z", 10, True, "z"))
    assert second == [*first[:1], ("b", "retry", "b0", 1), *first[1:], ("d", "retry", "d4", 1)]
    # b fails anew and comes back again, d succeeds after it came back
    third = feed(("b", 10, True, "b10"), ("d", 11, False, "d11"), ("y", 16, True, "y"))
    assert [x for x in third if x not in second] == [("b", "retry", "b10", 2), ("d", "taken", "d11", 1), ("z", "retry", "z", 1)]
    # nothing new, then a time at which a is forgotten, and a again
    assert feed() == third
    forgotten = feed(("y", 30, False, "y30"))
    assert [x for x in forgotten if x not in third] == [("y", "taken", "y30", 0)]
    assert ("a", "taken", "again", 0) in feed(("a", 31, False, "again"))


def test_table_functions_are_the_columns(spark):
    table_functions.register(spark)
    rng = random.Random(3)
    parts = ["5 %", "-1,234.50", "12,34", "٣", "3 %", "about 7", "KM² 5 km²", "5 Kg", "ISBN 1", "== x", "^ 2", "long words that go on and on and on in one sentence", ".", "! ", "? ", "\n", " "]
    texts = [" ".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(400)] + ["", None, "1 " * 200_000]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = spark.sql("SELECT id, pos, token, value FROM {rows}, LATERAL numbers_in(text)", rows=rows)
    want = rows.select("id", F.posexplode(T.extract_numbers(F.col("text"))).alias("pos", "token")).select("id", F.col("pos").cast("long").alias("pos"), "token", T.to_number(F.col("token")).alias("value"))
    assert got.count() == want.count() > 200_000
    assert got.exceptAll(want).isEmpty()
    got = spark.sql("SELECT id, pos, sentence FROM {rows}, LATERAL statistical_sentences(text)", rows=rows)
    want = K.statistical_sentences(rows, "text", "id")
    assert sorted(got.collect()) == sorted(want.collect())
    assert got.count() > 50
    short = spark.sql("SELECT sentence FROM LATERAL statistical_sentences('It grew by 5. No.', least => 3)").collect()
    assert [r.sentence for r in short] == ["It grew by 5."]
    assert spark.sql("SELECT * FROM LATERAL numbers_in(null)").isEmpty()
    for wrong in ("numbers_in(5)", "statistical_sentences('a', 'b')"):
        with pytest.raises(AnalysisException):
            spark.sql(f"SELECT * FROM LATERAL {wrong}").collect()


def test_calls_side_by_side_keep_the_budget(spark, tmp_path):
    folder = str(tmp_path)

    def call(prompts):
        began = time.time()
        with open(f"{folder}/{began}-{random.random()}", "w"):
            time.sleep(0.05)
        with open(f"{folder}/{time.time()}-{began}-done", "w"):
            pass
        if prompts[0].endswith("3"):
            raise ValueError("no")
        return [p.upper() for p in prompts]

    rows = spark.createDataFrame([(i, f"q{i}") for i in range(40)] + [(40, None)], "id int, prompt string")
    out = V.asked_at_once(rows, "prompt", call, tasks=2, flight=4, calls=20, seconds=1.0, tries=2).collect()
    assert {r.id: r.answer for r in out} == {i: "" if i % 10 == 3 or i == 40 else f"Q{i}" for i in range(41)}
    assert {r.id for r in out if r.error} == {3, 13, 23, 33}
    made = sorted(float(p.name.split("-")[0]) for p in tmp_path.iterdir() if not p.name.endswith("done"))
    assert len(made) == 45  # the failing ones twice
    assert all(b - a > 0.9 for a, b in zip(made, made[20:], strict=False))  # files are stamped a little after their call is let go
    spans = [tuple(map(float, p.name.split("-")[:2])) for p in tmp_path.iterdir() if p.name.endswith("done")]
    most = max(sum(b <= t < e for e, b in spans) for _, t in spans)
    assert 2 < most <= 8


def test_a_hub_does_not_meet_every_query(spark):
    rng = random.Random(4)
    facts = [(i, "hub" if i % 3 else f"s{i % 7}", f"d{rng.randrange(1500)}") for i in range(3000)]
    triples = spark.createDataFrame(facts, "id long, subject string, document string")
    hits = [(q, i, r + 1) for q in range(30) for r, i in enumerate(rng.sample(range(3000), 6))]
    k, by = 4, {i: (s, d) for i, s, d in facts}
    want = []
    for q in range(30):
        mine = {i: r for qq, i, r in hits if qq == q}
        more = sorted(i for i, s, _ in facts if s in {by[i][0] for i in mine} and i not in mine)[: 3 * k]
        best: dict = {}
        for place in [(1, r, by[i][1]) for i, r in mine.items()] + [(2, p + 1, by[i][1]) for p, i in enumerate(more)]:
            best[place[2]] = min(best.get(place[2], place), place)
        want += [(q, x[2], x[0], n + 1) for n, x in enumerate(sorted(best.values())[:k])]
    frame = spark.createDataFrame(hits, "qid long, id long, rank int")
    assert sorted(map(tuple, R.two_hop(frame, triples, k).collect())) == sorted(want)
    kept = R.adjacency(triples, 3 * k + 6)
    assert kept.groupBy("subject").count().agg(F.max("count")).first()[0] == 3 * k + 6
    assert sorted(map(tuple, R.two_hop(frame, triples, k, kept).collect())) == sorted(want)
    assert R.two_hop(frame.limit(0), triples, k).isEmpty()


def test_pareto_front_by_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, *[rng.choice([rng.randrange(6), rng.randrange(60)]) for _ in range(3)], "x" * (i % 3)) for i in range(1500)]
    rows += [(2000 + i, *rows[i][1:4], "again") for i in range(0, 1500, 40)]
    frame = spark.createDataFrame([*rows, (9000, None, 1, 1, "null")], "id int, a int, b int, c int, note string").repartition(6)
    beats = lambda q, p: q[1] <= p[1] and q[2] <= p[2] and q[3] >= p[3] and q[1:4] != p[1:4]
    want = sorted(p for p in rows if not any(beats(q, p) for q in rows))
    assert sorted(map(tuple, Y.pareto_front(frame, ["a", "b"], ["c"]).collect())) == want
    assert Y.pareto_front(frame.limit(0), ["a"], []).isEmpty()
    odd = spark.createDataFrame([(1.0, 2.0), (float("nan"), 0.0), (float("-inf"), 5.0)], "a double, `b c` double")
    assert sorted(map(tuple, Y.pareto_front(odd, ["a", "b c"], []).collect())) == [(float("-inf"), 5.0), (1.0, 2.0)]
    line = np.column_stack([np.arange(3000.0), -np.arange(3000.0)])
    assert len(Y.front(line)) == 3000
    assert Y.front(np.repeat(line[:1], 5, axis=0)).tolist() == [0, 1, 2, 3, 4]
    far = np.array([[0.0, np.inf], [-np.inf, np.inf], [1e17, 1.0], [1e17, 2.0]])
    assert Y.front(far).tolist() == [1, 2]


@pytest.mark.parametrize("places", [0, 1, 2, 4])
def test_rounding_is_that_of_exact_binary_values(spark, places):
    rng = random.Random(6)
    values = [rng.uniform(-1, 1) * 10.0 ** rng.randint(-8, 18) for _ in range(100_000)]
    values += [rng.randrange(-(10**9), 10**9) / 32 for _ in range(50_000)]
    values += [(2 * rng.randrange(10 ** rng.randint(1, 11)) + 1) / (2 * 10**places) for _ in range(100_000)]
    values += [0.0, 2.5, -2.5, 0.03125, 0.00005, 1e300, float("inf"), 2.0**39 - 2**-13, 2.0**52 + 0.5]
    rows = spark.createDataFrame([(float(v),) for v in values], "x double")
    for r in rows.select("x", T.half_even(F.col("x"), places).alias("y")).toLocalIterator():
        assert r.y == (round(r.x, places) if np.isfinite(r.x) else r.x), r.x


def test_lateral_rows_are_spread_over_tasks(spark):
    one = spark.range(100).coalesce(1).selectExpr("id", "'The unit weighs about 12 kg in all, as its makers say, or more.' as text")
    table_functions.register(spark)
    many = spark.sql("SELECT id, spark_partition_id() AS part FROM {rows}, LATERAL statistical_sentences(text)", rows=round_trips.spread(one)).collect()
    assert len(many) == 100 and len({r.part for r in many}) == int(spark.conf.get("spark.sql.shuffle.partitions"))
