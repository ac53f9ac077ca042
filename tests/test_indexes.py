"""Exact and indexed nearest neighbours, and huge JSON files, against brute force."""

from __future__ import annotations

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from statweave.operators import nearest as N
from statweave.operators import retrieval as R
from statweave.plans import round_trips
from statweave.sources import files
from statweave.sources import json_entries as J


def frame(spark, rows, key):
    return spark.createDataFrame([(i, v) for i, v in rows], f"{key} long, vector array<double>")


def plain(queries, index, k, later=False):
    unit = lambda v: np.array(v) / (np.linalg.norm(v) or 1)
    out = set()
    for q, v in queries:
        ranked = sorted((round(1 - float(unit(v) @ unit(x)), 9), -i if later else i) for i, x in index)[:k]
        out |= {(q, abs(i), n + 1) for n, (_, i) in enumerate(ranked)}
    return out


@pytest.mark.parametrize("later", [False, True])
@pytest.mark.parametrize("tile", [3, 1448])
def test_exact_search_in_tiles(spark, monkeypatch, tile, later):
    monkeypatch.setattr(R, "TILE", tile)
    rng = np.random.default_rng(1)
    index = [(i, rng.integers(-1, 2, 3).astype(float).tolist()) for i in range(60)]  # many ties, and zero vectors
    queries = [(i, rng.integers(-1, 2, 3).astype(float).tolist()) for i in range(7)]
    odd = [(100, None), (101, [None, 1.0, 0.0])]
    found = R.cosine_topk(frame(spark, queries + odd, "qid"), frame(spark, index + odd, "id"), 4, later_first=later).collect()
    got = {}
    for r in found:
        got.setdefault(r.qid, []).append((r["rank"], round(r.distance, 9), r.id))
    assert set(got) == {q for q, _ in queries}
    assert {(q, i, n) for q, rows in got.items() for n, _, i in rows} == plain(queries, index, 4, later)


def test_memory_of_exact_search(monkeypatch):
    """A full block of queries against large batches stays within a few hundred megabytes."""
    import resource

    import pyarrow as pa

    rng = np.random.default_rng(0)
    queries = R._unit(rng.normal(size=(20_000, 64)))

    class Held:
        value = (np.arange(20_000), queries)

    flat = pa.array(rng.normal(size=20_000 * 64))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(20_000)), pa.ListArray.from_arrays(pa.array(np.arange(0, 20_001 * 64, 64), pa.int32()), flat)], ["id", "vector"])
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    [out] = list(R._nearest(Held, 5, False)(iter([batch])))
    assert out.num_rows == 100_000 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 400_000


def test_index_finds_the_nearest(spark, tmp_path):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16))
    index = [(i, (centres[i % 12] + rng.normal(size=16) / 3).tolist()) for i in range(3000)]
    index += [(5000 + i, centres[0].tolist()) for i in range(2500)]  # a hot list, over more than one block
    index += [(9000, None), (9001, [None] * 16), (9002, [0.0] * 16)]
    queries = [(i, index[i][1]) for i in range(0, 3000, 100)] + [(7, None)]
    df, asked, path = frame(spark, index, "id"), frame(spark, queries, "qid"), str(tmp_path / "index")
    model = N.build(df, path)
    assert {tuple(r) for r in spark.read.parquet(f"{path}/postings").select(F.explode("ids").alias("id")).groupBy().agg(F.count("id"), F.count_distinct("id")).collect()} == {(5501, 5501)}
    assert (N.load(spark, path).centroids == model.centroids).all()
    exact = {(r.qid, r.id) for r in R.cosine_topk(asked, df, 5).collect()}
    found = N.search(asked, path, 5).collect()
    assert len({(r.qid, r.id) for r in found} & exact) >= 0.9 * len(exact)
    whole = N.search(asked, path, 5, probes=len(model.centroids), shortlist=2000).collect()
    assert {(r.qid, r.id) for r in whole} == exact
    assert all(a.distance <= b.distance for a in whole for b in whole if a.qid == b.qid and a["rank"] < b["rank"])
    with pytest.raises(ValueError, match="vector"):
        N.build(frame(spark, [(1, None)], "id"), path)
    assert N.search(asked, path, 5).count() == len(found)  # the old index stays


def test_tasks_hand_on_only_the_nearest(spark, tmp_path, monkeypatch):
    """However many lists and blocks a task reads, by codes or by vectors, and in blocks of queries too."""
    rng = np.random.default_rng(3)
    index = [(i, rng.normal(size=8).tolist()) for i in range(600)] + [(1000 + i, [1.0] + [0.0] * 7) for i in range(300)]
    queries = [(i, index[i][1]) for i in range(0, 900, 45)]
    df, asked, path = frame(spark, index, "id"), frame(spark, queries, "qid"), str(tmp_path / "index")
    model = N.build(df, path)

    class Held:
        value = (np.arange(20), R._unit(np.array([v for _, v in queries])), np.ones((20, len(model.centroids)), bool))

    for cells, by in (("codes", model), ("vectors", None)):
        batches = spark.read.parquet(f"{path}/postings").select("list", "ids", F.col(cells).alias("cells")).toArrow().to_batches(4)
        assert sum(b.num_rows for b in N._meet(Held, by, 7)(iter(batches))) == 20 * 7
    for most in (8192, 6):
        monkeypatch.setattr(N, "QUERIES", most)
        got = {(r.qid, r.id, r["rank"]) for r in N.search(asked, path, 5, shortlist=None).collect()}
        assert got == plain(queries, index, 5)
    assert N.search(asked.limit(0), path, 5).count() == 0


def test_index_is_the_same_for_any_split(spark):
    rows = frame(spark, [(i, np.random.default_rng(i).normal(size=8).tolist()) for i in range(300)], "id")
    a, b = N.train(rows.repartition(1)), N.train(rows.repartition(7))
    assert (a.centroids == b.centroids).all() and all((x == y).all() for x, y in zip(a.books, b.books, strict=True))


WORDS = ["a", 'say "x"', "{", "}, ", "[1,2]", "\\", 'end\\"', ",", "]", "\n", "é", " ", '}, "k": {"v": 1}', "", " "]


def odd_value(rng, depth=0):
    kind = rng.randrange(6 if depth < 3 else 3)
    if kind < 2:
        return "".join(rng.choices(WORDS, k=rng.randrange(6)))
    if kind == 2:
        return rng.choice([None, True, 1.5, -3])
    if kind == 3:
        return [odd_value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {rng.choice(WORDS) + str(i): odd_value(rng, depth + 1) for i in range(rng.randrange(4))}


@pytest.mark.parametrize("block", [150, 1000])
@pytest.mark.parametrize("indent", [None, 2])
def test_entries_of_any_json(spark, tmp_path, monkeypatch, block, indent):
    rng, key = random.Random(block), "spark.sql.files.maxPartitionBytes"
    objects = [{rng.choice(WORDS) + f"{i}": odd_value(rng) for i in range(rng.choice([0, 1, 9]))} for _ in range(2)] + [{"long": "x, y" * 60, "b": [{}]}]
    arrays = [[odd_value(rng) for _ in range(rng.choice([0, 1, 9]))] for _ in range(3)]
    kept = spark.conf.get(key)
    try:
        for name, wholes in (("o", objects), ("a", arrays)):
            folder = tmp_path / name
            folder.mkdir()
            for i, whole in enumerate(wholes):
                (folder / f"{i}.json").write_text(rng.choice(["", " \n"]) + json.dumps(whole, indent=indent, ensure_ascii=bool(i % 2)) + rng.choice(["", "\n"]), encoding="utf-8")
            (folder / "none.json").write_text("")
            spark.conf.set(key, str(block))
            got = {}
            for r in J.entries(spark, str(folder)).collect():
                got.setdefault(r.file.rsplit("/", 1)[1], []).append(r.text)
            for i, whole in enumerate(wholes):
                texts = got.get(f"{i}.json", [])
                if name == "o":
                    assert {k: v for t in texts for k, v in json.loads("{" + t + "}").items()} == whole and len(texts) == len(whole)
                else:
                    assert sorted((json.dumps(json.loads(t)) for t in texts)) == sorted(map(json.dumps, whole))
    finally:
        spark.conf.set(key, kept)


def test_objects_come_back(spark, tmp_path):
    rows = [("a", 1, "x, y"), ('q"uote', 2, None), ("new\nline", 3, "}"), ("é", None, "\\"), (None, 5, "lost")]
    df, path = spark.createDataFrame(rows, "k string, n int, t string"), str(tmp_path / "out")
    J.write_object(df.repartition(3), F.col("k"), F.struct("n", "t"), path)
    back = J.object_of(spark, path, "struct<n: int, t: string>").select("key", "value.n", "value.t").collect()
    assert {tuple(r) for r in back} == set(rows[:4])
    J.write_array(df.repartition(3), F.struct("n", "t"), f"{path}-array")
    assert {tuple(r) for r in J.array_of(spark, f"{path}-array", "struct<n: int, t: string>").select("value.n", "value.t").collect()} == {r[1:] for r in rows}
    J.write_object(df.limit(0), F.col("k"), F.struct("n"), f"{path}-empty")
    assert J.object_of(spark, f"{path}-empty", "struct<n: int>").count() == 0


def test_one_large_file_is_read_by_many_tasks(spark, tmp_path):
    path, n = tmp_path / "big.json", 20_000
    with open(path, "w") as f:
        f.write("{" + ", ".join(f'"topic {i}": {{"sentences": ["one, {i}", "two"], "full_text": "{"text " * 40}"}}' for i in range(n)) + "}")
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256k")
    try:
        assert spark.read.text(str(path), lineSep=",").rdd.getNumPartitions() > 15
        assert J.object_of(spark, str(path), "struct<sentences: array<string>>").agg(F.count_distinct("key"), F.sum(F.size("value.sentences"))).first()[:] == (n, 2 * n)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)


def test_large_objects_are_read_in_larger_blocks(spark, tmp_path):
    assert [round_trips.block_bytes(n) for n in (0, 1, 1 << 22, 1 << 30)] == [16 << 10, 16 << 10, 16 << 10, 4 << 20]
    spark.range(100).selectExpr("repeat('x', 99) as value").write.text(str(tmp_path / "a"))
    assert files.size(spark, str(tmp_path / "a")) == 10_000


def test_equal_ids_have_a_stated_place(spark):
    """Rows of one tid are numbered by what else the order states, whatever order they come in."""
    rows = spark.range(200).selectExpr("id div 2 as tid", "cast(1 - id % 2 as int) as side", "concat('s', id) as subject", "'R' as relation", "'1' as object", "'t' as source_topic")
    got = {(r.id, r.subject) for r in files.index_rows(rows.repartition(7, "subject"), F.lit("d"), "tid", "side").collect()}
    assert got == {(f"t_{2 * tid + side}", f"s{2 * tid + 1 - side}") for tid in range(100) for side in (0, 1)}
