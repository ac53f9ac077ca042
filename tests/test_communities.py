"""Communities: connected, and as good as the best there are on small graphs."""

from __future__ import annotations

import itertools
import random

import pytest

from statweave.operators import graph as G


def edge_frame(spark, edges):
    return spark.createDataFrame([(f"n{a:02d}", f"n{b:02d}") for a, b in edges], "src string, dst string")


def plain_modularity(edges, label):
    m = len(edges)
    degree = {}
    for a, b in edges:
        degree[a], degree[b] = degree.get(a, 0) + 1, degree.get(b, 0) + 1
    inside = sum(label[a] == label[b] for a, b in edges) / m
    return inside - sum(sum(d for n, d in degree.items() if label[n] == c) ** 2 for c in set(label.values())) / (4 * m * m)


def partitions(n):
    def grow(prefix, most):
        if len(prefix) == n:
            yield prefix
        else:
            for c in range(most + 2):
                yield from grow([*prefix, c], max(most, c))

    yield from grow([0], 0)


def reached(edges, start, allowed):
    seen, todo = {start}, [start]
    while todo:
        x = todo.pop()
        for a, b in edges:
            for p, q in ((a, b), (b, a)):
                if p == x and q in allowed and q not in seen:
                    seen.add(q)
                    todo.append(q)
    return seen


@pytest.mark.parametrize("seed", [1])
def test_communities_by_brute_force(spark, seed):
    rng = random.Random(seed)
    pairs = list(itertools.combinations(range(8), 2))
    edges = [p for p in pairs if rng.random() < (0.75 if (p[0] < 4) == (p[1] < 4) else 0.15)]
    label = {int(r.node[1:]): r.community for r in G.modularity_communities(edge_frame(spark, edges)).collect()}
    nodes = sorted({x for e in edges for x in e})
    best = max(plain_modularity(edges, dict(zip(nodes, p, strict=True))) for p in partitions(len(nodes)))
    assert sorted(label) == nodes and plain_modularity(edges, label) >= 0.95 * best
    for c in set(label.values()):
        own = {n for n, k in label.items() if k == c}
        assert reached(edges, min(own), own) == own


def test_connected_parts(spark):
    edges = [(i, i + 1) for i in range(40) if i not in (10, 30)] + [(50, 60)]
    both = edge_frame(spark, edges + [(b, a) for a, b in edges])
    nodes = edge_frame(spark, [(i, i) for i in [*range(41), 50, 60, 70]]).selectExpr("src as node")
    got = {r.node: r.part for r in G.connected_parts(both, nodes).collect()}
    assert got == {f"n{i:02d}": f"n{0 if i < 11 else 11 if i < 31 else 31:02d}" for i in range(41)} | {"n50": "n50", "n60": "n50", "n70": "n70"}


def test_no_community_falls_apart(spark):
    """A hub holds two groups together until it moves away."""
    left, right = list(itertools.combinations(range(5), 2)), list(itertools.combinations(range(10, 15), 2))
    edges = left + right + [(20, i) for i in (0, 1, 10, 11)] + [(20, 30 + i) for i in range(6)] + list(itertools.combinations(range(30, 36), 2))
    label = {int(r.node[1:]): r.community for r in G.modularity_communities(edge_frame(spark, edges)).collect()}
    for c in set(label.values()):
        own = {n for n, k in label.items() if k == c}
        assert reached(edges, min(own), own) == own
    assert len({label[i] for i in range(5)}) == len({label[i] for i in range(10, 15)}) == 1 and label[0] != label[10]
    assert G.modularity_communities(spark.createDataFrame([], "src string, dst string")).count() == 0


def test_leaves_follow_their_neighbour(spark):
    """Nodes with one neighbour are merged into it before the search, pairs among themselves; weights stay whole."""
    edges = [(0, 1), (1, 2), (0, 2), *[(i, 10 + 5 * i + j) for i in range(3) for j in range(5)], (40, 41)]
    both = G.weighted(edge_frame(spark, edges))
    follows = G._followed(both, 1.0)
    got = {int(r.node[1:]): int(r.community[1:]) for r in follows.collect()}
    assert got == {n: n if n < 3 else 40 if n >= 40 else (n - 10) // 5 for e in edges for n in e}
    merged = {(r.src, r.dst): r.w for r in G._merged(both, follows).collect()}
    assert merged == {(a, b): 10.0 if a == b else 1.0 for a in ("n00", "n01", "n02") for b in ("n00", "n01", "n02")} | {("n40", "n40"): 2.0}
    assert all(r.node == r.community for r in G._followed(both, 1.5).collect())
    label = {int(r.node[1:]): r.community for r in G.modularity_communities(edge_frame(spark, edges)).collect()}
    assert sorted(label) == sorted({n for e in edges for n in e}) and all(label[n] == label[got[n]] for n in label)
    assert all(c == f"n{min(n for n in label if label[n] == c):02d}" for c in label.values())


def test_units_are_ranked_in_parts_that_stay_apart(spark):
    """Units are ranked by many small tasks before entities are looked up, which are never broadcast."""
    units = spark.range(40).selectExpr("id as unit", "concat('u', id) as text", "array(id % 3, id % 5 + 10, cast(null as bigint)) as entity_ids")
    entities = spark.createDataFrame([(0,), (0,), (2,), (14,), (99,), (None,)], "entity long")
    found = G.membership_facts(entities, units)
    assert {(r.entity, r.unit, r.text, r["rank"]) for r in found.collect()} == {(e, u, f"u{u}", i + 1) for e, us in ((0, (0, 3, 6)), (2, (2, 5, 8)), (14, (4, 9, 14))) for i, u in enumerate(us)}
    assert found.count() == 9 and found.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
