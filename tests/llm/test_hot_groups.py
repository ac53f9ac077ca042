"""Joins and components where one key holds very many rows and others few."""

from __future__ import annotations

from collections import Counter

import pytest

from statweave.llm.common import attach_group
from statweave.llm.components import connected_components


@pytest.mark.parametrize("hot_groups", [1, 3, 1000, 10**6])
def test_attach_group(spark, hot_groups):
    keys = [0] * 600 + [1] * 250 + [k for k in range(2, 120) for _ in range(k % 5 + 1)]
    sizes = Counter(keys)
    rows = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "i int, k int")
    groups = spark.createDataFrame([(k, n, -k) for k, n in sizes.items()], "k int, n long, name int")
    got = attach_group(rows, groups, "k", "n", len(keys), hot_groups).select("i", "k", "n", "name").collect()
    assert sorted(map(tuple, got)) == [(i, k, sizes[k], -k) for i, k in enumerate(keys)]


def test_attach_group_without_rows(spark):
    rows, groups = spark.createDataFrame([], "i int, k int"), spark.createDataFrame([], "k int, n long")
    assert attach_group(rows, groups, "k", "n", 0).collect() == []


def test_components_of_hubs_and_chains(spark):
    hub = [(5000, 5000 + i) for i in range(1, 1500)] + [(7000 + i, 6000) for i in range(40)]
    chains = [(10000 + 10 * c + i, 10000 + 10 * c + i + 1) for c in range(150) for i in range(7)]
    links = hub + chains + [(3, 10003), (10003, 3), (4, 4), (None, 9)]
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = connected_components(spark.createDataFrame(links, "a long, b long")).collect()
    assert len(got) == len({r["node"] for r in got})
    assert {r["node"]: r["root"] for r in got} == {x: find(x) for x in parent}


@pytest.mark.parametrize("links", [[], [(None, 1)], [(4, 4)]])
def test_components_without_links(spark, links):
    frame = spark.createDataFrame(links, "a long, b long")
    assert connected_components(frame).collect() == [] and connected_components(frame.where("false")).collect() == []
