"""Budgets of calls: what a service is asked again for counts, and nothing goes out in a burst."""

from __future__ import annotations

import json
import os
import time
import urllib.parse

import pytest

from statweave.sources import remote, wiki
from statweave.sources import services as V


class BusyAtFirst:
    """A wiki that answers every title with 429 the first time; each request is a line of the log."""

    def __init__(self, path: str) -> None:
        self.path = path

    def __call__(self, url: str) -> tuple[int, bytes]:
        title = dict(urllib.parse.parse_qsl(urllib.parse.urlparse(url).query))["titles"]
        before = os.path.exists(self.path) and any(line.split("\t")[1] == title for line in open(self.path).read().splitlines())
        with open(self.path, "a") as log:
            log.write(f"{time.monotonic()}\t{title}\n")
        return (200, json.dumps({"query": {"pages": {"1": {"extract": f"about {title}"}}}}).encode()) if before else (429, b"")


def test_requests_made_again_count_in_the_budget(spark, tmp_path):
    path = str(tmp_path / "log")
    titles = spark.createDataFrame([(f"t{i}",) for i in range(12)], "k string")
    got = wiki.articles(titles, "k", wiki.Api("http://wiki/api", BusyAtFirst(path)), calls=10, seconds=1.0, wait=0.0).collect()
    assert sorted((r.key, r.item, r.error) for r in got) == sorted((f"t{i}", f"about t{i}", None) for i in range(12))
    times = [float(line.split("\t")[0]) for line in open(path).read().splitlines()]
    assert len(times) == 24 and times[-1] - times[0] >= 1.5  # three windows: ten, ten, four
    # after ten requests there is a pause
    assert all(times[i + 1] - times[i] > 0.3 for i in (9, 19))


def test_a_wiki_that_stays_busy_is_an_error_of_its_titles(spark):
    api = wiki.Api("http://wiki/api", lambda url: (429, b"") if "bad" in url else (200, json.dumps({"query": {"pages": {"1": {"extract": "x"}}}}).encode()))
    got = {r.key: (r.item, r.error) for r in wiki.articles(spark.createDataFrame([("bad",), ("good",), (None,)], "k string"), "k", api, calls=100, tries=2, wait=0.0).collect()}
    assert got == {"bad": (None, "Busy: status 429"), "good": ("x", None)}
    with pytest.raises(wiki.Busy):
        api.once(titles="bad")


def test_throttled_items_go_out_one_by_one():
    now, seen = [0.0], []
    service = V.Throttled(lambda items: (seen.extend((now[0], x) for x in items), [x.upper() for x in items])[1], 2, 60.0, clock=lambda: now[0], sleep=lambda s: now.__setitem__(0, now[0] + s))
    assert service(list("abcde")) == list("ABCDE") and service([]) == []
    assert seen == [(0.0, "a"), (0.0, "b"), (60.0, "c"), (60.0, "d"), (120.0, "e")]


def test_listings_without_keys(spark):
    none = spark.createDataFrame([], "k string")
    assert remote.paged(none, "k", wiki.CategoryMembers(wiki.Api("http://wiki/api", lambda url: (500, b"")))).count() == 0


def test_rows_of_many_answers_go_on_together():
    got = [b.num_rows for b in remote._tables(iter([[("k", str(i), i, None)] for i in range(2500)] + [[]]))]
    assert got == [1000, 1000, 500] and not list(remote._tables(iter([[], []])))
