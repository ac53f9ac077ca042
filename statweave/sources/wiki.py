"""A wiki's query API as the callables that remote.paged and remote.looked_up take, and article texts.

A fetch takes a URL and returns the status and the body. Everything here is picklable and holds no connection, so
that executors call it and tests put tables in its place.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from statweave.sources import remote

Fetch = Callable[[str], tuple[int, bytes]]


def web(url: str, agent: str = "statweave", timeout: float = 15.0) -> tuple[int, bytes]:
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": agent}), timeout=timeout) as answer:
            return answer.status, answer.read()
    except urllib.error.HTTPError as e:
        return e.code, b""


class Refused(RuntimeError):
    """The service answered with something else than what was asked for."""


class Busy(Refused):
    """The service asked to be called later."""


@dataclass(frozen=True)
class Api:
    """Queries of a wiki. query, when told to slow down, waits twice as long each time, then gives up; once leaves that to
    its caller, so that a job's lookups repeat their requests within the job's budget."""

    url: str
    fetch: Fetch = web
    tries: int = 4
    wait: float = 2.0
    sleep: Callable[[float], None] = time.sleep

    def once(self, **given: str) -> dict:
        status, body = self.fetch(f"{self.url}?{urllib.parse.urlencode({'action': 'query', 'format': 'json'} | given)}")
        if status == 429:
            raise Busy("status 429")
        if status != 200:
            raise Refused(f"status {status}")
        return json.loads(body)

    def query(self, **given: str) -> dict:
        for attempt in range(self.tries):
            try:
                return self.once(**given)
            except Busy:
                self.sleep(self.wait * 2**attempt)
        raise Busy("status 429")

    def _page(self, answer: dict, marker: str) -> str | None:
        return answer.get("continue", {}).get(marker)


@dataclass(frozen=True)
class CategoryMembers:
    """Page call: the articles (page) or the subcategories (subcat, without their prefix) of a category."""

    api: Api
    kind: str = "page"

    def __call__(self, category: str, token: str | None) -> tuple[list[str], str | None]:
        more = {"cmcontinue": token} if token else {}
        answer = self.api.once(list="categorymembers", cmtitle=f"Category:{category}", cmtype=self.kind, cmlimit="500", **more)
        titles = [m["title"] for m in answer.get("query", {}).get("categorymembers", [])]
        return [t.replace("Category:", "") if self.kind == "subcat" else t for t in titles], self.api._page(answer, "cmcontinue")


#: For each property of an article its parameters, the marker of its continuation, and its field.
PROPERTIES = {
    "links": ({"pllimit": "500", "plnamespace": "0"}, "plcontinue"),
    "categories": ({"cllimit": "500", "clshow": "!hidden"}, "clcontinue"),
    "redirects": ({"rdlimit": "500", "rdnamespace": "0"}, "rdcontinue"),
}


@dataclass(frozen=True)
class ArticleProperty:
    """Page call: the titles in one property (links, categories, redirects) of an article."""

    api: Api
    name: str

    def __call__(self, title: str, token: str | None) -> tuple[list[str], str | None]:
        given, marker = PROPERTIES[self.name]
        answer = self.api.once(titles=title, prop=self.name, **given, **({marker: token} if token else {}))
        pages = answer.get("query", {}).get("pages", {})
        return [x["title"] for page in pages.values() for x in page.get(self.name, [])], self.api._page(answer, marker)


@dataclass(frozen=True)
class Resolved:
    """Lookup call: what titles are redirected to, or with kind normalized are written like."""

    api: Api
    kind: str = "redirects"

    def __call__(self, titles: list[str]) -> list[tuple[str, str]]:
        answer = self.api.once(titles="|".join(titles), redirects="1")
        return [(x["from"], x["to"]) for x in answer.get("query", {}).get(self.kind, [])]


@dataclass(frozen=True)
class ArticleText:
    """Lookup call: the plain text of each article that there is."""

    api: Api

    def __call__(self, titles: list[str]) -> list[tuple[str, str]]:
        out = []
        for title in titles:
            answer = self.api.once(titles=title, prop="extracts", explaintext="1")
            out += [(title, page["extract"]) for page in answer.get("query", {}).get("pages", {}).values() if "missing" not in page and page.get("extract")]
        return out


def articles(topics: DataFrame, column: str, api: Api, **settings: object) -> DataFrame:
    """key, item (the text), position, error for every topic that has an article. Texts come one a request, so each title
    is a batch of its own: it counts in the budget, and fails, by itself."""
    return remote.looked_up(topics, column, ArticleText(api), **{"batch": 1} | settings)
