"""Crawl, connectors, sinks, answering methods and experiments, on hand-made rows and against brute force."""

from __future__ import annotations

import json
import math
import os
import random
import re
import time
import urllib.parse

import numpy as np
import pytest
from pyspark.sql import functions as F

from statweave import session
from statweave.functions import text as T
from statweave.operators import crawl as C
from statweave.operators import evaluation as E
from statweave.operators import graph as G
from statweave.operators import retrieval as R
from statweave.operators import statistics as S
from statweave.operators import triples as K
from statweave.plans import answering as A
from statweave.plans import benchmark as B
from statweave.plans import experiments as N
from statweave.sources import files, remote, sparql, wiki
from statweave.sources import services as V
from statweave.streaming import resume


def values(spark, rows, column):
    return [r.x for r in spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, v string").select("i", column(F.col("v")).alias("x")).orderBy("i").collect()]


SPACES = ["\t", "\n", "\x0b", "\x1c", "\x85", "\u00a0", "\u2003", "\u2028", "\u3000", " "]


def test_white_space_of_all_scripts(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choices([*SPACES, "a", ".", "É", "e\u0301"], k=rng.randint(0, 12))) for _ in range(300)]
    assert values(spark, texts, T.strip) == [t.strip() for t in texts]
    import unicodedata

    plain = lambda t: " ".join(unicodedata.normalize("NFC", t).split()).rstrip(".")
    assert values(spark, texts, T.normalize_string) == [plain(t) for t in texts]
    assert values(spark, [" " * 100_000 + "x" + " " * 100_000 + "y", None], T.strip)[0].startswith("x")


def test_statistical_sentences_in_odd_white_space(spark):
    long = "This sentence is long enough and says that about 5 percent"
    texts = [f"\n^ {long}.", f"\u00a0{long}!\u2003Short 5%.\u00a0^ {long}", f"\t ISBN {long}", f"{long}\u00a07 kg.\n\n{long}?"]
    got = values(spark, texts, lambda c: F.filter(T.sentences(c), T.is_statistical))
    assert got == [[], [f"{long}!"], [], [f"{long}\u00a07 kg.", f"{long}?"]]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('[{"subject": "a", "relation": "r", "object": "1"}]', [("a", "r", "1")]), ('{"subject": "a", "relation": "r", "object": "1"}', []), ('{"a": 1}', []), ("no", []), ("", []), (None, []),
        ('```json\n[{"subject": "a", "relation": "r", "object": 1.50}]\n``` and ```more```', [("a", "r", "1.5")]), ('x ```[{"subject": "a", "relation": "r", "object": null}]', [("a", "r", None)]),
        ('[{"subject": "a"}, 5, "x", null, [1], {"object": {"n": 2}, "subject": "b", "relation": "r", "z": 0}]', [("b", "r", '{"n":2}')]), ('[{"subject": "a", "relation": "r", "object": "1"}, ', []), ("[]", []),
    ],
)
def test_generated_json(spark, text, want):
    rows = spark.createDataFrame([(7, text)], "k int, answer string")
    assert [(r.subject, r.relation, r.object) for r in K.parse_generated(rows, "answer", "k").collect()] == want


def test_binomial_by_brute_force():
    for b, c in [(0, 0), (0, 5), (3, 4), (10, 40), (17, 17), (300, 360)]:
        n = b + c
        tail = sum(math.comb(n, i) for i in range(min(b, c) + 1)) / 2**n
        assert S.binomial_p(b, c) == pytest.approx(min(1.0, 2 * tail), rel=1e-9)
    assert S.binomial_p(500_000_000, 500_100_000) == pytest.approx(math.erfc(100_000 / math.sqrt(1_000_100_000) / math.sqrt(2)), rel=1e-3)


def test_bonferroni_of_two_tests(spark):
    tests = spark.createDataFrame([("a", 0.001, 0.04), ("b", 0.03, 0.02), ("c", None, 0.9)], "name string, p double, q double")
    got = {r["name"]: r for r in S.bonferroni(tests, "p", "q").collect()}
    assert got["a"]["alpha"] == pytest.approx(0.016667) and got["a"]["significant_p"] and not got["a"]["significant_q"]
    assert (got["a"]["stars_p"], got["b"]["stars_p"], got["c"]["stars_q"]) == ("**", "*", "")


def test_bootstrap_by_brute_force(spark):
    rng = np.random.default_rng(5)
    x, y = (rng.random(400) < 0.62).astype(int), (rng.random(400) < 0.5).astype(int)
    pairs = spark.createDataFrame([("m", int(a), int(b)) for a, b in zip(x, y, strict=True)], "model string, x int, y int")
    got = S.paired_bootstrap(pairs, ["model"]).first()
    picks = rng.integers(0, 400, (10_000, 400))
    deltas = np.sort((x - y)[picks].mean(axis=1))
    assert got.delta == pytest.approx((x - y).mean())
    assert got.low == pytest.approx(deltas[250], abs=0.01) and got.high == pytest.approx(deltas[9750], abs=0.01)
    assert got.p == pytest.approx(min(1, 2 * min((deltas <= 0).mean(), (deltas >= 0).mean())), abs=0.01)


def test_annotators(spark):
    one = spark.createDataFrame([(1, 2, 3), (2, 0, 1), (3, 1, 1), (9, 2, 2)], "sample_id int, q int, c int")
    two = spark.createDataFrame([(1, 2, 2), (2, 2, 1), (3, 2, 2), (8, 0, 0)], "sample_id int, q int, c int")
    both = S.both_annotators(one, two, "q", "c")
    assert tuple(S.annotation_buckets(both, "q_a", "q_b").first()) == (3, 2, 1, 0, 1, 1)
    assert tuple(S.validity(both, "q", "c").first()) == (3, 66.7)
    assert [tuple(r) for r in S.disagreements(both, "q").collect()] == [(2, 0, 2)]


def brute_crawl(roots, pages, subs, skip, max_depth, most):
    found, seen, queue, at = {}, set(), [(r, 0) for r in roots], 0
    bad = lambda c: any(s in c.lower() for s in skip)
    while at < len(queue) and len(found) < most:
        name, depth = queue[at]
        at += 1
        if name in seen or bad(name):
            seen.add(name)
            continue
        seen.add(name)
        for title in pages.get(name, []):
            found.setdefault(title, (depth, name))
        if depth < max_depth:
            queue += [(s, depth + 1) for s in subs.get(name, []) if s not in seen and not bad(s)]
    return found


@pytest.mark.parametrize("seed", range(4))
def test_crawl_by_brute_force(spark, seed):
    rng = random.Random(seed)
    names = [f"cat{i}" + rng.choice(["", "", "Stub"]) for i in range(25)]
    subs = {c: rng.sample(names, rng.randint(0, 4)) for c in names}
    pages = {c: [f"t{rng.randint(0, 60)}" for _ in range(rng.randint(0, 6))] for c in names}
    roots = [c for c in names if "Stub" not in c][:2]
    table = lambda d: spark.createDataFrame([(k, x, i) for k, v in d.items() for i, x in enumerate(v)], "key string, item string, position long")
    for depth, most in ((0, 1000), (2, 1000), (3, 20)):
        want = brute_crawl(roots, pages, subs, ("stub",), depth, most)
        got = C.crawl(spark.createDataFrame(list(enumerate(roots)), "position long, category string").select("category", "position"), C.listing(table(pages)), C.listing(table(subs)), ("stub",), depth, most).collect()
        assert {r.title: (r.depth, r.category) for r in got} == want and len(got) == len(want)
        assert [r.title for r in sorted(got, key=lambda r: (r.depth, r.place))] == sorted(want, key=list(want).index)


def test_accepted_keeps_the_order_of_the_crawl(spark):
    rows = [("a", 0, [0, 5], [1.0, 0.0]), ("b", 0, [0, 2], [1.0, 0.0]), ("c", 1, [0, 0, 0], [1.0, 0.0]), ("d", 0, [0, 1], [0.0, 1.0]), ("e", 0, [0, 9], [0.0, 0.0])]
    candidates = spark.createDataFrame([(t, d, "k", p, v) for t, d, p, v in rows], "title string, depth long, category string, place array<long>, vector array<double>")
    scored = C.scored(candidates, spark.createDataFrame([([1.0, 0.1],)], "vector array<double>"))
    assert {r.title: r.score for r in scored.collect()}["e"] == 0
    assert [(r["rank"], r.title) for r in C.accepted(scored, 0.5, 2).orderBy("rank").collect()] == [(1, "b"), (2, "a")]
    assert [r.category for r in C.most_common(candidates, "category", ["place"]).collect()] == ["k"]


WIKI = {
    ("cmtitle=Category:Energy", "cmtype=page", ""): {"query": {"categorymembers": [{"title": "Coal"}]}, "continue": {"cmcontinue": "2"}}, ("cmtitle=Category:Energy", "cmtype=page", "2"): {"query": {"categorymembers": [{"title": "Oil"}]}},
    ("cmtitle=Category:Energy", "cmtype=subcat", ""): {"query": {"categorymembers": [{"title": "Category:Solar"}]}}, ("titles=Coal", "prop=links", ""): {"query": {"pages": {"1": {"links": [{"title": "Oil"}, {"title": "Gas"}]}}}},
    ("titles=Coal", "prop=extracts", ""): {"query": {"pages": {"1": {"extract": "Coal is black."}}}}, ("titles=None", "prop=extracts", ""): {"query": {"pages": {"-1": {"missing": ""}}}},
    ("titles=coal|Gas", "redirects=1", ""): {"query": {"redirects": [{"from": "coal", "to": "Coal"}], "normalized": [{"from": "coal", "to": "COAL"}]}},
}


def offline_wiki(url):
    given = dict(urllib.parse.parse_qsl(urllib.parse.urlparse(url).query))
    if "Broken" in url:
        return 500, b""
    for (first, second, token), answer in WIKI.items():
        if all(given.get(k) == v for k, v in (first.split("="), second.split("="))) and (given.get("cmcontinue", "") == token):
            return 200, json.dumps(answer).encode()
    return 200, b"{}"


def test_wiki(spark):
    api = wiki.Api("http://wiki/api", offline_wiki, sleep=lambda s: None)
    keys = spark.createDataFrame([("Energy",), ("Energy",), ("Broken",), (None,)], "k string")
    got = {(r.key, r.item, r.position, r.error) for r in remote.paged(keys, "k", wiki.CategoryMembers(api), tries=1).collect()}
    assert got == {("Energy", "Coal", 0, None), ("Energy", "Oil", 1, None), ("Broken", None, None, "Refused: status 500")}
    assert wiki.CategoryMembers(api, "subcat")("Energy", None) == (["Solar"], None)
    assert wiki.ArticleProperty(api, "links")("Coal", None) == (["Oil", "Gas"], None)
    assert wiki.Resolved(api)(["coal", "Gas"]) == [("coal", "Coal")] and wiki.Resolved(api, "normalized")(["coal", "Gas"]) == [("coal", "COAL")]
    assert [(r.key, r.item) for r in wiki.articles(spark.createDataFrame([("Coal",), ("None",)], "k string"), "k", api).collect()] == [("Coal", "Coal is black.")]
    waits, answers = [], [(429, b""), (429, b""), (200, b"{}")]
    assert wiki.Api("http://x", lambda url: answers.pop(0), sleep=waits.append).query() == {} and waits == [2.0, 4.0]
    with pytest.raises(wiki.Refused):
        wiki.Api("http://x", lambda url: (429, b""), sleep=waits.append).query()


def test_throttle_counts_units_and_callers():
    now, slept = [0.0], []
    throttle = remote.Throttle(30, 60.0, lambda: now[0], lambda s: (slept.append(s), now.__setitem__(0, now[0] + s)))
    for _ in range(11):  # three calls a question: ten in a window
        throttle.wait(3)
    assert slept == [60.0] and throttle.used == 3


def test_throttled_service():
    import pickle

    now, slept = [0.0], []
    service = V.Throttled(V.echo_generator(), 30, 60.0, 3, clock=lambda: now[0], sleep=lambda s: (slept.append(s), now.__setitem__(0, now[0] + s)))
    assert service(["[1] a"] * 8) == ["a"] * 8 and service(["x"] * 3) == ["Not known"] * 3 and slept == [60.0]
    assert V.tuned(service, 0.5).calls == 30
    chat = V.Throttled(V.ChatService(print, "m"))
    assert V.tuned(chat, 0.5).call.temperature == 0.5 and pickle.loads(pickle.dumps(chat)).throttle is None


def test_last_try_does_not_wait(monkeypatch):
    slept = []
    monkeypatch.setattr(V.time, "sleep", slept.append)
    assert V.retried(lambda _: 1 / 0, [1], 3, 1.0)[1].startswith("ZeroDivisionError") and slept == [1.0, 2.0]


def endpoint(query):
    if "Bad" in query:
        raise OSError("gone")
    cell = lambda **kv: {k: {"value": v} for k, v in kv.items()}
    return [cell(entity="q1", name="Sweden", property="http://w/P2046", amount="+450", unit_name="km2", article="https://en.wikipedia.org/wiki/SWEDEN"), cell(entity="q2", name="Norway north", property="http://w/P9", amount="7", unit_name="1"), cell(entity="q3", name="Else", property="http://w/P9", amount="8")]


def test_sparql(spark):
    topics = spark.createDataFrame([(i, t) for i, t in enumerate(["Norway", "Sweden", "North \"x\"", "Bad", "Worse"])], "i int, t string")
    batches = sparql.batched(topics, "t", "i", 3)
    assert {(r.topic, r.batch) for r in batches.collect()} == {("Norway", 0), ("Sweden", 0), ("North \"x\"", 0), ("Bad", 1), ("Worse", 1)}
    rows = sparql.bindings(batches, endpoint, ["P2046"], tries=1).cache()
    assert [r.error for r in rows.where("error is not null").collect()] == ["OSError: gone"]
    got = {tuple(r)[:4] for r in sparql.facts(rows, batches, {"P2046": "HasArea"}).collect()}
    assert got == {("Sweden", "HasArea", "450 km2", "Sweden"), ("Norway north", "P9", "7", "Norway"), ("Else", "P9", "8", "Else")}
    query = sparql.question(["http://a/x"], ["P1", "P2"])
    assert "<http://a/x>" in query and query.endswith("LIMIT 5000")
    check_request(query, ["P1", "P2"])
    assert [r.u for r in topics.select(T.sitelink_url(F.col("t")).alias("u")).collect()][2].endswith("/North_x")


def check_request(query, properties):
    """The request in the grammar that endpoints accept: triples of terms, no variable inside a property path, every
    selected variable bound, and every property's statement and quantity paths side by side."""
    head, body = re.fullmatch(r"SELECT ((?:\?\w+ ?)+) WHERE \{\n(.*)\n\}\nLIMIT \d+", query, re.S).groups()
    rows = re.search(r"VALUES \(\?property \?leads \?holds\) \{ (.*?) \}", body)[1]
    assert rows == " ".join(f"(wd:{p} p:{p} psv:{p})" for p in properties)
    body = re.sub(r"VALUES (\([^)]*\)|\?\w+) \{[^}]*\}", "", body)
    body = re.sub(r"FILTER\(LANG\(\?\w+\) = '\w+'\)", "", body).replace("OPTIONAL {", "").replace("}", "")
    term = r"(\?\w+|<[^>]*>|[a-z]\w*:\w+)"
    triples = [t.strip() for t in re.split(r"\s\.(?:\s|$)", body) if t.strip()]
    for triple in triples:
        first, *more = triple.split(" ; ")
        assert re.fullmatch(f"{term} {term} {term}", first) and all(re.fullmatch(f"{term} {term}", m) for m in more), triple
    assert set(head.split()) <= set(re.findall(r"\?\w+", body)) | {"?property", "?article"}


def test_requests_are_counted(spark, tmp_path):
    """Every try and every text is a request; the stub counts them in a file, the throttle by the number of waits."""
    log = str(tmp_path / "requests")

    def fetch(url):
        with open(log, "a") as f:
            f.write(".")
        return 200, json.dumps({"query": {"pages": {"1": {"extract": "text"}}}}).encode()

    api = wiki.Api("http://wiki/api", fetch, sleep=lambda s: None)
    began = time.monotonic()
    assert wiki.articles(spark.range(25).selectExpr("cast(id as string) as k"), "k", api, calls=10, seconds=1.0).count() == 25
    assert os.path.getsize(log) == 25 and time.monotonic() - began >= 1.9


def test_chat_service():
    asked = []

    def post(request):
        asked.append(request)
        return {"choices": [{"message": {"content": "yes"}}]}

    service = V.ChatService(post, "small", "Be brief.", max_tokens=100)
    assert service(["a", "b"]) == ["yes", "yes"] and asked[0]["max_tokens"] == 512 and asked[0]["messages"][0]["content"] == "Be brief."
    assert V.tuned(service, 0.7).temperature == 0.7 and service.temperature == 0.1 and V.tuned(V.echo_generator(), 0.7) is not None
    V.ChatService(post, "GLM-5")(["a"])
    V.ChatService(post, "qwen-3.6-27b")(["a"])
    assert asked[-2]["max_tokens"] == 1024 and asked[-1]["chat_template_kwargs"] == {"enable_thinking": False}
    for message, want in (({"content": None, "reasoning": "so"}, "so"), ({"content": None}, ""), ({"content": None, "reasoning_content": "r", "reasoning": "s"}, "r")):
        assert V.ChatService(lambda _, m=message: {"choices": [{"message": m}]}, "m")(["a"]) == [want]


def test_embedding_failures(spark):
    def broken(texts):
        raise OSError

    rows = spark.createDataFrame([("a",)], "t string")
    assert V.embed(rows, "t", broken).first().vector is None
    assert V.embed(rows, "t", broken, pad=3).first().vector == [0.0] * 3


def test_a_cluster_needs_a_shared_folder():
    class Session:
        class conf:
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:
            master = "yarn"

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_path(Session, "x")


def test_replacing_is_all_or_nothing(spark, tmp_path):
    path = f"{tmp_path}/log"
    files.write_jsonl(spark.createDataFrame([(1,)], "a int"), path)
    before = spark.read.json(path)
    files.write_jsonl(before.union(spark.createDataFrame([(2,)], "a long")), path)  # reads what it replaces
    assert sorted(r.a for r in spark.read.json(path).collect()) == [1, 2]
    with pytest.raises(Exception, match="boom"):
        files.replaced(spark, path, lambda p: (_ for _ in ()).throw(ValueError("boom")))
    assert sorted(r.a for r in spark.read.json(path).collect()) == [1, 2] and [f for f in os.listdir(tmp_path) if "new" in f or "old" in f] == []


def test_purge_of_a_log(spark, tmp_path):
    path = tmp_path / "kg_m.jsonl"
    path.mkdir()
    (path / "part.json").write_text('{"query": "a", "answer": "1"}\n{"query": "b", "answer": "", "error": "timeout"}\n\nnot json\n{"query": "c", "answer": "2"}\n')
    assert files.purge_errors(spark, str(path)) == 2
    assert sorted(r.query for r in spark.read.json(str(path)).collect()) == ["a", "c"] and files.purge_errors(spark, str(path)) == 0
    assert files.purge_errors(spark, f"{tmp_path}/none") == 0


def test_files_of_a_domain(spark, tmp_path):
    schema = {"schema_version": "2", "relations": [{"name": "HasArea", "description": "extent", "example": "5 km2"}, {"name": "HasMax", "description": "most", "example": "9"}]}
    (tmp_path / "schema.json").write_text(json.dumps(schema))
    got = files.vocabulary(spark, str(tmp_path / "schema.json"))
    assert files.vocabulary_prompt(got) == "- HasArea: extent (e.g., 5 km2)\n- HasMax: most (e.g., 9)"
    default = files.Domain(("Energy",), ("Coal",), ("stub", "politics"))
    assert files.domain(spark, f"{tmp_path}/none.json", default) == default
    (tmp_path / "domain.json").write_text(json.dumps({"root_categories": ["Health"], "unskip": ["politics"], "extra_skip": ["films"]}))
    assert files.domain(spark, f"{tmp_path}/domain.json", default) == files.Domain(("Health",), ("Coal",), ("stub", "films"))
    (tmp_path / "topics.txt").write_text("\u00a0Coal \n\n\tOil\u2003\nCoal\n")
    assert sorted(r.topic for r in files.topics(spark, f"{tmp_path}/missing.txt", f"{tmp_path}/topics.txt").collect()) == ["Coal", "Coal", "Oil"]
    assert files.topics(spark, f"{tmp_path}/topics.txt", distinct=True).count() == 2


def test_positions_and_index(spark, tmp_path):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("tid"), F.lit("s").alias("subject"), F.lit("r").alias("relation"), F.repeat(F.lit("x"), 600).alias("object"), F.lit(None).cast("string").alias("source_topic"))
    assert sorted((r.tid, r.position) for r in files.positions(rows.select("tid"), "tid").collect()) == [(i, i) for i in range(1000)]
    index = files.index_rows(rows, K.verbalise("fine"))
    first = index.where("id = 't_3'").first()
    assert (first.source_topic, first.source, len(first.object)) == ("", "llm", 500)
    path = f"{tmp_path}/index"
    assert files.write_index(index.withColumn("vector", F.array(F.lit(1.0))), path) == 1000
    assert files.write_index(index.limit(5).withColumn("vector", F.array(F.lit(1.0))), path) == 5
    held = files.index_where(spark, path, F.col("source") == "llm", 3)
    assert held.count() == 3 and "vector" not in held.columns


def test_embedding_cache(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def embedder(texts):
        calls.add(len(texts))
        if "bad" in texts:
            raise OSError
        return [[float(len(t))] for t in texts]

    embed = lambda df: V.embed(df, "text", embedder, batch=1)
    rows = spark.createDataFrame([("a",), ("bb",), ("a",), (None,), ("bad",)], "name string")
    got = files.cached_vectors(rows, "name", f"{tmp_path}/cache", embed).collect()
    assert sorted((r["name"] or "", r.vector) for r in got) == [("", None), ("a", [1.0]), ("a", [1.0]), ("bad", None), ("bb", [2.0])]
    before = calls.value
    more = files.cached_vectors(spark.createDataFrame([("a",), ("ccc",)], "name string"), "name", f"{tmp_path}/cache", embed)
    assert sorted(r.vector for r in more.collect()) == [[1.0], [3.0]] and calls.value == before + 1


def test_graph_tables_and_report_lines(spark, tmp_path):
    one = spark.createDataFrame([("a", 0.5, 3), ("long name", None, 10)], "name string, nem double, n int")
    assert files.write_graph(one, one.limit(1), one, f"{tmp_path}/g") == {"chunks": 2, "entities": 1, "relationships": 2}
    assert files.report_lines(one.orderBy("n"), {"name": 5, "nem": 7, "n": 4}) == ["name      nem    n", "-" * 18, "a      0.5000    3", "long        -   10"]


def test_reports_of_communities(spark):
    members = spark.createDataFrame([("c1", f"m{i}") for i in range(6)] + [("c2", "x"), ("c2", "y")], "community string, node string")
    facts = spark.createDataFrame([(i, "s", "r", str(i), f"m{i % 2}") for i in range(10)], "tid long, subject string, relation string, object string, source_topic string")
    entities = spark.createDataFrame([("x", "about x"), ("y", "about y")], "entity string, description string")
    asked = []

    def fail(prompts):
        raise OSError

    got = {r.community: r for r in G.community_reports(members, facts, V.echo_generator(), entities).collect()}
    assert (got["c1"].title, got["c1"]["rank"], got["c1"].summary) == ("Community c1: m0, m1, m2", 6, "Not known")
    got = {r.community: r.summary for r in G.community_reports(members, facts, fail, entities).collect()}
    assert got == {"c1": "Community covering: m0, m1, m2, m3, m4", "c2": "Community covering: x, y"}
    told = {}
    for r in G.community_facts(members, facts, entities=entities).orderBy("rank").collect():
        told.setdefault(r.community, []).append(r.fact)
    assert told == {"c1": [f"- s r {i}" for i in (0, 2, 4, 1, 3, 5)], "c2": ["- x: about x", "- y: about y"]}
    assert not asked


def index(spark):
    rows = [(i, [math.cos(i / 10), math.sin(i / 10)], f"t{i % 3}", f"s{i // 2}", f"fact {i} is {i * 10}") for i in range(12)]
    return spark.createDataFrame(rows, "id long, vector array<double>, source_topic string, subject string, document string")


def questions(spark):
    return spark.createDataFrame([(100, "first?", [1.0, 0.0]), (101, "second?", [math.cos(0.5), math.sin(0.5)])], "qid long, question string, vector array<double>")


def test_filters_reach_every_method(spark, tmp_path):
    q, i = questions(spark), index(spark)
    where = {"source_topic": {"$nin": ["t0", "t2"]}}
    answer = lambda df: {r.qid: r.answer for r in df.collect()}
    echo = V.echo_generator()
    assert answer(A.kg_retrieval(q, i, None, echo)) == {100: "fact 0 is 0", 101: "fact 5 is 50"}
    assert answer(A.kg_retrieval(q, {"fine": i, "coarse": i.withColumn("document", F.lit("c"))}, None, echo, where=where)) == {100: "fact 1 is 10", 101: "fact 4 is 40"}
    assert answer(A.kg_retrieval(q, {"fine": i, "coarse": i.withColumn("document", F.lit("c"))}, None, echo, granularity="coarse")) == {100: "c", 101: "c"}
    assert answer(A.kg_retrieval(q, i, None, echo, rerank=V.shortest_reranker(), where=where)) == {100: "fact 1 is 10", 101: "fact 4 is 40"}
    graph = A.graph_retrieval(q, i, None, echo, 20, where=where).collect()
    assert all(set(r.retrieved) <= {f"fact {n} is {n * 10}" for n in (1, 4, 7, 10)} for r in graph) and {r.qid: r.answer for r in graph}[100] == "fact 1 is 10"
    chunks = i.withColumnRenamed("source_topic", "topic")
    assert answer(A.standard_rag(q, chunks, None, echo, where={"$and": [where, {"source_topic": "t1"}]})) == {100: "fact 1 is 10", 101: "fact 4 is 40"}
    assert answer(A.verified(q, i, None, echo, V.supporting_verifier(), echo, where=where)) == {100: "fact 1 is 10", 101: "fact 4 is 40"}
    bare = A.verified(q, None, None, echo, V.supporting_verifier("SUPPORTED"), echo).collect()
    assert {r.answer for r in bare} == {"Not known"} and all(r.context is None for r in bare)
    both = A.compared_indexes(q, {"own": (i, where), "other": (i, None)}, None, echo).collect()
    assert {(r.method, r.qid): r.answer for r in both} == {("kg_retrieval_own", 100): "fact 1 is 10", ("kg_retrieval_own", 101): "fact 4 is 40", ("kg_retrieval_other", 100): "fact 0 is 0", ("kg_retrieval_other", 101): "fact 5 is 50"}
    assert answer(A.run("kg_retrieval", q, i, None, echo)) == {100: "fact 0 is 0", 101: "fact 5 is 50"}


def test_chunk_index_is_made_once(spark, tmp_path):
    corpus = spark.createDataFrame([("Coal", "short\n\n" + "a long paragraph on coal " * 4 + "\n\n" + "another paragraph, on mines " * 4)], "topic string, full_text string")
    path = f"{tmp_path}/chunks"
    got = A.chunk_index(corpus, V.hashed_embedder(8), path).collect()
    assert sorted((r.id, r.topic, r.chunk_idx) for r in got) == [(0, "Coal", "1"), (1, "Coal", "2")]
    assert A.chunk_index(corpus.limit(0), V.hashed_embedder(8), path).count() == 2


def test_later_rows_first_among_equals(spark):
    same = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(6)], "id long, vector array<double>")
    q = spark.createDataFrame([(0, [1.0, 0.0])], "qid long, vector array<double>")
    ids = lambda df: [r.id for r in df.orderBy("rank").collect()]
    assert ids(R.cosine_topk(q, same, 3)) == [0, 1, 2] and ids(R.cosine_topk(q, same, 3, later_first=True)) == [5, 4, 3]


def test_a_grid_resumes(spark, tmp_path):
    q = questions(spark)
    cells = N.grid(method=("kg_retrieval", "zero_shot"), top_k=(1, 3))
    services = N.Services({"fine": index(spark)}, V.echo_generator())
    asked, path = [], f"{tmp_path}/log"

    def answer(need, some):
        asked.append((need.count(), len(some)))
        out = N.answer_cells(need, some, services)
        if len(asked) == 1:  # one fails the first time
            out = out.withColumn("error", F.when(F.col("label").contains("top_k=3") & (F.col("qid") == 101), "timeout"))
        return out

    first = N.run(q, cells, path, answer)
    assert first.count() == 8 and first.where("error is not null").count() == 2
    again = N.run(q, cells, path, answer)
    assert asked == [(8, 4), (2, 2)] and again.count() == 8 and again.where("error is not null").count() == 0
    assert N.run(q, cells, path, answer).count() == 8 and len(asked) == 2
    gold = spark.createDataFrame([(1, "first?", ["0"]), (2, "second?", ["50"])], "id int, question string, gold_numbers array<string>")
    got = {(r.method, r.top_k): (r.n, r.nem) for r in N.summary(N.scores(again, gold), "method", "top_k").collect()}
    assert got == {("kg_retrieval", 1): (2, 1.0), ("kg_retrieval", 3): (2, 1.0), ("zero_shot", 1): (2, 0.0), ("zero_shot", 3): (2, 0.0)}


def test_thresholds_are_sorted_with_none_last(spark):
    rows = spark.createDataFrame([("kg", "m", t, 1.0, 0) for t in (None, 0.5, 0.0, 0.2)], "method string, model string, threshold double, substring_nem double, facts int")
    assert [r.threshold for r in N.by_threshold(rows).collect()][:2] == [0.2, 0.5]


def test_a_checkpoint_is_taken_up_and_deleted(spark, tmp_path):
    path, seen = f"{tmp_path}/cp", []

    def step(rows):
        seen.append(sorted(r.k for r in rows.collect()))
        return rows.select("k", F.when((F.col("k") == 2) & F.lit(len(seen) == 1), "timeout").alias("error"))

    work = spark.range(4).withColumnRenamed("id", "k")
    assert sorted(r.k for r in resume.checkpointed(work, "k", path, step).collect()) == [0, 1, 3]
    assert sorted(r.k for r in resume.checkpointed(work, "k", path, step).collect()) == [0, 1, 2, 3]
    assert sorted(r.k for r in resume.checkpointed(work.where("k > 0"), "k", path, step).collect()) == [1, 2, 3] and seen == [[0, 1, 2, 3], [2]]
    resume.finish(spark, path)
    assert not os.path.exists(path)
    resume.finish(spark, path)


def test_benchmark_is_resumed(spark, tmp_path):
    rows = [(i, f"s{i}", "ab"[i % 2], "no figure" if i > 30 else f"{i} km", "t") for i in range(40)]
    triples = spark.createDataFrame(rows, "tid long, subject string, relation string, object string, source_topic string")
    asked = spark.sparkContext.accumulator(0)
    plain, path = B.template_questions(), f"{tmp_path}/cp"

    def sometimes(prompts):
        asked.add(len(prompts))
        if any("Subject: s1" in p for p in prompts):
            raise OSError
        return plain(prompts)

    def all_(prompts):
        asked.add(len(prompts))
        return plain(prompts)

    some = B.build(triples, 20, 3, sometimes, path).collect()
    assert 0 < len(some) < 20 and os.path.exists(path)
    before = asked.value
    whole = sorted(B.build(triples, 20, 3, all_, path).collect(), key=lambda r: r.id)
    assert [r.id for r in whole] == list(range(20)) and asked.value - before == 20 - len(some) and not os.path.exists(path)
    assert all(r.gold_numbers == [r.object.split()[0]] and r.question == f"What is the {r.relation} of {r.subject}?" for r in whole)
    assert sorted(r.relation for r in whole) == ["a"] * 10 + ["b"] * 10 and {r.id: r.question for r in some}.items() <= {r.id: r.question for r in whole}.items()


def test_work_list_and_numbers(spark):
    corpus = spark.createDataFrame([("a", 2), ("b", 0), ("c", 1)], "topic string, sentence_count int")
    assert [r.topic for r in K.work_list(corpus, spark.createDataFrame([("c",)], "topic string")).collect()] == ["a"]
    facts = spark.createDataFrame([("5 km",), ("none",), (None,)], "object string")
    assert [r.object for r in K.with_numbers(facts).collect()] == ["5 km"]


def test_attribution_summary_by_brute_force(spark):
    rows = [("m", "kg", f"q{i}", a, r, ["7"], None) for i, (a, r) in enumerate([("it is 7", ["x 7", "y 8"]), ("8", ["x 7", "y 8"]), ("none", ["x 7"]), ("7", []), ("9", ["a 1", "b 2", "c 3", "d 9 7"])])]
    scored = spark.createDataFrame([*rows, ("m", "kg", "q9", "7", ["x 7"], ["7"], "timeout")], "model string, method string, question string, answer string, retrieved array<string>, gold_numbers array<string>, error string")
    assert tuple(E.attribution_summary(scored, "method").first()) == ("kg", 5, 4, 75.0, 100.0, 1.33, 33.3, 66.7)


def test_modularity_of_two_cliques_is_the_best_there_is(spark):
    import itertools

    nodes = [f"a{i}" for i in range(4)] + [f"b{i}" for i in range(4)]
    pairs = list(itertools.combinations(nodes[:4], 2)) + list(itertools.combinations(nodes[4:], 2)) + [("a0", "b0")]
    edges = spark.createDataFrame(pairs, "src string, dst string")
    got = {r.node: r.community for r in G.modularity_communities(edges).collect()}
    degree = {n: sum(n in p for p in pairs) for n in nodes}

    def value(of):
        return sum((of[x] == of[y]) * (2 if x != y else 1) * (((x, y) in pairs or (y, x) in pairs) - degree[x] * degree[y] / 2 / len(pairs)) for x, y in itertools.combinations_with_replacement(nodes, 2)) / 2 / len(pairs)

    best = max(value(dict(zip(nodes, labels, strict=True))) for labels in itertools.product(range(3), repeat=8))
    assert value(got) == pytest.approx(best)
