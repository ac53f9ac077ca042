"""Whitening, URL filters and periodic runs against brute force, with the awkward cases."""

from __future__ import annotations

import hashlib
import random
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pandas as pd
import pytest

from statweave.llm import periodic_runs, url_filter, whitening
from tests.llm.data import frame

SCHEMA = "vec_id long, embedding array<float>, x string, n int, component string, __row int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1, "c", 2) for i, v in rows], SCHEMA)


def plain_whitening(rows, dims):
    """rows: usable vectors. Whole numbers, distinct ones, covariance, eigenpairs, by the definition."""
    x = [tuple(int(np.floor(64 * np.float64(np.float32(c)))) + 1_000_000 for c in [*v, *[0] * (dims - len(v))]) for v in rows]
    fit = sorted(set(x))
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    cov = [[Fraction(sum((n * r[i] - sums[i]) * (n * r[j] - sums[j]) for r in fit), n**3) for j in range(dims)] for i in range(dims)]
    values, axes = np.linalg.eigh(np.array(cov, float))
    return x, n, sums, cov, values[::-1], axes[:, ::-1]


def test_whitening_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    good = [(i, (rng.normal(size=6) * [5, 4, 3, 2, 1, 0.5]).tolist()) for i in range(200)]
    good += [(300, good[7][1])] * 30 + [(None, good[8][1]), (301, good[9][1][:4]), (302, [])]
    bad = [(400, None), (401, [1.0, None, 0.0]), (402, [float("nan")] * 6), (403, [float("inf"), 0.0, 0.0, 0.0, 0.0, 0.0])]
    found = whitening.whiten(vectors(spark, good + bad)).toPandas()
    x, n, sums, cov, values, axes = plain_whitening([v for _, v in good], 6)
    assert len(found) == 6 * len(good) and set(found.vec_id.dropna()) == {i for i, _ in good if i is not None}
    assert set(found.n) == {n} and found.identity_error.nunique() == 1 and found.identity_error.max() < 1e-9
    trace = float(sum(cov[i][i] for i in range(6)))
    for k, part in found.groupby("component"):
        want = sorted(((tuple(r), sum((n * a - s) ** 2 for a, s in zip(r, sums, strict=True)), float(np.dot([float(a - Fraction(s, n)) for a, s in zip(r, sums, strict=True)], axes[:, k - 1]) / values[k - 1] ** 0.5)) for r in x), key=lambda w: (w[1], abs(w[2])))
        got = sorted(zip(part.deviation, part.whitened, strict=True), key=lambda w: (w[0], abs(w[1])))
        assert [w[1] for w in want] == [g[0] for g in got]
        sign = np.sign(got[-1][1] * want[-1][2])
        assert np.allclose([w[2] for w in want], [sign * g[1] for g in got], atol=1e-9)
        assert np.allclose(part.explained, values[k - 1] / trace, rtol=1e-12)


def test_whitening_of_odd_tables(spark):
    empty = whitening.whiten(vectors(spark, [(1, None)]))
    assert empty.columns[:7] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and empty.count() == 0
    same = whitening.whiten(vectors(spark, [(1, [1.0, 2.0])] * 3)).toPandas()
    assert len(same) == 6 and (same.whitened == 0).all() and (same.explained == 0).all() and (same.deviation == 0).all() and (same.identity_error == 0).all()
    flat = whitening.whiten(vectors(spark, [(i, [float(i), 2.0 * i, 1.0]) for i in range(9)])).toPandas()
    assert (flat[flat.component > 1].whitened == 0).all() and flat.identity_error.max() < 1e-9 and abs(flat[flat.component == 1].explained.iloc[0] - 1) < 1e-12
    huge = whitening.whiten(vectors(spark, [(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [1e10, 5.0])])).toPandas()
    assert huge[huge.vec_id == 1].deviation.isna().all() and huge[huge.vec_id == 1].deviation_exact.str.fullmatch(r"\d{20,}").all()
    with pytest.raises(ValueError, match="dimensions"):
        whitening.whiten(vectors(spark, [(1, [0.5] * 2000)]))


@pytest.mark.parametrize("size", [1, 100, 1 << 20, 1 << 40, 1 << 54])
def test_products_of_limbs_are_exact(size):
    z = np.random.default_rng(size % 97).integers(-size, size + 1, (50, 4))
    assert (whitening.exact_gram(z) == z.astype(object).T @ z.astype(object)).all()
    assert all(sum(int(p[k]) << (whitening.PLANE * i) for i, p in enumerate(whitening.planes(z[:, 0].astype(object) ** 2))) == int(z[k, 0]) ** 2 for k in range(50))


URLS = [
    "http://Shop.Example.NET/en/1?x", "https://a.example.net/de/2#t", "https://example.net/en/", "https://notexample.net/en/3", "ftp://x.net", "http://x.net?q=/en/", "http://x.net:80/a", "http://b.example.com/de/4.html",
    "http://b.example.com/de", "http://example.com/DE/5", "http://www.y.org/fr/6", "http://y.org/fr", "no scheme", "", None, "://", ":///fr/", "http://a://b.net/c", "http://y.org/0123456789abcdef/deep/1/2/3/4/5/6", "http://ÄB.net/ü",
    "http://y.org/one\nline", "http://y.org//x//", "http://y.org/#/x", "http://z.ORG/fr/?", "http://net/x", "http://internet/x",
]


def pages(spark, urls):
    return spark.createDataFrame([(i, u, "h", "other", "t", 3) for i, u in enumerate(urls)] + [(None, urls[0] if urls else "", "h", "o", "t", 3)][: len(urls)], "page_id long, url string, host string, rule string, template string, __key int")


def by_sql(found, url_table):
    con = duckdb.connect()
    con.register("pages", url_table)
    want = con.execute(url_filter.ORACLE).df()
    order = lambda df: sorted(df[["page_id", "host", "path", "rule", "verdict", "template"]].astype(object).where(lambda x: x.notna(), None).itertuples(index=False, name=None), key=str)
    plain = lambda rows: [tuple(None if v is None else int(v) if k == 0 else v for k, v in enumerate(r)) for r in rows]
    assert plain(order(found)) == plain(order(want))


def plain_rule(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, rest = "".join(c.lower() if c.isascii() else c for c in rest[:cut]), rest[cut:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    fits = [(len(d + p), d + p, v) for v, d, p in url_filter.RULES if (host == d or host.endswith("." + d)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_urls_rules_and_sql(spark):
    rng = random.Random(4)
    urls = list(URLS)
    for i in range(400):  # hosts with many rare segments, mixed labels, and a hot one
        host = rng.choice(["hot.example.com", "hot.example.com", "a.example.net", "b.org", "c.example.com"])
        urls.append(f"https://{host}/{rng.choice(['en', 'de', 'fr', f'u{i}-{rng.choice(EASY)}', rng.choice(EASY)])}/{rng.choice([str(i), rng.choice(EASY), 'x/y/z/w/v'])}")
    df = pages(spark, urls)
    found = url_filter.url_verdicts(df).toPandas()
    assert len(found) == len(urls) + 1
    by_sql(found, df.select("page_id", "url").toPandas())
    for r in found.itertuples():
        if r.page_id == r.page_id:
            host, path, rule, verdict = plain_rule(urls[int(r.page_id)])
            assert (r.host, r.path, r.rule if isinstance(r.rule, str) else None) == (host, path, rule) and verdict in (None, r.verdict)
    assert url_filter.url_verdicts(pages(spark, [])).count() == 0
    assert set(url_filter.url_verdicts(df, rules=()).select("verdict").distinct().toPandas().verdict) == {"allow"}


EASY = [a + b for a in ("ka", "lo", "mi", "nu") for b in ("ra", "se", "ti")]


def test_templates_generalise_merge_and_reject(spark):
    # the rule's prefix ends inside segments: most of their siblings under the hot node are blocked by it
    urls = [f"http://s.com/ad{i % 40:02d}{'abcdefgh'[i % 8]}/k" for i in range(400)] + [f"http://s.com/{w}x/k" for w in EASY] + [f"http://s.com/news/{w}" for w in EASY * 30]
    found = url_filter.url_verdicts(pages(spark, urls), rules=(("block", "s.com", "/ad"),)).toPandas().dropna(subset="page_id").set_index("page_id")
    assert (found.verdict.iloc[:400] == "block").all()
    assert (found.verdict.iloc[400:] == "allow").all()  # what most of its pages are labelled keeps blocked segments apart
    names = set(found.template)
    assert any(t.startswith("/#b") or "#n" in t for t in names) and found.template.iloc[412:].nunique() == 1  # alike branches of news are one
    # a host that is nearly all blocked takes its unlabelled pages along
    mostly = [f"http://t.com/ad{i}" for i in range(60)] + ["http://t.com", "http://u.com"]
    found = url_filter.url_verdicts(pages(spark, mostly), rules=(("block", "t.com", "/ad"),)).toPandas().dropna(subset="page_id").set_index("page_id")
    assert found.verdict.iloc[60] == "block" and found.verdict.iloc[61] == "allow"


def plain_runs(w):
    n, out = len(w), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i < n - q:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i < n - q and w[i] == w[i + q]:
                i += 1
            part = w[s : i + q]
            if len(part) >= max(24, 3 * q) and not any(part[d:] == part[:-d] for d in range(1, q)):
                out.append((s, len(part), q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_scan_finds_every_run():
    rng = random.Random(8)
    for _ in range(150):
        kinds, w = rng.choice([1, 2, 3, 6]), []
        while len(w) < rng.choice([20, 24, 90, 300]):
            period = [rng.randrange(kinds) for _ in range(rng.randint(1, 25))]
            w += (period * 40)[: rng.randint(1, len(period) * 8)] + [rng.randrange(kinds) for _ in range(rng.randint(0, 9))]
        ids = (np.array(w, np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        assert periodic_runs.runs_of(ids) == plain_runs(w)
        assert sorted((r for o in periodic_runs.octaves(len(w)) for r in periodic_runs.scan(ids, [o])), key=lambda r: (r[0], r[2])) == plain_runs(w)


def plain_digest(doc_id, text):
    words = [w for w in (text or "").encode().split()]
    n = len(words)
    if doc_id is not None and n and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g = zlib.crc32(str(doc_id).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None, None, None))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2], sha("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in gone)))


def run_documents():
    from tests.llm.data import documents

    rows = [(r[0], r[1]) for r in documents() if not r[1] or len(r[1]) < 20_000]
    rng = random.Random(2)
    for i in range(200, 260):
        words = [rng.choice(EASY) for _ in range(rng.randint(0, 40))]
        rows.append((i, " ".join(words) + rng.choice([" ", "\n", "\t\x0b "]) + " ".join([*(words[:5] or ["a"]) * rng.randint(1, 20), "é\u00a0ü"])))
    return rows + [(261, "same " * 100), (262, "x y " * 12), (263, "x y " * 11 + "x"), (None, "z " * 30), (262, "x y " * 12), (264, "\u2003 a" * 30), (265, "p q " * 20 + "r s t " * 11 + "p q " * 14)]


@pytest.mark.parametrize("long_bytes", [1 << 20, 100])
def test_periodic_runs_equal_brute_force(spark, long_bytes):
    rows = run_documents()
    docs = frame(spark, [(i, t, "en", "s", 1, True, "r", 1, "s", "w", 2) for i, t in rows])
    found = periodic_runs.run_digests(periodic_runs.periodic_runs(docs, arrange=periodic_runs.repeated_tail, long_bytes=long_bytes)).collect()
    assert sorted(map(tuple, found), key=str) == sorted((plain_digest(i, t) for i, t in rows), key=str)
    assert any(r["n_runs"] > 1 for r in found)
    assert periodic_runs.periodic_runs(frame(spark, [])).count() == 0


def test_collapsed_text(spark):
    row = periodic_runs.periodic_runs(frame(spark, [(1, "start " + "one two  three\n" * 9 + "end", "en", "s", 1, True, "r", 1, "s", "w", 2)])).first()
    assert row["collapsed"] == "start one two three end" and [tuple(r) for r in row["runs"]] == [(1, 27, 3)] and row["n_words"] == 29


def test_tables_fit_pandas(spark):
    assert isinstance(periodic_runs.run_digests(periodic_runs.periodic_runs(frame(spark, []))).toPandas(), pd.DataFrame)
