"""Pages, the archive, and the pipeline's stages."""

from __future__ import annotations

import hashlib
import random
import re
import time
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from statweave.llm import common, exact_dedup, html_extract, simhash, warc
from tests.llm.data import documents, frame

PAGE = "page_id long, url string, html string, text string, record string, size int, address string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "t", "r", 1, "a") for r in rows], PAGE)


def test_archive(spark):
    big, small = "<p>" + "é word " * 300, "<p>tiny"
    rows = [(1, "u", big), (2, "u", big), (5, "v", big), (5, "v", big), (3, None, None), (4, "w", ""), (6, "x\ny", small), (7, "x", small), (None, "n", big + "!"), (8, "z", "long" * 200_000)]
    archive = warc.write_archive(pages(spark, rows))
    assert archive.payloads.count() == len({r[2] or "" for r in rows})
    got = [r.asDict() for r in warc.read_archive(archive).collect()]
    want = Counter()
    for i, _, h in rows:
        data = (h or "").encode()
        want[i, len(data), hashlib.sha1(data).hexdigest()] += 1
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"]) for r in got) == want
    kinds = Counter((r["page_id"], r["record_type"], r["refers_to"]) for r in got)
    assert kinds[1, "revisit", 5] == kinds[2, "revisit", 5] == kinds[5, "revisit", 5] == kinds[5, "response", None] == 1
    assert sum(n for (_, kind, _), n in kinds.items() if kind == "revisit") == 3
    for r in got:
        data = next((h or "").encode() for i, _, h in rows if i == r["page_id"])
        head, _, body = r["record"].partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\n") and body.endswith(b"\r\n\r\n") or r["record_type"] == "revisit"
        if r["record_type"] == "response":
            assert body.partition(b"\r\n\r\n")[2] == data + b"\r\n\r\n"
            assert f"Content-Length: {len(body) - 4}".encode() in head
    assert warc.warc_round_trip(pages(spark, [])).count() == 0


@pytest.mark.parametrize("rows", [0, 10**6])
def test_payloads_are_stored_once(spark, monkeypatch, rows):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", rows)
    given = [(i, "u", f"<p>{'long text ' * 200}{i % 7}") for i in range(60)] + [(100 + i, "u", "<p>short") for i in range(30)]
    archive = warc.write_archive(pages(spark, given).repartition(5))
    stored = archive.payloads.collect()
    assert sorted(r.address for r in stored) == sorted({hashlib.sha256(h.encode()).digest() for _, _, h in given})
    got = Counter((r.page_id, r.record_type, r.refers_to) for r in warc.read_archive(archive).collect())
    assert got == Counter({(i, "response" if i >= 53 else "revisit", None if i >= 53 else max(j for j in range(60) if j % 7 == i % 7)): 1 for i in range(60)} | {(100 + i, "response", None): 1 for i in range(30)})


def test_records_make_a_stream(spark):
    given = [(i, f"http://x/{i}", None if i == 2 else f"<p>é\r\n\r\n {i}" + "t" * 600 * (i % 4)) for i in range(12)] + [(20, "", "<p>é\r\n\r\n 7" + "t" * 1800)]
    records = [r.record for r in warc.read_archive(warc.write_archive(pages(spark, given))).orderBy("page_id").collect()]
    found = list(warc.parse_stream(b"".join(records)))
    assert [int(f["warc-record-id"][10:-1]) for f, _ in found] == [i for i, *_ in given]
    for (field, block), (_, url, html) in zip(found, given, strict=True):
        assert field["warc-target-uri"] == url
        if field["warc-type"] == "response":
            assert warc.payload_of(field, block) == (html or "").encode()
        else:
            assert block == b"" and field["warc-refers-to"] == "<urn:page:20>"


def test_what_does_not_check_is_refused():
    import zlib

    with pytest.raises(ValueError, match="address"):
        warc._checked(hashlib.sha256(b"a").digest(), zlib.compress(b"b"))
    head = b"WARC/1.1\r\nWARC-Record-ID: <urn:page:1>\r\nWARC-Payload-Digest: sha1:%s\r\nContent-Length: %d\r\n\r\n"
    block = b"HTTP/1.1 200 OK\r\nContent-Length: 3\r\n\r\nabc"
    good = head % (hashlib.sha1(b"abc").hexdigest().encode(), len(block)) + block + b"\r\n\r\n"
    assert [warc.payload_of(*x) for x in warc.parse_stream(good + good)] == [b"abc"] * 2
    for bad, why in ((good[:-1], "length"), (good.replace(b"WARC/1.1", b"WARC/0.0"), "not a WARC"), (b"WARC/1.1\r\nx", "without an end")):
        with pytest.raises(ValueError, match=why):
            list(warc.parse_stream(good + bad))
    with pytest.raises(ValueError, match="payload"):
        [warc.payload_of(*x) for x in warc.parse_stream(good.replace(b"abc", b"abd"))]


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("", ""), ("plain", "plain"), ("<p>a &lt;b&gt; &#233; &amp", "a <b> é &"), ("<nav>menu</nav>", ""), ("<script>var a='<p>x</p>'</script><p>kept", "kept"),
        ("<p><b>one<br><p>two</p>", "one\ntwo"), ("<p>a <b>b</b>c<table><tr><td>1<td>2<tr><td>3</table>", "a bc\n1\n2\n3"),
        ("<body><div class=ad>Buy now, friends</div><article><h1>T</h1><p>One, two &amp; three.<p>Four<br>five<aside>x</aside><div id=comments><p>hi, there, you</div></article><footer>f</footer>", "T\nOne, two & three.\nFour five"),
        ("<body><div id=side><ul><li><a href=x>l, m</a></ul></div><div class=story><p>Long text, with commas, and more words here.</p><p>Another, here.</p></div><div class='cookie-notice'>We use cookies, ok</div>", "Long text, with commas, and more words here.\nAnother, here."),
        ("<article><p>a<!-- <p>no</p> --><p title='a>b'>c</article>", "a\nc"), ("<p>cut off <a href='", "cut off"),
    ],
)
def test_extract(html, text):
    assert html_extract.extract(html) == text


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ('<article class="post related"><p>One, two.<p>Three</article>', "One, two.\nThree"),
        ('<nav>x</nav><article id="search-engines"><p>One, two.</article><footer>f', "One, two."),
        ('<article><p>One, two.</p></article><article class="promo"><p>Buy</p></article>', "One, two."),
        ("<body><aside>note<div class=story><p>Long, text.</p><p>More, of it.</p></div></body>", "Long, text.\nMore, of it."),
        ("<div><nav><a href=x>m</a></div><div><p>Long, text.</p><p>More, of it.</p></div>", "Long, text.\nMore, of it."),
        ("<div><section><h2>One</h2><p>Long, text, with many, many words, that score, well.</section><section><h2>Two</h2><p>Also, long, text.</section><section><h2>Three</h2><p>Tiny end.</section></div>", "One\nLong, text, with many, many words, that score, well.\nTwo\nAlso, long, text.\nThree\nTiny end."),
        ("<div><p>Hi.</p><div><p>Long, text, with many, many words.</p><p>And, more.</p></div><p>Bye.</p></div>", "Hi.\nLong, text, with many, many words.\nAnd, more.\nBye."),
        ("<div class=row><div class=col><p>First, of, three.</div></div><div class=row><div class=col><p>Second, of, them.</div></div><div class=row><div class=col><p>End</div></div>", "First, of, three.\nSecond, of, them.\nEnd"),
        ("<article><header><h1>Title</h1><p>by me</header><p>Text, here.</article>", "Title\nText, here."),
        ("<article><p>Text, here.</p><section id=comments><article class=comment><p>Long, long, long, comment, here</article></section></article>", "Text, here."),
        ("<div class=page><p>Text, here, it is.</p><ol class=comment-list><li class=comment><p>Long, long, long, long, long, comment, here</li></ol></div>", "Text, here, it is."),
        ("<form><div><p>Text, here, it is.</p><p>More</p></div><input type=hidden></form>", "Text, here, it is.\nMore"),
        ("<table><tr><td><p>Text, here, it is.</div></p><td>More</table>", "Text, here, it is.\nMore"),
        ("<p>One</i></b><b>two<p>three", "Onetwo\nthree"), ("<h2>Head</h3><p>Text, here.", "Head\nText, here."), ("<h2 id=related-work>Related work</h2><p>Text, here.", "Related work\nText, here."),
        ("<p hidden>x</p><p style='display: none'>y</p><p>Text</p>", "Text"), ("<SCRIPT>İ</SCRIPT><p>Text</p>", "Text"),
    ],
)
def test_nothing_of_the_article_is_lost(html, text):
    assert html_extract.extract(html) == text


def test_extraction_of_generated_pages():
    """Pages made from a known article and known surroundings, in many templates: the article comes back whole."""
    rng = random.Random(12)
    say = lambda n: " ".join(rng.choices(["word", "text,", "more", "and", "other", "things,", "here"], k=n)) + "."
    inline = lambda t: rng.choice([t, f"<b>{t}</b>", f"<span>{t[:5]}</span>{t[5:]}", t.replace(" ", "\n ", 2), f"<em>{t}", t.replace("and", "<a href='/q'>and</a>", 1)])

    def part():
        kind, t = rng.choice(["p", "p", "p", "p", "h2", "ul", "blockquote", "pre", "table", "div"]), say(rng.choice([1, 2, 30, 60, 120]))
        if kind == "ul":
            items = [say(rng.randint(2, 9)) for _ in range(rng.randint(1, 4))]
            return "<ul>" + "".join(f"<li>{x}" + rng.choice(["", "</li>"]) for x in items) + "</ul>", items
        if kind == "table":
            return f"<table><tr><td>{t}<td>x</table>", [t, "x"]
        return f"<{kind}>{inline(t) if kind == 'p' else t}" + ("" if kind == "p" and rng.random() < 0.3 else f"</{kind}>"), [t]

    def article():
        parts = [("<h1>Title of it</h1>", ["Title of it"])] + [part() for _ in range(rng.randint(3, 9))] + [(f"<p>{(t := say(150))}</p>", [t])]
        rng.shuffle(parts[1:])
        return parts

    links = lambda n: "".join(f"<li><a href='/{i}'>link {i}</a>" for i in range(n))
    before = [
        "<nav><ul>" + links(8) + "</ul></nav>", "<header><p>Site, name</header>", "<div class='top-nav'><ul>" + links(5) + "</ul></div>", "<div id=cookie-banner><p>We use, cookies, here, and, there.</div>", "<ul>" + links(6) + "</ul>",
        "<div class='ad ad-slot'>Buy, this, now</div>", "<div role=navigation>" + links(3) + "</div>", "<script>var a = '<p>no</p>'</script>", "<form action=/s><input><button>Search</button></form>", "<!-- <p>no -->", "<style>p{}</style>", "<noscript><p>Turn on, scripts</noscript>",
    ]
    after = [
        "<footer><p>Copyright, all, of it</footer>", "<section id=comments><h3>Comments</h3><p>Nice, text, really, I say</section>", "<div class=related-posts><ul>" + links(5) + "</ul></div>", "<aside><h3>About</h3><p>A bio, short</aside>",
        "<div class='newsletter signup'><p>Join, us, today</div>", "<div class=share>" + links(4) + "</div>", "<nav>" + links(2) + "</nav>", "<svg><text>x</text></svg>",
    ]
    inside = ["<aside>Not, this</aside>", "<div class=ad>Buy, it</div>", "<script>x</script>", "<div class='share-buttons'><a href=x>s</a></div>", "<form><input></form>"]
    wraps = [
        ("<article>", "</article>"), ("<main>", "</main>"), ("<article class='post related'>", "</article>"), ("<div class=story>", "</div>"), ("<div>", "</div>"), ("<div id=content><div>", "</div></div>"),
        ("<main><div class=wrap><article id=search>", "</article></div></main>"), ("<section>", "</section>"), ("<div class=page><div class=inner>", "</div></div>"), ("<article>", ""),
    ]
    for _ in range(600):
        parts = article()
        body = "".join(h + (rng.choice(inside) if rng.random() < 0.2 else "") for h, _ in parts)
        start, end = rng.choice(wraps)
        tail = rng.sample(after, rng.randint(0, 4)) if end else []
        html = "<html><head><title>No</title></head><body class=comments-open>" + "".join(rng.sample(before, rng.randint(0, 5))) + start + body + end + "".join(tail) + rng.choice(["", "</body></html>"])
        assert html_extract.extract(html) == "\n".join(x for _, texts in parts for x in texts), html


def test_extraction_of_tag_soup():
    """Whatever the tags, the text has no word that the page lacks, no empty block, and single spaces."""
    rng = random.Random(7)
    tags = [*sorted(html_extract.BLOCK), *sorted(html_extract.NEVER), *sorted(html_extract.INLINE), "br", "img", "script", "style", "title", "head"]
    marks = ["", "", "", " class=ad", " id=comments", " class='post content'", " hidden", " role=navigation", " class=sidebar", " style='display:none'"]
    for _ in range(1500):
        n = [0]

        def piece():
            k, tag = rng.random(), rng.choice(tags)
            if k < 0.4:
                return f"<{tag}{rng.choice(marks)}>"
            if k < 0.65:
                return f"</{tag}>"
            n[0] += 1
            return rng.choice([f"w{n[0]}, here ", f"w{n[0]} ", f" w{n[0]} &amp; ", "<", "</", "<!-- c -->", "<!", " \n"])

        html = "".join(piece() for _ in range(rng.randint(1, 60)))
        blocks = html_extract.extract(html).split("\n")
        words = [w for b in blocks for w in re.findall(r"w[0-9]+", b)]
        assert words == sorted(set(words), key=lambda w: int(w[1:])), html  # in page order, none twice
        assert blocks == [""] or all(b and b == " ".join(b.split()) for b in blocks), html


@pytest.mark.parametrize("html", ["<b>" * 130_000 + "x" + "</i>" * 130_000, "<i><div>" + "<b>" * 100_000 + "</i>" * 100_000, "<div>" * 90_000 + "<li></li>" * 60_000, "<article>" * 60_000 + "<p>x, y</p>" * 30_000, "<table><tr>" * 40_000 + "<td>x" * 80_000, "<a '>" * 200_000, "<div>" * 90_000 + "<h1>x</h1>" * 60_000])
def test_extraction_takes_linear_time(html):
    began = time.process_time()
    html_extract.extract(html)
    assert time.process_time() - began < 8


def test_pages(spark):
    rows = [(1, "u", "<article><p>x y</article>"), (1, "u", "<article><p>x y</article>"), (2, None, None), (None, "v", "<div>" * 5000 + "deep, text")]
    got = Counter(tuple(r) for r in html_extract.extract_main_text(pages(spark, rows)).collect())
    assert got == Counter([(1, "u", "x y", 3)] * 2 + [(2, None, "", 0), (None, "v", "deep, text", 10)])
    assert html_extract.extract_main_text(pages(spark, [])).count() == 0


def test_stages(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = documents(80)
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    junk = [(i, "!! ".join("ABCDEFG" * 12) + str(i), "en", "s", 1, True, "r", 1, "s", "w", 2) for i in range(200, 260)]
    frame(spark, docs + junk).select(*names).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 200)) for i in [*range(80), *range(200, 260)]], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    given = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (name, stage) in enumerate(pipeline.STAGES):
        stage(spark, given, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        if name != "packing":
            assert out.columns == names
            left, before = Counter((r.doc_id, r.text) for r in out.collect()), Counter((r.doc_id, r.text) for r in given.collect())
            assert left <= before
            dropped = {i for i, _ in before - left}
        if name == "language":
            assert {104, 105, 106, 107} <= dropped and not dropped & set(range(80))
        elif name == "quality":
            assert set(range(200, 260)) <= dropped and not dropped & set(range(80))
        elif name == "exact_dedup":
            groups = Counter(r.text_sha256 for r in exact_dedup.exact_dedup(given).collect())
            assert sum(left.values()) == len(groups) < sum(before.values())
        elif name == "near_dedup":
            groups = {r.component_id for r in simhash.simhash_groups(given).collect()}
            assert sum(left.values()) == len(groups)
            assert {i for i, _ in left} == groups
        else:
            assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == {r.doc_id for r in given.collect()}
        given = out
    assert pipeline.run(spark, str(tmp_path)).drop("sequence_id", "offset").subtract(given.drop("sequence_id", "offset")).count() == 0
    empty = given = frame(spark, []).select(*names)
    for _, stage in pipeline.STAGES:
        given = stage(spark, empty, str(tmp_path))
        assert given.count() == 0


def test_stages_leave_other_columns_alone(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(60)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = documents(60)
    rows += [(None, "another text, without an id, and unlike all others that are here", "en", *rows[0][3:]), (5, "a second text of the id five, which nothing else is like, as it is", "en", *rows[0][3:]), rows[7]]
    given = frame(spark, rows).withColumnsRenamed({"fp": "found", "score": "ROW", "words": "_row"}).withColumn("root", F.lit("r")).withColumn("sha", F.lit("s"))
    assert "__row" in given.columns
    whole = Counter(tuple(map(str, r)) for r in given.collect())
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, given, str(tmp_path))
        assert out.columns == given.columns, name
        kept = Counter(tuple(map(str, r)) for r in out.collect())
        assert kept <= whole, name
        if name.endswith("dedup"):
            assert sum(kept.values()) >= 60 and sum(n for r, n in kept.items() if r[1].startswith(("another", "a second"))) == 2, name
            assert kept[tuple(map(str, given.where("doc_id = 7").first()))] == 1
    assert stage(spark, given.limit(0), str(tmp_path)).columns == given.columns


@pytest.mark.parametrize("few", [0, 10**6])
def test_rows_are_dropped_by_broadcast_and_by_shuffle(spark, monkeypatch, few):
    pipeline = pytest.importorskip("corpus_pipeline")
    monkeypatch.setattr(pipeline, "BROADCAST_ROWS", few)
    given = frame(spark).select("doc_id", "text")
    groups = {r.root for r in simhash.simhash_groups(given).collect()}
    assert dict(pipeline.STAGES)["near_dedup"](spark, given, "").count() == len(groups)


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

    class Conf:
        get = staticmethod(lambda key, default=None: default)

    class Session:
        conf, sparkContext = Conf, Context

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.work_dir(Session)


def test_arrow_batches_are_bounded_in_bytes(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    for given, want in (("64m", common.ARROW_BYTES), ("1GB", common.ARROW_BYTES), ("2mb", 2 << 20), ("100k", 100 << 10), ("1000000", 1_000_000)):
        spark.conf.set(key, given)
        common.bound_batches(spark)
        assert spark.conf.get(key) == (str(want) if want == common.ARROW_BYTES else given)
    spark.conf.set(key, "100000")
    rows = spark.range(40).select(F.repeat(F.lit("x"), 30_000).alias("text")).coalesce(1)
    sizes = rows.mapInArrow(lambda it: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"]) for b in it), "n long").collect()
    assert len(sizes) > 5 and max(r.n for r in sizes) < 200_000
    spark.conf.set(key, "64m")


def test_slices_of_text():
    texts = ["a" * 10, None, "", "b" * 50, "c", "d" * 5] * 3
    for column in (pa.array(texts), pa.array(texts, pa.large_string()), pa.array(["x", *texts, "y"]).slice(1, len(texts))):
        runs = list(common.text_slices(column, 16, 4))
        assert [i for i, _ in runs] == [0] + [j for _, j in runs][:-1] and runs[-1][1] == len(texts)
        for i, j in runs:
            assert j - i == 1 or (j - i <= 4 and sum(len(t or "") for t in texts[i:j]) <= 16)
    assert common.by_slices(lambda x: x)(pa.array([], pa.string())).to_pylist() == []
    assert [b"".join(common.byte_pieces(x, 3)) for x in (b"", b"abcdefgh", b"ab cd ef gh")] == [b"", b"abcdefgh", b"ab cd ef gh"]


def test_near_dedup_keeps_unrelated_texts_that_share_an_id(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    texts = [(None, "a first text without an id, on wizards and foxes"), (None, "something else altogether, also without an id here"), (7, "seven sorcerers judge what makes good writing"), (7, "lazy dogs sleep in the sun while nobody is looking"), (None, "lazy dogs sleep in the sun while nobody is looking")]
    given = frame(spark, [(i, t, "en", "s", 1, True, "r", 1, "s", "w", 2) for i, t in texts]).select("doc_id", "text", "lang", "source", "n_chars")
    stage = dict(pipeline.STAGES)["near_dedup"]
    assert Counter((r.doc_id, r.text) for r in stage(spark, given, "").collect()) == Counter(texts[:4])


@pytest.mark.parametrize("page", ["<p>text" + "a<b," * 250_000, "<p" * 500_000, "<aaa" * 250_000, "<aaa" * 250_000 + ">", "<p>t" + "a<b 'x\" " * 100_000])
def test_broken_tags_take_linear_time(page):
    began = time.perf_counter()
    html_extract.extract(page)
    assert time.perf_counter() - began < 5


TEXT = "<p>A paragraph of the article, with words, and commas, that is long enough to be text by itself.</p>"
WHOLE = "<p>Another whole paragraph of it, which no name may take away, with commas, and with enough words.</p>"


@pytest.mark.parametrize("start", ['<div class="ad-hoc-analysis">', '<div class="navigation-history">', '<section id="promotion-and-relegation">', '<div class="login">', '<div class="search">', '<section id="sponsor">', '<div class="notice-period">'])
def test_sections_are_not_lost_by_their_names(start):
    end = f"</{start[1:].split()[0]}>"
    for page in (f"<div>{TEXT}{start}{WHOLE}{end}{TEXT}</div>", f"<body><article>{TEXT}{start}{WHOLE}{end}</article>"):
        assert html_extract.extract(page).count("Another whole paragraph") == 1


@pytest.mark.parametrize("part", ['<div class="login"><input name=user> <button>Sign in</button> with your account, please, to go on reading all of this text today</div>', '<div class="related"><a href=x>Something else, that you may like, and that is much longer than a few words, all of it linked</a></div>', '<div class="share">Tell a friend</div>', '<div class="ad">Buy this, now, at once, as many of them as you can, before they are all gone, my friends.</div>'])
def test_what_bears_its_name_out_goes(part):
    assert html_extract.extract(f"<div>{TEXT}{part}{TEXT}</div>").count("\n") == 1


@pytest.mark.parametrize("entry", ["<div class=item><span class=author>Ann {0}</span> <time>May {0}</time><p>{1}</div>", "<li class=x><b class=username>Bo</b> {0} days ago<p>{1}</li>", "<div class=post-7><a rel=author href=u>Cy</a> <i>2021-03-0{0}</i><p>{1}</div>"])
def test_threads_without_names_are_comments(entry):
    says = "I think, that this is, in every way, a wrong view of it, and I have always thought so, really."
    thread = "<div class=discussion>" + "".join(entry.format(i, says) for i in (1, 2, 3)) + "</div>"
    for page in (f"<div>{TEXT * 3}{thread}</div>", f"<body><article>{TEXT}{TEXT}{thread}</article>"):
        assert "wrong view" not in html_extract.extract(page) and html_extract.extract(page).count("A paragraph") >= 2
    dated = "<ul>" + "".join(f"<li>{i} May 2020: something, of note, took place, as the article tells here</li>" for i in range(4)) + "</ul>"
    assert html_extract.extract(f"<article>{TEXT}{dated}</article>").count("took place") == 4
