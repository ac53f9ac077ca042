"""Registered queries that go through files, connectors and services: what is written, or offered by an offline service,
comes back as the SQL has it."""

from __future__ import annotations

import functools
import json
import re
import urllib.parse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statweave.functions import table_functions
from statweave.functions.vectors import cosine
from statweave.operators import evaluation as E
from statweave.operators import graph as G
from statweave.operators import nearest, retrieval
from statweave.operators import statistics as S
from statweave.operators import triples as K
from statweave.plans import answering as A
from statweave.plans import fixtures as X
from statweave.plans import queries as Q
from statweave.plans.queries import query, with_
from statweave.session import cut_lineage, shared_path
from statweave.sources import files, json_entries, remote, sparql, wiki
from statweave.sources import services as V
from statweave.streaming import once, resume


# files
@query(with_(X.SENTENCES) + "SELECT CAST(id AS VARCHAR) AS topic, row_number() OVER (PARTITION BY id ORDER BY pos) - 1 AS pos, sentence FROM SS")
def corpus_file(spark: SparkSession, d: str) -> DataFrame:
    path, text = shared_path(spark, "corpus-"), X.prose(spark, d)
    found = K.statistical_sentences(text, "text", "id").groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "sentence"))), lambda x: x["sentence"]).alias("sentences"))
    rows = found.join(text, "id").select(F.col("id").cast("string").alias("topic"), "sentences", F.col("text").alias("full_text"), F.size("sentences").cast("long").alias("sentence_count"), F.length("text").cast("long").alias("text_length"))
    files.write_corpus(rows, path)
    return files.flat_sentences(files.corpus(spark, path)).select("topic", F.col("pos").cast("long").alias("pos"), "sentence")


def block_bytes(size: int, least: int = 16 << 10, most: int = 256) -> int:
    """Bytes of a block where a file of that size is cut into as many as most, or into blocks of at least so many bytes."""
    return max(least, -(-size // most))


@query(with_(X.TRIPLES) + "SELECT CAST(tid AS VARCHAR) AS tid, subject, object FROM T")
def json_object(spark: SparkSession, d: str) -> DataFrame:
    """Rows as one JSON object, written by many tasks and read in blocks of a few kilobytes, with entries over their ends.
    Of large objects the blocks are larger instead of more."""
    path, key = shared_path(spark, "object-"), "spark.sql.files.maxPartitionBytes"
    json_entries.write_object(X.triples(spark, d), F.col("tid"), F.struct("subject", "object"), path)
    kept = spark.conf.get(key)
    spark.conf.set(key, str(block_bytes(files.size(spark, path))))
    try:
        return cut_lineage(json_entries.object_of(spark, path, "struct<subject: string, object: string>")).select(F.col("key").alias("tid"), "value.subject", "value.object")
    finally:
        spark.conf.set(key, kept)


@query("SELECT qid, id, rank FROM (SELECT q.vec_id AS qid, x.vec_id AS id, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(x.embedding AS DOUBLE[])) DESC, x.vec_id) AS rank FROM embeddings q, embeddings x WHERE q.vec_id % 50 = 0) z WHERE rank <= 5")
def nearest_index(spark: SparkSession, d: str) -> DataFrame:
    """An index of all vectors, of which every list is asked by its vectors and ranked again: exact, and in order."""
    path, index = shared_path(spark, "nearest-"), X.vectors(spark, d).select("id", "vector")
    nearest.build(index, path)
    return nearest.search(index.where("id % 50 = 0").select(F.col("id").alias("qid"), "vector"), path, 5, shortlist=None).select("qid", "id", "rank")


@query("SELECT count(*) AS asked, true AS nine_of_ten, true AS in_order FROM embeddings WHERE vec_id % 50 = 0")
def nearest_index_recall(spark: SparkSession, d: str) -> DataFrame:
    """With production parameters the index finds at least nine of ten of the exact nearest, in order."""
    path, index = shared_path(spark, "nearest-"), X.vectors(spark, d).select("id", "vector")
    nearest.build(index, path)
    asked = cut_lineage(index.where("id % 50 = 0").select(F.col("id").alias("qid"), "vector"))
    found, exact = cut_lineage(nearest.search(asked, path, 5)), cut_lineage(retrieval.cosine_topk(asked, index, 5))
    right = exact.join(found.select("qid", "id", F.lit(1).alias("hit")), ["qid", "id"], "left").agg((F.sum(F.coalesce("hit", F.lit(0))) >= 0.9 * F.count(F.lit(1))).alias("nine_of_ten"))
    order = found.alias("a").join(found.alias("b"), F.expr("a.qid = b.qid and a.rank + 1 = b.rank")).agg(F.coalesce(F.bool_and(F.expr("a.distance <= b.distance")), F.lit(True)).alias("in_order"))
    return asked.agg(F.count(F.lit(1)).alias("asked")).join(F.broadcast(right)).join(F.broadcast(order))  # one row each


@query(with_(X.TRIPLES) + "SELECT subject, relation, object, source_topic, 'llm' AS source FROM T")
def triples_file(spark: SparkSession, d: str) -> DataFrame:
    """JSON lines, among them blank ones and some that don't parse."""
    path = shared_path(spark, "triples-")
    rows = X.triples(spark, d).select(F.to_json(F.struct("subject", "relation", "object", "source_topic")).alias("value"))
    rows.unionByName(spark.createDataFrame([("",), ("not json",), ("{\"subject\": ",)], "value string")).write.text(path)
    return files.triples(spark, path).select("subject", "relation", "object", "source_topic", "source")


@query(with_(X.RESULTS) + "SELECT method, 'all' AS model, count(*) AS n, count(DISTINCT question) AS questions FROM R WHERE error IS NULL GROUP BY method")
def results_log(spark: SparkSession, d: str) -> DataFrame:
    """Logs that are appended to, cleared of errors, and read by their names, one method under an old one."""
    folder = shared_path(spark, "logs-")
    rows = X.results(spark, d).select(F.col("question").alias("query"), "method", "answer", "error", "latency_ms")
    for method in ("kg", "rag", "zero"):
        own = rows.where(F.col("method") == method).drop("method")
        for half in (own.where("error is null"), own.where("error is not null")):
            files.append_results(half, f"{folder}/{'facts' if method == 'kg' else method}_all.jsonl")
        files.purge_errors(spark, f"{folder}/{'facts' if method == 'kg' else method}_all.jsonl")
    return files.results(spark, folder, {"facts": "kg"}).groupBy("method", "model").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("query").alias("questions"))


@query(with_(X.ASKED) + "SELECT id, subject, fine AS document, 't' || label AS source_topic FROM FI WHERE label = 1 ORDER BY id LIMIT 20")
def index_file(spark: SparkSession, d: str) -> DataFrame:
    """An index that is made anew, read by a filter on metadata, without vectors, up to a limit."""
    path = shared_path(spark, "index-")
    rows = X.facts(spark, d).select("id", "vector", "subject", F.col("fine").alias("document"), "source_topic")
    files.write_index(rows.where("id < 5"), path)
    files.write_index(rows, path)
    return files.index_where(spark, path, F.col("source_topic") == "t1", 20)


@query("SELECT DISTINCT 'current' AS list, p_brand AS topic FROM part UNION SELECT 'backup', trim(p_name) FROM part")
def topic_lists(spark: SparkSession, d: str) -> DataFrame:
    """A topic list is replaced twice; what stood there first is kept, once."""
    path, part = shared_path(spark, "topics-"), X.table(spark, d, "part")
    for name in ("p_name", "p_type", "p_brand"):
        files.write_topics(part.select(F.col(name).alias("topic")).distinct(), path, f"{path}.backup")
    read = lambda p, name: files.topics(spark, p, distinct=True).select(F.lit(name).alias("list"), "topic")
    return read(path, "current").unionByName(read(f"{path}.backup", "backup"))


@query("SELECT p_partkey % 4 AS depth, p_name || ' ' || p_partkey AS title, p_brand AS category FROM part")
def tsv_dump(spark: SparkSession, d: str) -> DataFrame:
    path = shared_path(spark, "tsv-")
    files.write_tsv(X.table(spark, d, "part").select((F.col("p_partkey") % 4).alias("depth"), F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string")).alias("title"), F.col("p_brand").alias("category")), path)
    return spark.read.csv(path, sep="\t", schema="depth long, title string, category string")


@query(with_(X.BENCHMARK) + "SELECT relation, count(*) AS n, count(DISTINCT source_topic) AS topics FROM B GROUP BY relation")
def report_file(spark: SparkSession, d: str) -> DataFrame:
    """A report is one JSON array, which is replaced as a whole and read again."""
    path = shared_path(spark, "report-")
    rows = Q.benchmark_stats(spark, d)
    files.write_json(rows.limit(1), path)
    files.write_json(rows, path)
    return files.json_array(spark, path, "relation string, n long, topics long")


@query("SELECT CAST(p_partkey AS VARCHAR) AS sample_id, CAST(p_size % 3 AS VARCHAR) AS score, p_name || ', \"so\"' || chr(10) || 'it is' AS note FROM part")
def annotation_csv(spark: SparkSession, d: str) -> DataFrame:
    """Quoted fields with separators, quotation marks and line breaks."""
    path = shared_path(spark, "csv-")
    rows = X.table(spark, d, "part").select(F.col("p_partkey").alias("sample_id"), (F.col("p_size") % 3).alias("score"), F.concat("p_name", F.lit(', "so"\nit is')).alias("note"))
    rows.write.csv(path, header=True, escape='"')
    return files.table_csv(spark, path)


@query("SELECT DISTINCT p_brand AS topic FROM part")
def held_out_file(spark: SparkSession, d: str) -> DataFrame:
    path = shared_path(spark, "held-")
    X.table(spark, d, "part").select("p_brand").distinct().agg(F.to_json(F.collect_list("p_brand")).alias("value")).coalesce(1).write.text(path)
    return files.held_out_topics(spark, path)


@query("SELECT CAST(rank() OVER (ORDER BY r_name) - 1 AS BIGINT) AS position, r_name AS relation, '- ' || r_name || ': number ' || r_regionkey || ' (e.g., ' || r_regionkey || ' units)' AS line FROM region")
def vocabulary_file(spark: SparkSession, d: str) -> DataFrame:
    path, key = shared_path(spark, "schema-"), F.col("r_regionkey").cast("string")
    entry = F.struct(F.col("r_name").alias("name"), F.concat(F.lit("number "), key).alias("description"), F.concat(key, F.lit(" units")).alias("example"))
    X.table(spark, d, "region").agg(F.to_json(F.struct(F.lit("2.0").alias("schema_version"), F.array_sort(F.collect_list(entry)).alias("relations"))).alias("value")).coalesce(1).write.text(path)
    return files.vocabulary(spark, path).select(F.col("position").cast("long").alias("position"), "relation", "line")


@query(with_(X.TRIPLES, X.STRUCTURAL) + """SELECT 'chunks' AS name, count(*) AS n FROM part UNION ALL SELECT 'entities', count(DISTINCT subject) FROM T UNION ALL SELECT 'relationships', (SELECT count(*) FROM T) + (SELECT count(*) FROM S)""")
def graph_tables(spark: SparkSession, d: str) -> DataFrame:
    t = X.triples(spark, d)
    path = shared_path(spark, "graph-")
    names = files.write_graph(X.prose(spark, d), G.entity_descriptions(t), G.relationships(t, X.structural(spark, d)), path)
    counts = [spark.read.parquet(f"{path}/{name}").agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n")) for name in names]
    return functools.reduce(DataFrame.unionByName, counts)


@query("SELECT DISTINCT p_brand AS name, 64 AS dimensions, CAST(1 AS DOUBLE) AS length FROM part")
def embedding_cache(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of names, half of which a first call has put into the cache."""
    path, names = shared_path(spark, "vectors-"), X.table(spark, d, "part").select(F.col("p_brand").alias("name")).distinct()
    embed = lambda rows: V.embed(rows, "text", V.hashed_embedder(64))
    files.cached_vectors(names.where("name < 'Brand#3'"), "name", path, embed)
    rows = files.cached_vectors(names, "name", path, embed)
    return rows.select("name", F.size("vector").alias("dimensions"), F.round(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)), 6).alias("length"))


@query("SELECT o_orderstatus AS status, count(*) AS n, count(DISTINCT o_orderkey) AS orders FROM orders GROUP BY o_orderstatus")
def streamed_files(spark: SparkSession, d: str) -> DataFrame:
    """Files that come in twice, with orders that came before among the second."""
    folder, orders = shared_path(spark, "stream-"), X.table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    for rows in (orders.where("o_orderstatus <> 'O'"), orders):
        rows.write.mode("append").json(f"{folder}/in")
        resume.process_new_files(spark, f"{folder}/in", "o_orderkey long, o_orderstatus string", f"{folder}/out", f"{folder}/checkpoint", "o_orderkey", lambda batch: batch)
    return spark.read.parquet(f"{folder}/out").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_orderkey").alias("orders"))


@query("SELECT r_name AS key, 'done ' || r_regionkey AS result FROM region")
def checkpointed_work(spark: SparkSession, d: str) -> DataFrame:
    """Work of which a part fails the first time, and alone is done again."""
    path, work = shared_path(spark, "checkpoint-"), X.table(spark, d, "region").select(F.col("r_name").alias("key"), "r_regionkey")
    result = F.concat(F.lit("done "), F.col("r_regionkey").cast("string")).alias("result")
    failing = F.when(F.col("r_regionkey") > 2, "timeout").alias("error")
    resume.checkpointed(work, "key", path, lambda rows: rows.select("key", result, failing))
    return resume.checkpointed(work, "key", path, lambda rows: rows.select("key", result, F.lit(None).cast("string").alias("error"))).select("key", "result")


@query(with_(X.SCORED) + """SELECT 'method      n       nem' AS line UNION ALL SELECT '-----------------------' UNION ALL SELECT format('{:<6} {:>6} {:>9.4f}', method, count(*), round(avg(nem), 6)) FROM F GROUP BY method""")
def report_table(spark: SparkSession, d: str) -> DataFrame:
    """A report of fixed width under its heading."""
    rows, widths = E.summary(Q.scored(spark, d), "method").select("method", F.col("n_evaluated").alias("n"), "nem"), {"method": 6, "n": 6, "nem": 9}
    head = spark.range(1).select(F.explode(F.array(*map(F.lit, files.report_head(rows, widths)))).alias("line"))
    return head.unionByName(files.report_rows(rows, widths).select("line"))


# connectors
def offline_wiki(url: str) -> tuple[int, bytes]:
    """Answers of a wiki, all from the number in the title that is asked for: members and links come in pages of three,
    every fourth article is missing, every third title is a redirect, every second is written in small letters."""
    given = dict(urllib.parse.parse_qsl(urllib.parse.urlparse(url).query))
    title = given.get("cmtitle", given.get("titles", ""))
    number = lambda name: int(re.sub("[^0-9]", "", name))

    def page(rows: list[str], marker: str) -> tuple[list[dict], dict]:
        at = int(given.get(marker, 0))
        return [{"title": x} for x in rows[at : at + 3]], {"continue": {marker: str(at + 3)}} if at + 3 < len(rows) else {}

    if "cmtitle" in given:
        name, kind = title.removeprefix("Category:"), "Category:" if given["cmtype"] == "subcat" else ""
        rows, more = page([f"{kind}{name} part {i}" for i in range(number(name) % 8)], "cmcontinue")
        answer = {"query": {"categorymembers": rows}} | more
    elif given.get("prop") == "categories":
        answer = {"query": {"pages": {"1": {"categories": [{"title": f"Category:Group {number(title) % 7}"}, {"title": "Category:Articles with Dead Links"}]}}}}
    elif given.get("prop") in ("links", "redirects"):
        rows, more = page([f"{given['prop']} {i} of {title}" for i in range(number(title) % 5)], "plcontinue" if given["prop"] == "links" else "rdcontinue")
        answer = {"query": {"pages": {"1": {given["prop"]: rows}}}} | more
    elif given.get("prop") == "extracts":
        answer = {"query": {"pages": {"1": {"extract": f"{title} is in group {number(title) % 7}."} if number(title) % 4 else {"missing": ""}}}}
    else:
        moved = lambda every, to: [{"from": x, "to": to(x)} for x in title.split("|") if number(x) % every == 0]
        answer = {"query": {"redirects": moved(3, lambda x: f"Target {number(x) % 10}"), "normalized": moved(2, str.lower)}}
    return 200, json.dumps(answer).encode()


WIKI = wiki.Api("http://wiki.invalid/api", offline_wiki)
MANY = {"calls": 1_000_000, "callers": 8}
NUMBERED = "C AS (SELECT DISTINCT c_name AS key, CAST(regexp_replace(c_name, '[^0-9]', '', 'g') AS BIGINT) AS n FROM customer)"


@query(with_(NUMBERED) + "SELECT key, key || ' part ' || i AS item, i AS position, CAST(NULL AS VARCHAR) AS error FROM C, (SELECT unnest(range(8)) AS i) r WHERE i < n % 8")
def wiki_subcategories(spark: SparkSession, d: str) -> DataFrame:
    """Listings that go on over several pages."""
    return remote.paged(X.table(spark, d, "customer"), "c_name", wiki.CategoryMembers(WIKI, "subcat"), **MANY)


@query(with_(NUMBERED) + "SELECT kind, key, kind || ' ' || i || ' of ' || key AS item, i AS position FROM C, (SELECT unnest(range(5)) AS i) r, (VALUES ('links'), ('redirects')) k(kind) WHERE i < n % 5")
def wiki_links(spark: SparkSession, d: str) -> DataFrame:
    """What articles link to, and what is redirected to them, page by page."""
    kinds = [remote.paged(X.table(spark, d, "customer"), "c_name", wiki.ArticleProperty(WIKI, kind), **MANY).where("error is null").select(F.lit(kind).alias("kind"), "key", "item", "position") for kind in ("links", "redirects")]
    return functools.reduce(DataFrame.unionByName, kinds)


@query(with_(NUMBERED) + "SELECT key, 'Group ' || n % 7 AS item, CAST(0 AS BIGINT) AS position FROM C")
def wiki_categories(spark: SparkSession, d: str) -> DataFrame:
    """Categories of articles, those of maintenance left out."""
    listed = remote.paged(X.table(spark, d, "customer"), "c_name", wiki.ArticleProperty(WIKI, "categories"), **MANY)
    return remote.visible_categories(listed, ("dead links",))


@query(with_(NUMBERED) + "SELECT key, key || ' is in group ' || n % 7 || '.' AS item FROM C WHERE n % 4 <> 0")
def wiki_articles(spark: SparkSession, d: str) -> DataFrame:
    """Texts of the articles that there are."""
    return wiki.articles(X.table(spark, d, "customer"), "c_name", WIKI, **MANY).where("error is null").select("key", "item")


@query(with_(NUMBERED) + "SELECT key AS alias, CASE WHEN n % 3 = 0 THEN 'Target ' || n % 10 ELSE lower(key) END AS target FROM C WHERE n % 3 = 0 OR n % 2 = 0")
def wiki_aliases(spark: SparkSession, d: str) -> DataFrame:
    """Redirects, asked for in batches, which beat spellings."""
    customer = X.table(spark, d, "customer")
    redirects, spellings = (remote.looked_up(customer, "c_name", wiki.Resolved(WIKI, kind), **MANY) for kind in ("redirects", "normalized"))
    return remote.aliases(redirects, spellings)


@query("SELECT date_trunc('minute', ts) AS minute, count(*) AS calls, greatest(count(*) - 30, 0) AS over FROM events GROUP BY ALL")
def call_windows(spark: SparkSession, d: str) -> DataFrame:
    """A log of calls against a budget of thirty a minute."""
    return X.table(spark, d, "events").groupBy(F.date_trunc("minute", "ts").alias("minute")).agg(F.count(F.lit(1)).alias("calls"), F.greatest(F.count(F.lit(1)) - 30, F.lit(0)).alias("over"))


class Clock:
    """A clock that only sleeping moves; a copy's time is its own."""

    def __init__(self) -> None:
        self.now = 0.0

    def __call__(self) -> float:
        return self.now

    def sleep(self, seconds: float) -> None:
        self.now += seconds

    def minutes(self, items: list) -> list[str]:
        """A service that answers with the minute it is called in."""
        return [str(int(self.now // 60))] * len(items)


@query("SELECT count(*) AS n, 10 AS most, true AS full FROM part")
def throttled_calls(spark: SparkSession, d: str) -> DataFrame:
    """Questions of three calls each to a service with thirty a minute in every task: ten questions a minute, and a
    task's last minute alone has fewer."""
    clock = Clock()
    service = V.Throttled(clock.minutes, 30, 60.0, 3, clock=clock, sleep=clock.sleep)
    asked = X.table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("prompt")).repartition(4, "prompt")
    minutes = V.generate(asked, "prompt", service).groupBy(F.spark_partition_id().alias("task"), F.col("answer").cast("int").alias("minute")).agg(F.count(F.lit(1)).alias("calls"))
    tasks = minutes.groupBy("task").agg(F.sum("calls").alias("n"), F.max("calls").alias("most"), F.max("minute").alias("last"), F.sum(F.when(F.col("calls") == 10, 1).otherwise(0)).alias("whole"))
    return tasks.agg(F.sum("n").alias("n"), F.max("most").cast("int").alias("most"), F.every(F.col("whole") >= F.col("last")).alias("full"))


def offline_endpoint(request: str) -> list[dict]:
    """Answers for the articles of a request: of all but every fourth, by the length of its name, a quantity for each
    property that is asked for; every other amount has a sign, as endpoints write them."""
    cell = lambda **kv: {k: {"value": v} for k, v in kv.items()}
    out = []
    for url in re.findall(r"<(http[^>]*/wiki/[^>]*)>", request):
        name = url.rsplit("/", 1)[1]
        key = int(name[-3:])
        for code in re.findall(r"\(wd:(P\d+) ", request) if key % 4 else []:
            out.append(cell(entity=f"http://w/Q{key}", name=name.lower(), property=f"http://w/{code}", amount=f"{'+' * (key % 2)}{key * len(code)}", unit_name="1" if code == "P1082" else "square kilometre", article=url))
    return out


@query("""WITH C AS (SELECT c_name AS topic, CAST(right(c_name, 3) AS BIGINT) AS key FROM customer)
SELECT lower(topic) AS subject, relation, CAST(min(key) * len AS VARCHAR) || unit AS object, min(topic) AS source_topic
FROM C, (VALUES ('HasPopulation', 5, ''), ('HasArea', 5, ' square kilometre'), ('P9', 2, ' square kilometre')) p(relation, len, unit) WHERE key % 4 <> 0 GROUP BY topic, relation, len, unit""")
def sparql_bindings(spark: SparkSession, d: str) -> DataFrame:
    """Requests for batches of topics, made on the executors, and the facts in the answers."""
    batches = cut_lineage(sparql.batched(X.table(spark, d, "customer"), "c_name", "c_custkey"))
    rows = cut_lineage(sparql.bindings(batches, offline_endpoint, ["P1082", "P2046", "P9"], calls=1_000_000, callers=8))
    return sparql.facts(rows, batches, {"P1082": "HasPopulation", "P2046": "HasArea"}).select("subject", "relation", "object", "source_topic")


# services
def offline_chat(request: dict) -> dict:
    text = request["messages"][-1]["content"]
    if text.endswith("0"):
        raise OSError("gone")
    kind = int(text[-1]) % 3
    message = {"content": f"{request['max_tokens']} {request['temperature']}"} if kind == 0 else {"content": None, "reasoning": "because"} if kind == 1 else {"content": None}
    return {"choices": [{"message": message}]}


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 10 = 0 THEN '' ELSE CASE p_partkey % 10 % 3 WHEN 0 THEN '1024 0.3' WHEN 1 THEN 'because' ELSE '' END END AS answer, CASE WHEN p_partkey % 10 = 0 THEN 'RuntimeError: OSError: gone' END AS error FROM part""")
def chat_answers(spark: SparkSession, d: str) -> DataFrame:
    """A chat service that fails, reasons without an answer, and says nothing."""
    call = V.tuned(V.ChatService(offline_chat, "glm-5", wait=0.0, tries=1), 0.3)
    rows = X.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("question "), F.col("p_partkey").cast("string")).alias("prompt"))
    return V.generate(rows, "prompt", call).select("id", "answer", "error")


def broken(pairs: list) -> list:
    raise OSError("gone")


@query(with_(Q.NEAREST) + "SELECT qid, id, rank FROM N WHERE rank <= 3")
def reranker_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Where the reranker fails, the order stays."""
    hits = Q.nearest(spark, d).withColumns({"question": F.lit("q"), "document": F.lit("d")})
    return V.rerank(hits, "question", "document", broken, 3).select("qid", "id", "rank")


@query(with_(X.ASKED) + ", E AS (SELECT qid, FN.id, label FROM FN JOIN FI USING (id) WHERE mode = 'full_index' AND rank = 1) SELECT qid, 'Community ' || label || ' in short' AS answer, 'community' AS method FROM E")
def community_answers(spark: SparkSession, d: str) -> DataFrame:
    """The reports of the nearest entities' communities; the offline service answers with the first."""
    index = X.facts(spark, d)
    entities = index.select("id", "vector", F.concat(F.lit("e"), F.col("id").cast("string")).alias("entity"), F.substring("source_topic", 2, 9).alias("community"))
    reports = entities.select("community").distinct().withColumn("summary", F.concat(F.lit("Community "), "community", F.lit(" in short")))
    return A.community_retrieval(X.asked(spark, d).select("qid", "question", "vector"), entities, reports, None, V.echo_generator()).select("qid", "answer", "method")


@query(with_(X.ASKED) + "SELECT qid, fine AS answer, 'hybrid' AS method FROM FN WHERE mode = 'full_index' AND rank = 1")
def hybrid_answers(spark: SparkSession, d: str) -> DataFrame:
    """Entities, relations and chunks together, the nearest entity first."""
    index = X.facts(spark, d)
    entities = index.select("id", "vector", F.concat(F.lit("e"), F.col("id").cast("string")).alias("entity"), F.col("fine").alias("document"))
    relations = index.select("id", "vector", F.concat(F.lit("e"), F.col("id").cast("string")).alias("src"), F.col("source_topic").alias("dst"), F.col("medium").alias("document"))
    chunks = entities.select("entity", F.concat(F.lit("about "), "entity").alias("document"))
    return A.hybrid_retrieval(X.asked(spark, d).select("qid", "question", "vector"), entities, relations, chunks, None, V.echo_generator()).select("qid", "answer", "method")


@query(with_(X.TRIPLES) + """, M AS (SELECT DISTINCT p_type AS community, p_brand AS node FROM part), O AS (SELECT *, row_number() OVER (PARTITION BY community ORDER BY node) AS m FROM M)
SELECT community, 'Community ' || community || ': ' || string_agg(node, ', ' ORDER BY node) FILTER (m <= 3) AS title, 'Community covering: ' || string_agg(node, ', ' ORDER BY node) FILTER (m <= 5) AS summary, 0 AS level, count(*) AS rank FROM O GROUP BY community""")
def community_reports(spark: SparkSession, d: str) -> DataFrame:
    """Reports whose service fails name the first members."""
    members = X.table(spark, d, "part").select(F.col("p_type").alias("community"), F.col("p_brand").alias("node")).distinct()
    return G.community_reports(members, X.triples(spark, d), broken).drop("error")


def topped(number: str, of: str) -> str:
    """SQL for a numbered line of a context."""
    return f"'[' || {number} || '] ' || {of}"


#: Two entities of each fact lie at one place, so every search has ties; e-entities come before x-entities.
COMMUNITY = X.ASKED + f""",
EN AS (SELECT id AS eid, v, 'e' || id AS entity, 'c' || label AS community, id AS part FROM FI UNION ALL SELECT id + 1000000000, v, 'x' || id, 'd' || id % 7, id FROM FI),
ED AS (SELECT q.id AS qid, q.question, e.eid, e.entity, e.community, e.part, 1 - list_cosine_similarity(q.v, e.v) AS distance FROM FI q, EN e WHERE q.id % 50 = 0),
NE AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, eid DESC) AS rank FROM ED) z WHERE rank <= 10),
BC AS (SELECT qid, community, row_number() OVER (PARTITION BY qid ORDER BY min(rank), community) AS n FROM NE GROUP BY qid, community),
CS AS (SELECT qid, string_agg({topped("n", "'About ' || community")}, chr(10) ORDER BY n) AS summaries FROM BC WHERE n <= 5 GROUP BY qid),
UN AS (SELECT DISTINCT l_orderkey AS unit, l_partkey AS part FROM lineitem),
MF AS (SELECT * FROM (SELECT entity, unit, row_number() OVER (PARTITION BY entity ORDER BY unit) AS nth FROM EN JOIN UN USING (part) WHERE entity LIKE 'e%') z WHERE nth <= 3),
QF AS (SELECT qid, unit, row_number() OVER (PARTITION BY qid ORDER BY rank, entity, nth) AS n FROM NE JOIN MF USING (entity)),
CF AS (SELECT qid, string_agg({topped("n", "'order ' || unit")}, chr(10) ORDER BY n) AS facts FROM QF WHERE n <= 10 GROUP BY qid)"""


@query(with_(COMMUNITY) + """SELECT qid, 'Context:' || chr(10) || 'Community Summaries:' || chr(10) || summaries || coalesce(chr(10) || chr(10) || 'Relevant Facts:' || chr(10) || facts, '') || chr(10) || chr(10) || 'Question: ' || question AS prompt
FROM CS LEFT JOIN CF USING (qid) JOIN FI ON qid = id""")
def community_prompts(spark: SparkSession, d: str) -> DataFrame:
    """Whole prompts of the community method: summaries by their best entity, of equally near entities the later first,
    then the first text units of each entity."""
    index = X.facts(spark, d)
    name = lambda kind: F.concat(F.lit(kind), F.col("id").cast("string")).alias("entity")
    entities = index.select("id", "vector", name("e"), F.concat(F.lit("c"), F.substring("source_topic", 2, 9)).alias("community"))
    entities = entities.unionByName(index.select((F.col("id") + 1_000_000_000).alias("id"), "vector", name("x"), F.concat(F.lit("d"), (F.col("id") % 7).cast("string")).alias("community")))
    reports = entities.select("community").distinct().withColumn("summary", F.concat(F.lit("About "), "community"))
    named = F.array_sort(F.collect_set(F.concat(F.lit("e"), F.col("l_partkey").cast("string"))))
    units = X.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("unit")).agg(named.alias("entity_ids")).withColumn("text", F.concat(F.lit("order "), F.col("unit").cast("string")))
    asked = A.community_retrieval(X.asked(spark, d).select("qid", "question", "vector"), entities, reports, None, list, units=units)
    return asked.select("qid", F.col("answer").alias("prompt"))


HYBRID = X.ASKED + f""",
HN AS (SELECT qid, id, fine, rank FROM FN WHERE mode = 'full_index' AND rank <= 10),
RL AS (SELECT id, 'e' || (id - 1) AS src, 'e' || id AS dst, medium, v FROM FI WHERE id % 2 = 1),
HD AS (SELECT q.id AS qid, r.id, r.src, r.dst, r.medium, 1 - list_cosine_similarity(q.v, r.v) AS distance FROM FI q, RL r WHERE q.id % 50 = 0),
HR AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, id) AS rank FROM HD) z WHERE rank <= 10),
HE AS (SELECT qid, 'e' || id AS entity, rank FROM HN UNION ALL SELECT qid, src, rank + 10 FROM HR UNION ALL SELECT qid, dst, rank + 10 FROM HR),
CH AS (SELECT 'e' || id AS entity, 'text ' || id // 3 AS document FROM FI),
HT AS (SELECT qid, document, min(rank) AS rank FROM HE JOIN CH USING (entity) GROUP BY qid, document),
HC AS (SELECT * FROM (SELECT qid, document, row_number() OVER (PARTITION BY qid ORDER BY rank, document) AS rank FROM HT) z WHERE rank <= 10),
HA AS (SELECT qid, fine AS document, 0 AS part, rank FROM HN UNION ALL SELECT qid, medium, 1, rank FROM HR UNION ALL SELECT qid, document, 2, rank FROM HC),
HO AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY part, rank, document) AS n FROM HA)"""


@query(with_(HYBRID) + f"""SELECT qid, 'Context:' || chr(10) || string_agg({topped("n", "document")}, chr(10) ORDER BY n) || chr(10) || chr(10) || 'Question: ' || any_value(question) AS prompt FROM HO JOIN FI ON qid = id GROUP BY qid""")
def hybrid_prompts(spark: SparkSession, d: str) -> DataFrame:
    """Whole prompts of the hybrid method: ten entities, ten relations of other facts, and the texts of all of them, of
    which three entities share one."""
    index, near = X.facts(spark, d), lambda back: F.concat(F.lit("e"), (F.col("id") - back).cast("string"))
    entities = index.select("id", "vector", near(0).alias("entity"), F.col("fine").alias("document"))
    relations = index.where("id % 2 = 1").select("id", "vector", near(1).alias("src"), near(0).alias("dst"), F.col("medium").alias("document"))
    chunks = index.select(near(0).alias("entity"), F.concat(F.lit("text "), F.floor(F.col("id") / 3).cast("string")).alias("document"))
    asked = A.hybrid_retrieval(X.asked(spark, d).select("qid", "question", "vector"), entities, relations, chunks, None, list)
    return asked.select("qid", F.col("answer").alias("prompt"))


@query(with_(X.TRIPLES) + """, M AS (SELECT DISTINCT p_type AS community, p_brand AS node FROM part), O AS (SELECT *, row_number() OVER (PARTITION BY community ORDER BY node) AS m FROM M),
W AS (SELECT *, row_number() OVER (PARTITION BY source_topic ORDER BY tid) AS t FROM T),
FA AS (SELECT community, row_number() OVER (PARTITION BY community ORDER BY m, t) AS n, '- ' || subject || ' ' || relation || ' ' || object AS fact FROM O JOIN W ON node = source_topic WHERE m <= 10 AND t <= 3),
FS AS (SELECT community, string_agg(fact, chr(10) ORDER BY n) AS facts FROM FA WHERE n <= 15 GROUP BY community)
SELECT community, 'Summarise in two or three sentences what these topics have in common, with their key figures.' || chr(10) || 'Topics: ' || string_agg(node, ', ' ORDER BY node) FILTER (m <= 10) || chr(10) || 'Facts:' || chr(10) || coalesce(any_value(facts), '') AS summary, count(*) AS rank, CAST(NULL AS VARCHAR) AS error
FROM O LEFT JOIN FS USING (community) GROUP BY community""")
def written_reports(spark: SparkSession, d: str) -> DataFrame:
    """Reports by a service that works, and gives back what it was asked."""
    members = X.table(spark, d, "part").select(F.col("p_type").alias("community"), F.col("p_brand").alias("node")).distinct()
    return G.community_reports(members, X.triples(spark, d), list).select("community", "summary", "rank", "error")


@query("""WITH V AS (SELECT CAST(vec_id AS BIGINT) AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), B AS (SELECT id, v FROM V UNION ALL SELECT id + 1000000000, v FROM V UNION ALL SELECT id + 2000000000, v FROM V),
D AS (SELECT q.id AS qid, b.id, 1 - list_cosine_similarity(q.v, b.v) AS distance FROM V q, B b WHERE q.id % 50 = 0)
SELECT qid, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, id DESC) AS rank FROM D) z WHERE rank <= 4""")
def later_first(spark: SparkSession, d: str) -> DataFrame:
    """An index that holds every vector three times: of equally near rows the later come first."""
    rows = X.vectors(spark, d)
    index = rows.select(F.explode(F.array(*[F.col("id") + n * 1_000_000_000 for n in range(3)])).alias("id"), "vector")
    return retrieval.cosine_topk(rows.where("id % 50 = 0").select(F.col("id").alias("qid"), "vector"), index, 4, later_first=True).select("qid", "id", "rank")


# bounds for what has no one right answer
@query(with_(Q.ALL_EDGES) + ", X AS (SELECT src AS node FROM G UNION SELECT dst FROM G) SELECT count(*) AS nodes, true AS better_than_labels, true AS whole FROM X")
def modularity_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Greedy communities cover all nodes and are more modular than propagated labels."""
    edges = cut_lineage(Q.all_edges(spark, d))
    both, found = cut_lineage(G.weighted(edges)), cut_lineage(G.modularity_communities(edges))
    own, other = (G.modularity(both, labels).first().modularity for labels in (found, G.propagate_labels(edges, 2)))
    return found.agg(F.count(F.lit(1)).alias("nodes"), F.lit(bool(own > max(other, 0.5))).alias("better_than_labels"), (F.count(F.lit(1)) == F.count_distinct("node")).alias("whole"))


@query(with_(Q.PAIRS) + "SELECT model, count(*) AS n, round(avg(x - y), 6) AS delta, true AS low_is_near, true AS high_is_near, abs(avg(x - y)) > 1.96 * stddev_samp(x - y) / sqrt(count(*)) AS significant FROM W GROUP BY model")
def bootstrap_bounds(spark: SparkSession, d: str) -> DataFrame:
    """The bootstrap's interval and its verdict, whether that leaves zero out, against those of the normal distribution."""
    pairs = Q.pairs(spark, d)
    near = pairs.groupBy("model").agg((F.stddev_samp(F.col("x") - F.col("y")) / F.sqrt(F.count(F.lit(1)))).alias("error"))
    rows = S.paired_bootstrap(pairs, ["model"]).join(near, "model")
    close = lambda end, sign: (F.abs(F.col(end) - F.col("delta") - sign * 1.96 * F.col("error")) < 0.25 * F.col("error")).alias(f"{end}_is_near")
    return rows.select("model", "n", F.round("delta", 6).alias("delta"), close("low", -1), close("high", 1), "significant")


# rows of parts that no other row reaches
@query(with_(X.ASKED) + f""", CX AS (SELECT 'own' AS name, qid, question, fine, rank FROM FN WHERE mode = 'held_out' UNION ALL
 SELECT 'other', qid, question, fine, row_number() OVER (PARTITION BY qid ORDER BY distance, id) FROM FD WHERE mode = 'full_index' AND id % 2 = 1)
SELECT 'kg_retrieval_' || name AS method, qid, 'Context:' || chr(10) || string_agg('[' || rank || '] ' || fine, chr(10) ORDER BY rank) || chr(10) || chr(10) || 'Question: ' || any_value(question) AS answer FROM CX WHERE rank <= 5 GROUP BY name, qid""")
def two_collections(spark: SparkSession, d: str) -> DataFrame:
    """The same questions to the own index, without what is held out, and to another collection, half of the facts: whole
    prompts."""
    questions, _, services = Q.offline(spark, d)
    index = services.indexes["fine"]
    return A.compared_indexes(questions, {"own": (index, Q.HELD_TOPICS), "other": (index.where("id % 2 = 1"), None)}, None, list).select("method", "qid", "answer")


@query(with_(X.ASKED) + f"""SELECT 'graph_rag' AS method, count(DISTINCT qid) AS n, true AS same FROM FN
UNION ALL SELECT 'kg_retrieval', count(DISTINCT qid), true FROM FN UNION ALL SELECT 'standard_rag', count(DISTINCT qid), true FROM FN UNION ALL SELECT 'zero_shot', count(DISTINCT qid), true FROM FN""")
def methods_by_name(spark: SparkSession, d: str) -> DataFrame:
    """Methods run by their names, one by one, give the prompts that a grid of them gives."""
    questions, _, s = Q.offline(spark, d, list)
    questions = cut_lineage(questions)
    index, chunks = s.indexes["fine"], s.chunks
    settings = {"zero_shot": (), "kg_retrieval": (index, None), "standard_rag": (chunks, None), "graph_rag": (index, None)}
    some = {"graph_rag": {"k": 5}}
    alone = [A.run(m, questions, *of, list, **some.get(m, {})).select("method", "qid", "answer") for m, of in settings.items()]
    cells = Q.N.grid(method=tuple(settings), mode=("full_index",), rerank=(False,))
    grid = Q.N.answer_cells(Q.N.with_cells(questions, cells), cells, s).select("method", "qid", F.col("answer").alias("other"))
    both = functools.reduce(DataFrame.unionByName, alone).join(grid, ["method", "qid"], "full")
    return both.groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.every(F.col("answer").eqNullSafe(F.col("other"))).alias("same"))


@query("""WITH V AS (SELECT CAST(vec_id AS BIGINT) AS id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: CASE WHEN vec_id % 10 = 1 THEN 0.0 ELSE x END) AS v FROM embeddings), O AS (SELECT v AS w FROM V WHERE id = 0)
SELECT id, round(list_inner_product(v, w) / (sqrt(list_inner_product(v, v)) * sqrt(list_inner_product(w, w)) + 1e-10), 6) AS cosine FROM V, O""")
def cosine_with_epsilon(spark: SparkSession, d: str) -> DataFrame:
    """Similarities whose norms are kept from zero, some of the vectors being zero."""
    zero = F.transform("vector", lambda x: F.when(F.col("id") % 10 == 1, 0.0).otherwise(x.cast("double")))
    rows = X.vectors(spark, d).select("id", zero.alias("vector"))
    one = rows.where("id = 0").select(F.col("vector").alias("w"))
    return rows.join(F.broadcast(one)).select("id", F.round(cosine(F.col("vector"), F.col("w"), "eps"), 6).alias("cosine"))


@query(with_(X.TRIPLES) + "SELECT subject || ' é' AS subject, relation, object, 'second' AS source FROM T")
def jsonl_file(spark: SparkSession, d: str) -> DataFrame:
    """Lines of triples, written twice in place of one another and read back."""
    path, rows = shared_path(spark, "lines-"), X.triples(spark, d).select(F.concat("subject", F.lit(" é")).alias("subject"), "relation", "object")
    files.write_jsonl(rows.limit(0), path)
    files.write_jsonl(rows, path)
    return files.triples(spark, path, "second").select("subject", "relation", "object", "source")


# table functions
def spread(rows: DataFrame) -> DataFrame:
    """rows in as many parts as the session's shuffles have: a small file of many rows is one task's otherwise."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


@query(Q.ORACLES["extract_numbers_docs"])
def numbers_lateral(spark: SparkSession, d: str) -> DataFrame:
    table_functions.register(spark)
    return spark.sql("SELECT doc_id, token, round(value, 6) AS value FROM {docs}, LATERAL numbers_in(text)", docs=X.table(spark, d, "documents"))


@query(Q.ORACLES["stat_sentence_filter"])
def sentences_lateral(spark: SparkSession, d: str) -> DataFrame:
    table_functions.register(spark)
    return spark.sql("SELECT id, sentence FROM {prose}, LATERAL statistical_sentences(text)", prose=X.prose(spark, d).transform(spread))


# streams
LATE, WAIT, REMEMBER = 6 * 3_600_000, 45_000_500, 90 * 86_400_000
ATTEMPTS = f"""
P AS (SELECT CAST(event_id // 3 AS VARCHAR) AS key, date_trunc('second', ts) AS ts, event_type = 'error' AS error, CAST(event_id AS VARCHAR) AS body, event_id,
 CASE WHEN event_id % 10 <> 0 AND event_id * 2 < (SELECT max(event_id) FROM events) THEN 1 ELSE 2 END AS run FROM events),
A AS (SELECT key, ts, error, body FROM P WHERE run = 1), W1 AS (SELECT max(ts) - INTERVAL {LATE} MILLISECOND AS w FROM A),
B0 AS (SELECT key, ts, error, body FROM P WHERE run = 2 OR event_id % 7 = 0), B AS (SELECT B0.* FROM B0, W1 WHERE ts > w),
W2 AS (SELECT max(ts) - INTERVAL {LATE} MILLISECOND AS w FROM B0),
T1 AS (SELECT key, min((ts, body)) AS x FROM A WHERE NOT error GROUP BY key), E1 AS (SELECT key, max((ts, body)) AS x FROM A WHERE key NOT IN (SELECT key FROM T1) GROUP BY key),
R1 AS (SELECT key, x FROM E1, W1 WHERE x[1] + INTERVAL {WAIT} MILLISECOND <= w),
T2 AS (SELECT key, min((ts, body)) AS x FROM B WHERE NOT error AND key NOT IN (SELECT key FROM T1) GROUP BY key),
E2 AS (SELECT key, max(x) AS x FROM (SELECT key, x FROM E1 UNION ALL SELECT key, (ts, body) FROM B WHERE error AND key NOT IN (SELECT key FROM T1)) z WHERE key NOT IN (SELECT key FROM T2) GROUP BY key),
R2 AS (SELECT E2.key, E2.x, R1.key IS NOT NULL AS again FROM E2 LEFT JOIN R1 USING (key), W2 WHERE E2.x[1] + INTERVAL {WAIT} MILLISECOND <= w AND (R1.key IS NULL OR E2.x[1] > R1.x[1]))"""


@query(with_(ATTEMPTS) + """SELECT key, x[1] AS ts, x[2] AS body, 'taken' AS status, 0 AS tries FROM T1
UNION ALL SELECT key, x[1], x[2], 'taken', CASE WHEN key IN (SELECT key FROM R1) THEN 1 ELSE 0 END FROM T2
UNION ALL SELECT key, x[1], x[2], 'retry', 1 FROM R1 UNION ALL SELECT key, x[1], x[2], 'retry', CASE WHEN again THEN 2 ELSE 1 END FROM R2""")
def taken_once(spark: SparkSession, d: str) -> DataFrame:
    """Events as attempts, three to a key, streamed in two runs, the second with late and repeated rows."""
    source, out, checkpoint = (shared_path(spark, f"{name}-") for name in ("attempts", "taken", "progress"))
    events = X.table(spark, d, "events")
    rows = events.crossJoin(events.agg(F.max("event_id").alias("last"))).select(
        F.floor(F.col("event_id") / 3).cast("string").alias("key"), F.date_trunc("second", "ts").cast("timestamp").alias("ts"), (F.col("event_type") == "error").alias("error"), F.col("event_id").cast("string").alias("body"), "event_id",
        ((F.col("event_id") % 10 != 0) & (F.col("event_id") * 2 < F.col("last"))).alias("early"),
    )
    for run in ("early", "not early or event_id % 7 = 0"):
        rows.where(run).select("key", "ts", "error", "body").write.mode("append").parquet(source)
        stream = spark.readStream.schema("key string, ts timestamp, error boolean, body string").parquet(source)
        once.run_available(once.take_once(stream, f"{LATE} milliseconds", WAIT, REMEMBER), out, checkpoint)
    return spark.read.schema("key string, ts timestamp, body string, status string, tries int").parquet(out)
