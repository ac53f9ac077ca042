"""Every registered query over the driver's tables, each beside the SQL that it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statweave.functions import metrics as M
from statweave.functions import text as T
from statweave.functions.vectors import cosine
from statweave.operators import containing as I
from statweave.operators import crawl as C
from statweave.operators import evaluation as E
from statweave.operators import graph as G
from statweave.operators import retrieval as R
from statweave.operators import skyline as Y
from statweave.operators import statistics as S
from statweave.operators import triples as K
from statweave.plans import answering as A
from statweave.plans import benchmark as B
from statweave.plans import experiments as N
from statweave.plans import fixtures as X
from statweave.session import cut_lineage, shared_path
from statweave.sources import files
from statweave.sources import services as V
from statweave.sources import sparql as P

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def with_(*parts: str) -> str:
    return "WITH " + ",".join(p.strip() for p in parts) + "\n"


def scored(spark: SparkSession, d: str) -> DataFrame:
    return E.with_gold(X.results(spark, d), X.benchmark(spark, d))


HELD_OUT = (0, 3)
NEAREST = """
V AS (SELECT CAST(vec_id AS BIGINT) AS id, CAST(label AS BIGINT) AS label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
D AS (SELECT q.id AS qid, x.id, x.label, 1 - list_cosine_similarity(q.v, x.v) AS distance FROM V q, V x WHERE q.id % 50 = 0 AND x.label NOT IN (0, 3)),
N AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, id) AS rank FROM D) z WHERE rank <= 5)"""


def nearest(spark: SparkSession, d: str, k: int = 5) -> DataFrame:
    """The flagship's core: top-k for the stated query set, held-out topics excluded beforehand."""
    index = X.vectors(spark, d)
    held = spark.createDataFrame([(x,) for x in HELD_OUT], "label long")
    return R.cosine_topk(index.where("id % 50 = 0").select(F.col("id").alias("qid"), "vector"), R.exclude(index, "label", held), k)


def documents_of(spark: SparkSession, d: str) -> DataFrame:
    """Each vector stands for the fact of the same number."""
    t = X.triples(spark, d)
    return t.select(F.col("tid").alias("id"), "subject", K.verbalise("fine").alias("document"))


FACTS = "K AS (SELECT tid AS id, subject, 'The ' || relation || ' of ' || subject || ' is ' || object || '.' AS document FROM T)"


@query(with_(NEAREST, X.TRIPLES, FACTS) + """
SELECT q.qid, coalesce(c.kept, 0) AS kept, c.kept IS NULL AS zero_shot, c.context FROM (SELECT DISTINCT qid FROM D) q LEFT JOIN
 (SELECT qid, count(*) AS kept, string_agg('[' || rank || '] ' || document, chr(10) ORDER BY rank) AS context FROM N JOIN K USING (id) WHERE distance <= 0.7 GROUP BY qid) c USING (qid)""")
def retrieve_context(spark: SparkSession, d: str) -> DataFrame:
    """Flagship: nearest facts without held-out topics, the distance gate, numbered context, fallback flag."""
    near = nearest(spark, d).where("distance <= 0.7").join(documents_of(spark, d), "id")
    queries = X.vectors(spark, d).where("id % 50 = 0").select(F.col("id").alias("qid"))
    context = R.numbered_context(near, "document")
    return R.gate(near, queries, 0.7).join(context, "qid", "left")


@query(with_(NEAREST) + "SELECT qid, id, rank, round(distance, 6) AS distance FROM N")
def cosine_topk_heldout(spark: SparkSession, d: str) -> DataFrame:
    return nearest(spark, d).select("qid", "id", "rank", F.round("distance", 6).alias("distance"))


@query("""WITH V AS (SELECT CAST(vec_id AS BIGINT) AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
SELECT * FROM (SELECT q.id AS qid, x.id, row_number() OVER (PARTITION BY q.id ORDER BY list_cosine_similarity(q.v, x.v) DESC, x.id) AS rank FROM V q, V x WHERE q.id % 50 = 0) z WHERE rank <= 5""")
def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    index = X.vectors(spark, d)
    return R.cosine_topk(index.where("id % 50 = 0").select(F.col("id").alias("qid"), "vector"), index, 5).select("qid", "id", "rank")


@query(with_(NEAREST) + """
SELECT t.threshold, round(avg(kept), 4) AS avg_kept, round(avg(CASE WHEN kept = 0 THEN 1.0 ELSE 0.0 END), 4) AS zero_share, count(*) AS n FROM
 (SELECT threshold, q.qid, count(N.id) AS kept FROM (VALUES (0.55), (0.6), (0.65), (0.7), (9.0)) v(threshold) CROSS JOIN (SELECT DISTINCT qid FROM D) q LEFT JOIN N ON N.qid = q.qid AND N.distance <= threshold GROUP BY ALL) t GROUP BY t.threshold""")
def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    thresholds = F.explode(F.array(*map(F.lit, (0.55, 0.60, 0.65, 0.70, 9.0)))).alias("threshold")
    near, queries = nearest(spark, d), X.vectors(spark, d).where("id % 50 = 0").select(F.col("id").alias("qid"))
    # every query keeps a row for each threshold, with hits or without
    hits = queries.join(near.groupBy("qid").agg(F.collect_list("distance").alias("distances")), "qid", "left").select("qid", "distances", thresholds)
    kept = F.coalesce(F.size(F.filter("distances", lambda x: x <= F.col("threshold"))), F.lit(0))
    return hits.withColumn("kept", F.greatest(kept, F.lit(0))).groupBy("threshold").agg(F.round(F.avg("kept"), 4).alias("avg_kept"), F.round(F.avg((F.col("kept") == 0).cast("double")), 4).alias("zero_share"), F.count(F.lit(1)).alias("n"))


@query(with_(NEAREST, X.TRIPLES, FACTS) + """,
H AS (SELECT qid, N.id, rank, subject, document FROM N JOIN K USING (id)),
O AS (SELECT DISTINCT qid, subject FROM H),
W AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY id) AS pos FROM (SELECT O.qid, K.id, K.document FROM O JOIN K USING (subject) WHERE NOT EXISTS (SELECT 1 FROM N WHERE N.qid = O.qid AND N.id = K.id)) z),
U AS (SELECT qid, document, 1 AS hop, rank AS pos FROM H UNION ALL SELECT qid, document, 2, pos FROM W WHERE pos <= 45),
Y AS (SELECT qid, document, min((hop, pos)) AS first FROM U GROUP BY qid, document)
SELECT qid, document, hop, rank FROM (SELECT qid, document, CAST(first[1] AS BIGINT) AS hop, row_number() OVER (PARTITION BY qid ORDER BY first, document) AS rank FROM Y) z WHERE rank <= 15""")
def two_hop_context(spark: SparkSession, d: str) -> DataFrame:
    near = nearest(spark, d).select("qid", "id", "rank")
    return R.two_hop(near, documents_of(spark, d), 15)


@query(with_(NEAREST, X.TRIPLES, FACTS) + r"""
SELECT qid, 'According to the available data, ' || string_agg(regexp_replace(regexp_replace(document, '^The ', 'the '), '\.+$', ''), '. ' ORDER BY rank) || '.' AS context FROM N JOIN K USING (id) GROUP BY qid""")
def prose_context(spark: SparkSession, d: str) -> DataFrame:
    return R.prose_context(nearest(spark, d).join(documents_of(spark, d), "id"), "document")


@query("""WITH C AS (SELECT i, avg(x) AS m FROM (SELECT unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings WHERE label IN (0, 3)) z GROUP BY i),
L AS (SELECT list(m ORDER BY i) AS v FROM C)
SELECT CAST(vec_id AS BIGINT) AS id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), v), 4) AS score FROM embeddings, L""")
def centroid_score(spark: SparkSession, d: str) -> DataFrame:
    index = X.vectors(spark, d)
    return R.centroid_scores(index, index.where(F.col("label").isin(*HELD_OUT)))


@query("""WITH C AS (SELECT i, avg(x) AS m FROM (SELECT unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings WHERE label IN (0, 3)) z GROUP BY i),
L AS (SELECT list(m ORDER BY i) AS v FROM C), Z AS (SELECT round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), v), 4) AS s FROM embeddings, L)
SELECT count(*) AS n, count(*) FILTER (s >= 0.1) AS passed, round(min(s), 4) AS low, round(max(s), 4) AS high, round(avg(s), 4) AS mean, round(quantile_cont(s, 0.25), 4) AS p25, round(quantile_cont(s, 0.5), 4) AS p50, round(quantile_cont(s, 0.75), 4) AS p75 FROM Z""")
def score_stats(spark: SparkSession, d: str) -> DataFrame:
    """Exact percentiles: they count equal scores together, and scores of four places have at most 20,001 values."""
    s = centroid_score(spark, d)
    p = lambda x: F.round(F.percentile("score", F.lit(x)), 4)
    return s.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("score") >= 0.1).alias("passed"), F.round(F.min("score"), 4).alias("low"), F.round(F.max("score"), 4).alias("high"), F.round(F.avg("score"), 4).alias("mean"), p(0.25).alias("p25"), p(0.5).alias("p50"), p(0.75).alias("p75"))


@query("""WITH C AS (SELECT i, avg(x) AS m FROM (SELECT unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings WHERE label IN (0, 3)) z GROUP BY i),
L AS (SELECT list(m ORDER BY i) AS v FROM C)
SELECT CAST(vec_id AS BIGINT) AS id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), v), 4) AS score FROM embeddings, L WHERE round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), v), 4) >= 0.05 ORDER BY score DESC, id LIMIT 20""")
def top_topics_cap(spark: SparkSession, d: str) -> DataFrame:
    return centroid_score(spark, d).where("score >= 0.05").orderBy(F.desc("score"), "id").limit(20)


@query("SELECT CAST(a.vec_id AS BIGINT) AS id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS cosine FROM embeddings a, embeddings b WHERE b.vec_id = 0")
def cosine_similarity(spark: SparkSession, d: str) -> DataFrame:
    index = X.vectors(spark, d)
    one = index.where("id = 0").select(F.col("vector").alias("w"))
    return index.join(F.broadcast(one)).select("id", F.round(cosine(F.col("vector"), F.col("w")), 6).alias("cosine"))


# text and triples
@query(with_(X.SENTENCES) + "SELECT id, sentence FROM SS")
def stat_sentence_filter(spark: SparkSession, d: str) -> DataFrame:
    return K.statistical_sentences(X.prose(spark, d), "text", "id").select("id", "sentence")


@query(with_(X.SENTENCES) + """, RN AS (SELECT topic, sentence, row_number() OVER (PARTITION BY topic ORDER BY id, pos) AS rn FROM SS)
SELECT topic, CAST(floor((rn - 1) / 5) AS BIGINT) AS batch, string_agg(sentence, chr(10) ORDER BY rn) AS sentences, count(*) AS n FROM RN WHERE rn <= 20 GROUP BY ALL""")
def sentence_batches(spark: SparkSession, d: str) -> DataFrame:
    rows = K.statistical_sentences(X.prose(spark, d), "text", "topic", "id")
    return K.sentence_batches(rows.withColumn("at", F.struct("id", "pos")), "topic", "at", "sentence")


@query(with_(X.SENTENCES) + """, C AS (SELECT id, count(*) FILTER (length(sentence) >= 50) AS sentence_count FROM SS GROUP BY id)
SELECT CAST(id AS VARCHAR) AS topic, sentence_count FROM C WHERE sentence_count > 0 AND id NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)""")
def work_list(spark: SparkSession, d: str) -> DataFrame:
    """Topics with statistical sentences that no earlier run has done."""
    text = X.prose(spark, d).select(F.col("id").cast("string").alias("topic"), F.size(F.filter(T.sentences(F.col("text")), T.is_statistical)).cast("long").alias("sentence_count"))
    done = X.table(spark, d, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").cast("string").alias("topic"))
    return K.work_list(text, done).select("topic", "sentence_count")


@query("SELECT CAST(row_number() OVER (ORDER BY doc_id) - 1 AS BIGINT) AS position, doc_id FROM documents ORDER BY doc_id LIMIT 20")
def first_in_order(spark: SparkSession, d: str) -> DataFrame:
    """The first so many in file order, which is what a limit on a run takes."""
    return files.positions(X.table(spark, d, "documents").select("doc_id"), "doc_id").where("position < 20").select("position", "doc_id")


@query(r"SELECT doc_id, t.token, round(TRY_CAST(regexp_replace(t.token, '[,%\s]', '', 'g') AS DOUBLE), 6) AS value FROM (SELECT doc_id, unnest(regexp_extract_all(text, '-?\d+(?:,\d{3})*(?:\.\d+)?(?:\s*%)?')) AS token FROM documents) t")
def extract_numbers_docs(spark: SparkSession, d: str) -> DataFrame:
    rows = X.table(spark, d, "documents").select("doc_id", F.explode(T.extract_numbers(F.col("text"))).alias("token"))
    return rows.withColumn("value", F.round(T.to_number(F.col("token")), 6))


@query(f"SELECT doc_id, {X.normal('text')} AS normalized FROM documents")
def normalize_strings(spark: SparkSession, d: str) -> DataFrame:
    return X.table(spark, d, "documents").select("doc_id", T.normalize_string(F.col("text")).alias("normalized"))


KEYS = f"Y AS (SELECT doc_id, text AS entity, {X.normal('text')} AS norm FROM documents)," + r"""
Z AS (SELECT *, regexp_replace(regexp_replace(lower(norm), '(^|[^\p{L}\p{M}\p{N}_])(the|a|an)($|[^\p{L}\p{M}\p{N}_])', '\1\3', 'g'), '(^|[^\p{L}\p{M}\p{N}_])(the|a|an)($|[^\p{L}\p{M}\p{N}_])', '\1\3', 'g') AS k FROM Y),
C AS (SELECT doc_id, entity, norm, trim(regexp_replace(regexp_replace(replace(k, '\'\'s', ''), '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g')) AS key FROM Z)""".replace("\\'\\'", "''")


@query(with_(KEYS) + "SELECT key, count(*) AS n, count(DISTINCT entity) AS variants FROM C GROUP BY key")
def canonical_key_groups(spark: SparkSession, d: str) -> DataFrame:
    """How many texts have each key, and in how many variants. Equal texts are counted together first, so each is
    normalised once, by the tasks of a shuffle, however few row groups there are."""
    texts = X.table(spark, d, "documents").groupBy("text").agg(F.count(F.lit(1)).alias("n"))
    return texts.groupBy(T.canonical_key(F.col("text")).alias("key")).agg(F.sum("n").alias("n"), F.count("text").alias("variants"))


VARIANTS = """
T AS (SELECT o_orderkey AS tid, CASE o_orderkey % 4 WHEN 0 THEN 'The ' || o_orderpriority || '.' WHEN 1 THEN lower(o_orderpriority) WHEN 2 THEN ' ' || o_orderpriority || '  ' ELSE o_orderpriority END AS subject,
             'HasNumericValue' AS relation, CAST(o_custkey % 50 AS VARCHAR) || ' units' AS object, o_orderstatus AS source_topic FROM orders)"""


def variants(spark: SparkSession, d: str) -> DataFrame:
    o, k = X.table(spark, d, "orders"), F.col("o_orderkey") % 4
    subject = F.when(k == 0, F.concat(F.lit("The "), "o_orderpriority", F.lit("."))).when(k == 1, F.lower("o_orderpriority")).when(k == 2, F.concat(F.lit(" "), "o_orderpriority", F.lit("  "))).otherwise(F.col("o_orderpriority"))
    return o.select(F.col("o_orderkey").alias("tid"), subject.alias("subject"), F.lit("HasNumericValue").alias("relation"), F.concat((F.col("o_custkey") % 50).cast("string"), F.lit(" units")).alias("object"), F.col("o_orderstatus").alias("source_topic"))


MAPPING = VARIANTS + r""",
Y AS (SELECT DISTINCT subject AS original, regexp_replace(trim(regexp_replace(subject, '\s+', ' ', 'g')), '\.+$', '') AS norm FROM T),
Z AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(lower(norm), '(^| )(the|a|an)($| )', '\1\3', 'g'), '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g')) AS key FROM Y),
N AS (SELECT original, first_value(norm) OVER (PARTITION BY key ORDER BY length(norm), norm) AS normalized FROM Z)"""


@query(with_(MAPPING) + "SELECT original, normalized FROM N WHERE original <> normalized")
def normalization_map(spark: SparkSession, d: str) -> DataFrame:
    return K.normalization_map(variants(spark, d))


@query(with_(MAPPING) + ", W AS (SELECT tid, coalesce(N.normalized, subject) AS subject, relation, object, source_topic FROM T LEFT JOIN N ON original = subject) SELECT subject, relation, object, min(tid) AS tid, min_by(source_topic, tid) AS source_topic FROM W GROUP BY subject, relation, object")
def normalize_rewrite_dedupe(spark: SparkSession, d: str) -> DataFrame:
    rows = variants(spark, d)
    return K.dedupe(K.rewrite(rows, K.normalization_map(rows)))


@query(with_(X.TRIPLES) + "SELECT subject, relation, object, min(tid) AS tid, min_by(source_topic, tid) AS source_topic FROM T GROUP BY subject, relation, object")
def dedupe_triples(spark: SparkSession, d: str) -> DataFrame:
    return K.dedupe(X.triples(spark, d))


@query("SELECT event_id, event_type AS relation, props AS object FROM events WHERE event_type IN ('click', 'view', 'purchase') AND regexp_matches(props, '[0-9]')")
def validate_triples(spark: SparkSession, d: str) -> DataFrame:
    raw = X.table(spark, d, "events").select("event_id", F.col("user_id").cast("string").alias("subject"), F.col("event_type").alias("relation"), F.col("props").alias("object"))
    vocabulary = spark.createDataFrame([("click",), ("view",), ("purchase",)], "relation string")
    return K.validate(raw, vocabulary).select("event_id", "relation", "object")


@query("""SELECT p_partkey, p_name AS subject, 'HasCapacity' AS relation, CAST(p_size AS VARCHAR) || ' units' AS object FROM part WHERE p_partkey % 6 IN (0, 1, 4)
UNION ALL SELECT p_partkey, p_name, 'HasPrice', CAST(p_size AS VARCHAR) FROM part WHERE p_partkey % 6 = 4""")
def parse_generated_triples(spark: SparkSession, d: str) -> DataFrame:
    """Fenced and plain arrays, text, a lone object, and an array with elements that are no triples."""
    own = F.concat(F.lit('{"subject": "'), "p_name", F.lit('", "relation": "HasCapacity", "object": "'), F.col("p_size").cast("string"), F.lit(' units"}'))
    other = F.concat(F.lit('{"object": '), F.col("p_size").cast("string"), F.lit(', "relation": "HasPrice", "subject": "'), "p_name", F.lit('", "more": [1]}'))
    k = F.col("p_partkey") % 6
    text = (
        F.when(k == 0, F.concat(F.lit("Here:\n```json\n["), own, F.lit("]\n```"))).when(k == 1, F.concat(F.lit("\u00a0["), own, F.lit("]\n"))).when(k == 2, "no triples [").when(k == 3, own)
        .when(k == 4, F.concat(F.lit('```\n[{"a": 1}, 7, null, "x", '), own, F.lit(', {"subject": "s", "relation": "r"}, '), other, F.lit("]"))).otherwise('{"a": 1}')
    )
    return K.parse_generated(X.table(spark, d, "part").select("p_partkey", text.alias("answer")), "answer", "p_partkey")


@query(with_(X.TRIPLES) + "SELECT tid, 'The ' || relation || ' of ' || subject || ' is ' || object || '.' AS fine, subject || ' - ' || relation || ': ' || object AS medium, subject || ': ' || relation || '=' || object AS coarse FROM T")
def verbalise(spark: SparkSession, d: str) -> DataFrame:
    return X.triples(spark, d).select("tid", *[K.verbalise(level).alias(level) for level in K.LEVELS])


@query(with_(X.TRIPLES) + "SELECT source_topic, source_topic || ': ' || string_agg(relation || ': ' || object, ' | ' ORDER BY tid) AS document, 'MULTI' AS relation, CAST(count(*) AS VARCHAR) AS triple_count FROM T GROUP BY source_topic")
def coarse_documents(spark: SparkSession, d: str) -> DataFrame:
    return K.coarse_documents(X.triples(spark, d))


@query("SELECT doc_id, CAST(i - 1 AS VARCHAR) AS chunk_idx, substr(trim(c), 1, 1024) AS chunk FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS c, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) z WHERE length(trim(c)) > 50")
def chunk_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return K.paragraph_chunks(X.table(spark, d, "documents"), "doc_id", "text", "\n")


@query(with_(X.TRIPLES) + "SELECT relation, count(*) AS n, count(DISTINCT subject) AS subjects FROM T GROUP BY relation")
def relation_counts(spark: SparkSession, d: str) -> DataFrame:
    return X.triples(spark, d).groupBy("relation").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("subject").alias("subjects"))


@query(with_(X.TRIPLES, X.STRUCTURAL) + "SELECT entity, count(*) AS n FROM (SELECT subject AS entity FROM T UNION ALL SELECT object FROM T UNION ALL SELECT subject FROM S UNION ALL SELECT object FROM S) z GROUP BY entity")
def entity_frequency(spark: SparkSession, d: str) -> DataFrame:
    both = X.triples(spark, d).unionByName(X.structural(spark, d))
    return both.select(F.explode(F.array("subject", "object")).alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("n"))


@query(with_(X.TRIPLES, X.STRUCTURAL) + "SELECT source, count(*) AS n, count(DISTINCT subject) AS subjects FROM (SELECT *, 'llm' AS source FROM T UNION ALL SELECT *, 'structural' FROM S) z GROUP BY source")
def union_by_source(spark: SparkSession, d: str) -> DataFrame:
    both = X.triples(spark, d).withColumn("source", F.lit("llm")).unionByName(X.structural(spark, d).withColumn("source", F.lit("structural")), allowMissingColumns=True)
    return both.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("subject").alias("subjects"))


LINKS = r"""
L AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="/([^"]*)"', 1)) AS link FROM pages),
O AS (SELECT DISTINCT page_id, 't' || CAST(page_id AS VARCHAR) AS topic FROM pages)"""


def links(spark: SparkSession, d: str) -> DataFrame:
    return X.table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a href="/([^"]*)"'), F.lit(1))).alias("link"))


@query(with_(LINKS) + ", W AS (SELECT lower(link) AS low, min(link) AS object FROM L GROUP BY ALL), Z AS (SELECT page_id, link, first_value(link) OVER (PARTITION BY page_id ORDER BY link) AS topic FROM L) SELECT DISTINCT topic AS subject, 'RelatedTo' AS relation, object, topic AS source_topic FROM Z JOIN W ON lower(link) = low WHERE lower(topic) <> low")
def structural_related_to(spark: SparkSession, d: str) -> DataFrame:
    found = links(spark, d)
    topics = found.select(F.col("link").alias("topic")).distinct()
    named = found.join(found.groupBy("page_id").agg(F.min("link").alias("topic")), "page_id")
    return K.related_topics(named.select("topic", "link"), topics)


@query(with_(X.STRUCTURAL) + "SELECT subject, relation, object, source_topic FROM S")
def structural_category(spark: SparkSession, d: str) -> DataFrame:
    return X.structural(spark, d).select("subject", "relation", "object", "source_topic")


@query("SELECT DISTINCT regexp_extract(url, '^https?://([^/]+)', 1) AS subject, 'Synonym' AS relation, regexp_replace(regexp_extract(url, '^https?://([^/]+)', 1), '^(www|m|blog)\\.', '') AS object FROM pages WHERE regexp_extract(url, '^https?://([^/]+)', 1) <> regexp_replace(regexp_extract(url, '^https?://([^/]+)', 1), '^(www|m|blog)\\.', '')".replace("\\\\", "\\"))
def structural_synonym(spark: SparkSession, d: str) -> DataFrame:
    host = F.regexp_extract("url", "^https?://([^/]+)", 1)
    rows = X.table(spark, d, "pages").select(host.alias("subject"), F.lit("Synonym").alias("relation"), F.regexp_replace(host, r"^(www|m|blog)\.", "").alias("object"))
    return rows.where("subject <> object").distinct()


@query("SELECT p_partkey, p_type, lower(p_type) LIKE '%econ%' OR lower(p_type) LIKE '%promo%' AS skipped FROM part")
def skip_category_filter(spark: SparkSession, d: str) -> DataFrame:
    return X.table(spark, d, "part").select("p_partkey", "p_type", T.contains_any(F.col("p_type"), ("econ", "promo")).alias("skipped"))


TREE = """
G AS (SELECT 'root' AS parent, r_name AS child FROM region UNION ALL SELECT r_name, n_name FROM nation JOIN region ON n_regionkey = r_regionkey
      UNION ALL SELECT n_name, c_name FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT n_name, s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT r_name, 'root' FROM region)"""


def tree(spark: SparkSession, d: str) -> DataFrame:
    region, nation = X.table(spark, d, "region"), X.table(spark, d, "nation")
    parts = [region.select(F.lit("root").alias("parent"), F.col("r_name").alias("child")), nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", "n_name")]
    for name, key, child in (("customer", "c_nationkey", "c_name"), ("supplier", "s_nationkey", "s_name")):
        parts.append(X.table(spark, d, name).join(F.broadcast(nation), F.col(key) == F.col("n_nationkey")).select("n_name", child))
    parts.append(region.select("r_name", F.lit("root")))  # a cycle
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


@query(with_(TREE) + "SELECT child AS node, CAST(1 AS BIGINT) AS depth FROM G WHERE parent = 'root' UNION ALL SELECT 'root', 0 UNION ALL SELECT n_name, 2 FROM nation UNION ALL SELECT c_name, 3 FROM customer UNION ALL SELECT s_name, 3 FROM supplier")
def bfs_depth(spark: SparkSession, d: str) -> DataFrame:
    return G.breadth_first(tree(spark, d), spark.createDataFrame([("root",)], "node string"), 4)


@query("SELECT l_partkey, min_by(l_orderkey, (l_shipdate, l_orderkey, l_linenumber)) AS first_order FROM lineitem GROUP BY l_partkey")
def crawl_first_wins(spark: SparkSession, d: str) -> DataFrame:
    return X.table(spark, d, "lineitem").groupBy("l_partkey").agg(F.min_by("l_orderkey", F.struct("l_shipdate", "l_orderkey", "l_linenumber")).alias("first_order"))


# graphs
EDGES = "G AS (SELECT p_partkey AS o, p_name AS src, p_brand AS dst, p_type AS relation FROM part)"


def edges(spark: SparkSession, d: str) -> DataFrame:
    return X.table(spark, d, "part").select(F.col("p_partkey").alias("o"), F.col("p_name").alias("src"), F.col("p_brand").alias("dst"), F.col("p_type").alias("relation"))


@query(with_(EDGES) + "SELECT least(src, dst) AS src, greatest(src, dst) AS dst, max_by(relation, o) AS relation, count(*) AS n FROM G GROUP BY least(src, dst), greatest(src, dst)")
def bipartite_edges(spark: SparkSession, d: str) -> DataFrame:
    return G.collapse_edges(edges(spark, d), "o")


VOTES = """, X AS (SELECT DISTINCT src, dst FROM (SELECT src, dst FROM G UNION ALL SELECT dst, src FROM G) z WHERE src <> dst),
L0 AS (SELECT DISTINCT src AS node, src AS c FROM X),
L1 AS (SELECT src AS node, c FROM (SELECT src, c, row_number() OVER (PARTITION BY src ORDER BY count(*) DESC, c) AS r FROM X JOIN L0 ON dst = node GROUP BY src, c) z WHERE r = 1),
L2 AS (SELECT src AS node, c AS community FROM (SELECT src, c, row_number() OVER (PARTITION BY src ORDER BY count(*) DESC, c) AS r FROM X JOIN L1 ON dst = node GROUP BY src, c) z WHERE r = 1)"""
ALL_EDGES = """G AS (SELECT DISTINCT 'c' || o_custkey AS src, 'o' || o_orderkey AS dst FROM orders
UNION SELECT 'c' || c_custkey, 'n' || c_nationkey || c_mktsegment FROM customer)"""


def all_edges(spark: SparkSession, d: str) -> DataFrame:
    """Customers with their orders, and with their nation's segment."""
    s = lambda c, p: F.concat(F.lit(p), F.col(c).cast("string"))
    customer = X.table(spark, d, "customer").select(s("c_custkey", "c").alias("src"), F.concat(s("c_nationkey", "n"), "c_mktsegment").alias("dst"))
    return X.table(spark, d, "orders").select(s("o_custkey", "c").alias("src"), s("o_orderkey", "o").alias("dst")).unionByName(customer).distinct()


@query(with_(ALL_EDGES) + VOTES + "SELECT node, community FROM L2")
def community_labels(spark: SparkSession, d: str) -> DataFrame:
    return G.propagate_labels(all_edges(spark, d), 2)


@query(with_(ALL_EDGES) + VOTES + """, J AS (SELECT a.community AS c, b.community AS e FROM X JOIN L2 a ON X.src = a.node JOIN L2 b ON X.dst = b.node),
U AS (SELECT c, count(*) AS total, count(*) FILTER (c = e) AS inside FROM J GROUP BY c)
SELECT round(sum(inside) * 1.0 / sum(total) - sum(total * total) * 1.0 / (sum(total) * sum(total)), 6) AS modularity FROM U""")
def modularity_score(spark: SparkSession, d: str) -> DataFrame:
    edges_ = all_edges(spark, d)
    return G.modularity(G.weighted(edges_), G.propagate_labels(edges_, 2)).select(F.round("modularity", 6).alias("modularity"))


@query()
def modularity_communities(spark: SparkSession, d: str) -> DataFrame:
    return G.modularity_communities(all_edges(spark, d))


@query(with_(ALL_EDGES) + VOTES + "SELECT community, count(*) AS size, string_agg(node, '; ' ORDER BY node) FILTER (r <= 20) AS members FROM (SELECT *, row_number() OVER (PARTITION BY community ORDER BY node) AS r FROM L2) z GROUP BY community")
def community_members(spark: SparkSession, d: str) -> DataFrame:
    return G.community_table(G.propagate_labels(all_edges(spark, d), 2))


@query(with_(X.TRIPLES) + """, W AS (SELECT subject, tid, CASE WHEN row_number() OVER w = 1 THEN subject || ' (' || relation || ': ' || object || ')' ELSE '; ' || relation || ': ' || object END AS piece FROM T WINDOW w AS (PARTITION BY subject ORDER BY tid)),
Z AS (SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY subject ORDER BY tid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM W)
SELECT subject AS entity, string_agg(piece, '' ORDER BY tid) AS description FROM Z WHERE before < 500 GROUP BY subject""")
def custom_kg_entities(spark: SparkSession, d: str) -> DataFrame:
    return G.entity_descriptions(X.triples(spark, d))


@query(with_(X.TRIPLES, X.STRUCTURAL) + "SELECT subject AS src, source_topic AS dst, subject || ' ' || relation || ' ' || object AS description, relation || ' ' || source_topic AS keywords, CAST(1.0 AS DOUBLE) AS weight FROM T UNION ALL SELECT subject, object, subject || ' is related to ' || object, relation || ' ' || source_topic, 0.5 FROM S")
def custom_kg_relationships(spark: SparkSession, d: str) -> DataFrame:
    return G.relationships(X.triples(spark, d), X.structural(spark, d))


@query("SELECT entity, unit, rank FROM (SELECT l_partkey AS entity, l_orderkey AS unit, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey) AS rank FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) z) y WHERE rank <= 3")
def array_membership_facts(spark: SparkSession, d: str) -> DataFrame:
    units = X.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("unit")).agg(F.collect_set("l_partkey").alias("entity_ids")).withColumn("text", F.lit(""))
    entities = X.table(spark, d, "lineitem").select(F.col("l_partkey").alias("entity"))
    return G.membership_facts(entities, units).select("entity", "unit", "rank")


@query(with_(X.TRIPLES) + """, C AS (SELECT DISTINCT p_brand AS node, length(p_brand) AS community FROM part),
A AS (SELECT *, row_number() OVER (PARTITION BY community ORDER BY node) AS m FROM C), B AS (SELECT *, row_number() OVER (PARTITION BY source_topic ORDER BY tid) AS t FROM T),
Z AS (SELECT community, row_number() OVER (PARTITION BY community ORDER BY m, t) AS rank, '- ' || subject || ' ' || relation || ' ' || object AS fact FROM A JOIN B ON node = source_topic WHERE m <= 10 AND t <= 3)
SELECT CAST(community AS BIGINT) AS community, rank, fact FROM Z WHERE rank <= 15""")
def community_facts(spark: SparkSession, d: str) -> DataFrame:
    members = X.table(spark, d, "part").select(F.col("p_brand").alias("node"), F.length("p_brand").cast("long").alias("community")).distinct()
    return G.community_facts(members, X.triples(spark, d))


# evaluation
@query(with_(X.SCORED) + "SELECT rid, CAST(nem AS DOUBLE) AS nem, round(nf1, 6) AS nf1, round(fp, 6) AS fp, CASE WHEN contains(answer, gold_numbers[1]) THEN 1.0 ELSE 0.0 END AS substring_nem FROM F")
def answer_metrics(spark: SparkSession, d: str) -> DataFrame:
    a, g = F.col("answer"), F.col("gold_numbers")
    return scored(spark, d).select("rid", M.nem(a, g).alias("nem"), F.round(M.nf1(a, g), 6).alias("nf1"), F.round(M.fp(a, g), 6).alias("fp"), M.substring_nem(a, g).alias("substring_nem"))


@query(with_(X.SCORED) + """, Z AS (SELECT *, row_number() OVER (PARTITION BY model, method ORDER BY latency_ms) - 1 AS i, count(*) OVER (PARTITION BY model, method) AS c FROM F)
SELECT model, method, count(*) AS n_evaluated, round(avg(nem), 6) AS nem, round(avg(nf1), 6) AS nf1, round(avg(fp), 6) AS fp, round(avg(latency_ms), 4) AS latency_mean_ms, max(latency_ms) FILTER (i = floor(0.95 * c)) AS latency_p95_ms, round(avg(nullif(tokens, 0)), 4) AS tokens_mean FROM Z GROUP BY model, method""")
def evaluate_summary(spark: SparkSession, d: str) -> DataFrame:
    return E.summary(scored(spark, d), "model", "method")


@query(with_(X.SCORED) + "SELECT coalesce(relation, 'OVERALL') AS relation, count(*) AS n, CAST(sum(nem) AS BIGINT) AS correct, round(avg(nem), 6) AS accuracy FROM F GROUP BY ROLLUP (relation)")
def per_relation_rollup(spark: SparkSession, d: str) -> DataFrame:
    return E.by_relation(scored(spark, d))


@query(with_(X.SCORED) + """, Z AS (SELECT CASE WHEN nem >= 1 THEN 'correct' WHEN NOT list_has_any(gold_numbers, regexp_extract_all(array_to_string(retrieved, ' '), '-?\\d+(?:,\\d{3})*(?:\\.\\d+)?(?:\\s*%)?')) THEN 'retrieval_failure' WHEN len(pred) = 0 THEN 'injection_failure' ELSE 'hallucination_despite_injection' END AS category FROM F)
SELECT category, count(*) AS n, round(count(*) * 1.0 / (SELECT count(*) FROM R), 6) AS fraction FROM Z GROUP BY category""")
def error_taxonomy(spark: SparkSession, d: str) -> DataFrame:
    return E.error_taxonomy(X.results(spark, d), X.benchmark(spark, d))


@query(with_(X.SCORED) + """, M2 AS (SELECT F.*, CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN 't_' || p_partkey || ' ' || p_name || ' HasMaxValue ' || g || ' USD ' || p_brand WHEN 2 THEN 't_' || p_partkey || ' ' || p_name || ' HasCapacity ' || p_size || ' units ' || p_brand
 ELSE 't_' || p_partkey || ' ' || p_name || ' HasCapacity ' || p_size || ' units ' || p_brand || ' priced at ' || g END AS seen FROM F JOIN (SELECT *, CAST(floor(p_retailprice) AS BIGINT) AS g FROM part) x ON F.rid // 3 = p_partkey),
Z AS (SELECT CASE WHEN nem >= 1 THEN 'correct' WHEN NOT list_has_any(gold_numbers, regexp_extract_all(seen, '-?\\d+(?:,\\d{3})*(?:\\.\\d+)?(?:\\s*%)?')) THEN 'retrieval_failure' WHEN len(pred) = 0 THEN 'injection_failure' ELSE 'hallucination_despite_injection' END AS category FROM M2)
SELECT category, count(*) AS n, round(count(*) * 1.0 / (SELECT count(*) FROM R), 6) AS fraction FROM Z GROUP BY category""")
def error_taxonomy_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Retrieved facts with all their metadata; for a quarter of the questions the gold stands only in the topic's name."""
    part, k = X.table(spark, d, "part"), F.col("p_partkey") % 4
    fact = lambda relation, value, topic: F.struct(F.concat(F.lit("t_"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("subject"), F.lit(relation).alias("relation"), value.alias("object"), topic.alias("source_topic"))
    cost, size, brand = F.concat(X.price().cast("string"), F.lit(" USD")), F.concat(F.col("p_size").cast("string"), F.lit(" units")), F.col("p_brand")
    priced = F.concat("p_brand", F.lit(" priced at "), X.price().cast("string"))
    found = F.when(k == 1, F.array(fact("HasMaxValue", cost, brand))).when(k == 2, F.array(fact("HasCapacity", size, brand))).when(k == 3, F.array(fact("HasCapacity", size, priced)))
    results = X.results(spark, d).drop("retrieved").withColumn("p_partkey", F.floor(F.col("rid") / 3)).join(part.select("p_partkey", found.alias("retrieved")), "p_partkey")
    return E.error_taxonomy(results.drop("p_partkey"), X.benchmark(spark, d))


ATTRIBUTED = X.SCORED + """, Z AS (SELECT *, """ + X.NUMS.format("retrieved[1]") + " AS n1, " + X.NUMS.format("retrieved[2]") + """ AS n2 FROM F),
Y AS (SELECT *, coalesce(len(list_intersect(list_distinct(n1), list_distinct(pred))), 0) AS o1, coalesce(len(list_intersect(list_distinct(n2), list_distinct(pred))), 0) AS o2 FROM Z),
GR AS (SELECT rid, model, method, question, error, retrieved, CASE WHEN o1 > 0 AND o1 >= o2 THEN 0 WHEN o2 > 0 THEN 1 END AS best_rank, greatest(o1, o2) AS overlap, CASE WHEN list_contains(n1, gold[1]) THEN 0 WHEN list_contains(n2, gold[1]) THEN 1 END AS gold_rank FROM Y)"""


@query(with_(ATTRIBUTED) + "SELECT model, method, question, CAST(best_rank AS BIGINT) AS best_rank, CAST(overlap AS BIGINT) AS overlap, CAST(gold_rank AS BIGINT) AS gold_rank FROM GR")
def attribution_rank(spark: SparkSession, d: str) -> DataFrame:
    return E.attribution(scored(spark, d))


@query(with_(ATTRIBUTED) + """SELECT method, count(*) AS total, count(*) FILTER (len(retrieved) > 0) AS has_triples, round(100.0 * count(best_rank) / count(*) FILTER (len(retrieved) > 0), 1) AS attributed_pct,
round(100.0 * count(gold_rank) / count(*) FILTER (len(retrieved) > 0), 1) AS gold_in_context_pct, round(avg(best_rank), 2) AS mean_rank, round(100.0 * count(*) FILTER (best_rank = 0) / count(best_rank), 1) AS rank_1_pct,
round(100.0 * count(*) FILTER (best_rank < 3) / count(best_rank), 1) AS rank_top3_pct FROM GR WHERE error IS NULL GROUP BY method""")
def attribution_summary(spark: SparkSession, d: str) -> DataFrame:
    return E.attribution_summary(scored(spark, d), "method")


@query(with_(X.SCORED) + "SELECT relation, nth, substr(question, 1, 100) AS question, gold_numbers[1] AS gold, substr(answer, 1, 150) AS answer, CAST(nem AS DOUBLE) AS nem FROM (SELECT *, row_number() OVER (PARTITION BY relation ORDER BY rid) AS nth FROM F) z WHERE nth <= 3")
def relation_examples(spark: SparkSession, d: str) -> DataFrame:
    return E.relation_examples(scored(spark, d), "rid")


@query(with_(X.SCORED) + """, Z AS (SELECT model, method, CAST(tolerance AS DOUBLE) AS tolerance, avg(CASE WHEN len(list_filter(pred, lambda p: abs(p - gold[1]) / gold[1] <= CAST(tolerance AS DOUBLE))) > 0 THEN 1.0 ELSE 0.0 END) AS nem FROM F, (VALUES (0.005), (0.01), (0.02), (0.05)) v(tolerance) GROUP BY ALL)
SELECT method, tolerance, round(avg(nem), 6) AS nem FROM Z GROUP BY ALL""")
def tolerance_sweep(spark: SparkSession, d: str) -> DataFrame:
    return E.tolerance_sweep(scored(spark, d))


@query(with_(X.SCORED) + "SELECT model, question, CAST(max(nem) FILTER (method = 'kg') AS INT) AS kg, CAST(max(nem) FILTER (method = 'rag') AS INT) AS rag FROM F WHERE error IS NULL GROUP BY ALL HAVING count(*) FILTER (method = 'kg') > 0 AND count(*) FILTER (method = 'rag') > 0")
def align_scores(spark: SparkSession, d: str) -> DataFrame:
    return E.aligned(E.score_vectors(scored(spark, d), "rid"), ["kg", "rag"])


PAIRS = X.SCORED + """, W AS (SELECT a.model, a.nem AS x, b.nem AS y FROM F a JOIN F b USING (model, question) WHERE a.method = 'kg' AND b.method = 'rag' AND a.error IS NULL AND b.error IS NULL),
C AS (SELECT model, count(*) FILTER (x = 1 AND y = 1) AS n11, count(*) FILTER (x = 1 AND y = 0) AS n10, count(*) FILTER (x = 0 AND y = 1) AS n01, count(*) FILTER (x = 0 AND y = 0) AS n00 FROM W GROUP BY model),
PV AS (SELECT *, CASE WHEN n10 + n01 = 0 THEN 1.0 ELSE least(1.0, 2 * (SELECT sum(exp(lgamma(n10 + n01 + 1) - lgamma(i + 1) - lgamma(n10 + n01 - i + 1) + (n10 + n01) * ln(0.5))) FROM (SELECT unnest(range(0, 100000)) AS i) r WHERE i <= least(n10, n01))) END AS p FROM C)"""


def pairs(spark: SparkSession, d: str) -> DataFrame:
    return E.paired(E.score_vectors(scored(spark, d), "rid"), "kg", "rag")


@query(with_(PAIRS) + "SELECT model, n11, n10, n01, n00, round(p, 5) AS p FROM PV")
def mcnemar(spark: SparkSession, d: str) -> DataFrame:
    return S.mcnemar(pairs(spark, d), "model")


@query(with_(PAIRS) + "SELECT model, round(p, 5) AS p, round(0.05 / count(*) OVER (), 6) AS alpha, round(p, 5) < 0.05 / count(*) OVER () AS significant, CASE WHEN round(p, 5) < 0.001 THEN '***' WHEN round(p, 5) < 0.01 THEN '**' WHEN round(p, 5) < 0.05 THEN '*' ELSE '' END AS stars FROM PV")
def bonferroni(spark: SparkSession, d: str) -> DataFrame:
    return S.bonferroni(S.mcnemar(pairs(spark, d), "model").select("model", "p"))


@query()
def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    return S.paired_bootstrap(pairs(spark, d), ["model"])


CONTRASTS = {"recovery": ("kg", "zero"), "algorithm": ("kg", "rag"), "parity": ("rag", "zero")}
EXACT_P = "CASE WHEN n10 + n01 = 0 THEN 1.0 ELSE least(1.0, 2 * (SELECT sum(exp(lgamma(n10 + n01 + 1) - lgamma(i + 1) - lgamma(n10 + n01 - i + 1) + (n10 + n01) * ln(0.5))) FROM (SELECT unnest(range(0, 100000)) AS i) r WHERE i <= least(n10, n01))) END"


@query(with_(X.SCORED) + f""", W AS (SELECT contrast, a.nem AS x, b.nem AS y FROM (VALUES ('recovery', 'kg', 'zero'), ('algorithm', 'kg', 'rag'), ('parity', 'rag', 'zero')) v(contrast, m1, m2) JOIN F a ON a.method = m1 JOIN F b ON b.method = m2 AND b.model = a.model AND b.question = a.question WHERE a.error IS NULL AND b.error IS NULL),
C AS (SELECT contrast, count(*) FILTER (x = 1 AND y = 1) AS n11, count(*) FILTER (x = 1 AND y = 0) AS n10, count(*) FILTER (x = 0 AND y = 1) AS n01, count(*) FILTER (x = 0 AND y = 0) AS n00 FROM W GROUP BY contrast)
SELECT contrast, n11, n10, n01, n00, round({EXACT_P}, 5) AS p, round((n10 - n01) * 1.0 / (n11 + n10 + n01 + n00), 6) AS delta FROM C""")
def pooled_contrasts(spark: SparkSession, d: str) -> DataFrame:
    return S.contrasts(E.score_vectors(scored(spark, d), "rid"), CONTRASTS)


@query(with_(X.TRIPLES) + r"""SELECT text AS title, count(*) AS n FROM (SELECT subject AS text FROM T UNION ALL SELECT object FROM T) z
WHERE length(text) > 3 AND length(text) < 200 AND NOT regexp_matches(text, '^[\d\s.,%$€£-]+$') AND NOT regexp_matches(text, '^\d') GROUP BY text""")
def title_candidates(spark: SparkSession, d: str) -> DataFrame:
    t = X.triples(spark, d)
    texts = t.select(F.explode(F.array("subject", "object")).alias("title"))
    return texts.where(T.title_candidate(F.col("title"))).groupBy("title").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH V AS (SELECT CAST(vec_id AS BIGINT) AS id, CAST(label AS BIGINT) AS label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
D AS (SELECT q.id AS qid, x.id, 1 - list_cosine_similarity(q.v, x.v) AS distance FROM V q, V x WHERE q.id % 50 = 0 AND (x.label = 1 OR (x.label <> 2 AND x.id % 2 = 0)))
SELECT qid, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, id) AS rank FROM D) z WHERE rank <= 5""")
def metadata_filter_topk(spark: SparkSession, d: str) -> DataFrame:
    index = X.vectors(spark, d)
    queries_ = index.where("id % 50 = 0").select(F.col("id").alias("qid"), "vector")
    where = {"$or": [{"label": 1}, {"$and": [{"label": {"$nin": [2]}}, {"parity": 0}]}]}
    allowed = index.withColumn("parity", F.col("id") % 2).where(R.metadata_condition(where)).select("id", "vector")
    return R.cosine_topk(queries_, allowed, 5).select("qid", "id", "rank")


@query(with_(NEAREST, X.TRIPLES, FACTS) + r""", C AS (SELECT qid, string_agg('[' || rank || '] ' || document, chr(10) ORDER BY rank) AS structured, 'According to the available data, ' || string_agg(regexp_replace(regexp_replace(document, '^The ', 'the '), '\.+$', ''), '. ' ORDER BY rank) || '.' AS prose FROM N JOIN K USING (id) GROUP BY qid)
SELECT format, count(*) AS n, round(avg(length(context)), 4) AS mean_chars FROM (SELECT 'structured' AS format, structured AS context FROM C UNION ALL SELECT 'prose', prose FROM C) z GROUP BY format""")
def format_ablation(spark: SparkSession, d: str) -> DataFrame:
    hits = nearest(spark, d).join(documents_of(spark, d), "id")
    forms = R.numbered_context(hits, "document").select(F.lit("structured").alias("format"), "context").unionByName(R.prose_context(hits, "document").select(F.lit("prose").alias("format"), "context"))
    return forms.groupBy("format").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.length("context")), 4).alias("mean_chars"))


@query("""WITH N AS (SELECT quality AS a, toxic AS b FROM labels), C AS (SELECT a, b, count(*) AS n FROM N GROUP BY ALL),
Z AS (SELECT (SELECT count(*) FROM N) AS n, (SELECT sum(n) FROM C WHERE a = b) * 1.0 / (SELECT count(*) FROM N) AS po, (SELECT sum(x * y) FROM (SELECT a, sum(n) AS x FROM C GROUP BY a) r JOIN (SELECT b, sum(n) AS y FROM C GROUP BY b) s ON a = b) * 1.0 / (SELECT count(*) * count(*) FROM N) AS pe)
SELECT n, round(po, 6) AS agreement, round(pe, 6) AS expected, round((po - pe) / (1 - pe), 6) AS kappa, CASE WHEN (po - pe) / (1 - pe) >= 0.81 THEN 'Almost perfect' WHEN (po - pe) / (1 - pe) >= 0.61 THEN 'Substantial' WHEN (po - pe) / (1 - pe) >= 0.41 THEN 'Moderate' WHEN (po - pe) / (1 - pe) >= 0.21 THEN 'Fair' ELSE 'Slight/Poor' END AS interpretation FROM Z""")
def kappa(spark: SparkSession, d: str) -> DataFrame:
    return S.kappa(X.table(spark, d, "labels"), "quality", "toxic")


RATED = """
AB AS (SELECT p_partkey AS sample_id, p_partkey % 3 AS qa, p_size % 3 AS ca FROM part WHERE p_size > 5), BB AS (SELECT p_partkey AS sample_id, (p_partkey + p_size) % 3 AS qb, p_size % 2 + 1 AS cb FROM part WHERE p_type <> 'ECONOMY'),
W AS (SELECT * FROM AB JOIN BB USING (sample_id))"""


def rated(spark: SparkSession, d: str) -> DataFrame:
    """Two annotators, who did not rate the same samples all."""
    part, k, n = X.table(spark, d, "part"), F.col("p_partkey"), F.col("p_size")
    one = part.where("p_size > 5").select(k.alias("sample_id"), (k % 3).alias("quality"), (n % 3).alias("correct"))
    two = part.where("p_type <> 'ECONOMY'").select(k.alias("sample_id"), ((k + n) % 3).alias("quality"), (n % 2 + 1).alias("correct"))
    return S.both_annotators(one, two, "quality", "correct")


@query(with_(RATED) + "SELECT count(*) AS n, count(*) FILTER ((qa + qb) / 2.0 >= 1.5) AS good, count(*) FILTER ((qa + qb) / 2.0 >= 0.5 AND (qa + qb) / 2.0 < 1.5) AS fair, count(*) FILTER ((qa + qb) / 2.0 < 0.5) AS bad, count(*) FILTER (qa = 2 AND qb = 2) AS strict, count(*) FILTER (abs(qa - qb) >= 2) AS disagreements FROM W")
def annotation_buckets(spark: SparkSession, d: str) -> DataFrame:
    return S.annotation_buckets(rated(spark, d), "quality_a", "quality_b")


@query(with_(RATED) + "SELECT count(*) AS n, round(100 * avg(CASE WHEN (qa + qb) / 2.0 >= 1.5 AND (ca + cb) / 2.0 >= 1.5 THEN 1.0 ELSE 0.0 END), 1) AS valid_pct FROM W")
def annotation_validity(spark: SparkSession, d: str) -> DataFrame:
    return S.validity(rated(spark, d), "quality", "correct")


@query(with_(RATED) + "SELECT sample_id, qa AS a, qb AS b FROM W WHERE abs(qa - qb) >= 2 ORDER BY sample_id LIMIT 20")
def disagreements(spark: SparkSession, d: str) -> DataFrame:
    return S.disagreements(rated(spark, d), "quality").orderBy("sample_id").limit(20)


@query(with_(X.SCORED) + "SELECT method, passes, round(avg(nem), 6) AS nem, round(avg(latency_ms), 4) AS latency, round(avg(nullif(tokens, 0)), 4) AS tokens FROM F JOIN (VALUES ('kg', 1), ('rag', 3), ('zero', 4)) v(method, passes) USING (method) GROUP BY ALL")
def pareto_table(spark: SparkSession, d: str) -> DataFrame:
    passes = spark.createDataFrame([("kg", 1), ("rag", 3), ("zero", 4)], "method string, passes int")
    rows = scored(spark, d).withColumn("nem", M.nem(F.col("answer"), F.col("gold_numbers"))).join(F.broadcast(passes), "method")
    return rows.groupBy("method", "passes").agg(F.round(F.avg("nem"), 6).alias("nem"), F.round(F.avg("latency_ms"), 4).alias("latency"), F.round(F.avg(F.nullif("tokens", F.lit(0))), 4).alias("tokens")).orderBy(F.desc("nem"))


SOLD = """P AS (SELECT l_partkey AS part, count(*) AS n, CAST(round(sum(l_extendedprice) / sum(l_quantity) * 100) AS BIGINT) AS unit_cents, CAST(sum(l_quantity) AS BIGINT) AS quantity, CAST(round(sum(l_discount) * 100) AS BIGINT) AS discounts FROM lineitem GROUP BY ALL)"""


@query(with_(SOLD) + """SELECT * FROM P WHERE NOT EXISTS (SELECT 1 FROM P q WHERE q.unit_cents <= P.unit_cents AND q.quantity >= P.quantity AND q.discounts <= P.discounts AND
 (q.unit_cents < P.unit_cents OR q.quantity > P.quantity OR q.discounts < P.discounts))""")
def pareto_front(spark: SparkSession, d: str) -> DataFrame:
    """Parts that no other part beats in price, quantity sold and discounts given, over all items."""
    cents = lambda x: F.round(x * 100).cast("long")
    sold = X.table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("part")).agg(F.count(F.lit(1)).alias("n"), cents(F.sum("l_extendedprice") / F.sum("l_quantity")).alias("unit_cents"), F.sum("l_quantity").cast("long").alias("quantity"), cents(F.sum("l_discount")).alias("discounts"))
    return Y.pareto_front(sold, ["unit_cents", "discounts"], ["quantity"])


@query(with_(X.BENCHMARK) + ", Z AS (SELECT *, row_number() OVER (PARTITION BY relation ORDER BY md5('42:' || CAST(id AS VARCHAR)), id) AS rn FROM B) SELECT id, relation FROM (SELECT * FROM Z ORDER BY CASE WHEN rn > 33 THEN 1 ELSE 0 END, md5('42:' || CAST(id AS VARCHAR)), id LIMIT 100) y")
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    return E.stratified_sample(X.benchmark(spark, d), "relation", "id", 100, 42).select("id", "relation")


@query(with_(X.TRIPLES) + r""", Z AS (SELECT *, row_number() OVER (PARTITION BY relation ORDER BY md5('42:' || CAST(tid AS VARCHAR)), tid) AS rn FROM T WHERE regexp_matches(object, '[0-9]')),
Y AS (SELECT * FROM Z ORDER BY CASE WHEN rn > 50 THEN 1 ELSE 0 END, md5('42:' || CAST(tid AS VARCHAR)), tid LIMIT 100)
SELECT row_number() OVER (ORDER BY md5('order42:' || CAST(tid AS VARCHAR)), tid) - 1 AS id, 'What is the ' || relation || ' of ' || subject || '?' AS question, subject, relation, object, regexp_extract(object, '^[0-9]+') AS gold, source_topic FROM Y""")
def generated_benchmark(spark: SparkSession, d: str) -> DataFrame:
    """Sampled facts with figures, a question for each, in a seeded order."""
    out = B.build(X.triples(spark, d), 100, 42, B.template_questions(), shared_path(spark, "benchmark-"))
    return out.withColumn("gold", F.array_join("gold_numbers", ", ")).drop("gold_numbers")


@query(with_(X.BENCHMARK) + "SELECT relation, count(*) AS n, count(DISTINCT source_topic) AS topics FROM B GROUP BY relation")
def benchmark_stats(spark: SparkSession, d: str) -> DataFrame:
    return X.benchmark(spark, d).groupBy("relation").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source_topic").alias("topics"))


@query(with_(X.BENCHMARK) + "SELECT DISTINCT source_topic AS topic FROM B WHERE source_topic <> '' ORDER BY topic")
def heldout_topics(spark: SparkSession, d: str) -> DataFrame:
    return X.benchmark(spark, d).where("source_topic <> ''").select(F.col("source_topic").alias("topic")).distinct().orderBy("topic")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def resume_antijoin(spark: SparkSession, d: str) -> DataFrame:
    return X.table(spark, d, "orders").select("o_orderkey").join(X.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti")


@query(with_(X.RESULTS) + "SELECT model, method, count(*) AS n FROM R WHERE error IS NULL GROUP BY ALL")
def error_purge(spark: SparkSession, d: str) -> DataFrame:
    return X.results(spark, d).where("error is null").groupBy("model", "method").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT f AS file, regexp_extract(f, '^(.*)_([^_]+)[.]jsonl$', 1) AS method, regexp_extract(f, '^(.*)_([^_]+)[.]jsonl$', 2) AS model FROM (SELECT 'kg_' || event_type || '_m' || (user_id % 3) || '.jsonl' AS f FROM events) z")
def results_filename_parse(spark: SparkSession, d: str) -> DataFrame:
    f = F.concat(F.lit("kg_"), "event_type", F.lit("_m"), (F.col("user_id") % 3).cast("string"), F.lit(".jsonl"))
    part = lambda i: F.regexp_extract("file", "^(.*)_([^_]+)[.]jsonl$", i)
    return X.table(spark, d, "events").select(f.alias("file")).distinct().select("file", part(1).alias("method"), part(2).alias("model"))


@query("SELECT item_id, min(doc_id) AS doc_id, count(*) AS n FROM benchmark b JOIN documents d ON contains(d.text, b.text) WHERE b.text <> '' GROUP BY item_id")
def containment_match(spark: SparkSession, d: str) -> DataFrame:
    """Items that stand whole in a document."""
    items = X.table(spark, d, "benchmark").select("item_id", F.col("text").alias("passage"))
    docs = X.table(spark, d, "documents").select("doc_id", "text")
    return I.containment(items, docs, "item_id", "passage", "doc_id", "text").groupBy("item_id").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))


@query("""WITH N AS (SELECT item_id, n, array_to_string(string_split(text, ' ')[2:1 + n], ' ') AS needle FROM benchmark, (VALUES (1), (2), (3), (4)) v(n))
SELECT item_id, n, count(*) AS texts FROM N JOIN documents d ON contains(d.text, needle) WHERE needle <> '' GROUP BY item_id, n""")
def short_containment(spark: SparkSession, d: str) -> DataFrame:
    """Needles of one to four words, which may begin and end inside words of a document."""
    words = F.split("text", " ")
    items = X.table(spark, d, "benchmark").select("item_id", F.explode(F.array(*map(F.lit, range(1, 5)))).alias("n"), words.alias("w"))
    items = items.select(F.struct("item_id", "n").alias("item"), F.array_join(F.slice("w", F.lit(2), F.col("n")), " ").alias("needle"))
    found = I.containment(items, X.table(spark, d, "documents"), "item", "needle", "doc_id", "text")
    return found.groupBy("item").agg(F.count(F.lit(1)).alias("texts")).select("item.item_id", "item.n", "texts")


@query("SELECT page_id, replace(regexp_extract(url, '([^/]*)$', 1), '_', ' ') AS title FROM pages")
def sitelink_title(spark: SparkSession, d: str) -> DataFrame:
    made = F.concat(F.lit("https://en.example.org/wiki/"), F.regexp_extract("url", "([^/]*)$", 1))
    return X.table(spark, d, "pages").select("page_id", T.sitelink_title(made).alias("title"))


@query("SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'HasArea' WHEN 'MACHINERY' THEN 'HasCapacity' ELSE c_mktsegment END AS relation, CAST(c_custkey % 100 AS VARCHAR) || CASE WHEN c_nationkey = 1 THEN '' ELSE ' u' || c_nationkey END AS object FROM customer")
def property_mapping(spark: SparkSession, d: str) -> DataFrame:
    names = F.create_map(*[F.lit(x) for x in ("BUILDING", "HasArea", "MACHINERY", "HasCapacity")])
    unit = F.when(F.col("c_nationkey") == 1, "").otherwise(F.concat(F.lit(" u"), F.col("c_nationkey").cast("string")))
    return X.table(spark, d, "customer").select("c_custkey", F.coalesce(F.try_element_at(names, F.col("c_mktsegment")), "c_mktsegment").alias("relation"), F.concat((F.col("c_custkey") % 100).cast("string"), unit).alias("object"))


@query("WITH A AS (SELECT c_mktsegment AS alias, min_by(c_name, (c_custkey % 2, c_name)) AS target FROM customer GROUP BY ALL) SELECT entity, coalesce(target, entity) AS resolved FROM (SELECT DISTINCT c_mktsegment AS entity FROM customer UNION SELECT DISTINCT p_type FROM part) e LEFT JOIN A ON alias = entity")
def alias_resolution(spark: SparkSession, d: str) -> DataFrame:
    c = X.table(spark, d, "customer")
    aliases = c.select(F.col("c_mktsegment").alias("alias"), F.col("c_name").alias("target"), (F.col("c_custkey") % 2).alias("priority"))
    entities = c.select(F.col("c_mktsegment").alias("entity")).union(X.table(spark, d, "part").select("p_type")).distinct()
    return K.resolve_aliases(entities, aliases)


@query("SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS prompt, count(*) AS turns FROM conversations GROUP BY conv_id")
def prompt_assembly(spark: SparkSession, d: str) -> DataFrame:
    line = F.concat("role", F.lit(": "), "text")
    grouped = X.table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("l"))
    return grouped.select("conv_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("prompt"), F.size("l").cast("long").alias("turns"))


@query("""SELECT role, count(*) AS n, count(*) FILTER (turn % 3 = 1) AS contradicted, count(*) FILTER (turn % 3 = 2) AS incorrect FROM conversations GROUP BY role""")
def verdict_keywords(spark: SparkSession, d: str) -> DataFrame:
    """Checks' answers, found by the words that reject a draft, in capitals only."""
    k = F.col("turn") % 3
    said = X.table(spark, d, "conversations").withColumn("verdict", F.when(k == 1, "- claim 1: CONTRADICTED").when(k == 2, "The second claim is INCORRECT.").otherwise("SUPPORTED, not contradicted nor incorrect"))
    counted = lambda word: F.count_if(A.rejected(F.col("verdict"), word)).alias(word.lower())
    return said.groupBy("role").agg(F.count(F.lit(1)).alias("n"), counted("CONTRADICTED"), counted("INCORRECT"))


@query("SELECT event_type, count(*) AS n, max(value) FILTER (i = floor(0.95 * c)) AS p95 FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS c FROM events) z GROUP BY event_type")
def latency_p95_index(spark: SparkSession, d: str) -> DataFrame:
    return E.percentile_index(X.table(spark, d, "events"), ["event_type"], "value", 0.95, "p95")


# crawl, connectors, index
CRAWLED = """
C0 AS (SELECT CAST(r_regionkey AS BIGINT) AS r, CAST(-1 AS BIGINT) AS n, r_name AS category, 1 AS depth FROM region),
C1 AS (SELECT r_regionkey, n_nationkey, n_name, 2 FROM nation JOIN region ON n_regionkey = r_regionkey WHERE NOT contains(lower(n_name), '_1')),
CAT AS (SELECT * FROM C0 UNION ALL SELECT * FROM C1),
PG AS (SELECT r, n, category, depth, c_mktsegment || c_custkey % 400 AS title, c_custkey AS position FROM CAT JOIN customer ON c_nationkey = n
       UNION ALL SELECT r, n, category, depth, 'About ' || category, 0 FROM CAT),
FA AS (SELECT title, min_by(struct_pack(r := r, n := n, category := category, depth := depth), (depth, r, n, position)) AS x FROM PG GROUP BY title),
CN AS (SELECT x.depth AS depth, x.r AS r, x.n AS n, count(*) AS c FROM FA GROUP BY ALL),
KP AS (SELECT depth, r, n FROM (SELECT *, coalesce(sum(c) OVER (ORDER BY depth, r, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM CN) z WHERE before < 700)"""


@query(with_(CRAWLED) + "SELECT title, CAST(x.depth AS BIGINT) AS depth, x.category AS category FROM FA JOIN KP ON x.depth = KP.depth AND x.r = KP.r AND x.n = KP.n")
def crawl_categories(spark: SparkSession, d: str) -> DataFrame:
    """Regions, their nations and the customers there, with a cycle, names that are skipped, and a cap on articles."""
    region, nation, customer = (X.table(spark, d, t) for t in ("region", "nation", "customer"))
    names = nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
    subs = spark.createDataFrame([], "key string, item string, position long")
    for rows in (region.select(F.lit("root"), "r_name", "r_regionkey"), names.select("r_name", "n_name", "n_nationkey"), names.select("n_name", "r_name", F.lit(99))):
        subs = subs.union(rows)
    everyone = customer.join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    pages = everyone.select(F.col("n_name").alias("key"), F.concat("c_mktsegment", (F.col("c_custkey") % 400).cast("string")).alias("item"), F.col("c_custkey").alias("position"))
    for name in (region.select("r_name"), nation.select("n_name")):
        pages = pages.union(name.select(F.col(name.columns[0]), F.concat(F.lit("About "), name.columns[0]), F.lit(0)))
    found = C.crawl(spark.createDataFrame([("root", 0)], "category string, position long"), C.listing(pages), C.listing(subs), ("_1",), 2, 700)
    return found.select("title", "depth", "category")


@query("""WITH C AS (SELECT i, avg(x) AS m FROM (SELECT unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings WHERE label IN (0, 3)) z GROUP BY i), L AS (SELECT list(m ORDER BY i) AS v FROM C),
S AS (SELECT 'a' || vec_id AS title, vec_id, label, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), v), 4) AS score FROM embeddings, L)
SELECT row_number() OVER (ORDER BY score DESC, label, vec_id) AS rank, title, score, CAST(label AS BIGINT) AS depth, 'c' || label AS category FROM S WHERE score >= 0.05 ORDER BY rank LIMIT 50""")
def score_and_cap(spark: SparkSession, d: str) -> DataFrame:
    index = X.vectors(spark, d)
    candidates = index.select(F.concat(F.lit("a"), F.col("id").cast("string")).alias("title"), F.col("label").alias("depth"), F.concat(F.lit("c"), F.col("label").cast("string")).alias("category"), F.array("label", "id").alias("place"), "vector")
    return C.accepted(C.scored(candidates, index.where(F.col("label").isin(*HELD_OUT))), 0.05, 50)


@query(with_(X.TRIPLES) + "SELECT relation, count(*) AS n FROM T GROUP BY relation ORDER BY n DESC, min(tid) LIMIT 15")
def most_common_relations(spark: SparkSession, d: str) -> DataFrame:
    return C.most_common(X.triples(spark, d), "relation", ["tid"], 15)


BOUND = """
TP AS (SELECT c_name AS topic, row_number() OVER (ORDER BY c_custkey) - 1 AS position FROM customer),
BT AS (SELECT *, position // 25 AS batch FROM TP),
BF AS (SELECT c_custkey AS id, position // 25 AS batch, CASE c_custkey % 4 WHEN 0 THEN 'Someone else' WHEN 1 THEN lower(c_name) || ' plc' WHEN 2 THEN 'Customer#' ELSE 'Unknown' END AS label,
              CASE WHEN c_custkey % 4 = 0 THEN upper(c_name) END AS title, c_nationkey, c_custkey % 100 AS v FROM customer JOIN TP ON topic = c_name),
MT AS (SELECT id, BT.topic, row_number() OVER (PARTITION BY id ORDER BY coalesce(lower(title) = lower(topic), false) DESC, position) AS r FROM BF JOIN BT USING (batch)
       WHERE coalesce(lower(title) = lower(topic), false) OR contains(lower(label), lower(topic)) OR contains(lower(topic), lower(label))),
FC AS (SELECT label AS subject, CASE WHEN id % 2 = 0 THEN 'HasArea' ELSE 'P' || c_nationkey END AS relation, CAST(v AS VARCHAR) || CASE WHEN c_nationkey = 1 THEN '' ELSE ' u' || c_nationkey END AS object, coalesce(topic, label) AS source_topic FROM BF LEFT JOIN (SELECT * FROM MT WHERE r = 1) m USING (id))"""


@query(with_(BOUND) + "SELECT subject, relation, object, min(source_topic) AS source_topic FROM FC GROUP BY subject, relation, object")
def sparql_rows(spark: SparkSession, d: str) -> DataFrame:
    """An endpoint's rows for batches of topics, matched to them by title, else by names that hold each other."""
    c = X.table(spark, d, "customer")
    batches = cut_lineage(P.batched(c, "c_name", "c_custkey"))
    k, code = F.col("c_custkey"), F.col("c_nationkey").cast("string")
    label = F.when(k % 4 == 0, "Someone else").when(k % 4 == 1, F.concat(F.lower("topic"), F.lit(" plc"))).when(k % 4 == 2, "Customer#").otherwise("Unknown")
    link = F.when(k % 4 == 0, T.sitelink_url(F.upper("topic")))
    rows = batches.join(c, F.col("topic") == F.col("c_name")).select(
        "batch", k.cast("string").alias("item"), label.alias("label"), F.concat(F.lit("http://x/P"), F.when(k % 2 == 0, "2046").otherwise(code)).alias("property"), (k % 100).cast("string").alias("value"),
        F.when(F.col("c_nationkey") == 1, "1").otherwise(F.concat(F.lit("u"), code)).alias("unit"), link.alias("sitelink"), F.lit(None).cast("string").alias("error"),
    )
    return P.facts(rows, batches, {"P2046": "HasArea"}).select("subject", "relation", "object", "source_topic")


@query(with_(X.TRIPLES, X.STRUCTURAL) + """, W AS (SELECT tid, subject, relation, repeat(object || ' ', 100) AS object, source_topic FROM T UNION ALL SELECT tid, subject, relation, object, NULL FROM S)
SELECT 't_' || (row_number() OVER (ORDER BY tid) - 1) AS id, 'The ' || relation || ' of ' || subject || ' is ' || object || '.' AS document, subject, relation, substr(object, 1, 500) AS object, coalesce(source_topic, '') AS source_topic, 'llm' AS source FROM W""")
def index_metadata(spark: SparkSession, d: str) -> DataFrame:
    """What an index keeps beside its vectors: ids by position, objects cut, what is missing filled. Large tables have
    facts and structural rows of the same tid: facts come first, as in the SQL's union."""
    long = X.triples(spark, d).withColumn("object", F.repeat(F.concat("object", F.lit(" ")), 100)).withColumn("side", F.lit(0))
    both = long.unionByName(X.structural(spark, d).withColumn("source_topic", F.lit(None).cast("string")).withColumn("side", F.lit(1)))
    return files.index_rows(both, K.verbalise("fine"), "tid", "side")


# experiments over the offline services, whose answer is the first fact
HELD_TOPICS = {"source_topic": {"$nin": ["t0", "t3"]}}


def offline(spark: SparkSession, d: str, call: V.Generator | None = None) -> tuple[DataFrame, DataFrame, N.Services]:
    index = cut_lineage(X.facts(spark, d))
    of = lambda level: index.withColumn("document", F.col(level))
    asked = cut_lineage(X.asked(spark, d))
    chunks = index.select("id", "vector", F.col("source_topic").alias("topic"), F.col("coarse").alias("document"))
    services = N.Services({level: of(level) for level in K.LEVELS}, call or V.echo_generator(), rerank=V.shortest_reranker(), chunks=chunks, verify=V.supporting_verifier(), self_verify=V.echo_generator(), held_out=HELD_TOPICS)
    return asked.select("qid", "question", "vector"), asked.select("id", "question", "gold_numbers"), services


def experiment(spark: SparkSession, d: str, cells: list[N.Cell], call: V.Generator | None = None) -> DataFrame:
    questions, gold, services = offline(spark, d, call)
    log = N.run(questions, cells, shared_path(spark, "log-"), lambda need, some: N.answer_cells(need, some, services))
    return N.scores(log, gold)


MAIN_GRID = N.grid(method=("kg_retrieval", "zero_shot", "standard_rag", "graph_rag", "conli", "cove"), mode=("held_out", "full_index"), rerank=(False,))
MAIN = X.ASKED + f""", AN AS (SELECT mode, 'kg_retrieval' AS method, {X.right("fine")} AS nem FROM FN WHERE rank = 1 UNION ALL SELECT mode, 'graph_rag', {X.right("fine")} FROM FN WHERE rank = 1 UNION ALL SELECT mode, 'conli', {X.right("fine")} FROM FN WHERE rank = 1
UNION ALL SELECT mode, 'standard_rag', {X.right("coarse")} FROM FN WHERE rank = 1 UNION ALL SELECT mode, 'zero_shot', 0.0 FROM FN WHERE rank = 1 UNION ALL SELECT mode, 'cove', 0.0 FROM FN WHERE rank = 1)"""


@query(with_(MAIN) + "SELECT mode, method, 'offline' AS model, count(*) AS n, round(avg(nem), 6) AS nem FROM AN GROUP BY ALL")
def main_comparison(spark: SparkSession, d: str) -> DataFrame:
    return N.summary(experiment(spark, d, MAIN_GRID), "mode", "method", "model").drop("nf1", "fp")


@query(with_(MAIN) + "SELECT method, 'offline' AS model, round(avg(nem) FILTER (mode = 'held_out'), 6) AS held_out, round(avg(nem) FILTER (mode = 'full_index'), 6) AS full_index, round(round(avg(nem) FILTER (mode = 'full_index'), 6) - round(avg(nem) FILTER (mode = 'held_out'), 6), 6) AS delta FROM AN GROUP BY method")
def heldout_vs_full_delta(spark: SparkSession, d: str) -> DataFrame:
    return N.held_out_against_full(experiment(spark, d, MAIN_GRID))


def wanders(seed: str, temperature: str) -> str:
    """SQL for whether the offline service answers with the last fact."""
    return f"CAST('0x' || substr(md5({seed} || ':' || question), 1, 7) AS BIGINT) < {temperature} * 268435456"


@query(with_(X.ASKED) + f""", GN AS (SELECT granularity, top_k, qid, gold, rank, question, CASE granularity WHEN 'fine' THEN fine WHEN 'medium' THEN medium ELSE coarse END AS document FROM FN, (VALUES ('fine'), ('medium'), ('coarse')) g(granularity), (VALUES (1), (3), (5), (7), (10)) k(top_k) WHERE mode = 'held_out' AND rank <= top_k),
FR AS (SELECT granularity, top_k, qid, any_value(gold) AS gold, any_value(question) AS question, min_by(document, (length(document), rank)) AS low, max_by(document, (length(document), rank)) AS high FROM GN GROUP BY ALL),
SD AS (SELECT granularity, top_k, seed, gold, CASE WHEN {wanders("seed", "0.5")} THEN high ELSE low END AS document FROM FR, (VALUES (0), (1), (2)) s(seed)),
RU AS (SELECT granularity, top_k, seed, avg({X.right("document")}) AS nem FROM SD GROUP BY ALL)
SELECT granularity, top_k, count(*) AS seeds, round(avg(nem), 6) AS nem, round(stddev_pop(nem), 6) AS spread FROM RU GROUP BY granularity, top_k""")
def granularity_ablation(spark: SparkSession, d: str) -> DataFrame:
    """Wording by number of facts by seed, reranked: means and spread over seeds of a service that heeds them."""
    cells = N.grid(method=("kg_retrieval",), granularity=("fine", "medium", "coarse"), top_k=(1, 3, 5, 7, 10), seed=(0, 1, 2))
    return N.over_seeds(experiment(spark, d, cells, V.WanderingGenerator()))


@query(with_(X.ASKED) + f""", RR AS (SELECT false AS rerank, qid, gold, fine AS document FROM FN WHERE mode = 'held_out' AND rank = 1 UNION ALL SELECT true, qid, any_value(gold), min_by(fine, (length(fine), rank)) FROM FN WHERE mode = 'held_out' AND rank <= 5 GROUP BY qid)
SELECT rerank, count(*) AS n, round(avg({X.right("document")}), 6) AS nem FROM RR GROUP BY rerank""")
def reranker_ablation(spark: SparkSession, d: str) -> DataFrame:
    return N.summary(experiment(spark, d, N.grid(method=("kg_retrieval",), rerank=(True, False))), "rerank").drop("nf1", "fp")


CUTS = (0.55, 0.7, None)


@query(with_(X.ASKED) + """, TH AS (SELECT CAST(threshold AS DOUBLE) AS threshold FROM (VALUES (0.55), (0.7), (NULL)) v(threshold)),
HQ AS (SELECT DISTINCT threshold, qid, gold FROM FN, TH),
SD AS (SELECT threshold, FN.* FROM FN, TH WHERE mode = 'held_out' AND (threshold IS NULL OR distance <= threshold)),
KG AS (SELECT 'kg_retrieval' AS method, threshold, qid, count(*) AS facts, min_by(fine, rank) AS answer FROM SD WHERE rank <= 5 GROUP BY threshold, qid),
SG AS (SELECT * FROM SD WHERE rank <= 10),
WG AS (SELECT *, row_number() OVER (PARTITION BY threshold, qid ORDER BY id) AS pos FROM (SELECT o.threshold, o.qid, FI.id, FI.fine FROM (SELECT DISTINCT threshold, qid, subject FROM SG) o JOIN FI USING (subject) WHERE FI.label NOT IN (0, 3)
       AND NOT EXISTS (SELECT 1 FROM SG WHERE SG.threshold IS NOT DISTINCT FROM o.threshold AND SG.qid = o.qid AND SG.id = FI.id)) z),
UG AS (SELECT threshold, qid, fine, 1 AS hop, rank AS pos FROM SG UNION ALL SELECT threshold, qid, fine, 2, pos FROM WG WHERE pos <= 15),
GR AS (SELECT 'graph_rag' AS method, threshold, qid, least(5, count(DISTINCT fine)) AS facts, min_by(fine, (hop, pos)) AS answer FROM UG GROUP BY threshold, qid),
RS AS (SELECT m.method, HQ.threshold, HQ.qid, HQ.gold, coalesce(x.facts, 0) AS facts, coalesce(x.answer, 'Not known') AS answer FROM HQ CROSS JOIN (VALUES ('kg_retrieval'), ('graph_rag')) m(method) LEFT JOIN (SELECT * FROM KG UNION ALL SELECT * FROM GR) x ON x.method = m.method AND x.qid = HQ.qid AND x.threshold IS NOT DISTINCT FROM HQ.threshold)
SELECT method, 'offline' AS model, threshold, round(avg(CASE WHEN contains(answer, CAST(CAST(gold AS BIGINT) AS VARCHAR)) THEN 1.0 ELSE 0.0 END), 4) AS nem, round(avg(facts), 1) AS avg_facts, round(avg(CASE WHEN facts = 0 THEN 1.0 ELSE 0.0 END), 4) AS zero_share, count(*) AS n FROM RS GROUP BY method, threshold""")
def threshold_methods(spark: SparkSession, d: str) -> DataFrame:
    return N.by_threshold(experiment(spark, d, N.grid(method=("kg_retrieval", "graph_rag"), threshold=CUTS, rerank=(False,))))


@query(with_(X.ASKED) + f""", KG AS (SELECT qid, any_value(gold) AS gold, any_value(question) AS question, min_by(fine, rank) AS low, max_by(fine, rank) AS high FROM FN WHERE mode = 'held_out' AND rank <= 5 GROUP BY qid),
TD AS (SELECT CAST(temperature AS DOUBLE) AS temperature, gold, CASE WHEN {wanders("0", "temperature")} THEN high ELSE low END AS document FROM KG, (VALUES (0.0), (0.1), (0.3), (0.5), (0.7), (1.0)) t(temperature))
SELECT temperature, round(avg({X.right("document")}), 6) AS first, CAST(0 AS DOUBLE) AS second, round(avg({X.right("document")}), 6) AS delta FROM TD GROUP BY temperature""")
def temperature_sweep(spark: SparkSession, d: str) -> DataFrame:
    """A service that answers with the first fact when cold and with the last when hot."""
    return N.by_temperature(experiment(spark, d, N.grid(method=("kg_retrieval", "zero_shot"), temperature=N.TEMPERATURES, rerank=(False,)), V.WanderingGenerator()))
