"""The engine's logical inputs, derived from the driver's tables; each also as SQL for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statweave.functions import text as T
from statweave.operators import triples as K


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def price() -> F.Column:
    return F.floor("p_retailprice").cast("long")


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    facts = F.explode(F.array(F.struct(F.lit(0).alias("k"), F.lit("HasMaxValue").alias("relation"), F.concat(price(), F.lit(" USD")).alias("object")), F.struct(F.lit(1).alias("k"), F.lit("HasCapacity").alias("relation"), F.concat("p_size", F.lit(" units")).alias("object"))))
    return part.select("p_partkey", "p_name", "p_brand", facts.alias("f")).select((F.col("p_partkey") * 2 + F.col("f.k")).alias("tid"), F.col("p_name").alias("subject"), "f.relation", "f.object", F.col("p_brand").alias("source_topic"))


TRIPLES = """
T AS (SELECT p_partkey * 2 AS tid, p_name AS subject, 'HasMaxValue' AS relation, CAST(CAST(floor(p_retailprice) AS BIGINT) AS VARCHAR) || ' USD' AS object, p_brand AS source_topic FROM part
      UNION ALL SELECT p_partkey * 2 + 1, p_name, 'HasCapacity', CAST(p_size AS VARCHAR) || ' units', p_brand FROM part)"""


def structural(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    joined = nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select((F.col("n_nationkey") + 1_000_000).cast("long").alias("tid"), F.col("n_name").alias("subject"), F.lit("BelongsToCategory").alias("relation"), F.col("r_name").alias("object"), F.col("n_name").alias("source_topic"))


STRUCTURAL = """
S AS (SELECT CAST(n_nationkey + 1000000 AS BIGINT) AS tid, n_name AS subject, 'BelongsToCategory' AS relation, r_name AS object, n_name AS source_topic
      FROM nation JOIN region ON n_regionkey = r_regionkey)"""


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return part.select(F.col("p_partkey").alias("id"), F.concat(F.lit("price of "), F.col("p_partkey").cast("string")).alias("question"), F.when(F.col("p_partkey") % 3 == 0, "HasMaxValue").when(F.col("p_partkey") % 3 == 1, "HasStatistic").otherwise("HasNumericValue").alias("relation"), F.array(price().cast("string")).alias("gold_numbers"), F.col("p_brand").alias("source_topic"))


BENCHMARK = """
B AS (SELECT p_partkey AS id, 'price of ' || CAST(p_partkey AS VARCHAR) AS question, CASE p_partkey % 3 WHEN 0 THEN 'HasMaxValue' WHEN 1 THEN 'HasStatistic' ELSE 'HasNumericValue' END AS relation,
             [CAST(CAST(floor(p_retailprice) AS BIGINT) AS VARCHAR)] AS gold_numbers, p_brand AS source_topic FROM part)"""


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    methods = F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("m"), F.lit(n).alias("method")) for i, n in enumerate(("kg", "rag", "zero"))]))
    rows = part.select("*", price().alias("g"), methods.alias("x")).select("*", "x.m", "x.method").withColumn("k", (F.col("p_partkey") + 2 * F.col("m")) % 7)
    g, say = F.col("g"), lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in p])
    part_of = lambda d: F.floor(g / d).cast("long")
    answer = F.when(F.col("k") == 0, say("It is ", g, ".")).when(F.col("k") == 1, say("About ", g + part_of(200))).when(F.col("k") == 2, say(g + part_of(20), " USD")).when(F.col("k") == 3, "Not known").when(F.col("k") == 4, say("Between ", g - part_of(10), " and ", g)).when(F.col("k") == 5, "").otherwise("0")
    size, cost = say("The HasCapacity of ", F.col("p_name"), " is ", F.col("p_size"), " units."), say("The HasMaxValue of ", F.col("p_name"), " is ", g, " USD.")
    found = F.when(F.col("p_partkey") % 4 == 0, F.array().cast("array<string>")).when(F.col("p_partkey") % 4 == 1, F.array(cost, size)).when(F.col("p_partkey") % 4 == 2, F.array(size)).otherwise(F.array(size, cost))
    return rows.select(
        (F.col("p_partkey") * 3 + F.col("m")).alias("rid"), F.concat(F.lit("m"), (F.col("p_partkey") % 3).cast("string")).alias("model"), "method", say("price of ", F.col("p_partkey")).alias("question"), answer.alias("answer"),
        F.when(F.col("k") == 5, "timeout").alias("error"), ((F.col("p_partkey") * 37 + F.col("m") * 101) % 1000).cast("double").alias("latency_ms"), (F.col("p_partkey") % 5 * 100).alias("tokens"), found.alias("retrieved"),
    )


RESULTS = """
M AS (SELECT * FROM (VALUES (0, 'kg'), (1, 'rag'), (2, 'zero')) v(m, method)),
P AS (SELECT *, CAST(floor(p_retailprice) AS BIGINT) AS g, (p_partkey + 2 * m) % 7 AS k FROM part, M),
R AS (SELECT p_partkey * 3 + m AS rid, 'm' || CAST(p_partkey % 3 AS VARCHAR) AS model, method, 'price of ' || CAST(p_partkey AS VARCHAR) AS question,
        CASE k WHEN 0 THEN 'It is ' || g || '.' WHEN 1 THEN 'About ' || (g + g // 200) WHEN 2 THEN (g + g // 20) || ' USD' WHEN 3 THEN 'Not known'
               WHEN 4 THEN 'Between ' || (g - g // 10) || ' and ' || g WHEN 5 THEN '' ELSE '0' END AS answer,
        CASE WHEN k = 5 THEN 'timeout' END AS error, CAST((p_partkey * 37 + m * 101) % 1000 AS DOUBLE) AS latency_ms, p_partkey % 5 * 100 AS tokens,
        CASE p_partkey % 4 WHEN 0 THEN CAST([] AS VARCHAR[]) WHEN 1 THEN ['The HasMaxValue of ' || p_name || ' is ' || g || ' USD.', 'The HasCapacity of ' || p_name || ' is ' || p_size || ' units.']
             WHEN 2 THEN ['The HasCapacity of ' || p_name || ' is ' || p_size || ' units.']
             ELSE ['The HasCapacity of ' || p_name || ' is ' || p_size || ' units.', 'The HasMaxValue of ' || p_name || ' is ' || g || ' USD.'] END AS retrieved
      FROM P)"""

#: Number tokens of an expression as doubles; the metrics over an answer and gold tokens.
NUMS = r"list_transform(regexp_extract_all({0}, '-?\d+(?:,\d{{3}})*(?:\.\d+)?(?:\s*%)?'), lambda x: TRY_CAST(regexp_replace(x, '[,%\s]', '', 'g') AS DOUBLE))"
SCORED = (
    RESULTS
    + ","
    + BENCHMARK
    + """,
Q AS (SELECT R.*, B.relation, B.gold_numbers, """
    + NUMS.format("answer")
    + """ AS pred, list_transform(gold_numbers, lambda x: CAST(x AS DOUBLE)) AS gold FROM R JOIN B USING (question)),
E AS (SELECT *, CASE WHEN len(list_filter(pred, lambda p: abs(p - gold[1]) / gold[1] <= 0.01)) > 0 THEN 1.0 ELSE 0.0 END AS nem,
             len(list_intersect(list_distinct(pred), gold)) AS hit, len(list_distinct(pred)) AS np,
             CASE WHEN len(pred) = 0 THEN 1.0 ELSE len(list_filter(pred, lambda p: p = gold[1])) * 1.0 / len(pred) END AS fp FROM Q),
F AS (SELECT *, CASE WHEN hit = 0 THEN 0.0 ELSE 2.0 * (hit * 1.0 / np) * (hit * 1.0 / 1) / (hit * 1.0 / np + hit * 1.0) END AS nf1 FROM E)"""
)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("vector"), F.col("label").cast("long").alias("label"))


def squeezed(sql: str) -> str:
    """A text without white space at its ends, as T.strip makes it."""
    return f"regexp_replace(regexp_replace({sql}, '^{T.SPACE}+', ''), '{T.SPACE}+$', '')"


def normal(sql: str) -> str:
    """A text as T.normalize_string makes it."""
    return f"regexp_replace(regexp_replace({squeezed(f'nfc_normalize({sql})')}, '{T.SPACE}+', ' ', 'g'), '\\.+$', '')"


def prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text with figures, and with white space of all kinds: one article for each part."""
    part = table(spark, sf_dir, "part")
    s = lambda c: F.col(c).cast("string")
    kind = F.col("p_partkey") % 5
    text = F.concat(
        F.when(kind == 0, "\n^ ").when(kind == 1, "\u00a0\t").otherwise(""), F.lit("The "), s("p_name"), F.lit(" by "), s("p_brand"), F.lit(" costs about "), price().cast("string"), F.lit(" dollars and weighs "), s("p_size"), F.lit(" kg in all."),
        F.when(kind == 2, "\u2003").when(kind == 3, "\n").otherwise(" "), F.lit("Short 5%. A "), s("p_type"), F.lit(" part with no figures in it whatsoever, as such things go!"),
        F.when(kind == 4, "\u00a0").otherwise(" "), F.lit("^ see "), s("p_size"), F.lit("% of the pages that were cited in the literature here."),
    )
    return part.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("topic"), text.alias("text"))


PROSE = """
A AS (SELECT p_partkey AS id, p_brand AS topic,
        CASE p_partkey % 5 WHEN 0 THEN chr(10) || '^ ' WHEN 1 THEN chr(160) || chr(9) ELSE '' END || 'The ' || p_name || ' by ' || p_brand || ' costs about ' || CAST(floor(p_retailprice) AS BIGINT) || ' dollars and weighs ' || p_size || ' kg in all.'
        || CASE p_partkey % 5 WHEN 2 THEN chr(8195) WHEN 3 THEN chr(10) ELSE ' ' END || 'Short 5%. A ' || p_type || ' part with no figures in it whatsoever, as such things go!'
        || CASE p_partkey % 5 WHEN 4 THEN chr(160) ELSE ' ' END || '^ see ' || p_size || '% of the pages that were cited in the literature here.' AS text FROM part)"""
#: The statistical sentences of the prose, with their positions among all sentences.
SENTENCES = (
    PROSE
    + f""",
Z AS (SELECT id, topic, unnest(cut) AS raw, generate_subscripts(cut, 1) - 1 AS pos FROM (SELECT *, string_split(regexp_replace(text, '([.!?]){T.SPACE}+', '\\1' || chr(1), 'g'), chr(1)) AS cut FROM A) c),
S AS (SELECT id, topic, pos, {squeezed("raw")} AS sentence FROM Z),
SS AS (SELECT * FROM S WHERE length(sentence) >= 50 AND sentence NOT LIKE '^%' AND sentence NOT LIKE '%== %' AND sentence NOT LIKE 'ISBN%'
       AND regexp_matches(sentence, '(?i)(\\d+\\.?\\d*\\s*%|\\d+\\.?\\d*\\s*(tons?|tonnes?|kilograms?|kg)|(approximately|about|nearly|over|up\\s+to|around)\\s+\\d+)'))"""
)


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector index: each vector stands for the fact of the same number; its topic is its label's."""
    t = triples(spark, sf_dir).select("tid", "subject", "relation", "object")
    of = lambda level: K.verbalise(level).alias(level)
    return vectors(spark, sf_dir).join(t, F.col("id") == F.col("tid")).select("id", "vector", F.concat(F.lit("t"), F.col("label").cast("string")).alias("source_topic"), "subject", "relation", "object", *map(of, K.LEVELS))


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question for each fact of the stated query set, and the figure that answers it."""
    rows = facts(spark, sf_dir).where("id % 50 = 0")
    text = F.concat(F.lit("What is the "), "relation", F.lit(" of "), "subject", F.lit(" ("), F.col("id").cast("string"), F.lit(")?"))
    return rows.select(F.col("id").alias("qid"), text.alias("question"), "vector", F.array(F.regexp_extract("object", "^[0-9]+", 0)).alias("gold_numbers"), F.lit(0).alias("id"))


ASKED = (
    TRIPLES
    + """,
FI AS (SELECT CAST(vec_id AS BIGINT) AS id, CAST(label AS BIGINT) AS label, CAST(embedding AS DOUBLE[]) AS v, subject,
              'The ' || relation || ' of ' || subject || ' is ' || object || '.' AS fine, subject || ' - ' || relation || ': ' || object AS medium, subject || ': ' || relation || '=' || object AS coarse, CAST(regexp_extract(object, '^[0-9]+') AS DOUBLE) AS figure,
              'What is the ' || relation || ' of ' || subject || ' (' || vec_id || ')?' AS question
       FROM embeddings JOIN T ON tid = vec_id),
FD AS (SELECT mode, q.id AS qid, q.figure AS gold, q.question, x.id, x.subject, x.fine, x.medium, x.coarse, 1 - list_cosine_similarity(q.v, x.v) AS distance
       FROM (VALUES ('held_out'), ('full_index')) m(mode), FI q, FI x WHERE q.id % 50 = 0 AND (mode = 'full_index' OR x.label NOT IN (0, 3))),
FN AS (SELECT *, row_number() OVER (PARTITION BY mode, qid ORDER BY distance, id) AS rank FROM FD)"""
)


def right(document: str) -> str:
    """SQL for whether a document has a number close to gold."""
    return f"CASE WHEN len(list_filter({NUMS.format(document)}, lambda p: abs(p - gold) / gold <= 0.01)) > 0 THEN 1.0 ELSE 0.0 END"
