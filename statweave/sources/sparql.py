"""Numeric facts from a SPARQL endpoint, and their match to the topics that were asked for.

An endpoint is a picklable callable from a query's text to its bindings, as the endpoint's JSON has them; it is called
for batches of topics on the executors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statweave.functions import text as T
from statweave.sources.files import positions
from statweave.sources.services import Throttle, retried

Endpoint = Callable[[str], list[dict]]
BINDING = "batch long, item string, label string, property string, value string, unit string, sitelink string, error string"
#: Our column, and the variable of the request that fills it.
_FIELDS = {"item": "entity", "label": "name", "property": "property", "value": "amount", "unit": "unit_name", "sitelink": "article"}


def question(articles: list[str], properties: list[str], most: int = 5000, site: str = "https://en.wikipedia.org/", language: str = "en") -> str:
    """A request for the quantities of the items that the articles are about. In the public data model an item leads by
    p: to a statement, that by psv: to a quantity, and that to its amount and unit; all units are items, of which the
    plain number is one."""
    paths = " ".join(f"(wd:{p} p:{p} psv:{p})" for p in properties)
    name = lambda of, to: f"OPTIONAL {{ ?{of} rdfs:label ?{to} . FILTER(LANG(?{to}) = '{language}') }}"
    return f"""SELECT {" ".join(f"?{v}" for v in _FIELDS.values())} WHERE {{
  VALUES ?article {{ {" ".join(f"<{a}>" for a in articles)} }}
  VALUES (?property ?leads ?holds) {{ {paths} }}
  ?article schema:about ?entity ; schema:isPartOf <{site}> .
  ?entity ?leads ?statement .
  ?statement ?holds ?quantity .
  ?quantity wikibase:quantityAmount ?amount ; wikibase:quantityUnit ?unit .
  {name("entity", "name")}
  {name("unit", "unit_name")}
}}
LIMIT {most}"""


def batched(topics: DataFrame, column: str, order: str, size: int = 25) -> DataFrame:
    """topic, position and batch: topics in a stated order, so many to a batch."""
    return positions(topics.select(F.col(column).alias("topic"), F.col(order).alias("__order")), "__order").select("topic", "position", F.floor(F.col("position") / size).cast("long").alias("batch"))


def bindings(batches: DataFrame, endpoint: Endpoint, properties: list[str], calls: int = 30, seconds: float = 60.0, tries: int = 2, wait: float = 60.0, callers: int = 1) -> DataFrame:
    """batches (topic, position, batch): the endpoint's rows for each batch, or one row with the error."""
    callers = max(1, min(callers, calls))
    whole = batches.groupBy("batch").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", T.sitelink_url(F.col("topic")).alias("url")))), lambda x: x["url"]).alias("urls"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        throttle = Throttle(calls // callers, seconds)
        names = [x.split()[0] for x in BINDING.split(", ")]

        def counted(requests: list[str]) -> list[dict]:
            throttle.wait()
            return endpoint(requests[0])

        for part in parts:
            for batch, urls in zip(part.column("batch").to_pylist(), part.column("urls").to_pylist(), strict=True):
                got, error = retried(counted, [question(urls, properties)], tries, wait)
                rows = [{"batch": batch, "error": error}] if error else [{"batch": batch} | {k: b.get(f, {}).get("value") for k, f in _FIELDS.items()} for b in got]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], pa.int64() if n == "batch" else pa.string()) for n in names], names=names)

    return whole.repartition(callers, "batch").mapInArrow(run, BINDING)


def quantity(value: Column, unit: Column) -> Column:
    """A value with its unit, without a plus before it; the unit one, and none, are left out."""
    value = F.regexp_replace(value, r"^\+", "")
    return F.when(F.coalesce(unit, F.lit("")).isin("", "1"), value).otherwise(T.strip(F.concat(value, F.lit(" "), unit)))


def matched(found: DataFrame, batches: DataFrame) -> DataFrame:
    """found (id, batch, label, title) with topic: of its batch's topics that which is the title, whatever the case, else
    the first that holds the label or is held by it, else null. A batch has a few dozen topics, so each row meets no
    more."""
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    near = found.join(batches.select("batch", "position", "topic"), "batch")
    same = (low("title") != "") & (low("title") == low("topic"))
    near = near.withColumn("same", same).where(F.col("same") | F.contains(low("label"), low("topic")) | F.contains(low("topic"), low("label")))
    best = near.groupBy("id").agg(F.min_by("topic", F.struct((~F.col("same")).alias("other"), "position")).alias("topic"))
    return found.join(best, "id", "left")


def facts(rows: DataFrame, batches: DataFrame, relations: dict[str, str]) -> DataFrame:
    """Triples from bindings: subject, relation, object, source_topic, source, item; of equal triples one. relations
    names properties; a property without a name is its own."""
    numbered = rows.where("error is null").withColumn("id", F.xxhash64("batch", "item", "label", "property", "value", "unit", "sitelink"))
    numbered = numbered.dropDuplicates(["id"]).withColumn("title", F.when(F.col("sitelink").contains("/wiki/"), T.sitelink_title(F.col("sitelink"))))
    code = F.substring_index("property", "/", -1)
    named = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in relations.items() for x in kv]), code), code) if relations else code
    out = matched(numbered, batches).select(
        F.coalesce("label", F.lit("")).alias("subject"), named.alias("relation"), quantity(F.col("value"), F.col("unit")).alias("object"),
        F.coalesce("topic", "label").alias("source_topic"), F.lit("wikidata").alias("source"), "item",
    )
    return out.groupBy("subject", "relation", "object").agg(F.min(F.struct("source_topic", "source", "item")).alias("x")).select("subject", "relation", "object", "x.*")


def first_of_each(rows: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The first n rows of each key, as a result limit of the endpoint would leave them."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where(F.col("__n") <= n).drop("__n")
