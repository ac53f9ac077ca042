"""Remote lookups as tables: paged listings and batched lookups behind small callables, called on the executors.

A page call takes a key and a continuation token (null at first) and returns the page's items and the next token,
null at the end. A lookup call takes a list of keys and returns, for each item found, the key and the item. Both
are picklable, so that tests and offline runs put tables in their place. Calls that keep failing give one row with
the error's text and stop no job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statweave.sources.services import Throttle, retried

Page = Callable[[str, str | None], tuple[list[str], str | None]]
Lookup = Callable[[list[str]], list[tuple[str, str]]]
#: Rows that are handed on together, at least, except the last.
ROWS_OUT = 1000
ROWS = "key string, item string, position long, error string"


def _table(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["key", "item", "position", "error"])


def _tables(answers: Iterator[list[tuple]]) -> Iterator[pa.RecordBatch]:
    """The rows of many answers together: a batch for each would cost more than the answer."""
    rows: list[tuple] = []
    for some in answers:
        rows += some
        if len(rows) >= ROWS_OUT:
            yield _table(rows)
            rows = []
    if rows:
        yield _table(rows)


def paged(keys: DataFrame, column: str, call: Page, calls: int = 30, seconds: float = 60.0, tries: int = 4, wait: float = 1.0, callers: int = 1) -> DataFrame:
    """Every item of each distinct key's listing, followed over all pages: key, item, position, error. A key that
    fails keeps the items of its earlier pages and has one more row with the error. The budget of calls is the whole
    job's: it is shared out among so many callers, each a task."""
    callers = max(1, min(callers, calls))

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        throttle = Throttle(calls // callers, seconds)
        for batch in batches:
            for key in batch.column(0).to_pylist():
                token, position, more = None, 0, True
                while more:
                    got, error = retried(lambda of, t=token: (throttle.wait(), [call(of[0], t)])[1], [key], tries, wait)
                    if error:
                        yield [(key, None, None, error)]
                        break
                    items, token = got[0]
                    yield [(key, x, position + i, None) for i, x in enumerate(items)]
                    position, more = position + len(items), token is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _tables(pages(batches))

    return _distinct(keys, column, callers).mapInArrow(run, ROWS)


def looked_up(keys: DataFrame, column: str, call: Lookup, batch: int = 50, calls: int = 30, seconds: float = 60.0, tries: int = 4, wait: float = 1.0, callers: int = 1) -> DataFrame:
    """Items of distinct keys, asked for batch by batch: key, item, position, error. Each key of a failed batch has
    one row with the error; a key without items has none. The budget is shared out as in paged."""
    callers = max(1, min(callers, calls))

    def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        throttle = Throttle(calls // callers, seconds)
        for part in batches:
            names = part.column(0).to_pylist()
            for at in range(0, len(names), batch):
                asked = names[at : at + batch]
                got, error = retried(lambda keys: (throttle.wait(), call(keys))[1], asked, tries, wait)
                yield [(k, x, i, None) for i, (k, x) in enumerate(got or [])] if not error else [(k, None, None, error) for k in asked]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _tables(answers(batches))

    return _distinct(keys, column, callers).mapInArrow(run, ROWS)


def _distinct(keys: DataFrame, column: str, callers: int) -> DataFrame:
    """The keys in so many partitions, each key by its hash, so that no more tasks call at a time; a number that is asked
    for is not changed by adaptive execution."""
    return keys.select(F.col(column).cast("string").alias("key")).where("key is not null").distinct().repartition(callers, "key")


def aliases(redirects: DataFrame, normalized: DataFrame) -> DataFrame:
    """alias, target from two lookups; a redirect beats a normalisation of the same title, identities are dropped."""
    ranked = lambda rows, priority: rows.where("item is not null").select(F.col("key").alias("alias"), F.col("item").alias("target"), F.lit(priority).alias("priority"))
    both = ranked(redirects, 1).unionByName(ranked(normalized, 0))
    return both.groupBy("alias").agg(F.max_by("target", F.struct("priority", "target")).alias("target")).where("alias <> target")


def visible_categories(listed: DataFrame, hidden: tuple[str, ...]) -> DataFrame:
    """Category items without their prefix; those that contain one of hidden, in lower case, are dropped."""
    name = F.replace("item", F.lit("Category:"), F.lit(""))
    rows = listed.where("item is not null").select("key", name.alias("item"), "position")
    for word in hidden:
        rows = rows.where(~F.contains(F.lower("item"), F.lit(word)))
    return rows
