"""Which texts contain which needles, by an inverted index of grams and words.

A needle's inner words, those with a space on either side, stand as whole words in every text that contains it. A long
needle is filed under that run of three of them that the fewest texts have, one of few inner words under the rarest of
them. What has none, one or two words that may begin and end inside a text's words, is looked for in the vocabulary, all
texts' different words: it is filed under all words that hold its longest part, which are found by runs of characters.
So characters are looked at once for each different word, not in each text. Texts meet needles by equi-joins, whatever
their number, and what meets is verified, unless one word held all of the needle. What would meet more often
than there are texts is looked for in each of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statweave.session import cut_lineage

#: Inner words of a needle that is filed under runs of so many.
LONG = 3
#: Kinds of grams, the best first: name, units in a run, and whether they are words.
KINDS = (("words3", LONG, True), ("chars3", 3, False), ("char", 1, False))


def _runs(units: Column, first: Column, last: Column, length: int, name: str) -> Column:
    """Hashes of the runs of units that begin at 0-based places from first to last."""
    places = F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda i: F.xxhash64(F.lit(name), *[F.get(units, i + k) for k in range(length)])))


def _with_units(rows: DataFrame, column: str, words: bool = True, chars: bool = True) -> DataFrame:
    """rows with the words and characters of a column, as columns of their own: inside a lambda they would be cut
    anew for each element."""
    none = F.lit(None).cast("array<string>")
    return rows.select("*", (F.split(column, " ") if words else none).alias("words"), (F.split(column, "") if chars else none).alias("chars"))


def _kind(needle: Column) -> Column:
    """The best kind of gram that a needle has."""
    return F.when(F.size(F.split(needle, " ")) - 2 >= LONG, "words3").when(F.length(needle) >= 3, "chars3").otherwise("char")


def _of_needle() -> Column:
    """Grams of its inner words, or of all its characters, by the column kind."""
    out = F.array().cast("array<bigint>")
    for name, length, words in KINDS:
        units, edge = F.col("words" if words else "chars"), 1 if words else 0
        out = F.when(F.col("kind") == name, _runs(units, F.lit(edge), F.size(units) - edge - length, length, name)).otherwise(out)
    return out


def _of_text(kinds: set[str]) -> Column:
    units = lambda words: F.col("words" if words else "chars")
    parts = [_runs(units(words), F.lit(0), F.size(units(words)) - length, length, name) for name, length, words in KINDS if name in kinds]
    return F.concat(*parts) if parts else F.array().cast("array<bigint>")


def _by_grams(needles: DataFrame, texts: DataFrame) -> DataFrame:
    """needle, doc for every text (key, doc, text) that contains a needle (needle), which isn't empty.

    Grams that no needle is filed under are dropped before anything shuffles by them; a frequent gram of texts is split
    by the join like any skewed key. Texts come back by a join with what met them."""
    needles = _with_units(needles.withColumn("kind", _kind(F.col("needle"))), "needle")
    kinds = {r.kind for r in needles.select("kind").distinct().collect()}  # three at most
    filed = cut_lineage(needles.select("needle", F.explode(_of_needle()).alias("gram")))
    cut = _with_units(texts.select("key", "text"), "text", "words3" in kinds, bool(kinds - {"words3"}))
    grams = cut.select("key", F.explode(_of_text(kinds)).alias("gram"))
    grams = cut_lineage(grams.join(filed.select("gram").distinct(), "gram", "left_semi"))
    often = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("texts"))
    # a gram that no text has is the rarest: its needle stands nowhere
    ranked = filed.join(often, "gram", "left").withColumn("nth", F.row_number().over(Window.partitionBy("needle").orderBy(F.coalesce("texts", F.lit(0)), "gram")))
    met = cut_lineage(ranked.where("nth = 1").select("needle", "gram").join(grams, "gram").select("key", "needle").distinct())
    return texts.join(met, "key").where(F.contains("text", F.col("needle"))).select("needle", "doc")


def _by_words(needles: DataFrame, texts: DataFrame) -> DataFrame:
    """The same for needles (needle, parts) of few inner words or none, by the texts' vocabulary."""
    words = texts.select("key", F.explode(F.array_distinct(F.split("text", " "))).alias("word"))
    known = cut_lineage(words.groupBy("word").agg(F.count(F.lit(1)).alias("texts")))
    inner = needles.where(F.size("parts") > 2).select("needle", F.explode(F.slice("parts", F.lit(2), F.size("parts") - 2)).alias("word"))
    # a word that no text has is the rarest: its needle stands nowhere
    rank = F.row_number().over(Window.partitionBy("needle").orderBy(F.coalesce("texts", F.lit(0)), "word"))
    whole = inner.join(known, "word", "left").withColumn("nth", rank).where("nth = 1 and texts is not null").select("needle", "word", "texts")
    first, second = F.get("parts", F.lit(0)), F.coalesce(F.get("parts", F.lit(1)), F.lit(""))
    edges = cut_lineage(needles.where(F.size("parts") <= 2).select("needle", F.when(F.length(first) >= F.length(second), first).otherwise(second).alias("part")))
    parts = edges.select(F.col("part").alias("needle")).where("needle <> ''").distinct()
    held = _by_grams(parts, known.select(F.xxhash64("word").alias("key"), F.col("word").alias("doc"), F.col("word").alias("text")))
    held = edges.join(held.select(F.col("needle").alias("part"), F.col("doc").alias("word")), "part").join(known, "word").select("needle", "word", "texts")
    filed = cut_lineage(whole.unionByName(held))
    often = cut_lineage(filed.groupBy("needle").agg(F.sum("texts").alias("met")))
    total = texts.count()
    everywhere = often.where(F.col("met") >= total).select("needle").unionByName(edges.where("part = ''").select("needle"))
    rare = cut_lineage(filed.join(often.where(F.col("met") < total), "needle").select("needle", "word"))
    met = cut_lineage(words.join(rare, "word").select("key", "needle").distinct())
    spaced = F.contains("needle", F.lit(" "))
    sure = texts.select("key", "doc").join(met.where(~spaced), "key").select("needle", "doc")
    found = texts.join(met.where(spaced), "key").where(F.contains("text", F.col("needle"))).select("needle", "doc")
    common = texts.join(cut_lineage(everywhere), F.contains("text", F.col("needle"))).select("needle", "doc")
    return sure.unionByName(found).unionByName(common)


def containment(items: DataFrame, docs: DataFrame, item: str, needle: str, doc: str, text: str) -> DataFrame:
    """item, doc for every text that contains an item's needle; null and empty needles match nothing, null texts are
    matched by none, and repeated items and texts count each."""
    needles = items.select(F.col(needle).alias("needle")).where("needle <> ''").distinct()
    needles = cut_lineage(needles.withColumn("parts", F.split("needle", " ")))
    long = F.size("parts") - 2 >= LONG
    texts = docs.select(F.col(doc).alias("doc"), F.col(text).alias("text")).where("text is not null")
    texts = texts.select(F.xxhash64("doc", "text").alias("key"), "doc", "text")
    ways = {r.long for r in needles.select(long.alias("long")).distinct().collect()}
    found = _by_words(needles.where(~long), texts) if False in ways else None
    if found is None or True in ways:
        grams = _by_grams(needles.where(long).select("needle"), texts)
        found = grams if found is None else found.unionByName(grams)
    wanted = items.select(F.col(item).alias("item"), F.col(needle).alias("needle"))
    return wanted.join(found, "needle").select(F.col("item").alias(item), F.col("doc").alias(doc))
