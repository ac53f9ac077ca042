"""Exact deduplication by two-pass Bloom filtering, in DataFrame operations only.

Pass one turns every text's digest into bits of a blocked Bloom filter and keeps the bits that were hit at
least twice. Pass two probes it: a digest whose bits were not all hit twice is certainly unique, so its row
passes straight through; only the possibly repeated rows shuffle and are grouped exactly. A false positive
of the filter costs one shuffled row and changes no result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statweave.llm.common import attach_group, materialise

WHITE_SPACE = "[\\x20\\x09-\\x0D]+"
#: Bits in one block: what one value of bitmap_construct_agg holds.
BLOCK_BITS = 32768


def _is_set(bitmap: Column, bit: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, (bit % 8).cast("int")) == 1, F.lit(False))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """rid, doc_id, chars (code points of the original text) and sha (SHA-256 of the text without white space)."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return docs.select(
        (F.col(f"`{row_col}`") if row_col else F.monotonically_increasing_id()).alias("rid"),
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.length(text).cast("long").alias("chars"),
        F.unhex(F.sha2(F.regexp_replace(text, WHITE_SPACE, "").cast("binary"), 256)).alias("sha"),
    )


def repeated_bits(table: DataFrame, blocks: int) -> DataFrame:
    """Pass one: block and bitmap of the filter bits that at least two digests hit."""
    block = F.pmod(F.xxhash64("sha"), F.lit(blocks)) * BLOCK_BITS
    bits = [F.pmod(F.xxhash64("sha", F.lit(k)), F.lit(BLOCK_BITS)) for k in (1, 2)]
    hits = table.select(F.explode(F.array(*[block + b for b in bits])).alias("at")).groupBy("at").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return hits.groupBy(F.floor(F.col("at") / BLOCK_BITS).cast("long").alias("block")).agg(F.bitmap_construct_agg(F.col("at") % BLOCK_BITS).alias("bitmap"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None, bits_per_row: int = 16, broadcast_mb: int = 64, hot_groups: int = 1000) -> DataFrame:
    """One row for each input row: doc_id, keep_id, group_size, kept, text_sha256, and rid, a row number.

    Equal texts are equal after removal of [\\x20\\x09-\\x0D]; the row with the most code points, then the
    smallest doc_id, then the first of fully repeated rows stays. Null text counts as empty (all empty and
    blank texts are one group); a null doc_id comes after all others; an empty table gives an empty result;
    other columns, whatever their names, are ignored. row_col: a column that already numbers the rows.

    The filter takes bits_per_row bits a row. It is broadcast while it has at most broadcast_mb, and beyond
    that probed by a shuffle of digests by block, of which the hot ones, at most hot_groups of BLOCK_BITS bits
    each, are broadcast.
    """
    table = materialise(digests(docs, id_col, text_col, row_col), "digests")
    total = table.count()
    blocks = max(1, -(-total * bits_per_row // BLOCK_BITS))
    filter_ = repeated_bits(table, blocks)
    keyed = table.withColumn("block", F.pmod(F.xxhash64("sha"), F.lit(blocks)))
    if blocks * BLOCK_BITS // 8 <= broadcast_mb << 20:
        probed = keyed.join(F.broadcast(filter_), "block", "left")
    else:  # a text with very many copies makes its block hot
        filter_ = keyed.groupBy("block").agg(F.count(F.lit(1)).alias("rows")).join(filter_, "block", "left")
        probed = attach_group(keyed, materialise(filter_, "filter"), "block", "rows", total, hot_groups)
    bit = lambda k: F.pmod(F.xxhash64("sha", F.lit(k)), F.lit(BLOCK_BITS))
    probed = materialise(probed.select("rid", "doc_id", "chars", "sha", (_is_set(F.col("bitmap"), bit(1)) & _is_set(F.col("bitmap"), bit(2))).alias("maybe")), "probed")
    maybe = probed.where("maybe").drop("maybe")
    # of the largest struct: most characters, then smallest id, then first row
    best = F.max(F.struct("chars", F.bitwise_not("doc_id").alias("back"), F.bitwise_not("rid").alias("row")))
    groups = materialise(maybe.groupBy("sha").agg(F.count(F.lit(1)).alias("group_size"), best.alias("best")), "groups")
    grouped = attach_group(maybe, groups, "sha", "group_size", total, hot_groups).select(
        "doc_id", F.bitwise_not("best.back").alias("keep_id"), "group_size", (F.bitwise_not("best.row") == F.col("rid")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"), "rid"
    )
    single = probed.where("not maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"), "rid")
    return single.unionByName(grouped)


ORACLE = """
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS chars,
                  sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', '', 'g')) AS text_sha256
           FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept,
       text_sha256
FROM n WINDOW w AS (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id)
"""
