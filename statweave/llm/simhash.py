"""SimHash near-duplicates: fingerprints, and a binary trie self-join that finds all pairs in a small Hamming distance.

Two 64-bit fingerprints that differ in at most two bits agree on one of three blocks of bits, so each
fingerprint is filed three times, rotated so that a block comes first. What shares a block is a subtrie; one
traversal walks pairs of its nodes together, adds up differing bits, and drops a pair as soon as it has more
than the budget. A subtrie with too many fingerprints for one task is cut into pairs of its nodes below its
most even bits, and each pair of nodes within the budget becomes a group of its own, so no link is lost.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statweave.llm.common import attach_group, bound_batches, by_slices, byte_pieces, lower_ascii, materialise, text_buffers
from statweave.llm.components import connected_components

#: Start and width of the blocks; with a budget of k differing bits, k + 1 blocks suffice.
BLOCKS = ((0, 22), (22, 21), (43, 21))
BUDGET = 2
#: Distinct fingerprints that one subtrie may have before it is cut.
GROUP_LIMIT = 16384
#: Node pairs that a traversal holds at once; more are put off.
FRONTIER = 1 << 20
#: Rows of many small groups that are traversed together.
CHUNK = 1 << 17


def fingerprint(text: bytes, width: int = 3, seed: int = 42) -> int:
    """SimHash over all shingles of the words of text: a bit is 1 if set in over half of their XXH64 values. A long
    text is read in pieces, each after the last words of the one before."""
    digest = xxhash.xxh64_intdigest
    ones, total = np.zeros(64, np.int64), 0
    held: list[bytes] = []
    for piece in byte_pieces(text):
        words = held + piece.split()
        n = len(words) - width + 1
        if n > 0:
            line = b" ".join(words)
            size = np.fromiter(map(len, words), np.int64, len(words)) + 1
            stops = np.cumsum(size)
            starts, ends = (stops - size)[:n].tolist(), (stops - 1)[width - 1 :].tolist()
            hashes = np.fromiter((digest(line[i:j], seed) for i, j in zip(starts, ends, strict=True)), np.uint64, n)
            for at in range(0, n, 65536):
                part = hashes[at : at + 65536]
                ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            total += n
        held = words[max(0, len(words) - width + 1) :]
    if not total:
        return digest(b" ".join(held), seed) if held else 0
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.uint64)[0])


def fingerprint_column(width: int = 3, seed: int = 42):
    def run(text: pa.Array) -> pa.Array:
        data, offsets = text_buffers(text)
        data = lower_ascii(data).tobytes()
        out = [fingerprint(data[i:j], width, seed) for i, j in itertools.pairwise(offsets.tolist())]
        return pa.array(np.array(out, np.uint64).view(np.int64))

    @F.arrow_udf("long")
    def column(text: pa.Array) -> pa.Array:
        return by_slices(run)(text)

    return column


def _rotated(col: Column, by: int) -> Column:
    return col if not by else F.shiftleft(col, by).bitwiseOR(F.shiftrightunsigned(col, 64 - by))


def node_pairs(values: np.ndarray, roots: np.ndarray, first_bit: int, budget: int = BUDGET) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Walks pairs of trie nodes together from pairs of roots and yields the leaves' index pairs.

    values: unsigned 64-bit; a node is a range of them, sorted, equal in the bits above its level. roots:
    rows of (start, end, start, end); equal ranges stand for a subtrie with itself. first_bit: the first
    level whose bits may differ, counted from the highest.
    """
    n = values.size
    stack = [(first_bit, roots[:, 0], roots[:, 1], roots[:, 2], roots[:, 3], np.zeros(len(roots), np.int8))]
    zeros: dict[int, np.ndarray] = {}
    while stack:
        level, a, b, c, d, err = stack.pop()
        if level == 64:
            differ = a != c
            if differ.any():
                yield a[differ], c[differ]
            continue
        if a.size > FRONTIER:
            for at in range(0, a.size, FRONTIER):
                stack.append((level, *(x[at : at + FRONTIER] for x in (a, b, c, d, err))))
            continue
        if level not in zeros:
            count = np.zeros(n + 1, np.int64)
            np.cumsum(((values >> np.uint64(63 - level)) & np.uint64(1)) == 0, out=count[1:])
            zeros[level] = count
        count = zeros[level]
        ab, cd = a + count[b] - count[a], c + count[d] - count[c]
        own = (a == c) & (b == d)
        far = err < budget
        new = [(a, ab, c, cd, err, None), (ab, b, cd, d, err, None), (a, ab, cd, d, err + 1, far), (ab, b, c, cd, err + 1, far & ~own)]
        parts = []
        for w, x, y, z, e, only in new:
            live = (x > w) & (z > y) & ~((w == y) & (x == z) & (x - w == 1))
            live = live if only is None else live & only
            parts.append(tuple(v[live] for v in (w, x, y, z, e)))
        joined = tuple(np.concatenate(v) for v in zip(*parts, strict=True))
        if joined[0].size:
            stack.append((level + 1, *joined))


def local_roots(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The least index that each of n nodes reaches by the pairs; what is joined already isn't kept."""
    label = np.arange(n)
    for i, j in pairs:
        while True:
            x, y = label[i], label[j]
            open_ = x != y
            if not open_.any():
                break
            i, j, x, y = i[open_], j[open_], x[open_], y[open_]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while (label[label] != label).any():
                label = label[label]
    while (label[label] != label).any():
        label = label[label]
    return label


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (block, lo, hi, top, side, value) to links of fingerprints: each to the least of its group's
    that it reaches. Whole groups are gathered until there is a chunk of rows."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    names = ("block", "top", "lo", "hi", "side", "value")

    def solve(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        group = np.stack(rows[:4])
        change = np.concatenate([[True], (group[:, 1:] != group[:, :-1]).any(axis=0)])
        starts = np.flatnonzero(change)
        ends = np.append(starts[1:], group.shape[1])
        big = ends - starts > 1
        starts, ends = starts[big], ends[big]
        for block, (shift, width) in enumerate(BLOCKS):
            here = rows[0][starts] == block
            if not here.any():
                continue
            s, e = starts[here], ends[here]
            second = np.concatenate([[0], np.cumsum(rows[4])])
            cut = e - (second[e] - second[s])  # rows of the other side come last
            two = rows[2][s] != rows[3][s]
            ok = ~two | ((cut > s) & (cut < e))
            roots = np.stack([s, np.where(two, cut, e), np.where(two, cut, s), e], axis=1)[ok]
            values = rows[5].view(np.uint64)
            label = local_roots(values.size, node_pairs(values, roots, width))
            moved = np.flatnonzero(label != np.arange(label.size))
            if moved.size:
                back = lambda v, by=shift: v if not by else (v >> np.uint64(by)) | (v << np.uint64(64 - by))
                yield pa.RecordBatch.from_arrays([pa.array(back(values[x]).view(np.int64)) for x in (moved, label[moved])], schema=schema)

    held: list[np.ndarray] | None = None
    for batch in batches:
        new = [batch.column(n).to_numpy() for n in names]
        held = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
        if held[0].size >= CHUNK:
            last = np.logical_and.reduce([x == x[-1] for x in held[:4]])
            cut = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
            if cut:
                yield from solve([np.ascontiguousarray(x[:cut]) for x in held])
                held = [x[cut:] for x in held]
    if held is not None and held[0].size:
        yield from solve([np.ascontiguousarray(x) for x in held])


def _marked(filed: DataFrame, hot: DataFrame, most: int = 1000) -> DataFrame:
    """filed, with the bits that its subtrie is cut by, null for most. Subtries with more than a share of one in most
    of the rows are at most as many, so they are broadcast and their rows don't move. Others, which only large tables
    have, are joined by a shuffle, in which no key has a larger share."""
    limit = filed.count() // most
    large = hot.where(F.col("n") > limit).select("block", "top", "bits")
    marked = filed.join(F.broadcast(large), ["block", "top"], "left")
    rest = hot.where(F.col("n") <= limit)
    if rest.isEmpty():
        return marked
    other = marked.where("bits is null").drop("bits").join(rest.select("block", "top", "bits").hint("shuffle_merge"), ["block", "top"], "left")
    return marked.where("bits is not null").unionByName(other)


def hamming_links(prints: DataFrame, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """prints: distinct fp (long). Returns links a, b between fingerprints at most two bits apart: not every
    pair, but enough that whatever is linked by pairs is linked by them."""
    filed = prints.select(F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("block"), F.shiftrightunsigned(_rotated(F.col("fp"), s), 64 - w).alias("top"), _rotated(F.col("fp"), s).alias("value")) for k, (s, w) in enumerate(BLOCKS)])).alias("x")).select("x.*")
    plain = [F.lit(0).cast("long").alias(n) for n in ("lo", "hi", "side")]
    hot = materialise(filed.groupBy("block", "top").agg(F.count(F.lit(1)).alias("n"), F.array(*[F.sum(F.getbit("value", F.lit(b)).cast("long")) for b in range(64)]).alias("ones")).where(F.col("n") > group_limit), "hot")
    widest = hot.agg(F.max("n")).first()[0]
    if widest is None:
        rows = filed.select("block", "top", "value", *plain)
    else:
        depth = min(12, max(1, math.ceil(math.log2(widest / group_limit)) + 2))
        # the most even bits make the top levels of a hot subtrie
        even = F.slice(F.array_sort(F.transform("ones", lambda x, i: F.struct(F.abs(2 * x - F.col("n")), i.alias("bit")))), 1, depth)
        node = F.aggregate("bits", F.lit(0).cast("long"), lambda acc, b: acc * 2 + F.getbit("value", b))
        near = [0, *(1 << i for i in range(depth)), *((1 << i) | (1 << j) for i, j in itertools.combinations(range(depth), 2))]
        marked = _marked(filed, materialise(hot.select("block", "top", "n", F.transform(even, lambda x: x["bit"]).alias("bits")), "cuts"))
        other = F.col("node").bitwiseXOR(F.col("mask"))
        cut = marked.where("bits is not null").withColumn("node", node).withColumn("mask", F.explode(F.array(*[F.lit(m).cast("long") for m in near])))
        cut = cut.select("block", "top", "value", F.least("node", other).alias("lo"), F.greatest("node", other).alias("hi"), (F.col("node") > other).cast("long").alias("side"))
        rows = marked.where("bits is null").select("block", "top", "value", *plain).unionByName(cut)
    # unsigned order: flip the sign bit
    rows = rows.select("block", "top", "lo", "hi", "side", "value").repartition("block", "top", "lo", "hi")
    rows = rows.sortWithinPartitions("block", "top", "lo", "hi", "side", F.col("value").bitwiseXOR(F.lit(-(2**63)).cast("long")))
    return rows.mapInArrow(_linked, "a long, b long")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """One row for each input row: rid, doc_id, fingerprint (16 lower-case hex digits), component_id (smallest
    doc_id reachable over links of at most two differing bits, itself included), root (a fingerprint of the
    component, which no other has; ids that are null or repeated make component_id ambiguous).

    Null, empty and blank texts have no words and the fingerprint zero, which links like any other. Repeated
    rows and ties share a component; a null doc_id is never a component's smallest unless all are null; an
    empty table gives an empty result; other columns, whatever their names, are ignored. row_col: a column
    that already numbers the rows, returned as rid.
    """
    bound_batches(docs.sparkSession)
    rid = F.col(f"`{row_col}`") if row_col else F.monotonically_increasing_id()
    rows = materialise(docs.select(rid.alias("rid"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), fingerprint_column()(F.col(f"`{text_col}`").cast("string")).alias("fp")), "fingerprints")
    prints = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("size")), "prints")
    roots = materialise(connected_components(hamming_links(prints.select("fp"), group_limit)), "roots")
    named = prints.join(roots, prints["fp"] == roots["node"], "left").select("fp", "least", "size", F.coalesce("root", "fp").alias("root"))
    named = materialise(named, "named")
    comps = named.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("prints"))
    total = rows.count()
    named = materialise(attach_group(named, comps, "root", "prints", total).select("fp", "size", "component_id", "root"), "classes")
    return attach_group(rows, named, "fp", "size", total).select("rid", "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "root")
