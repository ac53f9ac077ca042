"""Language-model scoring with a log-bilinear neural model, trained in numpy by noise-contrastive estimation.

Words are counted over the whole training fold. The model predicts units: the most frequent words, the text's end,
and classes of the other words by how they end; a word within a class has its smoothed share of the class. The
two units before a unit each have a vector for their position; the sum of the two is the predicted vector, whose
inner product with a unit's vector, plus the unit's bias, is that unit's score.

Training tells each text's units from units drawn from the noise, the smoothed unigram, in small batches. It
starts on the driver with a bounded sample, and goes on over the whole training fold: every task goes on from
there over its own texts, and the mean of the tasks' parameters, weighted by their tokens, is the model. A score
is a sum of one term for each position, so a matrix product of the exponentials of these terms gives the
normaliser of every pair of contexts at once, and log-probabilities are exact.

Scoring looks common words up in a table of bounded size that every task holds; rarer words, by their 64-bit
hashes, get their counts by a shuffled join, and each text's sum comes back by a second one.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statweave.llm.common import SLICE_BYTES, bound_batches, byte_pieces, fold, lower_ascii, materialise, mix64, span_hashes, text_buffers, text_slices, word_spans

#: Hash of a text's end: no word's, as word hashes go through mix64 and this is held out of theirs.
END = np.uint64(0)
#: Words with a unit of their own, besides the end; classes of other words; words whose counts all tasks hold.
HEAD_UNITS, TAIL_CLASSES, KNOWN_WORDS = 831, 192, 262144
#: Length of the vectors, noise units drawn for a batch, tokens of a batch.
DIMENSIONS, NOISE, BATCH = 32, 128, 1024
#: Tokens that training starts with on the driver, about; it takes them from texts of at most so many tokens.
START_TOKENS, START_TEXT = 1_000_000, 50_000
SMOOTH = 0.1


def pieces(text: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """The bytes and offsets of a run of texts, or of a long text piece by piece, and whether texts end there."""
    data, offsets = text_buffers(text)
    if data.size <= 4 * SLICE_BYTES:
        yield data, offsets, True
        return
    left = data.size
    for piece in byte_pieces(data.tobytes()):
        left -= len(piece)
        yield np.frombuffer(piece, np.uint8), np.array([0, len(piece)]), not left


def tokens(data: np.ndarray, offsets: np.ndarray, ended: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, class and row of each token in order, with the ends of texts that end there."""
    data = lower_ascii(data)
    starts, ends, rows = word_spans(data, offsets)
    n = len(offsets) - 1
    hashes = span_hashes(data, starts, ends)
    hashes[hashes == END] = 1
    kinds = np.zeros(starts.size, np.int64)
    if starts.size:
        last = data[ends - 1].astype(np.uint64)
        second = np.where(ends - starts > 1, data[np.maximum(ends - 2, 0)], 0).astype(np.uint64)
        third = np.where(ends - starts > 2, data[np.maximum(ends - 3, 0)], 0).astype(np.uint64)
        kinds = (mix64(last << np.uint64(16) | second << np.uint64(8) | third) % np.uint64(TAIL_CLASSES)).astype(np.int64)
    if not ended:
        return hashes, kinds, rows
    where = np.searchsorted(rows, np.arange(n), side="right")  # an end goes after its row's words
    return np.insert(hashes, where, END), np.insert(kinds, where, -1), np.insert(rows, where, np.arange(n))


class HashTable:
    """Open addressing over unsigned 64-bit keys, for lookups of whole arrays."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = keys
        self.bits = max(4, int(2 * max(1, keys.size) - 1).bit_length())
        self.mask = (1 << self.bits) - 1
        self.slots = np.full(1 << self.bits, -1, np.int64)
        todo, at = np.arange(keys.size), self._home(keys)
        while todo.size:
            free = self.slots[at] < 0
            self.slots[at[free]] = todo[free]  # of several, one stays
            left = self.slots[at] != todo
            todo, at = todo[left], (at[left] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Each key's index, or -1."""
        out = np.full(keys.size, -1, np.int64)
        todo, at = np.arange(keys.size), self._home(keys)
        while todo.size:
            slot = self.slots[at]
            used = slot >= 0
            todo, at, slot = todo[used], at[used], slot[used]
            hit = self.keys[slot] == keys[todo]
            out[todo[hit]] = slot[hit]
            todo, at = todo[~hit], (at[~hit] + 1) & self.mask
        return out


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word counts of a few million tokens at a time."""
    names = ["h", "kind", "n"]

    def merged(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        h, kind, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        keys, first, back = np.unique(h, return_index=True, return_inverse=True)
        total = np.bincount(back, weights=n).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(kind[first]), pa.array(total)], names=names)

    parts, held = [], 0
    for text in (batch.column("text") for batch in batches):
        for i, j in text_slices(text):
            for piece in pieces(text.slice(i, j - i)):
                h, kind, _ = tokens(*piece)
                parts.append((h, kind, np.ones(h.size, np.int64)))
                held += h.size
                if held >= 2_000_000:
                    yield merged(parts)
                    parts, held = [], 0
    if held:
        yield merged(parts)


@dataclass
class Vocabulary:
    """What every task holds: hashes and counts of the most frequent words, their units (-1: by class), and
    for each class the words and tokens outside the units."""

    hashes: np.ndarray
    counts: np.ndarray
    units: np.ndarray
    class_words: np.ndarray
    class_tokens: np.ndarray
    train_tokens: int
    distinct: int

    @property
    def size(self) -> int:
        return 1 + HEAD_UNITS + TAIL_CLASSES

    def unit_of(self, found: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        unit = np.where(found >= 0, self.units[found] if self.units.size else -1, -1)
        unit = np.where(unit < 0, 1 + HEAD_UNITS + kinds, unit)
        return np.where(kinds < 0, 0, unit)  # the end is unit 0, counted or not


def vocabulary(counts: DataFrame) -> Vocabulary:
    """counts: h, kind, n. The driver gets at most KNOWN_WORDS rows, one for each class, and one for each of at most
    4,096 steps of a scale of counts, on which it finds the least count whose words, with all more frequent ones,
    still fit; so no task sorts or gathers words."""
    step = F.floor(64 * F.log2("n")).cast("int")
    room, least = KNOWN_WORDS, None
    for r in counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("step")).collect():
        room -= r["words"]
        if room < 0:
            break
        least = r["step"]
    top = counts.where(step >= least if least is not None else F.lit(False)).toArrow().combine_chunks().sort_by([("n", "descending"), ("h", "ascending")])
    hashes, kinds, n = (top.column(c).to_numpy() for c in ("h", "kind", "n"))
    hashes = hashes.view(np.uint64)
    units = np.full(hashes.size, -1, np.int64)
    words = np.flatnonzero(kinds >= 0)[:HEAD_UNITS]
    units[words] = 1 + np.arange(words.size)
    class_words, class_tokens = np.zeros(TAIL_CLASSES), np.zeros(TAIL_CLASSES)
    total = distinct = 0
    for r in counts.groupBy("kind").agg(F.count(F.lit(1)).alias("v"), F.sum("n").alias("n")).collect():
        total, distinct = total + r["n"], distinct + r["v"]
        if r["kind"] >= 0:
            class_words[r["kind"]], class_tokens[r["kind"]] = r["v"], r["n"]
    np.subtract.at(class_words, kinds[words], 1)
    np.subtract.at(class_tokens, kinds[words], n[words])
    return Vocabulary(hashes, n, units, class_words, class_tokens, total, distinct)


@dataclass
class LogBilinear:
    """one and two: the vectors of the last unit and of the one before it; unit, bias: of the predicted unit."""

    one: np.ndarray
    two: np.ndarray
    unit: np.ndarray
    bias: np.ndarray

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.one, self.two, self.unit, self.bias)])

    @staticmethod
    def of(values: np.ndarray, size: int) -> LogBilinear:
        d = (values.size - size) // (3 * size)
        one, two, unit = values[: 3 * size * d].reshape(3, size, d).astype(np.float32)
        return LogBilinear(one, two, unit, values[3 * size * d :].astype(np.float32))

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The terms of a unit's score by the unit before it and by the one before that, and the logarithm of the
        normaliser for each pair of those, all by matrix products."""
        last, second = self.one @ self.unit.T, self.two @ self.unit.T + self.bias
        high, higher = last.max(axis=1, keepdims=True), second.max(axis=1, keepdims=True)
        total = np.exp(last - high) @ np.exp(second - higher).T
        return last, second, np.log(total) + high + higher.T


class Trainer:
    """Noise-contrastive estimation in batches, with steps that shrink as a parameter's gradients add up."""

    def __init__(self, model: LogBilinear, noise: np.ndarray, draws: int = NOISE, rate: float = 0.1, calm: float = 1e-6, seed: int = 7) -> None:
        self.p = [x.copy() for x in (model.one, model.two, model.unit, model.bias[:, None])]
        self.sums = [np.full_like(x, calm) for x in self.p]
        self.below, self.draws, self.rate = np.cumsum(noise), draws, rate
        self.log_noise = np.log(draws * noise).astype(np.float32)
        self.rng = np.random.default_rng(seed)

    def model(self) -> LogBilinear:
        return LogBilinear(*self.p[:3], self.p[3][:, 0])

    def _move(self, k: int, where: np.ndarray, gradient: np.ndarray) -> None:
        order = np.argsort(where, kind="stable")
        where = where[order]
        first = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
        rows, total = where[first], np.add.reduceat(gradient[order], first, axis=0)
        self.sums[k][rows] += total * total
        self.p[k][rows] += self.rate * total / np.sqrt(self.sums[k][rows])

    def step(self, last: np.ndarray, second: np.ndarray, unit: np.ndarray) -> None:
        """One batch: its units against as many drawn ones, which all its contexts share."""
        drawn = np.minimum(np.searchsorted(self.below, self.rng.random(self.draws)), len(self.below) - 1)
        one, two, units, bias = self.p
        context, own, other = one[last] + two[second], units[unit], units[drawn]
        real = (context * own).sum(axis=1) + bias[unit, 0] - self.log_noise[unit]
        fake = context @ other.T + (bias[drawn, 0] - self.log_noise[drawn])
        up = 1 / (1 + np.exp(np.clip(real, -30, 30)))  # gradients of the objective by the scores
        down = -1 / (1 + np.exp(-np.clip(fake, -30, 30)))
        d_context = up[:, None] * own + down @ other
        both = np.concatenate([unit, drawn])
        moves = [(2, both, np.concatenate([up[:, None] * context, down.T @ context])), (3, both, np.concatenate([up, down.sum(axis=0)])[:, None]), (0, last, d_context), (1, second, d_context)]
        for move in moves:
            self._move(*move)

    def run(self, stream: Iterator[np.ndarray]) -> int:
        """Learns from texts, each an array of units that ends with the end; returns how many tokens they had."""
        seen, held, size = 0, [], 0
        for text in itertools.chain(stream, [None]):
            if text is not None:
                held.append(contexts(text))
                size += text.size
            if size >= BATCH or (text is None and size):
                columns = [np.concatenate(x) for x in zip(*held, strict=True)]
                for at in range(0, size, BATCH):
                    self.step(*(x[at : at + BATCH] for x in columns))
                seen, held, size = seen + size, [], 0
        return seen


def contexts(units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each unit of a text the one before it, the one before that (ends before the text begins), and itself."""
    before = np.concatenate([np.zeros(2, units.dtype), units])
    return before[1:-1], before[:-2], units


def untrained(noise: np.ndarray, dimensions: int = DIMENSIONS, seed: int = 7) -> LogBilinear:
    rng = np.random.default_rng(seed)
    one, two, unit = rng.normal(0, 0.1, (3, noise.size, dimensions)).astype(np.float32)
    return LogBilinear(one, two, unit, np.log(noise).astype(np.float32))


MEASURED = "rid long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, inside double, rare array<long>, units binary"


def measure(source: DataFrame, words: Vocabulary) -> DataFrame:
    """Each text's tokens, counted and turned into units, two bytes each; base: the logarithms of known words' counts,
    inside: of words' shares in their classes, both without those of rare words, whose hashes come along."""
    held = source.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = held.value
        table = HashTable(v.hashes)
        log_count, floor = np.log10(v.counts + SMOOTH), np.log10(SMOOTH)
        log_class = np.log10(v.class_tokens + SMOOTH * (v.class_words + 1))
        partial = v.distinct > v.hashes.size  # else the table has all words, and what it lacks is unknown
        for batch in batches:
            text = batch.column("text")
            for i, j in text_slices(text):
                n = j - i
                sums, parts = np.zeros((4, n)), []
                for piece in pieces(text.slice(i, n)):
                    h, kinds, rows = tokens(*piece)
                    at = table.find(h)
                    known = at >= 0
                    unit = v.unit_of(at, kinds)
                    share = np.where(known, log_count[at] if log_count.size else floor, np.where(partial & (kinds >= 0), 0.0, floor))
                    own = np.where((unit > HEAD_UNITS) & (kinds >= 0), share - log_class[np.maximum(kinds, 0)], 0.0)
                    rare = ~known & (kinds >= 0) & partial  # an end that was never trained on isn't looked up
                    sums += [np.bincount(rows, weights=x, minlength=n)[:n] for x in (np.ones(h.size), known, share, own)]
                    parts.append((unit.astype("<u2"), rows, h[rare], rows[rare]))
                unit, rows, rare, rare_rows = (np.concatenate(x) for x in zip(*parts, strict=True))
                edges, rare_edges = (np.searchsorted(x, np.arange(n + 1)).astype(np.int32) for x in (rows, rare_rows))
                units = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(2 * edges), pa.py_buffer(unit.tobytes())])
                rares = pa.ListArray.from_arrays(pa.array(rare_edges), pa.array(rare.view(np.int64)))
                counted = [pa.array(x.astype(np.int64)) for x in sums[:2]] + [pa.array(x) for x in sums[2:]]
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(i, n) for c in ("rid", "doc_id", "held_out")] + [*counted, rares, units], names=[x.split()[0] for x in MEASURED.split(", ")])

    return materialise(source.mapInArrow(run, MEASURED), "measured")


def train(measured: DataFrame, words: Vocabulary) -> LogBilinear:
    """The model of measured's texts. What tasks send is one row for each parameter, whatever the texts; parameters
    are averaged as whole numbers, so that the order of the sum doesn't matter."""
    spark = measured.sparkSession
    noise = np.bincount(np.where(words.units >= 0, words.units, 0), weights=words.counts * (words.units >= 0), minlength=words.size).astype(np.float64)
    noise[0] += words.counts[words.hashes == END].sum()
    noise[1 + HEAD_UNITS :] += words.class_tokens
    noise = (noise + SMOOTH) / (noise + SMOOTH).sum()
    learned = measured.where("not held_out")
    share = START_TOKENS / max(1, words.train_tokens)
    start = learned.where((F.pmod(F.xxhash64("rid"), F.lit(1 << 30)) < share * (1 << 30)) & (F.col("n_tokens") <= START_TEXT)).select("rid", "units").toArrow().sort_by("rid")
    trainer = Trainer(untrained(noise), noise)
    trainer.run(np.frombuffer(x.as_py(), "<u2") for x in start.column("units"))
    begun = spark.sparkContext.broadcast((trainer.model(), noise))
    scale = 1 << 20

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, noise = begun.value
        own = Trainer(model, noise, rate=0.02, calm=0.1)
        seen = own.run(np.frombuffer(x.as_py(), "<u2") for batch in batches for x in batch.column("units"))
        if seen:
            weight = -(-seen // BATCH)
            values = np.rint(own.model().flat().astype(np.float64) * scale).astype(np.int64) * weight
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(values.size)), pa.array(values), pa.array(np.full(values.size, weight))], names=["at", "value", "weight"])

    got = learned.select("units").mapInArrow(run, "at long, value long, weight long").groupBy("at").agg(F.sum("value").alias("value"), F.sum("weight").alias("weight")).toArrow().sort_by("at")
    if not got.num_rows:
        return trainer.model()
    return LogBilinear.of(got.column("value").to_numpy() / got.column("weight").to_numpy() / scale, words.size)


_ready: dict[int, tuple[np.ndarray, ...]] = {}


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, held_out: int = 0) -> DataFrame:
    """One row for each input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, rid.

    Learned from are the rows whose crc32 of the id as text, by folds, is not held_out. Null and empty texts
    are one token, the end. Repeated rows each count and get their own result; a long text is read in pieces;
    an empty table gives an empty result, and without training rows every word is unknown to both models; other
    columns, whatever their names, are ignored.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    source = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), (fold(F.col(f"`{id_col}`"), folds) == held_out).alias("held_out"))
    counts = materialise(source.where("not held_out").select("text").mapInArrow(_counts, "h long, kind long, n long").groupBy("h").agg(F.max("kind").alias("kind"), F.sum("n").alias("n")), "word_counts")
    words = vocabulary(counts)
    measured = measure(source, words)
    model = spark.sparkContext.broadcast(train(measured, words))
    key = model._jbroadcast.id() if model._jbroadcast is not None else id(model)

    @F.arrow_udf("double")
    def by_model(units: pa.Array) -> pa.Array:
        if key not in _ready:  # once for a worker
            _ready.clear()
            _ready[key] = model.value.tables()
        last, second, total = _ready[key]
        out = np.zeros(len(units))
        for i, x in enumerate(units):
            text = np.frombuffer(x.as_py(), "<u2")
            for at in range(0, text.size, 1 << 20):  # with the two units before, whose own terms are left out
                a, b, w = (c[min(at, 2) :] for c in contexts(text[max(0, at - 2) : at + (1 << 20)]))
                out[i] += (last[a, w].astype(np.float64) + second[b, w] - total[a, b]).sum()
        return pa.array(out / np.log(10))

    scored = materialise(measured.select("rid", "doc_id", "held_out", "n_tokens", "n_known", "base", (by_model("units") + F.col("inside")).alias("model")), "scored")
    rare = measured.select("rid", F.explode("rare").alias("h")).groupBy("rid", "h").agg(F.count(F.lit(1)).alias("k"))
    rare = rare.join(counts.select("h", "n"), "h", "left").groupBy("rid").agg(F.sum(F.col("k") * F.log10(F.coalesce("n", F.lit(0)) + SMOOTH)).alias("more"), F.sum(F.when(F.col("n").isNotNull(), F.col("k")).otherwise(0)).alias("more_known"))
    spread = float(np.log10(words.train_tokens + SMOOTH * (words.distinct + 1)))
    out = scored.join(rare, "rid", "left")
    more = F.coalesce("more", F.lit(0.0))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(words.train_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + more - F.col("n_tokens") * spread).alias("base_score"), (F.col("model") + more).alias("score"), "rid",
    )
