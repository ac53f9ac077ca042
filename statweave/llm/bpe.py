"""Byte-level BPE encoding by content-defined chunks, and decoding.

A rolling hash over the last few characters cuts each text where the hash says, so passages that documents
share are cut alike. A chunk's encoding is kept and reused for every later copy, within a bounded cache in
each worker. Ids can differ near a cut, so each join is repaired: the stretch from the last place where the
chunk before it must agree with the whole text to the first such place in a chunk after it is encoded again.
Such a place is a space or line feed after a character that is not white space: no pre-token of the pattern
goes on there, and the pattern never looks back, so on both sides of it the ids are those of the whole text
whatever surrounds them. A chunk without such a place is encoded again whole, with its neighbours.
"""

from __future__ import annotations

import codecs
import hashlib
import re
from collections import OrderedDict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statweave.llm.common import bound_batches, sliced_batches, tokenizer_path

#: How a byte-level tokenizer splits text before merging; a fixed value of the public vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters that the rolling hash covers; a power of two.
ROLL = 16
#: A cut comes on average after this many characters beyond the least; a power of two.
MEAN = 1024
LEAST, MOST = 256, 8192
#: Characters of chunks that a worker's cache keeps.
CACHE_CHARS = 16_000_000
#: Characters, and ids, that are worked on at once.
PIECE = 1 << 17


def _hits(text: str) -> np.ndarray:
    """Places after which the rolling hash hits, found by blocks, each with the characters before it that its first
    windows cover."""
    factor, found = 0x9E3779B97F4A7C15, []
    for begin in range(0, len(text), PIECE):
        before = min(begin, ROLL - 1)
        value = np.frombuffer(text[begin - before : begin + PIECE].encode("utf-32-le", "surrogatepass"), np.uint32) * np.uint64(0xD6E8FEB86659FD93)
        span = 1
        while span < ROLL:  # a window of twice the span is the older half, shifted, plus the newer one
            value[span:] += value[:-span] * np.uint64(pow(factor, span, 1 << 64))
            span *= 2
        found.append(np.flatnonzero((value[before:] >> np.uint64(40)) & np.uint64(MEAN - 1) == 0) + (begin + 1))
    return np.concatenate(found)


def cuts(text: str) -> list[int]:
    """Where text is cut: after characters where the rolling hash hits, LEAST to MOST apart."""
    n = len(text)
    if n <= LEAST:
        return [n] if n else []
    hits = _hits(text)
    out, last = [], 0
    while n - last > MOST or (hits.size and hits[-1] >= last + LEAST):
        k = int(np.searchsorted(hits, last + LEAST))
        at = min(int(hits[k]) if k < hits.size else n, last + MOST)
        if at >= n:
            break
        out.append(at)
        last = at
    return [*out, n]


#: A place where a pre-token begins in every context, one character on.
_AGREED = re.compile(r"\S[ \n]")


class Chunk:
    """A chunk's ids; the first and last agreed place in it, and how many ids lie before and after those."""

    __slots__ = ("first", "head", "ids", "last", "tail")

    def __init__(self, encoder: Encoder, text: str) -> None:
        self.ids = encoder.plain(text)
        found = _AGREED.search(text)
        self.first = self.last = found.start() + 1 if found else -1
        reach = 64
        while found and self.last == self.first:
            places = [m.start() + 1 for m in _AGREED.finditer(text, max(self.first, len(text) - reach))]
            if places or reach >= len(text):
                self.last = places[-1] if places else self.first
                break
            reach *= 4
        self.head = len(encoder.plain(text[: self.first])) if found else 0
        self.tail = len(encoder.plain(text[self.last :])) if found else 0


class Encoder:
    """Encodes whole texts exactly as the tokenizers library does with the file at path, reusing chunks.

    The file's vocabulary and merges also drive a second public implementation of the same merges, several
    times faster on one core; it is used only if the file's ids rise with its merges, which makes both equal.
    """

    def __init__(self, path: str, cache_chars: int = CACHE_CHARS) -> None:
        import json

        import tiktoken

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        joined = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in merges]
        if any(x >= y for x, y in zip(joined, joined[1:], strict=False)) or spec["normalizer"] or spec["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError("not a plain byte-level BPE whose ids rise with its merges")
        self.special = [(x["content"], x["id"]) for x in spec["added_tokens"]]
        back = {c: bytes([b]) for b, c in byte_characters().items()}
        names = {i: content for content, i in self.special}
        ranks = {b"".join(back[c] for c in token): i for token, i in vocab.items() if i not in names}
        self.bytes = [b""] * (1 + max([*vocab.values(), *names]))
        for token, i in ranks.items():
            self.bytes[i] = token
        for i, content in names.items():
            self.bytes[i] = content.encode()
        self._encode = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.cache: OrderedDict[str, Chunk] = OrderedDict()
        self.cache_chars, self.held, self.reused = cache_chars, 0, 0

    def plain(self, text: str) -> np.ndarray:
        return np.array(self._encode(text), np.uint32)

    def chunk(self, text: str) -> Chunk:
        found = self.cache.get(text)
        if found is not None:
            self.cache.move_to_end(text)
            self.reused += 1
            return found
        found = self.cache[text] = Chunk(self, text)
        self.held += len(text)
        while self.held > self.cache_chars and len(self.cache) > 1:
            self.held -= len(self.cache.popitem(last=False)[0])
        return found

    def encode(self, text: str) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.uint32), *self.parts(text)])

    def parts(self, text: str) -> Iterator[np.ndarray]:
        """The text's ids in order, a few thousand at a time."""
        return self._around_special(text, self._joined)

    def whole(self, text: str) -> np.ndarray:
        """The same ids without reuse of chunks; less work where little repeats."""
        return np.concatenate([np.zeros(0, np.uint32), *self._around_special(text, self._in_pieces)])

    def _around_special(self, text: str, encode: Callable[[str], Iterator[np.ndarray]]) -> Iterator[np.ndarray]:
        """Added tokens' strings split the text before anything else, as in the tokenizer."""
        for content, number in self.special:
            if content in text:
                for i, x in enumerate(text.split(content)):
                    if i:
                        yield np.array([number], np.uint32)
                    yield from self._around_special(x, encode)
                return
        yield from encode(text)

    def _in_pieces(self, text: str) -> Iterator[np.ndarray]:
        """Each piece ends at the first agreed place after PIECE characters."""
        at = 0
        while at < len(text):
            found = _AGREED.search(text, at + PIECE)
            stop = found.start() + 1 if found else len(text)
            yield self.plain(text[at:stop])
            at = stop

    def _joined(self, text: str) -> Iterator[np.ndarray]:
        ends = cuts(text)
        if len(ends) < 2:
            yield self.plain(text)
            return
        start, at = 0, 0  # at: a pre-token of the whole text begins there, and all before it has been given
        for end in ends:
            chunk = self.chunk(text[start:end])
            whole_head, whole_tail = start == 0, end == len(text)
            if chunk.first >= 0 or (whole_head and whole_tail):
                if not whole_head:
                    yield self.plain(text[at : start + chunk.first])
                yield chunk.ids[0 if whole_head else chunk.head : chunk.ids.size if whole_tail else chunk.ids.size - chunk.tail]
                at = end if whole_tail else start + chunk.last
            start = end
        yield self.plain(text[at:])

    def decode(self, ids: np.ndarray) -> str:
        return "".join(self.decoded([ids]))

    def decoded(self, parts: Iterable[np.ndarray]) -> Iterator[str]:
        """The text of the ids, a part at a time; a character may go over the end of a part."""
        table, decoder = self.bytes, codecs.getincrementaldecoder("utf-8")("replace")
        for part in parts:
            for i in range(0, part.size, PIECE):
                yield decoder.decode(b"".join([table[k] for k in part[i : i + PIECE].tolist()]))
        yield decoder.decode(b"", True)

    def digests(self, text: str) -> tuple[int, str, str]:
        """How many ids a text has, and the SHA-256 of them, joined by commas, and of the text that they stand for."""
        names, n = hashlib.sha256(), 0
        back = hashlib.sha256()

        def counted() -> Iterator[np.ndarray]:
            nonlocal n
            for part in self.parts(text):
                for i in range(0, part.size, PIECE):
                    some = part[i : i + PIECE]
                    names.update(("," * bool(n) + ",".join(map(str, some.tolist()))).encode())
                    n += some.size
                    yield some

        for piece in self.decoded(counted()):
            back.update(piece.encode("utf-8"))
        return n, names.hexdigest(), back.hexdigest()


def byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary: itself if printable in
    Latin-1 and not a space or soft hyphen, else the next free code point from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


_encoders: dict[str, Encoder] = {}


def encoder(path: str | None = None) -> Encoder:
    """This process's encoder, with its cache, for all tasks that it runs."""
    path = tokenizer_path(path)
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def bpe_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """doc_id, ids (array of int) and decoded (the text that the ids stand for) of each row. Null counts as
    empty and has no ids; repeated rows each get their own; an empty table gives an empty result; other
    columns, whatever their names, are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        for batch in sliced_batches(batches):
            ids = [own.encode(t or "") for t in batch.column("text").to_pylist()]
            arrays = [batch.column("doc_id"), pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())), pa.array([own.decode(x) for x in ids], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "ids", "decoded"])

    bound_batches(docs.sparkSession)
    return _source(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def bpe_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row; as bpe_ids, but only digests leave the worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        for batch in sliced_batches(batches):
            rows = [own.digests(text or "") for text in batch.column("text").to_pylist()]
            columns = list(zip(*rows, strict=True)) if rows else [(), (), ()]
            arrays = [batch.column("doc_id"), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    bound_batches(docs.sparkSession)
    return _source(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
