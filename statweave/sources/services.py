"""Embedding, generation and reranking services behind small interfaces, with offline implementations.

An implementation is a picklable callable from a list of texts (or pairs) to a list of results; it is called
with whole Arrow batches on the executors. Calls that keep failing give an empty answer with the error's text,
or a null vector, and never stop the job.
"""

from __future__ import annotations

import copy
import hashlib
import math
import re
import threading
import time
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

Embedder = Callable[[list[str]], list[list[float]]]
Generator = Callable[[list[str]], list[str]]
Reranker = Callable[[list[tuple[str, str]]], list[float]]


def retried(call: Callable, items: list, tries: int = 3, wait: float = 0.0) -> tuple[list | None, str | None]:
    error = None
    for attempt in range(tries):
        try:
            return call(items), None
        except Exception as e:  # a service may fail in any way; the error's text goes to the result
            error = f"{type(e).__name__}: {e}"
            if attempt + 1 < tries:
                time.sleep(wait * 2**attempt)
    return None, error


#: Least answer lengths in tokens, for models in general and for those that reason within it.
LEAST_TOKENS, LEAST_REASONING_TOKENS = 512, 1024


class ChatService:
    """A generator that asks a chat model, one call for each prompt. post takes a request (model, messages, temperature,
    max_tokens, top_p and what else the model needs) and returns the response as nested dicts. An answer without content
    is the model's reasoning, else empty. reasoning and plain name models, by part of their name, whose reasoning counts
    as part of the answer, and whose reasoning is switched off."""

    def __init__(self, post: Callable[[dict], dict], model: str, system: str = "", temperature: float = 0.1, max_tokens: int = 512, top_p: float = 0.9, tries: int = 3, wait: float = 5.0, reasoning: tuple[str, ...] = ("glm", "gpt-oss"), plain: tuple[str, ...] = ("qwen3", "qwen-3.6")) -> None:
        self.post, self.model, self.system, self.temperature, self.tries, self.wait = post, model, system, temperature, tries, wait
        named = lambda names: any(n in model.lower() for n in names)
        self.extra: dict = {"chat_template_kwargs": {"enable_thinking": False}} if named(plain) else {}
        self.max_tokens, self.top_p = max(max_tokens, LEAST_REASONING_TOKENS if named(reasoning) else LEAST_TOKENS), top_p

    def at(self, temperature: float) -> ChatService:
        """The same service at another temperature."""
        other = copy.copy(self)
        other.temperature = temperature
        return other

    def __call__(self, prompts: list[str]) -> list[str]:
        return [self._answer(p) for p in prompts]

    def _answer(self, prompt: str) -> str:
        messages = [{"role": "system", "content": self.system}] if self.system else []
        request = {"model": self.model, "messages": [*messages, {"role": "user", "content": prompt}], "temperature": self.temperature, "max_tokens": self.max_tokens, "top_p": self.top_p, **self.extra}
        got, error = retried(lambda of: [self.post(of[0])], [request], self.tries, self.wait)
        if error:
            raise RuntimeError(error)
        said = got[0]["choices"][0]["message"]
        text = said.get("content")
        return text if text is not None else said.get("reasoning_content") or said.get("reasoning") or ""


def tuned(call: Generator, temperature: float | None, seed: int | None = None) -> Generator:
    """call at a temperature and with a seed, where it heeds them."""
    call = call.at(temperature) if temperature is not None and hasattr(call, "at") else call
    return call.seeded(seed) if seed is not None and hasattr(call, "seeded") else call


class WanderingGenerator:
    """Offline: answers with the context's first fact; in a share of the prompts that grows with the temperature from none
    to all, drawn by the seed and the question, with its last. Without facts, that there is none."""

    def __init__(self, temperature: float = 0.5, seed: int = 0) -> None:
        self.temperature, self.seed = temperature, seed

    def at(self, temperature: float) -> WanderingGenerator:
        return WanderingGenerator(temperature, self.seed)

    def seeded(self, seed: int) -> WanderingGenerator:
        return WanderingGenerator(self.temperature, seed)

    def __call__(self, prompts: list[str]) -> list[str]:
        return [self._answer(p or "") for p in prompts]

    def _answer(self, prompt: str) -> str:
        facts = [line.split("] ", 1)[1] for line in prompt.splitlines() if re.match(r"\[\d+\] ", line)]
        drawn = int(hashlib.md5(f"{self.seed}:{prompt.rpartition('Question: ')[2]}".encode()).hexdigest()[:7], 16)
        return facts[-1 if drawn < self.temperature * 2**28 else 0] if facts else "Not known"


def supporting_verifier(word: str = "CONTRADICTED") -> Generator:
    """Offline: says word if the answer in a prompt doesn't stand in its facts, else that it is supported."""

    def verify(prompts: list[str]) -> list[str]:
        out = []
        for p in prompts:
            facts, _, answer = (p or "").rpartition("\nAnswer: ")
            out.append("SUPPORTED" if answer and answer in facts else word)
        return out

    return verify


def shortest_reranker() -> Reranker:
    """Offline: the shorter a document, the better."""

    def score(pairs: list[tuple[str, str]]) -> list[float]:
        return [-float(len(d)) for _, d in pairs]

    return score


class Throttle:
    """At most calls in each window of so many seconds, counted anew when a window is over; for one caller. A unit of
    work that makes several calls waits for all of them at once."""

    def __init__(self, calls: int = 30, seconds: float = 60.0, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> None:
        self.calls, self.seconds, self.clock, self.sleep = calls, seconds, clock, sleep
        self.began, self.used = clock(), 0

    def wait(self, units: int = 1) -> None:
        now = self.clock()
        if now - self.began >= self.seconds:
            self.began, self.used = now, 0
        if self.used and self.used + units > self.calls:
            self.sleep(self.seconds - (now - self.began))
            self.began, self.used = self.clock(), 0
        self.used += units


class Throttled:
    """A service that keeps to a budget of calls: each item is asked for by itself, after it has waited for as many calls
    as it stands for. The budget is a worker's; with several workers at a time, give each its share."""

    def __init__(self, call: Callable, calls: int = 30, seconds: float = 60.0, units: int = 1, **clock: Callable) -> None:
        self.call, self.calls, self.seconds, self.units, self.clock = call, calls, seconds, units, clock
        self.throttle: Throttle | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"throttle": None}  # each worker counts anew

    def at(self, temperature: float) -> Throttled:
        other = copy.copy(self)
        other.call = tuned(self.call, temperature)
        return other

    def seeded(self, seed: int) -> Throttled:
        other = copy.copy(self)
        other.call = tuned(self.call, None, seed)
        return other

    def __call__(self, items: list) -> list:
        if self.throttle is None:
            self.throttle = Throttle(self.calls, self.seconds, **self.clock)
        out = []
        for item in items:
            self.throttle.wait(self.units)
            out += self.call([item])
        return out


class Budget:
    """At most so many calls in any stretch of so many seconds, for the threads of one worker."""

    def __init__(self, calls: int, seconds: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> None:
        self.seconds, self.clock, self.sleep = seconds, clock, sleep
        self.made: deque[float] = deque([-math.inf] * calls, maxlen=calls)
        self.turn = threading.Lock()

    def wait(self) -> None:
        with self.turn:  # those that come later wait behind this one
            left = self.made[0] + self.seconds - self.clock()
            if left > 0:
                self.sleep(left)
            self.made.append(self.clock())


def asked_at_once(df: DataFrame, prompt: str, call: Generator, tasks: int, flight: int = 8, calls: int = 240, seconds: float = 60.0, tries: int = 3, wait: float = 0.0) -> DataFrame:
    """df with answer, error and latency_ms, from calls of one prompt each, of which every task has up to flight under way.

    All tasks together make at most so many calls in so many seconds, failed and repeated ones included: there are tasks
    of them, or fewer where the budget is smaller, each with an equal share. Prompts are taken and answers given in the
    rows' order, of which a task holds flight and one batch; null prompts are asked as empty ones. A task that is run again after a
    loss starts with a full share.
    """
    tasks = max(1, min(tasks, calls))
    share = calls // tasks

    @F.arrow_udf("struct<answer: string, error: string, latency_ms: double>")
    def run(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
        budget = Budget(share, seconds)

        def counted(items: list[str]) -> list[str]:
            budget.wait()
            return call(items)

        def one(text: str | None) -> dict:
            began = time.perf_counter()
            got, error = retried(counted, [text or ""], tries, wait)
            return {"answer": got[0] if got else "", "error": error, "latency_ms": (time.perf_counter() - began) * 1000}

        with ThreadPoolExecutor(flight) as pool:
            for part in column:
                yield pa.array(list(pool.map(one, part.to_pylist())), pa.struct([("answer", pa.string()), ("error", pa.string()), ("latency_ms", pa.float64())]))

    return df.repartition(tasks).withColumn("__g", run(F.col(prompt))).select(*df.columns, "__g.*")


def hashed_embedder(dimensions: int = 64) -> Embedder:
    """Deterministic bag-of-words vectors of length one; an empty text is the zero vector."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), dimensions))
        for i, text in enumerate(texts):
            for word in (text or "").lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                out[i, h % dimensions] += 1 if h >> 63 else -1
            out[i] /= np.linalg.norm(out[i]) or 1
        return out.tolist()

    return embed


def echo_generator() -> Generator:
    """Answers with the first fact of the prompt's context, or that there is none."""

    def generate(prompts: list[str]) -> list[str]:
        return [next((line.split("] ", 1)[1] for line in (p or "").splitlines() if line.startswith("[1] ")), "Not known") for p in prompts]

    return generate


def overlap_reranker() -> Reranker:
    def score(pairs: list[tuple[str, str]]) -> list[float]:
        return [len(set(q.lower().split()) & set(d.lower().split())) / (len(set(q.lower().split())) or 1) for q, d in pairs]

    return score


def embed(df: DataFrame, text: str, call: Embedder, batch: int = 20, pad: int | None = None) -> DataFrame:
    """df with a column vector; texts of a batch whose calls all fail get null, or with pad so many zeros, which are at
    distance one from everything."""

    @F.arrow_udf("array<double>")
    def run(column: pa.Array) -> pa.Array:
        texts, out = column.to_pylist(), []
        for at in range(0, len(texts), batch):
            part = texts[at : at + batch]
            got, _ = retried(call, [x or "" for x in part])
            out += got if got is not None else [None if pad is None else [0.0] * pad] * len(part)
        return pa.array(out, pa.list_(pa.float64()))

    return df.withColumn("vector", run(F.col(text)))


def generate(df: DataFrame, prompt: str, call: Generator) -> DataFrame:
    """df with answer, error and latency_ms."""

    @F.arrow_udf("struct<answer: string, error: string, latency_ms: double>")
    def run(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in column:
            rows = []
            for text in part.to_pylist():
                began = time.perf_counter()
                got, error = retried(call, [text or ""])
                rows.append({"answer": got[0] if got else "", "error": error, "latency_ms": (time.perf_counter() - began) * 1000})
            yield pa.array(rows, pa.struct([("answer", pa.string()), ("error", pa.string()), ("latency_ms", pa.float64())]))

    return df.withColumn("__g", run(F.col(prompt))).select(*df.columns, "__g.*")


def rerank(hits: DataFrame, question: str, document: str, call: Reranker, top_n: int | None = None, keys: tuple[str, ...] = ("qid",)) -> DataFrame:
    """Hits reordered by relevance within each of keys, the first top_n; where the service fails, as they were."""

    @F.arrow_udf("double")
    def run(q: pa.Array, d: pa.Array) -> pa.Array:
        pairs = list(zip(q.to_pylist(), d.to_pylist(), strict=True))
        got, _ = retried(call, [(a or "", b or "") for a, b in pairs])
        return pa.array(got if got is not None else [None] * len(pairs), pa.float64())

    scored = hits.withColumn("rerank_score", run(F.col(question), F.col(document)))
    # one failed call leaves its query's order alone
    whole = F.count("rerank_score").over(Window.partitionBy(*keys)) == F.count(F.lit(1)).over(Window.partitionBy(*keys))
    scored = scored.withColumn("whole", whole)
    order = Window.partitionBy(*keys).orderBy(F.when(F.col("whole"), -F.col("rerank_score")), "rank")
    scored = scored.withColumn("rank", F.row_number().over(order).cast("long")).drop("whole")
    return scored if top_n is None else scored.where(F.col("rank") <= top_n)
