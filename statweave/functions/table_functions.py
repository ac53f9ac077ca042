"""Table functions for SQL: after register, LATERAL numbers_in(text) and LATERAL statistical_sentences(text)."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import DataType, IntegralType, NullType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from statweave.functions import text as T


def _python(pattern: str) -> re.Pattern:
    """A pattern of the columns' functions, read as the JVM does: ASCII digits, letters and case."""
    return re.compile(re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: f"\\u{int(m[1], 16):04x}", T.spaced(pattern)), re.ASCII)


_NUMBER, _FIGURE, _ENDS = _python(T.NUMBER), _python(T.ANY_FIGURE), _python(r"(?<=[.!?])\s+")
_NO_DIGIT, _SPACES = _python(r"[,%]|\s"), "".join(c for c in map(chr, range(0x3001)) if _python(r"\s").fullmatch(c))


def _expect(name: str, argument: AnalyzeArgument, kind: type[DataType]) -> None:
    if not isinstance(argument.dataType, (kind, NullType)):
        raise ValueError(f"{name} has to be {kind.__name__.removesuffix('Type').lower()}, not {argument.dataType.simpleString()}")


class NumbersIn:
    """pos, token, value of each number in a text, left to right; none for null."""

    @staticmethod
    def analyze(text: AnalyzeArgument) -> AnalyzeResult:
        _expect("text", text, StringType)
        return AnalyzeResult(StructType().add("pos", "long").add("token", "string").add("value", "double"))

    def eval(self, text: str | None) -> Iterator[tuple]:
        for pos, found in enumerate(_NUMBER.finditer(text or "")):
            yield pos, found[0], float(_NO_DIGIT.sub("", found[0]))


class StatisticalSentences:
    """pos (among all sentences) and sentence of those with a figure and at least so many characters; none for null."""

    @staticmethod
    def analyze(text: AnalyzeArgument, least: AnalyzeArgument | None = None) -> AnalyzeResult:
        _expect("text", text, StringType)
        if least is not None:
            _expect("least", least, IntegralType)
            if not least.isConstantExpression:
                raise ValueError("least has to be a constant")
        return AnalyzeResult(StructType().add("pos", "long").add("sentence", "string"))

    def eval(self, text: str | None, least: int | None = None) -> Iterator[tuple]:
        least = T.SENTENCE_LENGTH if least is None else least
        for pos, part in enumerate(self._parts(text or "")):
            sentence = part.strip(_SPACES)
            if len(sentence) >= least and not sentence.startswith(("^", "ISBN")) and "== " not in sentence and _FIGURE.search(sentence):
                yield pos, sentence

    @staticmethod
    def _parts(text: str) -> Iterator[str]:
        at = 0
        for end in _ENDS.finditer(text):
            yield text[at : end.start()]
            at = end.end()
        yield text[at:]


def register(spark: SparkSession) -> None:
    """Makes the functions known to the session's SQL; their rows are those of the columns' functions. They go to Python
    pickled: with Arrow each input row's few output rows would be a table of their own, which costs more than they do."""
    for name, f in (("numbers_in", NumbersIn), ("statistical_sentences", StatisticalSentences)):
        spark.udtf.register(name, udtf(f, returnType=None, useArrow=False))
