"""Strings and the numbers inside them."""

from __future__ import annotations

import math
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# They define what a number and a sentence with figures are.
NUMBER = r"-?\d+(?:,\d{3})*(?:\.\d+)?(?:\s*%)?"
FIGURES = (
    r"\d+\.?\d*\s*%",
    r"\d+\.?\d*\s*(GW|MW|kW|TWh|MWh|GWh)",
    r"\d+\.?\d*\s*(million|billion|trillion|thousand)",
    r"\d+\.?\d*\s*(tons?|tonnes?|kilograms?|kg)",
    r"\d+\.?\d*\s*(hectares?|acres?|km²|square)",
    r"\d+\.?\d*\s*(gallons?|liters?|litres?|cubic)",
    r"\d+\.?\d*\s*(per\s+capita|per\s+year|annually)",
    r"(approximately|about|nearly|over|up\s+to|around)\s+\d+",
    r"\$\s*\d+",
    r"\d{4}\s*(to|and|through)\s*\d{4}",
    r"(increased?|decreased?|grew?|declined?|rose?|fell?)\s+(by\s+)?\d+",
    r"\d+\.?\d*x\s",
    r"\d+\.?\d*\s*-\s*fold",
)
ANY_FIGURE = "(?i)(?:" + "|".join(FIGURES) + ")"
SENTENCE_LENGTH = 50
#: White space in all scripts, as a class that the JVM and RE2 read alike; plain \\s is ASCII in both.
SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def spaced(pattern: str) -> str:
    """The pattern with its white space in all scripts."""
    return pattern.replace(r"\s", SPACE)


#: The same characters one by one.
SPACES = "".join(c for c in map(chr, range(0x3001)) if re.match(re.sub(r"x\{(\w+)\}", lambda m: f"u{m[1]:>04}", SPACE), c))


def strip(text: Column) -> Column:
    """text without white space at both ends; in linear time, however long a run of it is."""
    return F.trim(text, F.lit(SPACES))


def extract_numbers(text: Column) -> Column:
    """All number tokens, left to right; a hyphen before digits counts as a minus."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(spaced(NUMBER)), F.lit(0))


def to_number(token: Column) -> Column:
    """A token without commas, percent sign and white space as a double, or null."""
    return F.regexp_replace(token, f"[,%]|{SPACE}", "").try_cast("double")


def numbers(tokens: Column) -> Column:
    return F.filter(F.transform(tokens, to_number), lambda x: x.isNotNull())


def half_even(x: Column, places: int = 4) -> Column:
    """The double nearest to x's exact binary value rounded to so many places (0 to 15), ties to even.

    Rounding x's shortest decimals differs from that only where they end in a tie, so the exact way is for those: the whole part is set aside, which is exact; what is left times 10^places is a product and its error, both exact,
    so that the sum of error and distance from the tie has the right sign.
    """
    scale, size = 10.0**places, F.abs(x)
    whole = F.floor(size).cast("double")
    part = size - whole
    product = part * scale
    high = part * 134217729.0 - (part * 134217729.0 - part)  # the upper half of the digits; scale has few enough itself
    error = (high * scale - product) + (part - high) * scale
    down = F.floor(product).cast("double")
    over = (product - down - 0.5) + error
    last = whole * scale + down
    up = (over > 0) | ((over == 0) & (last % 2 == 1))
    near = (last + F.when(up, 1.0).otherwise(0.0)) / scale
    tie = (F.round(x, places + 1) == x) & (F.round(x, places) != x) & (size < 2.0 ** math.ceil(52 - places * math.log2(10)))
    return F.when(tie, F.when(x < 0, -near).otherwise(near)).otherwise(F.round(x, places))


def rounded(values: Column) -> Column:
    """The distinct values to four places."""
    return F.array_distinct(F.transform(values, lambda x: half_even(x)))


@F.arrow_udf(StringType())
def _composed(text: pa.Array) -> pa.Array:
    return pa.array([None if x is None else unicodedata.normalize("NFC", x) for x in text.to_pylist()], pa.string())


def nfc(text: Column) -> Column:
    """Canonical composition; Arrow-batched Python, as the JVM side has no such function. ASCII texts, which it leaves
    alone, don't go there."""
    return F.coalesce(_composed(F.when(text.rlike(r"[^\x00-\x7f]"), text)), text)


def normalize_string(text: Column) -> Column:
    """Composed, trimmed, white space collapsed, all trailing dots off."""
    return F.rtrim(F.regexp_replace(strip(nfc(text)), f"{SPACE}+", " "), F.lit("."))


def canonical_key(text: Column) -> Column:
    """normalize_string in lower case without articles, possessives and all but ASCII letters, digits and spaces."""
    key = F.lower(normalize_string(text))
    for _ in range(2):  # neighbouring articles share a separator
        key = F.regexp_replace(key, r"(^|[^\p{L}\p{M}\p{N}_])(the|a|an)($|[^\p{L}\p{M}\p{N}_])", "$1$3")
    key = F.regexp_replace(F.replace(key, F.lit("'s"), F.lit("")), r"[^a-z0-9 ]", "")
    return F.trim(F.regexp_replace(key, r" {2,}", " "))


def sentences(text: Column) -> Column:
    """Split after . ! or ? and white space; trimmed."""
    return F.transform(F.split(text, f"(?<=[.!?]){SPACE}+"), strip)


def is_statistical(sentence: Column) -> Column:
    """Long enough, no reference or heading, and with a figure."""
    return (F.length(sentence) >= SENTENCE_LENGTH) & ~sentence.startswith("^") & ~sentence.contains("== ") & ~sentence.startswith("ISBN") & sentence.rlike(spaced(ANY_FIGURE))


def contains_any(text: Column, patterns: tuple[str, ...]) -> Column:
    """Whether the text in lower case contains any of the literal patterns."""
    return F.exists(F.array(*map(F.lit, patterns)), lambda p: F.contains(F.lower(text), p))


def fenced_json(text: Column) -> Column:
    """What follows the first fence marked as JSON, else the first fence, up to the next one or the end; without a
    fence the text itself."""
    after = lambda fence: F.get(F.split(F.get(F.split(text, fence), F.lit(1)), "```"), F.lit(0))
    return strip(F.coalesce(after("```json"), after("```"), text))


def sitelink_title(url: Column) -> Column:
    return F.replace(F.substring_index(url, "/wiki/", -1), F.lit("_"), F.lit(" "))


def sitelink_url(title: Column, site: str = "https://en.wikipedia.org/wiki/") -> Column:
    """The page of a title: underscores for spaces, quotation marks left out."""
    return F.concat(F.lit(site), F.translate(title, ' "', "_"))


def title_candidate(text: Column) -> Column:
    """Plausible as an article title: 4 to 199 characters, not a number, not starting with a digit."""
    return (F.length(text) > 3) & (F.length(text) < 200) & ~text.rlike(spaced(r"^(?:[\d.,%$€£-]|\s)+$")) & ~text.rlike(r"^\d")
