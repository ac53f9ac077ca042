"""Trimming and normalising against plain Python."""

from __future__ import annotations

import random
import re
import unicodedata

from pyspark.sql import functions as F

from statweave.functions import text as T
from statweave.sources import files

MARKS = [*T.SPACES, "a", "é", "́", ".", "..", "The", " the ", "'s", "​", "᠎", "\U0001f600", "-", "5", ""]


def plain(text: str) -> str:
    text = re.sub(r"\s+", " ", unicodedata.normalize("NFC", text).strip())
    return text.rstrip(".")


def test_the_white_space_of_all_scripts():
    assert {c for c in map(chr, range(0x110000)) if c.isspace()} == set(T.SPACES)


def test_strip_and_normalise_by_plain_python(spark):
    rng = random.Random(11)
    texts = ["", " ", "...", " . ", "　a. "] + ["".join(rng.choice(MARKS) for _ in range(rng.randint(0, 12))) for _ in range(4000)]
    rows = spark.createDataFrame([(x,) for x in [*texts, None]], "t string")
    got = rows.select("t", T.strip(F.col("t")).alias("s"), T.normalize_string(F.col("t")).alias("n")).collect()
    for r in got:
        assert (r.s, r.n) == ((None, None) if r.t is None else (r.t.strip(), plain(r.t))), repr(r.t)


def test_report_rows(spark):
    rows = spark.createDataFrame([("long name", 2.00005, 7, None), (None, None, 123456, "x"), ("é", -0.5, -1, "")], "name string, nem double, n long, note string")
    lines = files.report_lines(rows.coalesce(1), {"name": 5, "nem": 8, "n": 4, "note": 3})
    assert lines == ["name       nem    n note", "-" * 24, f"long  {2.00005:8.4f}    7 -  ", "-            - 123456 x  ", "é      -0.5000   -1    "]
    assert files.report_lines(rows.limit(0), {"n": 3}) == ["  n", "---"]
