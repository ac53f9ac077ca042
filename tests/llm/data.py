"""Small documents with the awkward cases: nulls, empties, blanks, ties, repeated rows, a very long text."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, rid string, fp int, score string, words string, __row int"
EN = "the quick brown fox jumps over a lazy dog while seven wizards quietly judge what makes good text worth reading again".split()
DE = "der schnelle braune fuchs springt über den faulen hund während sieben zauberer leise prüfen was guten text lesenswert macht".split()
FR = "le rapide renard brun saute par dessus le chien paresseux pendant que sept sorciers jugent ce qui fait un bon texte".split()


def prose(rng: random.Random, words: list[str], n: int) -> str:
    out = [rng.choice(words) + rng.choice(["", "", rng.choice(words)]) for _ in range(n)]
    return " ".join(w + ("." if i % 9 == 8 else "") + ("\n" if i % 27 == 26 else "") for i, w in enumerate(out)).strip() + "."


def documents(n: int = 60, seed: int = 5) -> list[tuple]:
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang, words = (("en", EN), ("de", DE), ("fr", FR))[i % 3]
        rows.append((i, prose(rng, words, rng.randint(30, 120)), lang))
    base = rows[3][1]
    rows += [(100, base, "en"), (101, "  " + base.replace(" ", "\t"), "en"), (102, base + " \n", None), (102, base + " \n", None)]
    rows += [(103, base.replace("the", "thee", 1), "en"), (104, None, "en"), (105, "", None), (106, " \t\n", "de"), (107, "12 34 !!", "fr"), (None, "a text without an id, kept as it is here", "en")]
    rows += [(108, prose(rng, EN, 6000), "en"), (109, "x" * 30_000, "en"), (110, "same words " * 50, "en"), (111, "one two", "en"), (112, "<|endoftext|> a<|endoftext|>", "en")]
    return [(i, t, g, "src", len(t or ""), True, "r", 1, "s", "w", 2) for i, t, g in rows]


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA)
