"""Small fixtures of the training-data tests."""

from __future__ import annotations

import random
import re

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PAGE_SCHEMA = "page_id long, url string, html string"

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text: str | None) -> list[bytes]:
    return WORDS.findall((text or "").encode())


def documents(spark, rows):
    """Rows ``(doc_id, text[, lang[, source]])`` as a documents table, with
    extra columns whose names operators use themselves."""
    full = []
    for r in rows:
        doc_id, text, lang, source = (*r, *(None, "en", "s0")[len(r) - 1:])[:4]
        full.append((doc_id, text, lang, source, None if text is None else len(text), "x", 7.0, True))
    return spark.createDataFrame(full, DOC_SCHEMA + ", size string, score double, kept boolean")


def prose(n: int, seed: int, vocabulary: int = 400) -> str:
    rng = random.Random(seed)
    return " ".join(f"w{min(rng.randrange(vocabulary), rng.randrange(vocabulary))}" for _ in range(n))


def odd_rows():
    """Nulls, empty, blank, very long, repeated and tied rows."""
    long = prose(30_000, 99, 5000)
    return [
        (1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "one two three four"), (6, "One TWO three four"),
        (7, long), (8, long), (9, prose(60, 1)), (9, prose(60, 1)), (9, prose(60, 2)), (None, prose(60, 1)), (None, None),
        (10, "naïve café — 日本語 \U0001F600 ▁mark nbsp sep", None, None), (11, "a " * 500, "en", None), (12, "x" * 5000),
    ]
