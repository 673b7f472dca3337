from __future__ import annotations

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    """Rows of (doc_id, text[, lang[, source]]) as documents."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or "")) for r in rows]
    return spark.createDataFrame(full, DOCS)


#: One row of each awkward kind: nulls in every column, empty and blank texts, ties and repeated rows, a long text.
AWKWARD = [
    (None, None, None, None), (None, "some words of a text without an id here", "en", None), (1, "", "en", "a"), (2, " \t\n ", None, "a"), (3, None, "de", "b"),
    (4, "a text that is there twice in the very same row of all", "en", "a"), (4, "a text that is there twice in the very same row of all", "en", "a"),
    (5, "one id", "en", "a"), (5, "and another text of the same id", "en", "a"), (6, "x" * 20_000, "en", "a"), (7, "word " * 4000, "en", "a"), (8, "12 34 !!", "en", "a"),
    (9, "é ñ 漢字 😀 ß", "fr", "c"), (10, "\x00\x1c odd \x85 bytes ﻿", "fr", "c"),
]
