"""Small tables with the awkward cases that every operator must take."""

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def docs_of(spark):
    def make(rows, more=""):
        """rows: (doc_id, text) or (doc_id, text, lang)."""
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, "s", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


AWKWARD = [
    (None, "a row without id but with some words in it"),
    (1, None),
    (2, ""),
    (3, " .,;\n\t"),
    (4, "word"),
    (5, "x" * 200_000),
    (6, "many words " * 30_000),
    (7, "Ünïcödé — 日本語 テキスト 😀 \x00\x01 end"),
    (8, "the same row twice, word for word, as it is"),
    (8, "the same row twice, word for word, as it is"),
]
