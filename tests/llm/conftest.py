import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, fingerprint string, size string, h string"


def docs_of(spark, rows):
    """(doc_id, text, source) rows as documents, with extra columns whose names clash with the operators' own."""
    full = [(i, t, "en", s, len(t) if t is not None else None, "x", "y", "z") for i, t, s in rows]
    return spark.createDataFrame(full, COLUMNS)


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls, empty and very long texts, repeated rows, equal texts, odd white space."""
    long = " ".join(f"w{i % 997}" for i in range(60_000))
    rows = [
        (1, None, "a"), (2, "", "a"), (3, "One two  three\tfour five six", None), (3, "One two  three\tfour five six", None), (4, "ONE two three four five six", "b"),
        (5, long, "b"), (6, "  \n\t ", "b"), (7, "Ünï cödé \u00a0 nbsp\u2003em \x1c fs", None), (None, "no id here at all", "a"), (8, "x", ""), (9, "ΑΣ Σ ÀÉ a's İ", "b"), (10, long, "a"),
        (11, "#" * 3000, "c"), (12, "again again " * 400, "c"), (13, "line one is here\nline one is here\n\nend", "c"),
    ]
    return docs_of(spark, rows)


@pytest.fixture(scope="session")
def no_docs(spark):
    return docs_of(spark, [])
