import pytest

EXTRA = ("id", "key", "rep", "hash", "score", "component", "p", "u", "doc", "row_key")


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang, source), with columns whose names operators use inside."""

    def make(rows):
        full = [(r[0], r[1], *(r[2:] or ("en", "src0")), len(r[1] or ""), *["x"] * len(EXTRA)) for r in rows]
        schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in EXTRA)
        return spark.createDataFrame(full, schema)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Null id, null text, empty and blank texts, a repeated row, a very long text."""
    long = "word " * 30_000 + "end"
    return [(None, "a text without id"), (1, None), (2, ""), (3, " \n\t"), (4, "some words here"), (4, "some words here"), (5, long), (6, "é€𝔘 ß x")]
