import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, key string, text_hash string, fp string, k string, t string, h string, spans string, score string, n_words string, _stay string, _bad string"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents with columns whose names the operators use inside."""

    def make(rows):
        return spark.createDataFrame([(i, t, lang, "s", len(t or ""), *["x"] * 11) for i, t, lang in rows], SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd(make_docs):
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    long = " ".join(f"wort{i % 977} Satz{i % 31}" for i in range(30_000))
    rows = [(1, None, None), (2, "", "de"), (3, " \t\n ", None), (4, long, "de"), (5, "one two three four", "en"), (5, "one two three four", "en"), (6, "one two three four", None), (None, "one two three four", "en"), (7, "🙂 ÄÖ ſ K   x\x00y", "fr"), (8, "A" * 70_000, "en"), (9, "12345", "en"), (10, "a", "de")]
    return make_docs(rows)


@pytest.fixture(scope="session")
def none(make_docs):
    return make_docs([])
