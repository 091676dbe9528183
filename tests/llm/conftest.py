import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, key string"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table of (doc_id, text), with extra columns whose names operators use themselves."""
    def make(rows, lang="en"):
        return spark.createDataFrame([(d, t, lang, "src0", None if t is None else len(t), 7, "k") for d, t in rows], SCHEMA).repartition(3)
    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empties, ties, repeated rows, a very long text."""
    return [(1, None), (2, ""), (3, "a"), (3, "a"), (None, "lone words here"), (4, " \n\t "), (5, "x" * 3000), (6, "w " * 40000),
            (7, "Größe naïve čaj 中文 🙂 İstanbul it's <|endoftext|> don't stop"), (8, "same text again"), (9, "same text again")]
