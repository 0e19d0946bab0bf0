import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, size string, uid string, path string, n string"


def _words(n, seed):
    import random

    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(1, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows and extra columns with clashing names."""
    base = _words(120, 1)
    near = base.replace(" ", "  ", 1) + " tail"
    rows = [(1, base), (2, base), (3, near), (4, ""), (5, None), (6, "   \n\t "), (7, "one two"), (8, "one two"), (9, "12 34 !!"), (10, _words(30_000, 2)), (11, "x" * 5000), (12, _words(60, 3)), (None, _words(50, 4)), (12, _words(60, 3)), (13, "é\u00a0ü <|endoftext|> ok"), (14, base + " " + _words(15, 5))]
    data = [(i, t, None if i == 12 else "en" if (i or 0) % 2 else "de", None if i == 9 else f"s{(i or 0) % 3}", None, "a", None, "b", None, "c") for i, t in rows]
    return spark.createDataFrame(data, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def real_docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
