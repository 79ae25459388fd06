import pytest

DATA = "/root/testdata/sf0.001"

#: Nulls, empty and white texts, ties, repeated rows, a very long text, odd characters.
ODD = [
    (0, "the cat sat on the mat\nA line\nthe end", "en", "a"),
    (1, "the cat sat on the mat\nA line\nthe end", "en", "a"),
    (1, "the cat sat on the mat\nA line\nthe end", "en", "a"),
    (2, None, None, None),
    (3, "", "en", ""),
    (4, " \t\n \x0b", "de", "b"),
    (None, "no id here", "en", "a"),
    (5, "one", "en", "c"),
    (6, "Ünïcödé ſtraße 漢字 \U0001f600 <|endoftext|> ~0 </s>\r\nx\x85y", "fr", "a"),
    (7, "long " * 30000, "en", "a"),
    (8, "long " * 30000 + "tail", "en", "b"),
]
COLUMNS = "doc_id bigint, text string, lang string, source string, n_lines int, kept int, length int, part int, row int, key string"


@pytest.fixture(scope="session")
def odd(spark):
    """Documents of every odd kind, with further columns whose names clash with the operators' own."""
    return spark.createDataFrame([(*r, i, i, i, i, i, "k") for i, r in enumerate(ODD)], COLUMNS).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")
