import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, _lane0 string, _key string, key string, shard string, component_id string, _drop long, score string"


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls, empty and very long texts, ties, repeated rows and clashing extra columns."""
    long_text = "word and another one " * 6000 + "x" * 70_000
    texts = [
        (1, "The same text twice, with a few words more to make it long enough for shingles."),
        (2, "The same text twice, with a few words more to make it long enough for shingles."),
        (2, "The same text twice, with a few words more to make it long enough for shingles."),
        (3, None), (4, ""), (5, " \t\n\x0b\x0c\r "), (6, long_text), (7, "é日本🙂  ß　İ"), (8, "one"), (None, "no id here at all"), (None, None), (9, "\x00\x1c\x85 odd �"),
    ]
    return [(i, t, "en" if n % 2 else None, None if n % 3 == 0 else f"s{n % 2}", None, 7, "l", "k", "q", "h", "c", 1, "s") for n, (i, t) in enumerate(texts)]


@pytest.fixture(scope="session")
def edge(spark, edge_rows):
    return spark.createDataFrame(edge_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_rows(spark):
    return spark.createDataFrame([], SCHEMA)
