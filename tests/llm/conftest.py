import pytest

EDGES = [
    (None, "a line that is long enough to count"), (1, None), (2, ""), (3, " \n\t\n"), (4, "a line that is long enough to count\nB"),
    (5, "A Line that is long enough to count  "), (5, "A Line that is long enough to count  "), (6, "x" * 300_000), (7, "word " * 20_000),
    (8, "é" * 150 + " tail"), (9, "é" * 150 + " other"), (10, "one two three"), (11, "one TWO three"), (12, " " * 9000),
]


@pytest.fixture
def edges(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and clashing extra columns."""
    rows = [(i, t, "host" if k % 2 else None, k, "own", 7, "own") for k, (i, t) in enumerate(EDGES)]
    names = "doc_id long, text string, source string, shard int, component_id string, id long, node string"
    return spark.createDataFrame(rows, names).repartition(3)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string, n_chars long")
