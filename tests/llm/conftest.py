import pytest

LONG = "lorem ipsum dolor sit amet " * 4000


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, columns with clashing names."""
    rows = [
        (1, "same text", "src0", "kept?", 7),
        (2, "same text", "src1", None, None),
        (2, "same text", "src1", None, None),
        (3, None, None, "x", 1),
        (4, "", "src0", "y", 2),
        (5, LONG, "src0", "z", 3),
        (6, LONG, "src2", "z", 3),
        (None, "same text", "src0", "n", 0),
        (7, "é É 日本 \U0001f600 <|endoftext|> x", "src3", "u", 9),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, kept string, id int")


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.limit(0)
