import pytest


def _documents(spark, rows, extra=""):
    """A Parquet-backed documents table of (doc_id, text, source) with clashing extra columns."""
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return df.selectExpr("*", "'en' AS lang", "1L AS n_chars", "7 AS size", "'x' AS score", "8 AS copies", "9L AS row_no", "'k' AS kept", "1 AS base", "2 AS n_tokens")


@pytest.fixture
def parquet(spark, tmp_path):
    """Write a frame as Parquet and read it back."""
    made = []

    def store(df):
        path = str(tmp_path / f"t{len(made)}" / "documents.parquet")
        made.append(path)
        df.write.parquet(path)
        return spark.read.parquet(path)

    return store


@pytest.fixture
def documents(spark, parquet):
    return lambda rows: parquet(_documents(spark, rows))


LONG = " ".join(f"w{i}" for i in range(3000))
EDGE = [
    (1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (4, "one", "b"), (5, "one two three four", "b"), (6, LONG, "a"), (6, LONG, "a"),
    (7, LONG.upper(), "c"), (8, LONG + " tail", None), (None, "x y z", "b"), (None, None, None), (9, "a " * 200, "d"), (10, "a " * 200, "d"),
    (11, " ".join(f"w{i}" for i in range(40)), "d"), (12, "é ü\x85 ñ\x1c " * 20, "a"),
]


@pytest.fixture
def edge_rows():
    return EDGE
