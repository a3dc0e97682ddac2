import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls, empty and long texts, repeated rows, and columns named like outputs."""
    rows = [
        (1, "one two three four five six", "a", "x"), (2, "One two three  four five six", "a", None), (3, None, None, "y"),
        (4, "", "b", "y"), (5, "word", None, None), (6, "word", "a", "z"), (6, "word", "a", "z"), (None, "lone text", "b", "z"),
        (7, "\t \n \n", "b", "z"), (8, "long words of a text " * 3000, "c", "z"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size string").withColumnRenamed("size", "Size")
