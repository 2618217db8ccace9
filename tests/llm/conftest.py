import pytest
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    # clashing and extra columns
    T.StructField("n_words", T.StringType()), T.StructField("fingerprint", T.StringType()), T.StructField("kept", T.StringType()),
])

LONG = "lorem ipsum dolor sit amet " * 3000

ODD_ROWS = [
    (1, None, "x", "y", "z"),
    (2, "", "x", "y", "z"),
    (3, "  \n\t ", "x", None, "z"),
    (4, "One two three four five six seven eight nine ten eleven.", "x", "y", "z"),
    (4, "One two three four five six seven eight nine ten eleven.", "x", "y", "z"),
    (5, "one TWO three four five six seven eight nine ten eleven.", None, "y", "z"),
    (None, "a text without an id, of some more words than ten of them in all", "x", "y", "z"),
    (None, None, None, None, None),
    (6, LONG, "x", "y", "z"),
    (7, "\x1c    odd ́ white\r\nspace <|endoftext|> \U0001f600", "x", "y", "z"),
]


@pytest.fixture
def odd_docs(spark):
    return spark.createDataFrame(ODD_ROWS, DOCS)


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
