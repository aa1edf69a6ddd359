import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("rep", T.StringType()), T.StructField("t", T.StringType())])
PROSE = "the quick brown fox jumps over a lazy dog while seven wizards brew potions under old stone bridges near the harbour"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and blank texts, a very long one, repeated rows, clashing columns."""
    long = " ".join(f"word{i % 997}x{i}" for i in range(20_000))
    rows = [(1, PROSE), (1, PROSE), (2, PROSE + " today"), (3, None), (4, ""), (5, " \n\t "), (None, PROSE), (None, None), (6, long), (7, "one two"), (8, "one two"), (9, long)]
    return spark.createDataFrame([(i, t, None, None if i == 2 else "s", None, "r", "t") for i, t in rows], DOCS).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)
