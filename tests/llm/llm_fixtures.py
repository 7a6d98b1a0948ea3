"""Small tables with every kind of odd row."""

import pytest
from pyspark.sql import functions as F

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def odd(spark):
    """Documents with nulls in every column, empty, wordless, long and repeated texts and clashing extra columns."""
    long = " ".join(f"w{i % 700}" for i in range(30_000))
    passage = " ".join(f"p{i}" for i in range(70))
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n ", "en", "a", 4), (4, "one", "en", "b", 3),
            (5, long, "en", "b", len(long)), (6, long, "en", "c", len(long)), (6, long, "en", "c", len(long)),
            (None, "nobody " * 60, "en", None, 1), (7, "x" * 50_000, "en", "d", 50_000), (8, "again " * 200, "en", "d", 9),
            (9, f"alpha {passage} omega " + " ".join(f"u{i}" for i in range(80)), "en", "e", 1),
            (10, f"{passage} " + " ".join(f"v{i}" for i in range(80)), "en", "e", 1), (11, passage, "en", "e", 1),
            (12, "A  éß中 <b>#*$%&|</b>\n\nline\nline\n \nline", "zz", "é", 3)]
    frame = spark.createDataFrame(rows, DOCS)
    return frame.withColumn("size", F.lit("mine")).withColumn("_t", F.lit(1)).withColumn("n_words", F.lit(None).cast("string")).withColumn(
        "row", F.lit(2)).withColumn("bits", F.lit(3)).withColumn("length", F.lit("x")).withColumn("base", F.lit(0)).withColumn("_n", F.lit(5))


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture
def plain(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
