"""Shared helpers: words, scratch tables in the shared folder, numbering of rows."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigil.session import checkpoint_dir

SPACE = r"\x20\x09-\x0D"                 # white space, as it stands inside a character class
SPACES = " \t\n\x0b\x0c\r"
WORD = f"[^{SPACE}]+"


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that ``spark.checkpoint.dir`` names."""
    return f"{checkpoint_dir(spark).rstrip('/')}/vigil-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = scratch(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables in the shared folder that end with the block: ``with Scratch(spark) as scratch: ... scratch.stored(df)``.

    What leaves the block must not read them any more, so it is stored by :func:`stored` before.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def stored(self, df: DataFrame) -> DataFrame:
        path = scratch(self.spark)
        self.paths.append(path)
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __enter__(self):
        return self

    def __exit__(self, *error) -> None:
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        for path in map(hadoop.Path, self.paths):
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """The words of a text in order: maximal runs of anything but white space."""
    return F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    bare = F.btrim(text, F.lit(SPACES))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, f"[{SPACE}]+"))).cast("long")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once; a plain expression inside a lambda runs per element."""
    return F.transform(F.array(value), body)[0]


def before(values: Column, combine, zero: int = 0, chunk: int = 128) -> Column:
    """For each element of an array of ints, ``combine`` over all elements in front of it.

    Arrays cannot grow in place, so the scan runs inside chunks first and over the chunks then.
    """
    state = F.struct(F.lit(zero).alias("at"), F.array().cast("array<int>").alias("out"))

    def step(s, value):
        return F.struct(combine(s["at"], value).cast("int").alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out"))

    def scanned(v):
        return F.transform(F.sequence(F.lit(0), ((F.size(v) - 1) / chunk).cast("int")), lambda k: F.aggregate(
            F.slice(v, k * chunk + 1, F.lit(chunk)), state, step))

    def joined(chunks):
        starts = F.aggregate(chunks, state, lambda s, c: step(s, c["at"]), lambda s: s["out"])
        return let(starts, lambda at: F.flatten(F.transform(chunks, lambda c, k: F.transform(
            c["out"], lambda x: combine(F.get(at, k), x).cast("int")))))
    return let(values, lambda v: F.when(F.size(v) > 0, let(scanned(v), joined)).otherwise(F.array().cast("array<int>")))


def numbered(df: DataFrame, *order: Column, name: str = "position") -> DataFrame:
    """Add the row number (from 0) in the given order without gathering the rows in one task.

    The rows are range-partitioned and sorted; only one count per partition is added up.
    """
    cut = stored(df.repartitionByRange(*order).sortWithinPartitions(*order)
                 .withColumn("_task", F.spark_partition_id())
                 .withColumn("_place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    counts = cut.groupBy("_task").agg(F.count(F.lit(1)).alias("_rows"))
    before = counts.withColumn("_before", F.sum("_rows").over(
        Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1))).drop("_rows")
    return (cut.join(F.broadcast(before), "_task")       # one row per task of the range partitioning
            .withColumn(name, F.coalesce("_before", F.lit(0)) + F.col("_place"))
            .drop("_task", "_place", "_before"))
