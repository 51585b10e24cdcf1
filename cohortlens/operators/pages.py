"""Pages of a stored result: every row has a number, and a page reads only the files that hold it.

``store`` writes a result once, in its own order (the files of a write follow the order of its partitions). A row's number
is that of the first row of its file, from a running sum of rows a file, plus its place in the file, which Parquet
readers know. Nothing is sorted or collected again, whatever page is asked for.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import new_path


class Result(NamedTuple):
    """A stored result: where it lies, its schema and number of rows; ``files``: (file, first number, rows)."""

    spark: SparkSession
    path: str
    schema: StructType
    count: int
    files: DataFrame


def store(df: DataFrame, path: str | None = None) -> Result:
    """Write ``df`` to a new folder (by default in the shared folder)."""
    spark = df.sparkSession
    path = path or new_path(spark, "result")
    df.write.parquet(path)
    return stored(spark, path, df.schema)


def stored(spark: SparkSession, path: str, schema: StructType) -> Result:
    """A result that ``store`` has written; its files are counted once and kept beside it."""
    rows = spark.read.schema(schema).parquet(path)
    counted = rows.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))  # a row a file
    counted.select("file", F.coalesce(before, F.lit(0)).alias("first"), "n").write.mode("overwrite").parquet(f"{path}/_files")
    files = spark.read.schema("file string, first long, n long").parquet(f"{path}/_files")
    return Result(spark, path, schema, files.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], files)


def numbered(result: Result, size: int) -> DataFrame:
    """All rows with their ``row_number`` and, at ``size`` rows a page, ``page_number``, both from 0."""
    rows = result.spark.read.schema(result.schema).parquet(result.path).select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("at"))
    place = (F.col("at") + F.col("first")).cast("long")
    joined = rows.join(result.files.select("file", "first"), "file").withColumn("row_number", place)
    return joined.select(*result.schema.names, "row_number", F.floor(F.col("row_number") / size).cast("long").alias("page_number"))


def page(result: Result, number: int, size: int) -> DataFrame:
    """Rows ``number * size`` up to (not with) ``(number + 1) * size`` (pages from 0) in order, with their ``row_number`` from 0."""
    if number < 0 or size < 1:
        raise ValueError("pages are numbered from 0 and hold a row at least")
    low, high = number * size, (number + 1) * size
    held = result.files.where((F.col("first") < high) & (F.col("first") + F.col("n") > low)).collect()  # at most ``size`` files
    place = "row_number"
    if not held:
        return result.spark.createDataFrame([], result.schema).withColumn(place, F.lit(0).cast("long"))
    first = F.lit(0)
    for r in held:
        first = F.when(F.col("_metadata.file_name") == r.file, F.lit(r.first)).otherwise(first)
    rows = result.spark.read.schema(result.schema).parquet(*(f"{result.path}/{r.file}" for r in held))
    numbered = rows.select("*", (F.col("_metadata.row_index") + first).cast("long").alias(place))
    return numbered.where((F.col(place) >= low) & (F.col(place) < high)).orderBy(place)
