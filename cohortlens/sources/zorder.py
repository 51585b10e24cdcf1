"""The event log in one layout for lookups by user and by date.

User and day are ranked by cut points of their quantiles (``BITS`` bits each), the bits of both ranks are interleaved, and the log
is range-partitioned by that number: a file holds a small rectangle of users and days, so a lookup by user and one by date each
need about the square root of all files. Ranks from quantiles keep the rectangles equally full on skewed
data; a user with very many events fills a rank alone, whose files then split by day.

Beside the data lies an index, a row a file with its least and greatest user and date. ``read`` takes the files from it, so
others are neither opened nor listed; Parquet's statistics and a Bloom filter on user_id then skip row groups.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BITS = 6
INDEX = "_files"  # Spark does not read folders of such names as data


def day_of(ts: Column) -> Column:
    return F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date"))


def cut_points(df: DataFrame, bits: int, **values: Column) -> dict[str, list[int]]:
    """For each value the 2**bits - 1 points that part its rows equally (about: by Spark's mergeable quantile sketch)."""
    shares = [i / (1 << bits) for i in range(1, 1 << bits)]
    found = df.agg(*(F.percentile_approx(v, shares, 10_000).alias(n) for n, v in values.items())).first()
    return {n: list(found[n] or []) for n in values}


def rank_of(value: Column, cuts: Sequence[int]) -> Column:
    """Number of cut points up to the value, by a search tree of CASE expressions; NULL: 0."""

    def search(part: Sequence[int]) -> Column:
        if not part:
            return F.lit(0)
        middle = len(part) // 2
        return F.when(value < part[middle], search(part[:middle])).otherwise(F.lit(middle + 1) + search(part[middle + 1 :]))

    return F.when(value.isNull(), 0).otherwise(search(list(cuts)))


def interleaved(a: Column, b: Column, bits: int) -> Column:
    """Bits of a and b in turn, the highest of a first."""
    out = F.lit(0)
    for i in range(bits):
        for rank, place in ((a, 2 * i + 1), (b, 2 * i)):
            out = out + F.shiftleft(F.shiftright(rank, i).bitwiseAND(F.lit(1)), place)
    return out


def write(events: DataFrame, path: str, num_files: int | None = None, bits: int = BITS) -> None:
    """Lay out (user_id, event_name, event_date, ...) below ``path``, which must not exist yet."""
    n = num_files or int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    user, day = F.col("user_id"), day_of(F.col("event_date"))
    cuts = cut_points(events, bits, user=user, day=day)
    ranks = events.withColumns({"user_rank": rank_of(user, cuts["user"]), "day_rank": rank_of(day, cuts["day"])})
    placed = ranks.withColumn("place", interleaved(F.col("user_rank"), F.col("day_rank"), bits)).drop("user_rank", "day_rank")
    order = ["user_id", "event_date", "event_name"]
    (
        placed.repartitionByRange(n, "place", *order)
        .sortWithinPartitions(*order)
        .drop("place")
        .write.option("parquet.bloom.filter.enabled#user_id", "true")
        .parquet(path)
    )
    spark = events.sparkSession
    ends = [f(c).alias(f"{n}_{c}") for c in ("user_id", "event_date") for n, f in (("least", F.min), ("most", F.max))]
    files = spark.read.schema(events.schema).parquet(path).groupBy(F.col("_metadata.file_name").alias("file")).agg(
        *ends, F.count(F.lit(1)).alias("n"), F.count_if(F.col("user_id").isNull()).alias("nameless"), F.count_if(F.col("event_date").isNull()).alias("dateless")
    )
    files.coalesce(1).write.parquet(f"{path}/{INDEX}")


def files_of(spark: SparkSession, path: str, user_id: int | None = None, first: date | datetime | None = None, last: date | datetime | None = None) -> list[str]:
    """Files that can hold events of the user and of the dates from ``first`` up to (not with) ``last``."""
    index = spark.read.parquet(f"{path}/{INDEX}")
    if user_id is not None:
        index = index.where(F.lit(user_id).between(F.col("least_user_id"), F.col("most_user_id")))
    if first is not None:
        index = index.where(F.col("most_event_date") >= F.lit(first))
    if last is not None:
        index = index.where(F.col("least_event_date") < F.lit(last))
    return [f"{path}/{r.file}" for r in index.select("file").orderBy("file").collect()]  # names of the files to be read


def read(spark: SparkSession, path: str, user_id: int | None = None, first: date | datetime | None = None, last: date | datetime | None = None) -> DataFrame:
    """Events of a user, of the dates from ``first`` up to (not with) ``last``, or both; without either the whole log."""
    everything = spark.read.parquet(path)
    if user_id is None and first is None and last is None:
        return everything
    files = files_of(spark, path, user_id, first, last)
    rows = spark.read.schema(everything.schema).parquet(*files) if files else everything.limit(0)
    if user_id is not None:
        rows = rows.where(F.col("user_id") == user_id)
    if first is not None:
        rows = rows.where(F.col("event_date") >= F.lit(first))
    return rows if last is None else rows.where(F.col("event_date") < F.lit(last))
