"""Tables in versions: failing writers, tables replaced from themselves, conflicts, old versions."""

import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cohortlens.sources import sinks, snapshots


@pytest.fixture
def table(tmp_path):
    return f"file://{tmp_path}/table"


def numbers(spark, table, number=None):
    return sorted(r.n for r in snapshots.read(spark, table, number).collect())


def test_replace_from_itself(spark, table):
    snapshots.write(spark.range(5).select(F.col("id").alias("n")), table)
    for _ in range(2):
        snapshots.write(snapshots.read(spark, table).select((F.col("n") + 10).alias("n")), table)
    assert numbers(spark, table) == [20, 21, 22, 23, 24]
    assert snapshots.versions(spark, table) == [1, 2, 3] and numbers(spark, table, 1) == [0, 1, 2, 3, 4]


def test_a_failing_write_leaves_the_table(spark, table):
    snapshots.write(spark.range(3).select(F.col("id").alias("n")), table)
    failing = snapshots.read(spark, table).select(F.when(F.col("n") == 2, F.raise_error(F.lit("lost"))).otherwise(F.col("n")).cast("long").alias("n"))
    with pytest.raises(PySparkException):
        snapshots.write(failing, table)
    assert numbers(spark, table) == [0, 1, 2] and snapshots.versions(spark, table) == [1]
    snapshots.write(spark.range(1).select(F.col("id").alias("n")), table)  # goes on from there
    assert numbers(spark, table) == [0]
    snapshots.expire(spark, table, keep=1)  # what the failed writer left goes too
    assert len(os.listdir(f"{table[7:]}/data")) == 1 and numbers(spark, table) == [0]


def test_a_reader_keeps_its_version(spark, table):
    snapshots.write(spark.range(4).select(F.col("id").alias("n")), table)
    reader = snapshots.read(spark, table)
    snapshots.write(spark.range(1).select(F.col("id").alias("n")), table)
    assert reader.count() == 4 and snapshots.read(spark, table).count() == 1


def test_two_writers_of_one_version(spark, table):
    one = snapshots.write(spark.range(1).select(F.col("id").alias("n")), table)
    snapshots.write(spark.range(2).select(F.col("id").alias("n")), table, expected=one.number)
    with pytest.raises(snapshots.Conflict):
        snapshots.write(spark.range(3).select(F.col("id").alias("n")), table, expected=one.number)
    with pytest.raises(snapshots.Conflict):  # both had seen the same last version
        snapshots._commit(spark, table, 2, "{}")
    assert numbers(spark, table) == [0, 1] and all(not n.startswith("_") for n in os.listdir(f"{table[7:]}/log"))


def test_expire(spark, table):
    for i in range(4):
        snapshots.write(spark.range(i).select(F.col("id").alias("n")), table, notes={"i": i})
    assert snapshots.expire(spark, table, keep=2) == [1, 2]
    assert snapshots.versions(spark, table) == [3, 4] and snapshots.version(spark, table).notes == {"i": 3}
    assert len(os.listdir(f"{table[7:]}/data")) == 2
    with pytest.raises(LookupError):
        snapshots.read(spark, table, 1)
    with pytest.raises(ValueError):
        snapshots.expire(spark, table, keep=0)


def test_no_version(spark, table):
    assert snapshots.version(spark, table) is None
    with pytest.raises(LookupError):
        snapshots.read(spark, table)


def test_write_table_replaces_in_versions(spark, table):
    """The general writer: the relation can be replaced from itself."""
    sinks.write_table(spark.range(3).select(F.col("id").alias("n")), table)
    sinks.write_table(snapshots.read(spark, table).where("n > 0"), table)
    assert sorted(r.n for r in snapshots.read(spark, table).collect()) == [1, 2]
