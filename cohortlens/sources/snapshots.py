"""Tables in versions: a writer never touches the files that readers see.

A table is a folder. Each version's Parquet files lie in a folder of their own below ``data``; ``log`` has one small file a
version, named by its number, which says where the data is, its schema and its rows. A version exists from the
moment its log file does, and that file appears by one rename that fails if the name is taken. So a writer that fails leaves
the table as it was, a table can be replaced by a query on itself, two writers of the same version can't both
succeed (``Conflict``), and a reader that has begun goes on with its version. ``expire`` deletes versions that are no longer wanted.

Files are made, listed and renamed by Hadoop's file system of the path, so any store that Spark writes can hold a table
whose rename of a file fails or is atomic as a local or HDFS one is.
"""

from __future__ import annotations

import json
import uuid
from typing import NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


class Conflict(RuntimeError):
    """Another writer has made the version that this one was to be."""


class Version(NamedTuple):
    number: int
    data: str
    schema: StructType
    notes: dict


def _file_system(spark: SparkSession, path: str):
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, at.getFileSystem(conf), jvm.org.apache.hadoop.fs.Path


def _names(spark: SparkSession, folder: str) -> list[str]:
    _, fs, path = _file_system(spark, folder)
    at = path(folder)
    return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []


def versions(spark: SparkSession, table: str) -> list[int]:
    """Numbers of the versions that can be read, ascending."""
    return sorted(int(n) for n in _names(spark, f"{table}/log") if n.isdigit())


def version(spark: SparkSession, table: str, number: int | None = None) -> Version | None:
    """A version, by default the newest; None if the table has none."""
    known = versions(spark, table)
    if number is None and not known:
        return None
    number = known[-1] if number is None else number
    if number not in known:
        raise LookupError(f"{table} has no version {number}")
    text = "\n".join(r.value for r in spark.read.text(f"{table}/log/{number:012d}", wholetext=True).collect())
    found = json.loads(text)
    return Version(number, f"{table}/{found['data']}", StructType.fromJson(found["schema"]), found["notes"])


def read(spark: SparkSession, table: str, number: int | None = None) -> DataFrame:
    """The rows of a version, by default the newest."""
    found = version(spark, table, number)
    if found is None:
        raise LookupError(f"{table} has no version")
    return spark.read.schema(found.schema).parquet(found.data)


def write(df: DataFrame, table: str, notes: dict | None = None, expected: int | None = None, partition_by: tuple[str, ...] = ()) -> Version:
    """Make ``df`` the table's next version. ``expected``: the number of the version that it was made from; where another one
    has come since, Conflict. ``notes``: what else to keep with the version (JSON)."""
    spark = df.sparkSession
    known = versions(spark, table)
    last = known[-1] if known else 0
    if expected is not None and expected != last:
        raise Conflict(f"{table} is at version {last}, not {expected}")
    data = f"data/{last + 1:012d}-{uuid.uuid4().hex}"
    writer = df.write
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{table}/{data}")
    text = json.dumps({"data": data, "schema": df.schema.jsonValue(), "notes": notes or {}})
    _commit(spark, table, last + 1, text)
    return Version(last + 1, f"{table}/{data}", df.schema, notes or {})


def _commit(spark: SparkSession, table: str, number: int, text: str) -> None:
    jvm, fs, path = _file_system(spark, table)
    fs.mkdirs(path(f"{table}/log"))
    draft, final = path(f"{table}/log/_{uuid.uuid4().hex}"), path(f"{table}/log/{number:012d}")
    out = fs.create(draft, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), spark._jsc.hadoopConfiguration())
    no_options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        files.rename(draft, final, no_options)  # fails where the version exists
    except Py4JJavaError as e:
        fs.delete(draft, False)
        if "FileAlreadyExistsException" in str(e.java_exception):
            raise Conflict(f"version {number} of {table} was written by another writer") from e
        raise


def expire(spark: SparkSession, table: str, keep: int = 2) -> list[int]:
    """Delete all but the newest ``keep`` versions, then data folders that no version names and that are older than the newest
    version's (leftovers of writers that failed). Returns the deleted numbers."""
    if keep < 1:
        raise ValueError("the newest version stays")
    _, fs, path = _file_system(spark, table)
    old = versions(spark, table)[:-keep]
    for number in old:
        fs.delete(path(f"{table}/log/{number:012d}"), False)
    kept = {version(spark, table, n).data.rsplit("/", 1)[1] for n in versions(spark, table)}
    newest = max(kept, default="")
    for name in _names(spark, f"{table}/data"):
        if name not in kept and name[:12] <= newest[:12]:
            fs.delete(path(f"{table}/data/{name}"), True)
    return old
