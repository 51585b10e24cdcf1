"""Helpers of the llm operators: shared folder, stored tables, Arrow batches."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import session
from ..session import new_path


def shared_folder(spark: SparkSession) -> str:
    """The library's shared folder; checkpoints go there too."""
    folder = session.shared_folder(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and reread it: cuts the lineage,
    and every later use reads the same rows, whichever executors are lost."""
    path = new_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Let the Python workers import this package: where PYTHONPATH does not name it, Spark
    sends them its source files, once an application. Where the caller has set no number of rows for Arrow
    batches, they are kept smaller than Spark's default, as an executor holds some whole texts for each core."""
    if spark.conf.get(ARROW_ROWS, "-1") == "-1":  # not set
        spark.conf.set(ARROW_ROWS, "1000")
    root = Path(__file__).resolve().parents[2]
    app = spark.sparkContext.applicationId
    if app in _shipped or str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    path = Path(tempfile.mkdtemp(prefix="llm-code-"), "cohortlens_code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for source in sorted((root / "cohortlens").rglob("*.py")):
            z.write(source, source.relative_to(root))
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(app)


def parts_for(df: DataFrame, bytes_a_task: int) -> int:
    """Tasks for ``df``: one for each ``bytes_a_task`` that Catalyst estimates (files: their size), at least
    spark.sql.shuffle.partitions. Without an estimate (rows of an RDD): that setting."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return least if size >= 1 << 62 else max(least, -(-size // bytes_a_task))


def texts_of(docs: DataFrame) -> DataFrame:
    """(doc_id long, text string) of ``docs``; null text: empty. Other columns are left out,
    so that no name of theirs can clash."""
    ship(docs.sparkSession)
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )


def chunks(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose ``column`` holds at most ``max_bytes`` (one row at least), so
    that what a task unpacks at once is bounded by the slice and the longest text."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).to_pylist()
        begin = total = 0
        for i, size in enumerate(sizes):
            if i > begin and total + (size or 0) > max_bytes:
                yield batch.slice(begin, i - begin)
                begin, total = i, 0
            total += size or 0
        if begin < len(sizes):
            yield batch.slice(begin)
        pa.default_memory_pool().release_unused()  # a worker lives on for other tasks


def gathered(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """``chunks`` of about ``max_bytes`` each, whatever the size of the batches: small ones are put together."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(column).nbytes
        if size >= max_bytes:
            yield from chunks(pa.Table.from_batches(held).combine_chunks().to_batches(), column, max_bytes)
            held, size = [], 0
    if size:
        yield from chunks(pa.Table.from_batches(held).combine_chunks().to_batches(), column, max_bytes)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def finite_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id long, vec array<double>) without rows whose id or vector is null or whose vector
    is empty or holds a null or non-finite component."""
    ship(vectors.sparkSession)
    x = F.col("vec")
    ok = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return (
        vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vec"))
        .where(F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0))
        .where(F.coalesce(ok, F.lit(False)))
    )
