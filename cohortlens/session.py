"""SparkSession construction and shared-folder handling."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on: AQE (runtime coalescing, skew-join splitting,
# runtime broadcast conversion of small aggregated sides), a fixed session time
# zone, and no web UI.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # coalesce small shuffle partitions to the advisory size instead of keeping
    # one per core: fewer tiny tasks, no effect on large partitions
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # no Python call-site capture per DataFrame/Column call (several Py4J
    # round trips each); plans are built faster, error messages lack the
    # Python line of the failing call
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(
    master: str | None = None,
    app_name: str = "cohortlens",
    shuffle_partitions: int | None = None,
    extra_conf: dict[str, str] | None = None,
) -> SparkSession:
    """Create (or reuse) a session with the settings above.

    ``master`` is only set when given, so that on a cluster the launcher's
    master wins. ``shuffle_partitions`` should be sized so that one shuffle
    partition stays within executor memory at the target data size.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(BASE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra_conf or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_RUN_FOLDER: ContextVar[str | None] = ContextVar("run folder", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which all executors share; where it is
    unset, the context's checkpoint folder, or one below the warehouse, which they share too."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/cohortlens-work"


def new_path(spark: SparkSession, label: str) -> str:
    """A path that no other run uses, in the shared folder or in the folder of the ``run_folder`` that is open."""
    return f"{_RUN_FOLDER.get() or shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


@contextmanager
def run_folder(spark: SparkSession) -> Iterator[str]:
    """A folder of the shared one for the tables that are stored while it is open; it is deleted in the end, so results
    must be collected or written elsewhere before."""
    folder = f"{shared_folder(spark)}/run-{uuid.uuid4().hex}"
    before = _RUN_FOLDER.set(folder)
    try:
        yield folder
    finally:
        _RUN_FOLDER.reset(before)
        delete(spark, folder)


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and reread it: later plans start from the files, whichever
    executors are lost."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def input_bytes(spark: SparkSession, paths: Iterable[str]) -> int:
    """Stored size of tables, from Catalyst's statistics of their file listing."""
    reads = (spark.read.parquet(p) for p in paths)
    return sum(int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) for df in reads)


def size_session(spark: SparkSession, n_bytes: int) -> None:
    """Set ``sizing_conf`` of this input on the session."""
    for key, value in sizing_conf(n_bytes).items():
        spark.conf.set(key, value)


def sizing_conf(
    n_bytes: int,
    split_bytes: int = 1 << 30,
    bytes_per_shuffle_partition: int = 1 << 30,
    advisory_bytes: int = 256 << 20,
    min_partitions: int = 8,
) -> dict[str, str]:
    """Scan and shuffle sizing for an input of ``n_bytes``.

    Scans split files at ``split_bytes``. The first shuffle gets one partition
    per ``bytes_per_shuffle_partition`` of input; AQE then coalesces every
    stage to ``advisory_bytes`` and splits skewed partitions.
    """
    parts = max(min_partitions, -(-int(n_bytes) // int(bytes_per_shuffle_partition)))
    return {
        "spark.sql.files.maxPartitionBytes": f"{int(split_bytes)}b",
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(parts),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": f"{int(advisory_bytes)}b",
    }
