"""Users, events and subscriptions in buckets by user, so that joins and aggregates by user need no shuffle.

``write_model`` stores each relation in the same number of buckets by a hash of user_id, sorted within each; the number
follows from the rows and the stored size of the largest relation, so that a task, which sorts and joins a whole bucket, takes about as much memory however large they are. A session gets to know the stored tables by name
(``register``, from a small file beside each), which reads no data. A scan then hands each bucket to one task, and Spark plans the funnel, the
readout, revenue and churn without an exchange by user_id.

One task a bucket is too much for a bucket that holds a user with very many events. ``read_model`` looks at the files'
sizes: where the largest bucket is over ``SKEW`` times the mean, that relation is read as plain files, which any number of tasks
share, and its aggregate by user takes an exchange with map-side partial sums.
"""

from __future__ import annotations

import json
import re
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructField

from ..session import input_bytes
from . import snapshots
from .model import Model
from .tables import MODEL_SCHEMAS

# rows of few stored bytes take a task as much memory as others (about 160 bytes a row of events)
BUCKET_ROWS, BUCKET_BYTES = 1 << 20, 64 << 20
MOST_BUCKETS = "spark.sql.sources.bucketing.maxBuckets"
SKEW = 4.0
# Spark names a bucket's file by its number, before the ending
_BUCKET_OF = re.compile(r"_(\d{5})(?:\.|$)")


def _name(path: str) -> str:
    """A table name for a folder."""
    return "bucketed_" + re.sub(r"\W+", "_", path.strip("/")).lower()


def write(df: DataFrame, path: str, buckets: int) -> None:
    """Store ``df`` (user_id, ...) in ``buckets`` buckets below ``path``, which must not exist yet."""
    spark, name = df.sparkSession, _name(path)
    # one file a bucket: rows of a bucket come to one task, split further by none; NULL keys lie in one bucket
    dealt = df.repartition(buckets, "user_id")
    dealt.write.bucketBy(buckets, "user_id").sortBy("user_id").option("path", path).saveAsTable(name)
    _, fs, at = snapshots._file_system(spark, path)
    out = fs.create(at(f"{path}.buckets"), True)
    try:
        out.write(bytearray(json.dumps({"buckets": buckets, "schema": df.schema.jsonValue()}).encode()))
    finally:
        out.close()


def register(spark: SparkSession, path: str) -> str:
    """Make the stored table known to this session; returns its name."""
    name = _name(path)
    if not spark.catalog.tableExists(name):
        about = _about(spark, path)
        columns = ", ".join(f"`{f['name']}` {StructField.fromJson(f).dataType.simpleString()}" for f in about["schema"]["fields"])
        spark.sql(
            f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (user_id) SORTED BY (user_id) INTO {int(about['buckets'])} BUCKETS "
            f"LOCATION '{path}'"
        )
    return name


def _about(spark: SparkSession, path: str) -> dict:
    """Number of buckets and schema, from the file beside the table."""
    return json.loads("".join(r.value for r in spark.read.text(f"{path}.buckets").collect()))


def bucket_bytes(spark: SparkSession, path: str) -> dict[int, int]:
    """Stored bytes of each bucket, from the listing of the files."""
    _, fs, at = snapshots._file_system(spark, path)
    found: dict[int, int] = defaultdict(int)
    for s in fs.listStatus(at(path)):
        name = s.getPath().getName()
        bucket = _BUCKET_OF.search(name)
        if bucket and not name.startswith(("_", ".")):
            found[int(bucket[1])] += s.getLen()
    return dict(found)


def is_skewed(sizes: dict[int, int], buckets: int) -> bool:
    return bool(sizes) and max(sizes.values()) > SKEW * sum(sizes.values()) / buckets


def read(spark: SparkSession, path: str) -> DataFrame:
    """The table by its buckets; as plain files where one bucket is far larger than the others."""
    table = spark.table(register(spark, path))
    if is_skewed(bucket_bytes(spark, path), _about(spark, path)["buckets"]):
        return spark.read.schema(table.schema).parquet(path)
    return table


def write_model(model: Model, base_dir: str, buckets: int | None = None) -> None:
    """Store the three relations in equal buckets. Without ``buckets``, one for each ``BUCKET_ROWS`` or ``BUCKET_BYTES`` of
    the largest relation as plain files, which are written first; no more than Spark allows a table."""
    base, spark = base_dir.rstrip("/"), model.users.sparkSession
    if buckets is None:
        for name, df in zip(MODEL_SCHEMAS, model):
            df.write.parquet(f"{base}/_plain/{name}")
        model = Model(*(spark.read.parquet(f"{base}/_plain/{n}") for n in MODEL_SCHEMAS))
        by_bytes = (-(-input_bytes(spark, [f"{base}/_plain/{n}"]) // BUCKET_BYTES) for n in MODEL_SCHEMAS)
        by_rows = (-(-df.count() // BUCKET_ROWS) for df in model)  # from the files' footers
        buckets = min(max(1, *by_bytes, *by_rows), int(spark.conf.get(MOST_BUCKETS, "100000")))
    for name, df in zip(MODEL_SCHEMAS, model):
        write(df, f"{base}/{name}", buckets)


def read_model(spark: SparkSession, base_dir: str) -> Model:
    return Model(*(read(spark, f"{base_dir.rstrip('/')}/{n}") for n in MODEL_SCHEMAS))
