"""URL allow and block rules by a sort-merge range join.

A rule (host, path) holds for its host and all subdomains if the url's path starts with the rule's.
With the host's labels reversed and a dot behind each ("com.example.") the host and its subdomains
are the keys that begin with the rule's key: an interval, and intervals of rules nest or are apart.

* A url's key is its reversed host, its path and its row's hash; cut points of a bounded sample of keys
  split the sorted keys into parts, so also the urls of one host, or copies of one url, are spread.
* Each rule goes to the parts that its interval touches; urls and rules are shuffled by part and
  sorted by key together.
* A sweep over a part keeps a stack of the rules whose interval is open. The longest (host + path)
  of the stack whose path fits decides; of equals the one of the longer host.

Null urls, and urls without "://": host and path are empty, no rule fits. No rule fits: ``default``
verdict and a null rule. Of rules with the same host and path, block goes before allow. Null page_id
and repeated rows: each row is judged. Empty pages: no row; empty rules: the default for all.
Other columns are left out.
"""

from __future__ import annotations

from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship

RULES = "host string, path string, verdict string"
JUDGED = "page_id long, host string, path string, rule string, verdict string"
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SWEPT = "part int, key string, kind int, page_id long, host string, path string, verdict string"


def parse(pages: DataFrame) -> DataFrame:
    """(page_id, host, path): the host after the first "://" up to /, ?, # or the end, A-Z in small letters;
    the path from there up to ?, # or the end."""
    rest = F.regexp_extract("url", r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), _CAPITALS, _SMALL)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*(/[^?#]*)", 1)
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.coalesce(host, F.lit("")).alias("host"),
        F.coalesce(path, F.lit("")).alias("path"),
    )


def host_key(host) -> F.Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def cut_points(keys: DataFrame, parts: int, each: int) -> list[str]:
    """parts - 1 keys at equal distances among the parts * each keys with the smallest hash."""
    if parts < 2:
        return []
    sample = keys.orderBy(F.xxhash64("key"), "key").limit(parts * each).toArrow().column("key").to_pylist()
    # Spark sorts strings by their bytes; Python by code points: the same order
    sample.sort()
    return sorted({sample[i * len(sample) // parts] for i in range(1, parts)}) if sample else []


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", parts: int | None = None, sample: int = 100) -> DataFrame:
    """page_id, host, path, rule, verdict of every row. pages: (page_id, url); rules: (host, path, verdict)."""
    spark = pages.sparkSession
    ship(spark)
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    row = F.hex(F.xxhash64("page_id", "host", "path"))
    urls = parse(pages)
    urls = urls.withColumn("key", F.concat(host_key("host"), F.col("path"), F.lit(" "), row))
    cuts = cut_points(urls.select("key"), parts, sample)

    def part_of(batches):
        for batch in batches:
            at = [bisect_right(cuts, k) for k in batch.column("key").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *batch.columns], ["part", *batch.schema.names])

    urls = urls.select("key", F.lit(1).alias("kind"), "page_id", "host", "path", F.lit(None).cast("string").alias("verdict"))
    urls = urls.mapInArrow(part_of, _SWEPT)
    least = F.translate("host", _CAPITALS, _SMALL)
    ranges = rules.groupBy(least.alias("host"), F.coalesce("path", F.lit("")).alias("path")).agg(F.max("verdict").alias("verdict"))
    ranges = ranges.where(F.col("host").isNotNull()).withColumn("key", host_key("host"))

    def touched(batches):
        for batch in batches:
            rows, at = [], []
            for i, key in enumerate(batch.column("key").to_pylist()):
                first, last = bisect_right(cuts, key), bisect_right(cuts, key[:-1] + "/")  # "/" comes next after "."
                rows += [i] * (last - first + 1)
                at += range(first, last + 1)
            picked = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *picked.columns], ["part", *batch.schema.names])

    ranges = ranges.select("key", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("page_id"), "host", "path", "verdict")
    ranges = ranges.mapInArrow(touched, _SWEPT)

    def sweep(batches):
        part, stack = None, []  # open intervals: (key, [(rule, path, verdict), longest first])
        for batch in batches:
            out = []
            for at, key, kind, page_id, host, path, verdict in zip(*(c.to_pylist() for c in batch.columns)):
                if at != part:
                    part, stack = at, []
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if kind == 0:
                    if not stack or stack[-1][0] != key:
                        stack.append((key, []))
                    stack[-1][1].append((host + path, path, verdict))
                    continue
                fit = [(len(rule), -depth, rule, v) for depth, (_, own) in enumerate(reversed(stack)) for rule, p, v in own if path.startswith(p)]
                _, _, rule, verdict = max(fit, default=(0, 0, None, default))
                out.append((page_id, host, path, rule, verdict))
            types = [pa.int64(), *[pa.string()] * 4]
            names = [f.split()[0] for f in JUDGED.split(", ")]
            columns = zip(*out) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    both = ranges.unionByName(urls).repartition(parts, "part").sortWithinPartitions("part", "key", "kind")
    return both.mapInArrow(sweep, JUDGED)


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, RULES)
