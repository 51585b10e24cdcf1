"""Text search in a stored result by an index of trigrams.

For a stored result (``pages``) ``build`` writes, for each run of three characters of the rows' lower-cased texts, the places
of its rows in their files: postings of up to ``BLOCK`` ascending places, range-partitioned by trigram, file and block, so a
trigram that every row has is many small blocks in many tasks. ``search`` reads the postings of the term's trigrams only,
intersects them block by block, reads the files of the rows that have them all, and verifies these rows by ``contains``.
Terms under three characters have no trigram and scan the result. The answer is that of ``explore.result_search``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from . import pages

BLOCK = 1 << 16
GRAM = 3
FILE, AT = "row's file", "place in the file"


def row_text(columns: list[str]) -> Column:
    """A row as one lower-case text, as the search sees it."""
    return F.lower(F.concat_ws(" ", *[F.col(f"`{c}`").cast("string") for c in columns]))


def grams_of(text: str) -> list[str]:
    return sorted({text[i : i + GRAM] for i in range(len(text) - GRAM + 1)})


def build(result: pages.Result) -> str:
    """Write the index beside the result; returns its folder."""
    names = result.schema.names
    rows = result.spark.read.schema(result.schema).parquet(result.path)
    text = rows.select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("at"), row_text(names).alias("text"))
    text = text.where(F.length("text") >= GRAM)
    starts = F.sequence(F.lit(1), F.length("text") - (GRAM - 1))
    grams = F.array_distinct(F.transform(starts, lambda i: F.substr("text", i, F.lit(GRAM))))
    postings = text.select(F.explode(grams).alias("gram"), "file", F.floor(F.col("at") / BLOCK).alias("block"), "at")
    # at most BLOCK numbers each, however common the trigram
    blocks = postings.groupBy("gram", "file", "block").agg(F.sort_array(F.collect_list("at")).alias("rows"))
    path = f"{result.path}/_grams"
    parts = int(result.spark.conf.get("spark.sql.shuffle.partitions"))
    order = ("gram", "file", "block")
    blocks.repartitionByRange(parts, *order).sortWithinPartitions(*order).write.mode("overwrite").parquet(path)
    return path


def candidates(result: pages.Result, term: str) -> DataFrame:
    """(file, block, rows): places in the file of the rows that hold every trigram of the term."""
    grams = grams_of(term.lower())
    found = result.spark.read.parquet(f"{result.path}/_grams").where(F.col("gram").isin(grams))
    lists = found.groupBy("file", "block").agg(F.collect_list("rows").alias("lists")).where(F.size("lists") == len(grams))  # a list a trigram
    rows = F.aggregate(F.slice("lists", 2, len(grams)), F.element_at("lists", 1), lambda a, b: F.array_intersect(a, b))
    return lists.select("file", "block", rows.alias("rows")).where(F.size("rows") > 0)


def search(result: pages.Result, term: str) -> DataFrame:
    """Rows of the result whose text contains ``term``, case-insensitive."""
    names = result.schema.names
    wanted = F.contains(row_text(names), F.lit(term.lower()))
    read = result.spark.read.schema(result.schema)
    if len(term.lower()) < GRAM:
        return read.parquet(result.path).where(wanted)
    held = stored(candidates(result, term), "text-candidates")
    files = [f"{result.path}/{r.file}" for r in held.select("file").distinct().orderBy("file").collect()]  # names of the files to be read
    if not files:
        return result.spark.createDataFrame([], result.schema)
    rows = read.parquet(*files).select("*", F.col("_metadata.file_name").alias(FILE), F.col("_metadata.row_index").alias(AT))
    places = held.select(F.col("file").alias(FILE), F.explode("rows").alias(AT))
    return rows.join(places, [FILE, AT], "left_semi").where(wanted).select(*names)
