"""Small tables with every odd case, and brute-force versions of the operators."""

import re

import duckdb

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG"

# columns whose names the operators use themselves
CLASHES = ("fp", "key", "row", "uid", "ids", "seeds", "spans", "vec", "leaf", "score", "rank", "part", "text_", "d", "fingerprint", "left", "left_", "fp_", "same_id", "no_id", "turn", "first_id")


def rows_of(name="documents", columns="doc_id, text", sf=SF):
    return duckdb.sql(f"SELECT {columns} FROM '{sf}/{name}.parquet'").fetchall()


def with_clashes(df, skip=()):
    from pyspark.sql import functions as F
    return df.withColumns({c: F.lit("x") for c in CLASHES if c not in skip and c not in df.columns})


def words(text):
    return WORD.findall(text or "")


def odd_texts():
    prose = " ".join(f"w{i}" for i in range(120))
    return [
        (0, "one two three four five six seven eight nine ten"),
        (1, "One TWO three four five six seven eight nine ten"),
        (2, None),
        (3, ""),
        (4, " \t\n "),
        (5, prose),
        (6, "lead " + prose + " tail"),
        (7, prose),
        (7, prose),
        (8, "x"),
        (None, prose + " more"),
        (None, None),
        (9, "été 東京 x \U0001f600 " + "\x0b\x0c\r\n" + "a b"),
        (10, "long " * 30_000 + prose),
        (11, "<|endoftext|> it's I'll  we've   x\n\n\ty"),
    ]


def odd_docs(spark):
    return with_clashes(spark.createDataFrame([(i, t, "en", "s", 0) for i, t in odd_texts()], DOCS))


def no_docs(spark):
    return spark.createDataFrame([], DOCS)


def tuples(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)
