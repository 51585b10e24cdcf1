"""The registered queries of the llm operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    ann_tree, bpe, conversation_repair, exact_topk, fp_search, langid, packing, pii, sign_dedup, simhash, sql, substring, token_store, url_rules,
)
from .common import new_path
from .encoder import vocabulary


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op1_exact_topk(spark: SparkSession, d: str) -> DataFrame:
    """The 20 largest inner products of floor(64 x) for every 20th vector, against all."""
    vectors = exact_topk.whole_numbers(_table(spark, d, "embeddings"), 64.0)
    return exact_topk.exact_topk(vectors.where(F.col("vec_id") % 20 == 0), vectors, k=20)


def op2_kmeans_tree(spark: SparkSession, d: str) -> DataFrame:
    """The 10 nearest found for every 100th vector, among all."""
    vectors = ann_tree.searchable(_table(spark, d, "embeddings"))
    return ann_tree.nearest_neighbours(vectors.where(F.col("vec_id") % 100 == 0), vectors, k=10)


def op3_simhash(spark: SparkSession, d: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, d, "documents"), shingle=4, max_bits=4)


def op4_url_rules(spark: SparkSession, d: str) -> DataFrame:
    return url_rules.judge(_table(spark, d, "pages"), url_rules.rule_table(spark, URL_RULES))


def op5_substring(spark: SparkSession, d: str) -> DataFrame:
    return substring.digest(_table(spark, d, "documents"))


def op6_token_store(spark: SparkSession, d: str) -> DataFrame:
    """Write all documents' ids to a store of its own, read it back, one row a document."""
    folder = new_path(spark, "token-store")
    token_store.write_tokens(_table(spark, d, "documents"), folder, vocabulary("byte_bpe_50k.json"), end_id=0)
    return token_store.digest(token_store.read_tokens(spark, folder))


def op7_pii(spark: SparkSession, d: str) -> DataFrame:
    return pii.digest(pii.personal_data(_table(spark, d, "documents")))


def op8_byte_bpe(spark: SparkSession, d: str) -> DataFrame:
    ranks = vocabulary("byte_bpe_50k.tiktoken")
    return bpe.digest(bpe.decode(bpe.encode(_table(spark, d, "documents"), ranks), ranks))


def op9_language(spark: SparkSession, d: str) -> DataFrame:
    return langid.identify(_table(spark, d, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op10_best_fit_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(_table(spark, d, "documents"), vocabulary("byte_bpe_50k.json"))


def op11_sign_dedup(spark: SparkSession, d: str) -> DataFrame:
    return sign_dedup.near_duplicates(_table(spark, d, "embeddings"), threshold=0.95)


def op12_fp_search(spark: SparkSession, d: str) -> DataFrame:
    """The 20 best documents of every benchmark item."""
    return fp_search.search(_table(spark, d, "documents"), _table(spark, d, "benchmark"), k=20)


def op13_conversation_repair(spark: SparkSession, d: str) -> DataFrame:
    return conversation_repair.damage_and_repair(_table(spark, d, "conversations"))


QUERIES = {
    "op1_exact_topk": op1_exact_topk,
    "op2_kmeans_tree": op2_kmeans_tree,
    "op3_simhash": op3_simhash,
    "op4_url_rules": op4_url_rules,
    "op5_substring": op5_substring,
    "op6_token_store": op6_token_store,
    "op7_pii": op7_pii,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_language": op9_language,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_sign_dedup": op11_sign_dedup,
    "op12_fp_search": op12_fp_search,
    "op13_conversation_repair": op13_conversation_repair,
}


def queries():
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(sql.ORACLES)
