"""The registered queries ``opN_<name>`` over the given tables, with production
parameters, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexivec.llm import (collocations, conversation_trie, embedding_graph, html_blocks, jaccard_join, license_scan, mixing, packing,
                         pii, quality_rules, token_counts, token_files, toxicity)
from lexivec.llm.common import table
from lexivec.llm.tokens import vocabulary


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json")).drop("ids")


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.linked(table(spark, sf_dir, "documents"), k=3, num=90, den=100).drop("cls")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.fit_and_score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"), ["doc_id"])
    return judged.select("doc_id", *(F.col(f"{quality_rules.VERDICT}.{c}").alias(c)
                                     for c in (*quality_rules.COUNTS, "base_failed", "kept")))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.encode_and_read(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.fit_and_detect(table(spark, sf_dir, "documents"))


def op9_embedding_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_graph.near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.extract(table(spark, sf_dir, "pages"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.prefix_trie(table(spark, sf_dir, "conversations")).drop("turn_ref1", "turn_ref2")


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = license_scan.scan(table(spark, sf_dir, "documents"), ["doc_id"])
    return scanned.select("doc_id", *(F.col(f"license.{c}").alias(c) for c in license_scan.COUNTS))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_packing, op2_jaccard_join, op3_toxicity, op4_quality_rules, op5_token_files, op6_mixing, op7_token_counts,
    op8_pii, op9_embedding_graph, op10_html_blocks, op11_conversation_trie, op12_license_scan, op13_collocations)}
SQL = {"op4_quality_rules": quality_rules.SQL, "op11_conversation_trie": conversation_trie.SQL,
       "op12_license_scan": license_scan.SQL, "op13_collocations": collocations.SQL}
