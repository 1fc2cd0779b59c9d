"""A corpus pipeline of five stages over ``documents``: host-level quality rules,
n-gram Jaccard join, personal data, mixing to target weights, packing.

Each stage is written as Parquet below the shared checkpoint folder and read again as
the next one's ``docs``, so a lost executor never repeats an earlier stage.  All but
the last return the columns of ``docs`` as they came, extra ones included.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexivec.llm import jaccard_join, mixing, packing, pii, quality_rules
from lexivec.llm.common import TEXT_ROW_GROUP, prepare, staged, table
from lexivec.llm.tokens import vocabulary

#: Row number within a stage: the scan of a written table numbers its rows alike each time.
ROW = "_lexivec_row"


def _numbered(docs: DataFrame) -> DataFrame:
    return docs.withColumn(ROW, F.monotonically_increasing_id())


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and their host's verdict keep."""
    return quality_rules.judge(docs).where(F.col(f"{quality_rules.VERDICT}.kept")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (of smallest id) of each group of five-word shingle similarity 0.8;
    documents without words are in no group and stay."""
    rows = _numbered(docs)
    groups = staged(jaccard_join.linked(rows, k=5, num=80, den=100, key=ROW).select(ROW, "component_id"), "pipeline-groups")
    firsts = groups.join(rows.select(ROW, "doc_id"), ROW).groupBy("component_id") \
        .agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", ROW)).alias("first")) \
        .select(F.col(f"first.{ROW}").alias(ROW))
    return rows.join(firsts, ROW, "left_semi").select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data masked."""
    prepare(spark)
    return pii.redact(docs, pii.fit(docs))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: 0 to 3 rows."""
    rows = _numbered(docs)
    copies = mixing.mix(rows, key=ROW).where("taken > 0").select(ROW, (F.col("taken") / F.col("size")).cast("int").alias("_copies"))
    return rows.join(copies, ROW).withColumn("_copies", F.explode(F.sequence(F.lit(1), "_copies"))).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the sequences, with their ids."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [("quality rules", quality), ("n-gram Jaccard join", near_duplicates), ("PII", personal_data),
          ("mixing", mixture), ("packing", packed)]

#: Masking, the knapsack and packing can't be written as SQL; tests hold each stage's operator against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"), TEXT_ROW_GROUP)
    return STAGES[-1][1](spark, docs, sf_dir)
