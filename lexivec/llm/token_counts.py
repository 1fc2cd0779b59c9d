"""Token counts through a digest cache (operator 7).

A text's *content digest* is the SHA-256 of its normalised content; a tokenizer's
*version digest* is the SHA-256 of its file.  Counts are stored by the two digests
in a Parquet cache.  A run joins the distinct contents to the cache, encodes only
those it lacks, appends them, and joins all rows to the cache by digest.

Equal contents meet by a partial aggregate before the shuffle, so a text that a
third of all rows share is sent once per map task and encoded once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexivec.llm import tokens
from lexivec.llm.common import prepare, shared_path

CACHE = T.StructType([T.StructField("tokenizer", T.StringType()), T.StructField("content", T.BinaryType()),
                      T.StructField("n_tokens", T.LongType())])


def normalised(text: Column, drops_space: bool) -> Column:
    """The content that the digest stands for.  Runs of blanks and line ends
    become one blank where the tokenizer drops white space; its ids are the same
    for every text of the same normalised content."""
    text = F.coalesce(text, F.lit(""))
    return F.trim(F.regexp_replace(text, "[ \\t\\r\\n]+", " ")) if drops_space else text


def read_cache(spark, path: str, version: str) -> DataFrame:
    """Stored counts of one tokenizer version, one row per content; no rows when
    the cache doesn't exist yet."""
    try:
        stored = spark.read.schema(CACHE).parquet(path)
    except AnalysisException:
        stored = spark.createDataFrame([], CACHE)
    return stored.where(F.col("tokenizer") == version).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str | None = None, limit: int = 2048,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``n_bytes`` (UTF-8), ``n_tokens`` (no
    added tokens, special strings handled as the library does by default) and
    ``over_limit``.

    Null text counts as empty (0 bytes, 0 tokens).  Repeated rows and null ids are
    kept.  Texts of any length are encoded whole.  Other columns are ignored.  An
    empty table gives no rows."""
    spark = docs.sparkSession
    prepare(spark)
    cache_path = cache_path or shared_path(spark, "token-count-cache")
    version = tokens.tokenizer_digest(tokenizer_path)
    norm = normalised(F.col(text_col), tokens.UnitEncoder(tokenizer_path).drops_space)
    content = F.unhex(F.sha2(norm, 256))

    distinct = docs.select(content.alias("content"), norm.alias("norm")) \
        .groupBy("content").agg(F.first("norm").alias("norm"))
    misses = distinct.join(read_cache(spark, cache_path, version), "content", "left_anti")

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = tokens.encoder(tokenizer_path)
        for b in batches:
            ids = enc.encode(b["norm"].tolist())
            yield pd.DataFrame({"tokenizer": version, "content": b["content"], "n_tokens": [len(x) for x in ids]})

    misses.mapInPandas(encode, CACHE).write.mode("append").parquet(cache_path)
    rows = docs.select(F.col(id_col).alias(id_col), F.coalesce(F.octet_length(F.col(text_col)), F.lit(0))
                       .cast("long").alias("n_bytes"), content.alias("content"))
    return rows.join(read_cache(spark, cache_path, version), "content") \
        .select(id_col, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
