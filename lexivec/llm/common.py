"""Helpers shared by the operators: stage tables in the shared folder, text
splitting rules, unsigned hashes."""

from __future__ import annotations

import uuid

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexivec.session import ensure_checkpoint_dir, ensure_package

#: Characters between words, as a Java/DuckDB regular expression class.
SPACE = "[\\x20\\x09-\\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    ensure_checkpoint_dir(spark)
    ensure_package(spark)


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the cluster's shared ``spark.checkpoint.dir``."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


#: Row groups of tables that hold whole texts, in bytes: what a writing task buffers.
TEXT_ROW_GROUP = 16 << 20


def staged(df: DataFrame, name: str, row_group: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage is
    cut, and a lost executor costs no recomputation of what went before."""
    path = shared_path(df.sparkSession, name)
    write = df.write if row_group is None else df.write.option("parquet.block.size", row_group)
    write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finalizer (multiply, xor-shift) of uint64 values, one per seed."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((seed * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles of a whole text.
    ASCII letters are lower-cased; words are runs of characters other than
    space and U+0009-U+000D.  A text of fewer words is one shingle of all its
    words; without words there is none."""
    words = utf8(text).lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh3_64_intdigest
    if n < k:
        return np.array([digest(b" ".join(words), seed=n)], np.uint64)
    h = np.fromiter(map(digest, words), np.uint64, n)
    with np.errstate(over="ignore"):
        out = mix(h[: n - k + 1])
        for i in range(1, k):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i: n - k + 1 + i])
    return np.unique(out)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def word_count(text):
    """Number of words of a text column (null: 0)."""
    return F.coalesce(F.size(F.filter(F.split(text, SPACE + "+"), lambda w: w != "")), F.lit(0)).cast("long")
