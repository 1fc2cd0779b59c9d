"""Driver tables and the views every query derives from them.

The same views are written in DuckDB SQL for the oracle check
(``lexivec/plans/oracle_sql.py``); keep both in step.

* ``tok``      documents of all languages, lowercased, split on non-letters, empties dropped
* ``sent``     the same tokens, split on newline first (contexts never cross lines)
* tagging      ``token/TAG`` with TAG = N, V, J for ``length % 3`` = 0, 1, 2 — a
               deterministic stand-in for a tagger, not an operator
* ``lexicon``  ``embeddings`` as unigram vectors ``w<vec_id>/<TAG>`` (TAG N for
               label < 7, J for 7-8, V for 9), doubles
* ``phrases``  two phrases per embedding row ``i`` (its own token is always known,
               its partners only when they are nouns), with n the number of embeddings:
               ``w<i>/<tag_i>_w<(7i+1)%n>/N`` and
               ``w<(3i+2)%n>/N_w<i>/<tag_i>_w<(11i+5)%n>/N``
* ``svo``      distinct ``(w<l_partkey%n>/N, v<l_linenumber>/V, w<l_suppkey%n>/N)``
               from ``lineitem``
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

# Fixed values of the derived views.
TOKEN_SPLIT = r"[^\p{L}]+"
#: Session setting: tasks that a corpus scan is dealt to; unset, it is read as stored.
SPREAD_SETTING = "spark.lexivec.corpusPartitions"


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def read_corpus(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """A text table.  A table stored as a single row group is read by one task; where
    the session sets ``SPREAD_SETTING`` its rows are dealt to that many tasks."""
    df = read_table(spark, sf_dir, name)
    parts = spark.conf.get(SPREAD_SETTING, None)
    return df.repartition(int(parts)) if parts else df


def tokens_of(text) -> Column:
    """Lowercase, split on non-letters, drop empty strings."""
    t = F.col(text) if isinstance(text, str) else text
    return F.array_remove(F.split(F.lower(t), TOKEN_SPLIT), "")


def tag_by_length(token) -> Column:
    t = F.col(token) if isinstance(token, str) else token
    m = F.length(t) % 3
    return F.concat(t, F.lit("/"), F.when(m == 0, "N").when(m == 1, "V").otherwise("J"))


def tokens(documents: DataFrame) -> DataFrame:
    """``tok(doc_id, pos, token)``."""
    return documents.select("doc_id", F.posexplode(tokens_of("text")).alias("pos", "token"))


def sentences(documents: DataFrame, tagged: bool = True) -> DataFrame:
    """``sent(doc_id, line_no, toks ARRAY<STRING>)``: one row per non-empty line."""
    lines = documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    toks = tokens_of("line")
    if tagged:
        toks = F.transform(toks, lambda t: tag_by_length(t))
    return lines.select("doc_id", "line_no", toks.alias("toks")).where(F.size("toks") > 0)


def lexicon(embeddings: DataFrame) -> DataFrame:
    """Unigram vectors ``(entry, vec_id, vec ARRAY<DOUBLE>)`` from ``embeddings``."""
    tag = F.when(F.col("label") < 7, "N").when(F.col("label") < 9, "J").otherwise("V")
    return embeddings.select(
        F.concat(F.lit("w"), F.col("vec_id").cast("string"), F.lit("/"), tag).alias("entry"),
        "vec_id",
        F.transform("embedding", lambda x: x.cast("double")).alias("vec"))


def phrases(embeddings: DataFrame) -> DataFrame:
    """``(phrase, ord)`` — the phrase list, in input order ``ord``."""
    n = embeddings.count()
    i = F.col("vec_id")
    tag = F.when(F.col("label") < 7, "N").when(F.col("label") < 9, "J").otherwise("V")

    def w(idx, t):
        return F.concat(F.lit("w"), idx.cast("string"), F.lit("/"), t)

    own = w(i, tag)
    p2 = F.concat_ws("_", own, w((i * 7 + 1) % n, F.lit("N")))
    p3 = F.concat_ws("_", w((i * 3 + 2) % n, F.lit("N")), own,
                     w((i * 11 + 5) % n, F.lit("N")))
    return embeddings.select(F.explode(F.array(
        F.struct(p2.alias("phrase"), (i * 2).alias("ord")),
        F.struct(p3.alias("phrase"), (i * 2 + 1).alias("ord")))).alias("p")).select("p.*")


def svo_triples(lineitem: DataFrame, n_vectors: int) -> DataFrame:
    """``svo(subj, verb, obj, phrase)``, distinct, over ``n_vectors`` nouns."""
    # numbers are told apart in less room than the words made of them
    t = lineitem.select((F.col("l_partkey") % n_vectors).alias("s"), F.col("l_linenumber").alias("v"),
                        (F.col("l_suppkey") % n_vectors).alias("o")).dropDuplicates()
    word = lambda letter, c, tag: F.concat(F.lit(letter), F.col(c).cast("string"), F.lit(tag))
    t = t.select(word("w", "s", "/N").alias("subj"), word("v", "v", "/V").alias("verb"), word("w", "o", "/N").alias("obj"))
    return t.withColumn("phrase", F.concat_ws("_", "subj", "verb", "obj"))


def labelled_docs(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, y)`` — quality label as the binary class."""
    return labels.select("doc_id", F.col("quality").cast("int").alias("y")).join(
        documents.select("doc_id"), "doc_id", "left_semi")
