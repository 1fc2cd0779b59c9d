"""Feature selection over labelled documents.

Inputs are long tables: ``docfeat(doc_id, feature, weight)`` and
``labels(doc_id, y)``.  Every score is a grouped aggregate per feature; masks
are joins on ``feature``; the surviving vocabulary is re-indexed with the
distributed dense index.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivec.operators.indexing import global_index


def chi2_scores(docfeat: DataFrame, labels: DataFrame) -> DataFrame:
    """the chi² statistic of each (non-negative) feature against the class.

    ``observed[c] = Σ weight over class-c documents``,
    ``expected[c] = P(c) · Σ weight`` and ``chi2 = Σ_c (O−E)²/E``.  Classes a
    feature never occurs in contribute ``E`` each; since ``Σ_c P(c) = 1`` they
    are folded in as ``total − Σ_observed-classes E`` — no feature × class
    cross product is built.
    """
    n_docs = labels.select(F.count(F.lit(1))).scalar()
    prior = labels.groupBy("y").agg((F.count(F.lit(1)) / n_docs).alias("p"))
    obs = (docfeat.join(labels, "doc_id")
           .groupBy("feature", "y").agg(F.sum("weight").alias("o")))
    tot = obs.groupBy("feature").agg(F.sum("o").alias("total"))
    # one row per class
    cells = obs.join(F.broadcast(prior), "y").join(tot, "feature") \
        .withColumn("e", F.col("p") * F.col("total"))
    per = cells.groupBy("feature").agg(
        F.sum((F.col("o") - F.col("e")) * (F.col("o") - F.col("e")) / F.col("e") - F.col("e")).alias("part"),
        F.first("total").alias("total"))
    return per.select("feature", (F.col("part") + F.col("total")).alias("score"))


def log_odds(docfeat: DataFrame, labels: DataFrame) -> DataFrame:
    """F8 (EXT-8): document-frequency log odds for a binary label,
    ``ln((df1+½)/(n1−df1+½)) − ln((df0+½)/(n0−df0+½))``."""
    classes = labels.select("y").distinct().count()
    if classes != 2:
        raise ValueError("Calculating a log odds score requires a binary classification task")
    n1 = labels.select(F.count_if(F.col("y") == 1)).scalar()
    n0 = labels.select(F.count_if(F.col("y") != 1)).scalar()
    df = (docfeat.where(F.col("weight") > 0).select("doc_id", "feature").distinct()
          .join(labels, "doc_id")
          .groupBy("feature").agg(F.count_if(F.col("y") == 1).alias("df1"),
                                  F.count_if(F.col("y") != 1).alias("df0")))
    lo = (F.log((F.col("df1") + 0.5) / (n1 - F.col("df1") + 0.5))
          - F.log((F.col("df0") + 0.5) / (n0 - F.col("df0") + 0.5)))
    return df.select("feature", lo.alias("log_odds"))


def log_odds_mask(docfeat: DataFrame, labels: DataFrame, min_log_odds: float) -> DataFrame:
    """Features with ``log_odds > t`` or ``< -t`` (strict); off when t <= 0."""
    feats = docfeat.select("feature").distinct()
    if min_log_odds <= 0:
        return feats
    lo = log_odds(docfeat, labels)
    return lo.where(F.abs("log_odds") > min_log_odds).select("feature")


def k_best(scores: DataFrame, k, mode: str = "keep_best") -> DataFrame:
    """The k best features by score (NaN ranks lowest, ties by feature).
    ``mode='drop_lowest'`` is the as-written behaviour (Q-3): drop the k lowest."""
    nan_last = F.when(F.isnan("score"), F.lit(float("-inf"))).otherwise(F.col("score"))
    if k == "all":
        return scores.select("feature")
    if mode == "keep_best":
        return scores.orderBy(nan_last.desc(), F.col("feature").asc()).limit(int(k)).select("feature")
    lowest = scores.orderBy(nan_last.asc(), F.col("feature").desc()).limit(int(k)).select("feature")
    return scores.select("feature").join(lowest, "feature", "left_anti")


def presence_mask(features: DataFrame, vector_entries: DataFrame | None,
                  clusters: DataFrame | None = None) -> DataFrame:
    """Features that have a vector (or a cluster); neither source is an
    error, and so is an empty result."""
    if vector_entries is None and clusters is None:
        raise ValueError("vector source (vectors or clusters) required with must_be_in_thesaurus")
    src = vector_entries if vector_entries is not None else clusters
    kept = features.join(src.select(F.col("entry").alias("feature")).distinct(), "feature", "left_semi")
    if kept.limit(1).count() == 0:
        raise ValueError("Empty vocabulary")
    return kept


def select_features(docfeat: DataFrame, labels: DataFrame, k="all", must_be_in_thesaurus: bool = False,
                    vector_entries: DataFrame | None = None, min_log_odds: float = 0.0,
                    mode: str = "keep_best", score_func=None, clusters: DataFrame | None = None) -> DataFrame:
    """Score (``score_func(docfeat, labels) -> (feature, score)``, chi²
    when None; all 1 when every feature is kept), AND of the three independent
    masks, survivors re-indexed by sorted feature: ``(feature, col_id, score)``."""
    score_func = score_func or chi2_scores
    feats = docfeat.select("feature").distinct()
    n_feats = feats.count()
    if k == "all" or int(k) >= n_feats:
        scores = feats.withColumn("score", F.lit(1.0))
        best = feats
    else:
        scores = score_func(docfeat, labels)
        best = k_best(scores, k, mode)
    keep = best
    if must_be_in_thesaurus:
        keep = keep.join(presence_mask(feats, vector_entries, clusters), "feature", "left_semi")
    if min_log_odds > 0:
        keep = keep.join(log_odds_mask(docfeat, labels, min_log_odds), "feature", "left_semi")
    out = global_index(scores.join(keep, "feature", "left_semi"), ["feature"], col="col_id")
    return out.select("feature", "col_id", "score")


def transform_docs(docfeat: DataFrame, selected: DataFrame) -> DataFrame:
    """Project documents on the surviving features, with their new ids; an
    empty vocabulary passes the documents through unchanged (logged)."""
    if selected.limit(1).count() == 0:
        logging.error("Empty vocabulary")
        return docfeat
    return docfeat.join(selected.select("feature", "col_id"), "feature")
