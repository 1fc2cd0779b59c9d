"""Co-occurrence counting, frequency filters, PPMI and type quotas
(F1, F2, C11, C12, F3, G1).

Long tables throughout: ``counts(entry, feature, n)``.  Every aggregate is a
hash aggregate with a map-side partial step, so a hot word is pre-combined
before the shuffle; window contexts are generated inside each sentence row, so
F2 needs no shuffle at all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexivec.functions.features import feature_type, pos_of
from lexivec.operators.indexing import materialize, rank_within

# Sample configuration of the counting stage (README of the reference).
MIN_FEATURE_FREQ = 40
MIN_EVENT_FREQ = 15
# Quotas of the SVD stage: most frequent entries kept per type.
TYPE_QUOTAS = (("N", 200000), ("V", 200000), ("J", 100000), ("RB", 0), ("AN", 0), ("NN", 0))


def window_pairs(sent: DataFrame, window: int = 2, prefix: str = "T:",
                 toks_col: str = "toks", token_fn=None, mirrored: bool = True) -> DataFrame:
    """``(entry, feature)`` for every token and each neighbour within
    ``±window`` in the same sentence.  Without ``mirrored`` the pairs of tokens come
    once, as ``(a, b)`` with a <= b, for ``count_events`` to mirror.

    For each offset d the pairs are ``arrays_zip(slice(toks, 1, n-d),
    slice(toks, 1+d, n-d))``; each zipped pair yields both directions.  Only
    codegen'd array functions are used (no lambdas), the work stays inside the
    scan stage and the output is exactly 2·Σ_d (n-d) rows per sentence.
    ``token_fn`` (e.g. a tagger) is applied to both sides after the explode.
    """
    toks = F.col(toks_col)
    n = F.size(toks)
    zipped = [F.arrays_zip(F.slice(toks, 1, F.greatest(n - d, F.lit(0))).alias("a"),
                           F.slice(toks, d + 1, F.greatest(n - d, F.lit(0))).alias("b"))
              for d in range(1, window + 1)]
    z = sent.where(n > 1).select(F.explode(F.concat(*zipped)).alias("z"))
    fn = token_fn or (lambda c: c)
    a, b = fn(F.col("z.a")), fn(F.col("z.b"))
    if not mirrored:
        return z.select(F.when(a > b, b).otherwise(a).alias("a"), F.when(a > b, a).otherwise(b).alias("b"))
    both = F.array(F.struct(a.alias("entry"), F.concat(F.lit(prefix), b).alias("feature")),
                   F.struct(b.alias("entry"), F.concat(F.lit(prefix), a).alias("feature")))
    return z.select(F.explode(both).alias("p")).select("p.entry", "p.feature")


def instance_pairs(instances: DataFrame) -> DataFrame:
    """A2 -> F1 input: ``instances(entry, features ARRAY)`` exploded."""
    return instances.select("entry", F.explode("features").alias("feature"))


def count_events(pairs: DataFrame, prefix: str = "T:") -> DataFrame:
    """``counts(entry, feature, n)``.  Pairs ``(a, b)`` that stand for both directions are
    counted once and mirrored after the shuffle, which then holds half the rows."""
    if pairs.columns == ["a", "b"]:
        n = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
        cell = lambda e, f, c: F.struct(F.col(e).alias("entry"), F.concat(F.lit(prefix), F.col(f)).alias("feature"), c.alias("n"))
        both = F.when(F.col("a").eqNullSafe(F.col("b")), F.array(cell("a", "b", F.col("n") * 2))) \
            .otherwise(F.array(cell("a", "b", F.col("n")), cell("b", "a", F.col("n"))))
        return n.select(F.explode(both).alias("p")).select("p.*")
    return pairs.groupBy("entry", "feature").agg(F.count(F.lit(1)).alias("n"))


def frequency_filter(counts: DataFrame, min_feature_freq: int = MIN_FEATURE_FREQ,
                     min_event_freq: int = MIN_EVENT_FREQ) -> DataFrame:
    """C11 (EXT-6): drop features whose total count is below ``min_feature_freq``,
    then events whose count is below ``min_event_freq``; both inclusive."""
    kept = (counts.groupBy("feature").agg(F.sum("n").alias("_ft"))
            .where(F.col("_ft") >= min_feature_freq).select("feature"))
    return (counts.where(F.col("n") >= min_event_freq)
            .join(kept, "feature", "left_semi")
            .select("entry", "feature", "n"))


def with_marginals(counts: DataFrame, materialize_input: bool = True) -> DataFrame:
    """Add ``entry_total``, ``feature_total`` and the grand ``total``.

    The counts feed four consumers (two marginals, the total, the cells); they
    are checkpointed once (S6) instead of re-deriving them from the corpus for
    each.  Pass ``materialize_input=False`` when the caller already did."""
    if materialize_input:
        counts = materialize(counts)
    et = counts.groupBy("entry").agg(F.sum("n").alias("entry_total"))
    ft = counts.groupBy("feature").agg(F.sum("n").alias("feature_total"))
    total = counts.select(F.sum("n")).scalar()
    return (counts.join(et, "entry").join(ft, "feature")
            .withColumn("total", total))


def ppmi(counts: DataFrame, keep_zeros: bool = False, materialize_input: bool = True) -> DataFrame:
    """F3 (EXT-7): ``max(0, ln(n·N / (n_entry·n_feature)))``; zero cells dropped."""
    m = with_marginals(counts, materialize_input)
    pmi = F.log(F.col("n").cast("double") * F.col("total")
                / (F.col("entry_total").cast("double") * F.col("feature_total")))
    out = m.select("entry", "feature", F.greatest(pmi, F.lit(0.0)).alias("weight"))
    return out if keep_zeros else out.where(F.col("weight") > 0)


def top_features(weights: DataFrame, k: int = 10, score: str = "weight") -> DataFrame:
    """Top-k features per entry (score desc, feature asc).  A constant k below
    Spark's window-group-limit threshold is applied before the shuffle too."""
    w = Window.partitionBy("entry").orderBy(F.desc(score), F.asc("feature"))
    return (weights.withColumn("rank", F.row_number().over(w))
            .where(F.col("rank") <= k)
            .withColumn("rank", F.col("rank").cast("long")))


def entry_type(entry) -> "F.Column":
    """G1 key: the PoS of a single word, else the phrase type."""
    t = feature_type(entry)
    return F.when(t == "1-GRAM", pos_of(entry)).otherwise(t)


def type_quota(counts: DataFrame, quotas=TYPE_QUOTAS) -> DataFrame:
    """G1 (EXT-9): keep the most frequent entries of each type (frequency = sum
    of the pre-PPMI counts, ties by entry); types without a quota keep none.

    Ranking is a distributed global index, not a window per type: a type can
    hold a third of all entries."""
    spark = counts.sparkSession
    freq = (counts.groupBy("entry").agg(F.sum("n").alias("total"))
            .withColumn("type", entry_type("entry")))
    quota = spark.createDataFrame(list(quotas), "type string, quota long")
    # the quota table is a fixed handful of rows
    freq = freq.join(F.broadcast(quota), "type").where(F.col("quota") > 0)
    ranked = rank_within(freq, ["type"], [F.desc("total"), F.asc("entry")], small_groups=True)
    return ranked.where(F.col("rank") <= F.col("quota")).select("entry", "type", "total", "rank")


def vocabulary(sentences_df: DataFrame, min_count: int = 50, toks_col: str = "toks") -> DataFrame:
    """Tokens seen at least ``min_count`` times."""
    return (sentences_df.select(F.explode(toks_col).alias("token"))
            .groupBy("token").agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") >= min_count))


def ngram_window_pairs(sent: DataFrame, n: int = 2, window: int = 2, prefix: str = "T:",
                       toks_col: str = "toks") -> DataFrame:
    """F2 for observed n-grams: entry = ``n`` adjacent tokens joined by ``_``,
    contexts = tokens within ``window`` of either end, outside the n-gram.

    For each context offset o (relative to the n-gram start) the n token
    columns and the context column are aligned ``slice``s of the sentence,
    zipped and exploded — codegen'd array functions only, no lambdas."""
    toks = F.col(toks_col)
    size = F.size(toks)
    zipped = []
    for o in list(range(-window, 0)) + list(range(n, n + window)):
        lo = max(0, -o)                                  # first valid n-gram start (0-based)
        length = F.greatest(F.least(size - n, size - 1 - o) - lo + 1, F.lit(0))
        parts = [F.slice(toks, lo + k + 1, length).alias(f"t{k}") for k in range(n)]
        zipped.append(F.arrays_zip(*parts, F.slice(toks, lo + o + 1, length).alias("c")))
    z = sent.where(size >= n).select(F.explode(F.concat(*zipped)).alias("z"))
    entry = F.concat_ws("_", *[F.col(f"z.t{k}") for k in range(n)])
    return z.select(entry.alias("entry"), F.concat(F.lit(prefix), F.col("z.c")).alias("feature"))
