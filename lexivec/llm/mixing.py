"""Mixing sources to target weights by subset-sum budget fitting (operator 6).

A source's target is its share of all words by weight, at most ``MOST_COPIES`` times
its size (the excess goes to the other sources by weight).  A source takes each
document as often as its target holds the whole source, and the budget that remains
is fitted by documents counted by exact length: first the proportional number of
each length, then a greedy step down to a bounded remainder, which a bounded-knapsack
dynamic program over the remaining length counts hits as nearly as it can be hit from
below.  Of each length the planned number of documents is selected by seeded hash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexivec.llm.common import prepare, staged, word_count
from lexivec.operators.indexing import global_index

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
#: Words of budget that the dynamic program fits at most (bits of its state).
PROGRAM_WORDS = 1 << 16
#: Rows that one seeded bucket of a length has about.
BUCKET_ROWS = 4096


def fit(size: np.ndarray, count: np.ndarray, budget: int) -> np.ndarray:
    """How many copies of each size to take: at most ``count``, their words at
    most ``budget`` and near it (the best reachable remainder after the bulk)."""
    take = np.zeros(len(size), np.int64)
    total = int((size * count).sum())
    if budget <= 0 or not total:
        return take
    if budget >= total:
        return count.astype(np.int64).copy()
    take = np.array([c * budget // total for c in count.tolist()], np.int64)
    left = budget - int((size * take).sum())
    for i in np.argsort(-size, kind="stable").tolist():
        if left <= PROGRAM_WORDS:
            break
        n = min(int(count[i] - take[i]), left // int(size[i]))
        take[i] += n
        left -= n * int(size[i])
    # reachable sums as the bits of an integer; one step per (size, power of two)
    mask, reach, steps = (1 << (left + 1)) - 1, 1, []
    for i in np.argsort(-size, kind="stable").tolist():
        n, part = min(int(count[i] - take[i]), left // int(size[i])), 1
        while n > 0 and not reach >> left & 1:
            k = min(part, n)
            steps.append((i, k, reach))
            reach |= reach << (k * int(size[i])) & mask
            n, part = n - k, part * 2
        if reach >> left & 1:
            break
    at = reach.bit_length() - 1
    for i, k, before in reversed(steps):
        if not before >> at & 1:
            take[i] += k
            at -= k * int(size[i])
    return take


def targets(rows: DataFrame) -> DataFrame:
    """One row per source: ``source, source_size, target``.  Works on the table of
    sources; the driver sees one sum per round of resharing."""
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = global_index(sources, [F.col("source").asc_nulls_last()], col="rank")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("rank") % len(WEIGHTS)).cast("int") + 1)
    ranked = staged(ranked.select("source", "source_size", weight.cast("double").alias("weight")), "mix-sources")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    cap, share, at_cap = F.lit(MOST_COPIES) * F.col("source_size"), float("inf"), -1
    unit = 0.0
    while True:
        capped = F.col("weight") * F.lit(share) >= cap if share != float("inf") else F.lit(False)
        now = ranked.agg(F.sum(F.when(capped, cap)).alias("words"), F.sum(F.when(~capped, F.col("weight"))).alias("weight"),
                         F.sum(capped.cast("long")).alias("n")).first()
        if (now["n"] or 0) == at_cap or not now["weight"]:
            break
        at_cap = now["n"] or 0
        unit = share = (total - (now["words"] or 0)) / now["weight"]
    target = F.least(F.col("weight") * F.lit(unit), cap.cast("double"))
    return ranked.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, seed: int = 1, key: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of ``docs``: its ``key``, ``source, size, source_size, target,
    taken`` (words that the mix takes of it: 0 to 3 times its size).

    Null text has size 0 and is never taken; documents without a source are a source
    of their own, the last.  Rows that agree in key, source and size are
    interchangeable: the planned number of them is taken.  Other columns are
    ignored; an empty table gives no rows.  A rerun takes the same."""
    spark = docs.sparkSession
    prepare(spark)
    rows = staged(docs.select(F.col(key).alias("key"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
                  .withColumn("hash", F.xxhash64("key", F.lit(seed))), "mix-rows")
    aims = staged(targets(rows), "mix-targets")

    lengths = rows.where("size > 0").groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    budgets = lengths.join(aims.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")

    def plan(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("size")
        whole, target = int(p["source_size"].iloc[0]), float(p["target"].iloc[0])
        full = min(int(target // whole), MOST_COPIES)
        n = p["n"].to_numpy(np.int64)
        copies = fit(p["size"].to_numpy(np.int64), n * (MOST_COPIES - full), int(target - full * whole))
        return p.assign(full=full + copies // n, more=copies % n)[["source", "size", "n", "full", "more", "source_size", "target"]]

    planned = staged(budgets.groupBy("source").applyInPandas(
        plan, "source string, size long, n long, full long, more long, source_size long, target double"), "mix-plan")

    # a group's rows in the order of (bucket, hash): whole buckets, then part of one
    p = planned.select(F.col("source").alias("ps"), F.col("size").alias("pz"), "n", "full", "more")
    a = aims.select(F.col("source").alias("as_"), "source_size", "target")
    joined = staged(
        rows.join(p, F.col("source").eqNullSafe(F.col("ps")) & (F.col("size") == F.col("pz")), "left")
        .join(a, F.col("source").eqNullSafe(F.col("as_")))
        .withColumn("bucket", F.pmod("hash", F.ceil(F.coalesce(F.col("n"), F.lit(1)) / BUCKET_ROWS)))
        .select("key", "source", "size", "hash", "n", "full", "more", "source_size", "target", "bucket"), "mix-joined")
    cut = (F.col("more") > 0) & (F.col("more") < F.col("n"))
    open_ = joined.where(cut)
    buckets = open_.groupBy("source", "size", "bucket").agg(F.count(F.lit(1)).alias("held"))
    before = Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("before", F.coalesce(F.sum("held").over(before), F.lit(0))) \
        .select(F.col("source").alias("bs"), F.col("size").alias("bz"), F.col("bucket").alias("bb"), "held", "before")
    placed = open_.join(buckets, F.col("source").eqNullSafe(F.col("bs")) & (F.col("size") == F.col("bz"))
                        & (F.col("bucket") == F.col("bb"))).drop("bs", "bz", "bb")
    whole = F.col("before") + F.col("held") <= F.col("more")
    none = F.col("before") >= F.col("more")
    rank = F.row_number().over(Window.partitionBy("source", "size", "bucket").orderBy("hash", "key"))
    edge = placed.where(~whole & ~none).withColumn("extra", (rank + F.col("before") <= F.col("more")).cast("long"))
    columns = ["key", "source", "size", "source_size", "target", "full", "extra"]
    out = joined.where(F.coalesce(~cut, F.lit(True))).withColumn("extra", (F.coalesce(F.col("more"), F.lit(0)) > 0).cast("long")).select(columns) \
        .unionByName(placed.where(whole | none).withColumn("extra", whole.cast("long")).select(columns)) \
        .unionByName(edge.select(columns))
    taken = F.col("size") * (F.coalesce(F.col("full"), F.lit(0)) + F.col("extra"))
    return out.select(F.col("key").alias(key), "source", "size", "source_size", "target", taken.alias("taken"))
