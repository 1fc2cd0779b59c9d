"""Connected components of an edge table by hooking and contraction.

Each round every node takes the smallest label near it (two pointer jumps make it
the neighbour's neighbour's), edges are renamed by the labels, and loops and doubles
go.  A component shrinks by a factor each round, so a few rounds do; each round's
tables are written to the shared folder.  Labels come from partial ``min``
aggregates, so a node with very many edges is no hot group, and nothing but the
number of remaining edges comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivec.llm.common import staged


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges``: two columns ``a, b`` of one type, without nulls.  Returns
    ``node, component`` (the smallest node of its component) for each node that has
    an edge to another one."""
    edges = staged(edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
    labels = None
    while labels is None or not edges.isEmpty():
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("label")) \
            .unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("label")))
        near = staged(both.groupBy("node").agg(F.min("label").alias("label"))
                      .select("node", F.least("node", "label").alias("label")), "cc-near")
        for _ in range(2):
            up = near.select(F.col("node").alias("label"), F.col("label").alias("top"))
            near = near.join(up, "label").select("node", F.col("top").alias("label"))
        near = staged(near, "cc-jumped")
        if labels is None:
            labels = near
        else:
            step = near.select(F.col("node").alias("label"), F.col("label").alias("top"))
            labels = staged(labels.join(step, "label", "left")
                            .select("node", F.coalesce("top", "label").alias("label")), "cc-labels")
        name_a = near.select(F.col("node").alias("a"), F.col("label").alias("x"))
        name_b = near.select(F.col("node").alias("b"), F.col("label").alias("y"))
        edges = staged(edges.join(name_a, "a").join(name_b, "b").where("x != y")
                       .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "cc-edges")
    return labels.select("node", F.col("label").alias("component"))
