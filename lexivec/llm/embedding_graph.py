"""Near-duplicate embeddings by a robust-pruned flat graph (operator 9).

Distinct vectors are assigned to every cluster whose centroid is nearly as close as the
nearest one, so cluster shards overlap.  Each shard's task builds a graph: a
vector's candidates are its nearest ones in the shard, robustly pruned (a candidate
goes if a kept one is much closer to it than the vector is).  The adjacency lists of
all shards are united.  Then each shard is searched on the united graph: a greedy
beam search from the shard's medoid for each of its vectors, and from all found
within range the search expands along edges while it stays near the range.  Pairs
are verified in double precision; a pair found in several shards counts in the
first one that both share.

A sample of vectors is held against all others (in blocks) to audit recall: the share
of their links to other distinct vectors that was found.  It is drawn until ``LINKED``
of it have a link.  Below ``RECALL`` the graph is searched anew with more overlap and a
wider beam.  Where that does not help, or links are too rare to audit, all pairs of
vectors are compared in blocks.

A shard of more than ``BLOCK`` vectors, such as a dense group, is not searched by one
task: each two blocks of it are compared exactly in a group of their own.

Equal vectors are one node with a multiplicity, so copies make no pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivec.llm.common import prepare, staged
from lexivec.llm.components import connected_components

#: Vectors that centroids are fitted on, at most; vectors that a shard has about.
SAMPLE, SHARD_ROWS, MOST_CENTROIDS = 8192, 1500, 4096
#: Candidates of a vector, its out-degree, and the pruning factor.
POOL, DEGREE, ALPHA = 64, 24, 1.2
#: Beam of the greedy search; cosine below the threshold that still expands.
BEAM, SLACK = 24, 0.05
#: Overlap: clusters within this angle (radians) of the nearest one.
OVERLAP = 0.06
#: Vectors searched for at once (a multiple of 8), pairs compared at once.
QUERIES, STEP = 256, 1 << 16
#: First queries of the audit (more are drawn, up to SAMPLE, until so many have a link),
#: and the recall it asks for.
AUDIT, LINKED, RECALL = 256, 32, 0.95
#: Rows on a side of an exact block comparison, and of a shard that one task searches.
BLOCK = 8192


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def centroids(sample: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means of a bounded sample, started by evenly spaced rows."""
    c = sample[np.linspace(0, len(sample) - 1, k).astype(int)]
    for _ in range(rounds):
        near = (sample @ c.T).argmax(1)
        for j in range(k):
            mine = sample[near == j]
            if len(mine):
                m = mine.sum(0)
                c[j] = m / max(np.linalg.norm(m), 1e-12)
    # of centroids within the overlap one stays: else all of a dense group is in each of its shards
    close, kept = c @ c.T > math.cos(OVERLAP), []
    for j in range(k):
        if not close[j, kept].any():
            kept.append(j)
    return c[kept]


def build(x: np.ndarray) -> list[np.ndarray]:
    """Robust-pruned neighbour lists within a shard."""
    n, out = len(x), []
    pool = min(POOL, n - 1)
    for s in range(0, n, 512):
        sim = x[s: s + 512] @ x.T
        sim[np.arange(len(sim)), np.arange(s, s + len(sim))] = -2
        if not pool:
            out += [np.zeros(0, int)] * len(sim)
            continue
        near = np.argpartition(-sim, pool - 1, axis=1)[:, :pool]
        near = np.take_along_axis(near, np.argsort(-np.take_along_axis(sim, near, 1), axis=1, kind="stable"), 1)
        dist = 1 - np.take_along_axis(sim, near, 1)
        between = 1 - np.einsum("ipd,iqd->ipq", x[near], x[near])
        alive, kept = np.ones(near.shape, bool), np.zeros(near.shape, bool)
        for j in range(pool):  # the nearest alive one stays and prunes what lies behind it
            take = alive[:, j] & (kept.sum(1) < DEGREE)
            kept[take, j] = True
            alive &= ~(take[:, None] & (ALPHA * between[:, j] <= dist))
        kept[:, : min(4, pool)] = True
        out += [near[i][kept[i]] for i in range(len(near))]
    return out


def search(x: np.ndarray, graph: np.ndarray, queries: np.ndarray, start: int, beam: int) -> np.ndarray:
    """Greedy beam search for all queries (rows of x) at once: positions of the best
    ``beam`` nodes of each.  ``graph``: neighbour table, -1 where there is none."""
    q, width = len(queries), min(beam, len(x))
    vec = x[queries]
    best = np.full((q, width), -1)
    score = np.full((q, width), -2.0, x.dtype)
    done = np.ones((q, width), bool)
    best[:, 0], score[:, 0], done[:, 0] = start, vec @ x[start], False
    rows = np.arange(q)
    while True:
        open_ = np.where(done, -3.0, score)
        pick = open_.argmax(1)
        live = open_[rows, pick] > -3
        if not live.any():
            return best
        r = rows[live]
        done[r, pick[live]] = True
        step = graph[best[r, pick[live]]]
        s = np.einsum("qd,qkd->qk", vec[r], x[step])
        known = (step[:, :, None] == best[r][:, None, :]).any(2)
        s[(step < 0) | known] = -2
        first = np.argsort(step, axis=1, kind="stable")
        twin = np.zeros(step.shape, bool)
        ordered = np.take_along_axis(step, first, 1)
        np.put_along_axis(twin, first[:, 1:], ordered[:, 1:] == ordered[:, :-1], 1)
        s[twin] = -2
        all_s, all_b = np.hstack([score[r], s]), np.hstack([best[r], np.where(s > -2, step, -1)])
        all_d = np.hstack([done[r], s <= -2])
        top = np.argsort(-all_s, axis=1, kind="stable")[:, :width]
        score[r], best[r], done[r] = (np.take_along_axis(t, top, 1) for t in (all_s, all_b, all_d))
        done[r] |= best[r] < 0


def similar(x: np.ndarray, queries: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Cosines of pairs ``i n + j`` of a query's position and a row: a matrix product
    where a good part of all is asked for, else a bounded number at a time."""
    n = len(x)
    if 16 * len(at) > len(queries) * n:
        return (x[queries] @ x.T).reshape(-1)[at]
    out = np.empty(len(at), x.dtype)
    for s in range(0, len(at), STEP):
        i, j = np.divmod(at[s: s + STEP], n)
        out[s: s + STEP] = np.einsum("nd,nd->n", x[queries[i]], x[j])
    return out


def in_range(exact: np.ndarray, graph: np.ndarray, beam: int, threshold: float) -> np.ndarray:
    """Verified pairs of cosine >= threshold that search and range expansion find, as
    a symmetric matrix of packed bits: a dense shard never holds a list of its pairs.
    ``graph``: neighbour table whose edges go both ways."""
    x, (n, width) = exact.astype(np.float32), graph.shape
    mean = x.mean(0)
    start = int((x @ mean).argmax())
    bits = np.zeros((n, -(-n // 8)), np.uint8)
    for s in range(0, n, QUERIES):
        queries = np.arange(s, min(n, s + QUERIES))
        found = search(x, graph, queries, start, beam)
        seen, near = np.zeros((2, len(queries), n), bool)
        q, c = np.nonzero(found >= 0)
        seen[q, found[q, c]] = True
        seen[np.arange(len(queries)), queries] = True
        front = np.flatnonzero(seen)
        while True:  # expand from all that is within or near the range
            front = front[similar(x, queries, front) >= threshold - SLACK]
            if not len(front):
                break
            near.reshape(-1)[front] = True
            step = np.zeros((n + 1, len(queries)), bool)  # the last row: no neighbour
            step[front % n, front // n] = True
            step = np.packbits(step, axis=1)
            fresh = np.zeros((n, step.shape[1]), np.uint8)
            for at in range(0, n, max(1, STEP // width)):
                part = slice(at, at + max(1, STEP // width))
                fresh[part] = np.bitwise_or.reduce(step[graph[part]], axis=1)
            front = np.flatnonzero(np.unpackbits(fresh, axis=1, count=len(queries)).T & ~seen)
            seen.reshape(-1)[front] = True
        pair = np.flatnonzero(near)
        pair = pair[similar(exact, queries, pair) >= threshold]
        near[:] = False
        near.reshape(-1)[pair] = True
        near[np.arange(len(queries)), queries] = False
        bits[s: s + len(queries)] = np.packbits(near, axis=1)
    both = np.empty_like(bits)
    for s in range(0, n, QUERIES):  # what either side found
        rows = np.unpackbits(bits[s: s + QUERIES], axis=1, count=n)
        turned = np.unpackbits(bits[:, s // 8: -(-(s + len(rows)) // 8)], axis=1, count=len(rows)).T
        both[s: s + len(rows)] = np.packbits(rows | turned, axis=1)
    return both


def _forest(bits: np.ndarray) -> list[tuple[int, int]]:
    """Edges that span the components of a shard's links."""
    n = len(bits)
    fresh, out = np.ones(n, np.uint8), []
    for i in range(n):
        if not fresh[i]:
            continue
        fresh[i], todo = 0, [i]
        while todo:
            u = todo.pop()
            new = np.flatnonzero(np.unpackbits(bits[u], count=n) & fresh)
            fresh[new] = 0
            out += [(u, v) for v in new.tolist()]
            todo += new.tolist()
    return out


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``id, n_links, component_id, kept`` of every row.

    Vectors that are null, empty, zero, of another length than most, or hold null or
    non-finite components have no links and are their own component.  Equal
    vectors are linked with each other.  Null ids are kept and never are a component
    id unless all of a component are null.  Other columns are ignored; an empty table
    gives no rows."""
    spark = vectors.sparkSession
    prepare(spark)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    fine = F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
                      & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = staged(rows.withColumn("v", F.when(fine, F.col("v"))), "graph-rows")
    sizes = rows.where("v is not null").groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    dim = sizes[0]["d"] if sizes else 0
    rows = rows.withColumn("v", F.when(F.size("v") == dim, F.col("v")))
    nodes = staged(rows.where("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("least"))
                   .withColumn("node", F.monotonically_increasing_id()), "graph-nodes")
    alone = lambda r: r.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"),
                               F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    n = nodes.count()
    if not n:
        return alone(rows)
    sample = nodes.select("v").orderBy(F.xxhash64("v"), "v").limit(SAMPLE).collect()
    base = unit(np.array([r["v"] for r in sample]))
    k = max(1, min(MOST_CENTROIDS, len(base) // 2, math.ceil(n / SHARD_ROWS)))
    center = centroids(base.copy(), k)

    true = _audit(nodes, base, threshold)
    linked = sum(m > 0 for m in true.values())
    # whoever has audited all vectors knows how many links there are, be they few or none
    exact = linked < LINKED and len(true) < n
    beam, overlap = BEAM, OVERLAP
    for attempt in range(0 if exact else 3):
        partial, edges = _links(nodes, center, threshold, beam, overlap)
        audited = spark.createDataFrame([(i, r["v"]) for i, r in enumerate(sample[: len(true)])], "q int, v array<double>")
        got = dict(nodes.join(F.broadcast(audited), "v").join(partial, "node").groupBy("q").agg(F.sum("pairs")).collect())
        if recall(true, got) >= RECALL:
            break
        beam, overlap = 2 * beam, 2 * overlap
    else:
        partial, edges = _all_links(nodes, threshold, n)
    links = nodes.join(partial.groupBy("node").agg(F.sum("links").alias("links")), "node", "left") \
        .select("node", "v", "least", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    found = connected_components(edges)
    labelled = staged(links.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
                      .select("v", "least", "n_links", "component"), "graph-labelled")
    least = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    labelled = labelled.join(least, "component").select("v", "n_links", "component_id")
    joined = rows.where("v is not null").join(labelled, "v") \
        .select(F.col("id").alias(id_col), "n_links", "component_id",
                F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
    return joined.unionByName(alone(rows.where("v is null")))


def recall(true: dict[int, int], got: dict[int, int]) -> float:
    """Share of the audited vectors' links to other distinct vectors that was found; 1 if there are none."""
    return sum(min(got.get(q, 0), m) for q, m in true.items()) / sum(true.values()) if any(true.values()) else 1.0


def _audit(nodes: DataFrame, base: np.ndarray, threshold: float) -> dict[int, int]:
    """Exact number of other distinct vectors that each audited one is linked to,
    against all nodes in blocks.  Vectors of ``base`` are drawn in order until LINKED
    have a link or all are drawn."""
    true: dict[int, int] = {}
    while len(true) < len(base) and sum(m > 0 for m in true.values()) < LINKED:
        first, end = len(true), min(len(base), max(AUDIT, 2 * len(true)))
        queries = base[first: end]

        def against(batches: Iterator[pd.DataFrame], first=first, queries=queries) -> Iterator[pd.DataFrame]:
            total = np.zeros(len(queries), np.int64)
            for b in batches:
                x = unit(np.stack(b["v"].to_numpy()).astype(float))
                for s in range(0, len(x), 1024):
                    total += (x[s: s + 1024] @ queries.T >= threshold).sum(0)
            yield pd.DataFrame({"q": np.arange(first, first + len(queries)), "links": total})

        found = nodes.select("v").mapInPandas(against, "q int, links long").groupBy("q").agg(F.sum("links")).collect()
        true |= {q: m - 1 for q, m in found}  # without itself
    return true


def _links(nodes: DataFrame, center: np.ndarray, threshold: float, beam: int, overlap: float) -> tuple[DataFrame, DataFrame]:
    """Link counts per node and shard, and edges that span the components."""
    spark = nodes.sparkSession
    shared = spark.sparkContext.broadcast(center)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = unit(np.stack(b["v"].to_numpy()).astype(float))
            angle = np.arccos(np.clip(x @ shared.value.T, -1, 1))
            near = angle <= angle.min(1, keepdims=True) + overlap
            yield pd.DataFrame({"node": b["node"], "copies": b["copies"], "v": b["v"],
                                "shards": [np.flatnonzero(r).astype(np.int32) for r in near]})

    placed = staged(nodes.select("node", "copies", "v").mapInPandas(
        assign, "node long, copies long, v array<double>, shards array<int>"), "graph-placed")
    by_shard = placed.withColumn("shard", F.explode("shards"))
    # at most MOST_CENTROIDS counts; a shard of more than BLOCK rows is compared in blocks, no task holds it
    blocks = [(r["shard"], -(-r["count"] // BLOCK)) for r in by_shard.groupBy("shard").count().collect()]
    by_shard = by_shard.join(F.broadcast(spark.createDataFrame(blocks, "shard int, blocks int")), "shard")
    large, small = by_shard.where("blocks > 1"), by_shard.where("blocks = 1")

    def grow(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("node")
        x, ids = unit(np.stack(p["v"].to_numpy()).astype(float)).astype(np.float32), p["node"].to_numpy()
        lists = build(x)
        out = {i: set(l.tolist()) for i, l in enumerate(lists)}
        for i, l in enumerate(lists):  # edges go both ways
            for j in l.tolist():
                out[j].add(i)
        return pd.DataFrame({"node": ids, "near": [ids[sorted(out[i])] for i in range(len(ids))]})

    lists = small.select("shard", "node", "v").groupBy("shard").applyInPandas(grow, "node long, near array<long>")
    united = lists.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    ready = staged(small.drop("blocks").join(united, "node", "left"), "graph-united")

    def look(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("node")
        exact, ids = unit(np.stack(p["v"].to_numpy()).astype(float)), p["node"].to_numpy()
        lists = []
        for l in p["near"]:
            at = np.searchsorted(ids, l) if l is not None and len(l) else np.zeros(0, int)
            at = np.minimum(at, len(ids) - 1)
            lists.append(at[ids[at] == np.asarray(l)] if len(at) else at)
        graph = np.full((len(ids), max(1, max(map(len, lists)))), -1)
        for i, l in enumerate(lists):
            graph[i, : len(l)] = l
        bits = in_range(exact, graph, beam, threshold)
        # a pair counts in the first shard that both are in: here, if they share no earlier one
        shard = int(p["shard"].iloc[0])
        earlier = [[k for k in held if k < shard] for held in p["shards"].tolist()]
        place = {k: i for i, k in enumerate(sorted({k for held in earlier for k in held}))}
        member = np.zeros((len(ids), len(place)), np.float32)
        for i, held in enumerate(earlier):
            member[i, [place[k] for k in held]] = 1
        copies, count, pairs = p["copies"].to_numpy(), *np.zeros((2, len(ids)), np.int64)
        for s in range(0, len(ids), QUERIES):
            linked = np.unpackbits(bits[s: s + QUERIES], axis=1, count=len(ids)).astype(bool)
            if place:
                linked &= member[s: s + QUERIES] @ member.T == 0
            count[s: s + QUERIES] = linked @ copies
            pairs[s: s + QUERIES] = linked.sum(1)
        return _found(ids, count, pairs, _forest(bits))

    found = ready.groupBy("shard").applyInPandas(look, FOUND)
    return _parted(found.unionByName(_compared(large, threshold)) if max(b for _, b in blocks) > 1 else found)


#: Links of a node (``links`` with copies, ``pairs`` without), or an edge to ``other``.
FOUND = "node long, links long, pairs long, other long"


def _found(ids: np.ndarray, count: np.ndarray, pairs: np.ndarray, span: list[tuple[int, int]]) -> pd.DataFrame:
    at, none = np.flatnonzero(pairs), np.zeros(len(span), np.int64)
    return pd.DataFrame({"node": np.concatenate([ids[at], ids[np.array([i for i, _ in span], int)]]),
                         "links": np.concatenate([count[at], none]), "pairs": np.concatenate([pairs[at], none]),
                         "other": pd.array([None] * len(at) + [int(ids[j]) for _, j in span], "Int64")})


def _parted(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    found = staged(found, "graph-links")
    return found.where("other is null").select("node", "links", "pairs"), \
        found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b"))


def _all_links(nodes: DataFrame, threshold: float, n: int) -> tuple[DataFrame, DataFrame]:
    """As ``_links``, exactly: every two blocks of nodes are compared in a group of their own."""
    return _parted(_compared(nodes.select("node", "copies", "v", F.lit(0).alias("shard"), F.array(F.lit(0)).alias("shards"),
                                          F.lit(-(-n // BLOCK)).alias("blocks")), threshold))


def _compared(rows: DataFrame, threshold: float) -> DataFrame:
    """All pairs of a shard's rows, dealt to ``blocks`` blocks, each two of them (and
    each with itself) one group; a pair that shares an earlier shard counts there."""
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")) \
        .withColumn("facing", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1))) \
        .select("shard", F.least("own", "facing").alias("a"), F.greatest("own", "facing").alias("b"), "own", "node", "copies", "v", "shards")

    def compare(p: pd.DataFrame) -> pd.DataFrame:
        a, b, shard = (int(p[c].iloc[0]) for c in ("a", "b", "shard"))
        p = p.sort_values(["own", "node"])
        ids, copies, x = p["node"].to_numpy(), p["copies"].to_numpy(), unit(np.stack(p["v"].to_numpy()).astype(float))
        n, left = len(ids), int((p["own"] == a).sum())
        other = 0 if a == b else left  # rows from here on are compared with the left ones
        held = [[k for k in ks if k < shard] for ks in p["shards"].tolist()]
        place = {k: i for i, k in enumerate(sorted({k for ks in held for k in ks}))}
        member = np.zeros((n, len(place)), np.float32)
        for i, ks in enumerate(held):
            member[i, [place[k] for k in ks]] = 1
        count, pairs = np.zeros((2, n), np.int64)
        bits = np.zeros((n, -(-n // 8)), np.uint8)
        near = np.zeros((left, n - other), bool)
        for s in range(0, left, QUERIES):
            part = slice(s, min(left, s + QUERIES))
            linked = x[part] @ x[other:].T >= threshold
            if a == b:
                linked[np.arange(len(linked)), np.arange(part.start, part.stop)] = False
            near[part] = linked
            if place:
                linked &= member[part] @ member[other:].T == 0
            count[part] += linked @ copies[other:]
            pairs[part] += linked.sum(1)
            if a != b:
                count[left:] += copies[part] @ linked
                pairs[left:] += linked.sum(0)
        if not near.any():
            return _found(ids, count, pairs, [])
        for s in range(0, left, QUERIES):
            rows = np.zeros((min(left, s + QUERIES) - s, n), bool)
            rows[:, other:] = near[s: s + QUERIES]
            bits[s: s + len(rows)] = np.packbits(rows, axis=1)
        for s in range(left, n if a != b else left, QUERIES):
            rows = np.zeros((min(n, s + QUERIES) - s, n), bool)
            rows[:, :left] = near[:, s - left: s - left + len(rows)].T
            bits[s: s + len(rows)] = np.packbits(rows, axis=1)
        return _found(ids, count, pairs, _forest(bits))

    return rows.groupBy("shard", "a", "b").applyInPandas(compare, FOUND)
