"""Nearest neighbours and neighbour baselines.

Vectors are dealt to the cells of their nearest pivots (some vectors of the table, a
bounded number).  Queries first search the cells of their nearest pivots; the distance
of the k-th neighbour found there then bounds what is left: by the triangle inequality a
cell whose pivot is farther than this distance and the cell's radius together can't hold
a nearer one.  Exact search (G6) looks at all cells that remain; approximate search (G7)
stops after a number of cells that is measured, on sampled queries, to reach the
recall that was asked for.  Both re-rank by exact distances and always give k
neighbours where there are k.

A first group is one tile of a cell and one block of the queries that look there, a distance
block in numpy; only the k best of each query leave it.  Where the rest is many cells, a
query is not shipped to each of them: neighbouring cells make a few large tiles (about
``SWEEP_TILES`` as long as memory allows), a query goes once to a tile that holds a cell it
needs, and a product in single precision, with a margin for its error, leaves the pairs
below the bound for exact distances.  No pair rows are made.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexivec.functions import vectors as V
from lexivec.functions.arrow import matrix
from lexivec.operators.indexing import global_index, materialize

DEFAULT_K = 10
#: Rows of a cell about, most pivots, and most rows of either side that meet in one group.
CELL_ROWS, MAX_PIVOTS, TILE_ROWS = 256, 4096, 4096
#: Cells searched before the bound is known, and sampled queries that measure recall.
FIRST_CELLS, AUDITED = 2, 256
#: Tiles of neighbouring cells aimed at, and most doubles of a tile or of a block of queries.
SWEEP_TILES, SWEEP_VALUES = 12, 1 << 23
#: Queries and rows of one product, and pairs whose exact distances are made at once.
STEP_QUERIES, STEP_ROWS, STEP_PAIRS = 512, 4096, 1 << 16
#: Distances to pivots that a task holds at once.
STEP_DISTANCES = 1 << 21

OUT_SCHEMA = "entry string, neighbour string, distance double"


def _token_keys(q: pd.Series, c: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Token numbers of all tokens of each entry (rows padded with -1), numbered
    alike on both sides, for the lexical-overlap test."""
    number: dict[str, int] = {}
    lists = [[[number.setdefault(t, len(number)) for t in str(e).split("_")] for e in side] for side in (q, c)]
    out = []
    for rows in lists:
        keys = np.full((len(rows), max(map(len, rows))), -1, dtype=np.int64)
        for r, ids in enumerate(rows):
            keys[r, : len(ids)] = ids
        out.append(keys)
    return out[0], out[1]


def _tile_knn(k: int, exclude_self: bool, allow_overlap: bool):
    def run(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if q.empty or c.empty:
            return _found([], [], [])
        Q = np.stack(q["vec"].to_numpy()).astype(np.float64)
        Cm = np.stack(c["vec"].to_numpy()).astype(np.float64)
        qn = np.einsum("ij,ij->i", Q, Q)
        cn = np.einsum("ij,ij->i", Cm, Cm)
        d2 = qn[:, None] + cn[None, :] - 2.0 * (Q @ Cm.T)
        qe = q["entry"].to_numpy()
        ce = c["entry"].to_numpy()
        if exclude_self:
            d2[qe[:, None] == ce[None, :]] = np.inf
        if not allow_overlap:
            qt, ct = _token_keys(q["entry"], c["entry"])
            clash = np.zeros(d2.shape, dtype=bool)
            for a in range(qt.shape[1]):
                for b in range(ct.shape[1]):
                    clash |= (qt[:, a, None] == ct[None, :, b]) & (qt[:, a, None] >= 0)
            d2[clash] = np.inf
        m = min(k, Cm.shape[0])
        # all candidates up to the k-th distance, ties and rounding included
        reach = np.partition(d2, m - 1, axis=1)[:, m - 1]
        reach = reach + 1e-9 * (1.0 + qn + cn.max())
        rows_e, rows_n, rows_d = [], [], []
        for r in range(Q.shape[0]):
            idx = np.flatnonzero((d2[r] <= reach[r]) & np.isfinite(d2[r]))
            if idx.size == 0:
                continue
            # exact distances from differences for the few survivors
            dist = np.sqrt(((Cm[idx] - Q[r]) ** 2).sum(axis=1))
            order = np.lexsort((ce[idx], dist))[:k]
            rows_e.extend([qe[r]] * len(order))
            rows_n.extend(ce[idx][order])
            rows_d.extend(dist[order])
        return _found(rows_e, rows_n, rows_d)
    return run


def _found(entry: list, neighbour: list, distance: list) -> pd.DataFrame:
    text = lambda x: pd.Series(x, dtype=object)
    return pd.DataFrame({"entry": text(entry), "neighbour": text(neighbour), "distance": pd.Series(distance, dtype=float)})


def _names(q: pa.ChunkedArray, c: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the entries on both sides, equal for equal names, and the rows' places in the order of names."""
    coded = c.combine_chunks().dictionary_encode("encode")
    same = pc.fill_null(pc.index_in(q.combine_chunks(), coded.dictionary), -1).to_numpy(zero_copy_only=False)
    place = np.empty(len(c), np.int64)
    place[pc.sort_indices(c).to_numpy()] = np.arange(len(c))
    return same, coded.indices.to_numpy(zero_copy_only=False), place


def _sweep_tile(k: int, exclude_self: bool, allow_overlap: bool):
    """The k best of each query (with ``bound``, and ``asked``: bits of the cells it needs) among the rows of a tile of cells."""
    schema = pa.schema([("entry", pa.string()), ("neighbour", pa.string()), ("distance", pa.float64())])

    def run(q: pa.Table, c: pa.Table) -> pa.Table:
        if not q.num_rows or not c.num_rows:
            return schema.empty_table()
        c = c.sort_by("pos")
        q = q.sort_by("asked")  # queries that need the same cells together
        dim = len(c.column("vec")[0])
        Q, C = (matrix(t.column("vec"), dim) for t in (q, c))
        pos = c.column("pos").to_numpy()
        need = np.unpackbits(np.frombuffer(b"".join(q.column("asked").to_pylist()), np.uint8).reshape(q.num_rows, -1), axis=1).astype(bool)
        bound = np.nan_to_num(q.column("bound").to_numpy(zero_copy_only=False).astype(float), nan=np.inf)
        qname, cname, place = _names(q.column("entry"), c.column("entry"))
        qtok, ctok = (None, None) if allow_overlap else _token_keys(q.column("entry").to_pandas(), c.column("entry").to_pandas())
        finite = np.isfinite(C).all(1)
        middle = C[finite].mean(0) if finite.any() else np.zeros(dim)
        qn, cn = (np.einsum("ij,ij->i", x - middle, x - middle) for x in (Q, C))
        peak = np.sqrt(cn[finite].max(initial=0.0))
        kind = np.float32 if peak < 1e15 and not (qn > 1e30).any() else np.float64
        # |c|^2 - 2 q c is compared with bound^2 - |q|^2 and a margin for the rounding of the product
        left = np.c_[-2.0 * (Q - middle), np.ones(len(Q))].astype(kind)
        right = np.c_[C - middle, cn].astype(kind)
        slack = (dim + 8) * 4 * np.finfo(kind).eps * (np.sqrt(qn) + peak) ** 2
        out = []
        for lo in range(0, len(Q), STEP_QUERIES):
            some = slice(lo, min(lo + STEP_QUERIES, len(Q)))
            wanted, limit = need[some], bound[some].copy()
            rows = np.flatnonzero(wanted.any(0)[pos])
            best_q, best_c, best_d = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
            for s in range(0, len(rows), STEP_ROWS):
                part = rows[s: s + STEP_ROWS]
                whole = part[-1] - part[0] + 1 == len(part)
                product = left[some] @ (right[part[0]: part[-1] + 1] if whole else right[part]).T
                top = (limit * limit - qn[some] + slack[some]).astype(kind)
                at, to = np.divmod(np.flatnonzero(product <= top[:, None]), len(part))
                to = part[to]
                kept = wanted[at, pos[to]]
                if exclude_self:
                    kept &= qname[some][at] != cname[to]
                at, to = at[kept], to[kept]
                near = np.empty(len(at))
                for b in range(0, len(at), STEP_PAIRS):
                    cut = slice(b, b + STEP_PAIRS)
                    near[cut] = np.sqrt(((C[to[cut]] - Q[lo + at[cut]]) ** 2).sum(axis=1))
                    if not allow_overlap:
                        a, t = qtok[lo + at[cut]], ctok[to[cut]]
                        near[cut][((a[:, :, None] == t[:, None, :]) & (a[:, :, None] >= 0)).any((1, 2))] = np.inf
                kept = np.isfinite(near)
                if not kept.any():
                    continue
                at, to, near = np.r_[best_q, at[kept]], np.r_[best_c, to[kept]], np.r_[best_d, near[kept]]
                order = np.lexsort((place[to], near, at))
                at, to, near = at[order], to[order], near[order]
                rank = np.arange(len(at)) - np.searchsorted(at, at)
                kept = rank < k
                best_q, best_c, best_d = at[kept], to[kept], near[kept]
                last = rank == k - 1
                limit[at[last]] = np.minimum(limit[at[last]], near[last])
            out.append(pa.table([q.column("entry").take(pa.array(lo + best_q)), c.column("entry").take(pa.array(best_c)), pa.array(best_d)], schema=schema))
        return pa.concat_tables(out)

    return run


def _near_order(points: np.ndarray) -> np.ndarray:
    """The points in an order in which neighbours are near each other: halves along the longest axis, again and again."""
    if len(points) <= 4:
        return np.arange(len(points))
    axis = np.linalg.svd(points - points.mean(0), full_matrices=False)[2][0]
    order = np.argsort(points @ axis, kind="stable")
    return np.concatenate([half[_near_order(points[half])] for half in np.array_split(order, 2)])


class PivotIndex:
    """``vectors(entry, vec)`` by cells of nearest pivots.  The pivots, the cells' sizes and
    radii are on the driver (``MAX_PIVOTS`` rows at most); everything else stays in tables."""

    def __init__(self, vectors: DataFrame, cell_rows: int = CELL_ROWS, tile_rows: int = TILE_ROWS):
        rows = vectors.select(F.col("entry").cast("string").alias("entry"), V.as_double("vec").alias("vec")).where("vec is not null")
        self.spark, self.tile_rows = vectors.sparkSession, tile_rows
        self.n = rows.count()
        if not self.n:
            return
        n_pivots = max(1, min(MAX_PIVOTS, -(-self.n // cell_rows)))
        chosen = rows.orderBy(F.xxhash64("entry"), "entry").limit(n_pivots).select("vec").collect()
        self.pivots = pivots = np.array([r["vec"] for r in chosen], dtype=np.float64)

        def nearest(batches):
            for b in _steps(batches, len(pivots)):
                d = _distances(matrix(b.column("vec"), pivots.shape[1]), pivots)
                cell = d.argmin(1)
                yield pa.RecordBatch.from_arrays([b.column("entry"), b.column("vec"), pa.array(cell.astype(np.int32)),
                                                  pa.array(d[np.arange(len(cell)), cell])], names=["entry", "vec", "cell", "far"])

        self.rows = materialize(rows.mapInArrow(nearest, "entry string, vec array<double>, cell int, far double"))
        size, radius = np.zeros(len(pivots), np.int64), np.zeros(len(pivots))
        for r in self.rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).collect():
            size[r["cell"]], radius[r["cell"]] = r["n"], r["far"]
        self.size, self.radius, self.order = size, radius, _near_order(np.nan_to_num(pivots))

    def _visits(self, queries: DataFrame, pick) -> DataFrame:
        """``entry, vec, cell`` for the cells that ``pick(distances to pivots, batch)`` marks."""
        pivots = self.pivots

        def run(batches):
            for b in _steps(batches, len(pivots)):
                q, cell = np.nonzero(pick(_distances(matrix(b.column("vec"), pivots.shape[1]), pivots), b))
                for s in range(0, len(q), 8192):
                    at = pa.array(q[s: s + 8192])
                    yield pa.RecordBatch.from_arrays([b.column("entry").take(at), b.column("vec").take(at),
                                                      pa.array(cell[s: s + 8192].astype(np.int32))], names=["entry", "vec", "cell"])

        return queries.mapInArrow(run, "entry string, vec array<double>, cell int")

    def _tiles(self, most: int) -> list[tuple[int, int]]:
        """Tiles as runs of cells in ``self.order``, of ``most`` rows; a larger cell has several tiles."""
        tiles, lo, held = [], 0, 0
        for i, n in enumerate(self.size[self.order].tolist()):
            if held and held + n > most:
                tiles.append((lo, i))
                lo, held = i, 0
            held += n
            if held > most:
                tiles += [(i, i + 1)] * -(-held // most)
                lo, held = i + 1, 0
        return tiles + [(lo, len(self.size))] * (held > 0)

    def _sweep(self, queries: DataFrame, pick, k: int, exclude_self: bool, allow_overlap: bool) -> DataFrame:
        """The k best of each query ``(entry, vec, bound)`` among the cells that ``pick(distances to
        pivots, bounds)`` marks: ``entry, neighbour, distance``, per tile."""
        pivots, order = self.pivots, self.order
        most = min(max(self.tile_rows, -(-self.n // SWEEP_TILES)), max(1, SWEEP_VALUES // pivots.shape[1]))
        tiles = self._tiles(most)
        blocks = max(1, -(-queries.count() // most))

        def ship(batches):
            for b in _steps(batches, len(pivots)):
                limit = np.nan_to_num(b.column("bound").to_numpy(zero_copy_only=False).astype(float), nan=np.inf)
                mark = pick(_distances(matrix(b.column("vec"), pivots.shape[1]), pivots), limit)[:, order]
                for t, (lo, hi) in enumerate(tiles):
                    asks = mark[:, lo:hi]
                    rows = np.flatnonzero(asks.any(1))
                    bits = np.packbits(asks[rows], axis=1)
                    at = pa.array(rows)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(rows), t, np.int32)), *(b.column(c).take(at) for c in ("entry", "vec", "bound")),
                         pa.array([r.tobytes() for r in bits], pa.binary())], names=["tile", "entry", "vec", "bound", "asked"])

        first, pieces = {}, {}
        for t, (lo, hi) in enumerate(tiles):
            for at in range(lo, hi):
                first.setdefault(at, (t, lo))
                pieces[at] = pieces.get(at, 0) + 1
        places = self.spark.createDataFrame([(int(order[at]), t, pieces[at], at - lo) for at, (t, lo) in first.items()],
                                            "cell int, first int, pieces int, pos int")  # a row a cell
        keys = ["tile", "block"]
        left = queries.mapInArrow(ship, "tile int, entry string, vec array<double>, bound double, asked binary") \
            .withColumn("block", F.pmod(F.xxhash64("entry"), F.lit(blocks)).cast("int"))
        right = self.rows.join(F.broadcast(places), "cell").select(
            (F.col("first") + F.pmod(F.xxhash64("entry", F.lit(1)), "pieces")).cast("int").alias("tile"),
            F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "entry", "vec", "pos")
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_sweep_tile(k, exclude_self, allow_overlap), OUT_SCHEMA)

    def _search(self, visits: DataFrame, k: int, exclude_self: bool, allow_overlap: bool) -> DataFrame:
        """The k best of each query among the cells it visits: ``entry, neighbour, distance``, per group."""
        visits = materialize(visits)
        tiles = self.spark.createDataFrame([(c, -(-int(n) // self.tile_rows)) for c, n in enumerate(self.size.tolist()) if n], "cell int, tiles int")
        blocks = visits.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / self.tile_rows).cast("int").alias("blocks"))
        grid = blocks.join(F.broadcast(tiles), "cell")  # a row a cell
        some = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        left = visits.join(F.broadcast(grid), "cell").withColumn("block", F.pmod(F.xxhash64("entry"), "blocks").cast("int")) \
            .select("cell", some("tiles").alias("tile"), "block", "entry", "vec")
        right = self.rows.join(F.broadcast(grid), "cell").withColumn("tile", F.pmod(F.xxhash64("entry", F.lit(1)), "tiles").cast("int")) \
            .select("cell", "tile", some("blocks").alias("block"), "entry", "vec")
        keys = ["cell", "tile", "block"]
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_tile_knn(k, exclude_self, allow_overlap), OUT_SCHEMA)

    def search(self, queries: DataFrame, k: int, cells: int = FIRST_CELLS, exact: bool = True, exclude_self: bool = True,
               allow_overlap: bool = True) -> DataFrame:
        """``(entry, rank, neighbour, distance)`` from each query's ``cells`` nearest cells, and
        with ``exact`` (or where these hold no k neighbours) from all that the bound leaves."""
        size, radius, need = self.size, self.radius, k + 1
        queries = queries.select(F.col("entry").cast("string").alias("entry"), V.as_double("vec").alias("vec")).where("vec is not null")

        def nearest(d: np.ndarray, cells: int) -> np.ndarray:
            order = np.argsort(d, axis=1, kind="stable")
            held = np.cumsum(size[order], axis=1) - size[order]  # rows in nearer cells
            take = (np.arange(d.shape[1]) < cells) | (held < need)
            out = np.zeros(d.shape, bool)
            np.put_along_axis(out, order, take, axis=1)
            return out & (size > 0)

        few = min(cells, FIRST_CELLS)
        found = materialize(_ranked(self._search(self._visits(queries, lambda d, b: nearest(d, few)), k, exclude_self, allow_overlap), k))
        if len(self.pivots) == 1:
            return found
        bounds = found.groupBy("entry").agg(F.when(F.count(F.lit(1)) >= k, F.max("distance")).alias("bound"))
        asked = materialize(queries.alias("q").join(bounds.alias("b"), F.col("q.entry").eqNullSafe(F.col("b.entry")), "left")
                            .select("q.entry", "vec", F.col("bound").cast("double").alias("bound")))
        whole = exact or cells > few  # else only what the first cells left open
        if not whole:
            asked = asked.where("bound is null")

        def left_over(d: np.ndarray, limit: np.ndarray) -> np.ndarray:
            reach = limit[:, None] + radius[None, :]
            mark = (size > 0) & (d <= reach * (1 + 1e-9) + 1e-9)
            return mark if exact else mark & (nearest(d, cells) | np.isinf(limit)[:, None])

        swept = self._sweep(asked, left_over, k, exclude_self, allow_overlap)
        if not whole:
            full = found.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("entry"))).where(F.col("_n") >= k)
            swept = swept.unionByName(full.select("entry", "neighbour", "distance"))
        return _ranked(swept, k)

    def cells_for(self, recall: float, k: int) -> int:
        """Nearest cells that hold ``recall`` of the k nearest neighbours, by exact search for
        ``AUDITED`` of the vectors."""
        if len(self.pivots) == 1:
            return 1
        asked = materialize(self.rows.orderBy(F.xxhash64("entry", F.lit(2)), "entry").limit(AUDITED).select("entry", "vec"))
        near = self.search(asked, k).join(self.rows.select(F.col("entry").alias("neighbour"), "cell"), "neighbour") \
            .join(asked, "entry").select("vec", "cell").collect()  # AUDITED x k rows at most
        if not near:
            return 1
        d = _distances(np.array([r["vec"] for r in near]), self.pivots)
        d[:, self.size == 0] = np.inf
        place = np.sort((d < d[np.arange(len(near)), [r["cell"] for r in near]][:, None]).sum(1))
        return int(place[min(len(place) - 1, int(np.ceil(recall * len(place))) - 1)]) + 1


def _steps(batches, width: int):
    """The batches in parts whose rows have ``STEP_DISTANCES`` numbers about, ``width`` each."""
    rows = max(1, STEP_DISTANCES // width)
    for b in batches:
        for s in range(0, b.num_rows, rows):
            yield b.slice(s, rows)


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    d2 = np.einsum("ij,ij->i", x, x)[:, None] + np.einsum("ij,ij->i", pivots, pivots) - 2.0 * (x @ pivots.T)
    return np.sqrt(np.maximum(d2, 0.0))


def _ranked(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("entry").orderBy("distance", "neighbour")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k) \
        .select("entry", F.col("rank").cast("long").alias("rank"), "neighbour", "distance")


def knn_exact(vectors: DataFrame, k: int = DEFAULT_K, queries: DataFrame | None = None,
              exclude_self: bool = True, allow_lexical_overlap: bool = True,
              tile_rows: int = TILE_ROWS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Euclidean k nearest neighbours of each query entry among ``vectors``;
    ascending distance, ties by neighbour; ``(entry, rank, neighbour, distance)``."""
    index = PivotIndex(vectors, cell_rows, tile_rows)
    if not index.n:
        return vectors.sparkSession.createDataFrame([], "entry string, rank long, neighbour string, distance double")
    return index.search(vectors if queries is None else queries, k, exclude_self=exclude_self, allow_overlap=allow_lexical_overlap)


def knn_lsh(vectors: DataFrame, k: int = DEFAULT_K, recall: float = 0.97, cell_rows: int = CELL_ROWS,
            tile_rows: int = TILE_ROWS) -> DataFrame:
    """Approximate neighbours from as many nearest cells as hold ``recall`` of the
    true ones of sampled vectors, ranked by exact distances as in G6; k each, always."""
    index = PivotIndex(vectors, cell_rows, tile_rows)
    if not index.n:
        return vectors.sparkSession.createDataFrame([], "entry string, rank long, neighbour string, distance double")
    return index.search(vectors, k, cells=index.cells_for(recall, k), exact=False)


# ---- baselines -------------------------------------------------------------------

# Fixed values of the constant baseline.
CONSTANT_NEIGHBOUR = "b/N"


def constant_neighbours(entries: DataFrame) -> DataFrame:
    """Every entry has the single neighbour ``b/N`` with score 1.0."""
    return entries.select("entry", F.lit(1).cast("long").alias("rank"),
                          F.lit(CONSTANT_NEIGHBOUR).alias("neighbour"), F.lit(1.0).alias("score"))


def random_neighbours(entries: DataFrame, vocabulary: DataFrame, k: int = 1, seed: int = 0) -> DataFrame:
    """K distinct vocabulary items per entry, score 1.0 (may include the
    entry itself, as in the reference).  The vocabulary gets dense ids; each entry
    draws a uniform sample without replacement (Floyd's method: draw i is below
    n - k + i + 1 and, where taken already, is n - k + i), from md5 of entry, seed and i."""
    n = vocabulary.select("entry").distinct().count()
    if n == 0:
        raise ValueError("random neighbours need a vocabulary to draw from")
    k = min(k, n)
    vocab = global_index(vocabulary.select("entry").distinct(), ["entry"], col="idx")
    def drawn(held, i):
        top = F.lit(n - k) + i
        key = F.concat(F.col("entry"), F.lit(f"#{seed}#"), i.cast("string"))
        draw = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint") % (top + 1)
        return F.concat(held, F.array(F.when(F.array_contains(held, draw), top).otherwise(draw)))

    sample = F.aggregate(F.sequence(F.lit(0).cast("bigint"), F.lit(k - 1).cast("bigint")),
                         F.array().cast("array<bigint>"), drawn)
    picks = entries.select("entry", F.posexplode(sample).alias("t", "idx"))
    return (picks.join(vocab.select(F.col("idx"), F.col("entry").alias("neighbour")), "idx")
            .select("entry", (F.col("t") + 1).cast("long").alias("rank"), "neighbour",
                    F.lit(1.0).alias("score")))


def random_vectors(features: DataFrame, dim: int = 100) -> DataFrame:
    """One uniform [0, 1) vector per feature, from md5 of ``feature#i``;
    independent of partitioning."""
    return features.select("entry", V.random_vector("entry", dim).alias("vec"))
