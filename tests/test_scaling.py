"""Steps that were reshaped for larger tables give the rows of their plain forms."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexivec.operators import compose as C
from lexivec.operators import counting
from lexivec.operators import embeddings as EM
from lexivec.operators import neighbours as NB
from lexivec.operators import tensors as TS
from lexivec.operators.indexing import materialize
from lexivec.sources.vectors import parse_vector_lines


def test_pairs_counted_once_equal_both_directions(spark):
    sent = spark.createDataFrame([(["a", "b", "a", "a"],), (["b", "a"],), (["c"],), (["é", "b", "é", "c"],)], "toks array<string>")
    rows = lambda df: sorted(map(tuple, df.select("entry", "feature", "n").collect()))
    once = counting.window_pairs(sent, 2, mirrored=False)
    assert once.count() * 2 == counting.window_pairs(sent, 2).count()
    assert rows(counting.count_events(once)) == rows(counting.count_events(counting.window_pairs(sent, 2)))


def test_materialize_runs_a_stage_once(spark):
    runs = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            runs.add(b.num_rows)
            yield b

    out = materialize(spark.range(0, 50, 1, 2).mapInArrow(seen, "id long"))
    assert sorted(r.id for r in out.collect()) == list(range(50))
    assert runs.value == 50


def test_sparse_tiles_hold_what_phrases_compose(spark):
    rng = np.random.default_rng(1)
    cells = {(f"w{t}/N", f"T:f{f}"): float(rng.integers(1, 9)) * (-1 if f == 3 else 1) for t in range(12) for f in range(20) if rng.random() < .4}
    weights = spark.createDataFrame([(e, f, w) for (e, f), w in cells.items()], "entry string, feature string, weight double")
    phrases = ["_".join(f"w{t}/N" for t in rng.integers(0, 14, n)) for n in (1, 2, 2, 2, 3, 3) for _ in range(5)]
    df = spark.createDataFrame([(p,) for p in phrases], "phrase string")
    want = {}
    for p in set(phrases):
        toks = p.split("_")
        for f in {f for _, f in cells}:
            v = [cells.get((t, f), 0.0) for t in toks]
            for name, x in (("Add", sum(v)), ("Avg", sum(v) / 2), ("Mult", float(np.prod(v))), ("Min", min(v)), ("Max", max(v))):
                if x:
                    want[name, p, f] = x
    for tile in (4, 1 << 21):
        got = C.compose_long(df, weights, tile_cells=tile).collect()
        assert len(got) == len(want) and {(r.composer, r.phrase, r.feature): r.weight for r in got} == want
        mult = C.multiply_rows(df, weights, tile_cells=tile).collect()
        assert {(r.composer, r.phrase, r.feature): r.weight for r in mult} == {k: v for k, v in want.items() if k[0] == "Mult"}
        assert len(mult) == sum(k[0] == "Mult" for k in want)


def test_verb_tiles_ship_no_vector_per_triple(spark):
    d, rng = 3, np.random.default_rng(2)
    vec = {f"n{i}/N": rng.random(d) for i in range(9)}
    svo = sorted({(f"n{a}/N", f"v{b % 3}/V", f"n{c}/N") for a, b, c in rng.integers(0, 11, (120, 3))} | {("n0/N", "v0/V", f"n{c}/N") for c in range(9)})
    known = [t for t in svo if t[0] in vec and t[2] in vec]
    mats = {v: sum(np.outer(vec[s], vec[o]) for s, w, o in known if w == v) for v in {t[1] for t in known}}
    vectors = spark.createDataFrame([(k, x.tolist()) for k, x in vec.items()], "entry string, vec array<double>")
    rows = spark.createDataFrame([(*t, "_".join(t)) for t in svo], "subj string, verb string, obj string, phrase string")
    trained = TS.train_verb_tensors(rows, vectors, min_svos=1, dim=d)
    plan = trained._jdf.queryExecution().toString()
    for tile in (5, 1 << 18):
        cells = TS._train_dense(rows.join(vectors.select(F.col("entry").alias("subj")), "subj", "left_semi")
                                .join(vectors.select(F.col("entry").alias("obj")), "obj", "left_semi").select("subj", "verb", "obj"), vectors, d, tile).collect()
        assert len(cells) == len(mats) * d * d
        assert all(abs(mats[r.verb][r.i, r.j] - r.weight) < 1e-9 for r in cells)
        got = TS.compose_categorical(rows, vectors, TS.tensor_to_dense(trained, d), d, ["FAdd"], tile_rows=tile).collect()
        assert sorted(r.phrase for r in got) == sorted("_".join(t) for t in known)
        for r in got:
            s, v, o = r.phrase.split("_")
            assert np.allclose(r.vec, vec[s] * (mats[v] @ vec[o]) + vec[o] * (vec[s] @ mats[v]))
    assert "cogroup" in plan.lower()


def test_long_tsv_line_is_read_in_one_pass(spark):
    n = 4000
    line = "a/N\t" + "\t".join(f"f{i}\t{i}" for i in range(n))
    lines = spark.createDataFrame([(line,), (line.replace("a/N", "b/N") + "\t",), ("c/N",), ("d/N\t\t3\tx\t4\todd",)], "value string")
    cells = parse_vector_lines(lines)
    plan = cells._jdf.queryExecution().optimizedPlan().toString()
    assert "namedlambdavariable" not in plan or "sequence(" not in plan
    got = {}
    for r in cells.collect():
        got.setdefault(r.entry, []).append((r.feature, r.weight))
    want = [(f"f{i}", float(i)) for i in range(n)]
    assert sorted(got["a/N"]) == sorted(want) and sorted(got["b/N"]) == sorted(want)
    assert got["c/N"] == [(None, None)] and got["d/N"] == [("x", 4.0)]


def test_cooc_pairs_are_summed_before_they_are_sent(spark):
    """A task sends one row for each unordered pair, whose sums are those of a plain loop."""
    toks = [["a", "b", "a", "c"] * 50, ["b"], [], ["c", "a"], None]
    sent = spark.createDataFrame([(t,) for t in toks], "toks array<string>").coalesce(1)
    want: dict = {}
    for t in toks:
        for i in range(len(t or [])):
            for j in range(max(0, i - 3), min(len(t), i + 4)):
                if i != j:
                    want[t[i], t[j]] = want.get((t[i], t[j]), 0) + 1 / abs(i - j)
    got = EM.distance_weighted_cooc(sent, 3)
    rows = got.collect()
    assert len(rows) == len(want)
    assert all(abs(r.x - want[r.entry, r.ctx]) < 1e-9 for r in rows)
    flat = pa.array([t for t in toks if t], pa.list_(pa.string()))
    assert EM._window_sums(flat, 3).num_rows == len({tuple(sorted(k)) for k in want})


def test_glove_ships_vectors_to_few_blocks(spark, monkeypatch):
    """Blocks are as many as keep the cores busy, not as many as the cells allow."""
    made = []
    packed = EM._packed
    monkeypatch.setattr(EM, "_packed", lambda cells, key, other, blocks: made.append(blocks) or packed(cells, key, other, blocks))
    cells = [(f"a{i}", f"a{j}", 1.0 + i + j) for i in range(12) for j in range(12)]
    vecs, _ = EM.train_glove(spark.createDataFrame(cells, "entry string, ctx string, x double"), dim=2, sweeps=1, block_cells=1)
    assert vecs.count() == 12
    assert set(made) == {2 * spark.sparkContext.defaultParallelism}


def test_toxicity_vector_finds_word_beginnings_without_new_strings():
    """Beginnings are kept as they stand in words; the vector is that of the plain counts of terms."""
    toxicity = pytest.importorskip("lexivec.llm.toxicity")
    vocabulary = {"badly*": 0, "badlyset": 1, "worse*": 2, "worse": 3, "no": 4}
    weights = np.array([1.0, 2.0, 3.0, 4.0, 5.0])
    model = toxicity.Model(vocabulary, weights)
    assert model.stems == {"badly": 0, "worse": 2}
    text = "Badlyset badlyput worse worsened no, NO none"
    plain = {vocabulary[x]: n for x, n in toxicity.terms(text).items() if x in vocabulary}
    at = sorted(plain)
    want = (1 + np.log(np.array([plain[t] for t in at], float))) * weights[at]
    got_at, got = model.vector(text)
    assert got_at.tolist() == at
    assert np.allclose(got, want / np.sqrt(want @ want))
    assert [len(x) for x in model.vector("nothing")] == [0, 0]


def test_pick_long_deals_a_frequent_token_to_many_tasks(spark, monkeypatch):
    """All phrases start with one token of 60 cells, which was one key of the join and one task's work."""
    monkeypatch.setattr(C, "PICK_CELLS", 500)
    phrases = spark.createDataFrame([(f"a/N_w{i}/N",) for i in range(400)] * 2, "phrase string")
    weights = spark.createDataFrame([("a/N", f"f{i}", float(i)) for i in range(60)] + [("b/N", "f0", 1.0)], "entry string, feature string, weight double")
    rows = C.pick_long(phrases, weights, C.LEFT)
    got = rows.groupBy("phrase").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("total")).collect()
    assert len(got) == 400 and all((r.n, r.total) == (60, 1770.0) for r in got)
    tasks = [r["count"] for r in rows.groupBy(F.spark_partition_id().alias("task")).count().collect()]
    assert len(tasks) > 1 and max(tasks) <= sum(tasks) / 2


@pytest.mark.parametrize("overlap", [True, False])
def test_neighbours_ship_a_query_to_a_tile_once(spark, monkeypatch, overlap):
    """Vectors without clusters need most cells: a query went to each of these. Copies fill a cell of several tiles."""
    rng = np.random.default_rng(5)
    x = np.r_[rng.normal(size=(380, 6)), np.repeat(rng.normal(size=(1, 6)), 70, 0)] + 100.0
    names = [f"w{i}_{i % 3}" for i in range(len(x))]
    vectors = spark.createDataFrame([(n, v.tolist()) for n, v in zip(names, x)], "entry string, vec array<double>")
    shipped = spark.sparkContext.accumulator(0)
    sweep = NB._sweep_tile

    def counted(*args):
        run = sweep(*args)

        def tile(q, c):
            shipped.add(q.num_rows)
            return run(q, c)
        return tile

    monkeypatch.setattr(NB, "_sweep_tile", counted)
    monkeypatch.setattr(NB, "STEP_ROWS", 32)
    got = NB.knn_exact(vectors, k=4, tile_rows=40, cell_rows=5, allow_lexical_overlap=overlap).collect()
    assert 0 < shipped.value <= 14 * len(x)  # tiles of 40 rows; there are 90 cells
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    if not overlap:
        d[np.equal.outer(np.arange(len(x)) % 3, np.arange(len(x)) % 3)] = np.inf
    want = {(names[i], r + 1, names[j]) for i in range(len(x)) for r, j in enumerate(np.lexsort((names, d[i]))[:4])}
    assert {(r.entry, r["rank"], r.neighbour) for r in got} == want
