"""Property and numpy-reference checks for operators without an SQL oracle."""

import gzip
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from lexivec.operators import compose as C
from lexivec.operators import counting, embeddings as EM, neighbours as NB, reduction as RD
from lexivec.operators import regression as RG, tensors as TS
from lexivec.operators.indexing import global_index, rank_within
from lexivec.plans import catalog
from lexivec.sinks.writers import write_sparse_tsv
from lexivec.sources import corpus, tables as T
from lexivec.sources.vectors import read_line_aligned, read_vectors_tsv


def rand_vectors(spark, n, d, seed=0, prefix="w"):
    rng = np.random.default_rng(seed)
    m = rng.normal(size=(n, d))
    df = spark.createDataFrame([(f"{prefix}{i}/N", [float(x) for x in m[i]]) for i in range(n)],
                               "entry string, vec array<double>")
    return df, m


def test_global_index_dense_and_ordered(spark):
    df = spark.range(0, 1000).select(F.col("id"), (F.col("id") * 7919 % 1000).alias("k"))
    got = global_index(df, ["k", "id"], col="idx", num_partitions=7).orderBy("idx").collect()
    assert [r["idx"] for r in got] == list(range(1000))
    assert [r["k"] for r in got] == sorted(r["k"] for r in got)


def test_rank_within_groups(spark):
    df = spark.createDataFrame([(g, v) for g in "abc" for v in range(50)], "g string, v long")
    r = rank_within(df, ["g"], [F.desc("v")]).collect()
    assert all(x["rank"] == 50 - x["v"] for x in r)


def test_ppmi_nonnegative_and_window_counts(spark):
    sent = T.sentences(T.read_corpus(spark, SF_SMALL))
    pairs = counting.window_pairs(sent, 2)
    # both directions: every pair has its mirror
    c = counting.count_events(pairs)
    mirror = c.select(F.regexp_replace("feature", "^T:", "").alias("entry"),
                      F.concat(F.lit("T:"), "entry").alias("feature"), "n")
    assert c.exceptAll(mirror).count() == 0
    w = counting.ppmi(counting.frequency_filter(c, 5, 2))
    assert w.where(F.col("weight") <= 0).count() == 0


def test_left_plus_right_is_add_for_bigrams(spark):
    vec, _ = rand_vectors(spark, 20, 6)
    ph = spark.createDataFrame([(f"w{i}/N_w{(i * 3 + 1) % 20}/N",) for i in range(20)], "phrase string")
    out = {(r["composer"], r["phrase"]): np.array(r["vec"])
           for r in C.compose_dense(ph, vec, [C.ADD, C.LEFT, C.RIGHT, C.MIN, C.MAX, C.MULT]).collect()}
    for i in range(20):
        p = f"w{i}/N_w{(i * 3 + 1) % 20}/N"
        assert np.allclose(out[("Left", p)] + out[("Right", p)], out[("Add", p)])
        assert np.all(out[("Min", p)] <= out[("Max", p)])
        assert np.allclose(out[("Left", p)] * out[("Right", p)], out[("Mult", p)])


def test_compose_partition_independent(spark):
    vec, _ = rand_vectors(spark, 30, 4)
    ph = spark.createDataFrame([(f"w{i}/N_w{(i + 5) % 30}/N",) for i in range(30)], "phrase string")
    a = sorted((r["phrase"], tuple(r["vec"])) for r in C.compose_dense(ph, vec, [C.ADD]).collect())
    b = sorted((r["phrase"], tuple(r["vec"])) for r in C.compose_dense(ph.repartition(7), vec.repartition(3),
                                                                          [C.ADD]).collect())
    assert a == b


def test_categorical_halves(spark):
    d = 4
    vec, m = rand_vectors(spark, 12, d)
    svo = spark.createDataFrame([(f"w{i}/N", f"v{i % 2}/V", f"w{(i * 5 + 1) % 12}/N") for i in range(12)],
                                "subj string, verb string, obj string") \
        .withColumn("phrase", F.concat_ws("_", "subj", "verb", "obj"))
    tensor = TS.train_verb_tensors(svo, vec, dim=d)
    dense_long = TS.tensor_to_dense(tensor, d)
    dense_np = TS.tensor_to_dense(TS.train_verb_tensors(svo, vec, method="dense", dim=d), d)
    a = {r["verb"]: np.array(r["mat"]) for r in dense_long.collect()}
    b = {r["verb"]: np.array(r["mat"]) for r in dense_np.collect()}
    assert a.keys() == b.keys() and all(np.allclose(a[k], b[k]) for k in a)
    # numpy reference for the verb matrix
    for verb in a:
        ref = sum(np.outer(m[i], m[(i * 5 + 1) % 12]) for i in range(12) if f"v{i % 2}/V" == verb)
        assert np.allclose(a[verb].reshape(d, d), ref)
    out = {(r["composer"], r["phrase"]): np.array(r["vec"])
           for r in TS.compose_categorical(svo, vec, dense_long, d).collect()}
    for i in range(12):
        p = f"w{i}/N_v{i % 2}/V_w{(i * 5 + 1) % 12}/N"
        s, o, V = m[i], m[(i * 5 + 1) % 12], a[f"v{i % 2}/V"].reshape(d, d)
        assert np.allclose(out[("CopyObj", p)], s * (V @ o))
        assert np.allclose(out[("FAdd", p)], s * (V @ o) + o * (V.T @ s))
        assert np.allclose(out[("FMult", p)], (s * (V @ o)) * (o * (V.T @ s)))


@pytest.mark.parametrize("tile_rows", [4096, 7])
def test_knn_exact_matches_numpy(spark, tile_rows):
    vec, m = rand_vectors(spark, 40, 5, seed=3)
    got = NB.knn_exact(vec, k=4, tile_rows=tile_rows).collect()
    d = np.sqrt(((m[:, None, :] - m[None, :, :]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    for r in got:
        i = int(r["entry"][1:-2])
        order = np.argsort(d[i], kind="stable")[:4]
        assert r["neighbour"] == f"w{order[r['rank'] - 1]}/N"
        assert abs(r["distance"] - d[i, order[r["rank"] - 1]]) < 1e-9
    assert len(got) == 40 * 4


def test_knn_lexical_overlap(spark):
    vec = spark.createDataFrame([("a/N", [0.0, 0.0]), ("a/N_b/N", [0.1, 0.0]), ("c/N", [1.0, 1.0])],
                                "entry string, vec array<double>")
    got = NB.knn_exact(vec, k=1, allow_lexical_overlap=False).collect()
    assert {r["entry"]: r["neighbour"] for r in got}["a/N"] == "c/N"


def _clustered(spark, n, d, seed):
    rng = np.random.default_rng(seed)
    m = rng.normal(size=(12, d))[rng.integers(0, 12, n)] * 3 + rng.normal(size=(n, d))
    m[5] = m[6] = m[7]  # copies
    m[:n // 3] = m[0] + rng.normal(size=(n // 3, d)) * 1e-3  # a dense third
    df = spark.createDataFrame([(f"w{i}/N", m[i].tolist()) for i in range(n)], "entry string, vec array<double>")
    return df.repartition(4), m


def test_knn_exact_prunes_cells(spark):
    """Many cells, tiles and query blocks give the rows of one distance matrix."""
    vec, m = _clustered(spark, 300, 6, 8)
    d = np.sqrt(((m[:, None] - m[None]) ** 2).sum(-1))
    names = np.array([f"w{i}/N" for i in range(300)])
    np.fill_diagonal(d, np.inf)
    for cell_rows, tile_rows in ((10, 16), (25, 4096)):
        got = {(r.entry, r["rank"]): r for r in NB.knn_exact(vec, k=5, cell_rows=cell_rows, tile_rows=tile_rows).collect()}
        assert len(got) == 1500
        for i in range(300):
            order = np.lexsort((names, np.round(d[i], 12)))[:5]
            assert np.allclose([got[names[i], j + 1].distance for j in range(5)], d[i][order], atol=1e-9)
    index = NB.PivotIndex(vec, 10)
    rest = index._visits(vec, lambda dist, b: dist <= 2.0)
    assert rest.count() < 300 * len(index.pivots)  # a bound leaves cells out
    queries = spark.createDataFrame([("q", m[9].tolist()), ("null", None)], "entry string, vec array<double>")
    assert [r.entry for r in NB.knn_exact(vec, k=3, queries=queries, cell_rows=10).collect()] == ["q"] * 3
    assert NB.knn_exact(vec.limit(0), k=3).count() == 0


def test_knn_lsh_recall(spark):
    for vec in (T.lexicon(T.read_table(spark, SF_SMALL, "embeddings")), _clustered(spark, 600, 6, 9)[0]):
        n = vec.count()
        exact = {(r["entry"], r["neighbour"]) for r in NB.knn_exact(vec, k=10).collect()}
        approx = NB.knn_lsh(vec, k=10, cell_rows=20).collect()
        assert len(approx) == 10 * n  # never a short list
        assert len(exact & {(r["entry"], r["neighbour"]) for r in approx}) / len(exact) >= 0.95


def test_random_neighbours_distinct(spark):
    lex = T.lexicon(T.read_table(spark, SF_SMALL, "embeddings")).select("entry")
    got = NB.random_neighbours(lex, lex, k=5, seed=1).groupBy("entry").agg(
        F.countDistinct("neighbour").alias("n")).collect()
    assert all(r["n"] == 5 for r in got)


def _sparse_matrix(spark, m, n, seed=0):
    rng = np.random.default_rng(seed)
    a = rng.random((m, n)) * (rng.random((m, n)) < 0.3)
    a += np.outer(rng.random(m), np.linspace(3, 0, n))
    cells = [(f"e{i}", f"f{j:03d}", float(a[i, j])) for i in range(m) for j in range(n) if a[i, j] != 0]
    return spark.createDataFrame(cells, "entry string, feature string, weight double"), a


def test_svd_matches_numpy(spark):
    df, a = _sparse_matrix(spark, 60, 25)
    vecs, sigma, comps = RD.truncated_svd(df, 3, oversample=15, power_iters=6)
    s = np.linalg.svd(a, compute_uv=False)
    assert np.allclose(sigma, s[:3], rtol=1e-6)
    assert np.all(np.diff(sigma) <= 0)
    v = np.stack([r["vec"] for r in comps.orderBy("feature").collect()])
    assert np.allclose(v.T @ v, np.eye(3), atol=1e-6)
    us = {r["entry"]: np.array(r["vec"]) for r in vecs.collect()}
    u = np.stack([us[f"e{i}"] for i in range(60)])
    # the randomized range finder gives U·Σ = Q·W·Σ, which approximates A·V
    assert np.allclose(u, a @ v, atol=1e-3 * sigma[0])


def test_ridge_matches_closed_form(spark):
    rng = np.random.default_rng(1)
    rows, ref = [], {}
    for g in ("m1", "m2"):
        x = rng.normal(size=(30, 3))
        y = x @ rng.normal(size=(3, 2)) + 0.5 + 0.01 * rng.normal(size=(30, 2))
        rows += [(g, [float(v) for v in xi], [float(v) for v in yi]) for xi, yi in zip(x, y)]
        xt = np.hstack([x, np.ones((30, 1))])
        pen = np.eye(4) * 0.5
        pen[-1, -1] = 0
        ref[g] = np.linalg.solve(xt.T @ xt + pen, xt.T @ y).T.ravel()
    df = spark.createDataFrame(rows, "grp string, x array<double>, y array<double>").repartition(3)
    model = {r["grp"]: np.array(r["coef"]) for r in RG.fit_ridge_groups(df, 3, 2, lam=0.5).collect()}
    assert all(np.allclose(model[g], ref[g]) for g in ref)
    assert RG.fit_ridge_groups(df, 3, 2, min_samples=31).count() == 0


def test_partial_sums_at_100_dimensions(spark):
    """The sums of hot and small groups equal numpy's, and a task's memory doesn't grow with its samples."""
    rng = np.random.default_rng(4)
    names = np.where(rng.random(3000) < 0.6, "hot", rng.choice([f"m{i}" for i in range(40)], 3000))
    x, y = rng.normal(size=(3000, 100)), rng.normal(size=(3000, 100))
    df = spark.createDataFrame([(g, a.tolist(), b.tolist()) for g, a, b in zip(names, x, y)], "grp string, x array<double>, y array<double>").repartition(5)
    rows = RG.partial_sums(df, 100, 100, ["grp"]).collect()
    assert len(rows) <= 41 * 5
    total = {}
    for r in rows:
        s, n = total.get(r.grp, (0.0, 0))
        total[r.grp] = (s + np.array(r.s), n + r.n)
    for g, (s, n) in total.items():
        xt = np.hstack([x[names == g], np.ones((n, 1))])
        assert np.allclose(s, np.hstack([(xt.T @ xt).ravel(), (xt.T @ y[names == g]).ravel()]))


def test_regression_composers_match_numpy(spark):
    """I6-I8 and E9-E11 against closed forms, with common and rare modifiers and verbs."""
    d, lam = 3, 0.5
    rng = np.random.default_rng(5)
    vec = {f"n{i}/N": rng.normal(size=d) for i in range(12)} | {f"a{i}/J": rng.normal(size=d) for i in range(3)}
    nouns = [w for w in vec if w.endswith("/N")]
    vec |= {f"a{j}/J_{n}": rng.normal(size=d) for j in range(3) for n in nouns[: 4 + 4 * j]}
    vec |= {f"v/V_{n}": rng.normal(size=d) for n in nouns[:6]}
    vec |= {f"{s}_v/V_{o}": rng.normal(size=d) for s in nouns[:5] for o in nouns[:6]}
    df = spark.createDataFrame([(k, v.tolist()) for k, v in vec.items()], "entry string, vec array<double>").repartition(3)

    def solve(x, y):
        xt = np.hstack([x, np.ones((len(x), 1))])
        pen = np.diag([lam] * x.shape[1] + [0.0])
        return np.linalg.solve(xt.T @ xt + pen, xt.T @ y)

    one = lambda v: np.append(v, 1.0)
    ask = spark.createDataFrame([(f"a{j}/J_{n}",) for j in range(3) for n in nouns] + [("a9/J_n1/N",), ("a1/J_zz/N",)], "phrase string")
    got = {r.phrase: r.vec for r in RG.compose_baroni(ask, df, RG.train_baroni(df, d, lam, min_samples=5), d).collect()}
    assert set(got) == {f"a{j}/J_{n}" for j in (1, 2) for n in nouns}
    for j in (1, 2):
        heads = nouns[: 4 + 4 * j]
        w = solve(np.stack([vec[n] for n in heads]), np.stack([vec[f"a{j}/J_{n}"] for n in heads]))
        assert all(np.allclose(got[f"a{j}/J_{n}"], one(vec[n]) @ w) for n in nouns)
    pairs = [(f"a{j}/J", n) for j in range(3) for n in nouns[: 4 + 4 * j]]
    w = solve(np.stack([np.append(vec[m], vec[n]) for m, n in pairs]), np.stack([vec[f"{m}_{n}"] for m, n in pairs]))
    got = {r.phrase: r.vec for r in RG.compose_guevara(ask, df, RG.train_guevara(df, d, lam), d).collect()}
    assert len(got) == 36 and all(np.allclose(v, one(np.append(vec[p[:4]], vec[p[5:]])) @ w) for p, v in got.items())
    inner = {o: solve(np.stack([vec[s] for s in nouns[:5]]), np.stack([vec[f"{s}_v/V_{o}"] for s in nouns[:5]])).T for o in nouns[:6]}
    outer = solve(np.stack([vec[o] for o in inner]), np.stack([m.ravel() for m in inner.values()]))
    svo = spark.createDataFrame([(f"{s}_v/V_{o}",) for s in nouns for o in nouns] + [("n1/N_x/V_n2/N",)], "phrase string")
    got = {r.phrase: r.vec for r in RG.compose_multistep(svo, df, RG.train_multistep(df, d, lam)[1], d).collect()}
    assert len(got) == 144
    for s in nouns:
        for o in nouns:
            assert np.allclose(got[f"{s}_v/V_{o}"], (one(vec[o]) @ outer).reshape(d, d + 1) @ one(vec[s]))


def test_sparse_tiles_match_numpy(spark):
    from lexivec.operators.blocks import SparseTiles
    df, a = _sparse_matrix(spark, 50, 30, seed=2)
    x = np.random.default_rng(1).normal(size=(30, 4))
    right = spark.createDataFrame([(f"f{j:03d}", x[j].tolist()) for j in range(30)], "key string, vec array<double>")
    for tile_cells in (1 << 20, 40):
        got = {r.key: np.array(r.vec) for r in SparseTiles(df, tile_cells).multiply(right, "feature", "entry", 4).collect()}
        assert all(np.allclose(got[f"e{i}"], a[i] @ x) for i in range(50))


def test_sparse_tiles_follow_the_long_side(spark):
    """Rows of the long side are shipped once where the other one is short, and products by
    way of them leave the tiles summed."""
    from lexivec.operators.blocks import SparseTiles
    df, a = _sparse_matrix(spark, 400, 10, seed=3)
    tiles = SparseTiles(df, 100)
    assert tiles.lines["feature"] == 1 and tiles.lines["entry"] > 4
    x = np.random.default_rng(2).normal(size=(10, 3))
    right = spark.createDataFrame([(f"f{j:03d}", x[j].tolist()) for j in range(10)], "key string, vec array<double>")
    got = {r.key: np.array(r.vec) for r in tiles.multiply_twice(right, 3).collect()}
    y = a @ x
    assert np.allclose(got.pop(None).reshape(3, 3), y.T @ y)
    assert all(np.allclose(got[f"f{j:03d}"], (a.T @ y)[j]) for j in range(10) if a[:, j].any())
    wide, b = _sparse_matrix(spark, 60, 60, seed=4)
    assert SparseTiles(wide, 40).multiply_twice(right, 3) is None


@pytest.mark.parametrize("tile_cells", [1 << 19, 60])
def test_truncated_svd_whatever_the_tiles(spark, monkeypatch, tile_cells):
    from lexivec.operators import blocks
    monkeypatch.setattr(RD, "SparseTiles", lambda cells: blocks.SparseTiles(cells, tile_cells))
    df, a = _sparse_matrix(spark, 50, 30, seed=5)
    vecs, sigma, _ = RD.truncated_svd(df, 3, oversample=15, power_iters=6)
    u, s, vt = np.linalg.svd(a, full_matrices=False)
    assert np.allclose(sigma, s[:3], rtol=1e-6)
    got = {r.entry: np.array(r.vec) for r in vecs.collect()}
    assert all(np.allclose(np.abs(got[f"e{i}"]), np.abs(u[i, :3] * s[:3]), atol=5e-3) for i in range(50) if a[i].any())


def test_glove_loss_decreases(spark):
    sent = T.sentences(T.read_corpus(spark, SF_SMALL))
    vocab = counting.vocabulary(sent, 5).select(F.col("token").alias("entry"))
    cooc = EM.distance_weighted_cooc(sent, 3).join(vocab, "entry", "left_semi") \
        .join(vocab.withColumnRenamed("entry", "ctx"), "ctx", "left_semi")
    _, losses = EM.train_glove(cooc, dim=4, sweeps=3, track_loss=True)
    assert all(b <= a + 1e-9 for a, b in zip(losses, losses[1:]))


def test_glove_half_sweep_matches_normal_equations(spark):
    """Blocks, routing and the reported loss against numpy, for few and many blocks."""
    rng = np.random.default_rng(6)
    x = np.where(rng.random((25, 25)) < 0.5, rng.random((25, 25)) * 200, 0.0)
    x[3] = rng.random(25) * 50 + 1  # a word that meets all
    cells = [(f"k{i:02d}", f"k{j:02d}", float(x[i, j])) for i in range(25) for j in range(25) if x[i, j] > 0]
    df = spark.createDataFrame(cells, "entry string, ctx string, x double")
    start = {r.key: np.array(r.vec) for r in df.select(F.col("ctx").alias("key")).distinct().select(
        "key", F.transform(RD.gaussian_sketch("key", 3, 0), lambda v: v * 0.1).alias("vec")).collect()}
    names = sorted(start)
    c, cb = np.stack([start[k] for k in names]), np.zeros(25)

    def half(m, vec, bias):
        out = []
        for row in m:
            on = np.flatnonzero(row)
            f = np.minimum(1, (row[on] / 100) ** 0.75)
            xs = np.hstack([vec[on], np.ones((len(on), 1))])
            out.append(np.linalg.solve(xs.T @ (f[:, None] * xs) + np.diag([0.1] * 3 + [0.0]), xs.T @ (f * (np.log(row[on]) - bias[on]))))
        return np.stack(out)[:, :3], np.stack(out)[:, 3]

    for _ in range(2):
        w, wb = half(x, c, cb)
        c, cb = half(x.T, w, wb)
    on = x > 0
    want = np.sum((np.minimum(1, (x / 100) ** 0.75) * (w @ c.T + wb[:, None] + cb - np.log(np.where(on, x, 1))) ** 2)[on])
    for block_cells in (1 << 19, 20):
        vecs, losses = EM.train_glove(df, dim=3, sweeps=2, track_loss=True, block_cells=block_cells)
        got = {r.entry: np.array(r.vec) for r in vecs.collect()}
        assert all(np.allclose(got[k], w[i] + c[i], rtol=1e-3, atol=1e-3) for i, k in enumerate(names))
        assert abs(losses[-1] - want) < 1e-3 * want


def test_word2vec_vocabulary_is_min_count(spark):
    sents = catalog.corpus_sentences(spark, SF_SMALL)
    vocab = {r["token"] for r in counting.vocabulary(sents, 20).collect()}
    vecs = EM.train_word2vec(sents, dim=8, min_count=20, num_partitions=1).collect()
    assert {r["entry"] for r in vecs} == vocab
    assert all(len(r["vec"]) == 8 for r in vecs)


def test_sparse_tsv_round_trip(spark, tmp_path, tmp_text):
    src = read_vectors_tsv(spark, tmp_text("v.txt", "a/N\tx\t1.5\ty\t2.0\nb/V\tx\t3.0\nc/J\n"))
    out = str(tmp_path / "out")
    write_sparse_tsv(src.weights, src.entries, out, types=None)
    back = read_vectors_tsv(spark, out)
    assert sorted(map(tuple, back.weights.collect())) == sorted(map(tuple, src.weights.collect()))
    assert {r["entry"] for r in back.entries.collect()} == {"a/N", "b/V", "c/J"}
    assert any(f.endswith(".gz") for f in os.listdir(out))


def test_conll_reader(spark, tmp_path):
    p = tmp_path / "c.conll"
    p.write_text("1\tAnarchism\tAnarchism\tNNP\tMISC\t5\tnsubj\n2\tis\tbe\tVBZ\tO\t5\tcop\n"
                 "3\tbroken\n4\ta\ta\tDT\tO\t5\tdet\n\n\n1\tPolitical\tpolitical\tJJ\tO\t0\troot\n")
    got = corpus.read_conll(spark, str(p)).orderBy("sentence").collect()
    assert [r["sentence"] for r in got] == ["anarchism/N be/V a/DET", "political/J"]
    assert sum(r["n_malformed"] for r in got) == 1


def test_sentence_files_gzip(spark, tmp_path):
    d = tmp_path / "corpus"
    d.mkdir()
    line = " ".join(f"Word{i}/N" for i in range(10)) + " bad_token\n"
    with gzip.open(d / "a.gz", "wt") as f:
        f.write(line + "short/N line/N\n")
    (d / ".hidden").write_text(line)
    got = corpus.read_sentence_files(spark, str(d)).collect()
    assert len(got) == 1 and got[0]["toks"][0] == "word0/N" and len(got[0]["toks"]) == 10


def test_line_aligned(spark, tmp_text):
    a = tmp_text("p.txt", "big/J_cat/N\nred/J_dog/N\nx/N_y/N\n")
    b = tmp_text("e.txt", "big cat\n*UNKNOWN* dog\nx y\n")
    c = tmp_text("v.txt", "1,2\n3,4\n5,6\n")
    got = read_line_aligned(spark, a, b, c).orderBy("line_no").collect()
    assert [(r["phrase"], list(r["vec"])) for r in got] == [("big/J_cat/N", [1.0, 2.0]), ("x/N_y/N", [5.0, 6.0])]


def test_line_aligned_in_many_splits(spark, tmp_path):
    """Three folders of files of many splits each, one file empty, joined line by line."""
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    lines = [[f"p{f}-{i}/N_x/N" for i in range(400 * f)] for f in range(3)]
    for name, text in (("p", lambda x, i: x), ("e", lambda x, i: "*UNKNOWN*" if i % 7 == 0 else x), ("v", lambda x, i: f"{i},{len(x)}")):
        (tmp_path / name).mkdir()
        for f, rows in enumerate(lines):
            (tmp_path / name / f"part-{f}").write_text("".join(text(x, i) + "\n" for i, x in enumerate(rows)))
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1000b")
        got = read_line_aligned(spark, *(str(tmp_path / n) for n in "pev"))
        rows = {r.phrase: (r.line_no, list(r.vec)) for r in got.collect()}
        (tmp_path / "e" / "part-1").write_text("short\n")
        with pytest.raises(AssertionError):
            read_line_aligned(spark, *(str(tmp_path / n) for n in "pev"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    want = {x: (i, [float(i), float(len(x))]) for rs in lines for i, x in enumerate(rs) if i % 7}
    assert rows == want


def test_model_is_refused_for_other_columns(spark, tmp_path):
    from lexivec.sinks.writers import write_model
    from lexivec.sources.vectors import read_model
    cols = spark.createDataFrame([(0, "x"), (1, "y")], "col_id long, feature string")
    turned = spark.createDataFrame([(0, "y"), (1, "x")], "col_id long, feature string")
    vec = spark.createDataFrame([("n/N", [1.0, 2.0])], "entry string, vec array<double>")
    model = spark.createDataFrame([("a/J", [1.0, 0.0, 0.0, 0.0, 1.0, 5.0])], "modifier string, coef array<double>")
    path = str(tmp_path / "m")
    write_model(model, path, cols)
    loaded = read_model(spark, path, cols)
    ask = spark.createDataFrame([("a/J_n/N",)], "phrase string")
    assert list(RG.compose_baroni(ask, vec, loaded, 2, cols).first().vec) == [1.0, 7.0]
    for call in (lambda: read_model(spark, path, turned), lambda: RG.compose_baroni(ask, vec, loaded, 2, turned),
                 lambda: RG.compose_guevara(ask, vec, loaded, 2, turned)):
        with pytest.raises(AssertionError):
            call()
    with pytest.raises(ValueError):
        RG.compose_baroni(ask, None, loaded, 2)


def test_sampling_guard():
    with pytest.raises(ValueError):
        corpus.check_sampling(95, 2)


def test_multiply_rows_equals_long_form(spark, tmp_text, monkeypatch):
    """Phrases of one to five tokens, listed twice, tokens with and without cells, with and without chunks."""
    src = read_vectors_tsv(spark, tmp_text("m.txt", "a/N\tx\t1\ty\t2\tz\t0\nb/V\tx\t3\tz\t5\nc/J\tx\t2\ty\t1\n"))
    names = ["a/N_b/V", "a/N_b/V_c/J", "b/V_b/V", "a/N_c/J", "a/N", "b/V_b/V_b/V_c/J_a/N", "a/N_q/N"]
    ph = spark.createDataFrame([(p,) for p in names * 2], "phrase string")
    whole = sorted(map(tuple, C.compose_long(ph, src.weights, [C.ADD, C.MULT]).where("composer = 'Mult'").collect()))
    assert ("Mult", "b/V_b/V", "z", 25.0) in whole and ("Mult", "b/V_b/V_b/V_c/J_a/N", "x", 54.0) in whole
    for cells in (1 << 14, 1):
        monkeypatch.setattr(C, "CHUNK_CELLS", cells)
        assert sorted(map(tuple, C.multiply_rows(ph, src.weights).collect())) == whole
        left = sorted(map(tuple, C.pick_long(ph, src.weights, C.LEFT).where("phrase = 'b/V_b/V'").collect()))
        assert left == [("Left", "b/V_b/V", "x", 3.0), ("Left", "b/V_b/V", "z", 5.0)]


def test_conll_wholetext_fallback(spark, tmp_path):
    p = tmp_path / "crlf.conll"
    p.write_bytes(b"1\tA\ta\tDT\tO\t2\tdet\r\n2\tdog\tdog\tNN\tO\t0\troot\r\n \r\n1\tRan\trun\tVBD\tO\t0\troot\r\n")
    got = corpus.read_conll(spark, str(p), wholetext=True).orderBy("sentence").collect()
    assert [r["sentence"] for r in got] == ["a/DET dog/N", "run/V"]


def test_selection_score_func_and_empty_vocabulary(spark):
    from lexivec.operators import selection as SEL
    docfeat, lab = catalog.labelled_docfeat(spark, SF_SMALL)
    flat = SEL.select_features(docfeat, lab, k=5, score_func=lambda d, l: d.select("feature").distinct()
                               .withColumn("score", F.length("feature").cast("double")))
    assert flat.count() == 5
    empty = flat.where("false")
    assert SEL.transform_docs(docfeat, empty).count() == docfeat.count()
