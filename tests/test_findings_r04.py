"""Findings of round 4: steps made lighter give the rows of their plain forms."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lexivec.functions import features as FT
from lexivec.operators import blocks
from lexivec.operators import compose as C
from lexivec.operators import regression as RG
from lexivec.operators import tensors as TS
from lexivec.plans import catalog as K
from lexivec.sources import tables as T


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_rounding_takes_decimals_only_near_the_middle(spark):
    rng = np.random.default_rng(4)
    odd = [0.0, -0.0, 1e-7, -1e-7, 5e-7, -5e-7, 0.1234565, -0.1234565, 2.5000005, 1.0000015, 999999.9999995, 1e6, 1e6 + 5e-7, 1e17,
           -1e300, float("nan"), float("inf"), -float("inf"), 4.9e-324, 0.49949999e-6, 0.5009e-6, 123456.7891235]
    values = odd + list(rng.normal(0, 10, 2000)) + list(rng.integers(-10**8, 10**8, 2000) / 1e7) + [float(f"{x:.7f}") for x in rng.uniform(-9, 9, 2000)]
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "x double")
    got = df.select("x", K._r("x").alias("a"), F.round("x", 6).alias("b")).collect()
    same = [r for r in got if (r.a is None) == (r.b is None) and (r.a is None or (math.isnan(r.a) and math.isnan(r.b))
                               or (r.a == r.b and math.copysign(1, r.a) == math.copysign(1, r.b)))]
    assert len(same) == len(values) + 1
    assert "rint" in plan(df.select(K._r("x"))).lower()


def _tile(monkeypatch, composer):
    """The function that composes a tile."""
    got = []
    monkeypatch.setattr(C, "_tiled", lambda *a, **_: got.append(a[4]) or (None, None))

    class Cells:
        columns = ["entry", "feature", "weight"]
    C.compose_long(None, Cells, [composer])
    return got[0]


def test_min_looks_at_the_rarest_token_only(monkeypatch):
    run = _tile(monkeypatch, C.MIN)

    def refused(*_):
        raise AssertionError("all cells were folded")
    monkeypatch.setattr(C, "_folded", refused)
    cells = pa.table({"token": ["a"] + ["b"] * 500, "feature": ["f7"] + [f"f{i}" for i in range(500)], "weight": [2.0] + [3.0] * 500})
    made = run(pa.table({"phrase": ["a_b", "b_b"], "ts": [["a", "b"], ["b", "b"]]}), cells).to_pylist()
    assert {(r["phrase"], r["feature"]): r["weight"] for r in made} == {("a_b", "f7"): 2.0, **{("b_b", f"f{i}"): 3.0 for i in range(500)}}
    assert len(made) == 501


def test_min_alone_equals_min_among_all(spark):
    rng = np.random.default_rng(2)
    rows = [(f"w{t}", f"f{f}", float(rng.choice([-2.0, -1.0, 0.0, 1.0, 2.0, 3.0]))) for t in range(9) for f in range(12) if rng.random() < .5]
    rows += [("w1", "f3", float("nan")), ("n1", "f3", 2.0), ("n1", "f4", None), (None, "f3", 2.0), ("w2", None, -1.0)]
    rows = [r for r in rows if r != ("w1", "f3")]
    phrases = ["_".join(f"w{t}" for t in rng.integers(0, 11, n)) for n in (1, 2, 2, 3) for _ in range(12)] + ["w1_n1", "n1_w1", "n1_n1"]
    df = spark.createDataFrame([(p,) for p in phrases], "phrase string")

    def cells(weights, composers, tile):
        got = C.compose_long(df, weights, composers, tile_cells=tile).where("composer = 'Min'").collect()
        return sorted((r.phrase, str(r.feature), repr(r.weight)) for r in got)

    for data in (rows, rows + rows[:7]):  # some cells twice
        weights = spark.createDataFrame([r for r in data if r[0] is not None], "entry string, feature string, weight double")
        for tile in (4, 1 << 21):
            want = cells(weights, [C.MIN, C.MAX], tile)
            assert want and cells(weights, [C.MIN], tile) == want


def test_tiles_send_no_composer_name(spark):
    weights = spark.createDataFrame([("a", "f", 1.0), ("b", "f", 2.0), ("b", "g", 4.0)], "entry string, feature string, weight double")
    df = spark.createDataFrame([("a_b",)], "phrase string")
    out = C.compose_long(df, weights, [C.AVG])
    assert sorted(map(tuple, out.collect())) == [("Avg", "a_b", "f", 1.5), ("Avg", "a_b", "g", 2.0)]
    assert "composer" not in [f.name for f in C._CELLS if pa.types.is_string(f.type)]


def test_frequent_pairs_are_counted_before_their_type_is_tested(spark, monkeypatch):
    seen = []
    real = C.contains
    monkeypatch.setattr(C, "contains", lambda phrases, *a, **k: seen.append(plan(phrases)) or real(phrases, *a, **k))
    monkeypatch.setattr(K, "shared_stage", lambda spark, name, paths, params, build: build())
    K.sparse_space(spark, "/root/testdata/sf0.001")
    assert len(seen) == 1 and "Aggregate" not in seen[0] and "Generate" not in seen[0]


def test_zero_products_are_found_without_shipping_cells(spark):
    rng = np.random.default_rng(5)
    rows = [(f"w{t}", f"f{f}", float(rng.integers(1, 5))) for t in range(8) for f in range(15) if rng.random() < .3]
    weights = spark.createDataFrame(rows, "entry string, feature string, weight double")
    phrases = sorted({"_".join(f"w{t}" for t in rng.integers(0, 9, n)) for n in (1, 2, 2, 3, 3) for _ in range(9)})
    df = spark.createDataFrame([(p,) for p in phrases + phrases[:4]], "phrase string")
    for tile in (4, 1 << 21):
        cells = C.multiply_rows(df, weights, tile_cells=tile).select("phrase", "feature", "weight").collect()
        want = sorted(map(str, map(tuple, cells))) + [str((p, None, None)) for p in phrases if p not in {c.phrase for c in cells}]
        out = C.multiply_all_rows(df, weights, tile_cells=tile)
        assert sorted(want) == sorted(str((r.phrase, r.feature, r.weight)) for r in out.collect()) and {r.composer for r in out.collect()} == {"Mult"}
        assert any("None" in w for w in want)
    assert "LeftOuter" not in plan(out) and "RightOuter" not in plan(out)


def _type_by_tokens(feature):
    """The feature type, token by token."""
    pattern = r"^([^/_]+)/([A-Z]+)$"
    toks = F.split(feature, "_")
    n, ok = F.size(toks), F.forall(toks, lambda t: t.rlike(pattern))
    tags = F.array_join(F.transform(toks, lambda t: F.regexp_extract(t, pattern, 2)), ",")
    return (F.when(n > 3, "EMPTY").when(~ok, "EMPTY").when(n == 1, "1-GRAM").when((n == 2) & (tags == "J,N"), "AN")
            .when((n == 2) & (tags == "N,N"), "NN").when((n == 2) & (tags == "V,N"), "VO").when(n == 2, "2-GRAM")
            .when(tags == "N,V,N", "SVO").otherwise("3-GRAM"))


def test_type_of_the_whole_feature_equals_type_by_tokens(spark):
    rng = np.random.default_rng(6)
    pieces = ["a", "é/N", "b/J", "cc/V", "d/N", "x/NN", "/N", "a/", "a/n", "a/N/N", "", "a/N\n", "a\n/V", "b/J\r\n", "b/J\n\n", "c/N\u2028",
              "c/V\u0085", "\n", "a/N ", " /N", "1/RB", "a/J\r", "_", "a/N\x0b"]
    features = [None, ""] + pieces + ["_".join(rng.choice(pieces, n)) for n in (1, 2, 2, 3, 3, 3, 4, 5) for _ in range(400)] \
        + ["_".join(rng.choice(pieces[1:5], n)) for n in (2, 3, 4) for _ in range(80)]
    df = spark.createDataFrame([(f,) for f in features], "feature string")
    got = df.select("feature", FT.feature_type("feature").alias("a"), _type_by_tokens(F.col("feature")).alias("b")).collect()
    assert [r for r in got if r.a != r.b] == [] and len({r.a for r in got}) == 8
    made = plan(df.select(FT.feature_type(F.concat("feature", F.lit("/N"))).alias("a")))
    assert "split" not in made and made.count("concat") == 1


def test_grams_equal_those_of_slices(spark):
    sent = spark.createDataFrame([(["a", "b", "a", "b", "c"],), (["b"],), ([],), (["é", "a"],), (["x", "y", "z"],)], "toks array<string>")
    made = K.distinct_grams(sent, 4)
    want = {"_".join(r.toks[i: i + n]) for r in sent.collect() for n in range(1, 5) for i in range(len(r.toks) - n + 1)}
    got = [r.feature for r in made.collect()]
    assert sorted(got) == sorted(want) and "lambda" not in plan(made)


def test_outer_tokens_equal_those_of_the_split(spark):
    df = spark.createDataFrame([(f,) for f in ("a", "", "_", "a_", "_a", "a/N_b/V_c/N", "__", None)], "feature string")
    for i in (0, -1):
        got = df.select(FT.token_at("feature", i).alias("a"), F.try_element_at(F.split("feature", "_"), F.lit(1 if i == 0 else -1)).alias("b"))
        assert all(r.a == r.b for r in got.collect()) and "split" not in plan(df.select(FT.token_at("feature", i)))


def test_triples_are_told_apart_as_numbers_and_phrases_joined_last(spark):
    rows = [(p, s, n) for p in (1, 2, 12, None) for s in (3, 13, 4, None) for n in (1, 2)] * 2
    lineitem = spark.createDataFrame(rows, "l_partkey long, l_suppkey long, l_linenumber int")
    svo = T.svo_triples(lineitem, 10)
    subj, obj = ({f"w{k}/N" for k in ks} | {None} for ks in ((1, 2), (3, 4)))
    want = {(s, f"v{n}/V", o) for s in subj for o in obj for n in (1, 2)}
    got = [(r.subj, r.verb, r.obj) for r in svo.collect()]
    assert len(got) == len(want) and set(got) == want
    assert all(r.phrase == "_".join(x for x in (r.subj, r.verb, r.obj) if x) for r in svo.collect())
    assert "Aggregate [s#" in plan(svo)
    # phrases left out give the same rows
    rng = np.random.default_rng(7)
    vecs = spark.createDataFrame([(w, rng.normal(size=4).tolist()) for w in ("w1/N", "w2/N", "w3/N", "w4/N")], "entry string, vec array<double>")
    mats = spark.createDataFrame([(v, rng.normal(size=16).tolist()) for v in ("v1/V", "v2/V")], "verb string, mat array<double>")
    rows = lambda df: sorted((r.composer, r.phrase, tuple(r.vec)) for r in df.collect())
    made = rows(TS.compose_categorical(svo.drop("phrase"), vecs, mats, 4))
    assert len(made) == 3 * 8 and made == rows(TS.compose_categorical(svo, vecs, mats, 4))


def test_categorical_queries_deal_triples_that_are_written(spark):
    lex, svo = K._tensor_inputs(spark, "/root/testdata/sf0.001")
    assert svo.columns == ["subj", "verb", "obj"] and "Aggregate" not in plan(svo)


def test_few_samples_are_sent_as_they_are(spark):
    rng = np.random.default_rng(8)
    names = [g for g, n in (("hot", 900), ("mid", 60), ("rare", 3), ("one", 1), (None, 5)) for _ in range(n)] + [f"m{i % 40}" for i in range(200)]
    x, y, w = rng.normal(size=(len(names), 20)), rng.normal(size=(len(names), 10)), rng.uniform(.5, 2, len(names))
    df = spark.createDataFrame([(g, a.tolist(), b.tolist(), float(c)) for g, a, b, c in zip(names, x, y, w)],
                               "grp string, x array<double>, y array<double>, w double").repartition(6)
    part = RG.partial_sums(df, 20, 10, ["grp"], raw=True).collect()
    full, sent = 21 * 31, sum(len(r.s) for r in part)
    assert sent < 0.5 * full * len(part) and any(r.raw for r in part) and not all(r.raw for r in part)
    assert all(len(r.s) == (30 * r.n if r.raw else full) for r in part)
    pen = np.eye(21)
    pen[-1, -1] = 0
    for weighted in (False, True):
        got = {r.grp: r for r in RG.fit_ridge_groups(df, 20, 10, min_samples=2, weighted=weighted).collect()}
        assert set(got) == set(names) - {"one"}
        for g, r in got.items():
            at = [i for i, name in enumerate(names) if name == g]
            xt = np.hstack([x[at], np.ones((len(at), 1))])
            xw = xt * w[at][:, None] if weighted else xt
            assert r.n_samples == len(at) and np.allclose(r.coef, np.linalg.solve(xw.T @ xt + pen, xw.T @ y[at]).T.ravel())


def test_svd_tiles_follow_the_cores_not_the_cells():
    # 24 tiles of 524,288 cells before, with the dense rows shipped to 12 x 2 lines
    assert blocks._lines(12 << 20, 700_000, 150_000, 8) == {"entry": 8, "feature": 1}
    assert blocks._lines(12 << 20, 700_000, 150_000, 8, 1 << 19) == {"entry": 12, "feature": 2}
    assert blocks._lines(1 << 30, 70_000_000, 2_000_000, 8)["feature"] > 1
    big = blocks._lines(1 << 30, 70_000_000, 200_000, 8)
    assert big["entry"] * big["feature"] >= 512 and blocks._lines(0, 0, 0, 8) == {"entry": 1, "feature": 1}
