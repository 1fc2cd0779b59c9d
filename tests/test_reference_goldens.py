"""The reference's own unit tests, re-expressed on DataFrames."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexivec.operators import compose as C
from lexivec.operators.neighbours import random_vectors
from lexivec.sources.vectors import read_vectors_tsv

# The reference's fixture vector files, verbatim.
SMALL = ("a/N\tt:t1\t1\tt:t2\t2\tamod:c\t2\tt:t3\t3\n"
         "b/V\tt:t3\t3\tnow/RB\t7\talso/RB\t5\n"
         "c/J\tamod:c\t9\tnow/RB\t8\tt:t5\t4\tt:t4\t10\n")
EXP0 = ("cat/N\tdog/N\t0.8\tgame/N\t0.4\n"
        "dog/N\tcat/N\t0.7\tkid/N\t0.3\n"
        "game/N\tplay/V\t0.6\tcat/N\t0.04\tdog/N\t0.03\n"
        "kid/N\tfruit/N\t0.1\tcat/N\t0.02\tdog/N\t0.01\n"
        "fruit/N\tcat/N\t0.06\tdog/N\t0.05\n"
        "like/V\tplay/V\t0.11\t\n"
        "play/V\tlike/V\t0.09\n")
ONES = ("a/N\ta\t1\tb\t0\tc\t0\td\t0\n"
        "b/V\ta\t0\tb\t1\tc\t0\td\t0\n"
        "c/J\ta\t0\tb\t0\tc\t1\td\t0\n"
        "d/N\ta\t0\tb\t0\tc\t0\td\t1\n")
ONES_NOPOS = ONES.replace("a/N", "a").replace("b/V", "b").replace("c/J", "c").replace("d/N", "d")


@pytest.fixture()
def small(spark, tmp_text):
    return read_vectors_tsv(spark, tmp_text("small.txt", SMALL))


@pytest.fixture()
def vectors_a(spark, tmp_text):
    return read_vectors_tsv(spark, tmp_text("exp0.txt", EXP0))


@pytest.fixture()
def ones(spark, tmp_text):
    return read_vectors_tsv(spark, tmp_text("ones.txt", ONES))


def dense_rows(store):
    return {r["entry"]: list(r["vec"]) for r in store.to_dense().collect()}


def columns(store):
    return [r["feature"] for r in store.features.orderBy("col_id").collect()]


def phrases_df(spark, phrases):
    return spark.createDataFrame([(p, i) for i, p in enumerate(phrases)], "phrase string, ord long")


def composable(spark, store, composer, phrases, pos_mode=True):
    ok = C.contains(phrases_df(spark, phrases), store.entries, composer, pos_mode)
    return {r["phrase"] for r in ok.collect()}


def long_to_dense(cells, cols, phrase):
    vec = np.zeros(len(cols))
    for r in cells.where(F.col("phrase") == phrase).collect():
        vec[cols.index(r["feature"])] = r["weight"]
    return vec


def test_unigram_source_get_vector(spark, small):
    assert dense_rows(small)["a/N"] == [0.0, 2.0, 0.0, 1.0, 2.0, 3.0, 0.0, 0.0]
    assert columns(small) == ["also/RB", "amod:c", "now/RB", "t:t1", "t:t2", "t:t3", "t:t4", "t:t5"]
    keys = spark.createDataFrame([("jfhjgjdfyjhgb/N",), ("jfhjgjdfyjhgb/J",)], "entry string")
    got = small.get_vector(keys).collect()
    assert len(got) == 2 and all(r["feature"] is None for r in got)


def test_unigram_source_contains(small):
    names = {r["entry"] for r in small.entries.collect()}
    assert "a/N" in names
    assert "unk/UNK" not in names and "a/N_b/V" not in names


def test_additive_composer_contains(spark, small):
    ok = composable(spark, small, C.ADD, ["a/N_b/V", "b/V_c/J", "a/N_c/J", "b/V_b/V_b/V",
                                          "a/N", "unk/UNK", "a/N_UNK/UNK"])
    assert ok == {"a/N_b/V", "b/V_c/J", "a/N_c/J", "b/V_b/V_b/V"}


def test_additive_composer_contains_nopos(spark, tmp_text):
    store = read_vectors_tsv(spark, tmp_text("nopos.txt", ONES_NOPOS), enforce_word_entry_pos_format=False)
    assert {r["entry"] for r in store.entries.collect()} == set("abcd")
    ok = composable(spark, store, C.ADD, ["b_c", "a_c", "b_b_b", "a_b", "d", "d/N", "a/N"], pos_mode=False)
    assert ok == {"b_c", "a_c", "b_b_b", "a_b"}


def test_add_mult_avg_compose_with_real_data(spark, small):
    cols = columns(small)
    cells = C.compose_long(phrases_df(spark, ["a/N_b/V", "a/N_b/V_c/J"]), small.weights,
                           [C.ADD, C.AVG, C.MULT])
    add = cells.where("composer = 'Add'")
    mult = cells.where("composer = 'Mult'")
    avg = cells.where("composer = 'Avg'")
    assert list(long_to_dense(mult, cols, "a/N_b/V")) == [0, 0, 0, 0, 0, 9, 0, 0]
    assert list(long_to_dense(add, cols, "a/N_b/V")) == [5, 2, 7, 1, 2, 6, 0, 0]
    assert list(long_to_dense(add, cols, "a/N_b/V_c/J")) == [5, 11, 15, 1, 2, 6, 10, 4]
    assert list(long_to_dense(avg, cols, "a/N_b/V")) == list(np.array([5, 2, 7, 1, 2, 6, 0, 0]) / 2)


def test_add_mul_compose_with_synthetic_data(spark):
    vec = spark.createDataFrame([("a/N", [float(x) for x in range(10)])], "entry string, vec array<double>")
    for i in range(1, 4):
        phrase = "_".join(["a/N"] * i)
        ph = phrases_df(spark, [phrase])
        add = C.get_vector_dense(ph, vec, C.ADD).first()["vec"]
        mult = C.get_vector_dense(ph, vec, C.MULT).first()["vec"]
        assert np.array_equal(add, np.arange(10) * i)
        assert np.array_equal(mult, np.arange(10) ** i)


def test_min_max_composer(spark, ones):
    cols = columns(ones)
    cells = C.compose_long(phrases_df(spark, ["a/N_b/V_c/J", "b/V_c/J", "b/V"]), ones.weights, [C.MIN, C.MAX])
    mn, mx = cells.where("composer = 'Min'"), cells.where("composer = 'Max'")
    assert list(long_to_dense(mn, cols, "a/N_b/V_c/J")) == [0, 0, 0, 0]
    assert list(long_to_dense(mx, cols, "a/N_b/V_c/J")) == [1, 1, 1, 0]
    assert list(long_to_dense(mn, cols, "b/V_c/J")) == [0, 0, 0, 0]
    assert list(long_to_dense(mx, cols, "b/V_c/J")) == [0, 1, 1, 0]
    assert list(long_to_dense(mn, cols, "b/V")) == [0, 1, 0, 0]


def test_min_max_composer_contains(spark, ones):
    for comp in (C.MIN, C.MAX):
        ok = composable(spark, ones, comp, ["a/N_b/V_c/J", "b/V_c/J", "b/V_c/J_x/N", "b/X_c/X"])
        assert ok == {"a/N_b/V_c/J", "b/V_c/J"}


def test_left_right_contains(spark, vectors_a):
    cands = ["like/V_fruit/N", "fruit/N_cat/N", "kid/N_like/V_fruit/N", "cat/N", "red/J_cat/N"]
    left = composable(spark, vectors_a, C.LEFT, cands)
    right = composable(spark, vectors_a, C.RIGHT, cands)
    assert left == {"like/V_fruit/N", "fruit/N_cat/N", "kid/N_like/V_fruit/N"}
    assert right == left | {"red/J_cat/N"}


def test_left_right_get_vector(spark, vectors_a):
    cols = columns(vectors_a)
    assert len(cols) == 7
    ph = phrases_df(spark, ["like/V_fruit/N"])
    left = long_to_dense(C.pick_long(ph, vectors_a.weights, C.LEFT), cols, "like/V_fruit/N")
    right = long_to_dense(C.pick_long(ph, vectors_a.weights, C.RIGHT), cols, "like/V_fruit/N")
    assert list(left) == [0, 0, 0, 0, 0, 0, 0.11]
    assert list(right) == [0.06, 0.05, 0, 0, 0, 0, 0]
    assert list(right) == dense_rows(vectors_a)["fruit/N"]


def test_left_right_compose_all(spark, vectors_a):
    phrases = ["cat/N_game/N", "dog/N_game/N", "cat/N_a/N", "cat/N_b/N", "cat/N_c/N", "cat/N_d/N"]
    idx = C.compose_all_index(vectors_a.entries, phrases_df(spark, phrases), vectors_a.entries, C.LEFT)
    rows = {r["entry"]: r["row_id"] for r in idx.collect()}
    assert len(rows) == 13
    assert rows["cat/N_game/N"] == 7 and rows["dog/N_game/N"] == 8
    assert sorted(rows.values()) == list(range(13))
    before = {r["entry"]: r["row_id"] for r in vectors_a.entries.collect()}
    assert all(rows[e] == i for e, i in before.items())


def test_compose_all_rejects_overlap(spark, vectors_a):
    clashing = vectors_a.entries.union(spark.createDataFrame([("cat/N_game/N", 99)], "entry string, row_id long"))
    with pytest.raises(Exception):
        C.compose_all_index(clashing, phrases_df(spark, ["cat/N_game/N"]), vectors_a.entries, C.LEFT).collect()


def test_verb_composer(spark, ones):
    cols = columns(ones)
    ok = composable(spark, ones, C.VERB, ["a/N_b/V_a/N"])
    assert ok == {"a/N_b/V_a/N"}
    v = long_to_dense(C.pick_long(phrases_df(spark, ["a/N_b/V_a/N"]), ones.weights, C.VERB), cols, "a/N_b/V_a/N")
    assert list(v) == [0, 1, 0, 0]


def test_random_vectors(spark):
    feats = spark.createDataFrame([("a/N",), ("b/V",), ("a/N_b/V",)], "entry string")
    rows = random_vectors(feats, dim=10).collect()
    assert all(len(r["vec"]) == 10 and all(0 <= x < 1 for x in r["vec"]) for r in rows)
