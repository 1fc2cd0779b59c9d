"""Scalar functions, predicates, small readers and writers."""

import pytest
from pyspark.sql import functions as F

from lexivec.functions import features as FT
from lexivec.operators import compose as C
from lexivec.operators import counting
from lexivec.operators.regression import check_space
from lexivec.sinks.writers import write_dense, write_model, write_triples
from lexivec.sources import corpus
from lexivec.sources.vectors import (read_glove_text, read_phrase_list, read_svo_list,
                                     read_vectors_tsv)


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("feature,typ", [
    ("cat/N", "1-GRAM"), ("red/J_cat/N", "AN"), ("cat/N_food/N", "NN"), ("eat/V_food/N", "VO"),
    ("cat/N_eat/V_food/N", "SVO"), ("a/N_b/V", "2-GRAM"), ("a/N_b/V_c/J", "3-GRAM"),
    ("a/N_b/N_c/N_d/N", "EMPTY"), ("cat", "EMPTY"), ("cat/n", "EMPTY"), ("", "EMPTY")])
def test_feature_type(spark, feature, typ):
    assert one(spark, FT.feature_type, feature) == typ


def test_token_helpers(spark):
    assert one(spark, lambda c: FT.token_at(c, -1), "a/N_b/V_c/J") == "c/J"
    assert one(spark, lambda c: FT.token_at(c, 5), "a/N_b/V") is None
    assert one(spark, lambda c: FT.tail(c, 1), "a/N_b/V_c/J") == "b/V_c/J"
    assert one(spark, FT.smart_lower, "Spain/N") == "spain/N"
    assert one(spark, FT.strip_pos, "spain/N") == "spain"
    assert one(spark, FT.row_rename, "red cat") == "red_cat"
    assert one(spark, lambda c: FT.render_tokens(FT.parse_feature(c)["tokens"]), "red/J_cat/N") == "red/J_cat/N"
    names = spark.range(1).select(FT.dimension_names(3, "rand%d").alias("n")).first()["n"]
    assert names == ["rand0", "rand1", "rand2"]


def test_coarse_pos(spark):
    tags = ["NNP", "VBZ", "MD", "JJR", "RB", "DT", "PRP$", "IN", ".", "XYZ"]
    got = [one(spark, FT.coarse_pos, t) for t in tags]
    assert got == ["N", "V", "V", "J", "RB", "DET", "PRON", "CONJ", "PUNCT", "UNK"]


def test_predicates(spark):
    assert one(spark, FT.default_row_filter, "cat/N") and not one(spark, FT.default_row_filter, "now/RB")
    assert one(spark, FT.default_row_filter_nopos, "cat") and not one(spark, FT.default_row_filter_nopos, "a_b")
    assert one(spark, FT.nouns_only, "cat/N") and not one(spark, FT.nouns_only, "red/J")
    assert one(spark, FT.embedding_junk_filter, "cats/N") and not one(spark, FT.embedding_junk_filter, "a/N")
    assert one(spark, FT.has_punct_or_digit, "don't") and not one(spark, FT.has_punct_or_digit, "Dont")
    assert not one(spark, FT.without_unknown, "*UNKNOWN* cat")


def test_check_vectors_and_space(spark):
    with pytest.raises(ValueError):
        C.check_vectors(None)
    with pytest.raises(ValueError):
        C.check_vectors(spark.createDataFrame([("a",)], "x string"))
    a = spark.createDataFrame([(0, "x"), (1, "y")], "col_id int, feature string")
    check_space(a, a)
    with pytest.raises(AssertionError):
        check_space(a, spark.createDataFrame([(0, "y"), (1, "x")], "col_id int, feature string"))


def test_small_readers(spark, tmp_text):
    inst = corpus.read_instances(spark, tmp_text("i.txt", "it/PRON\tT:become/V\tT:a/DET\nbe/V\tT:it/PRON\n"))
    counts = counting.count_events(counting.instance_pairs(inst))
    assert counts.count() == 3
    glove = read_glove_text(spark, tmp_text("g.txt", "cat 0.1 0.2\ndog 0.3 0.4\n")).collect()
    assert [(r["entry"], r["vec"]) for r in glove] == [("cat", [0.1, 0.2]), ("dog", [0.3, 0.4])]
    ph = read_phrase_list(spark, tmp_text("p.txt", "cat/N\nred/J_cat/N\nred/J_cat/N\n"), include_unigrams=False)
    assert [r["phrase"] for r in ph.collect()] == ["red/J_cat/N"]
    svo = read_svo_list(spark, tmp_text("s.txt", "cat/N_eat/V_fish/N\ncat/N_eat/V_fish/N\nred/J_cat/N\n"))
    assert [(r["subj"], r["verb"], r["obj"]) for r in svo.collect()] == [("cat/N", "eat/V", "fish/N")]


def test_writers(spark, tmp_path, tmp_text):
    store = read_vectors_tsv(spark, tmp_text("v.txt", "a/N\tx\t1\ty\t2\nb/V\ty\t3\n"))
    write_triples(store.weights, store.entries, store.features, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t" / "triples")).count() == 3
    write_dense(store.to_dense(), str(tmp_path / "d"), store.features)
    dense = {r["entry"]: r["vec"] for r in spark.read.parquet(str(tmp_path / "d" / "vectors")).collect()}
    assert dense == {"a/N": [1.0, 2.0], "b/V": [0.0, 3.0]}
    write_model(spark.createDataFrame([("m", [1.0])], "modifier string, coef array<double>"), str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).count() == 1
