"""The composed matrix, and options of selection and training."""

import numpy as np
import pytest

from lexivec.operators import compose as C
from lexivec.operators import embeddings as EM
from lexivec.operators import regression as RG
from lexivec.operators import selection as SEL

VEC = "entry string, vec array<double>"


def test_compose_all_matrix(spark):
    uni = spark.createDataFrame([("a/J", 0, [1.0, 2.0]), ("b/N", 1, [3.0, 4.0]), ("c/N", 2, [5.0, 6.0])], "entry string, row_id long, vec array<double>")
    phrases = spark.createDataFrame([("b/N_c/N", 5), ("a/J_b/N", 3), ("a/J_b/N", 9), ("a/J_x/N", 1), ("b/N", 0)], "phrase string, ord long")
    got = [(r.row_id, r.entry, list(r.vec)) for r in C.compose_all(uni, phrases, C.ADD).orderBy("row_id").collect()]
    assert got == [(0, "a/J", [1.0, 2.0]), (1, "b/N", [3.0, 4.0]), (2, "c/N", [5.0, 6.0]), (3, "a/J_b/N", [4.0, 6.0]), (4, "b/N_c/N", [8.0, 10.0])]
    with pytest.raises(ValueError):
        C.compose_all(uni, phrases.where("phrase = 'a/J_x/N'"), C.ADD)


def test_selection_by_clusters(spark):
    docfeat = spark.createDataFrame([(d, f) for d in range(8) for f in ("p", "q") if d % 2 == 0 or f == "q"], "doc_id long, feature string")
    labels = spark.createDataFrame([(d, d % 2) for d in range(8)], "doc_id long, y int")
    clusters = spark.createDataFrame([("q", 1), ("z", 2)], "entry string, cluster int")
    got = SEL.select_features(docfeat, labels, must_be_in_thesaurus=True, clusters=clusters).collect()
    assert [(r.feature, r.col_id) for r in got] == [("q", 0)]
    with pytest.raises(ValueError):
        SEL.select_features(docfeat, labels, must_be_in_thesaurus=True)


def test_guevara_core_pos(spark):
    """With nouns only, the model is that of the noun-noun pairs."""
    r = np.random.default_rng(2)
    words = [f"j{i}/J" for i in range(6)] + [f"n{i}/N" for i in range(6)]
    named = words + [f"{a}_{b}" for a in words for b in words[6:] if a != b]
    vectors = spark.createDataFrame([(e, r.normal(size=3).tolist()) for e in named], VEC)
    every = RG.train_guevara(vectors, 3).first().asDict()
    nouns = RG.train_guevara(vectors, 3, core_pos=("N",)).first().asDict()
    only = RG.train_guevara(vectors.where("not entry like '%/J%'"), 3).first().asDict()
    assert np.allclose(nouns["coef"], only["coef"]) and not np.allclose(every["coef"], only["coef"])


def test_word2vec_vocabulary_subset(spark):
    sentences = spark.createDataFrame([(["a/N", "b/V", "c/N"] * 4,)] * 10, "toks array<string>")
    vocab = spark.createDataFrame([("a/N",), ("zzz/N",), ("a/N",)], "entry string")
    got = EM.train_word2vec(sentences, dim=4, min_count=1, num_partitions=1, vocab=vocab).collect()
    assert [r.entry for r in got] == ["a/N"] and len(got[0].vec) == 4
