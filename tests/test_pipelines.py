"""End-to-end pipelines on the smallest driver tables."""

import os

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from lexivec.operators import counting
from lexivec.plans import catalog, pipelines as P
from lexivec.sinks.stages import Stages, StaleStage, shared_stage
from lexivec.sources import tables as T


def _phrases(spark):
    return catalog._np_phrases(spark, SF_SMALL)


def test_count_pipeline_resumes_from_stages(spark, tmp_path):
    sent = T.sentences(T.read_corpus(spark, SF_SMALL))
    out = str(tmp_path / "p1")
    done = P.count_pipeline(spark, sent, _phrases(spark), out, min_feature_freq=10, min_event_freq=3,
                            quotas=(("N", 50), ("V", 50), ("J", 50)), dims=5)
    assert done and all(os.path.isdir(p) for p in done)
    # rerun only the compose stage from the persisted stages
    again = P.count_pipeline(spark, sent, _phrases(spark), out, stages=("compose",), dims=5)
    assert sorted(again) == sorted(done)
    first = spark.read.parquet(done[0])
    assert first.where(F.size("vec") != 5).count() == 0


def test_categorical_and_random_pipelines(spark, tmp_path):
    emb = T.read_table(spark, SF_SMALL, "embeddings")
    lex = T.lexicon(emb).select("entry", F.slice("vec", 1, 4).alias("vec"))
    svo = T.svo_triples(T.read_table(spark, SF_SMALL, "lineitem"), 500)
    out = P.categorical_pipeline(spark, svo, lex, str(tmp_path / "p5"), 4)
    assert {r["composer"] for r in out.select("composer").distinct().collect()} == {"CopyObj", "FAdd", "FMult"}
    path = P.random_pipeline(T.phrases(emb), str(tmp_path / "p7"), dim=6)
    assert spark.read.parquet(path).where(F.size("vec") != 6).count() == 0


def test_feature_selection_pipeline(spark):
    docfeat, lab = catalog.labelled_docfeat(spark, SF_SMALL)
    sent = T.sentences(T.read_corpus(spark, SF_SMALL))
    vecs = counting.vocabulary(sent, 3).select(F.col("token").alias("entry"),
                                               F.array(F.length("token").cast("double"), F.lit(1.0)).alias("vec"))
    selected, docs, neigh = P.feature_selection_pipeline(docfeat, lab, vecs, k=300, must_be_in_thesaurus=True)
    n = selected.count()
    assert 0 < n <= 300
    assert sorted(r["col_id"] for r in selected.collect()) == list(range(n))
    assert docs.select("feature").distinct().count() == n
    assert neigh.select("entry").distinct().count() == n


def test_word2vec_glove_and_third_party_pipelines(spark, tmp_path):
    from lexivec.operators.neighbours import random_vectors
    phrases = _phrases(spark)
    corpus = catalog.corpus_sentences(spark, SF_SMALL)
    p2 = P.word2vec_pipeline(spark, corpus, phrases, str(tmp_path / "p2"), percent=50, repeats=2,
                             average=True, dim=6, min_count=5)
    assert any("avg2" in p for p in p2)
    names = spark.read.parquet(p2[0] + ".features").orderBy("col_id").collect()
    assert [r["feature"] for r in names] == [f"f{i:02d}" for i in range(6)]
    sent = T.sentences(T.read_corpus(spark, SF_SMALL))
    p3 = P.glove_pipeline(spark, sent, phrases, str(tmp_path / "p3"), dim=3, sweeps=1, window=2)
    assert p3
    surfaces = catalog._surfaces(spark, SF_SMALL).select("surface", "row_id")
    emb = random_vectors(surfaces.withColumnRenamed("surface", "entry"), 4) \
        .withColumnRenamed("entry", "surface").join(surfaces, "surface")
    p4 = P.third_party_pipeline(spark, emb, phrases, str(tmp_path / "p4"))
    assert p4
    clean = Stages(spark, str(tmp_path / "p4")).read("clean_unigrams")
    assert clean.select("lemma").distinct().count() * 3 == clean.count()


def test_regression_pipeline(spark, tmp_path):
    sf = "/root/testdata/sf0.01"
    space = catalog.observed_space(spark, sf, max_n=3, k=10)
    outs = P.regression_pipeline(spark, space, catalog._np_phrases(spark, sf), str(tmp_path / "p6"), dim=10)
    assert set(outs) == {"Baroni", "Guevara", "Multistep"}
    assert outs["Guevara"].count() > 0 and outs["Baroni"].count() > 0
    assert outs["Guevara"].where(F.size("vec") != 10).count() == 0


def test_killed_run_resumes_and_stale_stage_is_refused(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.range(10).write.parquet(src)
    root = str(tmp_path / "job")

    def job(stages=None, fail=False):
        st = Stages(spark, root, stages)
        a = st("a", lambda: spark.read.parquet(src).withColumn("x", F.col("id") * 2), {"in": spark.read.parquet(src)}, k=2)

        def second():
            if fail:  # dies while its files are being written
                return a.withColumn("x", F.raise_error(F.lit("executor lost")).cast("long"))
            return a.where("x > 4")
        b = st("b", second, {"a": st.digests["a"]})
        return st, b

    with pytest.raises(Exception):
        job(fail=True)
    st, b = job()
    assert st.built == ["b"] and b.count() == 7  # the first stage was committed before
    st, b = job()
    assert st.built == []
    spark.range(20).write.mode("overwrite").parquet(src)
    with pytest.raises(StaleStage):
        job(stages=["b"])
    with pytest.raises(StaleStage):
        Stages(spark, root, [])("c", lambda: spark.range(1), {})
    st, b = job()
    assert st.built == ["a", "b"] and b.count() == 17


def test_shared_stage_follows_its_files(spark, tmp_path):
    src, built = str(tmp_path / "in"), []
    spark.range(3).write.parquet(src)

    def get(**params):
        return shared_stage(spark, "s", [src], params, lambda: built.append(1) or spark.read.parquet(src)).count()
    assert (get(k=1), get(k=1), get(k=2), len(built)) == (3, 3, 3, 2)
    spark.range(5).write.mode("append").parquet(src)
    assert get(k=1) == 8 and len(built) == 3


def test_word2vec_pipeline_from_conll(spark, tmp_path):
    """P2 with its reformatting stage, then only the vectors again."""
    conll = tmp_path / "conll"
    conll.mkdir()
    block = "\n".join(f"{i}\tWord{i}\tword{i}\tNN\tO\t0\troot" for i in range(12))
    for f in ("a.conll", "b.conll"):
        (conll / f).write_text("\n\n".join([block] * 20))
    phrases = spark.createDataFrame([("word1/N_word2/N",)], "phrase string")
    out = str(tmp_path / "p2")
    done = P.word2vec_pipeline(spark, str(conll), phrases, out, dim=4, min_count=5)
    assert done and spark.read.parquet(done[0]).where("entry = 'word1/N_word2/N'").count() == 1
    assert Stages(spark, out).read("reformat").count() == 40
    assert P.word2vec_pipeline(spark, str(conll), phrases, out, dim=4, min_count=5, stages=("vectors",)) == []
