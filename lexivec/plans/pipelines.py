"""End-to-end pipelines.

Each pipeline is a chain of DataFrame stages under ``out_dir`` (S6, ``sinks/stages.py``):
a stage is committed by a manifest with the digest of its inputs and parameters, a run
that was killed goes on after the last committed one, and ``stages`` names those to
run, where the others must be there, made from the same inputs.
"""

from __future__ import annotations

import logging
import os

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lexivec.functions.features import default_row_filter, dimension_names, embedding_junk_filter
from lexivec.operators import cleaning, compose as C, counting, embeddings as EM, neighbours as NB
from lexivec.operators import reduction as RD, regression as RG, selection as SEL, tensors as TS
from lexivec.sinks.stages import Stages, files_digest, table_digest
from lexivec.sinks.writers import write_sparse_tsv, write_tensors
from lexivec.sources.corpus import read_conll

log = logging.getLogger(__name__)

# The composers each reference pipeline runs.
COUNT_COMPOSERS = (C.ADD, C.MULT, C.LEFT, C.VERB, C.RIGHT)
EMBEDDING_COMPOSERS = (C.ADD, C.MULT, C.LEFT, C.RIGHT, C.VERB)


def dense_features(spark: SparkSession, dims: int, pattern: str) -> DataFrame:
    """``(col_id, feature)`` names of dense columns (``f%02d``, ``f%d``,
    ``RAE-feat%d``, ``rand%d``)."""
    return spark.range(1).select(F.posexplode(dimension_names(dims, pattern)).alias("col_id", "feature"))


def compose_and_write(unigrams: DataFrame, phrases: DataFrame, composers, out_dir: str,
                      name: str, dense: bool = True, row_filter=default_row_filter,
                      dim_pattern: str = "f%d") -> list[str]:
    """Unigram vectors filtered at load (C1), every composer run over the
    phrase list, one output per composer (unigrams first, then composed
    phrases) plus its column names.  A composer that composes nothing is
    logged and skipped."""
    uni = unigrams.where(row_filter(F.col("entry")))
    dims = len(uni.select("vec").first()["vec"]) if uni.limit(1).count() else 0
    done = []
    for comp in composers:
        out = C.compose_dense(phrases, uni, [comp]).select("phrase", "vec")
        if out.limit(1).count() == 0:
            log.error("%s cannot compose any of the provided phrases", comp.name)
            continue
        rows = uni.select("entry", "vec").unionByName(out.withColumnRenamed("phrase", "entry"))
        path = os.path.join(out_dir, f"composed_{name}_{comp.name}")
        if dense:
            rows.write.mode("overwrite").parquet(path)
            dense_features(rows.sparkSession, dims, dim_pattern).write.mode("overwrite") \
                .parquet(path + ".features")
        else:
            cells = rows.select("entry", F.posexplode("vec").alias("col_id", "weight")) \
                .select("entry", F.format_string("f%d", "col_id").alias("feature"), "weight")
            write_sparse_tsv(cells, rows.select("entry"), path)
        done.append(path)
    return done


def count_pipeline(spark: SparkSession, sentences: DataFrame, phrases: DataFrame, out_dir: str,
                   stages=("unigrams", "ppmi", "svd", "compose"), window: int = 2,
                   min_feature_freq: int = counting.MIN_FEATURE_FREQ,
                   min_event_freq: int = counting.MIN_EVENT_FREQ,
                   quotas=counting.TYPE_QUOTAS, dims: int = 100) -> list[str]:
    """Window contexts -> counts + C11 -> PPMI -> G1 quotas + SVD -> E16."""
    st = Stages(spark, out_dir, stages)
    counts = st("unigrams", lambda: counting.frequency_filter(
        counting.count_events(counting.window_pairs(sentences, window)), min_feature_freq, min_event_freq),
        {"sentences": sentences}, window=window, min_feature_freq=min_feature_freq, min_event_freq=min_event_freq)
    ppmi = st("ppmi", lambda: counting.ppmi(counts), {"counts": st.digests["unigrams"]})

    def reduce():
        kept = counting.type_quota(counts, quotas).select("entry")
        vecs, _, _ = RD.truncated_svd(ppmi.join(kept, "entry", "left_semi"), dims)
        return vecs

    vectors = st("svd", reduce, {"ppmi": st.digests["ppmi"], "counts": st.digests["unigrams"]}, dims=dims, quotas=sorted(dict(quotas).items()))
    if not st.wants("compose"):
        return []
    return compose_and_write(vectors, phrases, COUNT_COMPOSERS, os.path.join(out_dir, "composed"), f"count-{dims}")


def word2vec_pipeline(spark: SparkSession, corpus: DataFrame, phrases: DataFrame, out_dir: str,
                      percent: float = 100, repeats: int = 1, average: bool = False,
                      dim: int = EM.W2V_DIM, min_count: int = EM.W2V_MIN_COUNT,
                      stages=("reformat", "vectors", "average", "compose"), remove_pos: bool = False) -> list[str]:
    """Sentence corpus with ``file`` -> C15 + I1/I2 -> F6 -> E16.  Where ``corpus`` is
    the path of a CoNLL folder it is read and reformatted first (A3)."""
    st = Stages(spark, out_dir, stages)
    if isinstance(corpus, str):
        corpus = st("reformat", lambda: read_conll(spark, corpus, remove_pos=remove_pos).where("sentence != ''").select(
            "file", F.split("sentence", " ").alias("toks")), {"conll": files_digest(spark, [corpus])}, remove_pos=remove_pos)
    reps = st("vectors", lambda: EM.train_word2vec_repeats(corpus, percent, repeats, dim=dim, min_count=min_count),
              {"corpus": st.digests.get("reformat") or corpus}, percent=percent, repeats=repeats, dim=dim, min_count=min_count)
    averaged = None
    if average and repeats > 1:
        averaged = st("average", lambda: cleaning.combine_repeats(reps, repeats, "mean"), {"vectors": st.digests["vectors"]}, repeats=repeats)
    outputs = []
    if not st.wants("compose"):
        return outputs
    for r in range(repeats):
        outputs += compose_and_write(reps.where(F.col("repeat") == r).select("entry", "vec"), phrases,
                                     EMBEDDING_COMPOSERS, out_dir, f"w2v-rep{r}", dim_pattern="f%02d")
    if averaged is not None:
        outputs += compose_and_write(averaged, phrases, EMBEDDING_COMPOSERS, out_dir, f"w2v-avg{repeats}",
                                     dim_pattern="f%02d")
    return outputs


def glove_pipeline(spark: SparkSession, sentences: DataFrame, phrases: DataFrame, out_dir: str,
                   dim: int = 100, sweeps: int = 10, window: int = 10, min_count: int = 5,
                   stages=("vectors", "compose")) -> list[str]:
    """Co-occurrence -> I4 -> C7 -> E16."""
    st = Stages(spark, out_dir, stages)
    vocab = counting.vocabulary(sentences, min_count).select(F.col("token").alias("entry"))
    cooc = (EM.distance_weighted_cooc(sentences, window).join(vocab, "entry", "left_semi")
            .join(vocab.withColumnRenamed("entry", "ctx"), "ctx", "left_semi"))
    seen = Observation("glove_junk_filter")

    def train():
        trained = EM.train_glove(cooc, dim, sweeps)[0].observe(seen, F.count(F.lit(1)).alias("before"),
                                                               F.count_if(embedding_junk_filter("entry"))
                                                               .alias("kept"))
        return trained.where(embedding_junk_filter("entry"))

    vecs = st("vectors", train, {"sentences": sentences}, dim=dim, sweeps=sweeps, window=window, min_count=min_count)
    if "vectors" in st.built:
        log.info("C7 kept %s", seen.get)   # before/after counts of the junk filter
    if not st.wants("compose"):
        return []
    return compose_and_write(vecs, phrases, EMBEDDING_COMPOSERS, out_dir, "glove")


def third_party_pipeline(spark: SparkSession, embeddings: DataFrame, phrases: DataFrame, out_dir: str,
                         lemma_dictionary: DataFrame | None = None, stages=("clean_unigrams", "compose")) -> list[str]:
    """I13 = C8 -> B10 -> G2 -> H5 -> B11 on ``(row_id, surface, vec)``, then E16."""
    st = Stages(spark, out_dir, stages)
    kept = cleaning.canonical_surfaces(embeddings.select("surface", "row_id"), lemma_dictionary)
    vecs = cleaning.keep_surfaces(embeddings.select("surface", "vec"), kept) \
        .join(kept.select("lemma", "row_id"), "lemma")
    inputs = {"embeddings": embeddings} | ({} if lemma_dictionary is None else {"lemmas": lemma_dictionary})
    expanded = st("clean_unigrams", lambda: cleaning.pos_expand(vecs), inputs)
    if not st.wants("compose"):
        return []
    return compose_and_write(expanded.select("entry", "vec"), phrases, EMBEDDING_COMPOSERS, out_dir, "turian")


def categorical_pipeline(spark: SparkSession, svo: DataFrame, nouns: DataFrame, out_dir: str,
                         dim: int) -> DataFrame:
    """P5: F4 -> S5, then E12-E14 over the SVO phrases."""
    tensor_path = os.path.join(out_dir, "verb_tensors")
    write_tensors(TS.train_verb_tensors(svo, nouns, dim=dim), tensor_path)
    tensors = TS.tensor_to_dense(TS.load_tensors(spark, tensor_path).drop("verb_bucket"), dim)
    out = TS.compose_categorical(svo, nouns, tensors, dim)
    out.write.mode("overwrite").partitionBy("composer").parquet(os.path.join(out_dir, "composed"))
    return spark.read.parquet(os.path.join(out_dir, "composed"))


def regression_pipeline(spark: SparkSession, vectors: DataFrame, phrases: DataFrame, out_dir: str,
                        dim: int, lam: float = RG.DEFAULT_LAMBDA, stages=("baroni", "guevara", "multistep", "compose")) -> dict:
    """I6/I7/I8 (S4) -> E9/E10/E11."""
    st, made = Stages(spark, out_dir, stages), {"vectors": table_digest(vectors)}
    baroni = st("baroni", lambda: RG.train_baroni(vectors, dim, lam), made, dim=dim, lam=lam)
    guevara = st("guevara", lambda: RG.train_guevara(vectors, dim, lam), made, dim=dim, lam=lam)
    v_model = st("multistep", lambda: RG.train_multistep(vectors, dim, lam)[1], made, dim=dim, lam=lam)
    if not st.wants("compose"):
        return {}
    p = lambda s: os.path.join(out_dir, s)
    outs = {"Baroni": RG.compose_baroni(phrases, vectors, baroni, dim),
            "Guevara": RG.compose_guevara(phrases, vectors, guevara, dim),
            "Multistep": RG.compose_multistep(phrases, vectors, v_model, dim)}
    for name, df in outs.items():
        df.write.mode("overwrite").parquet(p(f"composed_{name}"))
    return {name: spark.read.parquet(p(f"composed_{name}")) for name in outs}


def random_pipeline(phrases: DataFrame, out_dir: str, dim: int = 100) -> str:
    """A9 (unigrams included) -> I10."""
    path = os.path.join(out_dir, "random_vectors")
    NB.random_vectors(phrases.select(F.col("phrase").alias("entry")), dim).write.mode("overwrite").parquet(path)
    dense_features(phrases.sparkSession, dim, "rand%d").write.mode("overwrite").parquet(path + ".features")
    return path


def feature_selection_pipeline(docfeat: DataFrame, labels: DataFrame, vectors: DataFrame | None = None,
                               k="all", must_be_in_thesaurus: bool = False, min_log_odds: float = 0.0,
                               n_neighbours: int = 10):
    """J1-J7, then J8 neighbours of the selected vocabulary (when vectors
    are given).  Returns ``(selected, projected_docs, neighbours)``."""
    entries = vectors.select("entry") if vectors is not None else None
    selected = SEL.select_features(docfeat, labels, k, must_be_in_thesaurus, entries, min_log_odds)
    docs = SEL.transform_docs(docfeat, selected)
    neigh = None
    if vectors is not None:
        vocab_vecs = vectors.join(selected.select(F.col("feature").alias("entry")), "entry", "left_semi")
        neigh = NB.knn_exact(vectors, k=n_neighbours, queries=vocab_vecs)
    return selected, docs, neigh

