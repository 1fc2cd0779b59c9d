"""Registered queries of sources and sinks: each writes a table that Spark derives from the
driver tables, reads it back by the library's reader and returns all that came back.
And the whole composed space (E15)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexivec.functions.features import feature_type
from lexivec.operators import compose as C
from lexivec.operators import counting
from lexivec.operators import tensors as TS
from lexivec.operators.indexing import global_index, materialize
from lexivec.plans import catalog as Q
from lexivec.sinks import writers as W
from lexivec.sources import corpus as CP
from lexivec.sources import tables as T
from lexivec.sources import vectors as SV


def _lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.lexicon(T.read_table(spark, sf_dir, "embeddings"))


def compose_all_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E15 with Add: unigrams and composed phrases as rows of one matrix, with their ids."""
    emb = T.read_table(spark, sf_dir, "embeddings")
    uni = T.lexicon(emb).select("entry", F.col("vec_id").alias("row_id"), "vec")
    made = C.compose_all(uni, T.phrases(emb), C.ADD)
    return made.select("entry", "row_id", F.posexplode("vec").alias("dim", "value")) \
        .select("entry", "row_id", F.col("dim").cast("long").alias("dim"), F.round("value", Q.ROUND).alias("value"))


def dense_store_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S2 -> A6: the lexicon as a dense store."""
    path = Q._scratch(spark, "dense")
    W.write_dense(_lexicon(spark, sf_dir).select("entry", "vec"), path)
    return Q.long_vectors(SV.read_dense(spark, f"{path}/vectors"), key="entry")


def embedding_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings as a third-party table of surface forms."""
    table = SV.read_embedding_table(spark, T.table_path(sf_dir, "embeddings"))
    rows = table.select(F.col("vec_id").alias("row_id"), F.concat(F.lit("w"), F.col("vec_id")).alias("surface"),
                        F.col("embedding").cast("array<double>").alias("vec"))
    return rows.select("row_id", "surface", F.posexplode("vec").alias("dim", "value")) \
        .select("row_id", "surface", F.col("dim").cast("long").alias("dim"), F.round("value", Q.ROUND).alias("value"))


def triples_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3: the PPMI space as triples of row id, column id and weight, named again by its two indexes."""
    weights = Q.ppmi_space(spark, sf_dir)
    path = Q._scratch(spark, "triples")
    W.write_triples(weights, global_index(weights.select("entry").distinct(), ["entry"], col="row_id"),
                    global_index(weights.select("feature").distinct(), ["feature"], col="col_id"), path)
    triples, rows, cols = (spark.read.parquet(f"{path}/{part}") for part in ("triples", "rows", "cols"))
    return triples.join(rows, "row_id").join(cols, "col_id") \
        .select("row_id", "col_id", "entry", "feature", F.round("weight", Q.ROUND).alias("value"))


def phrase_list_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases and words as lines, repeated ones among them; the distinct phrases."""
    emb = T.read_table(spark, sf_dir, "embeddings")
    path = Q._scratch(spark, "phrases")
    lines = T.phrases(emb).select("phrase").unionByName(T.lexicon(emb).select(F.col("entry").alias("phrase")))
    lines.unionByName(lines).write.text(path)
    return SV.read_phrase_list(spark, path, include_unigrams=False)


def svo_list_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10: phrases of all types as lines; the set of SVOs, in parts."""
    emb = T.read_table(spark, sf_dir, "embeddings")
    svo = T.svo_triples(T.read_table(spark, sf_dir, "lineitem"), emb.count())
    path = Q._scratch(spark, "svo")
    svo.select("phrase").unionByName(T.phrases(emb).select("phrase")).write.text(path)
    return SV.read_svo_list(spark, path)


def _sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.sentences(T.read_corpus(spark, sf_dir))


def sentence_files_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4: tagged sentences as gzipped files; tokens of the sentences kept, with their counts."""
    path = Q._scratch(spark, "sentences")
    _sentences(spark, sf_dir).select(F.array_join("toks", " ").alias("value")).write.option("compression", "gzip").text(path)
    toks = CP.read_sentence_files(spark, path).select(F.explode("toks").alias("token"))
    return toks.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def instances_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2 -> F1: sentences as instances, the first token with the others as its features, counted."""
    path = Q._scratch(spark, "instances")
    _sentences(spark, sf_dir).select(F.array_join("toks", "\t").alias("value")).write.text(path)
    return counting.count_events(counting.instance_pairs(CP.read_instances(spark, path)))


def line_aligned_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three line-aligned folders of the lexicon; verbs are emitted as unknown and go."""
    path = Q._scratch(spark, "aligned")
    lex = materialize(_lexicon(spark, sf_dir).repartitionByRange("vec_id").sortWithinPartitions("vec_id"))
    emitted = F.when(F.col("entry").endswith("/V"), F.lit("*UNKNOWN*")).otherwise(F.col("entry"))
    csv = F.array_join(F.transform("vec", lambda x: x.cast("string")), ",")
    for name, value in (("phrases", F.col("entry")), ("emitted", emitted), ("vectors", csv)):
        lex.select(value.alias("value")).write.text(f"{path}/{name}")
    back = SV.read_line_aligned(spark, f"{path}/phrases", f"{path}/emitted", f"{path}/vectors")
    return Q.long_vectors(back)


def model_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S4 -> A11, D9: coefficient rows with the digest of their columns, checked when read."""
    lex = _lexicon(spark, sf_dir)
    dims = lex.select(F.max(F.size("vec"))).first()[0] or 0
    columns = spark.range(dims).select(F.col("id").alias("col_id"), F.format_string("f%02d", "id").alias("feature"))
    path = Q._scratch(spark, "model")
    W.write_model(lex.select(F.col("entry").alias("modifier"), F.col("vec").alias("coef")), path, columns)
    back = SV.read_model(spark, path, columns)
    return Q.long_vectors(back.select(F.col("modifier").alias("entry"), F.col("coef").alias("vec")), key="entry")


def tensor_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S5 -> A12: the verb matrices of the lineitem triples."""
    lex, svo = Q._tensor_inputs(spark, sf_dir)
    path = Q._scratch(spark, "tensors")
    W.write_tensors(TS.train_verb_tensors(svo, lex, dim=Q.TENSOR_DIMS, distinct=True), path)
    t = TS.load_tensors(spark, path)
    return t.select("verb", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.round("weight", Q.ROUND).alias("weight"))


def cluster_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J1-J6 by clusters: the 2,000 best document features that are in a cluster index (here
    the tagged words that open a sentence)."""
    docfeat, lab = Q.labelled_docfeat(spark, sf_dir)
    clusters = _sentences(spark, sf_dir).select(F.get("toks", 0).alias("entry")).distinct()
    out = Q.SEL.select_features(docfeat, lab, k=2000, must_be_in_thesaurus=True, clusters=clusters)
    return out.select("feature", "col_id", F.round("score", Q.ROUND).alias("score"))


def run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the counts that runs report, one row a name: store size, phrases by type that Add can
    compose, modifiers, verbs, rows kept by the sentence filter, features that survive the frequency filter."""
    emb = T.read_table(spark, sf_dir, "embeddings")
    lex, phrases = T.lexicon(emb), T.phrases(emb).select("phrase").distinct()
    able = materialize(C.contains(phrases, lex, C.ADD).select("phrase"))
    svo = T.svo_triples(T.read_table(spark, sf_dir, "lineitem"), emb.count())
    raw = materialize(Q.cooc_raw(spark, sf_dir))
    one = lambda name, df, count: df.agg(count.cast("long").alias("n")).select(F.lit(name).alias("name"), "n")
    every, first = F.count(F.lit(1)), F.get(F.split("phrase", "_"), 0)
    noun_phrase = feature_type("phrase").isin("AN", "NN")
    parts = [one("unigrams", lex, every), one("phrases", phrases, every), one("composable", able, every),
             one("modifiers", able.where(noun_phrase), F.count_distinct(first)), one("verbs", svo, F.count_distinct("verb")),
             one("sentences", _sentences(spark, sf_dir), every),
             one("sentences kept", _sentences(spark, sf_dir), F.count_if(F.size("toks") > CP.MIN_SENTENCE_TOKENS)),
             one("features", raw, F.count_distinct("feature")),
             one("features kept", counting.frequency_filter(raw), F.count_distinct("feature"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


QUERIES = {f.__name__: f for f in (
    compose_all_matrix, dense_store_round_trip, embedding_table, triples_round_trip, phrase_list_round_trip, svo_list_round_trip,
    sentence_files_round_trip, instances_round_trip, line_aligned_round_trip, model_round_trip, tensor_round_trip, cluster_presence,
    run_report)}
