"""Registered queries: each takes ``(spark, sf_dir)`` and returns a DataFrame.

Every query reads its driver tables in full, documents of all languages
included (see ``sources/tables.py`` for the derived views).
Doubles are rounded to 6 digits at the boundary so the oracle comparison is
insensitive to summation order.
"""

from __future__ import annotations

import uuid
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexivec.functions import features as FT
from lexivec.functions import vectors as V
from lexivec.operators import cleaning as CL
from lexivec.operators import compose as C
from lexivec.operators import counting
from lexivec.operators import embeddings as EM
from lexivec.operators import neighbours as NB
from lexivec.operators import reduction as RD
from lexivec.operators import regression as RG
from lexivec.operators import selection as SEL
from lexivec.operators import tensors as TS
from lexivec.operators.indexing import materialize
from lexivec.session import ensure_checkpoint_dir
from lexivec.sinks.stages import shared_stage
from lexivec.sinks.writers import write_sparse_tsv
from lexivec.sources import tables as T
from lexivec.sources.vectors import read_glove_text, read_vectors_tsv

ROUND = 6


def _r(c):
    """``round`` by its own rule (half up on the shortest decimals).  Nearly all values are too far
    from the middle of two steps for the rule to matter and don't take the detour by decimals."""
    x = F.col(c) if isinstance(c, str) else c
    steps = x * F.lit(10.0 ** ROUND)
    plain = (F.abs(x) < 10.0 ** ROUND) & (F.abs(steps - F.rint(steps)) < 0.499)
    # no negative zero
    return F.when(plain, (F.rint(steps) + F.lit(0.0)) / F.lit(10.0 ** ROUND)).otherwise(F.round(x, ROUND))


# ---- counting ----------------------------------------------------------------

def cooc_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    sent = T.sentences(T.read_corpus(spark, sf_dir), tagged=False)
    return counting.count_events(counting.window_pairs(sent, window=2, token_fn=T.tag_by_length, mirrored=False))


def cooc_filtered(spark, sf_dir, min_ff=counting.MIN_FEATURE_FREQ, min_ef=counting.MIN_EVENT_FREQ):
    """Counted and filtered events, materialised once (stage output, S6)."""
    return materialize(counting.frequency_filter(cooc_raw(spark, sf_dir), min_ff, min_ef))


def cooc_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F2 -> F1 -> C11, marginals recomputed after filtering."""
    m = counting.with_marginals(cooc_filtered(spark, sf_dir), materialize_input=False)
    return m.select("entry", "feature", "n", "entry_total", "feature_total")


def ppmi_top_contexts(spark: SparkSession, sf_dir: str, k: int = 10,
                      min_ff=counting.MIN_FEATURE_FREQ, min_ef=counting.MIN_EVENT_FREQ) -> DataFrame:
    """F3 then top-k contexts per word (the flagship query)."""
    w = counting.ppmi(cooc_filtered(spark, sf_dir, min_ff, min_ef), materialize_input=False)
    top = counting.top_features(w, k)
    return top.select("entry", "feature", "rank", _r("weight").alias("ppmi"))


def corpus_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentence corpus of all documents: whitespace tokens, malformed ones
    dropped (C5), lowercased and tagged, sentences with more than 8 tokens (C6)."""
    from lexivec.sources.corpus import sentences_from_text
    docs = T.read_corpus(spark, sf_dir)
    return sentences_from_text(docs.select("doc_id", F.col("source").alias("file"), "text"))


def vocab_mincount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C5 -> C6 -> C12."""
    return counting.vocabulary(corpus_sentences(spark, sf_dir), min_count=50) \
        .select("token", "n")


def type_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1 on the raw co-occurrence counts."""
    return counting.type_quota(cooc_raw(spark, sf_dir))


# ---- composition ---------------------------------------------------------------

def _emb(spark, sf_dir):
    return T.read_table(spark, sf_dir, "embeddings")


def long_vectors(df: DataFrame, key: str = "phrase") -> DataFrame:
    """``(key, vec)`` -> ``(key, dim, value)`` rounded for comparison."""
    return df.select(key, F.posexplode("vec").alias("dim", "value")) \
        .select(key, F.col("dim").cast("long").alias("dim"), _r("value").alias("value"))


def _compose_query(composer):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        emb = _emb(spark, sf_dir)
        out = C.compose_dense(T.phrases(emb), T.lexicon(emb), [composer])
        return long_vectors(out)
    run.__name__ = f"compose_{composer.name.lower()}"
    run.__doc__ = f"{composer.name} composition of the phrase list over the embedding lexicon."
    return run


def compose_sparse_mult(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E3 on sparse PPMI rows: observed adjacent word pairs whose words both
    have a row; a phrase whose product is all zeros is kept as a NULL cell."""
    counts = cooc_filtered(spark, sf_dir)
    weights = materialize(counting.ppmi(counts, materialize_input=False))
    entries = counts.select("entry").distinct()
    sent = T.sentences(T.read_corpus(spark, sf_dir), tagged=False).where(F.size("toks") >= 2)
    n = F.size("toks")
    pairs = F.arrays_zip(F.slice("toks", 1, n - 1).alias("a"), F.slice("toks", 2, n - 1).alias("b"))
    bigrams = (sent.select(F.explode(pairs).alias("z"))
               .select(F.concat_ws("_", T.tag_by_length("z.a"), T.tag_by_length("z.b")).alias("phrase"))
               .distinct())
    ok = materialize(C.contains(bigrams, entries, C.MULT))
    return C.multiply_all_rows(ok, weights).select("phrase", "feature", _r("weight").alias("value"))


SPACE_PARAMS = {"min_ff": counting.MIN_FEATURE_FREQ, "min_ef": counting.MIN_EVENT_FREQ}


def ppmi_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PPMI cells, a stage that the sparse composers and stores share."""
    return shared_stage(spark, "ppmi", [T.table_path(sf_dir, "documents")], SPACE_PARAMS,
                        lambda: counting.ppmi(cooc_filtered(spark, sf_dir), materialize_input=False).where("weight > 0"))


def sparse_space(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """PPMI cells and the composable word pairs seen ``MIN_EVENT_FREQ`` times or more whose
    words both have a row; two stages that the sparse composers share."""
    files, params = [T.table_path(sf_dir, "documents")], SPACE_PARAMS
    weights = ppmi_space(spark, sf_dir)

    def pairs():
        sent = T.sentences(T.read_corpus(spark, sf_dir), tagged=False).where(F.size("toks") >= 2)
        n = F.size("toks")
        both = F.arrays_zip(F.slice("toks", 1, n - 1).alias("a"), F.slice("toks", 2, n - 1).alias("b"))
        seen = sent.select(F.explode(both).alias("z")).select("z.a", "z.b").groupBy("a", "b").count().where(F.col("count") >= counting.MIN_EVENT_FREQ)
        # written first: else the rule's test of a phrase's type runs on every pair before it is counted
        named = materialize(seen).select(F.concat_ws("_", T.tag_by_length("a"), T.tag_by_length("b")).alias("phrase"))
        return C.contains(named, weights.select("entry").distinct(), C.ADD)

    return weights, shared_stage(spark, "frequent-pairs", files, params, pairs)


def _long_query(c: C.Composer):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        weights, pairs = sparse_space(spark, sf_dir)
        return C.compose_long(pairs, weights, [c]).select("phrase", "feature", _r("weight").alias("value"))
    run.__name__ = f"compose_long_{c.name.lower()}"
    run.__doc__ = f"{c.name} over sparse PPMI rows of frequent word pairs: its non-zero cells."
    return run


def compose_pick_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Left and Right over sparse PPMI rows of frequent word pairs, as counts and sums per phrase."""
    weights, pairs = sparse_space(spark, sf_dir)
    left, right = (C.pick_long(pairs, weights, c).groupBy("composer", "phrase")
                   .agg(F.count(F.lit(1)).alias("n_features"), _r(F.sum("weight")).alias("total")) for c in (C.LEFT, C.RIGHT))
    return left.unionByName(right)


def _scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared ``spark.checkpoint.dir``."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/files/{name}-{uuid.uuid4().hex}"


def sparse_tsv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1 -> A1: the PPMI space written as gzipped TSV lines and read back."""
    weights = ppmi_space(spark, sf_dir)
    path = _scratch(spark, "tsv")
    write_sparse_tsv(weights, weights.select("entry").distinct(), path)
    back = read_vectors_tsv(spark, path, lowercasing=False)
    return back.weights.select("entry", "feature", _r("weight").alias("value"))


def glove_text_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: the lexicon as GloVe text, read back."""
    path = _scratch(spark, "glove")
    lex = T.lexicon(_emb(spark, sf_dir))
    values = F.array_join(F.transform(V.as_double("vec"), lambda x: x.cast("string")), " ")
    lex.select(F.concat_ws(" ", "entry", values).alias("value")).write.text(path)
    return long_vectors(read_glove_text(spark, path), key="entry")


GUEVARA_RULE = C.Composer("Guevara", "elementwise", "add", ("AN", "NN"))


def compose_all_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E15 with Add: unigram rows keep their ids, composable phrases follow in
    input order."""
    emb = _emb(spark, sf_dir)
    lex = T.lexicon(emb)
    uni = lex.select("entry", F.col("vec_id").alias("row_id"))
    return C.compose_all_index(uni, T.phrases(emb), lex, C.ADD)


def compose_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F9 for every simple composer and the Guevara rule."""
    emb = _emb(spark, sf_dir)
    return C.coverage(T.phrases(emb), T.lexicon(emb), C.ALL_SIMPLE + (GUEVARA_RULE,))


# ---- tensors ---------------------------------------------------------------------

TENSOR_DIMS = 64


def _tensor_inputs(spark, sf_dir):
    emb = _emb(spark, sf_dir)
    lex = T.lexicon(emb).select("entry", "vec")
    # written once: the training and the composition count and deal the triples
    svo = materialize(T.svo_triples(T.read_table(spark, sf_dir, "lineitem"), emb.count()).select("subj", "verb", "obj"))
    return lex, svo


def verb_tensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F4 + C13 + D4 on the lineitem triples."""
    lex, svo = _tensor_inputs(spark, sf_dir)
    t = TS.train_verb_tensors(svo, lex, dim=TENSOR_DIMS, distinct=True)
    return t.select("verb", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"),
                    _r("weight").alias("weight"))


def _categorical_query(name):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        lex, svo = _tensor_inputs(spark, sf_dir)
        dense = TS.tensor_to_dense(TS.train_verb_tensors(svo, lex, dim=TENSOR_DIMS, distinct=True), TENSOR_DIMS)
        out = TS.compose_categorical(svo, lex, dense, TENSOR_DIMS, [name])
        return long_vectors(out)
    run.__doc__ = f"{name} composition of the lineitem SVOs with the trained verb matrices."
    return run


# ---- neighbours and baselines -------------------------------------------------------

def knn_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """10 nearest neighbours (Euclidean, self excluded) of every lexicon entry."""
    lex = T.lexicon(_emb(spark, sf_dir))
    return NB.knn_exact(lex, k=10).select("entry", "rank", "neighbour", _r("distance").alias("distance"))


def knn_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approximate neighbours from the nearest cells (checked against G6 for recall in tests)."""
    lex = T.lexicon(_emb(spark, sf_dir))
    return NB.knn_lsh(lex, k=10).select("entry", "rank", "neighbour", _r("distance").alias("distance"))


def knn_lsh_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G7 held against the vectors: lists of k, exact distances, ranks in order, per tag."""
    lex = T.lexicon(_emb(spark, sf_dir))
    side = lambda c: lex.select(F.col("entry").alias(c), V.as_double("vec").alias(f"{c}_vec"))
    near = NB.knn_lsh(lex, k=10).join(side("entry"), "entry").join(side("neighbour"), "neighbour")
    squares = F.aggregate(F.zip_with("entry_vec", "neighbour_vec", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, b: a + b)
    lists = near.groupBy("entry").agg(
        F.countDistinct("neighbour").alias("n"), F.count_if(F.abs(F.sqrt(squares) - F.col("distance")) <= 1e-9).alias("exact"),
        F.max("rank").alias("last"))
    return lists.groupBy(F.substring_index("entry", "/", -1).alias("tag")).agg(
        F.count(F.lit(1)).alias("entries"), F.sum("n").alias("neighbours"), F.sum("exact").alias("exact"), F.max("last").alias("last_rank"))


def labelled_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A9 stand-in: distinct tagged words of the labelled documents."""
    docs = T.read_corpus(spark, sf_dir).join(
        T.read_table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    return (T.tokens(docs).select(T.tag_by_length("token").alias("entry")).distinct())


def random_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I10 over the labelled vocabulary, 100 dimensions; one row per word, its
    values in millionths, joined by commas."""
    vecs = NB.random_vectors(labelled_vocabulary(spark, sf_dir), dim=100)
    digits = F.transform("vec", lambda x: F.floor(x * 1000000).cast("string"))
    return vecs.select("entry", F.array_join(digits, ",").alias("vec"))


def constant_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I11 for every lexicon entry."""
    return NB.constant_neighbours(T.lexicon(_emb(spark, sf_dir)).select("entry"))


def random_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """3 random distinct lexicon entries per entry, seed 0."""
    lex = T.lexicon(_emb(spark, sf_dir)).select("entry")
    return NB.random_neighbours(lex, lex, k=3, seed=0)


# ---- feature selection ----------------------------------------------------------------

def labelled_docfeat(spark: SparkSession, sf_dir: str):
    """``docfeat(doc_id, feature, weight)`` (tagged word counts) and
    ``labels(doc_id, y)`` of the labelled documents, all languages."""
    docs = T.read_corpus(spark, sf_dir)
    lab = T.labelled_docs(docs, T.read_table(spark, sf_dir, "labels"))
    toks = docs.join(lab.select("doc_id"), "doc_id", "left_semi") \
        .select("doc_id", F.explode(T.tokens_of("text")).alias("t"))
    docfeat = toks.groupBy("doc_id", T.tag_by_length("t").alias("feature")) \
        .agg(F.count(F.lit(1)).cast("double").alias("weight"))
    return materialize(docfeat), materialize(lab)


def chi2_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F7 against the quality label."""
    docfeat, lab = labelled_docfeat(spark, sf_dir)
    return SEL.chi2_scores(docfeat, lab).select("feature", _r("score").alias("score"))


def select_k_best(spark: SparkSession, sf_dir: str, k: int = 200) -> DataFrame:
    """The 200 best features by chi²."""
    docfeat, lab = labelled_docfeat(spark, sf_dir)
    scores = SEL.chi2_scores(docfeat, lab)
    return scores.join(SEL.k_best(scores, k), "feature", "left_semi") \
        .select("feature", _r("score").alias("score"))


def log_odds_band(spark: SparkSession, sf_dir: str, t: float = 1.0) -> DataFrame:
    """Features whose log odds fall outside ±1."""
    docfeat, lab = labelled_docfeat(spark, sf_dir)
    return SEL.log_odds(docfeat, lab).where(F.abs("log_odds") > t) \
        .select("feature", _r("log_odds").alias("log_odds"))


def vector_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document features that have a row in the PPMI space."""
    docfeat, _ = labelled_docfeat(spark, sf_dir)
    entries = cooc_filtered(spark, sf_dir).select("entry").distinct()
    return SEL.presence_mask(docfeat.select("feature").distinct(), entries)


def feature_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-best (2000) AND vector presence AND log-odds band (0.3),
    survivors re-indexed."""
    docfeat, lab = labelled_docfeat(spark, sf_dir)
    entries = cooc_filtered(spark, sf_dir).select("entry").distinct()
    out = SEL.select_features(docfeat, lab, k=2000, must_be_in_thesaurus=True,
                              vector_entries=entries, min_log_odds=0.3)
    return out.select("feature", "col_id", _r("score").alias("score"))


# ---- parsing, cleaning, repeats, sampling, unions, CoNLL ---------------------------------

def distinct_grams(sent: DataFrame, max_n: int) -> DataFrame:
    """The distinct 1- to ``max_n``-grams of sentences: a token with those that follow it, which are
    null beyond the end, then its n-grams.  No lambdas, so it is all compiled."""
    toks = F.col("toks")
    near = F.arrays_zip(*[F.slice(toks, k + 1, F.size(toks)).alias(f"t{k}") for k in range(max_n)])
    z = sent.select(F.explode(near).alias("z"))
    grams = [F.concat(*[x for k in range(n) for x in ([F.lit("_")] if k else []) + [F.col(f"z.t{k}")]]) for n in range(1, max_n + 1)]
    return z.select(F.explode(F.array(*grams)).alias("feature")).where("feature is not null").distinct()


def parse_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1-B5, C1, C4 on the distinct 1- to 4-grams of the documents."""
    sent = T.sentences(T.read_corpus(spark, sf_dir))
    feats = distinct_grams(sent, 4)
    typed = feats.select("feature", FT.feature_type("feature").alias("type"))
    return typed.select(
        "feature", "type",
        F.size(FT.split_tokens("feature")).cast("long").alias("n_tokens"),
        FT.strip_pos(FT.token_at("feature", 0)).alias("head"),
        FT.pos_of(FT.token_at("feature", -1)).alias("last_pos"),
        FT.default_row_filter("feature", "type").alias("is_row"),
        FT.type_in("feature", FT.NP_TYPES, kind="type").alias("is_np"))


def combine_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F6 + H3: two repeats (even / odd vec_id) of ``w<vec_id div 2>/N``, mean."""
    emb = _emb(spark, sf_dir)
    reps = emb.select((F.col("vec_id") % 2).alias("repeat"),
                      F.concat(F.lit("w"), F.expr("vec_id div 2").cast("string"), F.lit("/N")).alias("entry"),
                      F.transform("embedding", lambda x: x.cast("double")).alias("vec"))
    return long_vectors(CL.combine_repeats(reps, 2, "mean"), key="entry")


def _surfaces(spark, sf_dir):
    docs = T.read_corpus(spark, sf_dir)
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    raw = lines.select("doc_id", "line_no", F.posexplode(F.split("line", "[ \t]+")).alias("pos", "surface"))
    raw = raw.where((F.col("surface") != "") & ~FT.has_punct_or_digit("surface"))
    return raw.groupBy("surface").agg(F.min(F.struct("doc_id", "line_no", "pos")).alias("row_id"))


def _canonical(spark, sf_dir):
    surf = _surfaces(spark, sf_dir)
    return CL.canonical_surfaces(surf, CL.suffix_dictionary(surf, "surface"))


def surface_form_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C8 -> B10 -> G2 on the raw words of the documents."""
    return _canonical(spark, sf_dir).select("lemma", "surface")


def pos_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H5 -> B11: every kept lemma as /N, /J and /V, numbered block by block."""
    return CL.pos_expand(_canonical(spark, sf_dir)).select("entry", "row_id")


def sample_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C15 with ``source`` as the file: 30 percent of the files for repeats 0, 1, 2."""
    from lexivec.sources.corpus import sample_files as pick
    docs = T.read_corpus(spark, sf_dir).select(F.col("source").alias("file"), "doc_id")
    out = None
    for r in (0, 1, 2):
        chosen = pick(docs, 30, r).withColumn("repeat", F.lit(r).cast("long"))
        out = chosen if out is None else out.unionByName(chosen)
    n_docs = docs.groupBy("file").agg(F.count(F.lit(1)).alias("n_docs"))
    return out.join(n_docs, "file").select("repeat", "file", "pos", "n_docs")


def observed_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H4 + H2: unigram and observed bigram context rows in one store, C11 over
    the union; one row per entry."""
    sent = T.sentences(T.read_corpus(spark, sf_dir))
    uni = counting.count_events(counting.window_pairs(sent, 2, mirrored=False))
    big = counting.count_events(counting.ngram_window_pairs(sent, 2, 2))
    filt = materialize(counting.frequency_filter(uni.unionByName(big)))
    is_phrase = F.col("entry").contains("_")
    store = CL.observed_union(filt.where(~is_phrase), filt.where(is_phrase))
    return store.groupBy("entry").agg(
        F.count(F.lit(1)).alias("n_features"), F.sum("n").alias("total")) \
        .select("entry", F.when(F.col("entry").contains("_"), "phrase").otherwise("unigram").alias("kind"),
                "n_features", "total")


# Fixed values of the CoNLL rendering of conversations.
FINE_TAGS = ("NN", "VBZ", "JJ", "DT", "RB")


def conll_reformat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3 + B6: every conversation turn rendered as a CoNLL block (word, lemma,
    a Penn tag chosen by word length; words whose length is a multiple of 7 lose
    their tag column and are malformed), then parsed back."""
    from lexivec.sources.corpus import parse_conll_blocks
    conv = T.read_corpus(spark, sf_dir, "conversations")
    toks = T.tokens_of("text")
    tags = F.array(*[F.lit(t) for t in FINE_TAGS])
    lines = F.transform(toks, lambda t, i: F.when(
        F.length(t) % 7 == 0, F.concat_ws("\t", (i + 1).cast("string"), t, t)).otherwise(
        F.concat_ws("\t", (i + 1).cast("string"), t,
                    F.when(F.length(t) % 2 == 0, F.translate(t, ascii_lowercase, ascii_uppercase)).otherwise(t),
                    F.get(tags, F.length(t) % 5), F.lit("O"), F.lit("0"), F.lit("dep"))))
    blocks = conv.select("conv_id", "turn", F.array_join(lines, "\n").alias("block"))
    return parse_conll_blocks(blocks).select("conv_id", "turn", "sentence", "n_malformed")


# ---- reduction and regression composers -----------------------------------------------

SVD_DIMS = 100
#: Rank of the space that the regression composers train on.
REGRESSION_DIMS = 100


def svd_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1 quotas -> I5: the PPMI rows of the kept entries reduced to 100 dimensions."""
    counts = cooc_filtered(spark, sf_dir)
    kept = counting.type_quota(counts).select("entry")
    weights = counting.ppmi(counts.join(kept, "entry", "left_semi"))
    vecs, _, _ = RD.truncated_svd(weights, SVD_DIMS)
    return long_vectors(vecs, key="entry")


OBSERVED_MIN_FEATURE = 40
OBSERVED_MIN_EVENT = 3


def observed_space(spark: SparkSession, sf_dir: str, max_n: int = 3, k: int = REGRESSION_DIMS) -> DataFrame:
    """Unigram and observed 2-/3-gram context counts of the documents,
    filtered (C11) over the union, PPMI-weighted and reduced together (P1's
    ``svd`` stage with observed phrases): ``vectors(entry, vec)``.  A stage of its own:
    the queries that train on the space share it as long as the documents stay the same."""
    def build():
        sent = T.sentences(T.read_corpus(spark, sf_dir))
        pairs = counting.window_pairs(sent, 2)
        for n in range(2, max_n + 1):
            pairs = pairs.unionByName(counting.ngram_window_pairs(sent, n, 2))
        counts = counting.frequency_filter(counting.count_events(pairs), OBSERVED_MIN_FEATURE, OBSERVED_MIN_EVENT)
        return RD.truncated_svd(counting.ppmi(counts), k)[0]

    params = {"max_n": max_n, "k": k, "min_feature": OBSERVED_MIN_FEATURE, "min_event": OBSERVED_MIN_EVENT}
    return shared_stage(spark, "observed-space", [T.table_path(sf_dir, "documents")], params, build)


def _np_phrases(spark, sf_dir, n: int = 2):
    """Phrases of interest: the distinct n-grams of the labelled documents."""
    docs = T.read_corpus(spark, sf_dir).join(
        T.read_table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    sent = T.sentences(docs).where(F.size("toks") >= n)
    size = F.size("toks")
    grams = F.transform(F.sequence(F.lit(0), size - n), lambda i: F.array_join(F.slice("toks", i + 1, n), "_"))
    return sent.select(F.explode(grams).alias("phrase")).distinct()


def baroni_fit_compose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I6 -> E9: per-modifier matrices from observed AN/NN vectors, applied to
    the AN/NN bigrams of the labelled documents."""
    space = observed_space(spark, sf_dir)
    model = RG.train_baroni(space, REGRESSION_DIMS)
    return long_vectors(RG.compose_baroni(_np_phrases(spark, sf_dir), space, model, REGRESSION_DIMS))


def guevara_fit_compose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I7 -> E10: the global full-additive model, applied likewise."""
    space = observed_space(spark, sf_dir)
    model = RG.train_guevara(space, REGRESSION_DIMS)
    return long_vectors(RG.compose_guevara(_np_phrases(spark, sf_dir), space, model, REGRESSION_DIMS))


def multistep_fit_compose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I8 -> E11: VO functions from observed SVO vectors, verb functions from
    those, applied to the SVO trigrams of the labelled documents."""
    space = observed_space(spark, sf_dir)
    _, v_model = RG.train_multistep(space, REGRESSION_DIMS)
    return long_vectors(RG.compose_multistep(_np_phrases(spark, sf_dir, 3), space, v_model, REGRESSION_DIMS))


# ---- embedding training ------------------------------------------------------------

def word2vec_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I1 + I3 on the sentence corpus (C5, C6): min count 50, 100 dimensions, seed 0."""
    vecs = EM.train_word2vec(corpus_sentences(spark, sf_dir), dim=100, min_count=50, seed=0)
    return long_vectors(vecs, key="entry")


GLOVE_MIN_COUNT = 5


def glove_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I4 -> C7: distance-weighted co-occurrence (window 10) of words seen at
    least 5 times, 100-dimensional GloVe by ten sweeps of alternating least squares, junk filter."""
    sent = T.sentences(T.read_corpus(spark, sf_dir))
    vocab = counting.vocabulary(sent, GLOVE_MIN_COUNT).select(F.col("token").alias("entry"))
    cooc = (EM.distance_weighted_cooc(sent, window=10)
            .join(vocab, "entry", "left_semi")
            .join(vocab.withColumnRenamed("entry", "ctx"), "ctx", "left_semi"))
    vecs, _ = EM.train_glove(cooc)
    return long_vectors(vecs.where(FT.embedding_junk_filter("entry")), key="entry")


QUERIES = {
    "cooc_counts": cooc_counts,
    "ppmi_top_contexts": ppmi_top_contexts,
    "vocab_mincount": vocab_mincount,
    "type_quota": type_quota,
    **{f"compose_{c.name.lower()}": _compose_query(c) for c in C.ALL_SIMPLE},
    "compose_sparse_mult": compose_sparse_mult,
    **{f"compose_long_{c.name.lower()}": _long_query(c) for c in (C.ADD, C.AVG, C.MULT, C.MIN, C.MAX)},
    "compose_pick_long": compose_pick_long,
    "sparse_tsv_round_trip": sparse_tsv_round_trip,
    "glove_text_round_trip": glove_text_round_trip,
    "compose_all_index": compose_all_index,
    "compose_coverage": compose_coverage,
    "verb_tensors": verb_tensors,
    "copy_object": _categorical_query("CopyObj"),
    "frobenius_add": _categorical_query("FAdd"),
    "frobenius_mult": _categorical_query("FMult"),
    "knn_exact": knn_exact,
    "knn_lsh": knn_lsh,
    "knn_lsh_audit": knn_lsh_audit,
    "random_vectors": random_vectors,
    "constant_neighbours": constant_neighbours,
    "random_neighbours": random_neighbours,
    "chi2_scores": chi2_scores,
    "select_k_best": select_k_best,
    "log_odds_band": log_odds_band,
    "vector_presence": vector_presence,
    "feature_selection": feature_selection,
    "parse_features": parse_features,
    "combine_repeats": combine_repeats,
    "surface_form_pick": surface_form_pick,
    "pos_expand": pos_expand,
    "sample_files": sample_files,
    "observed_union": observed_union,
    "conll_reformat": conll_reformat,
    "svd_reduce": svd_reduce,
    "baroni_fit_compose": baroni_fit_compose,
    "guevara_fit_compose": guevara_fit_compose,
    "multistep_fit_compose": multistep_fit_compose,
    "word2vec_vectors": word2vec_vectors,
    "glove_vectors": glove_vectors,
}
