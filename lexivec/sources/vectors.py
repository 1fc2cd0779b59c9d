"""Vector-store readers (A1, A5, A6, A7, A8, A9, A10, A11, A12) and the store
model (§1): a sparse store is three tables — ``weights(entry, feature,
weight)``, ``entries(entry, row_id)``, ``features(feature, col_id)`` — and a
dense store is ``vectors(entry, vec ARRAY<DOUBLE>)`` plus ``features``.

``entries`` is a real table: a row whose cells are all zero (or absent) is
still a row.  Columns are global and sorted (G4).
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexivec.functions.features import feature_type, smart_lower
from lexivec.operators.indexing import global_index, materialize


@dataclass
class SparseVectors:
    weights: DataFrame
    entries: DataFrame
    features: DataFrame

    def get_vector(self, keys: DataFrame) -> DataFrame:
        """``keys(entry)`` -> ``(entry, feature, weight)``; an unknown entry
        comes back with NULL feature/weight (left join)."""
        return keys.select("entry").join(self.weights, "entry", "left")

    def to_dense(self) -> DataFrame:
        """``(entry, row_id, vec)`` with every column filled (absent = 0)."""
        n = self.features.count()
        cells = self.weights.join(self.features, "feature")
        m = cells.groupBy("entry").agg(F.map_from_entries(F.collect_list(F.struct("col_id", "weight"))).alias("m"))
        dense = F.transform(F.sequence(F.lit(0), F.lit(n - 1)),
                            lambda i: F.coalesce(F.element_at(F.col("m"), i.cast("long")), F.lit(0.0)))
        zeros = F.array_repeat(F.lit(0.0), n)
        return (self.entries.join(m, "entry", "left")
                .select("entry", "row_id", F.when(F.col("m").isNull(), zeros).otherwise(dense).alias("vec")))


def build_store(cells: DataFrame) -> SparseVectors:
    """From ``(entry, feature, weight)`` cells (feature may be NULL for an entry
    with no cells): sum repeated cells, index entries and features by sort order."""
    weights = (cells.where(F.col("feature").isNotNull())
               .groupBy("entry", "feature").agg(F.sum("weight").alias("weight")))
    entries = global_index(cells.select("entry").distinct(), ["entry"], col="row_id")
    features = global_index(weights.select("feature").distinct(), ["feature"], col="col_id")
    return SparseVectors(weights, entries, features)


def parse_vector_lines(lines: DataFrame, value_col: str = "value", lowercasing: bool = True,
                       enforce_pos: bool = True, row_filter=None) -> DataFrame:
    """A1 parsing: ``entry<TAB>feature<TAB>weight...`` (ragged, trailing tab
    allowed) -> cells ``(entry, feature, weight)``; entries without cells keep
    one row with NULL feature."""
    cells = F.split(F.col(value_col), "\t")
    rest = F.slice(cells, 2, F.greatest(F.size(cells) - 1, F.lit(0)))
    # one pass over a line's cells: looked up by number, each would split the line again
    pairs = F.arrays_zip(F.filter(rest, lambda c, i: i % 2 == 0).alias("feature"), F.filter(rest, lambda c, i: i % 2 == 1).alias("weight"))
    pairs = F.filter(pairs, lambda p: (p["feature"] != "") & p["weight"].isNotNull())
    entry = F.get(cells, 0)
    if lowercasing:
        entry = smart_lower(entry)
    rows = lines.where(F.trim(F.col(value_col)) != "").select(entry.alias("entry"), pairs.alias("pairs"))
    if enforce_pos:
        rows = rows.where(feature_type("entry") != "EMPTY")
    if row_filter is not None:
        rows = rows.where(row_filter(F.col("entry")))
    return rows.select("entry", F.explode_outer("pairs").alias("p")).select("entry", "p.feature", F.col("p.weight").cast("double").alias("weight"))


def read_vectors_tsv(spark: SparkSession, path: str, row_filter=None, lowercasing: bool = True,
                     enforce_word_entry_pos_format: bool = True) -> SparseVectors:
    """A1: sparse vectors from (optionally gzipped) TSV files."""
    cells = parse_vector_lines(spark.read.text(path), lowercasing=lowercasing,
                               enforce_pos=enforce_word_entry_pos_format, row_filter=row_filter)
    return build_store(cells)


def read_glove_text(spark: SparkSession, path: str) -> DataFrame:
    """A5: ``token v1 ... vd`` per line, space separated, no header."""
    parts = F.split(F.trim("value"), " ")
    return (spark.read.text(path).where(F.trim("value") != "")
            .select(F.get(parts, 0).alias("entry"),
                    F.transform(F.slice(parts, 2, F.size(parts) - 1), lambda x: x.cast("double")).alias("vec")))


def read_dense(spark: SparkSession, path: str) -> DataFrame:
    """A dense store written by ``sinks.write_dense``."""
    return spark.read.parquet(path)


def numbered_lines(spark: SparkSession, path: str, name: str) -> DataFrame:
    """``(file_no, line_no, name)`` of the lines of a file or folder: files in the order of
    their names, lines from 0.  A file is read in splits by many tasks; the lines before a
    split are the sum of the counts of the splits before it (one row a split)."""
    rows = materialize(spark.read.text(path).select(
        F.col("value").alias(name), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"),
        F.monotonically_increasing_id().alias("id")))
    splits = rows.groupBy("file", "at").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # files without lines keep their place: the list is the folder's, one small row a file
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"))
    files = files.select("file", F.row_number().over(Window.orderBy("file")).alias("file_no"))
    places = splits.select("file", "at", "first", before.alias("before")).join(files, "file")
    return rows.join(places, ["file", "at"]).select("file_no", (F.col("id") - F.col("first") + F.col("before")).alias("line_no"), name)


def read_line_aligned(spark: SparkSession, phrases_path: str, emitted_path: str, vectors_path: str,
                      width: int | None = None) -> DataFrame:
    """A7 + D11 + C9: three files, or folders of as many files, aligned by file (in
    the order of their names) and line number — phrases as given, phrases as
    emitted, comma-separated vectors.  Rows whose emitted phrase holds
    ``*UNKNOWN*`` are dropped.  The line counts of each file must agree."""
    a, b, c = (numbered_lines(spark, path, name) for path, name in
               ((phrases_path, "phrase"), (emitted_path, "emitted"), (vectors_path, "csv")))
    counts = None
    for x, name in ((a, "phrases"), (b, "emitted"), (c, "vectors")):
        n = x.groupBy("file_no").agg(F.count(F.lit(1)).alias(name))
        counts = n if counts is None else counts.join(n, "file_no", "full")
    odd = counts.where(~(F.col("phrases").eqNullSafe(F.col("emitted")) & F.col("phrases").eqNullSafe(F.col("vectors")))).first()
    if odd is not None:
        raise AssertionError(f"the files do not have the same lines: {odd.asDict()}")
    at = ["file_no", "line_no"]
    j = a.join(b, at).join(c, at).where(~F.col("emitted").contains("*UNKNOWN*"))
    vec = F.transform(F.split("csv", ","), lambda x: F.trim(x).cast("double"))
    out = j.select("line_no", "phrase", vec.alias("vec"))
    if width is not None:
        out = out.where(F.size("vec") == width)
    return out


def read_embedding_table(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """``(row_id, surface, vec)`` third-party embeddings (the .mat codec is not built)."""
    return spark.read.format(fmt).load(path)


def read_phrase_list(spark: SparkSession, path: str, include_unigrams: bool = True) -> DataFrame:
    """One document feature per line -> distinct ``phrase``."""
    ph = spark.read.text(path).select(F.trim("value").alias("phrase")).where(F.col("phrase") != "")
    if not include_unigrams:
        ph = ph.where(feature_type("phrase") != "1-GRAM")
    return ph.distinct()


def read_svo_list(spark: SparkSession, path: str) -> DataFrame:
    """A10: keep the SVO features, split into parts, as a set."""
    ph = spark.read.text(path).select(F.trim("value").alias("phrase")).where(feature_type("phrase") == "SVO")
    parts = F.split("phrase", "_")
    return ph.select(F.get(parts, 0).alias("subj"), F.get(parts, 1).alias("verb"),
                     F.get(parts, 2).alias("obj"), "phrase").dropDuplicates()


def columns_digest(features: DataFrame) -> str:
    """Digest of an ordered column dictionary ``(col_id, feature)``."""
    row = features.select(F.xxhash64(F.col("col_id").cast("long"), "feature").alias("h")) \
        .agg(F.count(F.lit(1)), F.bit_xor("h"), F.sum(F.col("h").cast("decimal(20,0)"))).first()
    return hashlib.sha256("|".join(map(str, row)).encode()).hexdigest()


def check_columns(model: DataFrame, features: DataFrame | None) -> DataFrame:
    """D9 on every load and compose: a model that carries the digest of its columns
    (``space``) is only applied to a space with the same ones, in the same order."""
    if features is not None and "space" in model.columns:
        made = [r["space"] for r in model.select("space").distinct().limit(2).collect()]
        if made and made != [columns_digest(features)]:
            raise AssertionError("the model was trained on other columns, or in another order, than this space has")
    return model


def read_model(spark: SparkSession, path: str, features: DataFrame | None = None) -> DataFrame:
    """Trained composition coefficients, checked against the space's columns."""
    return check_columns(spark.read.parquet(path), features)
