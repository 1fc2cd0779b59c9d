"""Writers (S1-S5; S6 is in ``stages.py``).  Every writer is a DataFrame write; no rows pass through
the driver."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivec.functions.features import SPARSE_OUTPUT_TYPES, feature_type
from lexivec.sources.vectors import columns_digest


def write_sparse_tsv(weights: DataFrame, entries: DataFrame, path: str, entry_filter=None,
                     row_transform=None, gzipped: bool = True,
                     types=SPARSE_OUTPUT_TYPES) -> None:
    """One line per entry, ``entry<TAB>feature<TAB>weight...`` with features
    in sorted order; ``entry_filter``/``row_transform`` are Column functions.
    The sparse output keeps only the ``types`` rows (Q-8)."""
    rows = entries.select("entry")
    if types:
        rows = rows.where(feature_type("entry").isin(*types))
    if entry_filter is not None:
        rows = rows.where(entry_filter(F.col("entry")))
    name = row_transform(F.col("entry")) if row_transform is not None else F.col("entry")
    cells = weights.join(rows, "entry", "right").select(
        "entry", name.alias("name"), "feature", F.concat_ws("\t", "feature", F.col("weight").cast("string")).alias("cell"))
    # an entry's cells arrive in order and are joined as they come, no list of them is made
    lines = cells.repartitionByRange("entry").sortWithinPartitions("entry", "feature").select("entry", "name", "cell").mapInArrow(_lines, "value string")
    w = lines.write.mode("overwrite")
    if gzipped:
        w = w.option("compression", "gzip")
    w.text(path)


#: Characters of finished lines that a writing task holds.
LINE_BUFFER = 4 << 20


def _lines(batches):
    """Text lines from sorted ``entry, name, cell`` rows; an empty cell is an entry without cells."""
    entry, parts, done, size = None, [], [], 0
    for b in batches:
        for e, name, cell in zip(*(c.to_pylist() for c in b.columns)):
            if e != entry or not parts:
                if parts:
                    done.append("\t".join(parts))
                    size += len(done[-1])
                    if size > LINE_BUFFER:
                        yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], names=["value"])
                        done, size = [], 0
                entry, parts = e, [name]
            if cell:
                parts.append(cell)
    if parts:
        done.append("\t".join(parts))
    if done:
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], names=["value"])


def write_dense(vectors: DataFrame, path: str, features: DataFrame | None = None) -> None:
    """``vectors(entry, vec)`` (+ the named columns) as parquet."""
    vectors.write.mode("overwrite").parquet(f"{path}/vectors")
    if features is not None:
        features.write.mode("overwrite").parquet(f"{path}/features")


def write_triples(weights: DataFrame, entries: DataFrame, features: DataFrame, path: str,
                  row_transform=None) -> None:
    """S3: matrix triples by id, plus the row and column indexes."""
    ents = entries if row_transform is None else entries.withColumn("entry", row_transform(F.col("entry")))
    (weights.join(entries, "entry").join(features, "feature")
     .select("row_id", "col_id", "weight").write.mode("overwrite").parquet(f"{path}/triples"))
    ents.write.mode("overwrite").parquet(f"{path}/rows")
    features.write.mode("overwrite").parquet(f"{path}/cols")


def write_model(model: DataFrame, path: str, features: DataFrame | None = None) -> None:
    """S4; with ``features`` (the ordered columns of the space that the model was trained
    on) the rows carry their digest, which is checked when the model is used (D9)."""
    if features is not None:
        model = model.withColumn("space", F.lit(columns_digest(features)))
    model.write.mode("overwrite").parquet(path)


def write_tensors(tensor: DataFrame, path: str, buckets: int = 64) -> None:
    """Verb matrices, zstd, partitioned by a hash bucket of the full
    ``verb/V`` key (Q-9 ruling: the tag is kept)."""
    (tensor.withColumn("verb_bucket", F.pmod(F.xxhash64("verb"), F.lit(buckets)))
     .write.mode("overwrite").option("compression", "zstd").partitionBy("verb_bucket").parquet(path))
