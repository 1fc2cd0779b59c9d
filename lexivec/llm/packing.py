"""Lexical retrieval packing (operator 1).

Every document's ids, with an end id, are cut into full windows and a tail.  Full
windows are sequences of their own.  Tails go to *shards* of bounded size; each
shard builds a BM25 inverted index over its tails' token ids.  The longest unused
tail is the seed of a window, the index returns its unused neighbours by score, and
they fill the window greedily: first those that fit whole, then the best remaining
one is cut to the room that is left and its rest stays unused.  So only the last
window of a shard can have padding.

Shards: a tail has ``HASHES`` weighted minimum hashes of its distinct ids; an id is
drawn in proportion to its IDF over all tails, so an id that most tails hold is
practically never drawn, and two tails agree in a hash with about the share of IDF that
they have in common.  Tails are sorted by these hashes (range partitions) and shards are
runs of about ``shard_rows`` rows: tails that agree in the first hash are together, those
of an id with more rows than a shard by the second hash, and so on.  The row ends the
order, so a text that a third of all rows share runs through many shards.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivec.llm import tokens
from lexivec.llm.common import mix, partitions, prepare, staged

WINDOW = 2048
#: Rows that a shard has about, and the hashes that tails are sorted by.
SHARD_ROWS, HASHES = 512, 4
#: Documents, characters and ids that a task holds at once while it cuts.
STEP_DOCS, STEP_CHARS, STEP_IDS = 2048, 3_000_000, 1_000_000
#: Units in each generation of its encoder's memo.
MEMO_UNITS = 60_000
#: Kinds of staged rows: full window, tail, and the document counts of a task's ids.
FULL, TAIL, SEEN = 0, 1, 2
K1, B = 1.2, 0.75


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def cut(docs: DataFrame, tokenizer_path: str, end_id: int, window: int) -> DataFrame:
    """Full windows and tails of all documents, with ids; and per task a row with the
    number of tails that hold each id (``ids``: pairs of id and number)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = tokens.encoder(tokenizer_path, MEMO_UNITS)
        seen = np.zeros(0, np.int64)
        for b in batches:
            out, held = [], 0
            texts, doc_ids, rows = b["text"].tolist(), b["doc_id"].tolist(), b["row"].tolist()
            for s in range(0, len(texts), STEP_DOCS):
                e = s + STEP_DOCS
                for doc_id, row, ids in zip(doc_ids[s:e], rows[s:e], enc.encode(texts[s:e], STEP_CHARS)):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    n = len(ids)
                    for start in range(0, n, window):
                        part = ids[start: start + window]
                        kind = FULL if len(part) == window else TAIL
                        if kind == TAIL:
                            distinct = np.unique(part)
                            if distinct[-1] >= len(seen):
                                seen = np.append(seen, np.zeros(int(distinct[-1]) + 1 - len(seen), np.int64))
                            seen[distinct] += 1
                        out.append((doc_id, row, start, len(part), _crc(part), n, part.tobytes(), kind))
                        held += len(part)
                if held > STEP_IDS:
                    yield _pieces(out)
                    out, held = [], 0
            yield _pieces(out)
        at = np.flatnonzero(seen)
        yield _pieces([(None, 0, 0, 0, 0, 0, np.stack([at, seen[at]], 1).astype("<i8").tobytes(), SEEN)])

    numbered = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), F.col("text").alias("text"),
                           F.monotonically_increasing_id().alias("row"))
    return numbered.mapInPandas(run, "doc_id string, row long, start long, length long, ids_crc32 long, doc_tokens long, "
                                     "ids binary, kind int")


def _pieces(rows: list) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["doc_id", "row", "start", "length", "ids_crc32", "doc_tokens", "ids", "kind"])


def document_counts(pieces: DataFrame) -> np.ndarray:
    """Number of tails that hold each id; as many numbers as the vocabulary has come to the driver."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for x in b["ids"]:
                yield pd.DataFrame(np.frombuffer(x, "<i8").reshape(-1, 2), columns=["id", "n"])

    found = pieces.where(F.col("kind") == SEEN).select("ids").mapInPandas(run, "id long, n long") \
        .groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(int(found["id"].max()) + 1 if len(found) else 1, np.int64)
    df[found["id"].to_numpy(int)] = found["n"].to_numpy(int)
    return df


def draws(df: np.ndarray, n: int) -> np.ndarray:
    """For each hash the place of every id in a random order weighted by IDF: of a set of
    ids the first one is drawn with its share of the set's IDF (exponential races)."""
    idf = np.log1p((n - df + 0.5) / (df + 0.5))
    out = np.empty((HASHES, len(df)), np.int32)
    for k in range(HASHES):
        u = ((mix(np.arange(len(df), dtype=np.uint64), k + 1) >> np.uint64(11)).astype(float) + 0.5) / 2.0 ** 53
        out[k, np.argsort(-np.log(u) / idf, kind="stable")] = np.arange(len(df), dtype=np.int32)
    return out


def signatures(ids: list[np.ndarray], order: np.ndarray) -> np.ndarray:
    """The drawn ids (by their places) of each tail, one row per hash."""
    first = np.cumsum([0] + [len(x) for x in ids[:-1]])
    flat = np.concatenate(ids)
    return np.stack([np.minimum.reduceat(o[flat], first) for o in order])


class Index:
    """A BM25 inverted index over the distinct token ids of a shard's tails."""

    def __init__(self, ids: list[np.ndarray]):
        n = len(ids)
        length = np.array([len(x) for x in ids])
        doc = np.repeat(np.arange(n), length)
        pair, tf = np.unique(doc * (1 << 32) + np.concatenate(ids).astype(np.int64), return_counts=True)
        doc, term = pair >> 32, pair & 0xFFFFFFFF
        self.first_of_doc = np.searchsorted(doc, np.arange(n + 1))
        vocabulary, self.term = np.unique(term, return_inverse=True)
        df = np.bincount(self.term, minlength=len(vocabulary))
        self.idf = np.log1p((n - df + 0.5) / (df + 0.5))
        self.df, self.n = df, n
        weight = self.idf[self.term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[doc] / length.mean()))
        order = np.argsort(self.term, kind="stable")
        self.posting_doc, self.posting_weight = doc[order], weight[order]
        self.first = np.concatenate([[0], np.cumsum(df)])

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of all tails for all terms of the seed."""
        terms = self.term[self.first_of_doc[seed]: self.first_of_doc[seed + 1]]
        terms = terms[self.df[terms] > 1]
        n = self.df[terms]
        if not n.sum():
            return np.zeros(self.n)
        at = np.repeat(self.first[terms] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.bincount(self.posting_doc[at], self.posting_weight[at], self.n)


def pack_tails(ids: list[np.ndarray], window: int) -> Iterator[tuple[int, int, int, int, int]]:
    """Windows over one shard: (window number, offset in it, tail, from, length)
    for each piece; every id of every tail is in exactly one piece."""
    index = Index(ids)
    begin = np.zeros(len(ids), np.int64)
    left = np.array([len(x) for x in ids])
    number = 0
    while left.max(initial=0) > 0:
        seed = int(np.argmax(left))
        offset = int(left[seed])
        yield number, 0, seed, int(begin[seed]), offset
        left[seed] = 0
        score = index.scores(seed)
        near = np.argsort(-score, kind="stable")
        near = near[(score[near] > 0) & (left[near] > 0)]
        at = 0
        while offset < window:
            fits = np.flatnonzero(left[near[at:]] <= window - offset)
            if not len(fits):
                break
            at += int(fits[0])
            t = int(near[at])
            yield number, offset, t, int(begin[t]), int(left[t])
            offset += int(left[t])
            left[t] = 0
            at += 1
        while offset < window and left.max(initial=0) > 0:
            # the room goes to the best neighbour that is left, else to the longest tail
            rest = near[left[near] > 0]
            t = int(rest[0]) if len(rest) else int(np.argmax(left))
            take = min(window - offset, int(left[t]))
            yield number, offset, t, int(begin[t]), take
            begin[t] += take
            left[t] -= take
            offset += take
        number += 1


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 1, window: int = WINDOW, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Pieces of all documents packed into sequences of at most ``window`` ids:
    ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids``
    (``ids``: little-endian unsigned 32-bit).

    Null text is empty; every document has at least its end id.  Rows with equal or
    null ids are packed one by one.  Other columns are ignored.  An empty table
    gives no rows."""
    spark = docs.sparkSession
    prepare(spark)
    pieces = staged(cut(docs, tokenizer_path, end_id, window), "packing-pieces")
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    full = pieces.where(F.col("kind") == FULL).select(
        *columns, (F.lit(1 << 62) + F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), "ids")
    tails = pieces.where(F.col("kind") == TAIL)
    n = tails.count()
    order = spark.sparkContext.broadcast(draws(document_counts(pieces), n))  # HASHES numbers for each id of the vocabulary
    keys = [f"h{k}" for k in range(HASHES)]

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                found = signatures([np.frombuffer(x, "<u4") for x in b["ids"]], order.value)
                yield b.assign(**dict(zip(keys, found)))

    kept = "row long, doc_id string, start long, doc_tokens long, ids binary"
    signed = tails.select("row", "doc_id", "start", "doc_tokens", "ids") \
        .mapInPandas(sign, kept + "".join(f", {k} int" for k in keys))
    ranges = max(1, min(partitions(spark), n // shard_rows))
    ranged = signed.repartitionByRange(ranges, *keys, "row").sortWithinPartitions(*keys, "row")

    def windows(rows: pd.DataFrame, base: int) -> tuple[pd.DataFrame, int]:
        ids = [np.frombuffer(x, "<u4") for x in rows["ids"]]
        doc_ids, starts, totals = rows["doc_id"].tolist(), rows["start"].tolist(), rows["doc_tokens"].tolist()
        out, number = [], -1
        for number, offset, t, begin, length in pack_tails(ids, window):
            part = ids[t][begin: begin + length]
            out.append((doc_ids[t], starts[t] + begin, length, _crc(part), totals[t], base + number, offset, part.tobytes()))
        return pd.DataFrame(out, columns=[*columns, "sequence_id", "offset", "ids"]), base + number + 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base, held = TaskContext.get().partitionId() << 40, None
        for b in batches:
            held = b if held is None else pd.concat([held, b], ignore_index=True)
            while 2 * len(held) >= 3 * shard_rows:  # the last shard of a range has up to half as many rows more
                out, base = windows(held.iloc[:shard_rows], base)
                held = held.iloc[shard_rows:]
                yield out
        if held is not None and len(held):
            yield windows(held, base)[0]

    packed = ranged.select("doc_id", "start", "doc_tokens", "ids") \
        .mapInPandas(run, "doc_id string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
                          "offset long, ids binary")
    return full.unionByName(packed).withColumn("doc_id", F.col("doc_id").cast("long"))
