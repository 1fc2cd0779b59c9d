"""Token ids as raw binary shards with a minimal-perfect-hash index (operator 5).

A shard is two files in the shared folder:

``*.ids``  the ids of its documents, back to back, little-endian unsigned 16 or
           32 bit (16 where the vocabulary allows);
``*.mph``  a minimal perfect hash over the document keys: each level is a bit
           field in which a key owns a bit if no other key of that level hashes to
           it, colliding keys go on to the next level, and the rank of a key's bit
           is its slot.  Each slot has a 32-bit fingerprint of the key, the
           document's offset in the payload and its number of ids.

A lookup hashes the key, ranks one bit, compares the fingerprint and reads one
range of the payload: constant time, without scanning.  The keys are also listed
in document order, so that a shard can be walked.

Documents are range-partitioned by key; a task streams its range into one shard,
so no task holds more than a batch of ids and its own index.  Files carry a fresh
name per task attempt and only the attempt that Spark commits is in the manifest.
"""

from __future__ import annotations

import io
import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexivec.llm import tokens
from lexivec.llm.common import mix, partitions, prepare, shared_path, staged

MANIFEST = "shard int, base_path string, n_docs long, n_tokens long"
ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long"
#: Bits per remaining key in a level of the hash.
GAMMA = 2.0


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def key_of(doc_id, ordinal: int) -> bytes:
    """Key of a row: its id, and how many rows of that id stand before it."""
    return b"%s#%d" % (b"null" if doc_id is None else str(int(doc_id)).encode(), ordinal)


class PerfectHash:
    """A minimal perfect hash over distinct byte keys, with fingerprints."""

    def __init__(self, seed: int, sizes: list[int], bits: np.ndarray, fingerprints: np.ndarray):
        self.seed, self.sizes, self.fingerprints = seed, sizes, fingerprints
        self.first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.bits = bits
        self.rank = np.concatenate([[0], np.cumsum(bits)]).astype(np.int64)

    @staticmethod
    def _hashes(keys: list[bytes], seed: int) -> np.ndarray:
        return np.fromiter((xxhash.xxh3_64_intdigest(k, seed=seed) for k in keys), np.uint64, len(keys))

    @classmethod
    def build(cls, keys: list[bytes]) -> "PerfectHash":
        for seed in range(16):
            h = cls._hashes(keys, seed)
            if len(np.unique(h)) < len(h):
                continue  # two keys with one 64-bit hash: take another seed
            left, sizes, fields = h, [], []
            while len(left):
                size = max(8, int(GAMMA * len(left)))
                at = (mix(left, len(sizes) + 1) % np.uint64(size)).astype(np.int64)
                alone = np.bincount(at, minlength=size) == 1
                sizes.append(size)
                fields.append(alone)
                left = left[~alone[at]]
            bits = np.concatenate(fields) if fields else np.zeros(0, bool)
            out = cls(seed, sizes, bits, np.zeros(len(keys), np.uint32))
            out.fingerprints[out._slots(h)] = cls._prints(keys)
            return out
        raise ValueError("keys are not distinct")

    @staticmethod
    def _prints(keys: list[bytes]) -> np.ndarray:
        return np.fromiter((xxhash.xxh32_intdigest(k) for k in keys), np.uint32, len(keys))

    def _slots(self, h: np.ndarray) -> np.ndarray:
        slots, open_ = np.full(len(h), -1, np.int64), np.arange(len(h))
        for level, size in enumerate(self.sizes):
            at = self.first[level] + (mix(h[open_], level + 1) % np.uint64(size)).astype(np.int64)
            hit = self.bits[at]
            slots[open_[hit]] = self.rank[at[hit]]
            open_ = open_[~hit]
        return slots

    def lookup(self, keys: list[bytes]) -> np.ndarray:
        """Slot of each key, -1 for a key whose fingerprint differs."""
        slots = self._slots(self._hashes(keys, self.seed))
        if not len(self.fingerprints):
            return slots
        good = (slots >= 0) & (self.fingerprints[slots] == self._prints(keys))
        return np.where(good, slots, -1)


class Shard:
    """An open shard: index in memory, payload read by range."""

    def __init__(self, base_path: str):
        self.fs, self.path = filesystem(base_path)
        with self.fs.open_input_stream(self.path + ".mph") as f:
            z = np.load(io.BytesIO(f.read()))
        meta = json.loads(bytes(z["meta"]).decode())
        self.width = np.dtype(meta["dtype"])
        n = len(z["offset"])
        self.hash = PerfectHash(meta["seed"], meta["sizes"], np.unpackbits(z["bits"], count=int(sum(meta["sizes"]))).astype(bool), z["prints"])
        self.offset, self.length = z["offset"], z["length"]
        self.ids, self.null = z["ids"], np.unpackbits(z["null"], count=n).astype(bool)

    def keys(self) -> Iterator[tuple[int | None, bytes]]:
        """Ids and keys in document order."""
        last, ordinal = object(), 0
        for i, null in zip(self.ids.tolist(), self.null.tolist()):
            doc_id = None if null else i
            ordinal = ordinal + 1 if doc_id == last else 0
            last = doc_id
            yield doc_id, key_of(doc_id, ordinal)

    def get(self, f, slot: int) -> np.ndarray:
        """Ids of the document in a slot, from the open payload ``f``."""
        f.seek(int(self.offset[slot]) * self.width.itemsize)
        return np.frombuffer(f.read(int(self.length[slot]) * self.width.itemsize), self.width)

    def payload(self):
        return self.fs.open_input_file(self.path + ".ids")

    def read(self, doc_id, ordinal: int = 0) -> np.ndarray | None:
        """Ids stored under a key; None if the shard has no such key."""
        slot = self.hash.lookup([key_of(doc_id, ordinal)])[0]
        if slot < 0:
            return None
        with self.payload() as f:
            return self.get(f, slot).astype("<u4")


def write_shards(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = 1, n_shards: int | None = None,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode ``docs`` into shards below ``path``, in ascending id order; the
    manifest: one row per shard with its files, documents and ids.

    Null text is empty (only the end id); a null id sorts first.  Rows with equal
    ids keep their own entries, ordered by text.  Other columns are ignored; an
    empty table makes no shard."""
    spark = docs.sparkSession
    prepare(spark)
    n = n_shards or partitions(spark)
    scheme_path = path

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = tokens.encoder(tokenizer_path)
        width = np.dtype("<u2" if max(enc.tok.get_vocab_size(), end_id + 1) <= 65536 else "<u4")
        fs, root = filesystem(scheme_path)
        out, name, shard = None, "", -1
        ids_of, nulls, lengths, keys = [], [], [], []
        last, ordinal, total = object(), 0, 0
        for b in batches:
            if not len(b):
                continue
            if out is None:
                shard = int(b["_shard"].iloc[0])
                fs.create_dir(root, recursive=True)
                name = f"/shard-{shard:06d}-{uuid.uuid4().hex}"
                out = fs.open_output_stream(root + name + ".ids")
            for raw, ids in zip(b["doc_id"].tolist(), enc.encode(b["text"].tolist())):
                doc_id = None if raw is None else int(raw)
                ordinal = ordinal + 1 if doc_id == last else 0
                last = doc_id
                out.write(np.append(ids, np.uint32(end_id)).astype(width).tobytes())
                ids_of.append(doc_id or 0)
                nulls.append(doc_id is None)
                lengths.append(len(ids) + 1)
                keys.append(key_of(doc_id, ordinal))
        if out is None:
            return
        out.close()
        length = np.array(lengths, np.int64)
        ph = PerfectHash.build(keys)
        slots = ph.lookup(keys)
        offset, by_slot = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        offset[slots], by_slot[slots] = np.cumsum(length) - length, length
        meta = json.dumps({"seed": ph.seed, "sizes": ph.sizes, "dtype": width.str}).encode()
        buffer = io.BytesIO()
        np.savez(buffer, meta=np.frombuffer(meta, np.uint8), bits=np.packbits(ph.bits), prints=ph.fingerprints, offset=offset,
                 length=by_slot, ids=np.array(ids_of, np.int64), null=np.packbits(np.array(nulls, bool)))
        with fs.open_output_stream(root + name + ".mph") as f:
            f.write(buffer.getvalue())
        yield pd.DataFrame({"shard": [shard], "base_path": [scheme_path + name], "n_docs": [len(keys)],
                            "n_tokens": [int(length.sum())]})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ranged = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text") \
        .select(F.col("doc_id").cast("string").alias("doc_id"), "text", F.spark_partition_id().alias("_shard"))
    return staged(ranged.mapInPandas(write, MANIFEST), "token-manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """Every document of the shards, fetched by its key through the index:
    ``doc_id, start, n_tokens, ids_crc32``; ``start`` counts the ids of all
    documents before it."""
    spark = manifest.sparkSession
    # one small row per shard
    based = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(
        Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for base_path, base in zip(b["base_path"], b["base"]):
                shard = Shard(base_path)
                doc_ids, keys = zip(*shard.keys())
                slots = shard.hash.lookup(list(keys))
                if (slots < 0).any():
                    raise ValueError(f"{base_path}: a key is missing from its index")
                with shard.payload() as f:
                    crc = [zlib.crc32(shard.get(f, s).astype("<u4").tobytes()) for s in slots.tolist()]
                yield pd.DataFrame({"doc_id": pd.array(doc_ids, "Int64"), "start": int(base) + shard.offset[slots],
                                    "n_tokens": shard.length[slots], "ids_crc32": np.array(crc, np.int64)})

    return based.select("shard", "base_path", "base").repartition(partitions(spark), "shard").mapInPandas(read, ROWS)


def encode_and_read(docs: DataFrame, tokenizer_path: str, path: str | None = None, end_id: int = 1) -> DataFrame:
    """Write the shards and return what reading them back gives."""
    path = path or shared_path(docs.sparkSession, "token-files")
    return read_shards(write_shards(docs, tokenizer_path, path, end_id))
