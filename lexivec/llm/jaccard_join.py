"""N-gram Jaccard join by several global token orders (operator 2).

Two sets of Jaccard similarity t or more share a token among the first
``n - ceil(t n) + 1`` of each, under *any* global order of the tokens.  So a pair is a
candidate only if its prefixes meet under every one of several orders:

* the first order is rarest-first, on a fixed share of the hash space (tokens
  beyond it follow, by hash); the inverted index is over these prefixes;
* pairs of a list are joined under an exact bound: each set keeps the parity of its
  tokens in a few hundred hash buckets, and the sets differ in at least as many tokens
  as these bits differ;
* further orders are hash orders with other seeds; their prefixes are carried as
  short arrays and intersected before any set is fetched.

What is left is verified on the whole shingle sets.

Equal sets are one class from the start, so copies are never expanded into pairs.  In
a few rounds each class is held against one member of the largest component of its
longest list of the index; what is linked by then needs no further check, and at last
all pairs of a list that are still in different components are looked at.  The
components are those of the full link graph: each candidate pair is either verified
or already connected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexivec.llm.common import mix, prepare, shingles, signed, staged
from lexivec.llm.components import connected_components

#: Seeds of the hash orders beside the rarest-first one.
ORDERS = (11, 23)
#: Share of the hash space ordered by frequency, as a multiple of 1 - t.
RARE_SPACE = 1.5
SPACE_BITS = 63
#: Rounds that hold each class against one other, before all that is left is checked.
ROUNDS = 2
#: 64-bit words of parity bits of a set; rows of a list that meet in one task.
PARITY_WORDS, LIST_ROWS = 8, 1024
#: Profiles that a task holds before it sends them on.
PROFILE_ROWS = 512


def prefix_length(n, num: int, den: int):
    """n - ceil(num n / den) + 1."""
    return n - -(-n * num // den) + 1


def profile(text: str | None, k: int, num: int, den: int):
    """(n, class digest, rare-space size, index tokens, parity bits, one prefix per order)."""
    s = shingles(text, k) >> np.uint64(1)
    s = np.unique(s)
    n = len(s)
    if not n:
        return 0, None, 0, None, None, None
    p = prefix_length(n, num, den)
    limit = np.uint64(int(min(1.0, RARE_SPACE * (den - num) / den) * (1 << SPACE_BITS)))
    rare = int(np.searchsorted(s, limit))
    with np.errstate(over="ignore"):
        digest = mix(np.array([mix(s).sum(dtype=np.uint64) ^ mix(s, 5).sum(dtype=np.uint64)], np.uint64), n)
    orders = [np.sort((mix(s, seed) >> np.uint64(32)).astype(np.uint32))[:p].view(np.int32) for seed in ORDERS]
    bits = np.bincount((mix(s, 3) % np.uint64(64 * PARITY_WORDS)).astype(np.int64), minlength=64 * PARITY_WORDS) & 1
    parity = np.packbits(bits.astype(bool)).view(np.int64)
    return n, int(digest.view(np.int64)[0]), rare, s[: max(rare, p)].view(np.int64), parity, orders


def _within(a: Column, b: Column, num: int, den: int) -> Column:
    """Length filter: the smaller set can reach the similarity."""
    return F.least(a, b) * den >= F.greatest(a, b) * num


def linked(docs: DataFrame, k: int, num: int, den: int, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``key, n_shingles, cls, component_id`` of each row: links join rows whose
    shingle sets have ``den * intersection >= num * union``; ``component_id`` is the
    smallest key that links lead to, the row's own included; ``cls`` is one value
    per distinct set.

    Null text, empty text and text without words have the empty set and no links:
    their ``component_id`` is their own key.  Rows of equal sets are linked.  Null keys
    never are a ``component_id`` unless all of a component are null.  Other columns are
    ignored; an empty table gives no rows."""
    spark = docs.sparkSession
    prepare(spark)
    source = docs.select(F.col(key).alias("key"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row"))

    def profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # classes whose tokens this task has sent
        longs, ints = pa.list_(pa.int64()), pa.list_(pa.int32())
        schema = pa.schema([("row", pa.int64()), ("n", pa.int64()), ("cls", pa.int64()), ("rare", pa.int64()),
                            ("index", longs), ("parity", longs), *((f"o{i}", ints) for i in range(len(ORDERS)))])
        for b in batches:
            for at in range(0, b.num_rows, PROFILE_ROWS):  # few texts and sets at once, whatever a batch holds
                part, out = b.slice(at, PROFILE_ROWS), []
                for row, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    n, cls, rare, index, parity, orders = profile(text, k, num, den)
                    first = cls is not None and cls not in seen
                    if first:
                        seen.add(cls)
                    out.append((row, n, cls, rare, *((index, parity, *orders) if first else (None,) * (2 + len(ORDERS)))))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    orders = ", ".join(f"o{i} array<int>" for i in range(len(ORDERS)))
    rows = staged(source.select("row", "text").mapInArrow(
        profiles, f"row long, n long, cls long, rare long, index array<long>, parity array<long>, {orders}"), "join-profiles")

    sent = rows.where("index is not null")
    limit = int(min(1.0, RARE_SPACE * (den - num) / den) * (1 << SPACE_BITS))
    # two numbers a cell; what belongs to the class joins once the single tokens are gone
    cells = sent.select("cls", F.explode("index").alias("token"))
    sizes = sent.groupBy("cls").agg(F.max("n").alias("n"), F.max("rare").alias("rare"))
    often = cells.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    # tokens of one class only cannot make a pair; they only use up places of a prefix
    shared = cells.join(often, "token").join(sizes, "cls").groupBy("cls", "token") \
        .agg(F.max("n").alias("n"), F.max("rare").alias("rare"), F.max("df").alias("df"))
    in_space = F.col("token") < F.lit(limit)
    by_class = Window.partitionBy("cls")
    places = F.col("n") - F.ceil(F.col("n") * num / F.lit(den)).cast("long") + 1
    ranked = shared.withColumn("alone", F.col("rare") - F.sum(in_space.cast("long")).over(by_class)) \
        .withColumn("rank", F.row_number().over(by_class.orderBy((~in_space).cast("int"), "df", "token"))) \
        .where(~in_space | (F.col("alone") + F.col("rank") <= places))
    lists = staged(ranked.select("token", "cls", "n"), "join-index")

    several = lists.groupBy("token").agg(F.count(F.lit(1)).alias("held")).where("held > 1")
    shared_lists = staged(lists.join(several, "token").drop("held"), "join-lists")
    # one row, its prefixes and its whole shingle set for each class that has a candidate at all
    busy = shared_lists.select("cls").distinct()
    facts = staged(sent.select("cls", F.struct("row", "parity", *(f"o{i}" for i in range(len(ORDERS)))).alias("f")).join(busy, "cls", "left_semi")
                   .groupBy("cls").agg(F.first("f").alias("f")), "join-facts")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for at in range(0, x.num_rows, 256):
                part = x.slice(at, 256)
                found = [signed(shingles(t, k)) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(pa.int64()))], names=["cls", "s"])

    held = staged(source.select("row", "text").join(facts.select("cls", F.col("f.row").alias("row")), "row")
                  .select("cls", "text").mapInArrow(sets, "cls long, s array<long>"), "join-sets")

    def verify(pairs: DataFrame, name: str) -> DataFrame:
        """Of pairs ``a, b`` of classes those that are linked."""
        side = lambda c: facts.select(F.col("cls").alias(c), F.col("f").alias(f"f{c}"))
        meet = F.lit(True)
        for i in range(len(ORDERS)):
            meet = meet & F.arrays_overlap(F.col(f"fa.o{i}"), F.col(f"fb.o{i}"))
        pairs = staged(pairs.join(side("a"), "a").join(side("b"), "b").where(meet).select("a", "b"), f"{name}-candidates")
        full = pairs.join(held.select(F.col("cls").alias("b"), F.col("s").alias("sb")), "b") \
            .join(held.select(F.col("cls").alias("a"), F.col("s").alias("sa")), "a")
        both = F.size(F.array_intersect("sa", "sb"))
        return staged(full.where(den * both >= num * (F.size("sa") + F.size("sb") - both)).select("a", "b"), f"{name}-links")

    def open_lists(components: DataFrame | None) -> DataFrame:
        """Members of the lists that hold several components, with the largest one."""
        member = shared_lists.select("token", "cls", "n")
        member = member.withColumn("component", F.col("cls")) if components is None else \
            member.join(components.select(F.col("node").alias("cls"), "component"), "cls", "left") \
            .withColumn("component", F.coalesce("component", "cls"))
        parts = member.groupBy("token", "component").agg(F.count(F.lit(1)).alias("size"))
        largest = parts.groupBy("token").agg(F.max(F.struct("size", "component")).alias("top"), F.sum("size").alias("size"),
                                             F.count(F.lit(1)).alias("parts")) \
            .where("parts > 1").select("token", F.col("top.component").alias("top"), "size")
        return staged(member.join(largest, "token"), "join-open")

    links, tried, components = None, None, None
    ordered = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    for turn in range(ROUNDS):
        member = open_lists(components)
        hubs = member.where("component = top").groupBy("token") \
            .agg(F.min(F.struct(F.xxhash64("cls", F.lit(turn)), F.col("cls").alias("hub"), F.col("n").alias("hub_n"))).alias("h"))
        near = member.where("component != top").join(hubs, "token").where(_within(F.col("n"), F.col("h.hub_n"), num, den)) \
            .groupBy("cls").agg(F.max(F.struct("size", F.col("h.hub").alias("hub"))).alias("h"))
        pairs = near.select(*ordered(F.col("cls"), F.col("h.hub")))
        pairs = staged((pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti")).distinct(), "join-stars")
        if pairs.isEmpty():
            break
        found = verify(pairs, "join-round")
        tried = pairs if tried is None else tried.unionByName(pairs)
        links = found if links is None else links.unionByName(found)
        components = connected_components(links)

    # lists that still hold several components: all but the largest one meet the rest
    member = open_lists(components).join(facts.select("cls", F.col("f.parity").alias("p")), "cls") \
        .withColumn("blocks", F.ceil(F.col("size") / LIST_ROWS).cast("int"))
    # long lists are dealt out: one side by block, the other one to every block
    left = member.where("component != top").select("token", F.pmod(F.xxhash64("cls"), "blocks").cast("int").alias("block"), F.col("cls").alias("a"),
                                                   F.col("n").alias("na"), F.col("component").alias("ca"), F.col("p").alias("pa"))
    right = member.select("token", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("cls").alias("b"),
                          F.col("n").alias("nb"), F.col("component").alias("cb"), "top", F.col("p").alias("pb"))
    apart = sum((F.bit_count(F.get("pa", i).bitwiseXOR(F.get("pb", i))) for i in range(PARITY_WORDS)), F.lit(0))
    meet = (F.col("ca") != F.col("cb")) & ((F.col("cb") == F.col("top")) | (F.col("a") < F.col("b"))) \
        & _within(F.col("na"), F.col("nb"), num, den) & (apart * (den + num) <= (F.col("na") + F.col("nb")) * (den - num))
    same = (F.col("l.token") == F.col("r.token")) & (F.col("l.block") == F.col("r.block"))
    rest = left.alias("l").join(right.alias("r"), same & meet).select(*ordered("a", "b")).distinct()
    rest = rest if tried is None else rest.join(tried, ["a", "b"], "left_anti")
    last = verify(rest, "join-last")
    found = connected_components(last if links is None else links.unionByName(last))

    keyed = rows.select("row", "n", "cls").join(source.select("row", "key"), "row") \
        .join(found.select(F.col("node").alias("cls"), "component"), "cls", "left") \
        .withColumn("component", F.coalesce("component", "cls"))
    keyed = staged(keyed, "join-keyed")
    least = keyed.where("cls is not null").groupBy("component").agg(F.min("key").alias("component_id"))
    return keyed.join(least, "component", "left") \
        .select(F.col("key").alias(key), F.col("n").alias("n_shingles"), "cls",
                F.when(F.col("cls").isNull(), F.col("key")).otherwise(F.col("component_id")).alias("component_id"))
