"""Prefix trie of rebuilt conversations by composable fingerprints (operator 11).

Conversation ``c`` is rebuilt from the head of its base conversation and its own
turns after as many.  The rebuilt texts are never made: a sequence of turns has the
fingerprint ``sum(t_i * base**i) mod P`` in four lanes, which form a monoid
(appending a run of turns to ``m`` others shifts its product by ``base**m``), so a
rebuilt prefix's fingerprint is the base head's product combined with a difference of
two products of the own conversation.  Products come from one sorted pass over the
turns (:mod:`lexivec.llm.scan`), where a conversation of any length spans many tasks.

Prefixes of one depth with one fingerprint form a node.  Equality is verified, not
assumed: each row keeps a reference to its last turn (a 128-bit digest), all members
of a node must have the same, and no two different turns may share one.  Equal
fingerprints with equal last turns leave equal fingerprints one turn before, so the
nodes are exact by induction.  A collision restarts the job with other hashes.

Sums over subtrees need no walk down the levels.  The smallest member stands for a
node and all its nodes lie on its own path, so a subtree's sum is that of its members'
totals, less what its first member has above the node.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivec.llm.common import prepare, staged
from lexivec.llm.scan import P, running_sums

#: Conversations share the head of the first of FAMILY ids, of crc32 % HEADS turns.
FAMILY, HEADS = 5, 9
#: Members' ids are joined in blocks of 2**BLOCK neighbouring ids before a node is hashed.
BLOCK = 12
LANES = ["a", "b", "c", "d"]
NODE = ["depth", "f1", "f2"]
NOTHING = hashlib.sha256(b"").hexdigest()


def _bases(seed: int) -> dict[str, int]:
    return {c: int.from_bytes(hashlib.sha256(f"{c}{seed}".encode()).digest()[:8], "big") % (P - 1000) + 500 for c in LANES}


def _packed(lanes: list, name: str) -> list:
    """Four lanes as two longs."""
    return [(F.shiftleft(lanes[0], 31) + lanes[1]).alias(f"{name}1"), (F.shiftleft(lanes[2], 31) + lanes[3]).alias(f"{name}2")]


def _turns(conversations: DataFrame, seed: int) -> DataFrame:
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", text("role").alias("role"), text("text").alias("text"))
    digest = lambda i: F.xxhash64(F.lit(seed), F.lit(i), "role", "text")
    return rows.withColumns({"t1": digest(1), "t2": digest(2), "n_bytes": F.octet_length("text").cast("long")})


def _members(turns: DataFrame, seed: int) -> DataFrame:
    """One row per rebuilt conversation and depth, from 0: the node's fingerprint, that
    of its parent, the last turn's reference and bytes, and whether the conversation ends there."""
    bases = _bases(seed)
    low = lambda c: F.col(c).bitwiseAND(F.lit(0x7FFFFFFF))
    high = lambda c: F.shiftrightunsigned(F.col(c), 32).bitwiseAND(F.lit(0x7FFFFFFF))
    lanes = turns.withColumns({"a": low("t1"), "b": high("t1"), "c": low("t2"), "d": high("t2")})
    own = running_sums(lanes, "conv_id", ["turn", "role", "text"], bases, [], "trie-turns", drop=["turn", "role", "text"])
    first = F.struct("place", *(f"{c}_sum" for c in LANES), *LANES, "t1", "t2", "n_bytes")
    convs = staged(own.groupBy("conv_id").agg(
        (F.max("place") + 1).alias("n"),
        F.array_sort(F.collect_list(F.when(F.col("place") < HEADS - 1, first))).alias("head")), "trie-heads")  # eight at most
    h = F.crc32(F.col("conv_id").cast("string")) % HEADS
    base = convs.select(F.col("conv_id").alias("base"), F.col("head").alias("base_head"))
    plan = convs.withColumns({"h": h, "base": F.col("conv_id") - F.col("conv_id") % FAMILY}).join(base, "base", "left") \
        .withColumn("taken", F.least("h", F.coalesce(F.size("base_head"), F.lit(0))).cast("long")) \
        .withColumn("ends", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    at = lambda array, i, c: F.coalesce(F.get(F.col(array), i)[c], F.lit(0))
    plan = plan.withColumns({f"from_{c}": at("base_head", F.col("taken").cast("int") - 1, f"{c}_sum") for c in LANES}) \
        .withColumns({f"skip_{c}": at("head", F.col("h").cast("int") - 1, f"{c}_sum") for c in LANES})
    plan = staged(plan.drop("head"), "trie-plan")

    heads = plan.select("conv_id", "ends", F.explode(F.slice("base_head", 1, F.col("taken").cast("int"))).alias("x")) \
        .select("conv_id", "ends", "x.*").select(
            "conv_id", (F.col("place") + 1).alias("depth"),
            *_packed([F.col(f"{c}_sum") for c in LANES], "f"),
            *_packed([F.pmod(F.col(f"{c}_sum") - F.col(c), F.lit(P)) for c in LANES], "p"), "t1", "t2", "n_bytes",
            (F.col("place") + 1 == F.col("ends")).alias("last"))
    back = {c: F.array(*(F.lit(pow(pow(b, -1, P), i, P)) for i in range(HEADS))) for c, b in bases.items()}  # base**-i
    shift = {c: F.get(back[c], (F.col("h") - F.col("taken")).cast("int")) for c in LANES}
    product = {c: F.pmod(F.col(f"from_{c}") + shift[c] * F.pmod(F.col(f"{c}_sum") - F.col(f"skip_{c}"), F.lit(P)), F.lit(P)) for c in LANES}
    parent = {c: F.pmod(product[c] - shift[c] * F.col(c), F.lit(P)) for c in LANES}
    depth = F.col("taken") + F.col("place") - F.col("h") + 1
    tails = own.join(plan.where("n > h").select("conv_id", "h", "taken", "ends", *(f"{k}_{c}" for k in ("from", "skip") for c in LANES)),
                     "conv_id").where("place >= h").select(
        "conv_id", depth.alias("depth"), *_packed([product[c] for c in LANES], "f"), *_packed([parent[c] for c in LANES], "p"),
        "t1", "t2", "n_bytes", (depth == F.col("ends")).alias("last"))
    none = F.lit(0).cast("long")
    roots = plan.select("conv_id", none.alias("depth"), none.alias("f1"), none.alias("f2"), none.alias("p1"), none.alias("p2"),
                        none.alias("t1"), none.alias("t2"), none.alias("n_bytes"), (F.col("ends") == 0).alias("last"))
    return staged(heads.unionByName(tails).unionByName(roots), "trie-members")


def _digests(batches):
    """SHA-256 of the joined blocks of each node, from rows sorted by node and block."""
    node, sha, done = None, None, []

    def flush():
        cols = list(zip(*done))
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())],
                                          names=[*NODE, "ends_sha256"])

    for batch in batches:
        for depth, f1, f2, ids in zip(*(c.to_pylist() for c in batch.columns)):
            if (depth, f1, f2) != node:
                if node is not None:
                    done.append((*node, sha.hexdigest()))
                node, sha = (depth, f1, f2), hashlib.sha256(ids.encode())
            else:
                sha.update(b"," + ids.encode())
        if done:
            yield flush()
            done = []
    if node is not None:
        done.append((*node, sha.hexdigest()))
        yield flush()


def _ends(members: DataFrame) -> DataFrame:
    """Digest of the ids that end at each node; a node's ids meet as joined blocks, in order."""
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    blocks = members.where("last").groupBy(*NODE, F.shiftright("conv_id", BLOCK).alias("block")).agg(ids.alias("ids"))
    return blocks.repartition(*NODE).sortWithinPartitions(*NODE, "block").select(*NODE, "ids") \
        .mapInArrow(_digests, "depth long, f1 long, f2 long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, seed: int = 0) -> DataFrame:
    """One row per node of the trie of rebuilt conversations: ``conv_id`` (smallest
    member) and ``depth`` name it, then ``parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256`` and ``turn_ref1, turn_ref2``, the reference of its last
    turn (the root: null).

    Null role or text is empty; null turns come first, ties by role, then text; rows
    without ``conv_id`` belong to no conversation and are left out.  Repeated rows are
    turns of their own.  A conversation whose rebuilt form has no turn is a member of
    the root.  Other columns aren't read.  An empty table has no nodes."""
    prepare(conversations.sparkSession)
    while True:
        turns = _turns(conversations, seed)
        contents = turns.select("t1", "t2", "role", "text").distinct()
        clash = contents.groupBy("t1", "t2").count().where("count > 1")
        members = _members(turns, seed)
        nodes = staged(members.groupBy(*NODE).agg(
            F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"),
            *(F.min(c).alias(c) for c in ("p1", "p2", "n_bytes", "t1", "t2")),
            ((F.min("t1") == F.max("t1")) & (F.min("t2") == F.max("t2"))).alias("same")), "trie-nodes")
        if clash.isEmpty() and nodes.where("not same").isEmpty():
            return _subtrees(members, nodes)
        seed += 1


def _subtrees(members: DataFrame, nodes: DataFrame) -> DataFrame:
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("f1"), F.col("p2").alias("f2")) \
        .agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(children, NODE, "left").withColumns({
        "n_children": F.coalesce("n_children", F.lit(0)).cast("long"), "own": (F.col("n_convs") - 1) * F.col("n_bytes")})
    nodes = running_sums(nodes.drop("same", "n_bytes"), "conv_id", ["depth"], {}, ["own"], "trie-paths") \
        .withColumn("above", F.col("own_sum") - F.col("own")).drop("place", "own_sum")
    totals = nodes.groupBy("conv_id").agg(F.sum("own").alias("own"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf"))
    sums = members.select(*NODE, "conv_id").join(totals, "conv_id").groupBy(*NODE) \
        .agg(F.sum("own").alias("total"), F.sum("leaf").alias("n_leaves"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("f1").alias("p1"), F.col("f2").alias("p2"),
                           F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(sums, NODE).join(_ends(members), NODE, "left").join(parents, ["depth", "p1", "p2"], "left")
    real = lambda c: F.when(F.col("depth") > 0, F.col(c))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
                      (F.col("total") - F.col("above")).alias("saved_tokens"),
                      F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"),
                      real("t1").alias("turn_ref1"), real("t2").alias("turn_ref2"))


#: The same nodes in DuckDB SQL, over materialized lists of turns; CRC-32 bit by bit.
SQL = f"""
with t as (select conv_id, list(struct_pack(r := coalesce(role, ''), x := coalesce(text, ''))
                                order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as s
           from conversations where conv_id is not null group by conv_id),
h as (select *, xor(list_reduce(list_concat([4294967295::bigint], list_transform(string_split(cast(conv_id as varchar), ''), lambda z: cast(ascii(z) as bigint))),
        lambda a, b: list_reduce(list_concat([xor(a, b)], [0::bigint, 0, 0, 0, 0, 0, 0, 0]),
          lambda u, v: case when u % 2 = 1 then xor(u // 2, 3988292384::bigint) else u // 2 end)), 4294967295::bigint) % {HEADS} as h from t),
built as (select a.conv_id, list_concat(coalesce(b.s, [])[1:a.h], a.s[a.h + 1:]) as s
          from h a left join t b on b.conv_id = a.conv_id - a.conv_id % {FAMILY}),
m as (select conv_id, s, unnest(generate_series(0, len(s))) as depth from built),
n as (select s[1:depth] as p, depth, min(conv_id) as conv_id, count(*) as n_convs,
             coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (len(s) = depth), '') as ends
      from m group by all),
k as (select p[1:depth - 1] as p, count(*) as n_children from n where depth > 0 group by 1),
o as (select n.*, coalesce(k.n_children, 0) as n_children,
             case when n.depth = 0 then 0 else (n_convs - 1) * octet_length(encode(n.p[n.depth].x)) end as own from n left join k on n.p = k.p),
up as (select p[1:d] as p, sum(own) as saved_tokens, sum(case when n_children = 0 then 1 else 0 end) as n_leaves
       from (select *, unnest(generate_series(0, depth)) as d from o) group by 1)
select o.conv_id, o.depth, q.conv_id as parent_conv_id, o.n_convs, o.n_children, cast(up.n_leaves as bigint) as n_leaves,
       cast(up.saved_tokens as bigint) as saved_tokens, sha256(o.ends) as ends_sha256
from o join up on o.p = up.p left join o q on q.depth = o.depth - 1 and q.p = o.p[1:o.depth - 1]
"""
