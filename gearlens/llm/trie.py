"""Prefix trie of conversations from vertical bitmaps.

Conversations are dealt out by blocks of ``SHARD`` ids.  In a shard, every
(position, turn) has a bitset of the conversations that hold the turn there; a
trie node is the bitset of its members, and its children are the intersections
with the postings of the next position that are not empty, taken depth first.
A shard's rows come by position, and a band of ``BAND`` positions is held at a
time, so that a task's memory does not follow the length of a conversation.

The shards' nodes meet by the hash of their path.  Sums over subtrees need no
walk over ancestors: each node belongs to its smallest member, and a node's
subtree is what its members own from the node's depth on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, ship_by_value, stage, table

#: Conversation ids of a shard, positions that a task holds at once.
SHARD, BAND = 1024, 64
#: Node rows of an output batch.
ROWS = 20_000
NODE = ("k1 bigint, k2 bigint, p1 bigint, p2 bigint, depth bigint, shard bigint, n_words bigint, "
        "n_here bigint, first_here bigint, members array<int>, ends array<int>")


def _key(parent: bytes, turn: bytes) -> bytes:
    return hashlib.blake2b(parent + turn, digest_size=16).digest()


def places(bits: int) -> list[int]:
    """Places of the set bits of a bitset, ascending."""
    if bits.bit_count() < 24:
        out = []
        while bits:
            low = bits & -bits
            out.append(low.bit_length() - 1)
            bits ^= low
        return out
    raw = np.frombuffer(bits.to_bytes((bits.bit_length() + 7) // 8, "little"), np.uint8)
    return np.flatnonzero(np.unpackbits(raw, bitorder="little")).tolist()


class Shard:
    """The trie of one shard's conversations, fed by bands of positions."""

    def __init__(self, shard: int):
        self.shard = shard
        self.open: list[tuple] = []                  # nodes whose children are not known yet: (key, parent key, depth, words, bitset)
        self.rows: list[tuple] = []

    def _node(self, node: tuple, ends: int) -> None:
        key, parent, depth, words, bits = node
        a, b = np.frombuffer(key, np.int64).tolist()
        p, q = np.frombuffer(parent, np.int64).tolist() if depth else (None, None)
        members = places(bits)
        self.rows.append((a, b, p, q, depth, self.shard, words, len(members), self.shard * SHARD + members[0], members, places(ends)))

    def add(self, depths: np.ndarray, offsets: np.ndarray, h1: np.ndarray, h2: np.ndarray, words: np.ndarray) -> None:
        """Turns of one band: depth, conversation's place in the shard, hash of the turn, its words."""
        postings: dict[tuple[int, bytes], int] = {}
        turn_at: dict[int, dict[int, bytes]] = {}
        words_of: dict[bytes, int] = {}
        turns = np.stack([h1, h2], 1).astype(np.int64)
        for d, o, t, w in zip(depths.tolist(), offsets.tolist(), (turns[i].tobytes() for i in range(len(turns))), words.tolist()):
            postings[d, t] = postings.get((d, t), 0) | 1 << o
            turn_at.setdefault(d, {})[o] = t
            words_of[t] = w
        present = {d: 0 for d in turn_at}
        for (d, _), bits in postings.items():
            present[d] |= bits
        last = int(depths[-1])
        if depths[0] == 0:
            root = bytes(16)
            self.open = [(root, root, 0, 0, present[0])]
        stack, later = self.open, []
        while stack:
            node = stack.pop()
            key, _, depth, _, bits = node
            if depth == last and (depth + 1) % BAND == 0:                # the next band may go on from here
                later.append(node)
                continue
            here = turn_at.get(depth + 1, {})
            rest = bits & present.get(depth + 1, 0)
            self._node(node, bits & ~rest)
            while rest:
                t = here[(rest & -rest).bit_length() - 1]
                child = bits & postings[depth + 1, t]
                rest &= ~child
                stack.append((_key(key, t), key, depth + 1, words_of[t], child))
        self.open = later

    def close(self) -> None:
        for node in self.open:
            self._node(node, node[4])
        self.open = []

    def batches(self, least: int) -> Iterator[pa.RecordBatch]:
        while len(self.rows) > least:
            some, self.rows = self.rows[:ROWS], self.rows[ROWS:]
            kinds = [pa.int64()] * 9 + [pa.list_(pa.int32())] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some), kinds)], [f.split()[0] for f in NODE.split(", ")])


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (shard, depth, place, h1, h2, words) sorted by (shard, depth) to node rows."""
    held: list[list[np.ndarray]] = []
    at: tuple[int, int] | None = None
    trie: Shard | None = None

    def finish():
        if held:
            trie.add(*[np.concatenate([part[i] for part in held]) for i in range(5)])
            held.clear()

    for b in batches:
        shard, depth, *rest = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        if not len(shard):
            continue
        band = depth // BAND
        cuts = [0, *(np.flatnonzero((shard[1:] != shard[:-1]) | (band[1:] != band[:-1])) + 1).tolist(), len(shard)]
        for lo, hi in zip(cuts, cuts[1:]):
            here = (int(shard[lo]), int(band[lo]))
            if here != at:
                finish()
                if at is None or here[0] != at[0]:
                    if trie is not None:
                        trie.close()
                        yield from trie.batches(0)
                    trie = Shard(here[0])
                yield from trie.batches(ROWS)
                at = here
            held.append([depth[lo:hi], *[c[lo:hi] for c in rest]])
    if trie is not None:
        finish()
        trie.close()
        yield from trie.batches(0)


def _digest_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (k1, k2, shard, ends) sorted by (k1, k2, shard) to (k1, k2, SHA-256 of the
    decimal ids, comma-joined): a node's ids pass through one running hash."""
    at, sha, out = None, None, []

    def batch():
        a, b, c = zip(*out)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.string())], ["k1", "k2", "ends_sha256"])

    for b in batches:
        for k1, k2, shard, ends in zip(*[c.to_pylist() for c in b.columns]):
            ids = ",".join(map(str, (shard * SHARD + e for e in ends)))
            if at == (k1, k2):
                sha.update(f",{ids}".encode())
                continue
            if at is not None:
                out.append((*at, sha.hexdigest()))
            at, sha = (k1, k2), hashlib.sha256(ids.encode())
            if len(out) >= ROWS:
                yield batch()
                out = []
    if at is not None:
        out.append((*at, sha.hexdigest()))
        yield batch()


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, k, role, text): turns numbered from 1 by (turn, role, text), nulls
    first; null role or text is empty.  Rows without conv_id belong to no conversation."""
    t = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
                             F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    return t.where("conv_id IS NOT NULL").select("conv_id", F.row_number().over(order).cast("bigint").alias("k"), "role", "text")


def prefix_trie(turns: DataFrame, conv_ids: DataFrame | None = None) -> DataFrame:
    """The trie of all conversations: one row per distinct sequence of first turns.

    ``turns``: (conv_id bigint, k: 1, 2, ... in every conversation, role, text);
    ``conv_ids`` (conv_id): conversations that count even without a turn.

    Columns: conv_id (smallest member), depth, parent_conv_id (null for the root),
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256, and k1, k2 (hash of
    the path).  The root has depth 0 and all conversations; no conversation, no rows.
    Equal conversations are members of the same nodes, repeated conv_ids count once.
    Other columns are ignored; texts are hashed whole."""
    words = F.size(F.array_remove(F.split("text", SPACE), "")).cast("bigint")
    t = turns.select("conv_id", F.col("k").alias("depth"), F.xxhash64("role", "text").alias("h1"),
                     F.xxhash64(F.lit("second"), "text", "role").alias("h2"), words.alias("n_words"))
    none = F.lit(0).cast("bigint")
    ids = turns.select("conv_id").distinct() if conv_ids is None else conv_ids.select("conv_id").where("conv_id IS NOT NULL").distinct()
    t = t.union(ids.select("conv_id", none, none, none, none))
    t = t.select(F.shiftright("conv_id", SHARD.bit_length() - 1).alias("shard"), "depth", F.col("conv_id").bitwiseAND(SHARD - 1).alias("place"), "h1", "h2", "n_words")
    t = t.repartition("shard").sortWithinPartitions("shard", "depth")
    local = stage(t.mapInArrow(_walk, NODE), "trie-local")

    key, parent = ["k1", "k2"], ["p1", "p2"]
    nodes = local.groupBy(*key).agg(F.min("first_here").alias("conv_id"), F.min("depth").alias("depth"), F.min("p1").alias("p1"), F.min("p2").alias("p2"),
                                    F.max("n_words").alias("n_words"), F.sum("n_here").alias("n_convs"))
    nodes = stage(nodes, "trie-nodes")
    children = nodes.where("depth > 0").groupBy(*[F.col(p).alias(k) for p, k in zip(parent, key)]).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(children, key, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))) \
        .withColumn("leaf", (F.col("n_children") == 0).cast("bigint")).withColumn("saved", (F.col("n_convs") - 1) * F.col("n_words"))
    own = Window.partitionBy("conv_id").orderBy("depth")
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    nodes = nodes.withColumn("saved_above", F.coalesce(F.sum("saved").over(before), F.lit(0))).withColumn("attached", F.row_number().over(own) == 1)
    nodes = stage(nodes, "trie-sums")

    # what every conversation owns, summed over the members of every node
    owned = nodes.groupBy("conv_id").agg(F.sum("leaf").alias("leaves"), F.sum("saved").alias("saved"))
    members = local.select(*key, F.explode("members").alias("place"), "shard").select(*key, (F.col("shard") * SHARD + F.col("place")).alias("conv_id"))
    below = members.join(owned, "conv_id").groupBy(*key).agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_by_members"))

    ends = local.where(F.size("ends") > 0).select(*key, "shard", "ends").repartition(*key).sortWithinPartitions(*key, "shard") \
        .mapInArrow(_digest_ends, "k1 bigint, k2 bigint, ends_sha256 string")
    # the parent of a node that its owner does not own is looked up, all others follow in their owner's chain
    attached = nodes.where("attached AND depth > 0").select(*key, *[F.col(p).alias(f"__{p}") for p in parent])
    tops = nodes.where("n_children > 0").select(*[F.col(k).alias(f"__{p}") for k, p in zip(key, parent)], F.col("conv_id").alias("top"))
    tops = attached.join(tops, ["__p1", "__p2"]).select(*key, "top")
    out = nodes.join(below, key).join(ends, key, "left").join(tops, key, "left")
    empty = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", "depth", F.when(F.col("depth") > 0, F.coalesce("top", "conv_id")).alias("parent_conv_id"), "n_convs", "n_children",
                      "n_leaves", (F.col("saved_by_members") - F.col("saved_above")).alias("saved_tokens"),
                      F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"), *key)


#: The rebuild of the registered query: conversations of one block of ids share the
#: first turns of the block's first one (fixed values).
BLOCK, HEADS = 20, 4


def rebuild(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, conv_ids) of the rebuilt conversations: conversation c begins with the
    first h turns of conversation c - c % 20 and goes on with its own turns after its
    first h; h = crc32(decimal c) % 4."""
    t = ordered_turns(conversations)
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    base = F.col("conv_id") - F.col("conv_id") % BLOCK
    ids = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id")).where("conv_id IS NOT NULL").distinct().withColumn("base", base).withColumn("h", h)
    heads = t.where((F.col("k") < HEADS) & (F.col("conv_id") % BLOCK == 0)).withColumnRenamed("conv_id", "base")
    counts = heads.groupBy("base").agg(F.count(F.lit(1)).alias("n"))
    head = ids.join(heads, "base").where("k <= h").select("conv_id", "k", "role", "text")
    tail = t.withColumn("base", base).withColumn("h", h).where("k > h").join(counts, "base", "left")
    tail = tail.select("conv_id", (F.col("k") - F.col("h") + F.least("h", F.coalesce("n", F.lit(0)))).alias("k"), "role", "text")
    return head.union(tail), ids.select("conv_id")


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = prefix_trie(*rebuild(table(spark, sf_dir, "conversations")))
    return out.drop("k1", "k2")


_CRC = ("xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, length(conv_id::varchar) + 1), lambda i: ascii(substr(conv_id::varchar, i, 1))::bigint)), "
        "lambda c, b: list_reduce(list_prepend(xor(c, b), range(0, 8)), lambda x, j: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)")
ORACLE = {"op13_conversation_trie": f"""
WITH o AS (SELECT conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS l
           FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT *, {_CRC} % {HEADS} AS h FROM o),
c AS (SELECT h.conv_id, list_concat(list_slice(coalesce(b.l, []), 1, h.h), list_slice(h.l, h.h + 1, len(h.l))) AS l
      FROM h LEFT JOIN o b ON b.conv_id = h.conv_id - h.conv_id % {BLOCK}),
p AS (SELECT conv_id, l, unnest(range(0, len(l) + 1)) AS depth FROM c),
m AS (SELECT conv_id, depth, list_slice(l, 1, depth) AS path, len(l) = depth AS ends FROM p),
n AS (SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs,
        sha256(coalesce(string_agg(CASE WHEN ends THEN conv_id::varchar END, ',' ORDER BY conv_id), '')) AS ends_sha256,
        (count(*) - 1) * CASE WHEN depth = 0 THEN 0 ELSE len(list_filter(regexp_split_to_array(list_last(path).t, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')) END AS saved
      FROM m GROUP BY depth, path),
k AS (SELECT depth - 1 AS depth, list_slice(path, 1, depth - 1) AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
f AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (depth, path)),
up AS (SELECT unnest(range(0, depth + 1)) AS top, path, n_children, saved FROM f),
s AS (SELECT top AS depth, list_slice(path, 1, top) AS path, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved_tokens FROM up GROUP BY ALL)
SELECT f.conv_id, f.depth, q.conv_id AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves, s.saved_tokens::bigint AS saved_tokens, f.ends_sha256
FROM f JOIN s USING (depth, path) LEFT JOIN n q ON q.depth = f.depth - 1 AND q.path = list_slice(f.path, 1, f.depth - 1)"""}
QUERIES = {"op13_conversation_trie": op13_conversation_trie}
ship_by_value(__name__)
