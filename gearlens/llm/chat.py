"""Chat formatting with cumulative-snapshot collapse.

A logger that stores a conversation after every turn leaves snapshots that are
prefixes of longer ones.  Each turn gets a rolling hash of the conversation up
to it; conversations whose full hash is a proper prefix hash of another one are
anti-joined away, equal ones fold into the smallest id, and the maximal ones
are rendered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stage, table


def turn_prefixes(conversations: DataFrame) -> DataFrame:
    """One row per turn: conv_id, k (1-based place), n (turns), h1, h2: hash of turns 1..k.

    The rolling hash is the exclusive-or of 64-bit hashes of (place, role, text),
    twice with different seeds: one running window aggregate."""
    turns = conversations.select("conv_id", "turn", "role", "text").distinct()
    conv = Window.partitionBy("conv_id")
    order = conv.orderBy("turn", "role", "text")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = turns.withColumn("k", F.row_number().over(order)).withColumn("n", F.count(F.lit(1)).over(conv))
    # null and empty differ: whether a field is null is hashed too
    turn = [F.col("k"), F.col("role").isNull(), F.col("role"), F.col("text").isNull(), F.col("text")]
    t = t.withColumn("x1", F.xxhash64(*turn)).withColumn("x2", F.xxhash64(F.lit("second"), *turn))
    return t.select("conv_id", "turn", "role", "text", "k", "n",
                    F.expr("bit_xor(x1)").over(upto).alias("h1"), F.expr("bit_xor(x2)").over(upto).alias("h2"))


def maximal(prefixes: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_equal): the conversations that no longer one starts with.
    ``n_equal`` counts the conversations with the same turns; the smallest id stands for them."""
    key = ["h1", "h2", "k"]
    full = prefixes.where("k = n").groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_equal"))
    inner = prefixes.where("k < n").select(*key).distinct()
    return full.join(inner, key, "left_anti").select("conv_id", F.col("k").cast("bigint").alias("n_turns"), "n_equal")


def format_chats(conversations: DataFrame) -> DataFrame:
    """Rendered maximal conversations of ``conversations`` (conv_id, turn, role, text).

    Columns: conv_id, n_turns, n_equal, chat: ``<|role|>`` line and text line per turn.
    Turns go by (turn, role, text), nulls first; a repeated turn row counts once.
    Null role or text renders as empty but is told apart from it when
    conversations are compared.  Rows with null conv_id form one conversation.
    An empty table gives no rows; other columns are ignored.  A rendered
    conversation is one value of one row, so its size bounds the window."""
    p = stage(turn_prefixes(conversations), "chat-prefixes")
    keep = stage(maximal(p), "chat-maximal").withColumnRenamed("conv_id", "__conv")
    turns = p.join(keep, F.col("conv_id").eqNullSafe(F.col("__conv")))
    line = F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), F.coalesce("text", F.lit("")), F.lit("\n"))
    chats = turns.withColumn("line", line).groupBy("conv_id").agg(
        F.max("n_turns").alias("n_turns"), F.max("n_equal").alias("n_equal"), F.array_sort(F.collect_list(F.struct("k", "line"))).alias("lines"))
    return chats.select("conv_id", "n_turns", "n_equal", F.array_join(F.col("lines.line"), "").alias("chat"))


def op8_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))


ORACLE = {"op8_chat_snapshots": """
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
c AS (SELECT conv_id, list({'r': role, 't': text} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS l FROM t GROUP BY conv_id),
inner_prefix AS (SELECT DISTINCT list_slice(l, 1, k) AS l FROM (SELECT l, unnest(range(1, len(l))) AS k FROM c)),
f AS (SELECT min(conv_id) AS conv_id, l, count(*) AS n_equal FROM c GROUP BY l)
SELECT conv_id, CAST(len(l) AS BIGINT) AS n_turns, n_equal,
  array_to_string(list_transform(l, lambda x: '<|' || coalesce(x.r, '') || '|>' || chr(10) || coalesce(x.t, '') || chr(10)), '') AS chat
FROM f WHERE l NOT IN (SELECT l FROM inner_prefix)"""}
QUERIES = {"op8_chat_snapshots": op8_chat_snapshots}
