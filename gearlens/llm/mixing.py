"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

The target of each source is cut into blocks of ``BLOCK`` words.  Blocks are
seats: highest quotients votes / (2 k + 1) give them to sources, then each
source's blocks to its groups of shards, then to its shards, so that every
(source, shard) cell has an integer quota and every source its exact number.
Inside a cell the documents lie in seeded order as one stream of words, and the
quota is a run of whole blocks of that stream from a seeded start, going round
at the end (a document is then taken at most twice).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import split_words, stage, table

#: Words of a block.
BLOCK = 16
#: Words of a shard; the number of shards follows the corpus.
SHARD_WORDS = 1 << 16
#: Least blocks that a source has for each of its shards (a smaller source lies in
#: fewer): a cell gets whole blocks but no document more than twice, so a cell of
#: few blocks loses a large part of its quota or of its words.
CELL_BLOCKS = 64
SEED = 17
#: Fixed values of the mix: weights by rank of the source, share of all words, largest repetition.
WEIGHTS, SHARE_NUM, SHARE_DEN, MOST = (5, 2, 1), 3, 2, 2


def seeded(c: Column, tag: str, seed: int = SEED) -> Column:
    """A 60-bit number from md5 of the id and the seed (the same in any SQL engine)."""
    text = F.concat(F.lit(f"{tag}{seed}:"), F.coalesce(c.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def targets(sizes: DataFrame) -> DataFrame:
    """Targets of the sources of ``sizes`` (source, source_size): one small row per source.

    Water filling in one ordered pass: a source is capped at twice its size if
    the level reached by all sources with a smaller size to weight ratio, given
    full, still exceeds its cap."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", "rank")
    rank = F.row_number().over(by_name) - 1
    s = sizes.withColumn("rank", rank)
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("rank") % len(WEIGHTS) + 1).cast("int")).cast("bigint"))
    s = s.withColumn("ratio", F.col("source_size") * MOST / F.col("weight"))
    everything = Window.partitionBy()
    s = s.withColumn("total", F.sum("source_size").over(everything)).withColumn("all_weight", F.sum("weight").over(everything))
    upto = by_ratio.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # words left, and weight left, if this source and all before it are capped
    s = s.withColumn("left", F.col("total") * SHARE_NUM / SHARE_DEN - MOST * (F.sum("source_size").over(upto) - F.col("source_size"))) \
        .withColumn("weight_left", F.col("all_weight") - F.sum("weight").over(upto) + F.col("weight"))
    s = s.withColumn("capped", F.col("left") * F.col("weight") >= MOST * F.col("source_size") * F.col("weight_left"))
    level = F.max(F.when(~F.col("capped"), F.struct(-F.col("rank_ratio"), F.col("left") / F.col("weight_left")))).over(everything)
    s = s.withColumn("rank_ratio", F.row_number().over(by_ratio)).withColumn("level", level["col2"])
    return s.select("source", "rank", "source_size",
                    F.when(F.col("capped"), (MOST * F.col("source_size")).cast("double"))
                    .otherwise(F.col("level") * F.col("weight")).alias("target"))


def sainte_lague(cells: DataFrame, parent: list[str], votes: str, seats: str, tie: str, out: str) -> DataFrame:
    """Seats of each cell within its parent by highest quotients votes / (2 k + 1).

    With n cells and V votes for M seats, every divisor above V / (M - n/2)
    gives at most M seats and every one below V / (M + n/2) at least M.  So the
    seats of the first are safe, those beyond the second are never given, and
    only the at most 2 n + n quotients between are ranked.  ``seats`` is a
    column that is constant in a parent.  Cells without votes get none."""
    w = Window.partitionBy(*parent)
    v = F.col(votes)
    c = cells.withColumn("__n", F.count(F.when(v > 0, 1)).over(w)).withColumn("__v", F.sum(votes).over(w))
    some = (v > 0) & (F.col("__v") > 0)
    low = F.when(some & (F.col(seats) > F.col("__n") / 2), F.floor(v * (F.col(seats) - F.col("__n") / 2) / F.col("__v") + 0.5)).otherwise(0)
    high = F.when(some, F.floor(v * (F.col(seats) + F.col("__n") / 2) / F.col("__v") + 0.5) + 1).otherwise(0)
    c = c.withColumn("__low", low.cast("bigint")).withColumn("__high", high.cast("bigint"))
    c = c.withColumn("__open", F.col(seats) - F.sum("__low").over(w))
    q = c.withColumn("__k", F.explode(F.concat(F.array(F.lit(-1).cast("bigint")), F.when(
        F.col("__high") > F.col("__low"), F.sequence(F.col("__low"), F.col("__high") - 1)).otherwise(F.array().cast("array<bigint>")))))
    best = Window.partitionBy(*parent).orderBy(F.desc("__quotient"), tie, "__k")
    q = q.withColumn("__quotient", F.when(F.col("__k") >= 0, v / (2 * F.col("__k") + 1)).otherwise(-1.0))
    q = q.withColumn("__won", ((F.col("__k") >= 0) & (F.row_number().over(best) <= F.col("__open"))).cast("bigint"))
    return q.groupBy(*cells.columns).agg((F.max("__low") + F.sum("__won")).alias(out))


def mix(docs: DataFrame, block: int = BLOCK, shard_words: int = SHARD_WORDS, seed: int = SEED) -> DataFrame:
    """Words that the mix takes of each document of ``docs`` (doc_id, text, source).

    Columns: doc_id, source, size, source_size, target (its source's), quota
    (blocks of its cell), taken.  ``taken`` is at most twice the size.

    Null or empty text: size 0, nothing taken.  Null source: a source of its
    own, last in order.  Repeated rows are documents of their own, next to each
    other in the stream (their share of it is told apart by text size).  Null
    doc_id: an id like any other.  An empty table gives no rows.  Other columns
    are ignored.  The result depends on ids, texts and seed only."""
    d = stage(docs.select("doc_id", "source", F.size(split_words(F.col("text"))).cast("bigint").alias("size")), "mix-sizes")
    sizes = d.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = targets(sizes)
    total = d.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    shards = max(1, -(-total // shard_words))
    groups = max(1, round(shards ** 0.5))

    own = F.greatest(F.lit(1), F.least(F.lit(shards), F.floor(F.col("source_size") / (CELL_BLOCKS * block)))).cast("bigint")
    own = stage(sizes.select(F.col("source").alias("__source"), own.alias("__shards")), "mix-shards")
    own = F.broadcast(own) if own.count() <= 100_000 else own
    d = d.join(own, F.col("source").eqNullSafe(F.col("__source"))) \
        .withColumn("shard", seeded(F.col("doc_id"), "shard", seed) % F.col("__shards")).drop("__source", "__shards")
    d = stage(d, "mix-sharded")
    cells = d.groupBy("source", "shard").agg(F.sum("size").alias("cell_size"))
    blocks = F.round(F.sum("target").over(Window.partitionBy()) / block).cast("bigint")
    of_source = sainte_lague(goal.withColumn("blocks", blocks).withColumn("one", F.lit(1)), ["one"], "target", "blocks", "rank", "source_blocks") \
        .drop("one", "blocks")
    of_source = stage(of_source, "mix-sources")
    of_source = F.broadcast(of_source) if of_source.count() <= 100_000 else of_source
    named = of_source.withColumnRenamed("source", "__source")
    cells = cells.join(named, F.col("source").eqNullSafe(F.col("__source"))).drop("__source").withColumn("group", F.col("shard") % groups)
    cells = stage(cells, "mix-cells")
    up = cells.groupBy("rank", "group").agg(F.sum("cell_size").alias("group_size"), F.max("source_blocks").alias("source_blocks"))
    up = sainte_lague(up, ["rank"], "group_size", "source_blocks", "group", "group_blocks").select("rank", "group", "group_blocks")
    cells = cells.join(up, ["rank", "group"])
    cells = sainte_lague(cells, ["rank", "group"], "cell_size", "group_blocks", "shard", "quota")
    cells = stage(cells.select(F.col("source").alias("__source"), F.col("shard").alias("__shard"), "cell_size", "source_size", "target", "quota"), "mix-quotas")

    rows = d.join(cells, F.col("source").eqNullSafe(F.col("__source")) & (F.col("shard") == F.col("__shard"))) \
        .drop("__source", "__shard")
    order = Window.partitionBy("source", "shard").orderBy(seeded(F.col("doc_id"), "order", seed), "doc_id", "size") \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("to", F.sum("size").over(order)).withColumn("from", F.col("to") - F.col("size"))
    words = F.least(F.col("quota") * block, MOST * F.col("cell_size"))
    size = F.greatest(F.col("cell_size"), F.lit(1))
    rows = rows.withColumn("rounds", F.floor(words / size).cast("bigint")).withColumn("rest", words % size)
    n_blocks = F.greatest(F.floor(F.col("cell_size") / block).cast("bigint"), F.lit(1).cast("bigint"))
    start = seeded(F.concat_ws("/", F.coalesce(F.col("source"), F.lit("\x00")), F.col("shard").cast("string")), "start", seed) % n_blocks * block
    rows = rows.withColumn("start", start).withColumn("stop", F.col("start") + F.col("rest"))
    # the run [start, stop) of the stream laid twice end to end
    part = lambda shift: F.greatest(F.lit(0), F.least(F.col("to") + shift, F.col("stop")) - F.greatest(F.col("from") + shift, F.col("start")))
    taken = F.col("rounds") * F.col("size") + part(F.lit(0)) + part(F.col("cell_size"))
    return rows.select("doc_id", "source", "size", "source_size", "target", "quota", taken.cast("bigint").alias("taken"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def _sql_seeded(expr: str, tag: str) -> str:
    return f"CAST('0x' || substr(md5('{tag}{SEED}:' || coalesce(CAST({expr} AS VARCHAR), '')), 1, 15) AS BIGINT)"


def oracle(docs: str = "documents") -> str:
    """The plain definition: all quotients ranked, no bounds."""
    def seats(src, parent, votes, seats_, tie, out):
        over = f"PARTITION BY {parent}"
        return f"""(SELECT c.*, coalesce(won, 0) AS {out} FROM {src} c LEFT JOIN (
            SELECT {parent}, {tie}, count(*) AS won FROM (
              SELECT *, row_number() OVER ({over} ORDER BY {votes} / CAST(2 * k + 1 AS DOUBLE) DESC, {tie}, k) AS r FROM (
                SELECT *, unnest(range(0, {seats_} + 1)) AS k FROM {src} WHERE {votes} > 0)) WHERE r <= {seats_}
            GROUP BY ALL) w USING ({parent}, {tie}))"""
    return f"""
WITH d AS MATERIALIZED (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM {docs}),
t AS (SELECT *, [5, 2, 1][rank % 3 + 1] AS weight FROM (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM d GROUP BY source)),
o AS (SELECT *, 2 * source_size / CAST(weight AS DOUBLE) AS ratio FROM t),
l AS (SELECT *, CAST(sum(source_size) OVER () AS DOUBLE) * 3 / 2 - 2 * coalesce(sum(source_size) OVER p, 0) AS words_left,
        sum(weight) OVER () - coalesce(sum(weight) OVER p, 0) AS weight_left
      FROM o WINDOW p AS (ORDER BY ratio, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT min_by(words_left / weight_left, (ratio, rank)) AS v FROM l WHERE NOT words_left * weight >= 2 * source_size * weight_left),
goal AS MATERIALIZED (SELECT source, rank, source_size, CASE WHEN words_left * weight >= 2 * source_size * weight_left THEN CAST(2 * source_size AS DOUBLE)
         ELSE (SELECT v FROM level) * weight END AS target FROM l),
g1 AS MATERIALIZED (SELECT *, 1 AS one, CAST(round(sum(target) OVER () / {BLOCK}) AS BIGINT) AS blocks FROM goal),
s1 AS MATERIALIZED {seats('g1', 'one', 'target', 'blocks', 'rank', 'source_blocks')},
n AS (SELECT greatest(1, CAST(ceil(sum(size) / {SHARD_WORDS}) AS BIGINT)) AS shards FROM d),
n2 AS (SELECT shards, greatest(1, CAST(round_even(sqrt(shards), 0) AS BIGINT)) AS groups FROM n),
ds AS MATERIALIZED (SELECT d.*, {_sql_seeded('doc_id', 'shard')} % shards AS shard, {_sql_seeded('doc_id', 'shard')} % shards % groups AS grp FROM d, n2),
cells AS MATERIALIZED (SELECT s.rank, ds.source, shard, grp, CAST(sum(size) AS BIGINT) AS cell_size, any_value(s.source_size) AS source_size,
   any_value(s.target) AS target, any_value(s.source_blocks) AS source_blocks
  FROM ds JOIN s1 s ON ds.source IS NOT DISTINCT FROM s.source GROUP BY ALL),
up AS MATERIALIZED (SELECT rank, grp, sum(cell_size) AS group_size, any_value(source_blocks) AS source_blocks FROM cells GROUP BY ALL),
s2 AS MATERIALIZED {seats('up', 'rank', 'group_size', 'source_blocks', 'grp', 'group_blocks')},
c2 AS MATERIALIZED (SELECT cells.*, s2.group_blocks, cells.rank * 1000000000 + cells.grp AS parent FROM cells JOIN s2 ON cells.rank = s2.rank AND cells.grp = s2.grp),
s3 AS MATERIALIZED {seats('c2', 'parent', 'cell_size', 'group_blocks', 'shard', 'quota')},
r AS (SELECT ds.doc_id, ds.size, s3.source_size, s3.target, s3.cell_size, s3.quota, least(s3.quota * {BLOCK}, 2 * s3.cell_size) AS words,
   {_sql_seeded("coalesce(ds.source, chr(0)) || '/' || CAST(ds.shard AS VARCHAR)", 'start')} % greatest(s3.cell_size // {BLOCK}, 1) * {BLOCK} AS start,
   sum(ds.size) OVER (PARTITION BY ds.source, ds.shard ORDER BY {_sql_seeded('doc_id', 'order')}, doc_id, ds.size ROWS UNBOUNDED PRECEDING) AS upto
  FROM ds JOIN s3 ON ds.source IS NOT DISTINCT FROM s3.source AND ds.shard = s3.shard),
x AS (SELECT *, words // greatest(cell_size, 1) AS rounds, start + words % greatest(cell_size, 1) AS stop, upto - size AS since FROM r)
SELECT doc_id, size, source_size, target, CAST(rounds * size + greatest(0, least(upto, stop) - greatest(since, start))
  + greatest(0, least(upto + cell_size, stop) - greatest(since + cell_size, start)) AS BIGINT) AS taken FROM x"""


ORACLE = {"op5_source_mixing": oracle()}
QUERIES = {"op5_source_mixing": op5_source_mixing}
