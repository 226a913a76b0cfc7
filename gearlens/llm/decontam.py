"""Benchmark decontamination: token windows of the corpus against a hash set of benchmark n-grams.

Every benchmark item gives its windows of 13 consecutive words (a shorter item
is one window).  The corpus is scanned once: each document's windows are hashed,
probed against the broadcast hash set in generated code, and only the hits are
verified word by word and shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lower_ascii, split_words, table, text_key

WINDOW = 13
#: Word rule of the contract, after lower-casing A-Z: everything that is not one of these.
NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: The hash set is broadcast up to this many windows (about 200 bytes each); a
#: larger one is joined by a shuffle on the hash, with the same rows.
BROADCAST_WINDOWS = 500_000


def _window_hashes(hashes: Column, width: Column) -> Column:
    """Hash of each run of ``width`` word hashes; none if the text is shorter."""
    n = F.size(hashes)
    return F.when(n >= width, F.transform(F.sequence(F.lit(1), n - width + 1),
                                          lambda i: F.xxhash64(F.slice(hashes, i, width), width))) \
        .otherwise(F.array().cast("array<bigint>"))


def _word_hashes(words: Column) -> Column:
    # lower() folds at least A-Z, so equal words hash alike; the verification is exact
    return F.transform(words, lambda w: F.xxhash64(F.lower(w)))


def benchmark_windows(bench: DataFrame) -> DataFrame:
    """(hash, width, gram, items): one row per distinct window of the benchmark
    and the sorted ids, as text, of the items that hold it."""
    words = bench.select(F.col("item_id").cast("string").alias("item"),
                         split_words(lower_ascii(F.col("text")), NOT_WORD).alias("words")).where("size(words) > 0")
    w = words.withColumn("width", F.least(F.size("words"), F.lit(WINDOW)))
    grams = w.withColumn("h", _word_hashes(F.col("words"))).select(
        "item", "width", F.posexplode(_window_hashes(F.col("h"), F.col("width"))).alias("i", "hash"), "words")
    grams = grams.select("item", "width", "hash",
                         F.concat_ws(" ", F.slice("words", F.col("i") + 1, F.col("width"))).alias("gram"))
    return grams.groupBy("hash", "width", "gram").agg(F.array_sort(F.collect_set("item")).alias("items"))


def _probed(docs: DataFrame, probe: DataFrame, widths: list[int]) -> DataFrame:
    """Hits by a broadcast set: the scan's rows meet it where they are."""
    d = docs.select("doc_id", text_key(F.col("text")).alias("text_hash"), split_words(F.col("text"), NOT_WORD).alias("words"))
    d = d.withColumn("h", _word_hashes(F.col("words"))) \
        .withColumn("width", F.explode(F.array(*[F.lit(w) for w in widths])))
    # position -1 carries the document itself through the probe, so one scan serves all
    d = d.select("doc_id", "text_hash", "words", "width",
                 F.posexplode(F.concat(F.array(F.lit(0).cast("bigint")), _window_hashes(F.col("h"), F.col("width")))).alias("p", "hash"))
    d = d.withColumn("start", F.col("p") - 1)
    hits = d.join(F.broadcast(probe),
                  (F.col("hash") == F.col("w_hash")) & (F.col("width") == F.col("w_width")) & (F.col("start") >= 0), "left")
    hits = hits.where((F.col("start") < 0) | F.col("gram").isNotNull())
    found = lower_ascii(F.concat_ws(" ", F.slice("words", F.greatest(F.col("start"), F.lit(0)) + 1, F.col("width"))))
    hits = hits.where((F.col("start") < 0) | (found == F.col("gram")))
    hits = hits.select("doc_id", "text_hash", "start", F.when(F.col("start") >= 0, F.col("start") + F.col("width")).otherwise(0).alias("end"),
                       F.when(F.col("start") < 0, F.size("words")).alias("words_here"), "items",
                       ((F.col("start") < 0) & (F.col("width") == widths[0])).alias("is_doc"))
    return hits


def _joined(docs: DataFrame, probe: DataFrame, widths: list[int]) -> DataFrame:
    """The same hits by a shuffle of window hashes: (row's key, width, start, hash) of
    every window, without a word; the words meet the few hits again by the row's key."""
    base = docs.select("doc_id", text_key(F.col("text")).alias("text_hash"), split_words(F.col("text"), NOT_WORD).alias("words"))
    h = base.select("doc_id", "text_hash", _word_hashes(F.col("words")).alias("h")).withColumn("width", F.explode(F.array(*[F.lit(w) for w in widths])))
    h = h.select("doc_id", "text_hash", "width", F.posexplode(_window_hashes(F.col("h"), F.col("width"))).alias("start", "hash"))
    met = h.join(probe, (F.col("hash") == F.col("w_hash")) & (F.col("width") == F.col("w_width"))).select("doc_id", "text_hash", "start", "width", "gram", "items")
    met = met.dropDuplicates(["doc_id", "text_hash", "start", "width", "gram"])
    per_row = met.groupBy(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).agg(F.collect_list(F.struct("start", "width", "gram", "items")).alias("met"))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__hash"))
    both = base.join(per_row, same).select("doc_id", "text_hash", "words", F.inline("met"))
    found = lower_ascii(F.concat_ws(" ", F.slice("words", F.col("start") + 1, F.col("width"))))
    none = F.lit(None).cast("int")
    hits = both.where(found == F.col("gram")).select("doc_id", "text_hash", "start", (F.col("start") + F.col("width")).alias("end"), none.alias("words_here"), "items",
                                                     F.lit(False).alias("is_doc"))
    rows = base.select("doc_id", "text_hash", F.lit(-1).alias("start"), F.lit(0).alias("end"), F.size("words").alias("words_here"),
                       F.lit(None).cast("array<string>").alias("items"), F.lit(True).alias("is_doc"))
    return rows.union(hits)


def scan(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """Contamination of every row of ``docs`` (doc_id, text) by ``bench`` (item_id, text).

    Columns: doc_id, n_words, n_hit (words inside any occurrence of a window),
    n_items, items_sha256, contaminated, and hit_ranges (array of struct start,
    end: hit word positions, end exclusive), text_hash (tells rows with one id apart).

    Null or empty text: no words, not contaminated.  Repeated rows stay, one
    result row each.  Null doc_id and null item_id are ids like any other (a
    null item id is left out of the list of items).  Empty tables give no rows
    or no hits.  Other columns of either table are ignored.
    """
    windows = benchmark_windows(bench).persist()
    widths = sorted(r[0] for r in windows.select("width").distinct().collect()) or [WINDOW]   # at most 13 values
    small = windows.count() <= BROADCAST_WINDOWS
    probe = windows.select(F.col("hash").alias("w_hash"), F.col("width").alias("w_width"), "gram", "items")

    hits = _probed(docs, probe, widths) if small else _joined(docs, probe, widths)

    key = ["doc_id", "text_hash"]
    before = Window.partitionBy(*key).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max("end").over(before), F.lit(0))
    spans = hits.withColumn("from", F.greatest(F.col("start"), reach, F.lit(0)))
    per_doc = spans.groupBy(*key).agg(
        F.sum(F.col("is_doc").cast("bigint")).alias("copies"),
        F.max("words_here").cast("bigint").alias("n_words"),
        F.sum(F.greatest(F.col("end") - F.col("from"), F.lit(0))).cast("bigint").alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("item_list"),
        F.array_sort(F.collect_list(F.when(F.col("end") > F.col("from"), F.struct(F.col("from").alias("start"), "end")))).alias("hit_ranges"))
    out = per_doc.select(
        "doc_id", "text_hash", "n_words", "n_hit", F.size("item_list").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_list").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), "hit_ranges",
        F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))).alias("copy"))
    return out.drop("copy")


def remove_spans(text: Column, ranges: Column) -> Column:
    """The text without the words of ``ranges`` (word positions as in :func:`scan`)
    and without the separators that follow them."""
    pieces = F.regexp_extract_all(text, F.lit(rf"({NOT_WORD}|[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)"), F.lit(1))
    first_word = F.when(text.rlike("^" + NOT_WORD), 1).otherwise(0)
    word_of = lambda i: F.floor((i - first_word) / 2)                       # noqa: E731
    return F.array_join(F.filter(pieces, lambda p, i: (i < first_word) | ~F.exists(
        ranges, lambda r: (word_of(i) >= r["start"]) & (word_of(i) < r["end"]))), "")


def decontaminate(docs: DataFrame, bench: DataFrame, mode: str = "documents") -> DataFrame:
    """``docs`` without contaminated documents, or (``mode='spans'``) with the hit
    words cut out of them.  All columns of ``docs`` stay.  Rows are matched to
    their verdict by doc_id and text, null-safe; a repeated row keeps its verdict."""
    bad = scan(docs, bench).where("contaminated").dropDuplicates(["doc_id", "text_hash"]) \
        .select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("hit_ranges").alias("__ranges"))
    on = docs["doc_id"].eqNullSafe(bad["__id"]) & text_key(docs["text"]).eqNullSafe(bad["__hash"])
    if mode == "documents":
        return docs.join(bad, on, "left_anti")
    cut = docs.join(bad, on, "left")
    return cut.withColumn("text", F.when(F.col("__ranges").isNotNull(), remove_spans(F.col("text"), F.col("__ranges")))
                          .otherwise(F.col("text"))).select(*docs.columns)


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


_SQL_WORDS = ("list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
              "'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')")
ORACLE = {"op4_benchmark_decontamination": f"""
WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_SQL_WORDS} AS ws FROM benchmark),
grams AS (
  SELECT DISTINCT item, least(len(ws), 13) AS width, unnest(list_transform(range(1, len(ws) - least(len(ws), 13) + 2),
         lambda i: list_slice(ws, i, i + least(len(ws), 13) - 1))) AS gram
  FROM items WHERE len(ws) > 0),
widths AS (SELECT DISTINCT width FROM grams),
docs AS (SELECT doc_id, {_SQL_WORDS} AS ws FROM documents),
pos AS (SELECT doc_id, ws, width, unnest(range(1, len(ws) - width + 2)) AS i FROM docs, widths WHERE len(ws) >= width),
hits AS (SELECT p.doc_id, p.i, p.width, g.item FROM pos p JOIN grams g
         ON g.width = p.width AND g.gram = list_slice(p.ws, p.i, p.i + p.width - 1)),
covered AS (SELECT doc_id, count(DISTINCT w) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + width)) AS w FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, list_sort(list(DISTINCT item)) AS l FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(len(l), 0) AS BIGINT) AS n_items, sha256(coalesce(array_to_string(l, ','), '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM docs d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)"""}
QUERIES = {"op4_benchmark_decontamination": op4_benchmark_decontamination}
