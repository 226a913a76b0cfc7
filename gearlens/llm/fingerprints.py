"""Document fingerprints: bottom-k sketches of shingle hashes.

A text's sketch holds the ``K`` smallest distinct hashes of its word shingles,
sorted.  Sketches of the parts of a collection merge into the sketch of the
whole, and from two sketches alone follow estimates of resemblance, containment
and the number of distinct shingles; below ``K`` shingles all three are exact.

Everything is made of built-in functions, so the scan stays in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import lower_ascii, split_words, stage, table

#: Words of a shingle, hashes of a sketch.
WIDTH, K = 5, 128
#: Weights of a shingle's words (below 2^28, so that five products of 32-bit
#: hashes stay in a long) and the two primes that give the halves of a hash.
WEIGHTS = [268435399, 205891133, 151372417, 233280047, 119304653]
HIGH, LOW = 2**31 - 1, 2**31 - 19
#: Ranges of keys for each shuffle partition.
RANGES = 4
#: Hashes lie in 0 .. SPACE.
SPACE = HIGH * 2**31


def _once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often it occurs there."""
    return F.transform(F.array(value), use)[0]


def shingle_hashes(text: Column) -> Column:
    """Hashes of the word shingles of a text in order, repeats included: lower-cased
    A-Z, words of :data:`common.SPACE`; fewer words than a shingle are one shingle."""
    words = F.transform(split_words(lower_ascii(text)), lambda w: F.crc32(w))
    filled = _once(words, lambda h: F.when((F.size(h) > 0) & (F.size(h) < WIDTH), F.concat(h, F.array_repeat(F.lit(0).cast("bigint"), WIDTH - F.size(h))))
                   .otherwise(h))

    def shingle(h: Column, i: Column) -> Column:
        mixed = sum((h[i + j] * w for j, w in enumerate(WEIGHTS[1:], 1)), h[i] * WEIGHTS[0])
        return _once(mixed, lambda m: (m % HIGH) * 2**31 + m % LOW)

    return _once(filled, lambda h: F.when(F.size(h) >= WIDTH, F.transform(F.sequence(F.lit(0), F.size(h) - WIDTH), lambda i: shingle(h, i)))
                 .otherwise(F.array().cast("array<bigint>")))


def bottom(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def sketch(text: Column, k: int = K) -> Column:
    """Sketch of a text; null and wordless texts have the empty sketch."""
    return bottom(shingle_hashes(F.coalesce(text, F.lit(""))), k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the union of what two sketches stand for."""
    return bottom(F.concat(a, b), k)


def merge_parts(df: DataFrame, column: str, by: list[str], k: int = K) -> DataFrame:
    """``df`` (by, ``column``: a sketch) reduced to one sketch per group, and its
    ``n_parts``.  The hashes of a group are counted before they are ranked: a group
    is dealt out by ranges of hashes and every range hands on ``k`` at most, so a
    group of any size meets in one task as at most 256 * k hashes.  Null groups are
    a group; empty sketches add nothing but their part."""
    parts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_parts"))
    h = df.select(*by, F.explode(column).alias("hash")).distinct()
    order = F.row_number().over(Window.partitionBy(*by, "__range").orderBy("hash"))
    h = h.withColumn("__range", F.shiftright("hash", 54)).withColumn("__place", order).where(F.col("__place") <= k)
    whole = h.groupBy(*by).agg(F.slice(F.sort_array(F.collect_list("hash")), 1, k).alias("__sketch"))
    same = [parts[b].eqNullSafe(whole[b]) for b in by]
    return parts.join(whole, same, "left").select(*[parts[b] for b in by], "n_parts", F.coalesce("__sketch", F.array().cast("array<bigint>")).alias(column))


def n_distinct(s: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below ``k``, else from the
    ``k``-th smallest hash."""
    return F.when(F.size(s) < k, F.size(s).cast("double")).otherwise(F.lit(float((k - 1) * SPACE)) / F.greatest(F.element_at(s, -1), F.lit(1)))


def shared(a: Column, b: Column, k: int = K) -> Column:
    """(n, both): hashes of the union's sketch and how many of them lie in both."""
    return _once(F.struct(a.alias("a"), b.alias("b"), merge(a, b, k).alias("u")), lambda x: F.struct(
        F.size(x["u"]).alias("n"), F.size(F.array_intersect(F.array_intersect(x["u"], x["a"]), x["b"])).alias("both")))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the shingles of either text that both have; 1 for two empty sketches."""
    return _once(shared(a, b, k), lambda s: F.when(s["n"] == 0, F.lit(1.0)).otherwise(s["both"] / s["n"]))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the shingles of ``a`` that ``b`` has too; 1 for an empty ``a``."""
    both = _once(shared(a, b, k), lambda s: s["both"] / F.greatest(s["n"], F.lit(1))) * n_distinct(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), both / F.greatest(n_distinct(a, k), F.lit(1.0))))


def encode(s: Column) -> Column:
    """A sketch as text: 16 hexadecimal digits a hash."""
    return F.array_join(F.transform(s, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def decode(s: Column) -> Column:
    n = (F.length(s) / 16).cast("int")
    one = lambda i: F.conv(F.substring(s, i * 16 + 1, F.lit(16)), 16, 10).cast("bigint")          # noqa: E731
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), one)).otherwise(F.array().cast("array<bigint>"))


def _place(doc_id: Column, text_hash: Column) -> Column:
    """Descending doc_id, null last, then the text's hash, as an ascending key."""
    return F.struct(F.isnull(doc_id).alias("no_id"), F.bitwise_not(F.coalesce(doc_id, F.lit(0).cast("bigint"))).alias("down"), text_hash.alias("h"))


def _range_of(place: Column, firsts: list) -> Column:
    """Number of the range of keys, given every range's first key: two steps of
    about the root of the number of ranges."""
    step = max(1, int(len(firsts) ** 0.5))
    key = lambda r: F.struct(F.lit(r["no_id"]).alias("no_id"), F.lit(r["down"]).cast("bigint").alias("down"), F.lit(r["h"]).cast("bigint").alias("h"))
    starts = F.array(*[key(r) for r in firsts])
    coarse = F.array(*[key(r) for r in firsts[::step]])
    upto = lambda a: F.size(F.filter(a, lambda k: k <= place))                                     # noqa: E731
    block = F.greatest(upto(coarse), F.lit(1)) - 1
    return block * step + F.greatest(upto(F.slice(starts, block * step + 1, step)), F.lit(1)) - 1


def with_next(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) and ``next_text``: the text of the next row by
    descending doc_id (null last), then text; after the last comes the first.

    The keys alone are sorted by range and written; every range's first key (RANGES a
    shuffle partition) then tells each row its range, the texts are dealt out once,
    and each range is closed by a copy of the next range's first row.  Rows that
    share an id, or have none, are spread by their texts' hashes."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("__h"))
    place = _place(F.col("doc_id"), F.col("__h"))
    keys = keyed.select(place.alias("place")).repartitionByRange(RANGES * parts, "place")
    keys = stage(keys.withColumn("range", F.spark_partition_id()), "fingerprint-keys")
    firsts = [r["first"] for r in keys.groupBy("range").agg(F.min("place").alias("first")).orderBy("range").collect()]      # RANGES a shuffle partition
    if not firsts:
        return docs.select("doc_id", "text", F.lit(None).cast("string").alias("next_text"))
    dealt = keyed.withColumn("__range", _range_of(place, firsts)).withColumn("__end", F.lit(0))
    n = len(firsts)
    heads = F.broadcast(docs.sparkSession.createDataFrame(
        [(bool(r["no_id"]), int(r["down"]), int(r["h"]), (i - 1) % n) for i, r in enumerate(firsts)], "no_id boolean, down bigint, h bigint, before int"))
    closing = keyed.join(heads, (place["no_id"] == F.col("no_id")) & (place["down"] == F.col("down")) & (F.col("__h") == F.col("h"))) \
        .select("before", "text").distinct() \
        .select(F.lit(None).cast("bigint").alias("doc_id"), "text", F.lit(0).cast("bigint").alias("__h"), F.col("before").alias("__range"), F.lit(1).alias("__end"))
    order = Window.partitionBy("__range").orderBy("__end", F.isnull("doc_id"), F.col("doc_id").desc(), "__h", "text")
    # dealt out in as many parts as the session has: what follows is work on the words, not on the bytes
    return dealt.unionByName(closing).repartition(parts, "__range").withColumn("next_text", F.lead("text").over(order)).where("__end = 0").select("doc_id", "text", "next_text")


def fingerprint_edits(docs: DataFrame, k: int = K) -> DataFrame:
    """Fingerprints of every row of ``docs`` (doc_id bigint, text), of its edited
    text and their likeness.

    The edited text has its last third (floor of the code points / 3) replaced by
    as many first code points of the next text of :func:`with_next`, or all of it.

    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next (estimated resemblance to the edited and to the next
    text), n_shingles (estimate), kept_share (estimated containment of the text in
    the edited one).  Null text counts as empty; two wordless texts have likeness 1,
    one wordless text has 0 with any other.  Null doc_ids come last; repeated rows
    stay and follow each other; a single row is its own next.  An empty table gives
    no rows; other columns are ignored; texts are read whole."""
    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    d = with_next(d).withColumn("n", F.length("text"))
    cut = F.floor(F.col("n") / 3).cast("int")
    d = d.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n") - cut), F.substring("next_text", F.lit(1), cut)))
    s = d.select("doc_id", F.col("n").cast("bigint").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                 sketch(F.col("text"), k).alias("own"), sketch(F.col("edited"), k).alias("edit"), sketch(F.col("next_text"), k).alias("next"))
    own, edit, following = F.col("own"), F.col("edit"), F.col("next")
    return s.select("doc_id", "n_chars", "edited_sha256", encode(own).alias("fingerprint"), encode(edit).alias("edited_fingerprint"),
                    resemblance(own, edit, k).alias("near_edited"), resemblance(own, following, k).alias("near_next"),
                    F.round(n_distinct(own, k), 6).alias("n_shingles"), F.round(containment(own, edit, k), 6).alias("kept_share"))


def op12_bottom_k_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents"))


_CRC = ("xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, octet_length(encode(w)) + 1), "
        "lambda i: ('0x' || substr(hex(w), 2 * i - 1, 2))::bigint)), lambda c, b: list_reduce(list_prepend(xor(c, b), range(0, 8)), "
        "lambda x, j: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)")
_MIX = " + ".join(f"h[i + {j}] * {w}" for j, w in enumerate(WEIGHTS))
_NEAR = """CASE WHEN len({a}) + len({b}) = 0 THEN 1.0 ELSE
  len(list_filter(list_slice(list_sort(list_distinct(list_concat({a}, {b}))), 1, %d), lambda x: list_contains({a}, x) AND list_contains({b}, x)))
  / len(list_slice(list_distinct(list_concat({a}, {b})), 1, %d)) END""" % (K, K)
_HEX = "array_to_string(list_transform({a}, lambda x: printf('%016x', x)), '')"
_COUNT = f"CASE WHEN len({{a}}) < {K} THEN len({{a}})::double ELSE {float((K - 1) * SPACE)!r} / list_last({{a}}) END"
_UNION = f"list_slice(list_sort(list_distinct(list_concat(own, edit))), 1, {K})"
ORACLE = {"op12_bottom_k_fingerprints": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
nx AS (SELECT doc_id, text, length(text) AS n, coalesce(lead(text) OVER o, first_value(text) OVER o) AS next_text FROM d WINDOW o AS (ORDER BY doc_id DESC)),
ed AS (SELECT *, substr(text, 1, n - n // 3) || substr(next_text, 1, n // 3) AS edited FROM nx),
kinds AS (SELECT DISTINCT unnest([text, edited]) AS t FROM ed),
ws AS (SELECT t, list_filter(regexp_split_to_array(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS l FROM kinds),
vocabulary AS (SELECT w, {_CRC} AS c FROM (SELECT DISTINCT unnest(l) AS w FROM ws)),
placed AS (SELECT t, unnest(l) AS w, unnest(range(0, len(l))) AS i FROM ws),
hashed AS (SELECT t, list(c ORDER BY i) AS h FROM placed JOIN vocabulary USING (w) GROUP BY t),
filled AS (SELECT t, list_concat(h, list_transform(range(len(h), {WIDTH}), lambda x: 0::bigint)) AS h FROM hashed),
sk AS (SELECT t, list_slice(list_sort(list_distinct(list_transform(list_transform(range(1, len(h) - {WIDTH - 2}), lambda i: {_MIX}),
       lambda m: (m % {HIGH}) * 2147483648 + m % {LOW}))), 1, {K}) AS s FROM filled),
z AS (SELECT doc_id, n, edited, coalesce(a.s, []::bigint[]) AS own, coalesce(b.s, []::bigint[]) AS edit, coalesce(c.s, []::bigint[]) AS nxt
      FROM ed LEFT JOIN sk a ON a.t = text LEFT JOIN sk b ON b.t = edited LEFT JOIN sk c ON c.t = next_text),
n AS (SELECT *, {_NEAR.format(a="own", b="edit")} AS ne, {_NEAR.format(a="own", b="nxt")} AS nn, {_COUNT.format(a="own")} AS n_own, {_COUNT.format(a=f"({_UNION})")} AS n_union FROM z)
SELECT doc_id, n AS n_chars, sha256(edited) AS edited_sha256, {_HEX.format(a="own")} AS fingerprint, {_HEX.format(a="edit")} AS edited_fingerprint,
       ne::double AS near_edited, nn::double AS near_next, round(n_own, 6) AS n_shingles,
       round(CASE WHEN len(own) = 0 THEN 1.0 ELSE least(1.0, ne * n_union / n_own) END, 6)::double AS kept_share
FROM n"""}
QUERIES = {"op12_bottom_k_fingerprints": op12_bottom_k_fingerprints}
