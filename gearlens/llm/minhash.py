"""MinHash near-duplicate detection with min-max signatures.

Under each permutation of the shingle space both the minimum and the maximum of
a document's shingle hashes are kept, so ``PERMUTATIONS`` hash evaluations give
twice as many signature values; bands of ``ROWS`` values are the buckets.

1. Documents with equal shingle sets fold into one class (its smallest doc_id).
2. Each class is compared with the smallest class of each of its buckets, on
   full shingle sets; the confirmed links give components.
3. The classes of buckets that are still in several components are compared
   across components by an exact prefix-filter join on their shingles, so that
   no link between bucket partners is lost and no group is paired with itself.
4. Components of all confirmed links, by least-label propagation with pointer
   jumping over staged tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ship_by_value, stage, table

#: Words of a shingle and the similarity of a link (100 * common >= SIMILARITY * union).
WIDTH, SIMILARITY = 2, 80
#: 120 permutations give 240 values: 40 bands of 6.  A pair at similarity 0.8
#: shares no band with probability (1 - 0.8^6)^40 = 5e-6, at 0.2 one with 0.0026.
PERMUTATIONS, ROWS = 120, 6
SEED = 20240229
#: Words whose hashes a task remembers before it starts anew.
MEMO_WORDS = 400_000
CHUNK = 2048


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, memo: dict, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text; fewer words than
    ``width`` are one shingle, none give the empty set."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(memo) > MEMO_WORDS:
        memo.clear()
    for w in set(words):
        if w not in memo:
            memo[w] = xxhash.xxh64_intdigest(w)
    h = np.array([memo[w] for w in words], np.uint64)
    n = min(width, len(words))
    s = np.full(len(words) - n + 1, n, np.uint64)
    for i in range(n):
        s = _mix(s * np.uint64(0x9E3779B97F4A7C15) + h[i:len(words) - n + 1 + i])
    return np.unique(s)


def permutations(count: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(seed)
    return r.integers(0, 2**64, count, np.uint64) | np.uint64(1), r.integers(0, 2**64, count, np.uint64)


def min_max(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minima, then maxima, of the shingle hashes under each permutation."""
    low, high = np.full(len(a), np.iinfo(np.uint64).max, np.uint64), np.zeros(len(a), np.uint64)
    for i in range(0, len(shingles), CHUNK):
        v = shingles[i:i + CHUNK, None] * a + b
        np.minimum(low, v.min(0), out=low)
        np.maximum(high, v.max(0), out=high)
    return np.concatenate([low, high])


def band_hashes(signature: np.ndarray, rows: int) -> np.ndarray:
    bands = signature.reshape(-1, rows)
    h = np.arange(len(bands), dtype=np.uint64)
    for i in range(rows):
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + bands[:, i])
    return h.view(np.int64)


def _digest(shingles: np.ndarray) -> tuple[int, int]:
    d = np.frombuffer(xxhash.xxh128_digest(shingles.tobytes()), np.int64)
    return int(d[0]), int(d[1])


def _signer(count: int, rows: int, width: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict = {}
        a, b = permutations(count)
        for batch in batches:
            ids, n, c1, c2, bands = [], [], [], [], []
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                s = shingle_set(text.as_py(), memo, width)
                ids.append(doc_id)
                n.append(len(s))
                one, two = _digest(s)
                c1.append(one)
                c2.append(two)
                bands.append(band_hashes(min_max(s, a, b), rows) if len(s) else np.empty(0, np.int64))
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in bands])]).astype(np.int32)
            flat = np.concatenate(bands) if bands else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(c1, pa.int64()), pa.array(c2, pa.int64()),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["doc_id", "n_shingles", "c1", "c2", "bands"])
    return sign


def _setter(width: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict = {}
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([shingle_set(t.as_py(), memo, width).tobytes() for t in batch.column(1)], pa.binary())],
                ["doc_id", "shingles"])
    return sets


def _lister(width: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict = {}
        for batch in batches:
            found = [shingle_set(t.as_py(), memo, width) for t in batch.column(1)]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
            flat = np.concatenate(found).view(np.int64) if found else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets), pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
                                             ["rep", "size", "shingles"])
    return sets


def _linker(similarity: int):
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= similarity * (len(x) + len(y) - common))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])
    return link


def confirm(pairs: DataFrame, docs: DataFrame, width: int = WIDTH, similarity: int = SIMILARITY) -> DataFrame:
    """The (a, b) of ``pairs`` (distinct) whose full shingle sets are similar.  Only
    documents of a pair are shingled again; a much-paired document is spread by
    the skew join, since both sides of each join are plain exchanges."""
    ids = stage(pairs.select(F.explode(F.array("a", "b")).alias("__id")).distinct(), "minhash-ids")
    some = docs.select("doc_id", "text").join(ids, F.col("doc_id") == F.col("__id"), "left_semi")
    sets = stage(some.dropDuplicates(["doc_id"]).mapInArrow(_setter(width), "doc_id bigint, shingles binary"), "minhash-sets")
    p = pairs.select("a", "b").join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa")), "a")
    p = p.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb")), "b")
    return p.select("a", "b", "sa", "sb").mapInArrow(_linker(similarity), "a bigint, b bigint")


def prefix_pairs(crowd: DataFrame, docs: DataFrame, width: int, similarity: int) -> DataFrame:
    """(a, b), a > b: pairs of ``crowd`` (rep, label) of different label that can be similar.

    Exact prefix and position filter: with each set in one order, rarest shingles
    first, similar sets share a shingle early, and the first shared one leaves
    room for the rest of the overlap.  The shingles that edits brought in are
    rare, so copies that are edited too far meet no one.  For each shingle only
    rows outside its most frequent label look for partners, so that a large
    component isn't compared with itself."""
    some = docs.join(crowd.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    sets = some.select("doc_id", "text").mapInArrow(_lister(width), "rep bigint, size bigint, shingles array<bigint>")
    rows = stage(sets.select("rep", "size", F.explode("shingles").alias("g")), "minhash-shingles")
    often = stage(rows.groupBy("g").agg(F.count(F.lit(1)).alias("df")), "minhash-frequencies")
    place = F.row_number().over(Window.partitionBy("rep").orderBy("df", "g")) - 1
    early = rows.join(often, "g").withColumn("i", place).where((100 * (F.col("size") - F.col("i")) >= similarity * F.col("size")) & (F.col("df") > 1))
    early = stage(early.join(crowd, "rep").select("rep", "label", "size", "g", "i"), "minhash-prefixes")
    labels = early.groupBy("g", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("g").agg(
        F.max(F.struct("n", "label"))["label"].alias("most"), F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("g", "most")
    labels = stage(labels, "minhash-labels")
    y = early.join(labels, "g").select(*[F.col(c).alias(f"y_{c}") for c in ("rep", "label", "size", "g", "i")])
    x = early.join(labels, "g").where("label <> most")
    room = F.least(F.col("size") - F.col("i"), F.col("y_size") - F.col("y_i"))
    pairs = x.join(y, (F.col("g") == F.col("y_g")) & (F.col("label") != F.col("y_label"))
                   & ((100 + similarity) * room >= similarity * (F.col("size") + F.col("y_size"))))
    return pairs.select(F.greatest("rep", "y_rep").alias("a"), F.least("rep", "y_rep").alias("b")).distinct()


def _repeats(docs: DataFrame) -> bool:
    return docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count() > 0


def components(links: DataFrame) -> DataFrame:
    """(v, label) for every end of ``links`` (a, b): the smallest vertex it reaches.

    Least-label propagation with pointer jumping; every round is written to the
    shared folder, and both sides of each join are scans of such files, so hubs
    are split by the skew join.  Rounds grow with the logarithm of the longest
    path; none is cut off."""
    e = stage(links.select("a", "b").union(links.select("b", "a")).distinct(), "cc-edges")
    lab = stage(e.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("label")), "cc-labels")
    while True:
        # the labels of the neighbours, and the label of the own label
        far = e.join(lab.select(F.col("v").alias("b"), F.col("label")), "b").groupBy(F.col("a").alias("v")).agg(F.min("label").alias("far"))
        jump = lab.select("v", F.col("label").alias("at")).join(lab.select(F.col("v").alias("at"), F.col("label").alias("jump")), "at")
        new = stage(jump.select("v", "at", "jump").join(far, "v")
                    .select("v", F.least("jump", "far").alias("label"), (F.least("jump", "far") < F.col("at")).alias("moved")), "cc-labels")
        lab = new.select("v", "label")
        if new.where("moved").limit(1).count() == 0:
            return lab


def near_duplicates(docs: DataFrame, width: int = WIDTH, similarity: int = SIMILARITY, perms: int = PERMUTATIONS, rows: int = ROWS) -> DataFrame:
    """Components of similar documents of ``docs`` (doc_id bigint, text).

    Columns: doc_id, n_shingles, class_id (smallest doc_id with the same set),
    component_id (smallest doc_id reachable), kept.

    Null, empty or blank text: the empty set, linked with nothing, kept.  Rows
    with a null doc_id are not linked: component null, kept.  Rows that repeat a
    doc_id are one document (with differing texts, any one of them is compared).
    An empty table gives no rows; other columns are ignored.
    """
    if perms * 2 % rows:
        raise ValueError("rows must divide the number of signature values")
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = docs.mapInArrow(
        _signer(perms, rows, width), "doc_id bigint, n_shingles bigint, c1 bigint, c2 bigint, bands array<bigint>")
    signed = stage(signed, "minhash-signed")
    usable = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = stage(usable.groupBy("c1", "c2", "n_shingles").agg(F.min("doc_id").alias("rep")), "minhash-classes")
    heads = classes.select(F.col("rep").alias("doc_id"), "c1", "c2").join(usable, ["doc_id", "c1", "c2"])
    heads = heads.select(F.explode("bands").alias("bucket"), F.col("doc_id").alias("rep"), F.col("n_shingles").alias("size"))
    shared = heads.groupBy("bucket").agg(F.min("rep").alias("head"), F.max("rep").alias("last")).where("head < last").select("bucket", "head")
    members = stage(heads.join(stage(shared, "minhash-buckets"), "bucket"), "minhash-members")

    stars = stage(members.where("rep <> head").select(F.col("rep").alias("a"), F.col("head").alias("b")).distinct(), "minhash-stars")
    links = stage(confirm(stars, docs, width, similarity), "minhash-links")
    part = components(links)

    # classes of buckets that the links left in several parts: all their links across parts, by an exact join
    m = members.join(part.withColumnRenamed("v", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    m = stage(m.select("bucket", "rep", "size", "label"), "minhash-parts")
    open_ = stage(m.groupBy("bucket").agg(F.min("label").alias("l"), F.max("label").alias("r"), F.count(F.lit(1)).alias("n"))
                  .where("l < r AND n > 2").select("bucket"), "minhash-open")
    crowd = stage(m.join(open_, "bucket").select("rep", "label").distinct(), "minhash-crowd")
    rest = prefix_pairs(crowd, docs, width, similarity).join(stars, ["a", "b"], "left_anti")
    rest = stage(rest, "minhash-rest-pairs")
    if rest.limit(1).count():
        more = stage(confirm(rest, docs, width, similarity), "minhash-more-links")
        if more.limit(1).count():
            part = components(links.union(more))

    named = classes.join(part.withColumnRenamed("v", "rep"), "rep", "left") \
        .select("c1", "c2", F.col("n_shingles").alias("__n"), F.col("rep").alias("class_id"), F.coalesce("label", "rep").alias("component_id"))
    named = stage(named, "minhash-named")
    out = signed.drop("bands").join(named, (signed["c1"] == named["c1"]) & (signed["c2"] == named["c2"]) & (signed["n_shingles"] == named["__n"])
                                    & (signed["n_shingles"] > 0), "left")
    own = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    own = F.when(F.col("doc_id").isNotNull(), own)
    return out.select("doc_id", "n_shingles", F.coalesce("class_id", "doc_id").alias("class_id"), own.alias("component_id"),
                      F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"))


def deduplicate(docs: DataFrame, **options) -> DataFrame:
    """One document of each component: the one with the smallest doc_id, with all
    columns of ``docs``.  Of rows that repeat that doc_id one stays."""
    verdict = near_duplicates(docs, **options).where("NOT kept").select(F.col("doc_id").alias("__id")).distinct()
    kept = docs.join(verdict, F.col("doc_id") == F.col("__id"), "left_anti")
    if _repeats(docs.where("doc_id IS NOT NULL")):
        one = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text")
        kept = kept.withColumn("__r", F.when(F.col("doc_id").isNotNull(), F.row_number().over(one)).otherwise(1)).where("__r = 1").drop("__r")
    return kept


def op1_minmax_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


_SQL_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: Every pair of documents with a common shingle, and the closure of the links.
ORACLE = {"op1_minmax_near_dedup": f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_SQL_LOWER}, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 1 THEN [ws[1]] ELSE
  list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS g FROM w WHERE len(ws) > 0),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
sized AS MATERIALIZED (SELECT s.*, n.n FROM s JOIN n USING (doc_id)),
links AS MATERIALIZED (SELECT a, b FROM (
  SELECT x.doc_id AS a, y.doc_id AS b, any_value(x.n) AS na, any_value(y.n) AS nb, count(*) AS c FROM sized x JOIN sized y
  ON x.g = y.g AND x.doc_id <> y.doc_id AND 100 * x.n >= 80 * y.n AND 100 * y.n >= 80 * x.n GROUP BY 1, 2) WHERE 100 * c >= 80 * (na + nb - c)),
reach AS (SELECT a, a AS b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
comp AS (SELECT a, min(b) AS c FROM reach GROUP BY a),
sets AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY l) AS class_id FROM (SELECT doc_id, list_sort(list(g)) AS l FROM s GROUP BY doc_id))
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, coalesce(class_id, w.doc_id) AS class_id, coalesce(c, w.doc_id) AS component_id,
  coalesce(c, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN comp ON w.doc_id = comp.a LEFT JOIN sets ON sets.doc_id = w.doc_id"""}
QUERIES = {"op1_minmax_near_dedup": op1_minmax_near_dedup}
ship_by_value(__name__)
