"""Substring dedup over sliding sentence spans.

Every run of consecutive sentences is hashed; a global join finds runs that occur
more than once, and the sentences covered by any occurrence but the first
(smallest doc_id, then text, then position) are removed.

A sentence ends at a line's end or after a word that ends in ``.``, ``!`` or ``?``.
A long one goes on as several: it is cut at places that the words around decide,
so copies of a passage are cut alike whatever stands before it.  A run has ``RUN``
sentences, and more where they hold fewer than ``MIN_WORDS`` words: less is a
phrase.  Any repeated passage of 51 words holds a whole run, as it loses at most
``MAX_WORDS`` - 1 words at either end and a run takes at most
``MIN_WORDS`` + ``MAX_WORDS`` - 1.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship_by_value, stage, table, text_key

#: Least sentences and words of a run.
RUN, MIN_WORDS = 3, 24
#: Most words of a sentence; a longer one is cut into parts of LEAST_WORDS to
#: 2 * LEAST_WORDS - 1 words.
MAX_WORDS, LEAST_WORDS = 9, 4
#: A sentence ends after a word that ends in one of these, or at a line's end.
ENDS = b".!?"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Hashes of words that a task keeps.
MEMO_WORDS = 400_000
_memo: dict = {}


def hashed(words: list[bytes]) -> list[int]:
    if len(_memo) > MEMO_WORDS:
        _memo.clear()
    for w in set(words):
        if w not in _memo:
            _memo[w] = xxhash.xxh64_intdigest(w)
    return list(map(_memo.__getitem__, words))


def parts(hashes: list[int]) -> list[int]:
    """Places where the parts of a long sentence start, LEAST_WORDS to
    2 * LEAST_WORDS - 1 words apart, the first one left out: words are taken by their
    hash unless one closer than LEAST_WORDS is taken, so what is taken depends on the
    words around only."""
    n, near = len(hashes), LEAST_WORDS - 1
    taken, closed = [], bytearray(n)
    for i in (*range(min(n, near + 1)), *range(max(0, n - near), n)):
        closed[i] = 1
    shut = b"\1" * (2 * near + 1)
    for i in sorted(range(n), key=hashes.__getitem__):
        if not closed[i]:
            taken.append(i)
            closed[i - near:i + near + 1] = shut
    taken.sort()
    return taken


def cut_words(text: str) -> tuple[list[bytes], list[int], list[int]]:
    """Normalised words of a text, their hashes, and the places where its sentences start, then the words' number."""
    words, ends = [], []
    for line in text.encode("utf-8", "surrogatepass").lower().split(b"\n"):
        words += line.split()
        ends.append(len(words))
    ends += [i for i, w in enumerate(words, 1) if w[-1] in ENDS]
    if not words:
        return words, [], []
    hashes, cuts = hashed(words), [0]
    for end in sorted(set(ends)):
        start = cuts[-1]
        if end - start > MAX_WORDS:
            cuts += [start + i for i in parts(hashes[start:end])]
        if end > start:
            cuts.append(end)
    return words, hashes, cuts


def sentences(text: str) -> list[tuple[int, int, bytes, int]]:
    """(start, end, normalised words, number of words) of the sentences of a text;
    ends reach to the next sentence's start, so that the sentences cover the text
    from the first word on."""
    words, _, cuts = cut_words(text)
    at = [w.start() for w in WORD.finditer(text)]
    ends = [at[c] for c in cuts[1:-1]] + [len(text)]
    return [(at[a], e, b" ".join(words[a:b]), b - a) for a, b, e in zip(cuts, cuts[1:], ends)]


def run_ends(cuts: list[int], run: int, least: int) -> list[tuple[int, int]]:
    """(first sentence, sentence after the last) of every run: ``run`` sentences, and
    further ones up to ``least`` words."""
    out, j, n = [], 0, len(cuts) - 1
    for i in range(n):
        j = max(j, i + run)
        while j <= n and cuts[j] - cuts[i] < least:
            j += 1
        if j > n:
            break
        out.append((i, j))
    return out


def runs(hashes: list[int], cuts: list[int], run: int, least: int) -> list[tuple[int, int]]:
    """(hash, place of the first sentence) of every run."""
    data = np.array(hashes, np.uint64).tobytes()
    return [(xxhash.xxh64_intdigest(data[8 * cuts[i]:8 * cuts[j]], seed=j - i) - 2**63, i) for i, j in run_ends(cuts, run, least)]


def _runs(run: int, least: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, keys, hashes, at, again = [], [], [], [], []
            for doc_id, key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                seen: set = set()
                _, hashed_words, cuts = cut_words(text.as_py() or "")
                # one row tells the document's number of sentences
                ids.append(doc_id)
                keys.append(key)
                hashes.append(None)
                at.append(max(0, len(cuts) - 1))
                again.append(None)
                for h, i in runs(hashed_words, cuts, run, least):
                    ids.append(doc_id)
                    keys.append(key)
                    hashes.append(h)
                    at.append(i)
                    again.append(h in seen)                      # not the first one even within its text
                    seen.add(h)
                if len(ids) > 200_000:
                    yield _batch(ids, keys, hashes, at, again)
                    ids, keys, hashes, at, again = [], [], [], [], []
            yield _batch(ids, keys, hashes, at, again)
    return emit


def _batch(ids, keys, hashes, at, again) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(hashes, pa.int64()), pa.array(at, pa.int32()), pa.array(again, pa.bool_())],
                                      ["doc_id", "key", "hash", "at", "again"])


def _cutter(run: int, least: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total, gone, lost, spans, texts = [], [], [], [], []
            for text, starts, n in zip(b.column(1), b.column(2), b.column(3)):
                text, starts = text.as_py(), starts.as_py()
                if not starts:
                    total.append(n.as_py())
                    gone.append(0)
                    lost.append(0)
                    spans.append("")
                    texts.append(text)
                    continue
                found = sentences(text or "")
                words = np.cumsum([0, *(p[3] for p in found)]).tolist()
                upto = dict(run_ends(words, run, least))
                covered = sorted({k for i in starts for k in range(i, upto[i])})
                total.append(len(found))
                gone.append(len(covered))
                lost.append(sum(found[i][3] for i in covered))
                merged: list[list[int]] = []
                for i in covered:
                    if merged and merged[-1][1] == found[i][0]:
                        merged[-1][1] = found[i][1]
                    else:
                        merged.append([found[i][0], found[i][1]])
                spans.append(",".join(f"{a}:{e}" for a, e in merged))
                if merged:
                    kept, at = [], 0
                    for a, e in merged:
                        kept.append(text[at:a])
                        at = e
                    text = "".join([*kept, text[at:]])
                texts.append(text)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(lost, pa.int64()), pa.array(spans, pa.string()), pa.array(texts, pa.string())],
                ["doc_id", "n_sentences", "n_removed", "removed_words", "spans", "text"])
    return cut


def remove_repeats(docs: DataFrame, run: int = RUN, least: int = MIN_WORDS) -> DataFrame:
    """``docs`` (doc_id bigint, text) without repeated sentence spans.

    Columns: doc_id, n_sentences, n_removed, removed_words, spans (removed
    start:end in code points, comma-joined), text (what is left).

    Null or empty text: no sentences, text unchanged.  Rows that share a doc_id (or
    have none) are told apart by their texts, which also decide whose occurrence is
    first; rows with the same id and text are one document and are cut alike.  A null
    doc_id sorts after all others.  An empty table gives no rows; other columns are
    ignored; texts are read whole."""
    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_key(F.col("text").cast("string")).alias("key"), F.col("text").cast("string").alias("text"))
    every = stage(d.mapInArrow(_runs(run, least), "doc_id bigint, key bigint, hash bigint, at int, again boolean"), "spans-runs")
    r = every.where("hash IS NOT NULL")
    # runs of several documents: one row each, whatever the number of occurrences
    shared = r.groupBy("hash").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count_if(F.col("doc_id").isNull()).alias("no_id"),
                                   F.min("key").alias("k0"), F.max("key").alias("k1"))
    shared = stage(shared.where("first < last OR (no_id > 0 AND first IS NOT NULL) OR k0 < k1").select("hash", "first"), "spans-shared")
    many = stage(r.join(shared, "hash").select("hash", "doc_id", "key", "at", F.col("doc_id").eqNullSafe(F.col("first")).alias("holds")), "spans-many")
    first = many.where("holds").groupBy("hash").agg(F.min("key").alias("first_key"))
    across = many.join(first, "hash").where(~(F.col("holds") & (F.col("key") == F.col("first_key")))).select("doc_id", "key", "at")
    starts = across.union(r.where("again").select("doc_id", "key", "at")).withColumn("n", F.lit(None).cast("int"))
    sizes = every.where("hash IS NULL").select("doc_id", "key", F.lit(None).cast("int").alias("at"), F.col("at").alias("n"))
    cuts = starts.union(sizes).groupBy(F.col("doc_id").alias("__id"), F.col("key").alias("__key")).agg(F.collect_set("at").alias("starts"), F.max("n").alias("n"))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("key") == F.col("__key"))
    out = d.join(stage(cuts, "spans-cuts"), same, "left").select("doc_id", "text", "starts", "n")
    return out.mapInArrow(_cutter(run, least), "doc_id bigint, n_sentences bigint, n_removed bigint, removed_words bigint, spans string, text string")


def op6_sentence_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


ORACLE: dict[str, str] = {}
QUERIES = {"op6_sentence_span_dedup": op6_sentence_span_dedup}
ship_by_value(__name__)
