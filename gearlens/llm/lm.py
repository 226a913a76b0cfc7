"""Language-model scoring with a weighted backoff automaton.

An n-gram of the training texts is an arc with its log weight, and as the context
of longer ones a state with its backoff weight; the failure arc of a state leads
to its context without the first word.  All n-grams are kept at any size of the
corpus.  A text is scored by one walk from left to right that carries the state:
an arc of the state where there is one, else its failure arc and the arcs of the
next shorter state.

The automaton is never gathered.  Tasks collect blocks of texts, and a block asks
for what its own n-grams need: its distinct (two-word context, follower) keys go
to one exchange by context, where they also bring the training counts.  Answers
come back in the order of the keys, so they carry counts alone.  In each context
one block is told to count it for the context's last but one word, which gives
the one-word states by a second, small exchange of words.  Then the arcs and
failure weights of a block's n-grams are attached to its texts, and the walk
runs.  Exchanges that are over are given back.

In a bucket of the exchange a context is known by ``CONTEXT_BITS`` bits of its hash
and a follower by ``FOLLOWER_BITS``; buckets grow in number with the corpus, so about one
context in a hundred thousand shares its key with another, at any size.
"""

from __future__ import annotations

import gc
import os
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship_by_value, stage, table

#: Longest n-gram, absolute discount.
ORDER, DISCOUNT = 3, 0.75
#: Token that ends every text, and what follows it; no word holds a space.
END, AFTER = xxhash.xxh64_intdigest(b" "), xxhash.xxh64_intdigest(b"  ")
MEMO_WORDS = 400_000
#: Tokens of a block, and of a bucket of the exchange.
BLOCK_TOKENS, BUCKET_TOKENS = 1_500_000, 2_000_000
CONTEXT_BITS, FOLLOWER_BITS = 36, 28
#: Texts that walk side by side; fewer walk one by one.
ABREAST = 64
BLOCKS = "block bigint, doc_ids array<bigint>, flags binary, lens binary, words binary, tokens binary, n_train bigint"
ASKED = "bucket bigint, block bigint, keys binary, counts binary"
ANSWER = "block bigint, bucket bigint, answer binary"
SCORES = "doc_id bigint, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
#: Kinds of answers to a block.
CONTEXT, WORD = 1, 2
#: Flags of a text.
LEARN, SCORE = 1, 2


def pack(x: np.ndarray, kind=np.uint32) -> bytes:
    """Unsigned numbers, byte by byte (all first bytes, then all second ones), compressed."""
    x = np.ascontiguousarray(x, kind)
    return zstandard.compress(x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes(), 1)


def unpack(b: bytes, kind=np.uint32) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(b), np.uint8).reshape(size, -1).T).view(kind).ravel()


def pack_sorted(x: np.ndarray) -> bytes:
    return pack(np.diff(x, prepend=np.uint64(0)), np.uint64)


def unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(unpack(b, np.uint64), dtype=np.uint64)


def join(parts: list[bytes]) -> bytes:
    return b"".join([len(p).to_bytes(4, "little") + p for p in parts])


def split(b: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(b):
        n = int.from_bytes(b[at:at + 4], "little")
        out.append(b[at + 4:at + 4 + n])
        at += 4 + n
    return out


# ---------------------------------------------------------------------------
# Blocks of texts
# ---------------------------------------------------------------------------
def tokens(text: str | None, memo: dict) -> list[int]:
    """Hashes of the lower-cased words, then the end token."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(memo) > MEMO_WORDS:
        memo.clear()
    for w in set(words):
        if w not in memo:
            memo[w] = xxhash.xxh64_intdigest(w)
    out = [memo[w] for w in words]
    out.append(END)
    return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memo: dict = {}
    ids, flags, texts, size = [], [], [], 0

    def block() -> pa.RecordBatch:
        lens = np.array([len(t) for t in texts])
        words, place, n = np.unique(np.concatenate(texts), return_inverse=True, return_counts=True)
        order = np.argsort(-n, kind="stable")                                             # frequent words get small numbers
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        train = int(lens[np.array(flags) & LEARN > 0].sum())
        values = [int.from_bytes(os.urandom(8), "little") >> 1, ids, bytes(flags), pack(lens), pack(words[order], np.uint64), pack(rank[place]), train]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, (pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 4, pa.int64()))],
                                          [f.split()[0] for f in BLOCKS.split(", ")])

    for b in batches:
        for doc_id, flag, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            ids.append(doc_id)
            flags.append(flag)
            texts.append(np.array(tokens(text.as_py(), memo), np.uint64))
            size += len(texts[-1])
            if size >= BLOCK_TOKENS:
                yield block()
                ids, flags, texts, size = [], [], [], 0
    if ids:
        yield block()


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of a pair of hashes."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(30))


class Texts:
    """A block: word hashes, tokens as numbers of words, and its bigrams.

    ``second`` are the places of tokens that have one before them.  A bigram ends at
    each; its key is its hash as a context and the hash of what follows."""

    def __init__(self, row: dict):
        self.row = row
        self.flags, self.lens = np.frombuffer(row["flags"], np.uint8), unpack(row["lens"]).astype(np.int64)
        self.words, self.tokens = unpack(row["words"], np.uint64), unpack(row["tokens"]).astype(np.int64)
        self.start = np.cumsum(self.lens) - self.lens
        self.learn = np.repeat(self.flags & LEARN > 0, self.lens)
        first = np.zeros(len(self.tokens), bool)
        first[self.start] = True
        self.second = np.flatnonzero(~first)

    def asked(self, bits: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
        """(keys sorted by bucket, number of each bigram's key, where the buckets begin and end)."""
        h = self.words[self.tokens]
        ahead = np.append(h[1:], np.uint64(AFTER))
        ahead[self.start + self.lens - 1] = AFTER
        context = mix(h[self.second - 1], h[self.second])
        follower = mix(ahead[self.second], ahead[self.second]) >> np.uint64(64 - FOLLOWER_BITS)
        bucket = (context >> np.uint64(64 - bits)).astype(np.uint32) if bits else np.zeros(len(context), np.uint32)
        key = ((context << np.uint64(bits)) >> np.uint64(64 - CONTEXT_BITS)) << np.uint64(FOLLOWER_BITS) | follower
        order = np.argsort(bucket, kind="stable")
        upto = np.searchsorted(bucket[order], np.arange((1 << bits) + 1))
        keys, number, ends, n = [], np.empty(len(key), np.int64), [], 0
        for lo, hi in zip(upto, upto[1:]):
            some, place = np.unique(key[order[lo:hi]], return_inverse=True)
            number[order[lo:hi]] = place + n
            keys.append(some)
            ends.append((n, n + len(some)))
            n += len(some)
        return np.concatenate(keys), number, ends


def contexts(keys: np.ndarray, ends: list[tuple[int, int]]) -> np.ndarray:
    """Whether each key is the first one of its context."""
    if not len(keys):
        return np.zeros(0, bool)
    c = keys >> np.uint64(FOLLOWER_BITS)
    first = np.append(True, c[1:] != c[:-1])
    first[[lo for lo, hi in ends if lo < hi]] = True
    return first


# ---------------------------------------------------------------------------
# The exchange by context, and the one by word
# ---------------------------------------------------------------------------
def _ask(bits: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                t = Texts(row)
                keys, number, ends = t.asked(bits)
                counts = np.bincount(number, t.learn[t.second], len(keys)).astype(np.int64)
                rows = [(i, row["block"], pack_sorted(keys[lo:hi]), pack(counts[lo:hi])) for i, (lo, hi) in enumerate(ends) if lo < hi]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary(), pa.binary()))],
                                                     ["bucket", "block", "keys", "counts"])
    return ask


def _sum_contexts(t):
    """The answers of one bucket: to each block, in the order of its keys, the count of
    every n-gram; then of every context its count, its distinct followers, and whether
    this block is the one that counts it."""
    t = t.sort_by("block")
    keys, counts = [unpack_sorted(k) for k in t["keys"].to_pylist()], [unpack(c) for c in t["counts"].to_pylist()]
    sizes = np.array([len(k) for k in keys])
    every, place = np.unique(np.concatenate(keys), return_inverse=True)
    own, of = np.concatenate(counts), np.repeat(np.arange(len(keys)), sizes)
    total = np.bincount(place, own, len(every)).astype(np.int64)
    first = contexts(every, [(0, len(every))])
    context = np.cumsum(first) - 1
    c2, d2 = np.bincount(context, total).astype(np.int64), np.bincount(context, total > 0).astype(np.int64)
    owner = np.full(len(c2), len(keys))
    np.minimum.at(owner, context[place[own > 0]], of[own > 0])
    out = []
    for i, (lo, hi) in enumerate(zip(np.cumsum(sizes) - sizes, np.cumsum(sizes))):
        here = place[lo:hi]
        mine = context[here]
        mine = mine[np.append(True, mine[1:] != mine[:-1])]
        out.append(join([pack(total[here]), pack(c2[mine]), pack(d2[mine]), pack(owner[mine] == i, np.uint8)]))
    return pa.table({"block": t["block"], "bucket": t["bucket"], "answer": pa.array(out, pa.binary())})


def _sum_words(t):
    """The answers of one bucket of words: to each block every word's count and distinct
    followers; the row without a block holds the number of distinct words."""
    t = t.sort_by("block")
    keys = [unpack_sorted(k) for k in t["keys"].to_pylist()]
    counts = [[unpack(x) for x in split(c)] for c in t["counts"].to_pylist()]
    every, place = np.unique(np.concatenate(keys), return_inverse=True)
    c1, d1 = (np.bincount(place, np.concatenate([c[k] for c in counts]), len(every)).astype(np.int64) for k in (0, 1))
    ends = np.cumsum([len(k) for k in keys])
    out = [join([pack(c1[place[lo:hi]]), pack(d1[place[lo:hi]])]) for lo, hi in zip([0, *ends[:-1]], ends)]
    return pa.table({"block": pa.chunked_array([t["block"].combine_chunks(), pa.array([None], pa.int64())]),
                     "bucket": pa.array([*t["bucket"].to_pylist(), int((c1 > 0).sum())], pa.int64()), "answer": pa.array([*out, None], pa.binary())})


def attached(t: Texts, answers: list[bytes], bits: int) -> tuple[np.ndarray, ...]:
    """By bigram of the texts: count of the n-gram that goes on from it, its own count and
    distinct followers as a state; then (word before, whether this block counts it) by context."""
    keys, number, ends = t.asked(bits)
    context = np.cumsum(contexts(keys, ends)) - 1
    parts = [split(a) for a in answers]
    c3, c2, d2 = (np.concatenate([unpack(a[k]) for a in parts] or [np.zeros(0, np.uint32)]).astype(np.int64) for k in range(3))
    mine = np.concatenate([unpack(a[3], np.uint8) for a in parts] or [np.zeros(0, np.uint8)]) > 0
    at = context[number] if len(number) else np.zeros(0, np.int64)
    word = np.full(len(c2), -1)
    word[at] = t.tokens[t.second - 1]
    return c3[number], c2[at], d2[at], word, mine


def _by_bucket(right: pa.Table, kind: int) -> list[bytes]:
    some = right.filter(pc.equal(right["kind"], kind)).sort_by("bucket")
    return some["answer"].to_pylist()


def _ask_words(bits: int, word_bits: int):
    def ask(key, left, right):
        """A block's words with their training counts and the followers that this block counts."""
        row = left.to_pylist()[0]
        t = Texts(row)
        _, _, _, word, mine = attached(t, _by_bucket(right, CONTEXT), bits)
        followers, counts = np.bincount(word[mine], minlength=len(t.words)), np.bincount(t.tokens[t.learn], minlength=len(t.words))
        order = np.argsort(t.words)
        upto = np.searchsorted(t.words[order] >> np.uint64(64 - word_bits), np.arange((1 << word_bits) + 1)) if word_bits else [0, len(t.words)]
        rows = [(i, row["block"], pack_sorted(t.words[order[lo:hi]]), join([pack(counts[order[lo:hi]]), pack(followers[order[lo:hi]])]))
                for i, (lo, hi) in enumerate(zip(upto, upto[1:])) if lo < hi]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=["bucket", "block", "keys", "counts"])
    return ask


# ---------------------------------------------------------------------------
# The walk
# ---------------------------------------------------------------------------
class Automaton:
    """What a block's texts need of the automaton, by token: ``arc[n]``, weight of the
    n-gram that ends there (0: no arc); ``state[n]``, backoff weight of the state that
    its last n words are (0: no state).  The root has an arc for every word."""

    def __init__(self, t: Texts, c1, d1, c2, d2, c3, total: int, kinds: int):
        n = len(t.tokens)
        self.root = (c1 + 0.5) / (total + 0.5 * (kinds + 1))
        p1 = self.root[t.tokens]
        c1, d1 = c1[t.tokens].astype(float), d1[t.tokens].astype(float)
        bigram, trigram, followers = np.zeros(n), np.zeros(n), np.zeros(n)
        bigram[t.second], followers[t.second] = c2, d2
        # an n-gram is kept with the bigram that it goes on from
        inner = t.second[~np.isin(t.second, t.start + t.lens - 1)]
        trigram[inner + 1] = c3[np.searchsorted(t.second, inner)]
        # the end of a text is followed by nothing
        last = t.start + t.lens - 1
        d1[last], followers[last] = 0, 0
        with np.errstate(divide="ignore", invalid="ignore"):
            one = np.where((c1 > 0) & (d1 > 0), DISCOUNT * d1 / c1, 0.0)
            two = np.where((bigram > 0) & (followers > 0), DISCOUNT * followers / bigram, 0.0)
            before = np.zeros(n)
            before[1:] = np.where(one[:-1] > 0, c1[:-1], 0)
            p2 = np.where((bigram > 0) & (before > 0), (bigram - DISCOUNT) / before + np.append(0, one[:-1]) * p1, 0.0)
            before[1:] = np.where(two[:-1] > 0, bigram[:-1], 0)
            shorter = np.where(p2 > 0, p2, np.where(np.append(0, one[:-1]) > 0, np.append(0, one[:-1]), 1.0) * p1)
            p3 = np.where((trigram > 0) & (before > 0), (trigram - DISCOUNT) / before + np.append(0, two[:-1]) * shorter, 0.0)
            self.arc = [np.log10(p1), *(np.where(p > 0, np.log10(p), 0.0) for p in (p2, p3))]
            self.has = [np.ones(n, bool), p2 > 0, p3 > 0]
            self.fail = [np.zeros(n), *(np.where(s > 0, np.log10(s), 0.0) for s in (one, two))]
            self.state = np.where(two > 0, 2, np.where(one > 0, 1, 0))

    def walk(self, start: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """Sum of the log weights of each text, left to right.  A text's state is the
        number of its last words that are one; the texts advance side by side."""
        order = np.argsort(-lens, kind="stable")
        start, lens = start[order], lens[order]
        total, state = np.zeros(len(start)), np.zeros(len(start), np.int64)
        k = 0
        while len(start) and (going := int(np.searchsorted(-lens, -k, "left"))) >= min(ABREAST, len(start)) and going:
            at, s, add = start[:going] + k, state[:going], np.zeros(going)
            for n in (2, 1):
                # no arc: along the failure arc, by its weight, into the shorter state
                miss = (s == n) & ~self.has[n][at]
                add[miss] += self.fail[n][at[miss] - 1]
                # the shorter context may be no state, then its own failure costs nothing
                s = np.where(miss, np.minimum(n - 1, np.where(self.fail_is_state(at - 1, n - 1), n - 1, 0)), s)
            add += np.choose(s, [a[at] for a in self.arc])
            total[:going] += add
            state[:going] = self.state[at]
            k += 1
        for i in range(int(np.searchsorted(-lens, -k, "left")) if len(start) else 0):
            total[i] += self._alone(int(start[i]) + k, int(start[i] + lens[i]), int(state[i]))
        out = np.empty(len(total))
        out[order] = total
        return out

    def fail_is_state(self, at: np.ndarray, n: int) -> np.ndarray:
        return self.fail[1][at] != 0 if n == 1 else np.ones(len(at), bool)

    def _alone(self, lo: int, hi: int, s: int) -> float:
        arc, has, fail = ([x[lo:hi].tolist() for x in xs] for xs in (self.arc, self.has, self.fail))
        states = self.state[lo:hi].tolist()
        back = [x[lo - 1] if lo else 0.0 for x in self.fail]
        total = 0.0
        for i in range(hi - lo):
            if s == 2 and not has[2][i]:
                total += back[2]
                s = 1 if back[1] != 0 else 0
            if s == 1 and not has[1][i]:
                total += back[1]
                s = 0
            total += arc[s][i]
            s = states[i]
            back = [x[i] for x in fail]
        return total


def _score(total: int, kinds: int, bits: int):
    def score(key, left, right):
        t = Texts(left.to_pylist()[0])
        c3, c2, d2, _, _ = attached(t, _by_bucket(right, CONTEXT), bits)
        answers = [split(a) for a in _by_bucket(right, WORD)]
        order = np.argsort(t.words)
        c1, d1 = np.zeros(len(t.words), np.int64), np.zeros(len(t.words), np.int64)
        c1[order], d1[order] = (np.concatenate([unpack(a[k]) for a in answers]) for k in (0, 1))
        a = Automaton(t, c1, d1, c2, d2, c3, total, kinds)
        known = np.add.reduceat((c1[t.tokens] > 0).astype(np.int64), t.start)
        base = np.add.reduceat(a.arc[0], t.start)
        asked = np.flatnonzero(t.flags & SCORE)
        scores = a.walk(t.start[asked], t.lens[asked])
        ids = t.row["doc_ids"]
        return pa.table({"doc_id": pa.array([ids[i] for i in asked], pa.int64()), "n_tokens": pa.array(t.lens[asked], pa.int64()), "n_known": pa.array(known[asked], pa.int64()),
                         "train_tokens": pa.array(np.full(len(asked), total), pa.int64()), "base_score": pa.array(base[asked], pa.float64()), "score": pa.array(scores, pa.float64())})
    return score


def _bits(n: float) -> int:
    return max(0, int(np.ceil(np.log2(max(n, 1)))))


def score_flagged(docs: DataFrame) -> DataFrame:
    """Scores of the rows of ``docs`` (doc_id bigint, text, flags: LEARN, SCORE or both)
    that are to be scored, by a model of those to be learnt from.

    P(w) = (c + 0.5) / (N + 0.5 (V + 1)); in a context u that was seen, for its arcs
    P(w|u) = (c(u w) - D) / c(u) + back(u) P(w|shorter u), for all others
    back(u) P(w|shorter u), with back(u) = D * distinct followers of u / c(u): each
    context's probabilities, with one unknown word, add up to 1.

    Columns: doc_id, n_tokens, n_known, train_tokens, base_score, score (log10).
    Null or empty text: the end token alone.  Rows that share a doc_id are told
    apart; null doc_ids stay.  An empty table gives no rows; an empty training
    set leaves P = 1 for every token (score 0).  Texts are read whole; other
    columns are ignored."""
    spark = docs.sparkSession
    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("flags").cast("int").alias("flags"), F.col("text").cast("string").alias("text"))
    blocks = stage(d.mapInArrow(_blocks, BLOCKS), "lm-blocks")
    size = blocks.agg(F.coalesce(F.sum(F.size("doc_ids")), F.lit(0)), F.coalesce(F.sum("n_train"), F.lit(0)), F.count(F.lit(1))).first()
    total = size[1]
    # as many buckets as blocks, so that both hold about as much
    bits = _bits(size[2] * BLOCK_TOKENS / BUCKET_TOKENS)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    answers = stage(blocks.mapInArrow(_ask(bits), ASKED).groupBy("bucket").applyInArrow(_sum_contexts, ANSWER), "lm-answers")
    free(spark)
    to_blocks = answers.select(F.col("block").alias("of"), "bucket", "answer", F.lit(CONTEXT).alias("kind"))
    met = lambda right: blocks.repartition(parts, "block").groupBy("block").cogroup(right.groupBy("of"))                     # noqa: E731
    word_bits = max(0, bits - 3)
    words = stage(met(to_blocks).applyInArrow(_ask_words(bits, word_bits), ASKED).groupBy("bucket").applyInArrow(_sum_words, ANSWER), "lm-words")
    free(spark)
    kinds = words.where("block IS NULL").agg(F.coalesce(F.sum("bucket"), F.lit(0))).first()[0]
    to_blocks = to_blocks.union(words.where("block IS NOT NULL").select("block", "bucket", "answer", F.lit(WORD)))
    return met(to_blocks).applyInArrow(_score(int(total), int(kinds), bits), SCORES)


def free(spark: SparkSession) -> None:
    """Let go of exchanges that nothing refers to any more: Spark removes their files
    some moments after the driver has collected what stood for them."""
    gc.collect()
    for _ in range(2):
        spark.sparkContext._jvm.System.gc()
        time.sleep(1)


def score(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """:func:`score_flagged` of all ``docs`` (doc_id, text) by a model of ``texts`` (text)."""
    learn = texts.select(F.lit(None).cast("bigint").alias("doc_id"), F.lit(LEARN).alias("flags"), F.col("text").cast("string").alias("text"))
    asked = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.lit(SCORE).alias("flags"), F.col("text").cast("string").alias("text"))
    return score_flagged(asked.union(learn))


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False))


def op9_backoff_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score_flagged(docs.withColumn("flags", F.when(held_out(), SCORE).otherwise(SCORE | LEARN)))
    return out.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


ORACLE: dict[str, str] = {}
QUERIES = {"op9_backoff_automaton": op9_backoff_automaton}
ship_by_value(__name__)
