"""Bottom-k fingerprints against plain sets."""

import hashlib
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

pytest.importorskip("gearlens.llm.registry")

import plain_versions as H  # noqa: E402
from gearlens.llm import fingerprints as fp  # noqa: E402


def plain_hashes(text):
    w = [zlib.crc32(x.encode()) for x in H.WORD.findall(H.lower(text))]
    if not w:
        return set()
    w += [0] * (fp.WIDTH - len(w))
    mixed = [sum(a * b for a, b in zip(w[i:i + fp.WIDTH], fp.WEIGHTS)) for i in range(len(w) - fp.WIDTH + 1)]
    return {(m % fp.HIGH) * 2**31 + m % fp.LOW for m in mixed}


def likeness(a, b, k):
    u = sorted(plain_hashes(a) | plain_hashes(b))[:k]
    return sum(x in plain_hashes(a) and x in plain_hashes(b) for x in u) / len(u) if u else 1.0


def text(r, n):
    return " ".join(r.choice(["alpha", "Beta", "gamma", "délta", "eps"]) + str(r.randrange(40)) for _ in range(n))


ROWS = [(5, "one"), (4, None), (4, ""), (3, " \n\t "), (2, "A b\tC d e f"), (2, "A b\tC d e f"), (None, "no id here"), (None, "none here either, nor there"), (-7, "\U0001F600é " * 7),
        (9, "word " * 30_000), (2**62, "large id"), (-2**63, "least id of all"), (1, text(random.Random(1), 900)), (0, text(random.Random(2), 900))]


def test_equals_plain_sets(spark):
    df = spark.createDataFrame([(*x, 1, "n") for x in ROWS], "doc_id bigint, text string, own int, next_text string").repartition(5)
    got = fp.fingerprint_edits(df).collect()
    # the documented order: by descending id, null last; rows with one id by the hash of their text
    for key in ("doc_id", "n_chars", "edited_sha256"):
        assert all(getattr(x, key) is not None or key == "doc_id" for x in got)
    assert Counter(x.doc_id for x in got) == Counter(i for i, _ in ROWS)
    unique = [x for x in ROWS if Counter(i for i, _ in ROWS)[x[0]] == 1]
    order = sorted(unique, key=lambda x: -x[0])
    by_id = {x.doc_id: x for x in got}
    for (i, t), (j, nxt) in zip(order, order[1:]):
        if any(i > x > j for x, _ in ROWS if x is not None):
            continue
        x, n = by_id[i], len(t)
        edited = t[:n - n // 3] + nxt[:n // 3]
        assert (x.n_chars, x.edited_sha256) == (n, hashlib.sha256(edited.encode()).hexdigest())
        assert x.fingerprint == "".join(f"{h:016x}" for h in sorted(plain_hashes(t))[:fp.K])
        assert x.edited_fingerprint == "".join(f"{h:016x}" for h in sorted(plain_hashes(edited))[:fp.K])
        assert abs(x.near_edited - likeness(t, edited, fp.K)) < 1e-12 and abs(x.near_next - likeness(t, nxt, fp.K)) < 1e-12
    assert fp.fingerprint_edits(df.limit(0)).count() == 0
    one, = fp.fingerprint_edits(df.where("doc_id = 1")).collect()
    assert one.near_next == 1.0


def test_every_row_has_one_successor(spark):
    """Many ids, some of them shared by many rows, over many ranges: the texts form one ring."""
    r = random.Random(5)
    rows = [(None if r.random() < 0.3 else 7 if r.random() < 0.4 else r.randrange(10**6), f"t{i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(16)
    got = {x.text: (x.doc_id, x.next_text) for x in fp.with_next(df).collect()}
    assert len(got) == len(rows)
    at, seen = "t0", set()
    while at not in seen:
        seen.add(at)
        at = got[at][1]
    assert len(seen) == len(rows)
    id_of = {t: (i is None, -(i or 0)) for t, (i, _) in got.items()}
    assert sum(id_of[t] > id_of[got[t][1]] for t in got) == 1                        # only the last one leads back


def test_estimates(spark):
    """Sketches of whole collections from sketches of their parts; estimates near the true figures."""
    r = random.Random(3)
    parts = [(i % 3, text(r, 700)) for i in range(40)] + [(None, "a b c d e f"), (None, None), (3, "")]
    df = spark.createDataFrame(parts, "g int, text string").select("g", fp.sketch(F.col("text"), 512).alias("s"))
    got = {x.g: x for x in fp.merge_parts(df, "s", ["g"], 512).withColumn("n", fp.n_distinct(F.col("s"), 512)).collect()}
    for g in (0, 1, 2, 3, None):
        own = set().union(*[plain_hashes(t) for i, t in parts if i == g])
        assert got[g].s == sorted(own)[:512] and got[g].n_parts == sum(i == g for i, _ in parts)
        assert abs(got[g].n - len(own)) <= 0.12 * len(own)
    a, b = text(r, 3000), text(r, 2000)
    both = f"{a} {b}"
    row = spark.createDataFrame([(a, both)], "a string, b string").select(fp.sketch(F.col("a")).alias("a"), fp.sketch(F.col("b")).alias("b"))
    x = row.select(fp.resemblance(F.col("a"), F.col("b")).alias("r"), fp.containment(F.col("a"), F.col("b")).alias("c"), fp.containment(F.col("b"), F.col("a")).alias("d"),
                   fp.decode(fp.encode(F.col("a"))).alias("back"), F.col("a").alias("a"), fp.merge(F.col("a"), F.col("b")).alias("m"), F.col("b").alias("b")).first()
    true = len(plain_hashes(a) & plain_hashes(both)) / len(plain_hashes(a) | plain_hashes(both))
    assert abs(x.r - true) < 0.15 and x.c > 0.85 and abs(x.d - true) < 0.15 and x.back == x.a and x.m == sorted(plain_hashes(a) | plain_hashes(both))[:fp.K]
