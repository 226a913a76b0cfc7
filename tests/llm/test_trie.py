"""The conversation trie against plain prefixes."""

import hashlib
import random
import zlib
from collections import Counter

import pytest

pytest.importorskip("gearlens.llm.registry")

import plain_versions as H  # noqa: E402
from gearlens.llm import trie  # noqa: E402

SCHEMA = "conv_id bigint, turn int, role string, text string, depth int, shard string"


def plain_trie(convs):
    """conv_id -> list of (role, text) to the expected rows."""
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        own = (len(m) - 1) * len(H.WORD.findall(p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += own
    out = Counter()
    for p, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(convs[c]) == len(p))))
        out[(min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest())] += 1
    return out


def plain_conversations(rows):
    turns = {}
    for c, k, role, text in rows:
        if c is not None:
            turns.setdefault(c, []).append((k is not None, k or 0, role or "", text or ""))
    return {c: [x[2:] for x in sorted(t)] for c, t in turns.items()}


def plain_rebuild(convs):
    out = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = convs.get(c - (abs(c) % 20) * (1 if c > 0 else -1), [])
        out[c] = base[:h] + turns[h:]
    return out


def make(spark, rows):
    return spark.createDataFrame([(*x, 1, "s") for x in rows], SCHEMA).repartition(6)


def talks(seed, ids, longest=8):
    r = random.Random(seed)
    return [(c, k, r.choice(["user", "bot"]), r.choice(["hi", "hi there you", "a\tb  c"])) for c in ids for k in range(r.randrange(0, longest))]


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rows_of(df):
    return Counter(tuple(x) for x in df.select(*COLUMNS).collect())


@pytest.mark.parametrize("ids", [range(0, 300), [*range(-60, 60), 10**12, 10**12 + 5, -10**12], [0, 1, 1023, 1024, 1025, 5000, 2**62]])
def test_equals_plain_prefixes(spark, ids):
    rows = talks(len(ids), ids)
    convs = plain_conversations(rows)
    df = make(spark, rows)
    assert rows_of(trie.prefix_trie(trie.ordered_turns(df))) == plain_trie(convs)
    assert rows_of(trie.prefix_trie(*trie.rebuild(df))) == plain_trie(plain_rebuild(convs))


def test_long_and_hot_conversations(spark):
    """Conversations over many bands, and one that half of all ids hold."""
    same = [("user", f"turn {k}") for k in range(300)]
    convs = {c: same[:200] for c in range(0, 2000, 2)}
    convs |= {c: same[:k] + [("bot", str(c))] for c, k in ((1, 300), (3, 63), (5, 64), (7, 65), (9, 127), (11, 128), (13, 0))}
    convs |= {15: same[:63], 17: same[:64], 19: same}
    rows = [(c, k, *t) for c, turns in convs.items() for k, t in enumerate(turns)]
    assert rows_of(trie.prefix_trie(trie.ordered_turns(make(spark, rows)))) == plain_trie(convs)


def test_awkward_turns(spark):
    rows = [(1, 0, "user", None), (1, None, None, "first"), (1, 0, "user", None), (2, None, "", "first"), (2, 0, "user", ""), (None, 0, "user", "nobody"), (3, 0, None, None),
            (40, 0, "user", "x " * 50_000), (45, 0, "user", "a"), (45, 0, "user", "a")]
    df = make(spark, rows)
    convs = plain_conversations(rows)
    assert rows_of(trie.prefix_trie(trie.ordered_turns(df))) == plain_trie(convs)
    got = rows_of(trie.prefix_trie(*trie.rebuild(df)))
    assert got == plain_trie(plain_rebuild(convs)) and sum(x[1] == 0 for x in got) == 1
    assert trie.prefix_trie(*trie.rebuild(df.limit(0))).count() == 0
    assert trie.prefix_trie(*trie.rebuild(make(spark, [(None, 0, "user", "x")]))).count() == 0
