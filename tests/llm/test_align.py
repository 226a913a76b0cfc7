"""Token alignment against a version that goes token by token."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("gearlens.llm.registry")

import sentencepiece  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from gearlens.llm import align  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"
A, B = f"{align.FOLDER}/{align.A_FILE}", f"{align.FOLDER}/{align.B_FILE}"
ODD = [" ", "  ", "a", "é", "\U0001F600", "▁", "​", "日本", "\U00020BB7", "ﷺ", "\n", "\t", "the ", "<s>", "</s>", "<unk>", "<|endoftext|>",
       "<0x41>", "\x00", "ß", "ก็", "é", "don't "]


def tokens(tok, sp, text):
    """(A tokens, B tokens) as (id, bytes), None where they do not give the text back."""
    if not text:
        return None
    vocab = sorted(range(256), key=lambda b: (not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255), b))
    letter, other = {}, 256
    for b in vocab:
        plain = 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255
        letter[chr(b) if plain else chr(other)] = b
        other += not plain
    piece = lambda p: bytes.fromhex(p[3:5]) if len(p) == 6 and p[:3] == "<0x" and p[5] == ">" else p.replace("▁", " ").encode()      # noqa: E731
    a = [(i, bytes(letter[c] for c in tok.id_to_token(i))) for i in tok.encode(" " + text, add_special_tokens=False).ids]
    b = [(i, piece(sp.id_to_piece(i))) for i in sp.encode(text)]
    whole = (" " + text).encode()
    return (a, b) if b"".join(x for _, x in a) == whole == b"".join(x for _, x in b) else None


def brute_force(rows):
    tok, sp = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    tok.encode_special_tokens = True
    docs, counts = [], Counter()
    for doc_id, text in rows:
        found = tokens(tok, sp, text)
        if found is None:
            docs.append((doc_id, None))
            continue
        spans = []
        for side in found:
            at, out = 0, []
            for i, x in side:
                out.append((i, at, at + len(x)))
                at += len(x)
            spans.append(out)
        links, j = [], 0
        for i, lo, hi in spans[0]:
            while spans[1][j][2] <= lo:
                j += 1
            links += [(i, x[0]) for x in spans[1][j:j + hi - lo + 1] if x[1] < hi and x[2] > lo]
        groups = []
        lo = 0
        for cut in sorted({x[2] for x in spans[0]} & {x[2] for x in spans[1]}):
            groups.append("|".join(",".join(str(x[0]) for x in side if lo < x[2] <= cut) for side in spans))
            lo = cut
        counts.update(links)
        docs.append((doc_id, (len(spans[0]), len(spans[1]), groups, links)))
    best = {}
    for (_, b), c in counts.items():
        best[b] = max(best.get(b, 0), c)
    out = Counter()
    for doc_id, d in docs:
        if d is None:
            out[(doc_id, 0, 0, 0, 0, 0, 0, "")] += 1
            continue
        n_a, n_b, groups, links = d
        out[(doc_id, n_a, n_b, len(groups), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links),
             hashlib.sha256(";".join(groups).encode()).hexdigest())] += 1
    return out


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(1)
    docs = [(x.doc_id, x.text[:4000]) for x in spark.read.parquet(f"{SF_SMALL}/documents.parquet").where("text IS NOT NULL").limit(40).collect()]
    odd = [(1000 + i, "".join(r.choice(ODD) for _ in range(r.randrange(0, 40)))) for i in range(200)]
    return [*docs, *docs[:3], *odd, (2001, None), (None, "hello world"), (None, "hello world"), (2002, ""), (2003, "\U0001F9D1‍\U0001F680 " * 2000)]


def test_equals_brute_force(spark, rows, monkeypatch):
    """Small blocks, so that the counts of many blocks meet, and one large one."""
    df = spark.createDataFrame([(*x, 1, 2) for x in rows], "doc_id bigint, text string, block int, links int")
    want = brute_force(rows)
    assert sum(n for x, n in want.items() if x[1]) > 100 and sum(n for x, n in want.items() if not x[1]) > 10
    assert Counter(map(tuple, align.align(df).collect())) == want
    monkeypatch.setattr(align, "BLOCK", 500)
    monkeypatch.setattr(align, "CHUNK", 1000)
    monkeypatch.setattr(align, "ENTRIES", 7)
    monkeypatch.setattr(align, "MEMO_UNITS", 50)
    monkeypatch.setattr(align, "JOINED", 3)
    assert Counter(map(tuple, align.align(df).collect())) == want
    assert align.align(df.limit(0)).count() == 0
    assert {x.n_links for x in align.align(df.where("text IS NULL OR text = ''")).collect()} == {0}


def test_groups_give_the_text_back(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    tok, sp = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    tok.encode_special_tokens = True
    got = align.aligned_groups(df).collect()
    assert Counter(x.doc_id for x in got) == Counter(i for i, _ in rows)
    text_of = dict(rows)
    for x in got:
        if x.doc_id is None or Counter(i for i, _ in rows)[x.doc_id] > 1:
            continue
        found = tokens(tok, sp, text_of[x.doc_id])
        if found is None:
            assert x.groups == []
            continue
        assert [i for g in x.groups for i in g.a] == [i for i, _ in found[0]] and [i for g in x.groups for i in g.b] == [i for i, _ in found[1]]
        assert [g.start for g in x.groups] == [0, *[g.end for g in x.groups[:-1]]]
        assert x.groups[-1].end == len((" " + text_of[x.doc_id]).encode())


def test_characters_cut_by_tokens_are_refined():
    """Offsets of tokens inside one character say nothing; the decoded bytes place the ends."""
    al = align.Aligner(open(A, "rb").read(), open(B, "rb").read())
    good, j = al.encode([" \U00020BB7 \U0001F9D1 x", " <unk>▁", " "])
    assert good == [0, 2] and j.n_a.tolist()[0] > 6 and j.n_b.tolist()[1] == 1
    assert j.ends_a.tolist() == np.cumsum(al.va.lens[j.a]).tolist() and j.ends_b.tolist() == np.cumsum(al.vb.lens[j.b]).tolist()
    assert al.vb.fallback[j.b].any()


def test_texts_fall_into_units():
    """Units give the text back; none is cut where a token could reach over."""
    al = align.Aligner(open(A, "rb").read(), open(B, "rb").read())
    assert al.units
    for text in ["a b", " a  b ", "a\n b\t\n", "\u00a0 x", "it's <|endoftext|> ok"]:
        assert "".join(al.split(text)) == " " + text
        assert al.split(text) == align.UNIT.split(" " + text)
    assert al.split("a b  c \n d") == [" a", " b", "  c", " \n d"] and al.split("a b ") == [" a", " b", " "]
    al.learn([" a", " b", " <unk>▁", "  "])
    assert al.number[" <unk>▁"] == -1 and sorted(al.number[u] for u in (" a", " b", "  ")) == [0, 1, 2]
    assert len(al.texts) == 3 and al.counts[:, 3].sum() == len(al.pairs)
