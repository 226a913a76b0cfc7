"""Plain Python versions of the operators, for small inputs."""

import itertools
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
NORM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def shingles(t, width):
    w = WORD.findall(lower(t))
    n = min(width, len(w))
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if w else set()


def components(docs, width=2, similarity=80):
    """doc_id -> smallest doc_id reachable."""
    s = {i: shingles(t, width) for i, t in docs}
    parent = {i: i for i in s}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(sorted(s), 2):
        if s[a] and s[b] and 100 * len(s[a] & s[b]) >= similarity * len(s[a] | s[b]):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: root(i) for i in s}


def contamination(text, items, width=13):
    """(n_words, n_hit, items found) of one text."""
    w = NORM_WORD.findall(lower(text))
    hit, found = set(), set()
    for item, t in items:
        b = NORM_WORD.findall(lower(t))
        n = min(width, len(b))
        grams = {tuple(b[i:i + n]) for i in range(len(b) - n + 1)} if b else set()
        for i in range(len(w) - n + 1):
            if grams and tuple(w[i:i + n]) in grams:
                hit |= set(range(i, i + n))
                found.add(str(item))
    return len(w), len(hit), sorted(found)


def measures(text):
    t = text or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    windows = {}
    for i in range(len(w) - 4):
        windows.setdefault(tuple(w[i:i + 5]), []).append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)
