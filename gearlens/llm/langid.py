"""Language identification by cross-parsing entropy.

For every language a suffix automaton of labelled text is built.  A text is
parsed from left to right into the longest phrases that occur in that language's
text; the language that needs the fewest phrases, normalised by the logarithm of
its text's length, wins.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship_by_value, table

#: Bounds of the labelled sample that the automata are built from: letters per
#: language (documents share them equally), documents per language, and letters of
#: all languages together, which share them equally where they are many.
SAMPLE_CHARS, SAMPLE_DOCS, ALL_CHARS = 40_000, 64, 8_000_000
#: A text is parsed in blocks of this many characters side by side; each goes on
#: from the state in which the one before it ends.
BLOCK = 256
#: Characters parsed side by side in one task.
BATCH_CHARS = 3_000_000
UNKNOWN = "und"


def lower_letters() -> np.ndarray:
    """For each code point the code point of its lower-case letter, or 0 (no letter)."""
    t = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            t[c] = ord(low[0]) if low else c
    return t


def normalise(text: str, classes: np.ndarray) -> np.ndarray:
    """Classes of a text's letters, every run of other characters one 0 between them."""
    x = classes[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    keep = x > 0
    keep[1:] |= x[:-1] > 0
    x = x[keep]
    return x[:-1] if len(x) and x[-1] == 0 else x


class Alphabet:
    """Small numbers for the letters of the sample: 0 no letter, then one each,
    ``other`` for letters never seen, ``pad`` behind a text's end."""

    def __init__(self, samples: list[np.ndarray], lower: np.ndarray):
        seen = np.unique(np.concatenate([*samples, np.zeros(1, np.uint32)]))
        self.other, self.pad = len(seen), len(seen) + 1
        small = np.full(0x110000, self.other, np.uint16)
        small[seen] = np.arange(len(seen))
        self.lower_codes = small
        self.of = small[lower]


class Automaton:
    """Suffix automaton of one language as a dense table of rows (states) and
    columns (character classes).  An entry is the offset of the next state's row;
    where the phrase can't go on, it is ~(offset of the state that the character
    starts a new phrase with), which is negative."""

    def __init__(self, codes: np.ndarray, width: int):
        self.length = max(2, len(codes))
        go, link, size, last = [{}], [-1], [0], 0
        for c in codes.tolist():
            cur = len(go)
            go.append({})
            size.append(size[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in go[p]:
                go[p][c] = cur
                p = link[p]
            if p >= 0:
                q = go[p][c]
                if size[q] == size[p] + 1:
                    link[cur] = q
                else:
                    twin = len(go)
                    go.append(dict(go[q]))
                    size.append(size[p] + 1)
                    link.append(link[q])
                    while p >= 0 and go[p].get(c) == q:
                        go[p][c] = twin
                        p = link[p]
                    link[q] = link[cur] = twin
            last = cur
        start = np.array([go[0].get(c, 0) * width for c in range(width)], np.int32)
        rows = np.tile(~start, (len(go), 1))
        for s, arcs in enumerate(go):
            for c, t in arcs.items():
                rows[s, c] = t * width
        rows[0] = start                                          # at the root no phrase is open
        self.next = rows.ravel()
        self.unseen = start == 0
        self.unseen[-1] = False                                  # the padding

    def phrases(self, columns: np.ndarray, alive: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrases that end in blocks parsed side by side from the states ``start``, and
        the blocks' last states; ``columns[t]`` has the t-th character of the blocks, of
        which the first ``alive[t]`` are that long."""
        count = self.unseen[columns].sum(0, dtype=np.int32)      # a character of no phrase counts as one
        state = start.copy()
        at = np.zeros(columns.shape[1], np.int64)
        to, ends = np.zeros_like(state), np.zeros_like(state)
        for t in range(len(columns)):
            n = alive[t]
            s, v, e = state[:n], to[:n], ends[:n]
            np.add(s, columns[t, :n], out=at[:n])
            np.take(self.next, at[:n], out=v, mode="clip")
            np.right_shift(v, 31, out=e)                         # -1 where a phrase ends
            count[:n] -= e
            np.bitwise_xor(v, e, out=s)
        return count, state


def parse(texts: list[np.ndarray], automata: dict[str, Automaton], pad: int, block: int = BLOCK) -> np.ndarray:
    """Phrases of each text (row) under each language (column).

    All blocks are parsed from the root, then those again whose predecessor ends
    elsewhere, until every block has begun where the one before it ends."""
    sizes, owner, first = [], [], []
    for i, x in enumerate(texts):
        full, rest = divmod(len(x), block)
        n = full + (rest > 0)
        sizes += [block] * full + [rest] * (rest > 0)
        owner += [i] * n
        first += [k == 0 for k in range(n)]
    out = np.zeros((len(texts), len(automata)))
    if not sizes:
        return out
    sizes, owner, first = np.array(sizes), np.array(owner), np.array(first)
    rows = np.full((len(sizes), block), pad, np.uint16)
    rows[np.arange(block) < sizes[:, None]] = np.concatenate(texts)
    last = np.append(first[1:], True)
    for j, a in enumerate(automata.values()):
        start, count, end = (np.zeros(len(sizes), np.int32) for _ in range(3))
        todo = np.arange(len(sizes))
        while len(todo):
            order = todo[np.argsort(-sizes[todo], kind="stable")]
            columns = np.ascontiguousarray(rows[order].T)[:sizes[order[0]]]
            alive = np.searchsorted(-sizes[order], -np.arange(len(columns)), side="left")
            count[order], end[order] = a.phrases(columns, alive, start[order])
            before = np.where(first, 0, np.append(0, end[:-1])).astype(np.int32)
            todo = np.flatnonzero(before != start)
            start = before
        out[:, j] = np.bincount(owner, count + (last & (end > 0)), len(texts))            # the last phrase
    return out


def choose(phrases: np.ndarray, automata: dict[str, Automaton]) -> tuple[np.ndarray, np.ndarray]:
    """Index of the winner and its score: the share of the evidence, from 1 over
    the number of languages (no difference) to 1, of a soft vote in which 10 % more
    phrases than the winner weigh e times less.  Ties go to the first language."""
    cost = phrases * np.array([math.log2(a.length) for a in automata.values()])
    best = cost.argmin(1)
    low = np.maximum(cost.min(1, keepdims=True), 1e-9)
    votes = np.exp(np.maximum(-(cost / low - 1) * 10, -700))
    return best, 1 / votes.sum(1)


def _predict(model):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alphabet, automata = model.value
        names = list(automata)
        for batch in batches:
            col = batch.column(1)
            todo, size, pred, score = [], 0, [UNKNOWN] * len(col), [0.0] * len(col)

            def flush():
                if todo and names:
                    best, s = choose(parse([x for _, x in todo], automata, alphabet.pad), automata)
                    for (i, _), b, v in zip(todo, best, s):
                        pred[i], score[i] = names[b], float(v)
                todo.clear()

            for i, t in enumerate(col):
                t = t.as_py()
                x = normalise(t, alphabet.of) if t else None
                if x is not None and len(x):
                    todo.append((i, x))
                    size += len(x)
                    if size >= BATCH_CHARS:
                        flush()
                        size = 0
            flush()
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in (0, *range(2, batch.num_columns))], pa.array(pred, pa.string()), pa.array(score, pa.float64())],
                                             [batch.schema.names[k] for k in (0, *range(2, batch.num_columns))] + ["lang_pred", "score"])
    return predict


def fit(labelled: DataFrame, sample_chars: int = SAMPLE_CHARS, sample_docs: int = SAMPLE_DOCS) -> tuple[Alphabet, dict[str, Automaton]]:
    """Alphabet and automata of the languages of ``labelled`` (doc_id, text, lang).

    The sample is bounded: per language at most ``sample_docs`` documents, the
    one with the least hash of id and text in each of that many hash classes, and of
    the letters of each whole text the first ones, up to its share of ``sample_chars``
    (of ALL_CHARS over the languages, where that is less).  Rows with null lang or text
    are left out; so is a language without a letter in its sample."""
    rows = labelled.where("lang IS NOT NULL AND text IS NOT NULL AND length(text) > 0")
    h = F.xxhash64(F.col("doc_id").cast("string"), F.col("text"))
    picks = rows.groupBy("lang", F.pmod(h, F.lit(sample_docs)).alias("class")).agg(F.min(h).alias("h")).collect()        # the model has a part for each lang
    names = sorted({r["lang"] for r in picks})
    sample_chars = min(sample_chars, ALL_CHARS // max(1, len(names)))
    lower, texts = lower_letters(), {n: [] for n in names}
    if picks:
        # runs of what is no letter count as one character, as in the texts that are parsed
        letters = F.substring(F.regexp_replace("text", r"[^\p{L}]+", " "), 1, sample_chars)
        wanted = F.broadcast(labelled.sparkSession.createDataFrame([(r["lang"], r["h"]) for r in picks], "lang string, h bigint"))
        chosen = rows.select("lang", h.alias("h"), letters.alias("text")).join(wanted, ["lang", "h"], "left_semi")
        for r in sorted(chosen.dropDuplicates(["lang", "h"]).collect(), key=lambda r: (r["lang"], r["h"])):
            texts[r["lang"]].append(normalise(r["text"], lower))
    samples = {}
    for n in names:
        sample, left = [], sample_chars
        for k, x in enumerate(sorted(texts[n], key=len)):       # short ones leave their share to the rest
            share = left // (len(texts[n]) - k)
            sample += [x[:share], np.zeros(1, np.uint32)]
            left -= len(x[:share])
        sample = np.concatenate(sample) if sample else np.zeros(0, np.uint32)
        if sample.any():
            samples[n] = sample
    alphabet = Alphabet(list(samples.values()), lower)
    return alphabet, {n: Automaton(alphabet.lower_codes[x], alphabet.pad + 1) for n, x in samples.items()}


def identify(docs: DataFrame, model: tuple[Alphabet, dict[str, Automaton]], *keep: str) -> DataFrame:
    """doc_id, the columns ``keep``, lang_pred and score for every row of ``docs``.

    Null, empty or letterless text, or no automaton at all: ``und`` with score 0.
    Texts of any length are parsed whole.  Repeated rows and null doc_ids stay as
    they are; an empty table gives no rows; other columns are ignored."""
    shared = docs.sparkSession.sparkContext.broadcast(model)     # bounded by the sample
    d = docs.select("doc_id", "text", *keep)
    out = d.drop("text").withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)})
    return d.mapInArrow(_predict(shared), out.schema)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def op3_cross_parsing_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs.where(~held_out()))).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


ORACLE: dict[str, str] = {}
QUERIES = {"op3_cross_parsing_language": op3_cross_parsing_language}
ship_by_value(__name__)
