"""Alignment of two tokenizers' tokens over the same bytes.

Tokenizer A (a byte-level vocabulary of the ``tokenizers`` library) gives
character offsets, tokenizer B (a ``sentencepiece`` model) gives the byte spans
of its proto (the installed release calls the immutable proto ``proto``).  Both
are coarse cuts: they say nothing of tokens inside one character and of the
bytes of a fallback.  There the decoded bytes of the tokens place the ends.

Where an A and a B token end at the same byte, a group ends; every A-B pair of
tokens with overlapping bytes is a link.  A link's weight is the number of links
of its id pair in the whole corpus.

No token of either side reaches from a character that is no white space over a
space behind it.  So a text falls into units there, each aligned by itself, and a
unit that comes again is aligned once (tokenizers for which this does not hold
take whole texts as units).  A task collects blocks of documents.  It writes each
document's units, the units' pairs, and the distinct pairs with their counts.
Only these are summed and joined across the corpus, then each block meets its
own pairs again.
"""

from __future__ import annotations

import ctypes
import gc
import hashlib
import itertools
import json
import os
import re
from collections.abc import Iterator
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import ship_by_value, stage, table

#: Folder of the vocabulary files, and their names.
FOLDER = "/opt/tokenizers"
A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Code points encoded at once, links of a block (a longer text is a block of its own).
CHUNK, BLOCK = 400_000, 2_000_000
#: Entries of one output row of a block's list of pairs.
ENTRIES = 50_000
#: Units, and bytes of them, at which a process forgets the rare half of what it remembers.
MEMO_UNITS, MEMO_BYTES = 600_000, 60_000_000
#: Units aligned as one text, side by side.
JOINED = 5000
#: Where units begin: before a space that follows anything but white space.
UNIT = re.compile(r"(?<=\S)(?= )")
#: White space before a space: without it, every space begins a unit.
UNEVEN = re.compile(r"\s ")
#: The mark that B has for a space.
MARK = "▁"
PARTS = ("block bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, links binary, "
         "first int, pairs array<bigint>, counts array<bigint>")
OUT = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"
SPANS = "doc_id bigint, groups array<struct<start:int,end:int,a:array<int>,b:array<int>>>"
_made: dict = {}


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: printable Latin-1
    bytes stand for themselves, the others for the letters from 256 on, in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Vocabulary:
    """Decoded bytes and decimal digits of every id."""

    def __init__(self, decoded: list[bytes], fallback: list[bool]):
        self.decoded, self.lens = decoded, np.array([len(b) for b in decoded] or [0], np.int64)
        self.fallback = np.array(fallback or [False])
        width = len(str(max(1, len(decoded) - 1)))
        self.digits = np.zeros((len(decoded), width), np.uint8)
        for i in range(len(decoded)):
            self.digits[i, :len(str(i))] = list(str(i).encode())


class Aligner:
    """Both tokenizers, from the contents of their files."""

    def __init__(self, a: bytes, b: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_str(a.decode())
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b)
        letters = byte_letters()
        model = json.loads(a)
        entries = [b""] * self.a.get_vocab_size(with_added_tokens=True)
        for t in model.get("added_tokens", []):
            entries[t["id"]] = t["content"].encode()
        for t, i in model["model"]["vocab"].items():
            entries[i] = bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode()
        self.va = Vocabulary(entries, [False] * len(entries))
        pieces, fallback = [], []
        for i in range(self.b.get_piece_size()):
            p = self.b.id_to_piece(i)
            fallback.append(len(p) == 6 and p.startswith("<0x") and p.endswith(">"))
            pieces.append(bytes([int(p[3:5], 16)]) if fallback[-1] else p.replace(MARK, " ").encode())
        self.vb = Vocabulary(pieces, fallback)
        # a lone space and no other mark inside a piece, and words cut as byte-level vocabularies do
        before = model.get("pre_tokenizer") or {}
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.space = next((i for i, n in enumerate(names) if n == MARK), None)
        self.units = (model.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex", True)
                      and not before.get("add_prefix_space") and self.space is not None and not any(MARK in n.lstrip(MARK) for n in names))
        # units by number: tokens of A and B, groups and links, documents that held it, the
        # groups' text, and all units' pairs in a row; number -1: its bytes do not come back
        self.number: dict[str, int] = {}
        self.names: list[str] = []
        self.texts: list[bytes] = []
        self.counts, self.seen, self.pairs = np.zeros((0, 4), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.bytes = 0

    def pairs_of(self, units: np.ndarray) -> np.ndarray:
        """The pairs of some units one after the other."""
        sizes, last = self.counts[units, 3], np.cumsum(self.counts[:, 3])[units]
        return self.pairs[np.arange(sizes.sum()) + np.repeat(last - np.cumsum(sizes), sizes)]

    def forget(self, least: int = 2) -> None:
        """Keep what several documents held, half of the room at most."""
        while (keep := np.flatnonzero(self.seen >= least)).size > MEMO_UNITS // 2 or sum(len(self.names[i]) for i in keep) > MEMO_BYTES // 2:
            least *= 2
        self.pairs = self.pairs_of(keep)
        self.names, self.texts = [self.names[i] for i in keep], [self.texts[i] for i in keep]
        self.counts, self.seen = self.counts[keep], self.seen[keep] // 2
        self.number = {u: i for i, u in enumerate(self.names)}
        self.bytes = sum(map(len, self.names))

    def split(self, text: str) -> list[str]:
        """Units of space + text."""
        if not self.units:
            return [" " + text]
        return UNIT.split(" " + text) if UNEVEN.search(" " + text) else [" " + w for w in text.split(" ")]

    def learn(self, units: list[str]) -> None:
        """Align units not met before."""
        ends_in_space = [u for u in units if u[-1].isspace()]
        others = [u for u in units if not u[-1].isspace()]
        parts: list[Joint] = []
        for lo in range(0, len(ends_in_space), JOINED):
            self._learn(ends_in_space[lo:lo + JOINED], parts, [])
        for lo in range(0, len(others), JOINED):
            some = others[lo:lo + JOINED]
            self._learn(some, parts, some if self.units else [])
        if parts:
            self.counts = np.concatenate([self.counts, *[np.stack([j.n_a, j.n_b, j.n_groups, j.n_links], 1) for j in parts]])
            self.seen = np.concatenate([self.seen, np.zeros(len(self.names) - len(self.seen), np.int64)])
            self.pairs = np.concatenate([self.pairs, *[j.link_a * len(self.vb.decoded) + j.link_b for j in parts]])

    def _learn(self, units: list[str], parts: list["Joint"], joined: list[str]) -> None:
        """As one text, where their ends come back in it; else each by itself."""
        good, j = list(range(len(units))), None
        if joined:
            _, x = self.encode(["".join(joined)])
            j = x.cut(np.array([len(u.encode()) for u in joined])) if x is not None else None
        if j is None:
            good, j = self.encode(units)
        self.number.update(dict.fromkeys(units, -1))
        if j is not None:
            parts.append(j)
            names = [units[i] for i in good]
            self.number.update(zip(names, itertools.count(len(self.names))))
            self.names += names
            self.texts += j.texts(self.va, self.vb)
        self.bytes += sum(map(len, units))

    @staticmethod
    def refine(ends: np.ndarray, sure: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """Byte ends of tokens: the coarse ``ends`` where they are ``sure``, between
        them counted on from the last sure one by the decoded lengths.  A coarse cut
        that the decoded bytes contradict is none."""
        run = np.cumsum(lens)
        sure = sure & (run == ends)
        last = np.maximum.accumulate(np.where(sure, np.arange(len(lens)), -1))
        from_end, from_run = np.where(last < 0, 0, ends[last]), np.where(last < 0, 0, run[last])
        return from_end + run - from_run

    def encode(self, texts: list[str]) -> tuple[list[int], "Joint | None"]:
        """The places of the texts whose tokens give their bytes back, and these aligned.
        Every text begins with the space that B adds by itself (to nothing it adds none)."""
        bare = [t.encode() for t in texts]
        one = self.a.encode_batch(texts, add_special_tokens=False)
        two = self.b.encode([t[1:] for t in texts], num_threads=1, return_type="proto")
        ids_a, pieces = [x.ids for x in one], [list(x.pieces) for x in two]
        ids_b = [[p.id for p in x] if len(t) > 1 else [self.space] for x, t in zip(pieces, bare)]
        da, db = self.va.decoded.__getitem__, self.vb.decoded.__getitem__
        good = [i for i, (t, x, y) in enumerate(zip(bare, ids_a, ids_b)) if y != [None] and b"".join(map(da, x)) == t and b"".join(map(db, y)) == t]
        if not good:
            return [], None
        flat = lambda rows: np.fromiter(itertools.chain.from_iterable(rows), np.int64)               # noqa: E731
        size, chars = np.array([len(bare[i]) for i in good]), np.array([len(texts[i]) for i in good])
        n_a, n_b = np.array([len(ids_a[i]) for i in good]), np.array([len(ids_b[i]) for i in good])
        a, b = flat(ids_a[i] for i in good), flat(ids_b[i] for i in good)
        at, char_at = np.cumsum(size) - size, np.cumsum(chars) - chars
        whole = np.frombuffer(b"".join([bare[i] for i in good]), np.uint8)

        # A's offsets count characters; a token that shares its last one with the next ends inside it
        spans = flat(itertools.chain.from_iterable(one[i].offsets) for i in good).reshape(-1, 2) + np.repeat(char_at, n_a)[:, None]
        starts = np.append(np.flatnonzero((whole & 0xC0) != 0x80), len(whole))
        ends_a = self.refine(starts[spans[:, 1]], np.append(spans[1:, 0] >= spans[:-1, 1], True), self.va.lens[a])
        # B's spans count the bytes after the added space
        begin, end = (flat([*map(attrgetter(k), pieces[i])] if len(bare[i]) > 1 else [0] for i in good) + np.repeat(at, n_b) + 1 for k in ("begin", "end"))
        sure = ~self.vb.fallback[b] & (end > begin) & np.append(begin[1:] >= end[:-1], True)
        ends_b = self.refine(end, sure, self.vb.lens[b])
        return good, Joint(a, ends_a, n_a, b, ends_b, n_b, size)


class Joint:
    """Groups and links of some texts laid end to end: ids, byte ends and numbers of
    tokens of both sides, bytes of each text."""

    def __init__(self, a, ends_a, n_a, b, ends_b, n_b, sizes):
        self.a, self.b, self.n_a, self.n_b, self.ends_a, self.ends_b = a, b, n_a, n_b, ends_a, ends_b
        shift = np.cumsum(sizes) - sizes
        total = int(sizes.sum()) + 1
        at_a, at_b = np.zeros(total, bool), np.zeros(total, bool)
        at_a[ends_a], at_b[ends_b] = True, True
        both = np.cumsum(at_a & at_b)
        self.group_a, self.group_b = both[ends_a - 1], both[ends_b - 1]
        self.ends = np.flatnonzero(at_a & at_b)
        # each byte where a token ends closes one link: of the A and the B token that reach up to it
        close = np.flatnonzero(at_a | at_b)
        self.link_a, self.link_b = self.a[np.cumsum(at_a)[close - 1]], self.b[np.cumsum(at_b)[close - 1]]
        self.link_doc = np.searchsorted(shift, close, "left") - 1
        docs = np.arange(len(sizes) + 1)
        self.n_links = np.diff(np.searchsorted(self.link_doc, docs))
        self.n_groups = np.diff(np.searchsorted(self.ends, np.append(shift, total - 1), "right"))
        self.shift = shift

    def cut(self, sizes: np.ndarray) -> "Joint | None":
        """The same bytes as texts of these sizes; None if one does not end where both tokens do."""
        upto = np.cumsum(sizes)
        i, j = np.searchsorted(self.ends_a, upto), np.searchsorted(self.ends_b, upto)
        if (self.ends_a[np.minimum(i, len(self.a) - 1)] != upto).any() or (self.ends_b[np.minimum(j, len(self.b) - 1)] != upto).any():
            return None
        return Joint(self.a, self.ends_a, np.diff(i + 1, prepend=0), self.b, self.ends_b, np.diff(j + 1, prepend=0), sizes)

    def texts(self, va: Vocabulary, vb: Vocabulary) -> list[bytes]:
        """Every document's groups, `a1,a2|b1;a3|b2`."""
        n = len(self.a) + len(self.b)
        groups = int(self.group_a[-1]) + 1
        a_to, b_to = np.cumsum(np.bincount(self.group_a, minlength=groups)), np.cumsum(np.bincount(self.group_b, minlength=groups))
        at_a = np.arange(len(self.a)) + np.append(0, b_to)[self.group_a]
        at_b = np.arange(len(self.b)) + a_to[self.group_b]
        width = max(va.digits.shape[1], vb.digits.shape[1])
        text = np.zeros((n, width + 1), np.uint8)
        text[at_a, :va.digits.shape[1]] = va.digits[self.a]
        text[at_b, :vb.digits.shape[1]] = vb.digits[self.b]
        text[at_a, width] = np.where(np.append(self.group_a[1:] == self.group_a[:-1], False), ord(","), ord("|"))
        text[at_b, width] = np.where(np.append(self.group_b[1:] == self.group_b[:-1], False), ord(","), ord(";"))
        last = np.cumsum(self.n_a + self.n_b)
        text[last - 1, width] = 0
        flat = text.ravel()
        upto = np.append(0, np.cumsum(np.count_nonzero(text, axis=1))[last - 1]).tolist()
        joined = flat[flat != 0].tobytes()
        return [joined[lo:hi] for lo, hi in zip(upto, upto[1:])]

    def groups(self) -> list[list[dict]]:
        """Every document's groups with byte ranges in space + text."""
        out, a_at, b_at, start = [], 0, 0, 0
        ends, n_a, n_b = self.ends.tolist(), np.bincount(self.group_a).tolist(), np.bincount(self.group_b).tolist()
        g = 0
        for n, shift in zip(self.n_groups.tolist(), self.shift.tolist()):
            rows = []
            for i in range(g, g + n):
                rows.append({"start": start - shift, "end": ends[i] - shift, "a": self.a[a_at:a_at + n_a[i]].tolist(), "b": self.b[b_at:b_at + n_b[i]].tolist()})
                start, a_at, b_at = ends[i], a_at + n_a[i], b_at + n_b[i]
            g += n
            out.append(rows)
        return out


def _aligner(shared) -> Aligner:
    """One per worker process."""
    files = shared.value
    key = hash(files)
    if key not in _made:
        _made.clear()
        _made[key] = Aligner(*files)
    return _made[key]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    """(doc_ids, texts) of about CHUNK code points."""
    ids, texts, size = [], [], 0
    for b in batches:
        for doc_id, text in zip(b.column(0), b.column(1)):
            ids.append(doc_id.as_py())
            texts.append(text.as_py())
            size += len(texts[-1] or "") + 16
            if size >= CHUNK:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _pack(places: np.ndarray, times: np.ndarray) -> bytes:
    """Ascending places as steps, and how often each occurs."""
    return zstandard.compress(np.concatenate([np.diff(places, prepend=0), times]).astype(np.uint32).tobytes(), 1)


def _unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(zstandard.decompress(packed), np.uint32).astype(np.int64)
    return np.cumsum(x[:len(x) // 2]), x[len(x) // 2:]


class Block:
    """Documents of one block: rows, and the units of each by their numbers in the process."""

    def __init__(self, al: Aligner):
        self.al, self.name = al, int.from_bytes(os.urandom(8), "little") >> 1
        self.rows: list[tuple] = []
        self.docs: list[tuple[np.ndarray, np.ndarray] | None] = []
        self.size = 0

    def add(self, doc_id: int | None, units: np.ndarray) -> None:
        if not len(units) or (units < 0).any():
            self.rows.append((doc_id, 0, 0, 0, 0, ""))
            self.docs.append(None)
            return
        counts = self.al.counts[units].sum(0).tolist()
        self.rows.append((doc_id, *counts, hashlib.sha256(b";".join([self.al.texts[i] for i in units.tolist()])).hexdigest()))
        self.docs.append(np.unique(units, return_counts=True))
        self.al.seen[self.docs[-1][0]] += 1
        self.size += counts[3]

    def batches(self) -> Iterator[pa.RecordBatch]:
        fields = [f.split()[0] for f in PARTS.split(", ")]
        have = [d for d in self.docs if d is not None]
        used, place = np.unique(np.concatenate([d[0] for d in have] or [np.empty(0, np.int64)]), return_inverse=True)
        times = np.bincount(place, np.concatenate([d[1] for d in have] or [np.empty(0)]), len(used)).astype(np.int64)
        at = iter(np.split(place, np.cumsum([len(d[0]) for d in have])[:-1]) if have else [])
        links = [None if d is None else _pack(next(at), d[1]) for d in self.docs]
        for i in range(0, len(self.rows), 5000):
            some = self.rows[i:i + 5000]
            n = len(some)
            yield pa.RecordBatch.from_arrays(
                [pa.array([self.name] * n, pa.int64()), *[pa.array(c, pa.int64()) for c in list(zip(*some))[:5]], pa.array([r[5] for r in some], pa.string()),
                 pa.array(links[i:i + 5000], pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.int64()))], fields)
        if not have:
            return
        sizes = self.al.counts[used, 3]
        pairs, pair = np.unique(self.al.pairs_of(used), return_inverse=True)
        counts = np.bincount(pair, np.repeat(times, sizes), len(pairs)).astype(np.int64)
        # the units' pairs travel with the documents
        empty, head = [pa.nulls(1, pa.int64())] * 5, _pack(np.cumsum(sizes), sizes)
        yield pa.RecordBatch.from_arrays([pa.array([self.name], pa.int64()), *empty, pa.nulls(1, pa.string()), pa.array([head + zstandard.compress(pair.astype(np.uint32).tobytes(), 1)]),
                                          pa.array([len(head)], pa.int32()), pa.nulls(1, pa.list_(pa.int64())), pa.nulls(1, pa.list_(pa.int64()))], fields)
        for i in range(0, len(pairs), ENTRIES):
            yield pa.RecordBatch.from_arrays(
                [pa.array([self.name], pa.int64()), *empty, pa.nulls(1, pa.string()), pa.nulls(1, pa.binary()), pa.array([i], pa.int32()),
                 pa.array([pairs[i:i + ENTRIES]], pa.list_(pa.int64())), pa.array([counts[i:i + ENTRIES]], pa.list_(pa.int64()))], fields)


def give_back() -> None:
    """Return freed memory to the machine: the process lives on and serves other steps."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def _parts(shared):
    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        al = _aligner(shared)
        block = Block(al)
        gc.disable()                        # millions of small tuples, no cycles among them
        for ids, texts in _chunks(batches):
            if len(al.texts) > MEMO_UNITS or al.bytes > MEMO_BYTES:
                yield from block.batches()
                al.forget()
                block = Block(al)
            split = [al.split(t) if t else [] for t in texts]
            units = list(itertools.chain.from_iterable(split))
            numbers = np.fromiter(map(al.number.get, units, itertools.repeat(-2)), np.int64, len(units))
            new = [units[i] for i in np.flatnonzero(numbers == -2).tolist()]
            al.learn(list(dict.fromkeys(new)))
            numbers[numbers == -2] = np.fromiter(map(al.number.__getitem__, new), np.int64, len(new))
            for doc_id, own in zip(ids, np.split(numbers, np.cumsum([len(x) for x in split])[:-1])):
                block.add(doc_id, own)
                if block.size >= BLOCK:
                    yield from block.batches()
                    block = Block(al)
        yield from block.batches()
        al.forget(1 << 62)
        gc.enable()
        give_back()
    return parts


def _weigh(key, docs: pa.Table, entries: pa.Table) -> pa.Table:
    """A block's documents, its units' pairs and its pairs with their corpus-wide count
    and whether it is their B id's best."""
    place = entries["place"].to_numpy()
    count, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
    count[place], best[place] = entries["total"].to_numpy(), entries["best"].to_numpy()
    of_units = docs.filter(pc.is_valid(docs["first"]))
    packed, cut = of_units["links"][0].as_py(), of_units["first"][0].as_py()
    _, sizes = _unpack(packed[:cut])
    pair = np.frombuffer(zstandard.decompress(packed[cut:]), np.uint32)
    start = np.cumsum(sizes) - sizes
    unit_sum, unit_best = np.add.reduceat(count[pair], start), np.add.reduceat(best[pair], start)
    docs = docs.filter(pc.is_null(docs["first"]))
    sums, bests = [], []
    for links in docs["links"].to_pylist():
        where, times = _unpack(links)
        sums.append(int((unit_sum[where] * times).sum()))
        bests.append(int((unit_best[where] * times).sum()))
    columns = {c: docs[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")}
    return pa.table(columns | {"n_best": pa.array(bests, pa.int64()), "count_sum": pa.array(sums, pa.int64()), "groups_sha256": docs["groups_sha256"]})


def _files(spark: SparkSession, a: str, b: str):
    """Contents of both files, broadcast: executors need no copy of them (some MB, whatever the corpus)."""
    return spark.sparkContext.broadcast((open(a, "rb").read(), open(b, "rb").read()))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def align(docs: DataFrame, a: str = f"{FOLDER}/{A_FILE}", b: str = f"{FOLDER}/{B_FILE}") -> DataFrame:
    """Counts of every row of ``docs`` (doc_id bigint, text): tokens of A and B, groups,
    links, links that are their B id's most frequent in the corpus (ties included), and
    the sum over links of their pair's corpus-wide count; SHA-256 of the groups.

    Null or empty texts, and those whose joined tokens do not give back space + text,
    have no tokens: zeros and an empty digest, and they add nothing to the counts.
    Repeated rows and rows without doc_id stay and count each.  An empty table gives no
    rows; other columns are ignored.  Texts are encoded whole."""
    spark = docs.sparkSession
    parts = stage(_texts(docs).mapInArrow(_parts(_files(spark, a, b)), PARTS), "align-parts")
    entries = parts.where("pairs IS NOT NULL").select("block", "first", F.posexplode(F.arrays_zip("pairs", "counts")).alias("i", "x")) \
        .select("block", (F.col("first") + F.col("i")).alias("place"), F.col("x.pairs").alias("pair"), F.col("x.counts").alias("c"))
    totals = stage(entries.groupBy("pair").agg(F.sum("c").alias("total")), "align-totals")
    n_b = sentencepiece.SentencePieceProcessor(model_file=b).get_piece_size()
    b_id = F.col("pair") % n_b
    top = totals.groupBy(b_id.alias("b_id")).agg(F.max("total").alias("most"))              # one row per id of B
    totals = totals.join(F.broadcast(top), b_id == F.col("b_id")).select("pair", "total", (F.col("total") == F.col("most")).cast("bigint").alias("best"))
    weighed = entries.select(F.col("block").alias("of"), "place", "pair").join(totals, "pair").select("of", "place", "total", "best")
    rows = parts.where("pairs IS NULL").select("block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links", "first")
    linked = rows.where("links IS NOT NULL").groupBy("block").cogroup(weighed.groupBy("of")).applyInArrow(_weigh, OUT)
    none = F.lit(0).cast("bigint")
    return linked.union(rows.where("links IS NULL").select("doc_id", "n_a", "n_b", "n_groups", "n_links", none, none, "groups_sha256"))


def aligned_groups(docs: DataFrame, a: str = f"{FOLDER}/{A_FILE}", b: str = f"{FOLDER}/{B_FILE}") -> DataFrame:
    """The groups themselves, one row per row of ``docs``: doc_id and an array of
    (start, end: bytes of space + text, a and b: ids), empty without tokens."""
    shared = _files(docs.sparkSession, a, b)

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        al = _aligner(shared)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))
        for ids, texts in _chunks(batches):
            some = [i for i, t in enumerate(texts) if t]
            good, j = al.encode([" " + texts[i] for i in some])
            rows: list = [[]] * len(ids)
            for i, g in zip(good, j.groups() if good else []):
                rows[some[i]] = g
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(rows, kind)], ["doc_id", "groups"])
    return _texts(docs).mapInArrow(spans, SPANS)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"))


ORACLE: dict[str, str] = {}
QUERIES = {"op11_token_alignment": op11_token_alignment}
ship_by_value(__name__)
