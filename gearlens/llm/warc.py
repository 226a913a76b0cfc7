"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent Zstandard frames; a bundle ends with the
seek table of its frames (a skippable frame: sizes, number, magic), so any frame
is found and decompressed alone.  An index maps every record id to its bundle,
frame and offset within the frame.  Bundles are files in a shared folder.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gearlens.session import shared_folder

from .common import ship_by_value, stage, table

#: Payloads from this size on are stored once; equal ones are revisit records.
REVISIT_MIN = 100
#: Uncompressed bytes after which a frame is closed, and of a bundle.
FRAME_BYTES, BUNDLE_BYTES = 1 << 18, 1 << 26
LEVEL = 3
#: Fixed values of the seekable format and of WARC.
SEEK_MAGIC, SKIPPABLE, VERSION = 0x8F92EAB1, 0x184D2A5E, b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A fixed date keeps repeated runs byte-equal.
DATE = "1970-01-01T00:00:00Z"
INDEX = "record_id string, page_id bigint, bundle string, frame bigint, frame_start bigint, frame_bytes bigint, offset bigint, record_bytes bigint"


def record(record_id: str, page_id, url, payload: bytes, digest: str, size: int, refers_to) -> bytes:
    """One WARC record; a revisit has the digest and size of the payload but no block."""
    revisit = refers_to is not None
    one_line = lambda s: "".join(c if c.isprintable() and c != "%" else "".join(f"%{x:02X}" for x in c.encode("utf-8", "surrogatepass")) for c in s)
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", DATE)]
    if url is not None:
        head.append(("WARC-Target-URI", one_line(url)))
    if page_id is not None:
        head.append(("X-Page-ID", str(page_id)))
    head += [("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Payload-Length", str(size))]
    if revisit:
        head += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<{name_of(refers_to)}>"), ("X-Refers-To-Page", str(refers_to))]
    block = b"" if revisit else payload
    head += [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(block)))]
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def name_of(page_id) -> str:
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}"


def parse(data: bytes, at: int = 0) -> tuple[dict, bytes, int]:
    """(headers, block, end) of the record at ``at``."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode().split("\r\n")
    if lines[0].encode() != VERSION:
        raise ValueError("no WARC record here")
    head = dict(x.split(": ", 1) for x in lines[1:])
    begin = end + 4
    stop = begin + int(head["Content-Length"])
    if data[stop:stop + 4] != b"\r\n\r\n":
        raise ValueError("record without its end")
    return head, data[begin:stop], stop + 4


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    body = b"".join(struct.pack("<II", c, d) for c, d in frames) + struct.pack("<IBI", len(frames), 0, SEEK_MAGIC)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(f, size: int) -> list[tuple[int, int, int]]:
    """(start, compressed, uncompressed size) of the frames of an open bundle."""
    f.seek(size - 9)
    n, _, magic = struct.unpack("<IBI", f.read(9))
    if magic != SEEK_MAGIC:
        raise ValueError("no seek table")
    f.seek(size - 9 - 8 * n)
    entries = struct.iter_unpack("<II", f.read(8 * n))
    out, at = [], 0
    for c, d in entries:
        out.append((at, c, d))
        at += c
    return out


class Bundle:
    """A bundle being written, under another name until it is whole."""

    def __init__(self, folder: str, name: str):
        self.fs, self.folder = pafs.FileSystem.from_uri(folder)
        self.name, self.path = name, f"{self.folder}/{name}"
        self.temporary = f"{self.folder}/_{name}.{uuid.uuid4().hex}"
        self.out, self.zstd = self.fs.open_output_stream(self.temporary), zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)
        self.frames, self.at, self.total, self.open, self.size, self.rows = [], 0, 0, [], 0, []

    def add(self, record_id: str, page_id, data: bytes) -> None:
        self.rows.append([record_id, page_id, self.name, len(self.frames), self.at, 0, self.size, len(data)])
        self.open.append(data)
        self.size += len(data)
        if self.size >= FRAME_BYTES:
            self.close_frame()

    def close_frame(self) -> None:
        if self.open:
            c = self.zstd.compress(b"".join(self.open))
            self.out.write(c)
            for r in self.rows[::-1]:
                if r[3] != len(self.frames):
                    break
                r[5] = len(c)
            self.frames.append((len(c), self.size))
            self.at += len(c)
            self.total += self.size
            self.open, self.size = [], 0

    def close(self) -> list[list]:
        self.close_frame()
        self.out.write(seek_table(self.frames))
        self.out.close()
        self.fs.move(self.temporary, self.path)
        return self.rows


def _writer(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, bundle = TaskContext.get().partitionId(), 0, None
        names = [x.split()[0] for x in INDEX.split(", ")]
        kinds = [pa.string() if x.split()[1] == "string" else pa.int64() for x in INDEX.split(", ")]
        n = 0

        def done():
            rows = list(zip(*bundle.close())) or [[] for _ in names]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds)], names)

        for b in batches:
            for page_id, url, html, digest, size, refers in zip(*(b.column(i) for i in range(6))):
                # each attempt has bundles of its own: the index that is committed names those it describes
                bundle = bundle or Bundle(folder, f"part-{part:06d}-{k:04d}-{uuid.uuid4().hex[:12]}.warc.zst")
                page_id, refers = page_id.as_py(), refers.as_py()
                payload = b"" if refers is not None else (html.as_py() or "").encode("utf-8", "surrogatepass")
                record_id = name_of(page_id) if page_id is not None else f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'row:{part}:{n}')}"
                n += 1
                bundle.add(record_id, page_id, record(record_id, page_id, url.as_py(), payload, digest.as_py(), size.as_py(), refers))
                if bundle.total >= BUNDLE_BYTES:
                    yield done()
                    bundle, k = None, k + 1
        if bundle:
            yield done()
    return write


def revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, html, payload_digest, payload_bytes, refers_to (the smallest page_id
    with an equal payload of at least ``REVISIT_MIN`` bytes, null for itself)."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    p = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"),
                     F.sha2(payload, 256).alias("payload_digest"), F.octet_length(payload).cast("bigint").alias("payload_bytes"))
    groups = p.where(F.col("payload_bytes") >= REVISIT_MIN).groupBy("payload_digest").agg(
        F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("payload_digest").alias("__digest"), "first")
    # both sides are scans, so a payload with very many copies is split by the skew join
    p = p.join(stage(groups, "warc-groups"), F.col("payload_digest") == F.col("__digest"), "left")
    to = F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("first")), F.col("first"))
    return p.select("page_id", "url", F.when(to.isNull(), F.col("html")).alias("html"), "payload_digest", "payload_bytes", to.alias("refers_to"))


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write ``pages`` (page_id bigint, url, html) as bundles into ``folder`` (a shared
    URI) and return the written index (INDEX).

    Null html: an empty payload.  Null page_id: a record without that header,
    never the one that others revisit.  Rows that repeat the smallest page_id of
    a payload are all responses.  An empty table writes no bundle.  Other columns
    are ignored.  The index is written beside the bundles (``index``), in place of an
    earlier one; every attempt of a task writes bundles of its own, of which the index
    names those of the attempt that counts, whatever order its rows came in."""
    fs, path = pafs.FileSystem.from_uri(folder)
    fs.create_dir(path)
    index = f"{folder.rstrip('/')}/index"
    revisits(pages).mapInArrow(_writer(folder), INDEX).write.mode("overwrite").parquet(index)
    return pages.sparkSession.read.schema(INDEX).parquet(index)


def _reader(folder: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        zstd, name, f, where = zstandard.ZstdDecompressor(), None, None, []
        for b in batches:
            rows = {k: [] for k in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "bundle", "frame", "whole")}
            for bundle, frame, index in b.to_pandas()[["bundle", "frame", "records"]].itertuples(index=False):
                if bundle != name:
                    name, f = bundle, fs.open_input_file(f"{root}/{bundle}")
                    where = read_seek_table(f, f.size())
                start, compressed, size = where[frame]
                f.seek(start)
                data = zstd.decompress(f.read(compressed), max_output_size=size)
                for r in index:
                    head, block, end = parse(data, r["offset"])
                    revisit = head["WARC-Type"] == "revisit"
                    digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
                    whole = end - r["offset"] == r["record_bytes"] and head["WARC-Record-ID"] == f"<{r['record_id']}>" and (
                        revisit or hashlib.sha256(block).hexdigest() == digest and len(block) == int(head["X-Payload-Length"]))
                    for k, v in (("page_id", int(head["X-Page-ID"]) if "X-Page-ID" in head else None),
                                 ("payload_bytes", int(head["X-Payload-Length"])), ("payload_digest", digest), ("record_type", head["WARC-Type"]),
                                 ("refers_to", int(head["X-Refers-To-Page"]) if revisit else None), ("record_id", r["record_id"]), ("bundle", bundle), ("frame", int(frame)), ("whole", bool(whole))):
                        rows[k].append(v)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows.values(), kinds)], list(rows))
    return read


def read_archives(index: DataFrame, folder: str) -> DataFrame:
    """Records of the bundles of ``folder`` named by ``index`` rows, read frame by frame
    through the seek tables: page_id, payload_bytes, payload_digest, record_type,
    refers_to, record_id, bundle, frame, whole (the record lies where the index says
    and a response's block has its digest and length)."""
    frames = index.groupBy("bundle", "frame").agg(F.collect_list(F.struct("offset", "record_bytes", "record_id")).alias("records"))
    return frames.mapInArrow(_reader(folder), "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, "
                                              "record_id string, bundle string, frame bigint, whole boolean")


def op10_seekable_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, f"llm/warc-{uuid.uuid4().hex}")
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    index = write_archives(table(spark, sf_dir, "pages"), folder)
    return read_archives(index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "whole")


ORACLE = {"op10_seekable_warc": f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p GROUP BY d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
  CASE WHEN n >= {REVISIT_MIN} AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= {REVISIT_MIN} AND page_id <> first THEN first END AS refers_to, true AS whole FROM p JOIN f USING (d)"""}
QUERIES = {"op10_seekable_warc": op10_seekable_warc}
ship_by_value(__name__)
