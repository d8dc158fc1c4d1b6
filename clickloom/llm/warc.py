"""WARC archives with a two-level capture index.

Records are compressed one by one, so that a range of bytes is a whole record. The index
lists captures sorted by reversed-host URL key in compressed blocks of ``BLOCK_LINES``
lines; a sparse directory has the first key and the byte range of every block. A lookup
finds the index part by its first key, the block by binary search in the part's
directory, and the record by a range read.

Archive and index files are written by tasks through ``pyarrow.fs`` below the shared
folder, under names that no other attempt of a task uses. The list of files that count is
a Parquet table, so files of lost attempts are never read.

Payloads of at least ``MIN_DUPLICATE`` bytes that equal another one's are stored once,
with the largest page id; the others are revisit records without payload.

Defined cases: a null html is an empty payload; a null url has key ``-``; a null page id
is the smallest; rows that repeat the largest page id of a group are all responses;
an empty table gives an archive without records; other columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import posixpath
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.llm import text as T

MIN_DUPLICATE = 1000
BLOCK_LINES = 256
#: A task starts another archive file after this many bytes.
FILE_BYTES = 1 << 30
DATE = "2024-01-01T00:00:00Z"
NO_ID = "-"

CAPTURE = "url_key string, page_id long, url string, file string, offset long, length long, record_type string, payload_digest string"


def url_key(url: Column) -> Column:
    """Sort-friendly key: host labels reversed and joined by commas, then ``)`` and path with query.

    Scheme, user, port, a leading ``www.`` and the fragment are left out.
    """
    bare = F.regexp_replace(F.lower(F.trim(url)), r"^[a-z][a-z0-9+.-]*://", "")
    bare = F.regexp_replace(bare, "#.*$", "")
    authority = F.regexp_extract(bare, r"^[^/?]*", 0)
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":\d*$", ""), r"^www\d*\.", "")
    path = F.substr(bare, F.length(authority) + 1)
    path = F.when(path == "", "/").otherwise(path)
    return F.coalesce(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), path), F.lit(NO_ID))


def decide(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Pages with payload, digest, ``record_type`` and ``refers_to``."""
    rows = T.pick(pages, page_id=page_id, url=url, html=html)
    rows = rows.withColumn("payload", F.coalesce("html", F.lit("")).cast("binary")).drop("html")
    rows = rows.withColumn("payload_digest", F.sha1("payload")).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    large = rows.filter(F.col("payload_bytes") >= MIN_DUPLICATE)
    groups = large.groupBy("payload_digest").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    groups = groups.select(F.col("payload_digest").alias("g_digest"), "last")
    rows = rows.join(groups, (F.col("payload_digest") == F.col("g_digest")) & (F.col("payload_bytes") >= MIN_DUPLICATE), "left")
    revisit = F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))
    return rows.select(
        "page_id", "url", url_key(F.col("url")).alias("url_key"), "payload_digest", "payload_bytes",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("last")).alias("refers_to"),
        # a revisit record has no payload, so it need not travel further
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def record_id(page_id) -> str:
    return f"<urn:page:{NO_ID if page_id is None else page_id}>"


def build_record(page_id, url, digest: str, size: int, kind: str, refers_to, payload: bytes | None) -> bytes:
    """One uncompressed WARC record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        head.insert(3, "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.insert(4, f"WARC-Refers-To: {record_id(refers_to)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Headers and payload of an uncompressed record; the payload of a response is checked."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(http.rpartition(b"Content-Length: ")[2])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"damaged payload of {fields['WARC-Record-ID']}")
    return {
        "page_id": _page(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "payload_bytes": size, "payload_digest": digest,
        "record_type": kind, "refers_to": _page(fields.get("WARC-Refers-To")), "payload": payload if kind == "response" else None,
    }


def _page(urn: str | None) -> int | None:
    number = None if urn is None else urn.removeprefix("<urn:page:").removesuffix(">")
    return None if number in (None, NO_ID) else int(number)


def gzip_member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def gunzip(data: bytes) -> bytes:
    return zlib.decompress(data, 31)


def open_store(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
    return pafs.LocalFileSystem(), path


@dataclass(frozen=True)
class Archive:
    """Folder of an archive: ``warc/`` and ``index/`` files, with Parquet tables that list them."""

    spark: SparkSession
    folder: str
    #: First key of every index part, in order: one entry per index file.
    parts: tuple[tuple[bytes, int, str], ...]

    def captures(self) -> DataFrame:
        """All captures, as the writers recorded them."""
        return self.spark.read.schema(CAPTURE).parquet(f"{self.folder}/captures")

    def directory(self) -> DataFrame:
        """The sparse directory: one row per block."""
        return self.spark.read.schema(DIRECTORY).parquet(f"{self.folder}/directory")


DIRECTORY = "first_key string, first_page long, file string, offset long, length long, lines long"


def write_archive(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> Archive:
    """Write all pages as WARC records with their index in a new folder below the shared one."""
    spark = pages.sparkSession
    folder = T.scratch(spark, "warc")
    decide(pages, page_id, url, html).mapInArrow(_record_writer(folder), CAPTURE).write.parquet(f"{folder}/captures")
    # sorted by key, then page id, so that many captures of one URL are split over parts too
    lines = spark.read.schema(CAPTURE).parquet(f"{folder}/captures")
    lines = lines.withColumn("page_order", F.coalesce("page_id", F.lit(-(1 << 63))))
    ordered = lines.repartitionByRange(_tasks(spark), "url_key", "page_order").sortWithinPartitions("url_key", "page_order")
    ordered.mapInArrow(_index_writer(folder), DIRECTORY).write.parquet(f"{folder}/directory")
    blocks = spark.read.schema(DIRECTORY).parquet(f"{folder}/directory")
    firsts = blocks.groupBy("file").agg(F.min(F.struct("first_key", "first_page")).alias("first")).collect()
    # keys compare as UTF-8 bytes, as Spark sorts them
    parts = sorted((r["first"]["first_key"].encode(), r["first"]["first_page"], r["file"]) for r in firsts)
    return Archive(spark, folder, tuple(parts))


def _tasks(spark: SparkSession) -> int:
    """Tasks of steps whose rows are small but stand for much work, so they are not merged by size."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _record_writer(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)
        out, name, at = None, "", 0
        store.create_dir(posixpath.join(root, "warc"), recursive=True)
        try:
            for batch in batches:
                rows = []
                for row in _rows(batch):
                    if out is None or at >= FILE_BYTES:
                        if out is not None:
                            out.close()
                        name, at = f"warc/{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(posixpath.join(root, name), compression=None)
                    member = gzip_member(build_record(
                        row["page_id"], row["url"], row["payload_digest"], row["payload_bytes"], row["record_type"], row["refers_to"], row["payload"]))
                    out.write(member)
                    rows.append((row["url_key"], row["page_id"], row["url"], name, at, len(member), row["record_type"], row["payload_digest"]))
                    at += len(member)
                yield _batch(rows, CAPTURE_ARROW)
        finally:
            if out is not None:
                out.close()

    return write


CAPTURE_ARROW = pa.schema([
    ("url_key", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("file", pa.string()), ("offset", pa.int64()),
    ("length", pa.int64()), ("record_type", pa.string()), ("payload_digest", pa.string())])
DIRECTORY_ARROW = pa.schema([
    ("first_key", pa.string()), ("first_page", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("lines", pa.int64())])
FOUND = ("page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")
FOUND_ARROW = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
    ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """Rows of a batch, a few at a time, as payloads are large."""
    for at in range(0, batch.num_rows, 256):
        yield from batch.slice(at, 256).to_pylist()


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _escape(value: str) -> str:
    return value.replace("%", "%25").replace("\t", "%09").replace("\n", "%0A").replace("\r", "%0D")


def _index_line(row: dict) -> str:
    return "\t".join([_escape(row["url_key"]), str(row["page_order"]), row["file"], str(row["offset"]), str(row["length"])])


def _index_writer(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)
        store.create_dir(posixpath.join(root, "index"), recursive=True)
        name = f"index/{uuid.uuid4().hex}.idx.gz"
        out, at, lines, first, blocks = None, 0, [], None, []

        def flush():
            nonlocal at, lines
            member = gzip_member("\n".join(lines).encode())
            out.write(member)
            blocks.append((first[0], first[1], name, at, len(member), len(lines)))
            at, lines = at + len(member), []

        try:
            for batch in batches:
                for row in _rows(batch):
                    if out is None:
                        out = store.open_output_stream(posixpath.join(root, name), compression=None)
                    if not lines:
                        first = (row["url_key"], row["page_order"])
                    lines.append(_index_line(row))
                    if len(lines) == BLOCK_LINES:
                        flush()
            if lines:
                flush()
        finally:
            if out is not None:
                out.close()
        yield _batch(blocks, DIRECTORY_ARROW)

    return write


def lookup(archive: Archive, wanted: DataFrame) -> DataFrame:
    """Read the records of ``wanted`` (``url_key``, ``page_id``) through the index.

    One row per stored capture of a wanted pair; pairs that are not in the archive give
    none, and wanted pairs that repeat count once. Only the part boundaries, one per
    index file, go to every task; a task loads the directory of one part at a time.
    """
    firsts, files = [(key, page) for key, page, _ in archive.parts], [name for _, _, name in archive.parts]

    @F.pandas_udf("int")
    def part_of(key: pd.Series, page: pd.Series) -> pd.Series:
        return pd.Series([bisect.bisect_right(firsts, (k.encode(), p)) - 1 for k, p in zip(key, page)], dtype="int32")

    wanted = wanted.select("url_key", F.coalesce("page_id", F.lit(-(1 << 63))).alias("page_order")).distinct()
    wanted = wanted.withColumn("part", part_of("url_key", "page_order")).filter("part >= 0")
    # ranges of (part, key) keep neighbours together and split a large part over tasks
    wanted = wanted.repartitionByRange(_tasks(archive.spark), "part", "url_key", "page_order").sortWithinPartitions("part", "url_key", "page_order")
    directory = f"{archive.folder}/directory"
    return wanted.mapInArrow(_reader(archive.folder, directory, files), FOUND)


def _reader(folder: str, directory: str, files: list[str]):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)
        table_store, table_root = open_store(directory)
        names = [i.path for i in table_store.get_file_info(pafs.FileSelector(table_root)) if i.path.endswith(".parquet")]
        table = ds.dataset(names, filesystem=table_store, format="parquet")
        opened: dict[str, pa.NativeFile] = {}

        def range_read(name: str, offset: int, length: int) -> bytes:
            if name not in opened:
                if len(opened) >= 64:
                    opened.pop(next(iter(opened))).close()
                opened[name] = store.open_input_file(posixpath.join(root, name))
            return gunzip(opened[name].read_at(length, offset))

        part, starts, blocks, at, lines = None, [], [], None, {}
        for batch in batches:
            rows, size = [], 0
            for want in batch.to_pylist():
                if want["part"] != part:
                    part = want["part"]
                    blocks = table.to_table(filter=ds.field("file") == files[part]).sort_by("offset").to_pylist()
                    starts, at = [(b["first_key"].encode(), b["first_page"]) for b in blocks], None
                key = (want["url_key"].encode(), want["page_order"])
                # repeats of a capture may begin in the block before
                last = bisect.bisect_right(starts, key) - 1
                begin = max(0, bisect.bisect_left(starts, key) - 1)
                for b in range(begin, last + 1):
                    if at != b:
                        at, lines = b, _block(range_read(files[part], blocks[b]["offset"], blocks[b]["length"]))
                    for name, offset, length in lines.get(key, ()):
                        found = parse_record(range_read(name, offset, length))
                        rows.append(tuple(found[f.name] for f in FOUND_ARROW))
                        size += len(found["payload"] or b"")
                        if size > 8 << 20:
                            yield _batch(rows, FOUND_ARROW)
                            rows, size = [], 0
            yield _batch(rows, FOUND_ARROW)
        for handle in opened.values():
            handle.close()

    return read


def _block(data: bytes) -> dict[tuple[bytes, int], list[tuple[str, int, int]]]:
    lines: dict[tuple[bytes, int], list[tuple[str, int, int]]] = {}
    for line in data.decode().split("\n"):
        key, page, name, offset, length = line.split("\t")
        for mark, char in (("%0D", "\r"), ("%0A", "\n"), ("%09", "\t"), ("%25", "%")):
            key = key.replace(mark, char)
        lines.setdefault((key.encode(), int(page)), []).append((name, int(offset), int(length)))
    return lines
