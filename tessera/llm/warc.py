"""WARC archives as a Spark data source, and archiving of pages with one copy of each payload.

``spark.dataSource.register(WarcSource)`` gives the format ``warc``. Writing makes gzip archives, one member for each
record, with the skip length of the member in its header. Tasks write attempts of their own; the commit moves
those that count, so lost tasks leave nothing. A file is closed at ``maxBytes``.

Reading takes any archive: gzip with a member for each record or for several, and plain files. It plans partitions of whole
files, small ones together, up to ``splitBytes`` or an even share for each of ``tasks``; a record inside a file is only known from
those before it, so files aren't split. Comparisons of the record's type
and of named header fields with constants are pushed to the reader (``spark.sql.python.filterPushdown.enabled``).
It reads a record's headers first; if they don't pass, or if neither ``payload`` is in the schema nor ``verify`` is
set, it doesn't decode the payload: it skips the rest by the member's length or, in plain files, by Content-Length; other gzip
members must be inflated to find their end, of which nothing is kept. ``verify`` checks payloads of responses against length and digest.

Files are opened with pyarrow's file systems: local, HDFS, S3, GCS and others by URI.

Defined cases for :func:`archive_pages`: null html is an empty payload; of equal payloads the one with the smallest page_id is the
response, with all rows that repeat that id; null ids come last; null urls are left out; an empty table
gives an empty archive and result; input columns besides page_id, url and html aren't read. In records that others wrote, absent fields
are null, and payload_bytes is counted where the payload is read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import time
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, WriterCommitMessage

from tessera.llm.scratch import materialise
from tessera.llm.skew import SHARE

RECORD = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"
FIELDS = {"url": "WARC-Target-URI", "record_type": "WARC-Type", "payload_digest": "WARC-Payload-Digest", "page_id": "X-Page-Id", "refers_to": "X-Refers-To-Page-Id", "payload_bytes": "X-Payload-Length"}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_EXTRA = struct.Struct("<2sHII")
#: Bytes of a partition that is worth a task; payload digests that are broadcast (some 100 bytes each), at most.
LEAST, FEW = 1 << 20, 200_000


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _name(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{digest}')}>"


def member(data: bytes) -> bytes:
    """A gzip member with its own length in an extra field."""
    pack = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = pack.compress(data) + pack.flush()
    size = 12 + _EXTRA.size + len(body) + 8
    head = b"\x1f\x8b\x08\x04" + bytes(4) + b"\x00\xff" + struct.pack("<H", _EXTRA.size) + _EXTRA.pack(b"sl", 8, size, len(data) & 0xFFFFFFFF)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def record(page_id: int | None, url: str | None, kind: str, size: int, digest: str, refers_to: int | None, payload: bytes | None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """The bytes of a WARC record."""
    block = b"" if kind == "revisit" else b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n%b" % (len(payload or b""), payload or b"")
    head = {"WARC-Type": kind, "WARC-Record-ID": _name(page_id, digest), "WARC-Date": date, "WARC-Target-URI": url and " ".join(url.split()), "X-Page-Id": page_id, "WARC-Payload-Digest": f"sha1:{digest}", "X-Payload-Length": size}
    if kind == "revisit":
        head |= {"WARC-Refers-To": _name(refers_to, digest), "X-Refers-To-Page-Id": refers_to, "WARC-Profile": PROFILE}
    head |= {"Content-Type": "application/http; msgtype=response", "Content-Length": len(block)}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None)
    return f"WARC/1.1\r\n{lines}\r\n".encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


@dataclass
class Files(InputPartition):
    paths: tuple[str, ...]

    def __init__(self, paths: tuple[str, ...]):
        self.paths = paths


@dataclass
class Written(WriterCommitMessage):
    files: tuple[str, ...]


class Stream:
    """The bytes of a plain file or of all members of a gzip file, some at a time."""

    PIECE = 1 << 16

    def __init__(self, source: pa.NativeFile, packed: bool):
        self.source, self.held, self.raw, self.packed = source, b"", b"", packed
        self.unpack = zlib.decompressobj(31)

    def _more(self) -> bool:
        if not self.packed:
            piece = self.source.read(self.PIECE)
        else:
            piece = b""
            while not piece:
                if self.unpack.eof:
                    self.raw, self.unpack = self.unpack.unused_data, zlib.decompressobj(31)
                self.raw = self.raw or self.source.read(self.PIECE)
                if not self.raw:
                    break
                piece = self.unpack.decompress(self.raw, self.PIECE)
                self.raw = self.unpack.unconsumed_tail
        self.held += piece
        return bool(piece)

    def until(self, mark: bytes) -> bytes | None:
        """What stands before the next ``mark``, which is passed; none at the end."""
        at = 0
        while (n := self.held.find(mark, at)) < 0:
            at = max(0, len(self.held) - len(mark))
            if not self._more():
                return None
        out, self.held = self.held[:n], self.held[n + len(mark) :]
        return out

    def take(self, n: int, keep: bool) -> bytes:
        """The next ``n`` bytes; nothing unless ``keep``."""
        out = []
        while n:
            if not self.held and not keep and not self.packed:
                self.source.seek(min(self.source.tell() + n, self.source.size()))
                break
            if not self.held and not self._more():
                break
            part, self.held = self.held[:n], self.held[n:]
            n -= len(part)
            if keep:
                out.append(part)
        return b"".join(out)


def _fields(text: bytes) -> dict[str, str]:
    """Header fields by lower-case name."""
    out: dict[str, str] = {}
    for line in text.decode("utf-8", "surrogatepass").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        out[name.strip().lower()] = value.strip()
    return out


class Reader(DataSourceReader):
    def __init__(self, schema, options: dict):
        self.columns = schema.names
        self.path, self.split, self.tasks = options["path"], int(options.get("splitbytes", 128 << 20)), int(options.get("tasks", 1))
        self.verify = str(options.get("verify", "false")).lower() == "true"
        self.filters: list[tuple[str, tuple]] = []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            name = ".".join(f.attribute) if hasattr(f, "attribute") else ""
            if isinstance(f, EqualTo) and name in FIELDS:
                self.filters.append((name, (f.value,)))
            elif isinstance(f, In) and name in FIELDS:
                self.filters.append((name, tuple(f.value)))
            elif isinstance(f, IsNotNull) and name in FIELDS:
                self.filters.append((name, ()))
            else:
                yield f

    def partitions(self) -> list[Files]:
        system, path = _open(self.path)
        found = [f for f in system.get_file_info(fs.FileSelector(path, allow_not_found=True)) if f.is_file and f.base_name.endswith((".warc.gz", ".warc"))]
        out, held, size = [], [], 0
        split = min(self.split, max(LEAST, sum(f.size for f in found) // self.tasks))
        for f in sorted(found, key=lambda f: (-f.size, f.path)):
            if held and size + f.size > split:
                out.append(Files(tuple(held)))
                held, size = [], 0
            held.append(f.path)
            size += f.size
        return out + [Files(tuple(held))] if held or not out else out

    def read(self, partition: Files) -> Iterator[tuple]:
        system, _ = _open(self.path)
        for path in partition.paths:
            with system.open_input_file(path) as source:
                yield from self._records(source, path)

    def _records(self, source: pa.NativeFile, path: str) -> Iterator[tuple]:
        at, end = 0, source.size()
        while at < end:
            source.seek(at)
            head = source.read(12 + _EXTRA.size)
            if len(head) < 24 or head[:4] != b"\x1f\x8b\x08\x04" or head[12:14] != b"sl":
                # From here on the records of others.
                source.seek(at)
                yield from self._foreign(Stream(source, head[:2] == b"\x1f\x8b"), path)
                return
            size = _EXTRA.unpack(head[12:])[2]
            unpack, data = zlib.decompressobj(-15), b""
            left = size - len(head) - 8
            while b"\r\n\r\n" not in data and left > 0:
                piece = source.read(min(left, 4096))
                left -= len(piece)
                data += unpack.decompress(piece)
            at += size
            text, _, rest = data.partition(b"\r\n\r\n")
            fields = _fields(text)
            row = self._row(fields)
            if not self._passes(row):
                continue
            if self._wanted(row):
                self._fill(row, fields, (rest + unpack.decompress(source.read(left)) + unpack.flush())[: int(fields["content-length"])], path)
            yield tuple(row.get(c) for c in self.columns)

    def _foreign(self, stream: Stream, path: str) -> Iterator[tuple]:
        while (text := stream.until(b"\r\n\r\n")) is not None:
            text = text.lstrip(b"\r\n")
            if not text:
                continue
            if not text.startswith(b"WARC/"):
                raise ValueError(f"{path}: no record where one should start")
            fields = _fields(text)
            row, size = self._row(fields), int(fields["content-length"])
            passes = self._passes(row)
            block = stream.take(size, passes and self._wanted(row))
            # Two line ends close a record, if it isn't the file's last.
            stream.take(4, False)
            if passes:
                if self._wanted(row):
                    if len(block) < size:
                        raise ValueError(f"{path}: the file ends inside a record")
                    self._fill(row, fields, block, path)
                yield tuple(row.get(c) for c in self.columns)

    def _passes(self, row: dict) -> bool:
        return all((row[k] in v) if v else row[k] is not None for k, v in self.filters)

    def _wanted(self, row: dict) -> bool:
        return ("payload" in self.columns or self.verify) and row["record_type"] != "revisit"

    def _fill(self, row: dict, fields: dict[str, str], block: bytes, path: str) -> None:
        """The payload: what follows the header of an HTTP message, or the whole block."""
        row["payload"] = block.partition(b"\r\n\r\n")[2] if fields.get("content-type", "").startswith("application/http") else block
        if row["payload_bytes"] is None:
            row["payload_bytes"] = len(row["payload"])
        if self.verify and row["record_type"] == "response" and fields.get("warc-payload-digest", "").startswith("sha1:"):
            if len(row["payload"]) != row["payload_bytes"] or base64.b32encode(hashlib.sha1(row["payload"]).digest()).decode() != row["payload_digest"]:
                raise ValueError(f"{path}: a payload differs from its length or digest")

    @staticmethod
    def _row(fields: dict[str, str]) -> dict:
        row: dict = {k: fields.get(h.lower()) for k, h in FIELDS.items()}
        for k in ("page_id", "refers_to", "payload_bytes"):
            row[k] = None if row[k] is None else int(row[k])
        row["payload_digest"] = (row["payload_digest"] or "").rpartition(":")[2] or None
        return row


class Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.most, self.overwrite = options["path"], int(options.get("maxbytes", 128 << 20)), overwrite
        # Set where the writer is planned, so that attempts of a task agree.
        self.date = options.get("date") or time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, path = _open(self.path)
        system.create_dir(f"{path}/_attempts", recursive=True)
        files: list[str] = []
        out, size = None, 0
        try:
            for batch in iterator:
                columns = [batch.column(c).to_pylist() for c in ("page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload")]
                for row in zip(*columns):
                    if out is None or size >= self.most:
                        if out is not None:
                            out.close()
                        files.append(f"{uuid.uuid4().hex}.warc.gz")
                        out, size = system.open_output_stream(f"{path}/_attempts/{files[-1]}", compression=None), 0
                    data = member(record(*row, self.date))
                    out.write(data)
                    size += len(data)
        finally:
            if out is not None:
                out.close()
        return Written(tuple(files))

    def commit(self, messages: list[Written | None]) -> None:
        system, path = _open(self.path)
        system.create_dir(path, recursive=True)
        if self.overwrite:
            for f in system.get_file_info(fs.FileSelector(path, allow_not_found=True)):
                if f.is_file:
                    system.delete_file(f.path)
        for m in messages:
            for name in m.files if m else ():
                system.move(f"{path}/_attempts/{name}", f"{path}/{name}")
        self._clean(system, path)
        with system.open_output_stream(f"{path}/_SUCCESS"):
            pass

    def abort(self, messages: list[Written | None]) -> None:
        self._clean(*_open(self.path))

    @staticmethod
    def _clean(system: fs.FileSystem, path: str) -> None:
        if system.get_file_info(f"{path}/_attempts").type == fs.FileType.Directory:
            system.delete_dir(f"{path}/_attempts")


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return RECORD

    def reader(self, schema) -> Reader:
        return Reader(schema, self.options)

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options, overwrite)


def payload_digest(payload: Column) -> Column:
    """Upper-case base32 SHA-1 without padding: forty bits at a time."""
    digits, ours = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    sha = F.sha1(payload)
    return F.concat(*[F.translate(F.lpad(F.conv(F.substring(sha, 10 * k + 1, 10), 16, 32), 8, "0"), digits, ours) for k in range(4)])


def archive_pages(pages: DataFrame, path: str) -> None:
    """Write a record for each page below ``path``."""
    pages.sparkSession.dataSource.register(WarcSource)
    known = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce("html", F.lit("")), "utf-8").alias("payload")).withColumn("payload_digest", payload_digest(F.col("payload")))
    slim = materialise(known.select("page_id", "payload_digest"), "digests")
    # Only payloads that repeat need to be looked up; payloads themselves aren't shuffled where those are few.
    firsts = slim.groupBy(F.col("payload_digest").alias("_digest")).agg(F.min("page_id").alias("_first"), F.count("*").alias("_n")).filter("_n > 1")
    firsts = materialise(firsts, "repeated-payloads")
    same = F.col("payload_digest") == F.col("_digest")
    if firsts.count() <= FEW:
        joined = known.join(F.broadcast(firsts), same, "left")
    else:
        # At most 1 / SHARE digests are that frequent; rows of theirs stay where they are.
        often = F.col("_n") > max(1, int(slim.count() * SHARE))
        near = known.join(F.broadcast(firsts.filter(often)), same, "left")
        rest = near.filter("_digest is null").drop("_digest", "_first", "_n").join(firsts.filter(~often), same, "left")
        joined = near.filter("_digest is not null").unionByName(rest)
    own = F.col("_digest").isNull() | F.col("page_id").eqNullSafe(F.col("_first"))
    records = joined.select(
        "page_id", "url", F.when(own, "response").otherwise("revisit").alias("record_type"), F.octet_length("payload").cast("long").alias("payload_bytes"), "payload_digest",
        F.when(~own, F.col("_first")).alias("refers_to"), F.when(own, F.col("payload")).alias("payload"),
    )
    records.write.format("warc").mode("append").option("path", path).save()


def read_archive(spark: SparkSession, path: str, schema: str = RECORD, verify: bool = False) -> DataFrame:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("warc").schema(schema).option("verify", str(verify).lower()).option("tasks", spark.sparkContext.defaultParallelism).load(path)
