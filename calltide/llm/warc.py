"""A WARC data source in Python: reads and writes archives, plans partitions of files, pushes filters down to record headers.

Archives are gzipped record by record. Each member notes its compressed size in its gzip header (subfield "sl"), so a reader
inflates a record's headers first and, when filters or the ``payload`` option leave its payload unwanted, goes on to the next
record without inflating the rest. Archives of other writers, plain or gzipped, are read too: plain ones are skipped through by
Content-Length, gzipped ones are inflated and thrown away.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringEndsWith, StringStartsWith, WriterCommitMessage

from calltide.llm.common import Stored

SCHEMA = "record_id string, warc_type string, target_uri string, warc_date string, payload_digest string, refers_to string, content_length bigint, payload_length bigint, payload binary, read_digest string"
#: Columns that headers alone fill, and the headers.
HEADERS = {"record_id": "warc-record-id", "warc_type": "warc-type", "target_uri": "warc-target-uri", "warc_date": "warc-date", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to"}
LENGTH_HEADER = "WARC-X-Payload-Length"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNK = 1 << 20


def open_fs(path: str):
    """A file system and the path in it; a path without scheme is local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def b32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_bytes(headers: list[tuple[str, str]], block: bytes) -> bytes:
    clean = "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + clean.encode() + b"\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 4) -> bytes:
    """One gzip member with its whole size and its content's size in an extra field."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    size = 10 + 2 + 12 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, size & 0xFFFFFFFF, len(data) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def parse_headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record begins here: {lines[0][:60]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:] if line)}


def headers_of(more: Callable[[], bytes]) -> tuple[bytes, int]:
    """Bytes up to the blank line that ends the headers at least, however long they are, and where it ends."""
    data, cut, looked = bytearray(), -1, 0
    while cut < 0 and (got := more()):
        data += got
        cut = data.find(b"\r\n\r\n", looked)
        looked = max(0, len(data) - 3)
    if cut < 0 and data.strip():
        raise ValueError(f"a record's headers have no end: {bytes(data[:60])!r}")
    return bytes(data), cut + 4


class Records:
    """Iterates over (headers, get_block): ``get_block()`` decodes the record's block; if it isn't called, the block is passed over."""

    def __init__(self, stream, length: int):
        self.stream, self.length = stream, length
        self.skipped = 0  # bytes never inflated or read

    def __iter__(self):
        magic = self.stream.read(2)
        self.stream.seek(0)
        return self._gzipped() if magic == b"\x1f\x8b" else self._plain()

    def _plain(self):
        at = 0
        while at < self.length:
            self.stream.seek(at)
            head, cut = headers_of(lambda: self.stream.read(4096))
            if not head.strip():
                return
            headers = parse_headers(head[: cut - 4])
            size, begin = int(headers.get("content-length", 0)), at + cut
            taken = []

            def block(begin=begin, size=size, taken=taken):
                taken.append(1)
                self.stream.seek(begin)
                return self.stream.read(size)

            yield headers, block
            if not taken:
                self.skipped += size
            at = begin + size + 4

    def _gzipped(self):
        at = 0
        while at < self.length:
            self.stream.seek(at)
            raw = self.stream.read(16384)
            if len(raw) < 18:
                return
            size = None
            if raw[3] & 4 and raw[12:14] == b"sl":
                size = int.from_bytes(raw[16:20], "little") or None
            inflate = zlib.decompressobj(31)
            first = [raw]

            def inflated(inflate=inflate, first=first):
                while not inflate.eof and (more := first.pop() if first else self.stream.read(16384)):
                    if got := inflate.decompress(more):
                        return got
                return b""

            data, cut = headers_of(inflated)
            headers = parse_headers(data[: cut - 4])
            rest, length = [data[cut:]], int(headers.get("content-length", 0))

            def finish(keep: bool, inflate=inflate, rest=rest):
                while not inflate.eof and (more := self.stream.read(CHUNK)):
                    got = inflate.decompress(more)
                    if keep:
                        rest.append(got)

            taken = []

            def block(finish=finish, rest=rest, length=length, taken=taken):
                taken.append(1)
                finish(True)
                return b"".join(rest)[:length]

            yield headers, block
            if size is None:
                finish(False)
                at = self.stream.tell() - len(inflate.unused_data)
            else:
                if not taken:
                    self.skipped += size
                at += size


def http_payload(headers: dict[str, str], block: bytes) -> bytes:
    if headers.get("content-type", "").startswith("application/http"):
        return block.partition(b"\r\n\r\n")[2]
    return block


@dataclass
class Files(InputPartition):
    paths: list[str]


class WarcReader(DataSourceReader):
    """Options: path (a file or folder), payload ("bytes", "digest": read_digest and payload_length without the bytes, "skip"), partitionBytes."""

    def __init__(self, options: dict[str, str]):
        self.options, self.tests = dict(options), []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if column in HEADERS and isinstance(f, IsNotNull):
                self.tests.append((column, "IsNotNull", None))
            elif column in HEADERS and isinstance(f, EqualTo | In | StringStartsWith | StringEndsWith):
                self.tests.append((column, type(f).__name__, list(f.value) if isinstance(f, In) else f.value))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        """Files dealt to partitions of about ``partitionBytes``, in the order of their paths; a larger file is one of its own."""
        from pyarrow import fs

        system, at = open_fs(self.options["path"])
        info = system.get_file_info(at)
        files = [info] if info.type == fs.FileType.File else [i for i in system.get_file_info(fs.FileSelector(at, recursive=True)) if i.type == fs.FileType.File and ".warc" in i.base_name and not i.base_name.startswith((".", "_"))]
        limit, out, held = int(self.options.get("partitionbytes", self.options.get("partitionBytes", 16 << 20))), [], 0
        for i in sorted(files, key=lambda i: i.path):
            if not out or held + i.size > limit:
                out.append(Files([]))
                held = 0
            out[-1].paths.append(i.path)
            held += i.size
        return out or [Files([])]

    def wanted(self, headers: dict[str, str]) -> bool:
        for column, kind, value in self.tests:
            has = field(headers, column)
            if has is None or kind != "IsNotNull" and not (has == value if kind == "EqualTo" else has in value if kind == "In" else has.startswith(value) if kind == "StringStartsWith" else has.endswith(value)):
                return False
        return True

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        how, rows, held = self.options.get("payload", "bytes"), [], 0
        system, _ = open_fs(self.options["path"])
        for path in partition.paths:
            with system.open_input_file(path) as stream:
                for headers, block in Records(stream, stream.size()):
                    if not self.wanted(headers):
                        continue
                    length = int(headers[LENGTH_HEADER.lower()]) if LENGTH_HEADER.lower() in headers else None
                    payload = digest = None
                    if how != "skip" and headers.get("warc-type") != "revisit":
                        payload = http_payload(headers, block())
                        length, digest = len(payload), b32_sha1(payload)
                    rows.append((*(field(headers, c) for c in HEADERS), int(headers.get("content-length", 0)), length, payload if how == "bytes" else None, digest))
                    held += len(payload or b"") if how == "bytes" else 200
                    if held > 8 << 20 or len(rows) >= 4096:
                        yield _batch(rows)
                        rows, held = [], 0
        if rows:
            yield _batch(rows)


def field(headers: dict[str, str], column: str) -> str | None:
    value = headers.get(HEADERS[column])
    if value is None:
        return None
    if column in ("record_id", "refers_to"):
        return value.strip("<>").removeprefix("urn:record:")
    return value.removeprefix("sha1:") if column == "payload_digest" else value


_ARROW = pa.schema([*((c, pa.string()) for c in HEADERS), ("content_length", pa.int64()), ("payload_length", pa.int64()), ("payload", pa.binary()), ("read_digest", pa.string())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_ARROW)], schema=_ARROW)


@dataclass
class Written(WriterCommitMessage):
    path: str | None
    records: int


class WarcWriter(DataSourceArrowWriter):
    """Rows: record_id, target_uri, payload (binary), refers_to (null for responses). One file for each task.

    A task writes to a name of its own under ``_temporary``; committing the job moves the files into place, so that a task
    which runs twice leaves one file.
    """

    def __init__(self, options: dict[str, str]):
        self.options = dict(options)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, at = open_fs(self.options["path"])
        name = f"{at}/_temporary/{uuid.uuid4().hex}.warc.gz"
        date, level = self.options.get("date", "2024-01-01T00:00:00Z"), int(self.options.get("level", 4))
        n, stream = 0, None
        for batch in iterator:
            if stream is None:
                system.create_dir(f"{at}/_temporary", recursive=True)
                stream = system.open_output_stream(name, compression=None)
            for row in batch.to_pylist():
                stream.write(gzip_member(page_record(row, date), level))
                n += 1
        if stream is None:
            return Written(None, 0)
        stream.close()
        return Written(name, n)

    def commit(self, messages: list[Written | None]) -> None:
        system, at = open_fs(self.options["path"])
        system.create_dir(at, recursive=True)
        for i, message in enumerate(m for m in messages if m and m.path):
            system.move(message.path, f"{at}/part-{i:05d}-{message.path.rpartition('/')[2]}")
        system.delete_dir_contents(f"{at}/_temporary", missing_dir_ok=True)

    def abort(self, messages: list[Written | None]) -> None:
        system, at = open_fs(self.options["path"])
        system.delete_dir_contents(f"{at}/_temporary", missing_dir_ok=True)


def page_record(row: dict, date: str) -> bytes:
    payload = row["payload"] or b""
    revisit = row["refers_to"] is not None
    headers = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:record:{row['record_id']}>"), ("WARC-Date", date), ("WARC-Target-URI", row["target_uri"] or ""), ("WARC-Payload-Digest", f"sha1:{b32_sha1(payload)}"), (LENGTH_HEADER, str(len(payload))), ("Content-Type", "application/http; msgtype=response")]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: " + str(len(payload)).encode() + b"\r\n\r\n"
    if revisit:
        return record_bytes([*headers, ("WARC-Refers-To", f"<urn:record:{row['refers_to']}>"), ("WARC-Profile", REVISIT_PROFILE)], http)
    return record_bytes(headers, http + payload)


class WarcDataSource(DataSource):
    """``spark.read.format("calltide_warc").option("path", ...)``, after :func:`register`."""

    @classmethod
    def name(cls) -> str:
        return "calltide_warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def read_warc(spark: SparkSession, path: str, payload: str = "bytes") -> DataFrame:
    """Records of the archives at ``path``; see :class:`WarcReader`. No files: no rows."""
    register(spark)
    return spark.read.format("calltide_warc").option("path", path).option("payload", payload).load()


def write_pages(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit_bytes: int = 0, kept: Stored | None = None) -> None:
    """Writes a WARC record for each row. Of rows with equal payloads of ``min_revisit_bytes`` or more, the smallest id is a
    response and the others revisit it, without the payload.

    A null html is empty, a null url an empty target; a row with a null id is a response whose id reads back as "None".
    Only ids and digests are shuffled to find equal payloads; pages are joined with the rows that revisit.
    """
    spark = pages.sparkSession
    register(spark)
    kept = kept or Stored(spark, "warc")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("target_uri"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    digests = kept.write(rows.where("id IS NOT NULL").select("id", F.unhex(F.sha1("html")).alias("sha"), F.octet_length("html").alias("n")).where(F.col("n") >= min_revisit_bytes), "digests")
    first = digests.groupBy("sha", "n").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").drop("last")
    first = kept.write(first, "first")  # a table of its own, so that a payload of very many pages doesn't meet in one task of the join
    revisits = kept.write(digests.join(first, ["sha", "n"]).where("id > first").select("id", "first").distinct(), "revisits")
    out = rows.join(revisits, "id", "left").select(F.col("id").cast("string").alias("record_id"), "target_uri", F.encode("html", "UTF-8").alias("payload"), F.col("first").cast("string").alias("refers_to"))
    out.write.format("calltide_warc").option("path", path).mode("append").save()


def archive_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit_bytes: int = 0) -> DataFrame:
    """Writes ``pages`` to the shared folder and reads the archives back: ``id_col``, payload_bytes, payload_digest, record_type, refers_to.

    Responses and revisits are two reads, each with its record type pushed down to the headers: payloads are inflated for
    responses alone, whose length and digest come from them; a revisit's come from its headers.
    """
    kept = Stored(pages.sparkSession, "warc")
    at = kept.path("archives")
    write_pages(pages, at, id_col, url_col, html_col, min_revisit_bytes, kept)
    kind = pages.select(id_col).dtypes[0][1]
    responses = read_warc(pages.sparkSession, at, "digest").where("warc_type = 'response'").drop("payload_digest").withColumnRenamed("read_digest", "payload_digest")
    revisits = read_warc(pages.sparkSession, at, "skip").where("warc_type = 'revisit'").drop("read_digest")
    return responses.unionByName(revisits).select(
        F.when(F.col("record_id") != "None", F.col("record_id")).cast(kind).alias(id_col), F.col("payload_length").alias("payload_bytes"),
        "payload_digest", F.col("warc_type").alias("record_type"), F.col("refers_to").cast(kind).alias("refers_to"),
    )
