"""WARC archives as a PySpark Python data source, and an archive of pages without repeats.

Reading: the driver lists the archive's files and packs small ones together into file
partitions. Filters on record type and on header fields are pushed down. A reader takes
a record's header first; if the pushed filters reject it, or payloads are not wanted
(option ``payload`` = ``false``), the block is not decoded: a plain file is read on
behind it, a compressed record is skipped by the length that its gzip header states
(extra field ``sl``; without one, its bytes are passed over).

Writing: each task writes files of its own, one gzip member for each record, and reports
them; only when all tasks are done does the driver write a manifest that lists them.
Files of lost or failed attempts are in no manifest and are never read.

Archive of pages: of records with equal payloads of at least ``MIN_REVISIT_BYTES`` bytes
the one with the smallest id is a ``response``, the others are ``revisit`` records that
refer to it. The two-pass Bloom filter of exact deduplication finds the possibly repeated
payloads; only those rows are shuffled.

Defined cases: null html is an empty payload; rows that repeat both id and payload of a
response are responses too; a null id is written as ``null``, reads back as null and is
the smallest only where no other is; a null url leaves the header field out; an empty
table gives an archive without records; a record that ends too early raises an error.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    In,
    InputPartition,
    IsNotNull,
    StringStartsWith,
    WriterCommitMessage,
)

from .exact_dedup import flag_repeated
from .shared import new_path, staged

MIN_REVISIT_BYTES = 100
PARTITION_BYTES = 64 << 20
FILE_BYTES = 64 << 20
READ_BYTES = 1 << 20
BATCH_BYTES = 8 << 20
SCHEMA = (
    "warc_type string, record_id string, target_uri string, warc_date string, refers_to string, payload_digest string, "
    "payload_length bigint, headers map<string,string>, payload binary"
)
# Fixed names of the format.
FIELDS = {
    "warc_type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "target_uri": "WARC-Target-URI",
    "warc_date": "WARC-Date",
    "refers_to": "WARC-Refers-To",
    "payload_digest": "WARC-Payload-Digest",
}
VERSION = "WARC/1.1"
HTTP_TYPE = "application/http; msgtype=response"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"


def file_system(path: str):
    """A file system that every executor can open, and the path in it."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)


# ---------------------------------------------------------------- records


def _line_value(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record_bytes(fields: Sequence[tuple[str, str | None]], block: bytes) -> bytes:
    lines = [VERSION, *(f"{k}: {_line_value(v)}" for k, v in fields if v is not None), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


def http_block(payload: bytes | None, length: int) -> bytes:
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n"
    return head.encode("ascii") + (payload or b"")


def gzip_member(data: bytes) -> bytes:
    """One gzip member whose extra field ``sl`` states its compressed and plain length."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    total = 10 + 2 + 12 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, total, len(data) & 0xFFFFFFFF)
    head = b"\x1f\x8b\x08\x04" + b"\0" * 5 + b"\xff" + struct.pack("<H", len(extra)) + extra
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def parse_header(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    out: dict[str, str] = {}
    name = None
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
        elif ":" in line:
            name, value = line.split(":", 1)
            out[name] = value.strip()
    return out


class _Source:
    """Bytes of a file with a bounded buffer."""

    def __init__(self, stream):
        self.stream, self.held = stream, b""

    def fill(self) -> bool:
        more = self.stream.read(READ_BYTES)
        self.held += more
        return bool(more)

    def peek(self, n: int) -> bytes:
        while len(self.held) < n and self.fill():
            pass
        return self.held[:n]

    def take(self, n: int) -> bytes:
        if len(self.peek(n)) < n:
            raise EOFError("a WARC record ends too early")
        out, self.held = self.held[:n], self.held[n:]
        return out

    def skip(self, n: int) -> None:
        if n <= len(self.held):
            self.held = self.held[n:]
        else:
            self.stream.seek(n - len(self.held), 1)
            self.held = b""


def plain_records(source: _Source, wanted) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """(header, block); the block is None where wanted(header) is "header", nothing comes where it is false."""
    while True:
        while source.peek(2) == b"\r\n":
            source.skip(2)
        if not source.peek(1):
            return
        end = -1
        while (end := source.held.find(b"\r\n\r\n")) < 0:
            if not source.fill():
                raise EOFError("a WARC record ends too early")
        header = parse_header(source.take(end))
        source.skip(4)
        length = int(_field(header, "Content-Length") or 0)
        want = wanted(header)
        if want == "all":
            yield header, source.take(length)
        else:
            if want:
                yield header, None
            source.skip(length)


def gzip_records(source: _Source, wanted) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """As plain_records, for one gzip member per record."""
    while source.peek(1):
        total = None
        head = source.peek(24)
        if len(head) >= 24 and head[3] & 4 and head[12:14] == b"sl":
            total = struct.unpack("<I", head[16:20])[0]
        unpacker = zlib.decompressobj(31)
        data, fed = b"", 0
        while b"\r\n\r\n" not in data and not unpacker.eof:
            if fed >= len(source.held) and not source.fill():
                raise EOFError("a WARC record ends too early")
            piece = source.held[fed : fed + 2048]
            fed += len(piece)
            data += unpacker.decompress(piece)
        end = data.find(b"\r\n\r\n")
        if end < 0:
            raise EOFError("a WARC record ends too early")
        header = parse_header(data[:end])
        length = int(_field(header, "Content-Length") or 0)
        want = wanted(header)
        if want != "all" and total is not None:
            source.skip(total)
        else:
            parts, have = [data], len(data)
            while not unpacker.eof:
                if fed >= len(source.held) and not source.fill():
                    raise EOFError("a WARC record ends too early")
                piece = source.held[fed : fed + READ_BYTES]
                fed += len(piece)
                more = unpacker.decompress(piece)
                have += len(more)
                if want == "all":
                    parts.append(more)
            source.skip(fed - len(unpacker.unused_data))
            data = b"".join(parts)
        if want == "all":
            if len(data) < end + 4 + length:
                raise EOFError("a WARC record ends too early")
            yield header, data[end + 4 : end + 4 + length]
        elif want:
            yield header, None


def _field(header: dict[str, str], name: str) -> str | None:
    found = header.get(name)
    if found is None:
        low = name.lower()
        found = next((v for k, v in header.items() if k.lower() == low), None)
    return found


def _bare(value: str | None) -> str | None:
    """A URI without its angle brackets."""
    return value[1:-1] if value and value[0] == "<" and value[-1] == ">" else value


def column_value(header: dict[str, str], column: str) -> str | None:
    value = _field(header, FIELDS[column])
    return _bare(value) if column in ("record_id", "refers_to") else value


def split_http(block: bytes) -> tuple[bytes, bytes]:
    end = block.find(b"\r\n\r\n")
    return (block, b"") if end < 0 else (block[:end], block[end + 4 :])


def http_length(head: bytes) -> int | None:
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        if name.strip().lower() == b"content-length" and value.strip().isdigit():
            return int(value)
    return None


# ---------------------------------------------------------------- data source


class FilePartition(InputPartition):
    def __init__(self, files: list[str]):
        self.files = files


class CommittedFiles(WriterCommitMessage):
    def __init__(self, files: list[tuple[str, int]]):
        self.files = files


def list_files(path: str) -> list[tuple[str, int]]:
    """(file, bytes): what the manifests list, or every archive where there is no manifest."""
    from pyarrow import fs as pafs

    fs, root = file_system(path)
    info = fs.get_file_info(root)
    if info.is_file:
        return [(root, info.size)]
    found = fs.get_file_info(pafs.FileSelector(root, recursive=True))
    manifests = sorted(f.path for f in found if f.base_name.startswith("_manifest-"))
    if not manifests:
        return sorted((f.path, f.size) for f in found if f.is_file and f.base_name.endswith((".warc", ".warc.gz")))
    out: list[tuple[str, int]] = []
    for m in manifests:
        with fs.open_input_stream(m) as stream:
            out.extend((f"{root.rstrip('/')}/{name}", size) for name, size in json.loads(stream.read()))
    return sorted(out)


def plan_files(files: Iterable[tuple[str, int]], most: int) -> list[list[str]]:
    """Files packed in order into partitions of about `most` bytes."""
    out: list[list[str]] = []
    held = 0
    for name, size in files:
        if not out or held + size > most:
            out.append([])
            held = 0
        out[-1].append(name)
        held += size
    return out


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.payload = str(options.get("payload", "true")).lower() != "false"
        self.most = int(options.get("partitionBytes", PARTITION_BYTES))
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column not in FIELDS:
                yield f
            elif isinstance(f, EqualTo):
                self.tests.append((column, "in", [f.value]))
            elif isinstance(f, In):
                self.tests.append((column, "in", list(f.value)))
            elif isinstance(f, StringStartsWith):
                self.tests.append((column, "prefix", f.value))
            elif isinstance(f, IsNotNull):
                self.tests.append((column, "there", None))
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        return [FilePartition(files) for files in plan_files(list_files(self.path), self.most) or [[]]]

    def _wanted(self, header: dict[str, str]) -> str | None:
        for column, test, value in self.tests:
            own = column_value(header, column)
            if own is None or test == "in" and own not in value or test == "prefix" and not own.startswith(value):
                return None
        return "all" if self.payload or column_value(header, "warc_type") == "revisit" else "header"

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [
                *((c, pa.string()) for c in FIELDS),
                ("payload_length", pa.int64()),
                ("headers", pa.map_(pa.string(), pa.string())),
                ("payload", pa.binary()),
            ]
        )
        fs, _ = file_system(self.path)
        rows: list[tuple] = []
        size = 0
        for name in partition.files:
            with fs.open_input_file(name) as stream:
                source = _Source(stream)
                records = gzip_records if source.peek(2) == b"\x1f\x8b" else plain_records
                for header, block in records(source, self._wanted):
                    rows.append(self._row(header, block))
                    size += len(block or b"") + 500
                    if size > BATCH_BYTES:
                        yield self._batch(rows, schema)
                        rows, size = [], 0
        if rows:
            yield self._batch(rows, schema)

    def _row(self, header: dict[str, str], block: bytes | None) -> tuple:
        payload, length = None, None
        if block is not None:
            if (_field(header, "Content-Type") or "").startswith("application/http"):
                head, payload = split_http(block)
                length = len(payload)
                if column_value(header, "warc_type") == "revisit":
                    payload, length = None, http_length(head)
            else:
                payload, length = block, len(block)
        return (*(column_value(header, c) for c in FIELDS), length, list(header.items()), payload if self.payload else None)

    @staticmethod
    def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(column, field.type) for column, field in zip(zip(*rows), schema)], schema=schema
        )


class WarcWriter(DataSourceArrowWriter):
    """Columns: warc_type, record_id, target_uri, refers_to, payload_digest, payload_length, payload."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.most = int(options.get("fileBytes", FILE_BYTES))
        self.date = options.get("date", DATE)

    def _record(self, row: dict) -> bytes:
        revisit = row["warc_type"] == "revisit"
        fields = [
            ("WARC-Type", row["warc_type"]),
            ("WARC-Record-ID", f"<{row['record_id']}>"),
            ("WARC-Target-URI", row["target_uri"]),
            ("WARC-Date", self.date),
            ("WARC-Payload-Digest", row["payload_digest"]),
            ("WARC-Profile", REVISIT_PROFILE if revisit else None),
            ("WARC-Refers-To", f"<{row['refers_to']}>" if revisit else None),
            ("Content-Type", HTTP_TYPE),
        ]
        return record_bytes(fields, http_block(None if revisit else row["payload"], row["payload_length"]))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, root = file_system(self.path)
        done: list[tuple[str, int]] = []
        stream, name, size = None, "", 0
        for batch in iterator:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                if stream is None:
                    name, size = f"{uuid.uuid4().hex}.warc.gz", 0
                    fs.create_dir(root, recursive=True)
                    stream = fs.open_output_stream(f"{root.rstrip('/')}/{name}", compression=None)
                    info = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>")]
                    info += [("WARC-Date", self.date), ("Content-Type", "application/warc-fields")]
                    size += stream.write(gzip_member(record_bytes(info, b"format: WARC File Format 1.1\r\n")))
                size += stream.write(gzip_member(self._record(row)))
                if size >= self.most:
                    stream.close()
                    done.append((name, size))
                    stream = None
        if stream is not None:
            stream.close()
            done.append((name, size))
        return CommittedFiles(done)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = file_system(self.path)
        files = [f for m in messages if m is not None for f in m.files]
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root.rstrip('/')}/_manifest-{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps(sorted(files)).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = file_system(self.path)
        for m in messages:
            for name, _ in m.files if m is not None else ():
                fs.delete_file(f"{root.rstrip('/')}/{name}")


class WarcDataSource(DataSource):
    """format("warc"): options path, payload, partitionBytes; for writing fileBytes, date."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make format("warc") known and let Spark push filters into it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


# ---------------------------------------------------------------- archive of pages


def page_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The records of an archive: one for each row, repeated payloads as revisits."""
    rows = pages.select(
        F.col(id_col).alias("id"),
        F.col(url_col).alias("target_uri"),
        F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"),
    )
    flagged = flag_repeated(rows, "payload", ["id", "target_uri", "payload"], fold_case=False).withColumn(
        "payload_length", F.octet_length("payload").cast("long")
    )
    can_repeat = F.col("__maybe") & (F.col("payload_length") >= MIN_REVISIT_BYTES)
    alone = flagged.filter(~can_repeat).withColumn("first", F.col("id"))
    maybe = flagged.filter(can_repeat)
    # stored, so that both sides of the join are plain exchanges and Spark can split a hot payload
    firsts = staged(maybe.groupBy("__sha").agg(F.min("id").alias("first")), "warc-firsts")
    settled = maybe.join(firsts.hint("shuffle_merge"), "__sha")

    def urn(c: str):
        return F.concat(F.lit("urn:x-page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")))

    is_first = F.col("id").eqNullSafe(F.col("first"))
    return alone.unionByName(settled).select(
        F.when(is_first, F.lit("response")).otherwise(F.lit("revisit")).alias("warc_type"),
        urn("id").alias("record_id"),
        "target_uri",
        F.when(~is_first, urn("first")).alias("refers_to"),
        F.concat(F.lit("sha256:"), F.col("__sha")).alias("payload_digest"),
        "payload_length",
        F.when(is_first, F.col("payload")).alias("payload"),
    )


def write_archive(records: DataFrame, path: str) -> None:
    register(records.sparkSession)
    records.write.format("warc").mode("append").option("path", path).save()


def read_archive(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def page_id(urn) -> F.Column:
    """The id in a record's name."""
    text = F.regexp_extract(urn, r"^urn:x-page:(.*)$", 1)
    return F.when(text != "null", text).cast("long")


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write the pages as an archive in the shared folder, read it back and describe each record.

    payload_bytes and payload_digest of a response are those of the payload as read; a
    revisit has them in its headers.
    """
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_archive(page_records(pages, id_col, url_col, html_col), path)
    records = read_archive(spark, path).filter(F.col("warc_type").isin("response", "revisit"))
    is_response = F.col("warc_type") == "response"
    return records.select(
        page_id(F.col("record_id")).alias(id_col),
        F.col("payload_length").alias("payload_bytes"),
        F.when(is_response, F.sha2("payload", 256)).otherwise(F.substring_index("payload_digest", ":", -1)).alias("payload_digest"),
        F.col("warc_type").alias("record_type"),
        page_id(F.col("refers_to")).alias("refers_to"),
    )
