"""WARC archives as a PySpark Python data source, and the writing of pages as response and revisit records.

Each record is a gzip member of its own whose extra field ``sl`` tells the member's stored and raw length, so a
reader can step over a record without inflating it. Reading plans partitions of files, takes equality and IN
predicates on record_type and the other header columns, inflates a record's head first, and goes on to the payload
only if the head passes and payloads are wanted.

Nulls and edges: a null html is an empty payload; a null url has no WARC-Target-URI; a null page_id is ``null`` in the
record's name; equal rows that share the largest page_id are all responses; payloads of any length are held once, by the
task that writes or reads them; a header that a record lacks equals no value, so no pushed predicate passes it; an empty
table gives archives without records; further columns are ignored whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage

from marketgrain.llm.shared import cleared, file_system, fresh_path, spread_join, written

SCHEMA = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_length long, payload binary"
#: The column of each header that a predicate may be pushed down on.
HEADERS = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest"}
#: Payloads from this size on are stored once.
REVISIT_BYTES = 1000
#: Payloads met more than once are looked up by broadcast up to so many of them; beyond it they are joined.
BROADCAST_DIGESTS = 500_000
#: Bytes of archive files that one task reads.
TASK_BYTES = 64 << 20
_HEAD = struct.Struct("<2sBBIBB")
_EXTRA = struct.Struct("<2sHII")
_RECORD = "urn:x-page:"
#: How the names of files begin that list a write's archives.
_LIST = "_files"


def member(raw: bytes) -> bytes:
    """``raw`` as one gzip member that tells its lengths in an extra field."""
    packer = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = packer.compress(raw) + packer.flush()
    size = _HEAD.size + 2 + _EXTRA.size + len(body) + 8
    told = _EXTRA.pack(b"sl", 8, size, len(raw)) if max(size, len(raw)) < 2**32 else b""
    head = _HEAD.pack(b"\x1f\x8b", 8, 4, 0, 0, 255) + struct.pack("<H", len(told)) + told
    return head + body + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)


def record(record_id: str, kind: str, uri: str | None, refers_to: str | None, digest: str, payload: bytes, payload_length: int) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_length}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", "WARC-Date: 2024-01-01T00:00:00Z"]
    if uri is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri))
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{refers_to}>"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Payload-Length: {payload_length}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + len(payload)}"]
    return ("\r\n".join(head) + "\r\n\r\n").encode() + http + payload + b"\r\n\r\n"


def _headers(raw: bytes | bytearray) -> dict[str, str]:
    pairs = (line.partition(":") for line in raw.decode("utf-8", "replace").split("\r\n")[1:])
    return {name.strip().lower(): value.strip() for name, colon, value in pairs if colon}


class _Member:
    """The gzip member at a file's place, inflated as far as is asked for."""

    def __init__(self, file, at: int):
        self.file, self.inflater, self.raw = file, zlib.decompressobj(31), bytearray()
        file.seek(at)
        self.first = file.read(1 << 14)
        self.size = None
        if len(self.first) >= 24 and self.first[3] == 4 and self.first[12:14] == b"sl":
            _, _, self.size, _ = _EXTRA.unpack_from(self.first, 12)
        self.read, self.pending = len(self.first), self.first

    def grow(self) -> bool:
        """Inflate some more; False at the member's end."""
        if self.inflater.eof:
            return False
        if not self.pending:
            self.pending = self.file.read(1 << 18)
            self.read += len(self.pending)
            if not self.pending:
                raise ValueError("a WARC record breaks off")
        self.raw += self.inflater.decompress(self.pending, 1 << 20)
        self.pending = self.inflater.unconsumed_tail
        return True

    def until(self, mark: bytes, start: int = 0) -> int:
        """The place of ``mark``, inflating no further than needed; -1 if it isn't there."""
        while (at := self.raw.find(mark, start)) < 0 and self.grow():
            pass
        return at

    def all(self) -> bytearray:
        while self.grow():
            pass
        return self.raw

    def length(self) -> int:
        """The member's stored length: told by its extra field, else found by inflating it."""
        if self.size is None:
            self.all()
            self.size = self.read - len(self.inflater.unused_data)
        return self.size


@dataclass
class Files(InputPartition):
    paths: tuple[str, ...]


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.payload, self.wanted = options["path"], options.get("payload", "true").lower() == "true", {}
        self.task_bytes = int(options.get("taskbytes", TASK_BYTES))

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if name in HEADERS:
                values = {v for v in ([f.value] if isinstance(f, EqualTo) else f.value) if v is not None}
                self.wanted[name] = self.wanted.get(name, values) & values
            else:
                yield f

    def partitions(self):
        fs, root = file_system(self.path)
        from pyarrow.fs import FileSelector, FileType

        infos = sorted((i for i in fs.get_file_info(FileSelector(root)) if i.type == FileType.File), key=lambda i: i.path)
        lists = [i for i in infos if i.base_name.startswith(_LIST)]
        if lists:
            names = set()
            for i in lists:
                with fs.open_input_stream(i.path, compression=None) as f:
                    names |= set(f.read().decode().split("\n"))
            infos = [i for i in infos if i.base_name in names]
        groups, size = [[]], 0
        for i in (i for i in infos if i.base_name.endswith(".warc.gz")):
            if groups[-1] and size + i.size > self.task_bytes:
                groups.append([])
                size = 0
            groups[-1].append(f"{self.path}/{i.base_name}")
            size += i.size
        return [Files(tuple(g)) for g in groups]

    def _row(self, one: _Member) -> tuple | None:
        """The record's columns, or None if its head fails a predicate."""
        end = one.until(b"\r\n\r\n")
        headers = _headers(one.raw[: max(end, 0)])
        row = {name: headers.get(header) for name, header in HEADERS.items()}
        for name in ("record_id", "refers_to"):
            row[name] = row[name] and row[name].strip("<>")
        if any(row[name] is None or row[name] not in values for name, values in self.wanted.items()):
            return None
        length, payload = headers.get("warc-payload-length"), None
        if self.payload and row["record_type"] == "response":
            one.all()
            stop = end + 4 + int(headers["content-length"])
            http = one.raw.find(b"\r\n\r\n", end + 4, stop)
            payload = bytes(memoryview(one.raw)[http + 4 : stop]) if http >= 0 else b""
            length = len(payload) if length is None else length
        return (*(row[n] for n in HEADERS), None if length is None else int(length), payload)

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        types = [pa.string()] * len(HEADERS) + [pa.int64(), pa.binary()]
        names = [*HEADERS, "payload_length", "payload"]
        for path in partition.paths:
            fs, inner = file_system(path)
            with fs.open_input_file(inner) as file:
                at, size, rows, held = 0, file.size(), [], 0
                while at < size:
                    one = _Member(file, at)
                    row = self._row(one)
                    at += one.length()
                    if row is not None:
                        rows.append(row)
                        held += len(row[-1] or b"")
                    if rows and (held > 8 << 20 or len(rows) >= 4096 or at >= size):
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


@dataclass
class Written(WriterCommitMessage):
    name: str | None


class WarcWriter(DataSourceArrowWriter):
    """Writes rows of record_id, record_type, target_uri, refers_to, payload_digest, payload_length, payload."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = file_system(self.path)
        fs.create_dir(root, recursive=True)
        name, stream = f"part-{uuid.uuid4().hex}.warc.gz", None
        for batch in iterator:
            stream = stream or fs.open_output_stream(f"{root}/{name}", compression=None)
            columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            for i in range(batch.num_rows):
                r = {n: c[i].as_py() for n, c in columns.items()}
                payload = r["payload"] if r["record_type"] == "response" else None
                stream.write(member(record(r["record_id"], r["record_type"], r["target_uri"], r["refers_to"], r["payload_digest"], payload or b"", r["payload_length"])))
        if stream is not None:
            stream.close()
        return Written(name if stream is not None else None)

    def commit(self, messages: list[Written | None]) -> None:
        """List the files of the attempts that count, beside the lists of earlier writes; readers see no others. Where earlier
        records are to be replaced, their lists and files go once the new list is there."""
        from pyarrow.fs import FileSelector

        fs, root = file_system(self.path)
        fs.create_dir(root, recursive=True)
        names = sorted(m.name for m in messages if m is not None and m.name)
        earlier = [i.path for i in fs.get_file_info(FileSelector(root)) if i.base_name not in names and (i.base_name.startswith(_LIST) or i.base_name.endswith(".warc.gz"))] if self.overwrite else []
        with fs.open_output_stream(f"{root}/{_LIST}-{uuid.uuid4().hex}", compression=None) as f:
            f.write("\n".join(names).encode())
        for path in sorted(earlier, key=lambda p: p.endswith(".warc.gz")):
            fs.delete_file(path)

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = file_system(self.path)
        for m in messages:
            if m is not None and m.name:
                fs.delete_file(f"{root}/{m.name}")


class WarcSource(DataSource):
    """``spark.read.format("warc")``; options: payload (default true), taskBytes."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader({k.lower(): v for k, v in self.options.items()})

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter({k.lower(): v for k, v in self.options.items()}, overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The archives' records; with ``payload=False`` payloads are null and never inflated."""
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def page_records(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html", broadcast_digests: int = BROADCAST_DIGESTS) -> DataFrame:
    """A record's columns for each page. Equal payloads of REVISIT_BYTES or more are stored with the largest page_id only."""
    rows = pages.select(F.col(id_column).cast("long").alias("page_id"), F.col(url_column).alias("target_uri"), F.encode(F.coalesce(F.col(html_column), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumns({"payload_digest": F.sha1("payload"), "payload_length": F.octet_length("payload").cast("long")})
    repeated = rows.where(F.col("payload_length") >= REVISIT_BYTES).groupBy("payload_digest").agg(F.max("page_id").alias("kept_by"), F.count("*").alias("n")).where("n > 1")
    # only payloads met more than once need to be looked up, and payloads stay where they are if these are few
    repeated = written(repeated, "repeated")
    n, copies = repeated.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    kept_by = repeated.select("payload_digest", "kept_by")
    if n <= broadcast_digests:
        rows = rows.join(F.broadcast(kept_by), "payload_digest", "left")
    else:
        rows = spread_join(rows, kept_by, "payload_digest", "page_id", "left", counts=repeated.select("payload_digest", "n"), total=copies)
    revisit = F.col("kept_by").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("kept_by"))
    name = lambda c: F.concat(F.lit(_RECORD), F.coalesce(c.cast("string"), F.lit("null")))
    return rows.select(
        name(F.col("page_id")).alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        "target_uri",
        F.when(revisit, name(F.col("kept_by"))).alias("refers_to"),
        "payload_digest",
        "payload_length",
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def write_pages(pages: DataFrame, path: str | None = None, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> str:
    """Write a record for each page below ``path`` and return it. Records that are there stay, also those of the same pages; payloads
    are compared within one call only."""
    register(pages.sparkSession)
    path = path or fresh_path(pages.sparkSession, "warc")
    with cleared(pages.sparkSession):
        page_records(pages, id_column, url_column, html_column).write.format("warc").mode("append").option("path", path).save()
    return path


def page_id_of(record_id) -> F.Column:
    """The page_id in a record's name; null for pages without one."""
    return F.col(record_id).substr(len(_RECORD) + 1, 20).try_cast("long")


def base32_digest(hex_digest: str) -> str:
    """A hex SHA-1 in the base-32 form that other archives use."""
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def payload_digest(payload: bytes) -> str:
    return hashlib.sha1(payload).hexdigest()
