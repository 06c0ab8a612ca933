"""WARC archives as a Spark data source, and pages archived with revisit records for repeated payloads.

``format("warc")`` writes a gzip member per record, into files of a bounded size. A member says in its gzip header how long
it is (the ``sl`` field that the WARC standard describes), so that a reader can step over a record it has only seen
the headers of. Reading plans partitions of whole files, takes predicates on headers, parses a record's headers
first, and inflates a payload only where the record is wanted and the ``payload`` column is asked for.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    LessThan,
    LessThanOrEqual,
    Not,
    StringContains,
    StringEndsWith,
    StringStartsWith,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from evenstep.sources.storage import shared_folder

COLUMNS = (
    "record_id string, record_type string, target_uri string, date string, refers_to string, payload_digest string, "
    "payload_bytes long, content_type string, headers map<string,string>, payload binary, file string, offset long"
)
# Field names and constants of the WARC 1.1 format.
_FIELDS = {
    "record_id": "warc-record-id",
    "record_type": "warc-type",
    "target_uri": "warc-target-uri",
    "date": "warc-date",
    "refers_to": "warc-refers-to",
    "payload_digest": "warc-payload-digest",
    "content_type": "content-type",
}
_SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END = b"\r\n\r\n"
#: Bytes of archive that a reader holds at once, unless a single record has more.
WINDOW = 4 << 20
#: Output that a member is inflated to at first; longer headers are read on.
HEAD = 2048
#: A batch leaves a reader at so many rows or bytes of payload.
BATCH_ROWS, BATCH_BYTES = 2048, 4 << 20


def register(spark: SparkSession) -> None:
    """Make ``format("warc")`` known to a session, with its filter pushdown."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


class WarcSource(DataSource):
    """Options: ``path`` (a folder or a file), ``file_bytes`` (size at which a writer opens its next file) and
    ``partition_bytes`` (archive that a reading task takes, whole files).

    A schema given to the reader chooses among the columns; without ``payload`` no payload is inflated.
    """

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options["path"], schema, int(self.options.get("partition_bytes", 64 << 20)))

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], schema, overwrite, int(self.options.get("file_bytes", 64 << 20)))


def _store(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if re.match(r"[a-z][a-z0-9+.-]*:/", path):
        return pyarrow.fs.FileSystem.from_uri(path)
    return pyarrow.fs.LocalFileSystem(), path


# Writing


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


def _header_value(value: object) -> str:
    """A header holds one line: control characters and blanks are written as in a URI."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", str(value))


def _member(content: bytes) -> bytes:
    """``content`` as a gzip member with its packed and plain lengths in its header, as far as 32 bits tell them."""
    press = zlib.compressobj(3, zlib.DEFLATED, -15)
    body = press.compress(content) + press.flush()
    size, plain = 10 + 2 + 12 + len(body) + 8, len(content)
    if max(size, plain) >> 32:
        size = plain = 0  # not known; the reader inflates the member to its end
    extra = b"sl" + struct.pack("<HII", 8, size, plain)
    head = b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff" + struct.pack("<H", len(extra)) + extra
    return head + body + struct.pack("<II", zlib.crc32(content), len(content) & 0xFFFFFFFF)


def _record(row: dict, now: str) -> bytes:
    """A record as the standard lays it out; a revisit has the headers of its response and no payload."""
    payload = row.get("payload") or b""
    kind = row.get("record_type") or "response"
    revisit = kind == "revisit"
    size = row["payload_bytes"] if revisit else len(payload)
    digest = row.get("payload_digest") or (None if revisit else hashlib.sha256(payload).hexdigest())
    block = f"HTTP/1.1 200 OK\r\nContent-Type: {row.get('content_type') or 'text/html; charset=utf-8'}\r\nContent-Length: {size}\r\n\r\n".encode()
    if not revisit:
        block += payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{_header_value(row.get('record_id') or f'urn:uuid:{uuid.uuid4()}')}>",
        f"WARC-Date: {_header_value(row.get('date') or now)}",
    ]
    if row.get("target_uri") is not None:
        lines.append(f"WARC-Target-URI: {_header_value(row['target_uri'])}")
    if digest is not None:
        lines.append(f"WARC-Payload-Digest: sha256:{digest}")
    if row.get("refers_to") is not None:
        lines += [f"WARC-Refers-To: <{_header_value(row['refers_to'])}>", f"WARC-Profile: {_SAME_PAYLOAD}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + _END + block + _END


class WarcWriter(DataSourceArrowWriter):
    """Every task attempt writes files of its own below ``_temporary``; the commit moves those of the attempts that count."""

    def __init__(self, path: str, schema: StructType, overwrite: bool, file_bytes: int) -> None:
        self.path, self.overwrite, self.file_bytes = path, overwrite, file_bytes
        unknown = set(schema.names) - {f.split()[0] for f in COLUMNS.split(", ")}
        if unknown:
            raise ValueError(f"a record has no {sorted(unknown)}")
        self.job = uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, path = _store(self.path)
        folder, attempt = f"{path}/_temporary/{self.job}", uuid.uuid4().hex
        now = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
        names: list[str] = []
        out, size = None, 0
        for batch in iterator:
            for start in range(0, batch.num_rows, 256):
                for row in batch.slice(start, 256).to_pylist():
                    if out is None or size >= self.file_bytes:
                        if out is not None:
                            out.close()
                        store.create_dir(folder, recursive=True)
                        names.append(f"part-{attempt}-{len(names):05d}.warc.gz")
                        out, size = store.open_output_stream(f"{folder}/{names[-1]}", compression=None), 0
                    member = _member(_record(row, now))
                    out.write(member)
                    size += len(member)
        if out is not None:
            out.close()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        store, path = _store(self.path)
        if self.overwrite:
            for old in _archives(store, path):
                store.delete_file(old.path)
        store.create_dir(path, recursive=True)
        for message in messages:
            for name in message.names if message else []:
                store.move(f"{path}/_temporary/{self.job}/{name}", f"{path}/{name}")
        self._tidy(store, path)

    def abort(self, messages: list[Written | None]) -> None:
        self._tidy(*_store(self.path))

    def _tidy(self, store: pyarrow.fs.FileSystem, path: str) -> None:
        if store.get_file_info(f"{path}/_temporary/{self.job}").type == pyarrow.fs.FileType.Directory:
            store.delete_dir(f"{path}/_temporary/{self.job}")


# Reading


def _archives(store: pyarrow.fs.FileSystem, path: str) -> list[pyarrow.fs.FileInfo]:
    """Archives of a folder, below it too; what starts with ``_`` or ``.`` is not one. Or the one file that is named."""
    info = store.get_file_info(path)
    if info.type == pyarrow.fs.FileType.File:
        return [info]
    found = store.get_file_info(pyarrow.fs.FileSelector(path, recursive=True))
    hidden = re.compile(r"/[_.]")
    kept = [f for f in found if f.type == pyarrow.fs.FileType.File and f.base_name.endswith((".warc", ".warc.gz")) and not hidden.search(f.path[len(path) :])]
    return sorted(kept, key=lambda f: f.path)


class _Window:
    """A file seen through a window that moves forward; what is stepped over is not read."""

    def __init__(self, file: pa.NativeFile) -> None:
        self.file, self.size = file, file.size()
        self.low, self.data = 0, b""

    def take(self, at: int, n: int) -> memoryview:
        n = min(n, self.size - at)
        if at < self.low or at + n > self.low + len(self.data):
            self.low, self.data = at, self.file.read_at(min(max(n, WINDOW), self.size - at), at)
        return memoryview(self.data)[at - self.low : at - self.low + n]


def _member_length(head: memoryview) -> int | None:
    """What the ``sl`` field of a gzip header says; none without the field."""
    if len(head) < 12 or not head[3] & 4:
        return None
    (total,) = struct.unpack_from("<H", head, 10)
    at = 12
    while at + 4 <= min(12 + total, len(head)):
        (size,) = struct.unpack_from("<H", head, at + 2)
        if bytes(head[at : at + 2]) == b"sl" and size == 8:
            return struct.unpack_from("<I", head, at + 4)[0] or None
        at += 4 + size
    return None


class _Packed:
    """A record in a gzip member, inflated as far as it is asked for."""

    def __init__(self, window: _Window, at: int) -> None:
        self.window, self.at = window, at
        self.length = _member_length(window.take(at, 256))
        self.inflate = zlib.decompressobj(31)
        self.fed, self.plain = 0, b""

    def upto(self, n: int) -> bytes:
        """The first ``n`` bytes of the record, or all of it."""
        parts, have = [self.plain], len(self.plain)
        while have < n and not self.inflate.eof:
            piece = self.inflate.unconsumed_tail
            if not piece:
                left = (self.length or 1 << 62) - self.fed
                piece = self.window.take(self.at + self.fed, min(left, WINDOW // 16))
                if not len(piece):
                    raise ValueError(f"the record at byte {self.at} is cut off")
                self.fed += len(piece)
            parts.append(self.inflate.decompress(piece, n - have))
            have += len(parts[-1])
        self.plain = b"".join(parts)
        return self.plain

    def check(self) -> None:
        """Inflate the member to its end, where its checksum is compared."""
        kept = self.plain
        while not self.inflate.eof:
            self.plain = b""
            self.upto(WINDOW)
        self.plain = kept

    def end(self) -> int:
        """Where the next member starts: by this one's header, else by inflating it to its end."""
        if self.length is not None:
            return self.at + self.length
        self.check()
        return self.at + self.fed - len(self.inflate.unused_data)


class _Plain:
    """A record of an archive that is not compressed."""

    def __init__(self, window: _Window, at: int) -> None:
        self.window, self.at, self.length = window, at, None

    def upto(self, n: int) -> bytes:
        return bytes(self.window.take(self.at, n))

    def check(self) -> None:
        """Nothing to compare with."""

    def end(self) -> int:
        return self.at + self.length


def _headers(record: _Packed | _Plain) -> tuple[dict[str, str], int]:
    """Named fields (lower case) and where the record's block starts."""
    n = HEAD
    while (at := (head := record.upto(n)).find(_END)) < 0:
        if len(head) < n:
            raise ValueError(f"the record at byte {record.at} has no end of headers")
        n *= 4
    first, *lines = head[:at].decode("utf-8", "replace").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"no WARC record at byte {record.at}")
    fields: dict[str, str] = {}
    last = None
    for line in lines:
        if line[:1] in (" ", "\t") and last:  # a folded line goes on
            fields[last] += " " + line.strip()
            continue
        name, _, value = line.partition(":")
        last = name.strip().lower()
        fields[last] = value.strip()
    return fields, at + len(_END)


def _named(fields: dict[str, str]) -> dict[str, str | None]:
    """The columns that headers alone fill."""
    row = {column: fields.get(name) for column, name in _FIELDS.items()}
    for column in ("record_id", "refers_to"):
        if row[column]:
            row[column] = row[column].removeprefix("<").removesuffix(">")
    if row["payload_digest"]:
        row["payload_digest"] = row["payload_digest"].rpartition(":")[2]
    return row


#: Predicates by their kind: from the filter to a test of a header's value. Null fails all but the last three.
_TESTS: dict[type, Callable] = {
    EqualTo: lambda f, v: v == f.value,
    In: lambda f, v: v in f.value,
    GreaterThan: lambda f, v: v > f.value,
    GreaterThanOrEqual: lambda f, v: v >= f.value,
    LessThan: lambda f, v: v < f.value,
    LessThanOrEqual: lambda f, v: v <= f.value,
    StringStartsWith: lambda f, v: v.startswith(f.value),
    StringEndsWith: lambda f, v: v.endswith(f.value),
    StringContains: lambda f, v: f.value in v,
    EqualNullSafe: lambda f, v: v == f.value,
    IsNull: lambda f, v: v is None,
    IsNotNull: lambda f, v: v is not None,
}
_NULL_TOO = (EqualNullSafe, IsNull, IsNotNull)


def _taken(filter_: Filter) -> bool:
    inner = filter_.child if isinstance(filter_, Not) else filter_
    return type(inner) in _TESTS and len(inner.attribute) == 1 and inner.attribute[0] in _FIELDS


def _passes(filter_: Filter, row: dict[str, str | None]) -> bool:
    inner = filter_.child if isinstance(filter_, Not) else filter_
    value = row[inner.attribute[0]]
    if value is None and not isinstance(inner, _NULL_TOO):
        return False  # unknown, also when negated
    return _TESTS[type(inner)](inner, value) != isinstance(filter_, Not)


@dataclass
class Files(InputPartition):
    paths: list[str]


class WarcReader(DataSourceReader):
    """A batch holds at most ``BATCH_BYTES`` of payload beyond its last record. Broken archives raise."""

    def __init__(self, path: str, schema: StructType, partition_bytes: int) -> None:
        self.path, self.names, self.partition_bytes = path, schema.names, partition_bytes
        known = dict(field.rsplit(" ", 1) for field in COLUMNS.split(", "))
        unknown = set(self.names) - set(known)
        if unknown:
            raise ValueError(f"a record has no {sorted(unknown)}")
        kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "map<string,string>": pa.map_(pa.string(), pa.string())}
        self.kinds = {name: kinds[known[name]] for name in self.names}
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for filter_ in filters:
            if _taken(filter_):
                self.filters.append(filter_)
            else:
                yield filter_

    def partitions(self) -> list[Files]:
        store, path = _store(self.path)
        planned: list[list[str]] = []
        room = 0
        for info in _archives(store, path):
            if not planned or room < info.size:
                planned.append([])
                room = self.partition_bytes
            planned[-1].append(info.path)
            room -= info.size
        return [Files(paths) for paths in planned] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = _store(self.path)
        rows: list[dict] = []
        size = 0
        for path in partition.paths:
            with store.open_input_file(path) as file:
                for row in self._records(file, path):
                    rows.append(row)
                    size += len(row.get("payload") or b"")
                    if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
                        yield self._batch(rows)
                        rows, size = [], 0
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([row.get(n) for row in rows], kind) for n, kind in self.kinds.items()], names=self.names)

    def _records(self, file: pa.NativeFile, path: str) -> Iterator[dict]:
        window, at = _Window(file), 0
        whole = "payload" in self.names
        sized = "payload_bytes" in self.names
        while at < window.size:
            if window.take(at, 2) in (b"\r\n", b"\n\r"):
                at += 2  # between records of a plain archive
                continue
            record = (_Packed if window.take(at, 2) == b"\x1f\x8b" else _Plain)(window, at)
            fields, block = _headers(record)
            length = int(fields["content-length"])
            if isinstance(record, _Plain):
                record.length = block + length
            row = _named(fields)
            if all(_passes(f, row) for f in self.filters):
                if whole or sized:
                    row |= self._payload(record, row, block, length, whole)
                    if whole:
                        record.check()
                yield row | {"headers": list(fields.items()), "file": path, "offset": at}
            at = record.end()

    def _payload(self, record: _Packed | _Plain, row: dict, block: int, length: int, whole: bool) -> dict:
        """Size of the payload, and the payload itself where it is asked for and the record holds one.

        The payload of an HTTP message is what follows its headers; of any other record the whole block.
        """
        if not (row["content_type"] or "").startswith("application/http"):
            return {"payload_bytes": length, "payload": record.upto(block + length)[block : block + length] if whole else None}
        n = block + min(length, HEAD)
        while (at := (head := record.upto(n)).find(_END, block, block + length)) < 0 and n < block + length:
            n = min(n * 4, block + length)
        start = at + len(_END) if at >= 0 else block + length
        if row["record_type"] == "revisit":
            told = re.search(rb"(?im)^content-length:[ \t]*(\d+)", head[block:start])
            return {"payload_bytes": int(told[1]) if told else None}
        return {"payload_bytes": block + length - start, "payload": record.upto(block + length)[start : block + length] if whole else None}


# Pages

LEAST = 100
_PAGE = "urn:page:"


def write_pages(pages: DataFrame, path: str, least: int = LEAST) -> None:
    """A record per row of ``pages`` (``page_id, url, html``), its payload the html in UTF-8 (null: empty).

    Of rows with equal payloads of ``least`` bytes or more, the one with the smallest ``page_id`` is a response and the
    others are revisits that refer to it. A row without a ``page_id`` is never referred to; rows that share the smallest
    one are all responses. Other columns are not looked at. Payloads are equal when their SHA-256 is.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload"))
    rows = rows.select("*", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").cast("long").alias("size"))
    # Summed where the pages are read; only payloads that occur again meet the pages.
    firsts = rows.where(f"size >= {least}").groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    firsts = firsts.where("n > 1").select(F.col("digest").alias("_digest"), "first")
    met = rows.join(firsts, F.col("digest") == F.col("_digest"), "left")
    revisit = F.coalesce((F.col("first") < F.col("page_id")) | (F.col("first").isNotNull() & F.col("page_id").isNull()), F.lit(False))
    records = met.select(
        F.concat(F.lit(_PAGE), F.coalesce(F.col("page_id").cast("string"), F.lit(""))).alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.col("url").alias("target_uri"),
        F.when(revisit, F.concat(F.lit(_PAGE), F.col("first").cast("string"))).alias("refers_to"),
        F.col("digest").alias("payload_digest"),
        F.col("size").alias("payload_bytes"),
        F.when(~revisit, F.col("payload")).alias("payload"),
    )
    register(pages.sparkSession)
    records.write.format("warc").mode("append").save(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of the records that ``write_pages`` wrote.

    Size and digest of a response are worked out from the payload read; a revisit's stand in its headers.
    """
    register(spark)
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]

    def page(column: str):
        return F.substring(column, len(_PAGE) + 1, 20).try_cast("long")

    responses = spark.read.format("warc").schema("record_id string, record_type string, payload binary").load(path)
    responses = responses.where("record_type = 'response'").select(
        page("record_id").alias("page_id"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_digest"),
        "record_type",
        F.lit(None).cast("long").alias("refers_to"),
    )
    revisits = spark.read.format("warc").schema("record_id string, record_type string, refers_to string, payload_digest string, payload_bytes long").load(path)
    revisits = revisits.where("record_type = 'revisit'").withColumns({"page_id": page("record_id"), "refers_to": page("refers_to")})
    return responses.select(names).unionByName(revisits.select(names))


def archived_pages(pages: DataFrame) -> DataFrame:
    """``pages`` written to an archive in shared storage and read back; an empty table gives no rows."""
    path = f"{shared_folder(pages.sparkSession)}/archive-{uuid.uuid4().hex}"
    write_pages(pages, path)
    return read_pages(pages.sparkSession, path)


#: The same rows without an archive.
ARCHIVED_PAGES_SQL = f"""
WITH rows AS (
  SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS size FROM pages
), met AS (
  SELECT *, CASE WHEN size >= {LEAST} THEN min(page_id) OVER (PARTITION BY html) END AS first FROM rows
)
SELECT page_id, CAST(size AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest,
  CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first < page_id THEN first END AS refers_to
FROM met
"""
