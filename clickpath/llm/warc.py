"""Operator 11: WARC archives as a PySpark Python data source, ``spark.read.format("warc")`` and ``df.write.format("warc")``.

Reading. The planner lists the files and deals them, whole, to partitions of about ``partitionBytes``. With the option ``pushdown``
filters on the columns of ``HEADER_COLUMNS`` (equality, IN, comparisons, prefixes, null tests and their negations) are pushed down.
It is an option, because Spark 4.1 keeps what was pushed on the loaded DataFrame: such a DataFrame may be scanned once in a plan only
(``read_records`` loads one for its condition), whereas one without the option may be used freely. A task parses a record's
headers first; where a pushed filter rejects the record, or the schema that was asked for has no ``payload``, the block is passed over
(a seek in a plain file, inflated but neither held nor decoded in a compressed one). Payloads are read record by record into bounded Arrow batches.

Writing. Each task writes files of its own, each begun by a warcinfo record and closed at about ``fileBytes``; with compression each
record is one gzip member. A task's files have names that no other attempt uses, and count only once the driver has written the manifest
of all tasks' files: a lost executor or a repeated or failed attempt leaves files that no reader sees. Folders without a
manifest (written by others) are read by their file names. Paths are those that pyarrow's file systems open (local, hdfs, s3, gs).

``archive`` writes web pages: of records with equal payloads of at least ``least_bytes``, that with the largest id is a response, the others
are revisit records that hold the HTTP headers only. Payloads meet by their SHA-1 and length in an aggregate with map-side
combination; only groups of several rows are joined back, from a written table, so that a hot payload's rows can be split.

Defined cases: a null payload is the empty one; empty and short payloads are responses; very long payloads are one record and one row
each; null ids are smaller than any other, rows that repeat a group's largest id are all responses; repeated rows are records of their
own; a null URI writes no header, control characters in a header are percent-encoded; an empty table writes a manifest
without files, which reads as an empty table; other columns are not written. Malformed records raise an error that names file and place.
"""

from __future__ import annotations

import base64
import gzip
import io
import json
import re
import uuid
import zlib
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import datasource as ds
from pyspark.sql.types import StructType

from clickpath.llm.common import keep

SCHEMA = ("file string, number long, record_type string, record_id string, target_uri string, date string, refers_to string, "
          "payload_sha1 string, content_type string, content_length long, headers map<string,string>, "
          "payload_length long, payload binary")
#: Columns known from a record's own headers: filters on them need no block.
HEADER_COLUMNS = ("record_type", "record_id", "target_uri", "date", "refers_to", "payload_sha1", "content_type", "content_length")
LEAST_BYTES = 1000
FILE_BYTES = 128 << 20
PARTITION_BYTES = 128 << 20
#: Rows and payload bytes of an Arrow batch, at most (but for one row).
BATCH_ROWS, BATCH_BYTES = 512, 8 << 20
MANIFEST = "_manifest-"
#: Fixed values of the format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "application/http"
NO_DATE = "1970-01-01T00:00:00Z"
_CONTROL = re.compile(r"[\x00-\x1f\x7f]")


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def archive_files(path: str) -> list[tuple[str, int]]:
    """(name, bytes) of the files that count: those of the manifests, else all WARC files in the folder (or the one file)."""
    fs, root = file_system(path)
    if fs.get_file_info(root).type == pafs.FileType.File:
        return [(root, fs.get_file_info(root).size)]
    there = [i for i in fs.get_file_info(pafs.FileSelector(root)) if i.type == pafs.FileType.File]
    manifests = [i.path for i in there if i.base_name.startswith(MANIFEST)]
    if manifests:
        found = []
        for m in sorted(manifests):
            with fs.open_input_stream(m) as f:
                found += [(f"{root.rstrip('/')}/{name}", size) for name, size in json.loads(f.read())]
        return sorted(found)
    return sorted((i.path, i.size) for i in there if re.search(r"\.warc(\.gz)?$", i.base_name))


# --- reading ---------------------------------------------------------------------------------------------------------

@dataclass
class Files(ds.InputPartition):
    files: list

    def __init__(self, files: list):
        super().__init__(None)
        self.files = files


def digest_hex(label: str | None) -> str | None:
    """Lower-case hex of a labelled SHA-1 digest, which archives write in base 32 or in hex."""
    name, _, value = (label or "").partition(":")
    if name.lower() != "sha1":
        return None
    try:
        return base64.b32decode(value.upper()).hex() if len(value) == 32 else bytes.fromhex(value).hex() if len(value) == 40 else None
    except ValueError:
        return None


def header_lines(stream, most: int | None = None) -> tuple[str, dict[str, str], int]:
    """First line, headers (names in lower case) and size of a header part, which ends with an empty line or after ``most`` bytes."""
    first, found, last, size = None, {}, None, 0
    while most is None or size < most:
        line = stream.readline() if most is None else stream.readline(most - size)
        size += len(line)
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if not text:
            break
        if first is None:
            first = text
        elif text[0] in " \t" and last:  # a folded line
            found[last] += " " + text.strip()
        else:
            last, _, value = text.partition(":")
            last = last.strip().lower()
            found[last] = value.strip()
    return first or "", found, size


def plain_id(value: str | None) -> str | None:
    return value[1:-1] if value and value[0] == "<" and value[-1] == ">" else value


def records(stream, name: str, wanted, with_payload: bool):
    """A dict of each record that ``wanted`` (a test of its header columns) holds for."""
    number = -1
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        number += 1
        if not line.startswith(b"WARC/"):
            raise ValueError(f"{name}: record {number} does not begin with a WARC version")
        _, headers, _ = header_lines(_Prefixed(line, stream))
        length = int(headers.get("content-length", -1))
        if length < 0:
            raise ValueError(f"{name}: record {number} has no content length")
        row = {"file": name, "number": number, "record_type": headers.get("warc-type"), "record_id": plain_id(headers.get("warc-record-id")),
               "target_uri": headers.get("warc-target-uri"), "date": headers.get("warc-date"), "refers_to": plain_id(headers.get("warc-refers-to")),
               "payload_sha1": digest_hex(headers.get("warc-payload-digest")), "content_type": headers.get("content-type"),
               "content_length": length, "headers": headers}
        if not wanted(row):
            stream.seek(length, 1)
            continue
        size = 0
        row["payload_length"] = length
        if (row["content_type"] or "").startswith(HTTP):
            _, http, size = header_lines(stream, length)
            row["payload_length"] = length - size
            if row["record_type"] == "revisit" and http.get("content-length", "").isdigit():
                row["payload_length"] = int(http["content-length"])
        row["payload"] = None
        if with_payload and row["record_type"] != "revisit":
            row["payload"] = stream.read(length - size)
            if len(row["payload"]) < length - size:
                raise ValueError(f"{name}: record {number} is cut")
        else:
            stream.seek(length - size, 1)
        yield row


class _Prefixed:
    """A stream whose first line has been read already."""

    def __init__(self, line: bytes, stream):
        self.line, self.stream = line, stream

    def readline(self) -> bytes:
        line, self.line = self.line, None
        return self.stream.readline() if line is None else line


def as_test(f: ds.Filter):
    """(column, function of its value) of a filter on a header column, None for any other filter."""
    if isinstance(f, ds.Not):
        inner = as_test(f.child)
        # SQL: the negation of an unknown comparison is unknown, too
        known = isinstance(f.child, (ds.IsNull, ds.IsNotNull, ds.EqualNullSafe))
        return inner and (inner[0], lambda x, t=inner[1]: (known or x is not None) and not t(x))
    column = getattr(f, "attribute", None)
    if not column or len(column) != 1 or column[0] not in HEADER_COLUMNS:
        return None
    v = getattr(f, "value", None)
    tests = {
        ds.EqualTo: lambda x: x is not None and x == v, ds.EqualNullSafe: lambda x: x == v,
        ds.GreaterThan: lambda x: x is not None and x > v, ds.GreaterThanOrEqual: lambda x: x is not None and x >= v,
        ds.LessThan: lambda x: x is not None and x < v, ds.LessThanOrEqual: lambda x: x is not None and x <= v,
        ds.In: lambda x: x is not None and x in v, ds.IsNull: lambda x: x is None, ds.IsNotNull: lambda x: x is not None,
        ds.StringStartsWith: lambda x: x is not None and x.startswith(v), ds.StringEndsWith: lambda x: x is not None and x.endswith(v),
        ds.StringContains: lambda x: x is not None and v in x}
    test = tests.get(type(f))
    return test and (column[0], test)


class WarcReader(ds.DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema = schema
        self.path = options["path"]
        self.most = int(options.get("partitionbytes", PARTITION_BYTES))
        self.least_parts = int(options.get("minpartitions", 1))
        self.filters: list = []

    def partitions(self):
        """Whole files, dealt in order to partitions of about equal bytes."""
        files = archive_files(self.path)
        size = max(1, min(self.most, -(-sum(b for _, b in files) // max(1, self.least_parts))))
        parts, held = [[]], 0
        for name, b in files:
            if parts[-1] and held + b > size:
                parts.append([])
                held = 0
            parts[-1].append(name)
            held += b
        return [Files(p) for p in parts]

    def read(self, partition):
        from pyspark.sql.pandas.types import to_arrow_schema

        schema, names = to_arrow_schema(self.schema), self.schema.names
        tests = [as_test(f) for f in self.filters]
        wanted = lambda row: all(test(row[c]) for c, test in tests)
        fs, _ = file_system(self.path)
        held, size = [], 0

        def batch():
            cols = [[list(r[n].items()) if n == "headers" else r[n] for r in held] for n in names]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], names=names)

        for name in partition.files:
            with fs.open_input_file(name) as raw:
                # only a compressed file needs the detour over a stream; a plain one seeks
                stream = gzip.GzipFile(fileobj=raw) if name.endswith(".gz") else io.BufferedReader(_Raw(raw), 1 << 16)
                for row in records(stream, name, wanted, "payload" in names):
                    held.append(row)
                    size += len(row["payload"] or b"")
                    if len(held) >= BATCH_ROWS or size >= BATCH_BYTES:
                        yield batch()
                        held.clear()
                        size = 0
        if held:
            yield batch()


class PushedWarcReader(WarcReader):
    """The reader with filters pushed down."""

    def pushFilters(self, filters):
        for f in filters:
            if as_test(f):
                self.filters.append(f)
            else:
                yield f


class _Raw(io.RawIOBase):
    """A pyarrow file as Python's raw stream."""

    def __init__(self, file):
        self.file = file

    def readable(self):
        return True

    def seekable(self):
        return True

    def seek(self, offset, whence=0):
        return self.file.seek(offset, whence)

    def tell(self):
        return self.file.tell()

    def readinto(self, buffer):
        data = self.file.read(len(buffer))
        buffer[:len(data)] = data
        return len(data)


# --- writing ---------------------------------------------------------------------------------------------------------

@dataclass
class Written(ds.WriterCommitMessage):
    files: list = field(default_factory=list)


def header_value(text: str) -> str:
    return _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", text).strip()


def record_bytes(row: dict) -> bytes:
    """One record: of a response the HTTP headers and the payload, of a revisit the HTTP headers only."""
    payload = row["payload"] or b""
    block = (f"HTTP/1.1 200 OK\r\nContent-Type: {header_value(row['media_type'])}\r\n"
             f"Content-Length: {row['payload_length']}\r\n\r\n").encode() + payload
    revisit = row["record_type"] == "revisit"
    digest = base64.b32encode(bytes.fromhex(row["payload_sha1"])).decode() if row["payload_sha1"] else None
    headers = [("WARC-Type", row["record_type"]), ("WARC-Record-ID", f"<{row['record_id']}>"), ("WARC-Date", row["date"] or NO_DATE),
               ("WARC-Target-URI", row["target_uri"]), ("WARC-Payload-Digest", digest and f"sha1:{digest}"),
               ("WARC-Refers-To", row["refers_to"] and f"<{row['refers_to']}>"), ("WARC-Profile", REVISIT_PROFILE if revisit else None),
               ("Content-Type", f"{HTTP};msgtype=response"), ("Content-Length", str(len(block)))]
    head = "".join(f"{name}: {header_value(value)}\r\n" for name, value in headers if value is not None)
    return f"{VERSION}\r\n{head}\r\n".encode() + block + b"\r\n\r\n"


def info_record(name: str) -> bytes:
    block = b"software: clickpath\r\nformat: WARC File Format 1.1\r\n"
    return (f"{VERSION}\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: {NO_DATE}\r\nWARC-Filename: {name}\r\n"
            f"Content-Type: application/warc-fields\r\nContent-Length: {len(block)}\r\n\r\n").encode() + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class WarcWriter(ds.DataSourceArrowWriter):
    """Input columns: record_type, record_id, target_uri, date, refers_to, payload_sha1, media_type, payload_length, payload."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.level = int(options.get("level", 6))
        self.zipped = options.get("compression", "gzip") == "gzip"
        self.most = int(options.get("filebytes", FILE_BYTES))

    def write(self, iterator):
        fs, root = file_system(self.path)
        own, out, written, name, size = uuid.uuid4().hex, None, [], "", 0
        pack = (lambda data: gzip_member(data, self.level)) if self.zipped else (lambda data: data)
        fs.create_dir(root)
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    if out is None:
                        name, size = f"part-{own}-{len(written):05d}.warc" + ".gz" * self.zipped, 0
                        out = fs.open_output_stream(f"{root.rstrip('/')}/{name}", compression=None)
                        size += out.write(pack(info_record(name)))
                    size += out.write(pack(record_bytes(row)))
                    if size >= self.most:
                        out.close()
                        out = None
                        written.append((name, size))
            if out is not None:
                out.close()
                written.append((name, size))
                out = None
        finally:
            if out is not None:
                out.close()
        return Written(written)

    def commit(self, messages):
        fs, root = file_system(self.path)
        root = root.rstrip("/")
        fs.create_dir(root)
        before = [i.path for i in fs.get_file_info(pafs.FileSelector(root)) if i.type == pafs.FileType.File] if self.overwrite else []
        names = [f for m in messages if m is not None for f in m.files]
        with fs.open_output_stream(f"{root}/{MANIFEST}{uuid.uuid4().hex}.json") as f:
            f.write(json.dumps(names).encode())
        new = {f"{root}/{n}" for n, _ in names}
        # manifests go first: without them their files no longer count
        for old in sorted((p for p in before if p not in new), key=lambda p: not p.rsplit("/", 1)[1].startswith(MANIFEST)):
            fs.delete_file(old)

    def abort(self, messages):
        fs, root = file_system(self.path)
        for m in messages:
            for name, _ in m.files if m is not None else []:
                fs.delete_file(f"{root.rstrip('/')}/{name}")


class WarcDataSource(ds.DataSource):
    """``spark.read.format("warc")``, ``df.write.format("warc")``. A schema of some of the columns reads only those."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        options = {k.lower(): v for k, v in self.options.items()}
        return (PushedWarcReader if options.get("pushdown") == "true" else WarcReader)(schema, options)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter({k.lower(): v for k, v in self.options.items()}, overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to a session, and allow its filters to be pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def read_warc(spark: SparkSession, path: str, columns: str | None = None, **options) -> DataFrame:
    """The records of an archive; ``columns`` (a schema) leaves out what is not wanted."""
    register(spark)
    reader = spark.read.format("warc").option("minPartitions", str(spark.sparkContext.defaultParallelism)).options(**options)
    return (reader.schema(columns) if columns else reader).load(path)


def read_records(spark: SparkSession, path: str, condition: Column | str, columns: str | None = None, **options) -> DataFrame:
    """The records that a condition on ``HEADER_COLUMNS`` holds for, pushed down to the readers. The result is for one use in a
    plan: for other conditions call this again."""
    return read_warc(spark, path, columns, pushdown="true", **options).where(condition)


def revisits(pages: DataFrame, id_col: str, uri: Column, payload: Column, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """(id, target_uri, payload, payload_length, payload_sha1, record_type, first) of every row; first: the id of the response
    that a revisit refers to."""
    rows = (pages.select(F.col(id_col).alias("id"), uri.alias("target_uri"), F.coalesce(payload, F.lit("")).cast("binary").alias("payload"))
            .withColumns({"payload_length": F.octet_length("payload").cast("long"), "payload_sha1": F.sha1("payload")}))
    groups = keep(rows.where(F.col("payload_length") >= least_bytes).groupBy("payload_sha1", "payload_length")
                  .agg(F.max("id").alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n"), "payloads")
    other = F.col("_first").isNotNull() & ~F.col("id").eqNullSafe(F.col("_first"))
    return (rows.join(groups, ["payload_sha1", "payload_length"], "left")
            .select("id", "target_uri", "payload", "payload_length", "payload_sha1",
                    F.when(other, "revisit").otherwise("response").alias("record_type"), F.when(other, F.col("_first")).alias("first")))


def archive(pages: DataFrame, path: str, id_col: str, uri: Column, payload: Column, least_bytes: int = LEAST_BYTES,
            media_type: str = "text/html; charset=utf-8", mode: str = "append", **options) -> None:
    """Write every row as a record ``urn:page:<id>`` of a WARC archive at ``path``."""
    register(pages.sparkSession)
    urn = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")))
    rows = revisits(pages, id_col, uri, payload, least_bytes)
    revisit = F.col("record_type") == "revisit"
    (rows.select("record_type", urn("id").alias("record_id"), "target_uri", F.lit(None).cast("string").alias("date"),
                 F.when(revisit, urn("first")).alias("refers_to"), "payload_sha1", F.lit(media_type).alias("media_type"), "payload_length",
                 F.when(~revisit, F.col("payload")).alias("payload"))
     .write.format("warc").mode(mode).options(**options).save(path))


def page_of(record: Column) -> Column:
    """The id in ``urn:page:<id>``; null where there is none."""
    return F.substring(record, len("urn:page:") + 1, 1 << 30).try_cast("long")


def read_pages(spark: SparkSession, path: str, id_col: str) -> DataFrame:
    """(id, payload_bytes, payload_digest, record_type, refers_to) of every page of an archive: size and digest of a response from
    the payload itself, of a revisit from its headers."""
    rows = read_records(spark, path, F.col("record_type").isin("response", "revisit"),
                        "record_type string, record_id string, refers_to string, payload_sha1 string, payload_length long, payload binary")
    stored = F.col("record_type") == "response"
    return rows.select(page_of(F.col("record_id")).alias(id_col),
                       F.when(stored, F.octet_length("payload")).otherwise(F.col("payload_length")).cast("long").alias("payload_bytes"),
                       F.when(stored, F.sha1("payload")).otherwise(F.col("payload_sha1")).alias("payload_digest"),
                       "record_type", page_of(F.col("refers_to")).alias("refers_to"))
