"""WARC archives: writing with Spark, reading through a Python data source.

``write_archive`` turns rows into WARC/1.1 records, one string each, and lets Spark's
text writer place them, gzipped, so archives can go to any store Spark writes to.  Of records
with equal payloads of at least ``min_revisit_bytes`` bytes the one with the largest
id is a ``response``; the others are ``revisit`` records without payload that refer
to it.  Equal payloads meet by their SHA-1 (id and digest only); the join that tells a
record its partner is an equi-join that Spark splits when one payload is very common.

``WarcSource`` (format ``warc``) plans file partitions: files are packed up to
``partition_bytes``; a file is one unit because record ends are only known from the
headers before them, and the writer bounds the records of a file.  Headers are parsed
first.  Filters on ``warc_type`` and the other header columns are pushed into the
reader (set ``spark.sql.python.filterPushdown.enabled``); the payload of a record that
a filter rejects, or any payload with option ``payload=false``, is skipped by its
Content-Length and never decoded.  Files are opened through pyarrow's file systems
(local and shared folders, HDFS, S3, GCS); those named ``.gz`` are unzipped as they are
read and count ``GZIP_RATIO`` times their size when partitions are planned.

Defined results: null html is an empty payload; a null url leaves Target-URI out, line
breaks in it are escaped; equal payloads under one id are each a response; with a null
id a row is a response when no equal payload has an id, else a revisit; an empty table
writes no record and reads back no row; extra columns are not written.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition, IsNotNull

DATE = "2024-01-01T00:00:00Z"
RECORDS_PER_FILE = 20_000
PARTITION_BYTES = 64 << 20
GZIP_RATIO = 4
ID_URN = "urn:page:"
_BATCH_BYTES = 4 << 20
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_CONV32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"


def sha1_base32(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: 5 hex digits are 4 base32 digits."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, k, 5), 16, 32), 4, "0") for k in range(1, 41, 5)]
    return F.translate(F.concat(*parts), _CONV32, _BASE32)


def with_roles(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """page_id, url, payload (string), payload_bytes, payload_digest, record_type, refers_to."""
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", payload.alias("payload")).select(
        "*", F.octet_length("payload").cast("long").alias("payload_bytes"),
        sha1_base32(F.col("payload").cast("binary")).alias("payload_digest"))
    owners = rows.groupBy("payload_digest").agg(F.max("page_id").alias("_owner"))
    mine = F.col("_owner").isNull() | F.col("page_id").eqNullSafe(F.col("_owner"))
    first = (F.col("payload_bytes") < min_revisit_bytes) | mine
    return (rows.join(owners, "payload_digest")
            .withColumns({"record_type": F.when(first, F.lit("response")).otherwise(F.lit("revisit")),
                          "refers_to": F.when(~first, F.col("_owner"))}).drop("_owner"))


def record(rows: DataFrame) -> DataFrame:
    """One column ``value``: the record without the two line breaks that end it."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    urn = lambda c: F.concat(F.lit(f"<{ID_URN}"), F.col(c).cast("string"), F.lit(">"))
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    revisit = F.col("record_type") == "revisit"
    head = [
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.col("record_type")),
        F.coalesce(line("WARC-Record-ID", urn("page_id")), F.lit(f"WARC-Record-ID: <{ID_URN}>\r\n")),
        F.lit(f"WARC-Date: {DATE}\r\n"), F.coalesce(line("WARC-Target-URI", url), F.lit("")),
        F.when(revisit, F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"),
                                 line("WARC-Refers-To", urn("refers_to")))).otherwise(F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(revisit, line("X-Payload-Length", F.col("payload_bytes").cast("string"))).otherwise(F.lit("")),
        F.lit("Content-Type: text/html; charset=utf-8\r\n"),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("payload_bytes").cast("string"))),
        F.lit("\r\n"), F.when(revisit, F.lit("")).otherwise(F.col("payload")),
    ]
    return rows.select(F.concat(*head).alias("value"))


def write_archive(pages: DataFrame, path: str, min_revisit_bytes: int = 0, records_per_file: int = RECORDS_PER_FILE) -> None:
    (record(with_roles(pages, min_revisit_bytes)).write.option("lineSep", "\r\n\r\n").option("compression", "gzip")
     .option("maxRecordsPerFile", records_per_file).text(path))


SCHEMA = T.StructType([
    T.StructField("warc_type", T.StringType()), T.StructField("record_id", T.StringType()),
    T.StructField("target_uri", T.StringType()), T.StructField("date", T.StringType()),
    T.StructField("payload_digest", T.StringType()), T.StructField("refers_to", T.StringType()),
    T.StructField("content_type", T.StringType()), T.StructField("payload_length", T.LongType()),
    T.StructField("content_length", T.LongType()), T.StructField("payload", T.BinaryType()),
])
_HEADERS = {"warc_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "date": "warc-date",
            "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to", "content_type": "content-type"}


@dataclass
class Files(InputPartition):
    paths: tuple


def _file_system(path: str):
    from pyarrow import fs

    if "://" not in path and path.startswith("file:"):
        path = "file://" + path[5:]
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _headers(stream):
    """The next record's headers (lower-case names), or None at the end."""
    line = stream.readline()
    while line in (b"\r\n", b"\n"):  # between records
        line = stream.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"not a WARC record: {line[:40]!r}")
    found = {}
    while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
        name, _, value = line.decode("utf-8", "replace").partition(":")
        found[name.strip().lower()] = value.strip()
    return found


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.payload = str(options.get("payload", "true")).lower() != "false"
        self.partition_bytes = int(options.get("partition_bytes", PARTITION_BYTES))
        self.wanted: list[tuple[str, frozenset | None]] = []  # (header column, accepted values; None: present)

    def pushFilters(self, filters):
        """Equality, membership and presence of header columns are applied before the
        payload is read; other filters go back to Spark."""
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) else None
            if name in _HEADERS and isinstance(f, EqualTo) and f.value is not None:
                self.wanted.append((name, frozenset([f.value])))
            elif name in _HEADERS and isinstance(f, In):
                self.wanted.append((name, frozenset(f.value)))
            elif name in _HEADERS and isinstance(f, IsNotNull):
                self.wanted.append((name, None))
            else:
                yield f

    def partitions(self):
        from pyarrow import fs

        system, root = _file_system(self.path)
        infos = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        single = system.get_file_info(root)
        infos = [single] if single.is_file else infos
        files = sorted((i.path, i.size * (GZIP_RATIO if i.path.endswith(".gz") else 1)) for i in infos
                       if i.is_file and i.size and not i.base_name.startswith((".", "_")))
        plan, group, total = [], [], 0
        for path, size in files:
            if group and total + size > self.partition_bytes:
                plan.append(Files(tuple(group)))
                group, total = [], 0
            group.append(path)
            total += size
        return [*plan, Files(tuple(group))]

    def read(self, partition):
        system, _ = _file_system(self.path)
        rows, size = [], 0
        for path in partition.paths:
            with _open(system, path) as raw:
                buffered = _Buffered(raw)
                while (h := _headers(buffered)) is not None:
                    length = int(h.get("content-length", 0))
                    row = {c: h.get(k) for c, k in _HEADERS.items()}
                    if any(row[c] is None or (ok is not None and row[c] not in ok) for c, ok in self.wanted):
                        buffered.skip(length)
                        continue
                    row["payload_length"] = int(h.get("x-payload-length", length))
                    row["content_length"] = length
                    if self.payload:
                        row["payload"] = buffered.read(length)
                        size += length
                    else:
                        buffered.skip(length)
                        row["payload"] = None
                    rows.append(row)
                    if size >= _BATCH_BYTES or len(rows) >= 10_000:
                        yield _batch(rows)
                        rows, size = [], 0
        if rows:
            yield _batch(rows)


def _open(system, path: str):
    return system.open_input_stream(path, compression="gzip") if path.endswith(".gz") else system.open_input_file(path)


class _Buffered:
    """Lines, bytes and skips over a file; one without random access is read over what is skipped."""

    def __init__(self, raw, block: int = 1 << 18):
        self.raw, self.block, self.buffer, self.at = raw, block, b"", 0
        self.size = raw.size() if raw.seekable() else None

    def _fill(self) -> bool:
        """Read another block behind what is left; False at the end."""
        more = self.raw.read(self.block)
        self.buffer, self.at = self.buffer[self.at:] + more, 0
        return bool(more)

    def readline(self) -> bytes:
        while (end := self.buffer.find(b"\n", self.at)) < 0:
            if not self._fill():
                line, self.at = self.buffer[self.at:], len(self.buffer)
                return line
        line, self.at = self.buffer[self.at:end + 1], end + 1
        return line

    def read(self, n: int) -> bytes:
        have = self.buffer[self.at:self.at + n]
        self.at += len(have)
        if len(have) < n:
            have += self._more(n - len(have))
            self._reset()
        return have

    def _more(self, n: int) -> bytes:
        """The next n bytes of the file, fewer only at its end (a stream may hand out less at a time)."""
        parts = []
        while n > 0 and (part := self.raw.read(n)):
            parts.append(part)
            n -= len(part)
        return b"".join(parts)

    def skip(self, n: int) -> None:
        if self.at + n <= len(self.buffer):
            self.at += n
        elif self.size is None:
            n -= len(self.buffer) - self.at
            while n > 0 and (part := self.raw.read(min(n, self.block))):
                n -= len(part)
            self._reset()
        else:
            self.raw.seek(min(self.size, self.raw.tell() + n - (len(self.buffer) - self.at)))
            self._reset()

    def _reset(self) -> None:
        self.buffer, self.at = b"", 0


def _batch(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"payload_length": pa.int64(), "content_length": pa.int64(), "payload": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], kinds.get(f.name, pa.string())) for f in SCHEMA],
                                      names=SCHEMA.names)


class WarcSource(DataSource):
    """``spark.read.format("warc").load(path)``; options: payload, partition_bytes."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(dict(self.options))


def read_archive(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    from churnlens.session import ship_package

    ship_package(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)
