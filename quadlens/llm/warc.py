"""WARC archives as a Spark data source, and page tables through such archives and back.

`register(spark)` makes the format "warc" known. Reading: the driver lists the files and deals them to partitions
by size. Predicates on what a record's own header says (its type, ids, addresses, digest, length, date) are
pushed down where the option "pushdown" is true, as `read` sets it for its `where`: Spark 4.1 keeps what was last pushed
to a relation for later queries over it that push nothing, so only relations that always push may do it. A task parses a record's header first; where a predicate rules the record out, or no asked-for column
needs its payload, it passes over the rest: by a seek in plain files and in gzip members that tell their length (the
"sl" extra field, which the writer sets), else by inflating without keeping anything. Which columns are wanted is
told by the schema asked for, so `.schema("record_id string")` reads headers only.

Writing: each task writes its own files, up to `file_bytes` each, under a temporary name; the driver moves the files
of the attempts that succeeded, so that a lost executor or a repeated attempt leaves nothing behind. One gzip member
a record (`compression` "gzip", the default) or plain ("none"). A response holds its payload behind HTTP headers; a
revisit holds the HTTP headers alone, whose Content-Length is that of the full payload.

Files are never split: a partition holds whole files, as a record's start cannot be told from a payload that quotes
one. A file that breaks off or holds no WARC record raises a ValueError that names it.

Defined results of archive_report: a null html counts as empty; a null url gives a record without address (white space
and controls in one are percent-coded); a null page_id counts as smaller than any other and comes back as null; rows
that repeat the largest page_id of their payload are responses, each; if all page_ids of a payload are null, all are
responses; extra columns are ignored; an empty table gives an empty result. Payloads are told apart by their SHA-256.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
import zlib
from dataclasses import dataclass
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from quadlens.llm.common import join_hot, new_path, on_workers

SCHEMA = "warc_type string, record_id string, date string, target_uri string, refers_to string, content_type string, content_length long, payload_digest string, payload_length long, payload binary, file string"
#: Columns and the header fields that hold them; fixed values of the WARC format.
FIELDS = {
    "warc_type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "date": "WARC-Date",
    "target_uri": "WARC-Target-URI",
    "refers_to": "WARC-Refers-To",
    "content_type": "Content-Type",
    "content_length": "Content-Length",
    "payload_digest": "WARC-Payload-Digest",
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # fixed value of the format
END = b"\r\n\r\n"
CHUNK = 1 << 16
BATCH_BYTES = 4 << 20


def _at(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or address, and the path there."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


# Records


class _Bytes:
    """A file as a stream that can pass over bytes without reading them."""

    def __init__(self, f):
        self.f, self.size, self.buf, self.start, self.at = f, f.size(), b"", 0, 0  # start: where buf begins in the file

    def more(self) -> bytes:
        """What is read but not taken yet, or the next chunk; empty at the end."""
        if self.at == len(self.buf):
            self.start, self.buf, self.at = self.start + len(self.buf), self.f.read(CHUNK), 0
        rest, self.at = self.buf[self.at :] if self.at else self.buf, len(self.buf)
        return rest

    def back(self, n: int) -> None:
        self.at -= n

    def tell(self) -> int:
        return self.start + self.at

    def left(self) -> bool:
        return self.tell() < self.size

    def go(self, place: int) -> None:
        if place > self.size:
            raise ValueError("breaks off inside a record")
        if self.start <= place <= self.start + len(self.buf):
            self.at = place - self.start
        else:
            self.f.seek(place)
            self.start, self.buf, self.at = place, b"", 0


class _Plain:
    """What a record consists of, from an uncompressed file."""

    def __init__(self, source: _Bytes):
        self.source = source

    def until(self, end: bytes) -> bytes:
        """Up to and with `end`; what is left of the stream if it does not come."""
        found = b""
        while end not in found:
            more = self.source.more()
            if not more:
                return found
            found += more
        cut = found.index(end) + len(end)
        self.source.back(len(found) - cut) if len(found) - cut <= self.source.at else self.source.go(self.source.tell() - (len(found) - cut))
        return found[:cut]

    def take(self, n: int) -> bytes:
        parts = []
        while n:
            more = self.source.more()
            if not more:
                raise ValueError("breaks off inside a record")
            if len(more) > n:
                self.source.back(len(more) - n)
                more = more[:n]
            parts.append(more)
            n -= len(more)
        return b"".join(parts)

    def pass_over(self, n: int) -> None:
        self.source.go(self.source.tell() + n)

    def end(self) -> bool:
        """Past the blank lines behind a record; whether nothing is left."""
        while more := self.source.more():
            rest = more.lstrip(b"\r\n")
            if rest:
                self.source.back(len(rest))
                return False
        return True


class _Member:
    """One gzip member, inflated only as far as it is asked for. Without a told length it may hold several records."""

    def __init__(self, source: _Bytes):
        self.source, self.z, self.buf = source, zlib.decompressobj(31), b""
        start = source.tell()
        head = source.more()
        source.back(len(head))
        told = head[:2] == b"\x1f\x8b" and len(head) >= 24 and head[3] & 4 and head[12:16] == b"sl\x08\x00"
        self.next = start + struct.unpack("<I", head[16:20])[0] if told else None

    def _more(self) -> bytes:
        while not self.z.eof:
            raw = self.z.unconsumed_tail or self.source.more()
            if not raw:
                raise ValueError("breaks off inside a gzip member")
            try:
                found = self.z.decompress(raw, CHUNK)
            except zlib.error as e:
                raise ValueError(f"is not gzip: {e}") from e
            if self.z.eof:
                self.source.back(len(self.z.unused_data))
            if found:
                return found
        return b""

    def until(self, end: bytes) -> bytes:
        while end not in self.buf:
            more = self._more()
            if not more:
                found, self.buf = self.buf, b""
                return found
            self.buf += more
        cut = self.buf.index(end) + len(end)
        found, self.buf = self.buf[:cut], self.buf[cut:]
        return found

    def take(self, n: int) -> bytes:
        parts, have = [self.buf[:n]], min(n, len(self.buf))
        self.buf = self.buf[n:]
        while have < n:
            more = self._more()
            if not more:
                raise ValueError("breaks off inside a record")
            parts.append(more[: n - have])
            self.buf = more[n - have :]
            have += len(parts[-1])
        return b"".join(parts)

    def pass_over(self, n: int) -> None:
        while self.next is None and n:
            if not self.buf:
                self.buf = self._more()
                if not self.buf:
                    raise ValueError("breaks off inside a record")
            gone = min(n, len(self.buf))
            self.buf, n = self.buf[gone:], n - gone

    def end(self) -> bool:
        if self.next is not None:
            self.source.go(self.next)
            return True
        while True:
            self.buf = self.buf.lstrip(b"\r\n")
            if self.buf:
                return False
            self.buf = self._more()
            if not self.buf:
                return True


def _fields(head: bytes) -> dict[str, str]:
    """The fields of a header block by lower-case name; a line that opens with white space continues the last."""
    out, last = {}, None
    for line in head.split(b"\r\n")[1:]:
        if line[:1] in (b" ", b"\t") and last:
            out[last] += " " + line.decode("utf-8", "replace").strip()
        elif b":" in line:
            name, value = line.split(b":", 1)
            last = name.strip().lower().decode("ascii", "replace")
            out[last] = value.strip().decode("utf-8", "replace")
    return out


def bare_digest(told: str | None) -> str | None:
    """A labelled digest (`sha1:` and base32 or hex) as bare lower-case hex; others as they are."""
    if told is None or not told.lower().startswith("sha1:"):
        return told
    value = told[5:]
    try:
        return base64.b32decode(value.upper()).hex() if len(value) == 32 else value.lower()
    except ValueError:
        return value.lower()


def _header_row(fields: dict[str, str]) -> dict:
    row = {c: fields.get(f.lower()) for c, f in FIELDS.items()}
    row["content_length"] = int(row["content_length"] or 0)
    row["payload_digest"] = bare_digest(row["payload_digest"])
    return row


def records(f, wanted, columns: set[str]):
    """Rows, as dicts, of the records of an open file whose header `wanted` agrees to; payloads only where columns ask for them."""
    source, part = _Bytes(f), None
    first = source.more()
    source.back(len(first))
    kind = _Member if first[:2] == b"\x1f\x8b" else _Plain
    while True:
        place = source.tell()
        try:
            if part is None or part.end():
                if not source.left():
                    return
                part, place = kind(source), source.tell()
            head = part.until(END)
            if not head.strip():
                continue
            if not head.lstrip().startswith(b"WARC/") or not head.endswith(END):
                raise ValueError("holds what is no WARC record")
            row = _header_row(_fields(head.lstrip()))
            left = row["content_length"]
            keep = wanted(row)
            if keep and columns & {"payload", "payload_length"}:
                row["payload_length"], told = left, None
                if (row["content_type"] or "").startswith("application/http"):
                    http = part.until(END) if left else b""
                    if len(http) > left:
                        raise ValueError("holds a record without the end of its HTTP headers")
                    left -= len(http)
                    told = _fields(http).get("content-length")
                    row["payload_length"] = int(told) if row["warc_type"] == "revisit" and (told or "").isdigit() else left
                if "payload" in columns:
                    row["payload"] = part.take(left) if row["warc_type"] != "revisit" else None
                    left = 0 if row["warc_type"] != "revisit" else left
            part.pass_over(left)
        except ValueError as e:
            raise ValueError(f"{e} (at byte {place})") from e
        if keep:
            yield row


# Predicates

_COMPARE = {
    ds.EqualTo: lambda x, v: x is not None and x == v,
    ds.EqualNullSafe: lambda x, v: x == v,
    ds.In: lambda x, v: x is not None and x in v,
    ds.GreaterThan: lambda x, v: x is not None and x > v,
    ds.GreaterThanOrEqual: lambda x, v: x is not None and x >= v,
    ds.LessThan: lambda x, v: x is not None and x < v,
    ds.LessThanOrEqual: lambda x, v: x is not None and x <= v,
    ds.IsNull: lambda x, v: x is None,
    ds.IsNotNull: lambda x, v: x is not None,
    ds.StringStartsWith: lambda x, v: x is not None and x.startswith(v),
    ds.StringEndsWith: lambda x, v: x is not None and x.endswith(v),
    ds.StringContains: lambda x, v: x is not None and v in x,
}


def _pushable(f) -> bool:
    return type(f) in _COMPARE and len(f.attribute) == 1 and f.attribute[0] in FIELDS


@dataclass
class Files(ds.InputPartition):
    paths: tuple[str, ...]


class WarcReader(ds.DataSourceReader):
    def __init__(self, options, schema):
        self.path, self.schema, self.filters = options["path"], schema, []
        self.most = int(options.get("partition_bytes", 128 << 20))

    def partitions(self):
        fs, path = _at(self.path)
        found = fs.get_file_info(path)
        if found.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [found] if found.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(path, recursive=True))
        below = lambda x: x.path[len(path) :].split("/")
        files = [x for x in files if x.type == pafs.FileType.File and not any(p[:1] in ("_", ".") for p in below(x))]
        out, size = [], self.most
        for x in sorted(files, key=lambda x: x.path):
            if size + x.size > self.most:
                out.append([])
                size = 0
            out[-1].append(x.path)
            size += x.size
        return [Files(tuple(x)) for x in out]

    def read(self, partition):
        fs, _ = _at(self.path)
        schema, names = to_arrow_schema(self.schema), self.schema.fieldNames()
        wanted = lambda row: all(_COMPARE[type(f)](row[f.attribute[0]], getattr(f, "value", None)) for f in self.filters)
        rows, size = [], 0
        for path in partition.paths if partition else ():
            with fs.open_input_file(path) as f:
                try:
                    for row in records(f, wanted, set(names)):
                        rows.append(row | {"file": path})
                        size += 200 + len(row.get("payload") or b"")
                        if size >= BATCH_BYTES:
                            yield _batch(rows, schema)
                            rows, size = [], 0
                except ValueError as e:
                    raise ValueError(f"{path} {e}") from e
        if rows:
            yield _batch(rows, schema)


class PushingReader(WarcReader):
    def pushFilters(self, filters):
        for f in filters:
            if _pushable(f):
                self.filters.append(f)
            else:
                yield f


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(x.name) for r in rows], x.type) for x in schema], schema=schema)


# Writing


def _safe(value: str) -> str:
    """value without what cannot stand in a header line: white space and controls as percent codes."""
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def record_bytes(warc_type: str, fields: dict[str, str | None], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {warc_type}", *(f"{n}: {_safe(v) if n != 'Content-Type' else v}" for n, v in fields.items() if v is not None), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + END + block + END


def _http(length: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()


def gzip_member(raw: bytes) -> bytes:
    """One gzip member, its own length and that of its contents in the "sl" extra field."""
    z = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = z.compress(raw) + z.flush()
    tail = struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)
    total = 24 + len(body) + len(tail)
    if max(total, len(raw)) >= 1 << 32:
        return b"\x1f\x8b\x08\x00\0\0\0\0\0\xff" + body + tail
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", 12) + b"sl\x08\x00" + struct.pack("<II", total, len(raw)) + body + tail


@dataclass
class Written(ds.WriterCommitMessage):
    paths: tuple[str, ...]


class WarcWriter(ds.DataSourceArrowWriter):
    def __init__(self, options, overwrite):
        self.path, self.overwrite = options["path"], overwrite
        self.most = int(options.get("file_bytes", 256 << 20))
        self.packed = options.get("compression", "gzip") != "none"
        self.date = options.get("date") or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
        self.job = f"_temporary-{uuid.uuid4().hex}"

    def _record(self, row: dict) -> bytes:
        kind, payload = row.get("warc_type") or "response", row.get("payload")
        payload = payload.encode() if isinstance(payload, str) else payload or b""
        revisit = kind == "revisit"
        digest = row.get("payload_digest") if revisit else hashlib.sha1(payload).hexdigest()
        fields = {
            "WARC-Record-ID": row.get("record_id") or f"<urn:uuid:{uuid.uuid4()}>",
            "WARC-Date": row.get("date") or self.date,
            "WARC-Target-URI": row.get("target_uri"),
            "WARC-Refers-To": row.get("refers_to") if revisit else None,
            "WARC-Profile": PROFILE if revisit else None,
            "WARC-Payload-Digest": "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode() if digest else None,
            "Content-Type": "application/http;msgtype=response",
        }
        block = _http(int(row.get("payload_length") or 0)) if revisit else _http(len(payload)) + payload
        return record_bytes(kind, fields, block)

    def write(self, iterator):
        fs, path = _at(self.path)
        folder, paths, out, size = f"{path}/{self.job}", [], None, 0
        pack = gzip_member if self.packed else bytes
        try:
            for batch in iterator:
                columns = [batch.column(i) for i in range(batch.num_columns)]
                for i in range(batch.num_rows):  # one row at a time, so that only one payload is held twice
                    raw = pack(self._record({n: c[i].as_py() for n, c in zip(batch.schema.names, columns)}))
                    if out is None or size + len(raw) > self.most:
                        if out:
                            out.close()
                        fs.create_dir(folder)
                        paths.append(f"{folder}/{uuid.uuid4().hex}.warc{'.gz' if self.packed else ''}")
                        out, size = fs.open_output_stream(paths[-1], compression=None), 0
                        info = pack(record_bytes("warcinfo", {"WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": self.date, "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n"))
                        out.write(info)
                        size += len(info)
                    out.write(raw)
                    size += len(raw)
        finally:
            if out:
                out.close()
        return Written(tuple(paths))

    def commit(self, messages):
        fs, path = _at(self.path)
        fs.create_dir(path)
        if self.overwrite:
            for x in fs.get_file_info(pafs.FileSelector(path)):
                if x.type == pafs.FileType.File:
                    fs.delete_file(x.path)
        for m in messages:
            for x in m.paths if m else ():
                fs.move(x, f"{path}/{x.rsplit('/', 1)[1]}")
        self._clear(fs, path)

    def abort(self, messages):
        self._clear(*_at(self.path))

    def _clear(self, fs, path):
        if fs.get_file_info(f"{path}/{self.job}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{path}/{self.job}")


class WarcSource(ds.DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return (PushingReader if self.options.get("pushdown", "false").lower() == "true" else WarcReader)(self.options, schema)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format "warc" known to the session, with predicates pushed down."""
    on_workers(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def pushed_filters(df: DataFrame) -> str:
    """What of the filters over a read the source itself applies, as the plan tells it."""
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    found = re.search(r"PushedFilters: \[(.*)\]", df._jdf.queryExecution().explainString(mode))
    return found[1] if found else ""


def read(spark: SparkSession, path: str, columns: str = SCHEMA, where: str | None = None) -> DataFrame:
    """The records under path that `where`, an SQL condition on columns, agrees to; columns, a schema string out of SCHEMA's, says what is wanted of them.

    Pushdown is on if part of `where` can be pushed; more filters on the result are pushed then, too.
    """
    register(spark)
    found = lambda push: spark.read.format("warc").option("pushdown", push).schema(columns).load(path)
    if where is None:
        return found("false")
    pushing = found("true").where(where)
    return pushing if pushed_filters(pushing) else found("false").where(where)


# A table of pages through archives and back


def page_records(pages: DataFrame, least: int = 1000) -> DataFrame:
    """The records of pages, ready for the writer: of equal payloads of at least `least` bytes only one is stored.

    Which one is decided on hashes alone; html is moved once, to meet that decision, and hashes that more than a
    thousandth of all rows share meet it without a shuffle.
    """
    rows = pages.select("page_id", F.col("url").alias("target_uri"), F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("payload_length", F.octet_length("payload").cast("long"))
    short, long = rows.where(F.col("payload_length") < least), rows.where(F.col("payload_length") >= least)
    long = long.withColumn("hash", F.unhex(F.sha2("payload", 256)))
    owners = long.groupBy("hash").agg(F.max("page_id").alias("owner"), F.count("*").alias("n"))
    long = join_hot(long, owners, ["hash"])
    again = F.col("owner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("owner"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.col(c).cast("string"), F.lit(">"))
    long = long.select(
        "page_id",
        "target_uri",
        F.when(again, "revisit").otherwise("response").alias("warc_type"),
        F.when(again, name("owner")).alias("refers_to"),
        F.when(again, F.sha1("payload")).alias("payload_digest"),  # the writer takes a response's own
        "payload_length",
        F.when(~again, F.col("payload")).alias("payload"),
    )
    none = F.lit(None).cast("string")
    short = short.select("page_id", "target_uri", F.lit("response").alias("warc_type"), none.alias("refers_to"), none.alias("payload_digest"), "payload_length", "payload")
    return short.unionByName(long).withColumn("record_id", name("page_id")).drop("page_id")


def archive(pages: DataFrame, path: str, least: int = 1000, **options) -> None:
    """Writes the records of pages as archives under path."""
    register(pages.sparkSession)
    page_records(pages, least).write.format("warc").options(**options).mode("append").save(path)


def archived_pages(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of the pages archived under path.

    Responses are hashed anew from the payloads read; of revisits only the headers are read.
    """
    page = lambda c: F.nullif(F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1), F.lit("")).cast("long")
    first = read(spark, path, "warc_type string, record_id string, payload binary", "warc_type = 'response'")
    again = read(spark, path, "warc_type string, record_id string, refers_to string, payload_digest string, payload_length long", "warc_type = 'revisit'")
    first = first.select(page("record_id").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), F.col("warc_type").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    again = again.select(page("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"), "payload_digest", F.col("warc_type").alias("record_type"), page("refers_to").alias("refers_to"))
    return first.unionByName(again)


def archive_report(pages: DataFrame, least: int = 1000) -> DataFrame:
    """pages written as archives in the shared folder and read back (see archived_pages)."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    archive(pages, path, least)
    return archived_pages(spark, path)


ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS d, max(page_id) OVER (PARTITION BY b) AS owner FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
  CASE WHEN n >= 1000 AND owner IS NOT NULL AND page_id IS DISTINCT FROM owner THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND owner IS NOT NULL AND page_id IS DISTINCT FROM owner THEN owner END AS refers_to
FROM h
"""
