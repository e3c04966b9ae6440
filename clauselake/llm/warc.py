"""WARC archives as a Spark data source, read and written.

Reading plans partitions by size, takes predicates on record types and headers, parses the headers of a record first
and passes over the payloads of records that are not wanted, and of all if none is asked for. Archives may be plain or
compressed record by record. Compressed records written here say how long they are in an extra field of their gzip
header, so that a reader inflates the headers alone and jumps to the next record.

A file larger than the option splitBytes is cut, so that no task reads more than that; each part begins at the first
place behind the cut that looks like a record. Archives whose payloads hold archives themselves need splitBytes=0, which
leaves files whole.

The module stands by itself, as Spark may load it in processes that do not have the package.
"""

from __future__ import annotations

import io
import struct
import sys
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualNullSafe, EqualTo, In, InputPartition, IsNotNull, Not, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Header of each column that is text.
HEADERS = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "date": "warc-date", "content_type": "content-type", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to"}
SCHEMA = ", ".join(f"{c} string" for c in HEADERS) + ", payload_bytes long, payload binary"
_ARROW = pa.schema([*((c, pa.string()) for c in HEADERS), ("payload_bytes", pa.int64()), ("payload", pa.binary())])
#: Bytes of a file before the writer begins another, of files in a partition, and of payloads in a batch.
FILE_BYTES, PARTITION_BYTES, BATCH_BYTES = 64 << 20, 64 << 20, 4 << 20
#: Bytes of a file beyond which it is cut: twice what is written to one, so that files written here stay whole.
SPLIT_BYTES = 128 << 20
#: Payloads of fewer bytes are never written as revisits.
LEAST_REVISIT = 1000
#: The longest that a length of 32 bits can say.
_LONGEST = 0xFFFFFFFF
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _open_fs(path: str):
    """The file system of a path as Spark writes it, and the path in it; s3a and s3n are what pyarrow calls s3."""
    import re

    from pyarrow import fs

    path = re.sub(r"^s3[an]://", "s3://", re.sub(r"^file:/+", "file:///", path))
    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path)


def gzip_member(data: bytes, level: int = 1) -> bytes:
    """A gzip member whose extra field "sl" holds its compressed and its full length. A record that is too long for these
    numbers of 32 bits has an ordinary header, and is inflated to find its end."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    size = 10 + 2 + 12 + len(body) + 8
    if max(size, len(data)) > _LONGEST:
        return b"\x1f\x8b\x08\0\0\0\0\0\0\xff" + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)
    extra = b"sl" + struct.pack("<HII", 8, size, len(data))
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def record(headers: dict[str, str], payload: bytes) -> bytes:
    """A record; line ends in header values become spaces."""
    head = "".join(f"{k}: {' '.join(v.splitlines())}\r\n" for k, v in headers.items() if v is not None)
    return f"WARC/1.1\r\n{head}Content-Length: {len(payload)}\r\n\r\n".encode() + payload + b"\r\n\r\n"


def _parse(head: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    last = None
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
        elif ":" in line:
            k, v = line.split(":", 1)
            last = k.strip().lower()
            out[last] = v.strip()
    return out


class _Inflated(io.RawIOBase):
    """One gzip member of a stream, inflated as it is read and no further than asked for."""

    def __init__(self, f, start: int):
        self.f, self.z, self.raw, self.done = f, zlib.decompressobj(31), b"", False
        f.seek(start)

    def _more(self, most: int) -> bytes:
        """Up to `most` bytes more, some unless the member has ended."""
        while not self.done:
            raw = self.raw or self.f.read(min(max(most, 4 << 10), 1 << 20))
            out = self.z.decompress(raw, most)
            self.raw = self.z.unconsumed_tail
            self.done = self.z.eof or not raw
            if out:
                return out
        return b""

    def read(self, n: int = -1) -> bytes:
        parts = []
        while n and (out := self._more(n if n > 0 else 1 << 20)):
            parts.append(out)
            n -= len(out) if n > 0 else 0
        return b"".join(parts)

    def end(self) -> int:
        """Where the next member begins."""
        while self._more(1 << 20):
            pass
        return self.f.tell() - len(self.z.unused_data)


_MAGIC = b"\x1f\x8b\x08"


def next_record(f, at: int, size: int) -> int:
    """The first place from `at` on where a record begins: a gzip member that holds one, or a plain one behind the two
    line ends that close the record before; `size` if there is none."""
    if at <= 0:
        return 0
    f.seek(0)
    packed = f.read(3) == _MAGIC
    mark = _MAGIC if packed else b"\r\n\r\nWARC/"
    at, held = at if packed else max(0, at - 4), b""
    f.seek(at)
    while more := f.read(1 << 20):
        held += more
        found = held.find(mark)
        while found >= 0:
            if not packed:
                return at + found + 4
            if found + 4096 > len(held):
                held += f.read(4096)
            try:
                if zlib.decompressobj(31).decompress(held[found : found + 4096], 64).startswith(b"WARC/"):
                    return at + found
            except zlib.error:
                pass
            found = held.find(mark, found + 1)
        cut = max(0, len(held) - len(mark) + 1)
        at, held = at + cut, held[cut:]
    return size


def records(f, wanted, payloads: bool, start: int = 0, end: int | None = None) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """(headers, payload) of the records of an open archive for which wanted(headers) holds, in their order; the
    payload is None unless `payloads`. The payload of other records is not inflated where the record tells its length.
    With `start` and `end`, of those records that begin from the one on and before the other."""
    size = f.size()
    at, end = next_record(f, start, size), size if end is None else min(end, size)
    while at < end:
        f.seek(at)
        front = f.read(24)
        packed = front[:2] == _MAGIC[:2]
        known = packed and front[3] & 4 and front[12:14] == b"sl"
        source = _Inflated(f, at) if packed else f
        if not packed:
            f.seek(at)
        head, seen = bytearray(), 0
        while head.find(b"\r\n\r\n", max(0, seen - 3)) < 0:
            seen = len(head)
            more = source.read(1024 + seen)
            if not more:
                break
            head += more
        head = bytes(head)
        if not head.strip():
            at = source.end() if packed else at + max(1, len(head))
            continue
        raw, _, rest = head.partition(b"\r\n\r\n")
        headers = _parse(raw.lstrip(b"\r\n"))
        length = int(headers.get("content-length", 0))
        want = wanted(headers)
        body = None
        if want and payloads:
            body = rest[:length]
            if len(body) < length:
                body += source.read(length - len(body))
        if known:
            at += struct.unpack("<I", front[16:20])[0]
        else:
            at = source.end() if packed else at + len(raw) + 4 + length + 4
        if want:
            yield headers, body


@dataclass
class Files(InputPartition):
    #: path, start and end of each part; an end of None is the file's
    parts: tuple[tuple[str, int, int | None], ...]


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.payloads = options["path"], str(options.get("payload", "true")).lower() == "true"
        self.most, self.tests = int(options.get("partitionBytes", PARTITION_BYTES)), []
        self.split = int(options.get("splitBytes", SPLIT_BYTES))

    def pushFilters(self, filters):  # noqa: N802
        """Takes the predicates on header columns that it can apply to them; gives back the others."""
        for f in filters:
            inner, turned = (f.child, True) if isinstance(f, Not) else (f, False)
            column = getattr(inner, "attribute", (None,))
            if len(column) == 1 and column[0] in HEADERS and isinstance(inner, (EqualTo, EqualNullSafe, In, IsNotNull, StringStartsWith, StringEndsWith, StringContains)):
                self.tests.append((HEADERS[column[0]], type(inner).__name__, getattr(inner, "value", None), turned))
            else:
                yield f

    def partitions(self):
        from pyarrow import fs

        store, path = _open_fs(self.path)
        info = store.get_file_info(path)
        found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(path))
        found = sorted((f for f in found if f.type == fs.FileType.File and f.path.endswith((".warc", ".warc.gz")) and not f.base_name.startswith(("_", "."))), key=lambda f: f.path)
        out, held, total = [], [], 0
        for f in found:
            step = self.split or f.size or 1
            for at in range(0, max(f.size, 1), step):
                size = min(step, f.size - at)
                if held and total + size > self.most:
                    out.append(Files(tuple(held)))
                    held, total = [], 0
                held.append((f.path, at, None if at + step >= f.size else at + step))
                total += size
        return out + [Files(tuple(held))] if held or not out else out

    def wanted(self, headers: dict[str, str]) -> bool:
        for name, kind, value, turned in self.tests:
            v = headers.get(name)
            if v is None:
                if kind == "EqualNullSafe":
                    hit = value is None
                elif kind == "IsNotNull":
                    hit = False
                else:
                    return False  # a comparison with null holds neither way
            else:
                hit = {"EqualTo": lambda: v == value, "EqualNullSafe": lambda: v == value, "In": lambda: v in value, "IsNotNull": lambda: True, "StringStartsWith": lambda: v.startswith(value), "StringEndsWith": lambda: v.endswith(value), "StringContains": lambda: value in v}[kind]()
            if hit == turned:
                return False
        return True

    def read(self, partition):
        store, _ = _open_fs(self.path)
        rows, held = [], 0
        for path, start, end in partition.parts:
            with store.open_input_file(path) as f:
                for headers, body in records(f, self.wanted, self.payloads, start, end):
                    full = headers.get("x-payload-length", headers.get("content-length"))
                    rows.append((*(headers.get(h) for h in HEADERS.values()), None if full is None else int(full), body))
                    held += len(body or b"") + 200
                    if held >= BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


@dataclass
class Written(WriterCommitMessage):
    files: tuple[tuple[str, str], ...]


class WarcWriter(DataSourceWriter):
    """Writes rows of SCHEMA; files get their names when all tasks are done, so a lost task leaves none. Rows come one
    at a time, so that a task holds no more than one long payload."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.packed, self.most = str(options.get("compress", "true")).lower() == "true", int(options.get("fileBytes", FILE_BYTES))

    def write(self, iterator):
        store, path = _open_fs(self.path)
        store.create_dir(path, recursive=True)
        files, out, size = [], None, 0
        for row in iterator:
            payload = bytes(row["payload"] or b"")
            headers = {"WARC-Type": row["record_type"], "WARC-Record-ID": row["record_id"], "WARC-Date": row["date"], "WARC-Target-URI": row["target_uri"], "WARC-Payload-Digest": row["payload_digest"], "Content-Type": row["content_type"]}
            if row["record_type"] == "revisit":
                headers |= {"WARC-Refers-To": row["refers_to"], "WARC-Profile": PROFILE, "X-Payload-Length": str(row["payload_bytes"])}
            data = record(headers, payload)
            data = gzip_member(data) if self.packed else data
            if out is None or size + len(data) > self.most:
                if out is not None:
                    out.close()
                name = uuid.uuid4().hex + (".warc.gz" if self.packed else ".warc")
                files.append((f"{path}/_{name}", f"{path}/part-{name}"))
                out, size = store.open_output_stream(files[-1][0], compression=None), 0
            out.write(data)
            size += len(data)
        if out is not None:
            out.close()
        return Written(tuple(files))

    def commit(self, messages):
        store, path = _open_fs(self.path)
        if self.overwrite:
            from pyarrow import fs

            for f in store.get_file_info(fs.FileSelector(path, allow_not_found=True)):
                if f.base_name.startswith("part-"):
                    store.delete_file(f.path)
        for m in messages:
            for held, name in m.files if m else ():
                store.move(held, name)

    def abort(self, messages):
        store, _ = _open_fs(self.path)
        for m in messages:
            for held, _ in m.files if m else ():
                store.delete_file(held)


class WarcDataSource(DataSource):
    """format("warc"). Options: path; payload=false leaves payloads unread; compress, fileBytes, partitionBytes;
    splitBytes cuts larger files (0: none), see above."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Makes the source known to a session and lets Spark push predicates down to Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


_URN = "urn:page:"


def page_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Rows of SCHEMA, one for each page. A null page has an empty payload.

    Of pages with equal payloads of at least LEAST_REVISIT bytes, the one of largest id is a response with the
    payload, the others are revisits that refer to it; rows that repeat the largest id are all responses. Pages with
    smaller payloads are responses. A null id ranks below all others. Payloads are equal when SHA-1 and length are.

    Only digests that occur more than once are joined back; their table is written first, so that its size is known
    when the join is planned, and a large one meets the pages by sort-merge, where a hot digest is split.
    """
    from clauselake.session import materialize

    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"bytes": F.octet_length("payload").cast("long"), "sha": F.sha1("payload")})
    twice = rows.where(F.col("bytes") >= LEAST_REVISIT).groupBy("sha", "bytes").agg(F.max("id").alias("keep"), F.count(F.lit(1)).alias("n")).where("n > 1")
    twice = materialize(twice.select(F.col("sha").alias("s"), F.col("bytes").alias("b"), "keep"), "warc-twice")
    j = rows.join(twice, (F.col("sha") == F.col("s")) & (F.col("bytes") == F.col("b")), "left")
    again = F.col("s").isNotNull() & ~F.col("id").eqNullSafe(F.col("keep"))
    urn = lambda c: F.concat(F.lit(f"<{_URN}"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    return j.select(
        urn(F.col("id")).alias("record_id"),
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.col("url").alias("target_uri"),
        F.lit(date).alias("date"),
        F.lit("text/html; charset=utf-8").alias("content_type"),
        F.concat(F.lit("sha1:"), F.col("sha")).alias("payload_digest"),
        F.when(again, urn(F.col("keep"))).alias("refers_to"),
        F.col("bytes").alias("payload_bytes"),
        F.when(~again, F.col("payload")).alias("payload"),
    )


def query(pages: DataFrame) -> DataFrame:
    """Writes the pages' archives and reads them back. Lengths and digests of responses are those of the payloads as
    read, those of revisits stand in their headers. Nulls, empty and very long pages, repeated rows, null ids and empty
    tables as in page_records(); further columns are not read. The archives stay until session.clear()."""
    from clauselake.session import scratch_path

    spark = pages.sparkSession
    register(spark)
    path = scratch_path(spark, "warc")
    page_records(pages).write.format("warc").mode("append").save(path)
    kind = pages.schema["page_id"].dataType
    number = lambda c: F.nullif(F.regexp_extract(c, rf"^<{_URN}(.*)>$", 1), F.lit("")).cast(kind)
    back = spark.read.format("warc").load(path)
    read = F.col("record_type") == "response"
    return back.select(
        number("record_id").alias("page_id"),
        F.when(read, F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(read, F.sha1("payload")).otherwise(F.regexp_replace("payload_digest", "^sha1:", "")).alias("payload_digest"),
        "record_type",
        number("refers_to").alias("refers_to"),
    )


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS payload_digest, max(page_id) OVER (PARTITION BY html) AS keep FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> keep THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> keep THEN keep END AS refers_to
FROM d
"""
