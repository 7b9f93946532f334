"""WARC archives as a PySpark data source, with a writer that revisits equal payloads.

Reading: file partitions are planned from the folder's listing (small files
share one).  Predicates on the record type and on header columns are pushed to
the reader; a record's header is parsed first, and a record that a predicate
rejects is passed over by its Content-Length: its block is neither read nor
decoded.  ``option("payload", "false")`` passes over all blocks likewise.

Writing: every task writes files of its own under attempt names, which the
commit renames; a lost or repeated task leaves nothing.  The folder is reached
through ``pyarrow.fs``, so it may be any shared store that pyarrow knows.

Defined cases: a null payload is empty; line breaks in a url are
percent-encoded; a null page_id or url writes no such header and reads as null;
of equal payloads of ``least`` bytes or more the largest page_id is the
response (every row that has it), the others revisit it; null page_ids are
responses; an empty table gives an empty archive; other columns are ignored.
"""

from __future__ import annotations

import base64
import posixpath
import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, WriterCommitMessage,
)

from churnscope.llm.common import shared_path, stage

LEAST = 1000
FILE_BYTES = 64 << 20
PART_BYTES = 32 << 20
BROADCAST_GROUPS = 1_000_000  # repeated payloads up to which their list goes to the pages instead of all payloads shuffled
#: Columns of a record and the headers they come from.
HEADERS = {
    "record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri",
    "refers_to_id": "warc-refers-to", "payload_digest": "warc-payload-digest", "content_type": "content-type",
}
SCHEMA = ", ".join(f"{c} string" for c in HEADERS) + ", sha1 string, payload_bytes bigint, payload binary"


def _open(path: str):
    from pyarrow import fs

    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return fs.FileSystem.from_uri(path)


@dataclass
class Files(InputPartition):
    paths: list

    def __init__(self, paths):
        super().__init__(paths)
        self.paths = paths


def _header(f) -> dict[str, str] | None:
    """Header of the next record, names in lower case; None at the end."""
    line = f.readline()
    while line in (b"\r\n", b"\n"):
        line = f.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"no WARC record: {line[:40]!r}")
    head = {}
    while (line := f.readline()).strip():
        name, _, value = line.decode("utf-8", "replace").partition(":")
        head[name.strip().lower()] = value.strip()
    return head


def _http(block: bytes) -> tuple[int | None, bytes]:
    """Declared length and body of an HTTP message."""
    top, _, body = block.partition(b"\r\n\r\n")
    for line in top.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        if name.strip().lower() == b"content-length":
            return int(value), body
    return None, body


class Reader(DataSourceReader):
    def __init__(self, path: str, payload: bool):
        self.path, self.payload = path, payload
        self.wanted: list[tuple[str, tuple]] = []

    def pushFilters(self, filters):
        for f in filters:
            at = getattr(f, "attribute", ())
            column = at[0] if len(at) == 1 else None
            if isinstance(f, EqualTo) and column in HEADERS:
                self.wanted.append((HEADERS[column], (f.value,)))
            elif isinstance(f, In) and column in HEADERS:
                self.wanted.append((HEADERS[column], tuple(f.value)))
            elif isinstance(f, IsNotNull) and column in HEADERS:
                self.wanted.append((HEADERS[column], ()))
            else:
                yield f

    def partitions(self):
        from pyarrow import fs

        store, root = _open(self.path)
        found = sorted((x.path, x.size) for x in store.get_file_info(fs.FileSelector(root)) if x.is_file and x.path.endswith(".warc"))
        parts, held, size = [], [], 0
        for path, n in found:
            if held and size + n > PART_BYTES:
                parts.append(Files(held))
                held, size = [], 0
            held, size = [*held, path], size + n
        return [*parts, Files(held)] if held or not parts else parts

    def _keeps(self, head: dict[str, str]) -> bool:
        return all(name in head and (not values or head[name] in values) for name, values in self.wanted)

    def read(self, partition):
        store, _ = _open(self.path)
        rows, size = [], 0
        for path in partition.paths:
            with store.open_input_file(path) as f:
                reader = _Lines(f)
                while (head := _header(reader)) is not None:
                    n = int(head["content-length"])
                    if not self._keeps(head):
                        reader.skip(n)
                        continue
                    length = body = None
                    if self.payload:
                        length, body = _http(reader.read(n))
                        if head.get("warc-type") == "revisit":
                            body = None
                        elif length is None:
                            length = len(body)
                    else:
                        reader.skip(n)
                    rows.append([*[head.get(h) for h in HEADERS.values()], _hex(head.get("warc-payload-digest")), length, body])
                    size += n
                    if size > 8 << 20 or len(rows) >= 5000:
                        yield _batch(rows)
                        rows, size = [], 0
        if rows:
            yield _batch(rows)


class _Lines:
    """Buffered reads with line ends over a random-access file; ``skip`` moves without reading."""

    def __init__(self, f, size: int = 1 << 16):
        self.f, self.size, self.held, self.at = f, size, b"", 0

    def readline(self) -> bytes:
        while (i := self.held.find(b"\n", self.at)) < 0:
            more = self.f.read(self.size)
            if not more:
                i = len(self.held) - 1
                break
            self.held, self.at = self.held[self.at :] + more, 0
        out, self.at = self.held[self.at : i + 1], i + 1
        return out

    def read(self, n: int) -> bytes:
        out = self.held[self.at : self.at + n]
        self.at += len(out)
        return out if len(out) == n else out + self.f.read(n - len(out))

    def skip(self, n: int) -> None:
        here = min(n, len(self.held) - self.at)
        self.at += here
        if n > here:
            self.f.seek(self.f.tell() + n - here)


def _hex(digest: str | None) -> str | None:
    """Bare hexadecimal form of a ``sha1:`` digest in base 32."""
    name, _, value = (digest or "").partition(":")
    return base64.b32decode(value).hex() if name == "sha1" and len(value) == 32 else None


def _batch(rows) -> pa.RecordBatch:
    types = [pa.string()] * (len(HEADERS) + 1) + [pa.int64(), pa.binary()]
    names = [*HEADERS, "sha1", "payload_bytes", "payload"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def _id(page) -> str:
    return f"<urn:page:{page}>"


def _record(page, url, kind: str, refers, digest: bytes, size: int, payload: bytes) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http + (payload if kind == "response" else b"")
    head = ["WARC/1.0", f"WARC-Type: {kind}", "WARC-Date: 1970-01-01T00:00:00Z"]
    head += [f"WARC-Record-ID: {_id(page)}"] if page is not None else []
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A").strip())
    if kind == "revisit":
        head += [f"WARC-Refers-To: {_id(refers)}", "WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"]
    head += ["WARC-Payload-Digest: sha1:" + base64.b32encode(digest).decode(), "Content-Type: application/http; msgtype=response"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


@dataclass
class Written(WriterCommitMessage):
    names: list


class Writer(DataSourceArrowWriter):
    """Rows ``page_id, url, record_type, refers_to, digest (binary), payload_bytes, payload`` to files."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator):
        store, root = _open(self.path)
        store.create_dir(root, recursive=True)
        names, out, size = [], None, 0
        for batch in iterator:
            for r in batch.to_pylist():
                if out is None or size > FILE_BYTES:
                    if out:
                        out.close()
                    names.append(uuid.uuid4().hex)
                    out, size = store.open_output_stream(posixpath.join(root, f".{names[-1]}.attempt")), 0
                rec = _record(r["page_id"], r["url"], r["record_type"], r["refers_to"], r["digest"], r["payload_bytes"], r["payload"] or b"")
                out.write(rec)
                size += len(rec)
        if out:
            out.close()
        return Written(names)

    def commit(self, messages):
        store, root = _open(self.path)
        store.create_dir(root, recursive=True)
        for m in messages:
            for n in m.names if m else ():
                store.move(posixpath.join(root, f".{n}.attempt"), posixpath.join(root, f"{n}.warc"))

    def abort(self, messages):
        store, root = _open(self.path)
        for m in messages:
            for n in m.names if m else ():
                store.delete_file(posixpath.join(root, f".{n}.attempt"))


class WarcSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return Reader(self.options["path"], self.options.get("payload", "true").lower() == "true")

    def writer(self, schema, overwrite):
        return Writer(self.options["path"])


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def write_warc(pages: DataFrame, path: str | None = None, least: int = LEAST) -> str:
    """Write one record per row of ``pages(page_id, url, html)``; returns the folder."""
    spark = pages.sparkSession
    path = path or shared_path(spark, "warc")
    spark.dataSource.register(WarcSource)
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", F.sha1(payload).alias("hex"), F.octet_length(payload).cast("long").alias("payload_bytes"),
        payload.alias("payload"),
    )
    firsts = (
        rows.filter((F.col("payload_bytes") >= least) & F.col("page_id").isNotNull())
        .groupBy(F.col("hex").alias("_hex"), F.col("payload_bytes").alias("_n"))
        .agg(F.min("page_id").alias("low"), F.max("page_id").alias("refers_to"))
        .filter("low < refers_to")
        .drop("low")
    )
    firsts = stage(firsts, "repeated")
    if firsts.count() <= BROADCAST_GROUPS:
        firsts = F.broadcast(firsts)
    joined = rows.join(firsts, (F.col("hex") == F.col("_hex")) & (F.col("payload_bytes") == F.col("_n")), "left")
    revisit = F.coalesce(F.col("refers_to") > F.col("page_id"), F.lit(False))
    joined.select(
        "page_id", "url", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("refers_to")).alias("refers_to"),
        F.unhex("hex").alias("digest"), "payload_bytes", F.when(~revisit, F.col("payload")).alias("payload"),
    ).write.format("warc").mode("append").save(path)
    return path


def page_of(record_id):
    return F.regexp_extract(record_id, "^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")
