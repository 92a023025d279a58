"""WARC archives: write captures, read them back, assemble transactions.

Every page becomes a request, a response or revisit, and a metadata record, each its own gzip
member; the first and the last name the second in WARC-Concurrent-To. Reading parses the members one by
one, and `assemble` joins the records of a transaction through those identifiers into one nested row
per capture (a group of a few records, never of equal payloads).

Of records with equal payloads (SHA-256 and length) of at least `least` bytes, the one with the
smallest page_id is the response, the others are revisits that refer to it; the smallest id is a partial
aggregate, and its join back is split by adaptive execution where one payload is very common.

Archives are written by the tasks straight to the given folder, which must be shared; a file counts
only if its successful task reported it, so that lost or repeated tasks leave nothing that is read.

Defined cases: null html is an empty payload; a null url has no target URI; rows with the id of a
response and its payload are all responses; a null page_id is the largest; an empty table
gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.common import apart, bounded_batches, cut, shared_dir

#: An archive is closed once it has so many bytes.
ARCHIVE_BYTES = 32 << 20
#: Bytes fed to the decompressor at once.
WINDOW = 8192
DATE = "2024-01-01T00:00:00Z"
_URN = "urn:weft:page:"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, ident: str, fields: dict[str, str | None], block: bytes) -> bytes:
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<{ident}>", "WARC-Date": DATE, **fields, "Content-Length": str(len(block))}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def transaction(page_id: int | None, copy: str, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> list[bytes]:
    uri = None if url is None else quote(url, safe="%/:=&?~#+!$,;'@()*[]")
    ident, sha1 = f"{_URN}{page_id}?copy={copy}", digest(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    both = {"WARC-Target-URI": uri, "WARC-Payload-Digest": f"sha1:{sha1}", "Content-Type": "application/http; msgtype=response"}
    if revisit:
        both |= {"WARC-Refers-To": f"<{_URN}{refers_to}>", "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
    link = {"WARC-Concurrent-To": f"<{ident}>", "WARC-Target-URI": uri}
    ask = f"GET {uri or '/'} HTTP/1.1\r\n\r\n".encode()
    return [
        record("request", f"{ident}&part=request", link | {"Content-Type": "application/http; msgtype=request"}, ask),
        record("revisit" if revisit else "response", ident, both, http if revisit else http + payload),
        record("metadata", f"{ident}&part=metadata", link | {"Content-Type": "application/warc-fields"}, f"pageId: {page_id}\r\n".encode()),
    ]


def member(data: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _writer(folder: str, most: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(folder)
        part, n, buffer, held = TaskContext.get().partitionId(), 0, [], 0

        def close() -> pa.RecordBatch:
            name = f"{part:06d}-{uuid.uuid4().hex}.warc.gz"
            with files.open_output_stream(f"{root}/{name}", compression=None) as out:
                for x in buffer:
                    out.write(x)
            return pa.RecordBatch.from_pydict({"archive": [name], "n_records": pa.array([len(buffer)], pa.int64())})

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                page_id, url, html, refers_to, revisit = row
                for x in transaction(page_id, f"{part}.{n}", url, (html or "").encode(), refers_to, bool(revisit)):
                    buffer.append(z := member(x))
                    held += len(z)
                n += 1
                if held >= most:
                    yield close()
                    buffer, held = [], 0
        if buffer:
            yield close()

    return write


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the archives of pages to folder (a URI that all machines share); returns archive, n_records."""
    spark = pages.sparkSession
    bounded_batches(spark)
    from pyarrow import fs

    files, root = fs.FileSystem.from_uri(folder)
    files.create_dir(root, recursive=True)
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    key = [F.sha2("html", 256).alias("sha"), F.octet_length("html").alias("len")]
    firsts = rows.groupBy(*key).agg(F.min("page_id").alias("first_id")).filter(F.col("len") >= least)
    marked = rows.select("*", *key).join(apart(firsts), ["sha", "len"], "left")
    again = F.col("len").__ge__(least) & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    marked = marked.select("page_id", "url", "html", F.when(again, F.col("first_id")).alias("refers_to"), again.alias("revisit"))
    return cut(marked.mapInArrow(_writer(folder, archive_bytes), "archive string, n_records long"), "warc-manifest")


_RECORDS = "capture string, record_id string, kind string, uri string, payload_digest string, payload_bytes long, refers_to string, body binary"
_HEADER = re.compile(rb"([^:\r\n]+): *([^\r\n]*)\r\n")


def parse_members(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and block of each record; one member is unpacked at a time."""
    view, at = memoryview(data), 0
    while at < len(view):
        z, parts = zlib.decompressobj(31), []
        while not z.eof:  # what lies behind a member is copied, so it is fed in small windows
            window = view[at : at + WINDOW]
            if not len(window):
                raise ValueError("archive ends within a member")
            parts.append(z.decompress(window))
            at += len(window) - len(z.unused_data)
        raw = b"".join(parts)
        cut_at = raw.index(b"\r\n\r\n")
        fields = {k.decode().lower(): v.decode() for k, v in _HEADER.findall(raw[: cut_at + 2])}
        begin = cut_at + 4
        yield fields, raw[begin : begin + int(fields["content-length"])]


def _reader(folder: str, bodies: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(folder)
        names = [x.split()[0] for x in _RECORDS.split(", ")]
        types = [pa.int64() if x == "payload_bytes" else pa.binary() if x == "body" else pa.string() for x in names]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        for b in batches:
            for name in b.column("archive").to_pylist():
                rows, held = [], 0
                with files.open_input_file(f"{root}/{name}") as archive:
                    content = archive.read_buffer()  # an archive is closed once it has ARCHIVE_BYTES
                for f, block in parse_members(content):
                    kind, ident = f["warc-type"], f["warc-record-id"].strip("<>")
                    sha1, size, body = None, None, block
                    if kind in ("response", "revisit"):
                        end = block.index(b"\r\n\r\n") + 4
                        http = {k.lower(): v for k, v in _HEADER.findall(block[:end])}
                        body = block[end:]
                        size = int(http[b"content-length"])
                        sha1 = f["warc-payload-digest"].removeprefix("sha1:")
                        if kind == "response" and (len(body) != size or digest(body) != sha1):
                            raise ValueError(f"payload of {ident} differs from its digest")
                    rows.append((f.get("warc-concurrent-to", ident).strip("<>"), ident, kind, f.get("warc-target-uri"), sha1, size, f.get("warc-refers-to", "").strip("<>") or None, body if bodies else None))
                    held += len(body) if bodies else 200
                    if held > 4 << 20:
                        yield batch(rows)
                        rows, held = [], 0
                if rows:
                    yield batch(rows)

    return read


def read_archives(spark: SparkSession, folder: str, manifest: DataFrame, bodies: bool = True) -> DataFrame:
    """A row per record of the archives that manifest names: names are dealt out, and a task reads its archives itself."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("archive").repartition(n).mapInArrow(_reader(folder, bodies), _RECORDS)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: its request, its response or revisit, its metadata."""
    part = F.struct("record_id", "kind", "uri", "payload_digest", "payload_bytes", "refers_to", "body")
    of = lambda *kinds: F.max(F.when(F.col("kind").isin(*kinds), part))  # noqa: E731  one of each in a capture
    return records.groupBy("capture").agg(of("request").alias("request"), of("response", "revisit").alias("response"), of("metadata").alias("metadata"))


def page_of(ident):
    """The page_id in an identifier of ours."""
    return F.expr(f"try_cast(regexp_extract({ident}, '^{_URN}(-?[0-9]+)', 1) as bigint)")


def qualified(spark: SparkSession, folder: str) -> str:
    """folder as a URI; without a scheme it lies on the cluster's default file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    uri = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return re.sub("^file:/+", "file:///", uri)


def archived_pages(pages: DataFrame, folder: str | None = None, least: int = 0, **columns) -> DataFrame:
    """Write, read back, assemble: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    folder = folder or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    folder = qualified(spark, folder)
    manifest = write_archives(pages, folder, least=least, **columns)
    if manifest.isEmpty():
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    captures = assemble(read_archives(spark, folder, manifest, bodies=False))
    return captures.select(
        page_of("capture").alias("page_id"),
        F.col("response.payload_bytes").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.kind").alias("record_type"),
        page_of("response.refers_to").alias("refers_to"),
    )
