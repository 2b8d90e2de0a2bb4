"""WARC archives with revisit resolution.

Headers (page, digest, length) are shuffled by payload digest; the least page of a digest
is its response and the other pages are joined to it as revisits. Archives are then written
with fresh headers, one gzip member a record, so that a revisit carries no payload, and
read back record by record. Each task writes its own files under a name of its partition
and attempt; the manifest of the files that count is itself written to the shared folder
before anything reads it, so a lost executor or a second attempt leaves no trace.

Edge cases: a null payload counts as empty; payloads below ``min_bytes`` are all responses;
repeated rows of the least page of a digest are all responses; a row without a page id is a
revisit where a numbered page has its payload, and a response otherwise. An empty table
writes no archive and gives an empty result; columns other than the three are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidebar.llm.common import fresh_folder, saved

MIN_BYTES = 100
# a file is closed beyond this, so that reading has tasks of bounded size
FILE_BYTES = 16 << 20
# fixed: the date of each record, so that equal input gives equal archives
DATE = "2000-01-01T00:00:00Z"
_READ = 1 << 20


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a folder's address; plain paths are local."""
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def resolve(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """(page_id, digest, refers_to) of each page that revisits another; payloads don't move."""
    heads = pages.select("page_id", "digest", "length").where(F.col("length") >= min_bytes)
    firsts = heads.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("copies")).where("copies > 1 and refers_to is not null").drop("copies")
    return heads.join(firsts, "digest").where("page_id is null or page_id <> refers_to").select("page_id", "digest", "refers_to").distinct()


def _header(page: int | None, url: str | None, kind: str, digest: str, length: int, body: int, refers: int | None) -> bytes:
    clean = "".join(c for c in url or "" if c not in "\r\n")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page is None else page}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {clean}", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {length}"]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers}>"]
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {body}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode("utf-8", "surrogatepass")


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        fs, root = open_folder(folder)
        sink, path, size, records, number = None, "", 0, 0, 0

        def entry() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"path": [path], "bytes": [size], "records": [records]})

        for batch in batches:
            for page, url, html, digest, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                payload = (html or "").encode("utf-8", "surrogatepass")
                body = payload if refers is None else b""
                kind = "response" if refers is None else "revisit"
                deflate = zlib.compressobj(1, zlib.DEFLATED, 31)
                member = deflate.compress(_header(page, url, kind, digest, len(payload), len(body), refers) + body + b"\r\n\r\n") + deflate.flush()
                if sink is None:
                    path, size, records = f"{root}/part-{task.partitionId():06d}-{task.taskAttemptId()}-{number:04d}.warc.gz", 0, 0
                    sink = fs.open_output_stream(path, compression=None)
                    number += 1
                sink.write(member)
                size, records = size + len(member), records + 1
                if size >= FILE_BYTES:
                    sink.close()
                    sink = None
                    yield entry()
        if sink is not None:
            sink.close()
            yield entry()

    return run


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write (page_id, url, html, digest, refers_to) rows; the manifest (path, bytes, records)."""
    fs, root = open_folder(folder)
    fs.create_dir(root, recursive=True)
    rows = pages.select("page_id", "url", "html", "digest", "refers_to")
    return saved(rows.mapInArrow(_writer(folder), "path string, bytes long, records long"))


def _members(stream) -> Iterator[bytes]:
    """The gzip members of a stream, one record each."""
    inflate, out = zlib.decompressobj(31), []
    while data := stream.read(_READ):
        while data:
            out.append(inflate.decompress(data))
            data = b""
            if inflate.eof:
                yield b"".join(out)
                data, inflate, out = inflate.unused_data, zlib.decompressobj(31), []
    if any(out):
        raise ValueError("the archive ends inside a record")


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers by lower-case name and the payload of a record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    return fields, rest[: int(fields["content-length"])]


def _number(urn: str | None) -> int | None:
    digits = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def _reader(folder: str, payloads: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = open_folder(folder)
        names = ["page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to", "payload"]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]

        def packed(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, held = [], 0
                with fs.open_input_stream(path, compression=None) as stream:
                    for record in _members(stream):
                        f, body = parse_record(record)
                        kind, digest = f["warc-type"], f["warc-payload-digest"].removeprefix("sha256:")
                        if kind == "response" and hashlib.sha256(body).hexdigest() != digest:
                            raise ValueError(f"{path}: the payload of {f['warc-record-id']} doesn't match its digest")
                        length = len(body) if kind == "response" else int(f["x-payload-length"])
                        rows.append((_number(f["warc-record-id"]), f["warc-target-uri"], kind, digest, length, _number(f.get("warc-refers-to")), body if payloads else None))
                        held += len(body) if payloads else 200
                        if held > 4 << 20:
                            yield packed(rows)
                            rows, held = [], 0
                if rows:
                    yield packed(rows)

    return run


def read_archives(manifest: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """One row per record of the archives that a manifest names; response payloads are checked against their digests."""
    tasks = max(1, manifest.count())
    paths = manifest.select("path").repartition(min(tasks, 10_000), "path")
    return paths.mapInArrow(_reader(folder, payloads), "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary")


def archive(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = MIN_BYTES) -> DataFrame:
    """Write deduplicated archives of the pages and read them back; one row per page without payloads."""
    folder = folder or fresh_folder(pages.sparkSession, "warc")
    html = F.coalesce(F.col(html_col), F.lit(""))
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), html.alias("html"), F.sha2(html, 256).alias("digest"), F.octet_length(html).cast("long").alias("length"))
    refs = resolve(own, min_bytes).toDF("ref_page", "ref_digest", "refers_to")
    same = F.col("page_id").eqNullSafe(F.col("ref_page")) & (F.col("digest") == F.col("ref_digest"))
    placed = own.join(refs, same, "left").drop("ref_page", "ref_digest")
    return read_archives(write_archives(placed, folder), folder, payloads=False).drop("payload")
