"""WARC archives: writing, and normalising monolithic gzip files.

A *monolithic* archive is one gzip stream over all its records, so nothing in it can be read without
inflating all before. The normaliser inflates each file once, as a stream, writes every record as a gzip
member of its own, and a sidecar index of their offsets, by which a record is read alone.

Files are reached by pyarrow's file systems under their URI, so that executors write to the folder that
they share. A task names its file by a fresh id and reports the name in its rows: what a lost or repeated
attempt leaves behind is in no report and is read by nobody.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.llm.common import cut, shared_dir, shuffle_partitions

#: Equal payloads of at least so many bytes are stored once.
LEAST_SHARED = 1000
_CHUNK = 1 << 20
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
INDEX_SCHEMA = "file string, offset long, stored long, page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string"


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if re.match(r"\w+:", uri) else f"file://{uri}")


def duplicates(pages: DataFrame, *, id_col: str = "page_id", payload_col: str = "html", least: int = LEAST_SHARED) -> DataFrame:
    """``pages`` with payload_bytes, payload_digest (SHA-1) and refers_to: of records with equal payloads of at
    least ``least`` bytes, all but the one with the largest id refer to that one.

    Ids and digests alone are shuffled to find them. Null payloads are empty. Rows are told apart by id and digest, so that an
    id that repeats with another payload keeps both; of large equal rows that share the largest id each is a response.
    Null ids refer to others, none refers to them."""
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    sized = pages.withColumns({"payload_bytes": F.octet_length(payload).cast("long"), "payload_digest": F.sha1(payload)})
    large = sized.where(F.col("payload_bytes") >= least).select(F.col(id_col).alias("__id"), F.col("payload_digest").alias("__d"))
    heads = large.groupBy("__d").agg(F.max("__id").alias("refers_to"), F.count(F.lit(1)).alias("__n")).where("__n > 1").drop("__n")
    others = large.join(heads, "__d").where("__id is null or __id <> refers_to").groupBy("__id", "__d").agg(F.max("refers_to").alias("refers_to"))
    return sized.join(others, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("payload_digest") == F.col("__d")), "left").drop("__id", "__d")


def record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC record, not compressed. A revisit has the payload's digest and length, not the payload."""
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or f"urn:page:{page_id}")
    http = _HTTP + b"Content-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, the record's bytes) of inflated WARC data that comes in chunks; holds one record at a time."""
    buffer = bytearray()
    for chunk in chunks:
        buffer += chunk
        while (end := buffer.find(b"\r\n\r\n")) >= 0:
            headers = _headers(bytes(buffer[:end]))
            size = end + 4 + int(headers["content-length"]) + 4
            if len(buffer) < size:
                break
            yield headers, bytes(buffer[:size])
            del buffer[:size]
    if buffer.strip():
        raise ValueError(f"the archive ends inside a record, after {len(buffer)} bytes of it")


def _headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record begins here: {lines[0][:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def inflate(source) -> Iterator[bytes]:
    """The data of gzip members, one or many, in chunks."""
    z = zlib.decompressobj(31)
    while piece := source.read(_CHUNK):
        while piece:
            yield z.decompress(piece)
            piece = z.unused_data
            if z.eof:
                z = zlib.decompressobj(31)


def describe(headers: dict[str, str], data: bytes) -> tuple:
    """(page_id, record type, refers to, payload bytes, payload digest) as the record itself says; a response's payload is measured."""
    number = lambda name: None if (m := re.search(r"urn:page:(-?\d+)", headers.get(name, ""))) is None else int(m[1])
    block = data[data.index(b"\r\n\r\n") + 4 : -4]
    http, _, payload = block.partition(b"\r\n\r\n")
    kind = headers["warc-type"]
    if kind == "revisit":
        size, digest = int(re.search(rb"(?i)content-length: *(\d+)", http)[1]), headers["warc-payload-digest"].partition(":")[2]
    else:
        size, digest = len(payload), hashlib.sha1(payload).hexdigest()
    return number("warc-record-id"), kind, number("warc-refers-to"), size, digest


def write_monolithic(pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write each partition of ``duplicates``' rows as one gzip stream; (file, n) of the files, at a checkpoint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _filesystem(folder)
        name, n, z, out = f"{uuid.uuid4().hex}.warc.gz", 0, zlib.compressobj(1, zlib.DEFLATED, 31), None
        for b in batches:
            for page, url, html, digest, to in zip(*(b.column(i) for i in range(5)), strict=True):
                out = out or fs.open_output_stream(f"{root}/{name}", compression=None)
                out.write(z.compress(record(page.as_py(), url.as_py(), (html.as_py() or "").encode(), digest.as_py(), to.as_py())))
                n += 1
        if out:
            out.write(z.flush())
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([n], pa.int64())], ["file", "n"])

    _filesystem(folder)[0].create_dir(_filesystem(folder)[1], recursive=True)
    return cut(pages.select(id_col, url_col, payload_col, "payload_digest", "refers_to").mapInArrow(run, "file string, n long"))


def normalise(files: DataFrame, folder: str, *, level: int = 6, keep_source: bool = True) -> DataFrame:
    """Rewrite each archive of ``files`` (file) with a gzip member a record; the index, at a checkpoint.

    Beside each new archive stands its index as text (``.idx``: offset, bytes, type, id and digest a line).
    A task streams one archive and holds one record. ``keep_source`` false removes an archive when it has been rewritten
    (a task that is run again after that fails to find it, so leave it true unless space is short)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _filesystem(folder)
        for file in (f.as_py() for b in batches for f in b.column(0)):
            source_fs, source = _filesystem(file)
            name, offset, rows = uuid.uuid4().hex, 0, []
            with source_fs.open_input_stream(source, compression=None) as data, fs.open_output_stream(f"{root}/{name}.warc.gz", compression=None) as out, fs.open_output_stream(f"{root}/{name}.idx") as index:
                for headers, whole in records(inflate(data)):
                    z = zlib.compressobj(level, zlib.DEFLATED, 31)
                    member = z.compress(whole) + z.flush()
                    out.write(member)
                    row = (f"{folder}/{name}.warc.gz", offset, len(member), *describe(headers, whole))
                    index.write(("\t".join(map(str, (row[1], row[2], row[4], row[3], row[7]))) + "\n").encode())
                    rows.append(row)
                    offset += len(member)
                    if len(rows) == 4096:
                        yield _rows(rows)
                        rows = []
            if rows:
                yield _rows(rows)
            if not keep_source:
                source_fs.delete_file(source)

    _filesystem(folder)[0].create_dir(_filesystem(folder)[1], recursive=True)
    return cut(files.select("file").repartition(shuffle_partitions(files.sparkSession) * 2, "file").mapInArrow(run, INDEX_SCHEMA))


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in INDEX_SCHEMA.split(", ")])


def read_by_index(index: DataFrame) -> DataFrame:
    """Read each record of an index (file, offset, stored) alone, from its member; what the records say, and their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, source = None, None
        for b in batches:
            out = []
            for file, offset, stored in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if file != held:
                    if source:
                        source.close()
                    fs, path = _filesystem(file)
                    held, source = file, fs.open_input_file(path)
                whole = zlib.decompress(source.read_at(stored, offset), 31)
                headers, data = next(records(iter([whole])))
                out.append((file, offset, stored, *describe(headers, data)))
            if out:
                yield _rows(out)
        if source:
            source.close()

    return index.select("file", "offset", "stored").mapInArrow(run, INDEX_SCHEMA)


def op1_warc(pages: DataFrame) -> DataFrame:
    """The contract's columns, read back from the normalised archives. An empty table makes no archive and gives no rows."""
    spark: SparkSession = pages.sparkSession
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    files = write_monolithic(duplicates(pages.select("page_id", "url", "html")), f"{folder}/monolithic")
    index = normalise(files, f"{folder}/records")
    return read_by_index(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
