"""WARC archives: write pages as one gzip stream a file, normalise to a member a record, read through the index.

A *monolithic* archive is one gzip stream over many records, so nothing in it can be read without inflating all
before it. :func:`normalise` inflates each such file once, streaming, rewrites every record as a member of its own
and writes a sidecar index (``<archive>.idx``: offset, length, type, record id) beside the new archive; the same rows
come back as a DataFrame. :func:`read_records` then seeks to single records.

Files go to a folder that all executors see. A task writes under a name of its own, and only the manifest rows of
tasks that succeeded (a written table) name the files that count, so a lost executor leaves at most an orphan.

Defined cases: a null payload is an empty one; a null url gives no target URI; a null page_id is written as ``null``
and read as null; an empty table gives no archive and no rows; repeated rows give repeated records; other columns of
the input are not read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, lean, open_fs, slices

RECORD = "urn:page:"
CHUNK = 1 << 20
MANIFEST = "archive string, n_records long, wave int"
WAVES = 2
INDEX = "archive string, ordinal long, offset long, length long, record_type string, record_id string"
PAGE = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long, length long"


def resolve(pages: DataFrame, scratch: Scratch, min_bytes: int = 1000) -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, refers_to) of (page_id, url, html) rows.

    Of equal payloads of min_bytes or more, the rows with the largest page_id are responses (refers_to null); the
    others refer to it. Digests are grouped with map-side sums. Those that repeat are a written table, whose size Spark
    knows: it is broadcast below Spark's limit, so that no payload moves; above it, the join has an exchange of its own
    on either side, and Spark can split the partition of a digest that a third of all pages share.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string").cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha1("payload")})
    groups = rows.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    groups = scratch.table(groups.select(F.unhex("payload_digest").alias("same"), "first"), "repeated")
    joined = rows.join(groups, (F.unhex("payload_digest") == F.col("same")) & (F.col("payload_bytes") >= min_bytes), "left")
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") < F.col("first")), F.col("first"))
    return joined.select("page_id", "url", "payload", "payload_bytes", "payload_digest", refers.alias("refers_to"))


def make_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """A response record, or a revisit record: headers only, naming the response and the length of its payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{RECORD}{'null' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="".join(map(chr, range(33, 127)))))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{RECORD}{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_monolithic(rows: DataFrame, folder: str, roll_bytes: int = 256 << 20, date: str = "1970-01-01T00:00:00Z", level: int = 6) -> DataFrame:
    """Archives of resolve()'s rows, each one gzip stream of about roll_bytes raw at most; returns their manifest.

    Tasks write to one of WAVES folders, which are normalised and dropped one after the other.
    """

    def write(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, out, squeeze, n, raw = [], None, None, 0, 0
        wave = TaskContext.get().partitionId() % WAVES
        for batch in slices(it):
            for r in batch.to_pylist():
                if out is None:
                    fs, path = open_fs(uri := f"{folder}/{wave}/mono-{uuid.uuid4().hex}.warc.gz")
                    fs.create_dir(path.rpartition("/")[0], recursive=True)
                    out, squeeze, n, raw = fs.open_output_stream(path, compression=None), zlib.compressobj(level, zlib.DEFLATED, 31), 0, 0
                record = make_record(r["page_id"], r["url"], r["payload"], r["payload_digest"], r["refers_to"], date)
                out.write(squeeze.compress(record))
                n, raw = n + 1, raw + len(record)
                if raw >= roll_bytes:
                    out.write(squeeze.flush())
                    out.close()
                    made.append((uri, n))
                    out = None
        if out is not None:
            out.write(squeeze.flush())
            out.close()
            made.append((uri, n))
        if made:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in made]), pa.array([x[1] for x in made], pa.int64()), pa.array([wave] * len(made), pa.int32())], names=["archive", "n_records", "wave"])

    return rows.select("page_id", "url", "payload", "payload_digest", "refers_to").mapInArrow(write, MANIFEST)


def inflate(chunks: Iterable[bytes]) -> Iterator[bytes]:
    """Pieces of at most a MB of one or more gzip members."""
    d = zlib.decompressobj(31)
    for data in chunks:
        while data:
            if d.eof:
                d = zlib.decompressobj(31)
            piece = d.decompress(data, CHUNK)
            data = d.unused_data if d.eof else d.unconsumed_tail
            if piece:
                yield piece
        while not d.eof and (piece := d.decompress(d.unconsumed_tail, CHUNK)):
            yield piece
    if not d.eof:
        raise ValueError("the gzip stream is cut off")


def split_records(pieces: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, whole record) of a WARC stream; holds one record at a time."""
    pieces, buffer = iter(pieces), bytearray()

    def fill(n: int) -> bool:
        while len(buffer) < n:
            piece = next(pieces, None)
            if piece is None:
                return False
            buffer.extend(piece)
        return True

    while fill(1):
        seen = 0
        while (end := buffer.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            seen = len(buffer)
            if not fill(seen + 1):
                raise ValueError("a WARC header is cut off")
        lines = bytes(buffer[:end]).decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record starts with {lines[0][:40]!r}")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = end + 8 + int(head["content-length"])
        if not fill(size):
            raise ValueError("a WARC block is cut off")
        yield head, bytes(buffer[:size])
        del buffer[:size]


def normalise(manifest: DataFrame, folder: str, level: int = 6) -> DataFrame:
    """Rewrite each archive of the manifest with a gzip member a record and a sidecar index; returns the index rows."""
    types = {"archive": pa.string(), "ordinal": pa.int64(), "offset": pa.int64(), "length": pa.int64(), "record_type": pa.string(), "record_id": pa.string()}
    schema = pa.schema(list(types.items()))

    def rewrite(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for source in (x for b in it for x in b.column(0).to_pylist()):
            fs, path = open_fs(source)
            to, to_path = open_fs(uri := f"{folder}/{uuid.uuid4().hex}.warc.gz")
            to.create_dir(to_path.rpartition("/")[0], recursive=True)
            rows, at = [], 0
            with fs.open_input_stream(path, compression=None) as src, to.open_output_stream(to_path, compression=None) as out, to.open_output_stream(to_path + ".idx", compression=None) as idx:
                for i, (head, record) in enumerate(split_records(inflate(iter(lambda: src.read(CHUNK), b"")))):
                    squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
                    member = squeeze.compress(record) + squeeze.flush()
                    out.write(member)
                    row = (uri, i, at, len(member), head["warc-type"], head["warc-record-id"].strip("<>"))
                    idx.write(("\t".join(map(str, row[2:])) + "\n").encode())
                    rows.append(row)
                    at += len(member)
                    if len(rows) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                        rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    files = manifest.select("archive")
    return files.repartition(max(1, files.count())).mapInArrow(rewrite, INDEX)


def read_member(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of the one record in a member."""
    ((head, record),) = split_records(inflate([data]))
    return head, record[record.index(b"\r\n\r\n") + 4 : -4]


def parse_page(data: bytes) -> tuple:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of a member; a response's digest is recomputed."""
    head, block = read_member(data)
    number = lambda v: None if v in (None, "null") else int(v)
    name = lambda k: head[k].strip("<>").removeprefix(RECORD) if k in head else None
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = head["warc-payload-digest"].removeprefix("sha1:")
    if head["warc-type"] == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"the payload of {head['warc-record-id']} differs from its digest or length")
    return number(name("warc-record-id")), size, digest, head["warc-type"], number(name("warc-refers-to"))


def read_records(index: DataFrame) -> DataFrame:
    """A row a record, read at its offset."""
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])

    def read(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows, name, file = [], None, None
            for archive, offset, length in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if archive != name:
                    if file:
                        file.close()
                    fs, path = open_fs(archive)
                    name, file = archive, fs.open_input_file(path)
                file.seek(offset)
                rows.append((*parse_page(file.read(length)), archive, offset, length))
            if file:
                file.close()
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return index.select("archive", "offset", "length").mapInArrow(read, PAGE)


def archive_pages(pages: DataFrame, scratch: Scratch, min_bytes: int = 1000) -> DataFrame:
    """Write all pages, normalise the archives and read them back, a row a page."""
    with lean(pages.sparkSession):
        manifest = scratch.table(write_monolithic(resolve(pages, scratch, min_bytes), scratch.path("mono")), "manifest")
        index = None
        for wave in range(WAVES):
            part = scratch.table(normalise(manifest.where(F.col("wave") == wave), scratch.path("warc")), f"index-{wave}")
            index = part if index is None else index.union(part)
            scratch.drop(f"mono/{wave}")
    return read_records(index)
