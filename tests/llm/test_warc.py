import gzip
import hashlib

import pytest

from stratalake.llm import warc
from stratalake.llm.common import Scratch, open_fs

SCHEMA = "page_id long, url string, html string, payload int"


@pytest.fixture(scope="module")
def pages(spark):
    big, other = "é" * 600, "x" * 1000
    rows = [(1, "http://a/\r\nb", big, 0), (2, None, big, 0), (3, "u", "small", 0), (4, "u", "small", 0), (5, "u", None, 0), (6, "u", "", 0), (7, "u", big, 0), (7, "u", big, 0), (None, "u", big, 0), (8, "u", other, 0), (None, "u", None, 0), (9, "u", "\r\n\r\nWARC/1.1\r\n\r\n" * 5000, 0)]
    return spark.createDataFrame(rows, SCHEMA), rows


def test_round_trip(spark, pages):
    df, rows = pages
    got = sorted(map(tuple, warc.archive_pages(df, Scratch(spark, "t")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)
    want = []
    for page_id, _, html, _ in rows:
        data = (html or "").encode()
        last = max((r[0] for r in rows if (r[2] or "").encode() == data and r[0] is not None), default=None) if len(data) >= 1000 else None
        refers = last if last is not None and (page_id is None or page_id < last) else None
        want.append((page_id, len(data), hashlib.sha1(data).hexdigest(), "response" if refers is None else "revisit", refers))
    assert got == sorted(want, key=str)


def test_members_and_sidecar(spark, pages):
    scratch = Scratch(spark, "t")
    manifest = scratch.table(warc.write_monolithic(warc.resolve(pages[0], scratch), scratch.path("mono"), roll_bytes=2000), "manifest")
    assert manifest.count() > 1
    index = scratch.table(warc.normalise(manifest, scratch.path("warc")), "index").collect()
    assert len(index) == 12
    for r in index:
        fs, path = open_fs(r.archive)
        with fs.open_input_file(path) as f:
            f.seek(r.offset)
            assert gzip.decompress(f.read(r.length)).startswith(b"WARC/1.1\r\n")
        with fs.open_input_stream(path + ".idx", compression=None) as f:
            assert f"{r.offset}\t{r.length}\t{r.record_type}\t{r.record_id}" in f.read().decode()


def test_several_members_and_cut_streams():
    record = warc.make_record(1, "u", b"abc", hashlib.sha1(b"abc").hexdigest(), None, "1970-01-01T00:00:00Z")
    data = gzip.compress(record) + gzip.compress(record * 2)
    assert [r for _, r in warc.split_records(warc.inflate([data[:7], data[7:]]))] == [record] * 3
    with pytest.raises(ValueError, match="cut off"):
        list(warc.split_records(warc.inflate([data[:-20]])))


def test_empty_table(spark):
    out = warc.archive_pages(spark.createDataFrame([], SCHEMA), Scratch(spark, "t"))
    assert out.count() == 0


def test_payloads_of_several_megabytes(spark):
    texts = ["".join(chr(97 + (i * i * k) % 26) for i in range(3_000_000)) for k in (1, 3)]
    df = spark.createDataFrame([(1, "u", texts[0]), (2, "v", texts[1]), (3, "w", texts[0])], "page_id long, url string, html string")
    got = sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archive_pages(df, Scratch(spark, "t")).collect())
    digests = [hashlib.sha1(t.encode()).hexdigest() for t in texts]
    assert got == [(1, 3_000_000, digests[0], "revisit", 3), (2, 3_000_000, digests[1], "response", None), (3, 3_000_000, digests[0], "response", None)]
