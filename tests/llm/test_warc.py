"""WARC archives: round trips, splits, members that look like others, damage, odd rows."""

import base64
import glob
import gzip
import hashlib
import random
import zlib

import pytest

from concordat.llm import warc
from concordat.session import shared_folder

FOLDER = "/root/testdata/sf0.001"
PAGE = "page_id long, url string, html string, payload string, refers_to string, path string"


@pytest.fixture
def small_ranges(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
    spark.conf.set("spark.sql.files.openCostInBytes", old[1])


def plain(pages):
    """What the archives must give back, by brute force."""
    out = []
    for i, _, html, *_ in pages:
        payload = (html or "").encode()
        last = max((j for j, _, other, *_ in pages if j is not None and (other or "").encode() == payload), default=None)
        revisit = last is not None and i != last
        out.append((i, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "revisit" if revisit else "response", last if revisit else None))
    return sorted(out, key=str)


def read(frame):
    return sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in frame.collect()), key=str)


def odd_pages():
    noise = random.Random(5)
    rows = [(1, "http://a/é", "same"), (2, None, "same"), (9, "http://a/ \r\nX: y", "same"), (3, "u", None), (4, "u", ""), (None, "u", "same"), (None, "u", "alone"),
            (5, "u", "twice"), (5, "u", "twice"), (-7, "u", "x\r\n\r\ny"), (6, "u", "WARC/1.1\r\nWARC-Type: response\r\n\r\n"), (8, "u", "x" * 3_000_000)]
    rows += [(100 + i, f"http://b/{i}", "".join(chr(noise.randrange(32, 0x2FFF)) for _ in range(noise.randrange(900)))) for i in range(60)]
    return [(*r, "p", "r", "f") for r in rows]


def test_round_trip_over_small_ranges(spark, small_ranges):
    rows = odd_pages()
    pages = spark.createDataFrame(rows, PAGE)
    folder = warc.write_archives(pages, shared_folder(spark, "warc"))
    back = warc.read_archives(spark, folder)
    assert back.where("problem is not null").isEmpty() and read(back) == plain(rows)
    payloads = {(r["page_id"], r["payload_digest"]): r["payload"] for r in back.collect() if r["record_type"] == "response"}
    assert all(bytes(p) == (html or "").encode() for i, _, html, *_ in rows if (p := payloads.get((i, warc.digest((html or "").encode())))) is not None)
    assert {r["url"] for r in back.where("page_id = 9").collect()} == {"http://a/%20%0D%0AX:%20y"} and back.where("page_id = 2 and url is null").count() == 1
    # any gzip reader takes the files, and finds a record for each row
    files = glob.glob(f"{folder.removeprefix('file:')}/part-*")
    assert sum(gzip.decompress(open(f, "rb").read()).count(b"WARC-Record-ID: ") for f in files) == len(rows)


def test_records_of_16_mb(spark):
    whole = warc.member(b"WARC/1.1 " + bytes(1 << 24)) + warc.SEPARATOR
    assert gzip.decompress(whole) == b"WARC/1.1 " + bytes(1 << 24)
    pages = spark.createDataFrame([(1, "u", "é" * (9 << 20), "", "", ""), (2, "u", "b", "", "", "")], PAGE)
    assert [r[:2] for r in read(warc.archive_pages(pages))] == [(1, 18 << 20), (2, 1)]


def test_no_pages(spark):
    assert warc.archive_pages(spark.createDataFrame([], PAGE)).count() == 0


def stored(content, inside=b""):
    """A gzip member that keeps its content as it is, so that magics inside stay visible."""
    packer = zlib.compressobj(0, zlib.DEFLATED, 31)
    return packer.compress(content) + packer.flush()


def scan(data, cuts):
    """Read one archive as Spark's line reader hands it out, cut at the given byte offsets."""
    places, at = [], data.find(warc.MAGIC)
    while at >= 0:
        places.append(at)
        at = data.find(warc.MAGIC, at + 3)
    rows, parts = [], []
    bounds = [0, *cuts, len(data)]
    for start, end in zip(bounds, bounds[1:]):
        one = warc._Range("f", start)
        out = []
        for place, after in zip(places, [*places[1:], len(data)]):
            if start <= place < end:
                out += one.piece(data[place:after])
        out += one.end()
        rows += [r for r in out if "part" not in r]
        parts += [r for r in out if "part" in r]
    return rows, parts


@pytest.mark.parametrize("seed", range(30))
def test_magics_inside_members(spark, seed):
    noise = random.Random(seed)
    payloads = []
    for i in range(8):
        payload = noise.randbytes(noise.randrange(60))
        for _ in range(noise.randrange(4)):
            payload += noise.choice([warc.MAGIC, warc.MAGIC + b"\x00\x00\x00\x00\x00\x00\x03", gzip.compress(b"no record"), gzip.compress(b"")]) + noise.randbytes(noise.randrange(40))
        payloads.append(payload)
    data = b"".join(stored(warc.record(i, "u", p, None, False, "d")) for i, p in enumerate(payloads))
    rows, parts = scan(data, sorted(noise.sample(range(1, len(data)), 6)))
    import pyarrow as pa

    schema = pa.schema([("path", pa.string()), ("start", pa.int64()), ("place", pa.int64()), ("part", pa.binary())])
    for batch in warc._joined(True)(iter([pa.RecordBatch.from_pylist(sorted(parts, key=lambda r: (r["start"], r["place"])), schema)])):
        rows += batch.to_pylist()
    assert sorted((r["page_id"], r["payload"], r["problem"]) for r in rows) == [(i, p, None) for i, p in enumerate(payloads)]


def test_damaged_records_are_told(spark):
    data = bytearray(stored(warc.record(1, "u", b"a" * 50, None, False, "d")) + stored(warc.record(2, "u", b"b" * 50, None, False, "d")))
    wrong = warc.parse(warc.record(3, "u", b"abc", None, False, "d").replace(b"abc", b"abd"))
    assert wrong["problem"] == "digest" and warc.parse(warc.record(3, "u", b"abc", None, False, "d")[:-6])["problem"] == "length"
    data[60] ^= 255
    rows, _ = scan(bytes(data), [])
    assert [r["problem"] for r in rows if r["page_id"] == 2] == [None] and any(r["problem"] for r in rows)


def test_query_gives_every_page(spark):
    from concordat.llm.queries import QUERIES

    pages = [(r["page_id"], r["url"], r["html"]) for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()]
    assert read(QUERIES["op13_warc"](spark, FOLDER)) == plain(pages)
