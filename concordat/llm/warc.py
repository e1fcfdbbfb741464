"""WARC archives: written one gzip member a record, and read back by splits.

Writing.  Every row becomes one record (``response`` with its payload, or ``revisit`` of the
record that holds the same payload), every record one gzip member, and a task's members follow each
other in one file, so any WARC tool reads the files.  Spark's text writer puts them there, in
whatever store it reaches and by its commit protocol: a member ends with the length of its content,
whose last byte is 0 below 16 MB, and just that byte is the writer's line separator.  Longer records
are followed by an empty member.

Reading.  Spark cuts the files into byte ranges; its line reader looks for the gzip magic (the
separator it is given), and a task owns what starts in its range, to its end.  Each candidate is
tried by decoding its head: a gzip header, and ``WARC/`` as the first bytes it unpacks to.  Bytes
that only look like the magic, inside a member, fail that test (or find the member before them
unfinished) and are put back where they belong; where such a member runs into the next range, its
parts are met by file in a second, small step.  Memory is bounded by one batch and one record.

Repeated rows and ties: rows that share payload and page_id are all responses.  Null html is an
empty payload, a null url leaves the header out, a null page_id gives a record without number that
revisits whatever numbered record has its payload.  Damaged records keep a row, which says so in ``problem``.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concordat.llm.common import importable, text_blocks
from concordat.session import settle, shared_folder

MAGIC = b"\x1f\x8b\x08"
SEPARATOR = b"\x00"
_HEAD = b"WARC/"
PAGE = "urn:x-page:"
RECORD = ("page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, "
          "payload binary, problem string")
_SCANNED = f"{RECORD}, path string, start long, place long, part binary"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _number(name: str | None) -> int | None:
    """The page_id in a record's name; none if it has none."""
    text = (name or "").strip("<>").removeprefix(PAGE)
    return int(text) if re.fullmatch(r"-?[0-9]+", text) else None


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One WARC record, unpacked.  Control characters of a url are written as %XX, since a header is one line."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{PAGE}{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub("[\x00-\x20\x7f]", lambda c: f"%{ord(c[0]):02X}", url))
    head.append(f"WARC-Payload-Digest: sha1:{digest(payload)}")
    if revisit:
        head += [f"WARC-Refers-To: <{PAGE}{refers_to}>", f"WARC-Profile: {_REVISIT}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _packed(content: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(content) + packer.flush()


def member(content: bytes) -> bytes:
    """A record as gzip, without the last byte, which the text writer adds."""
    packed = _packed(content)
    return (packed if packed.endswith(SEPARATOR) else packed + _packed(b""))[: -len(SEPARATOR)]


def with_record_types(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, revisit, refers_to): of equal payloads, the largest page_id is the response.

    Only keys that occur more than once are looked up, and once each, so a payload that a third of the
    rows share is split among tasks.
    """
    rows = pages.select("page_id", "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("content", F.unhex(F.sha2("payload", 256)))
    shared = rows.groupBy(F.col("content").alias("of")).agg(F.max("page_id").alias("last_id"), F.count("*").alias("copies"))
    both = rows.join(shared.where("copies > 1 and last_id is not null"), F.col("content") == F.col("of"), "left")
    revisit = F.coalesce(~F.col("page_id").eqNullSafe(F.col("last_id")) & F.col("last_id").isNotNull(), F.lit(False))
    return both.select("page_id", "url", "payload", revisit.alias("revisit"), F.when(revisit, F.col("last_id")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z") -> str:
    """A record for every row of pages (page_id, url, html) in archives below folder, which must be new."""
    importable(pages.sparkSession)

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, "payload"):
            made = [member(record(r["page_id"], r["url"], r["payload"], r["refers_to"], r["revisit"], date)) for r in block.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], ["member"])

    packed = with_record_types(pages).mapInArrow(members, "member binary")
    lines = packed.select(F.col("member").cast("string").alias("value"))  # the bytes stay as they are
    lines.write.option("lineSep", SEPARATOR.decode("latin-1")).option("compression", "none").text(folder)
    return folder


def parse(content: bytes, problem: str | None = None) -> dict:
    """The row of one unpacked record."""
    head, _, rest = content.partition(b"\r\n\r\n")
    named = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.decode("utf-8", "replace").partition(":")
        named[name.strip().lower()] = value.strip()
    size = named.get("content-length", "")
    block = rest[: int(size)] if size.isdigit() else rest
    if problem is None and (not size.isdigit() or len(block) != int(size)):
        problem = "length"
    kind, said = named.get("warc-type"), named.get("warc-payload-digest", "").removeprefix("sha1:") or None
    payload, length = block, len(block)
    if named.get("content-type", "").startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
        stated = re.search(rb"(?im)^content-length:[ \t]*([0-9]+)", http)
        length = int(stated[1]) if kind == "revisit" and stated else len(payload)
    own = said
    if kind != "revisit":
        own = digest(payload)
        if problem is None and said is not None and said != own:
            problem = "digest"
    return {
        "page_id": _number(named.get("warc-record-id")), "url": named.get("warc-target-uri"), "record_type": kind,
        "refers_to": _number(named.get("warc-refers-to")), "payload_bytes": length, "payload_digest": own,
        "payload": None if kind == "revisit" else payload, "problem": problem,
    }


@dataclass
class _Open:
    """A member whose end has not come yet."""

    unpacker: object = field(default_factory=lambda: zlib.decompressobj(31))
    content: list[bytes] = field(default_factory=list)
    packed: list[bytes] = field(default_factory=list)

    broken: bool = False

    def feed(self, more: bytes) -> bool:
        """Whether the member goes on with these bytes; its first content must be a record's."""
        rest = more
        try:
            if not self.content:
                first = self.unpacker.decompress(more, 16)
                if first[:5] != _HEAD[: len(first)]:
                    return False
                if first:
                    self.content.append(first)
                rest = self.unpacker.unconsumed_tail
            self.content += filter(None, [self.unpacker.decompress(rest)])
        except zlib.error:
            self.broken = True
            return False
        self.packed.append(more)
        return True


def _candidate(packed: bytes) -> _Open | None:
    """A member that starts here, unless its header does not decode or it unpacks to something else."""
    opened = _Open()
    return opened if opened.feed(packed) or opened.content else None


class _Range:
    """Members of one byte range, from the pieces between magics in their order.

    ``found`` yields parsed rows; what only the ranges beside it can complete comes as parts: pieces
    before the first member that starts here, and a last member that has not ended.
    """

    def __init__(self, path: str, start: int):
        self.path, self.start, self.place, self.open, self.leading = path, start, 0, None, True

    def part(self, packed: bytes) -> dict:
        return {"path": self.path, "start": self.start, "place": self.place, "part": packed}

    def _ended(self) -> Iterator[dict]:
        """A member that is complete.  An empty one may also be bytes inside the last member of the range before."""
        self.leading &= not self.open.content
        if self.open.broken:
            yield parse(b"".join(self.open.content), "damaged")
            self.open = None
        elif self.open.unpacker.eof:
            if self.open.content:
                yield parse(b"".join(self.open.content))
            elif self.leading:
                yield self.part(b"".join(self.open.packed))
            self.open = None

    def piece(self, packed: bytes) -> Iterator[dict]:
        self.place += 1
        begun = None if self.open is not None and self.open.content else _candidate(packed)
        if self.open is not None:
            # a true member shows its record's head before anything in it can look like another member
            if not (begun is not None and begun.content) and self.open.feed(packed):
                yield from self._ended()
                return
            if self.open.content:
                yield parse(b"".join(self.open.content), "damaged")
                begun = _candidate(packed)
            elif self.leading:
                yield self.part(b"".join(self.open.packed))
                self.place += 1
        self.open = begun
        if begun is not None:
            yield from self._ended()
        elif self.leading:
            yield self.part(packed)

    def end(self) -> Iterator[dict]:
        if self.open is not None:
            self.place += 1
            yield self.part(b"".join(self.open.packed))


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema)


_TYPES = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def _arrow(fields: str) -> pa.Schema:
    return pa.schema([(n, _TYPES[t]) for n, t in (f.split() for f in fields.split(", "))])


def _scan(keep_payload: bool):
    schema = _arrow(_SCANNED)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current = None
        for block in text_blocks(batches, "piece"):
            rows = []
            for path, start, piece in zip(*(block.column(c).to_pylist() for c in ("path", "start", "piece"))):
                if current is None or (current.path, current.start) != (path, start):
                    if current is not None:
                        rows += current.end()
                    current = _Range(path, start)
                    if start == 0:
                        continue  # what stands before a file's first magic
                rows += current.piece(MAGIC + piece)
            if not keep_payload:
                for row in rows:
                    row.pop("payload", None)
            yield _batch(rows, schema)
        if current is not None:
            yield _batch(list(current.end()), schema)

    return scan


def _joined(keep_payload: bool):
    schema = _arrow(RECORD)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Parts of members that run over several ranges, a file's parts in their order."""
        path = opened = None

        def closed(problem: str | None) -> list[dict]:
            if not opened.content:
                return []
            row = parse(b"".join(opened.content), problem)
            return [row if keep_payload else {k: v for k, v in row.items() if k != "payload"}]

        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                if opened is not None and (row["path"] != path or not opened.feed(row["part"])):
                    rows += closed("damaged")
                    opened = None
                elif opened is not None:
                    if opened.unpacker.eof:
                        rows += closed(None)
                        opened = None
                    continue
                path, opened = row["path"], _candidate(row["part"])
                if opened is not None and opened.unpacker.eof:
                    opened = None
            yield _batch(rows, schema)
        if opened is not None:
            yield _batch(closed("damaged"), schema)

    return joined


def read_archives(spark: SparkSession, folder: str, keep_payload: bool = True) -> DataFrame:
    """The records of all archives below folder: page_id, url, record_type, refers_to, payload and its size and digest, problem.

    A revisit has the size and digest of the payload it stands for, and no payload.  ``problem`` is
    null for sound records, else ``damaged``, ``length`` or ``digest``.
    """
    importable(spark)
    lines = spark.read.option("lineSep", MAGIC.decode("latin-1")).option("encoding", "ISO-8859-1").text(folder)
    pieces = lines.select("_metadata.file_path", "_metadata.file_block_start", F.col("value").cast("binary")).toDF("path", "start", "piece")
    scanned = settle(pieces.mapInArrow(_scan(keep_payload), _SCANNED), "records")
    whole = scanned.where("part is null").drop("path", "start", "place", "part")
    parts = scanned.where("part is not null").select("path", "start", "place", "part")
    met = parts.repartition("path").sortWithinPartitions("path", "start", "place").mapInArrow(_joined(keep_payload), RECORD)
    read = whole.unionByName(met)
    return read if keep_payload else read.drop("payload")


def archive_pages(pages: DataFrame) -> DataFrame:
    """Write pages as archives into the shared folder and read the records back, without payloads."""
    spark = pages.sparkSession
    return read_archives(spark, write_archives(pages, shared_folder(spark, "warc")), keep_payload=False)
