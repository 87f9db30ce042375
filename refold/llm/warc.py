"""WARC files with a Zstandard dictionary of their own.

Each file begins with a skippable frame (magic 0x184D2A5D) that holds a dictionary; then comes one
frame for each record, compressed alone with that dictionary, so any record can be read from its
offset. The dictionary is built by the task that writes the file, from the first TRAIN bytes of the
records that it archives; it bears on the size of the file only.

Records with equal payloads of at least `least` bytes are archived once: the one with the largest
page_id is a response, the others are revisits that refer to it. Digests are grouped map-side first.
A digest with more than 1/SHARE of all pages (there are fewer than SHARE) is looked up by broadcast and
its pages are dealt by page_id; all others meet their digest's response by one shuffle on the digest.
So no task gets a hot group, and the html crosses the network once.

Edge cases: null html is an empty payload; null urls get urn:page:<id>; a null page_id counts as
smaller than any other; rows that repeat a response (same payload and page_id) are responses too; an
empty table gives no files.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle
from .store import reading, replacing
from .tokens import slices

MAGIC, TRAIN, DICTIONARY, SHARE, LEVEL = 0x184D2A5D, 1 << 20, 1 << 16, 256, 3
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, file string, offset long"


def digest(payload: bytes) -> str:
    """Base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def urn(page_id) -> str:
    return f"urn:page:{'' if page_id is None else page_id}"


def record(page_id, url, payload: bytes, refers_to, revisit: bool, date: str = DATE) -> bytes:
    """One WARC/1.1 record; a revisit has the HTTP head and no payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    place = " ".join((url or "").split()) or urn(page_id)
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<{urn(page_id)}>"),
        ("WARC-Target-URI", place),
        ("WARC-Date", date),
        ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
        *([("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{urn(refers_to)}>")] if revisit else []),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes, int]:
    """(WARC fields, payload as stored, payload length as declared) of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if version != "WARC/1.1":
        raise ValueError(f"not a WARC record: {version[:20]!r}")
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    return fields, payload, length


class Writer:
    """Records to a stream; the first TRAIN bytes of records are held back to build the dictionary."""

    def __init__(self, out):
        self.out, self.held, self.size, self.packer, self.at = out, [], 0, None, 0

    def add(self, data: bytes) -> None:
        if self.packer:
            self._frame(data)
            return
        self.held.append(data)
        self.size += len(data)
        if self.size >= TRAIN:
            self._begin()

    def _begin(self) -> None:
        import zstandard as z

        try:
            words = z.train_dictionary(DICTIONARY, [x[:DICTIONARY] for x in self.held])
        except z.ZstdError:  # too few records to train on: their text serves as it is
            words = z.ZstdCompressionDict(b"".join(self.held)[:DICTIONARY].ljust(8, b"\0"), dict_type=z.DICT_TYPE_RAWCONTENT)
        raw = words.as_bytes()
        self._put(struct.pack("<II", MAGIC, len(raw)) + raw)
        self.packer = z.ZstdCompressor(level=LEVEL, dict_data=words, write_content_size=True)
        for x in self.held:
            self._frame(x)
        self.held = []

    def _frame(self, data: bytes) -> None:
        self._put(self.packer.compress(data))

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def close(self) -> None:
        if not self.packer:
            self._begin()


def read(source) -> Iterator[tuple[int, bytes]]:
    """(offset, record) for each frame of a file-like object, with a bounded window."""
    import zstandard as z

    magic, size = struct.unpack("<II", source.read(8))
    if magic != MAGIC:
        raise ValueError("no dictionary frame")
    raw = source.read(size)
    trained = raw[:4] == struct.pack("<I", 0xEC30A437)
    words = z.ZstdCompressionDict(raw, dict_type=z.DICT_TYPE_FULLDICT if trained else z.DICT_TYPE_RAWCONTENT)
    unpacker, window, at = z.ZstdDecompressor(dict_data=words), b"", 8 + size
    while True:
        one, out = unpacker.decompressobj(), []
        start = at
        while not one.eof:
            if not window and not (window := source.read(1 << 20)):
                if out:
                    raise ValueError("a record ends early")
                return
            out.append(one.decompress(window))
            rest = one.unused_data if one.eof else b""
            at += len(window) - len(rest)
            window = rest
        yield start, b"".join(out)


def plan(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, sha (SHA-1 in hex), canon: the page_id of the response where a row is a revisit."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), F.sha1(payload.cast("binary")).alias("sha"), F.octet_length(payload).alias("bytes"))
    return keyed.where(F.col("bytes") >= least).groupBy("sha").agg(F.max("page_id").alias("canon"), F.count(F.lit(1)).alias("n")).where("n > 1")


def write(pages: DataFrame, path: str, least: int = 0) -> list[str]:
    """Archives pages (page_id, url, html) under path; returns the files' names."""
    groups = settle(plan(pages, least), "digests")
    total = pages.count()
    hot = groups.where(F.col("n") * SHARE > total)  # fewer than SHARE rows
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("html"), F.sha1(payload.cast("binary")).alias("sha"))
    known = base.join(F.broadcast(hot.select("sha", F.col("canon").alias("hot"), F.lit(True).alias("is_hot"))), "sha", "left")
    key = F.when(F.col("is_hot"), F.concat(F.lit("page "), F.coalesce(F.col("page_id").cast("string"), F.lit("")))).otherwise(F.col("sha"))
    rest = groups.where(F.col("n") * SHARE <= total).select(F.col("sha").alias("key"), "canon")
    placed = known.withColumn("key", key).join(rest, "key", "left").withColumn("canon", F.coalesce("hot", "canon"))
    revisit = F.col("canon").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("canon"))
    rows = placed.select("page_id", "url", "html", F.when(revisit, F.col("canon")).alias("refers_to"))

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, out, sink = f"part-{TaskContext.get().partitionId():06d}.warc.zst", None, None
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        with replacing(path, name) as sink:
            out = Writer(sink)
            for b in slices(_chain(first, batches), "html"):
                for page, url, html, refers in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to")), strict=True):
                    out.add(record(page, url, html.encode(), refers, refers is not None))
            out.close()
        yield pa.record_batch([pa.array([name])], names=["file"])

    return sorted(r.file for r in rows.mapInArrow(archive, "file string").collect())


def _chain(first, rest):
    yield first
    yield from rest


def records(spark, path: str, files: list[str]) -> DataFrame:
    """A row of RECORDS for each record of the archives. A response's payload must have the length and
    the digest that its record declares."""

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RECORDS.split(", ")]
        types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64())
        for b in batches:
            for name in b.column("file").to_pylist():
                out: list = []
                with reading(path, name) as source:
                    for offset, data in read(source):
                        out.append((*_facts(data), name, offset))
                        if len(out) == 10_000:
                            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
                            out = []
                if out:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    source = spark.createDataFrame([(f,) for f in files], "file string").repartition(max(1, len(files)))
    return source.mapInArrow(load, RECORDS)


def _facts(data: bytes) -> tuple:
    fields, payload, length = parse(data)
    kind, said = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != length or digest(payload) != said):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    page = lambda x: int(n) if (n := x.strip("<>").rpartition(":")[2]) else None
    return page(fields["WARC-Record-ID"]), length, said, kind, page(fields["WARC-Refers-To"]) if kind == "revisit" else None
