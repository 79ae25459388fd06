"""WARC: seekable Zstandard bundles.

``bundles`` writes one record per page into bundles. A bundle holds independent
Zstandard frames, each of whole records, and ends in a skippable frame with the seek
table of the Zstandard seekable format, so any Zstandard reader can decompress it and a
seeking one can open a single frame. Records are mapped to
(bundle, frame, offset in the frame, length). Payloads of equal digest are written
once: later ones become ``revisit`` records that name the record they repeat.

A bundle is a row ``path, content, records`` (the layout of Spark's ``binaryFile``
reader plus the index), at most about ``BUNDLE`` bytes of records, so a task holds one bundle at a
time. They are ordinary table rows, so Spark's writers commit them
and a lost executor costs one task; ``export`` turns them into files.

Defined cases: a null payload is empty; null or odd URLs are percent-encoded or left out; empty
tables give no bundle; records with equal ids and payloads are all kept; other columns
are ignored; a payload longer than a frame gets a frame of its own.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, written

FRAME, BUNDLE, LEVEL = 256 << 10, 16 << 20, 3
#: Records of a lookup whose places are broadcast at most.
FEW = 1 << 20
#: Fixed values of the seekable format: magic numbers of the skippable frame and of the seek table's footer.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

BUNDLES = "path string, content binary, records array<struct<record_id:bigint,frame:int,offset:bigint,length:bigint>>"
PARSED = "path string, record_id bigint, record_type string, refers_to bigint, url string, payload_bytes bigint, payload_digest string, payload binary"


#: Payloads with copies that are broadcast at most (about 100 bytes each); with more of them the pages are joined on the digest.
COPIES = 1 << 19


def with_reference(pages: DataFrame, least_bytes: int = 1000, most: int = COPIES) -> DataFrame:
    """``page_id, url, payload, digest, refers_to``: refers_to is the id of the record that holds the payload.

    Among payloads that are equal and have ``least_bytes`` at least, the largest page_id
    holds it; its own refers_to is null. Groups are counted before the shuffle (one
    row per digest and task), and only digests with copies are kept. Up to ``most`` of them are broadcast, so no payload
    is shuffled; more are joined on the digest, where Spark's adaptive skew join splits a digest that holds a large part of all rows.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    p = p.withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload"))
    keeper = (
        p.where(F.col("size") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("kept"), F.count("*").alias("copies"))
        .where("copies > 1").select(F.col("digest").alias("of"), "kept")
    )
    keeper = written(keeper, "copies")
    few = keeper.limit(most + 1).count() <= most
    return p.join(F.broadcast(keeper) if few else keeper, (p.digest == keeper.of) & (F.col("size") >= least_bytes), "left").select(
        "page_id", "url", "payload", "digest",
        F.when(~F.col("kept").eqNullSafe(F.col("page_id")), F.col("kept")).alias("refers_to"),
    )


def uri(record: int | None) -> str:
    return f"urn:page:{'' if record is None else record}"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC/1.1 record. A revisit keeps the HTTP headers, whose Content-Length is the payload's."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{uri(page_id)}>",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="!#$%&'()*+,/:;=?@[]~"))
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{uri(refers_to)}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The skippable frame with (compressed, decompressed) sizes of the frames before it."""
    body = b"".join(struct.pack("<II", *f) for f in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def frame_ranges(content: bytes) -> list[tuple[int, int, int]]:
    """(start, compressed size, decompressed size) of each frame, read from the footer alone."""
    n, flags, magic = struct.unpack("<IBI", content[-9:])
    if magic != SEEKABLE or flags:
        raise ValueError("no seek table of this format at the end of the bundle")
    entries = struct.iter_unpack("<II", content[-9 - 8 * n : -9])
    out, at = [], 0
    for packed, plain in entries:
        out.append((at, packed, plain))
        at += packed
    return out


def read_frame(content: bytes, frame: int) -> bytes:
    start, packed, plain = frame_ranges(content)[frame]
    return zstandard.ZstdDecompressor().decompress(content[start : start + packed], max_output_size=plain)


class _Bundle:
    """Records gathered into frames, frames into one bundle."""

    def __init__(self) -> None:
        self.packer = zstandard.ZstdCompressor(level=LEVEL)
        self.out, self.frames, self.index, self.open, self.size = [], [], [], bytearray(), 0

    def add(self, page_id: int | None, data: bytes) -> None:
        if self.open and len(self.open) + len(data) > FRAME:
            self.close_frame()
        self.index.append({"record_id": page_id, "frame": len(self.frames), "offset": len(self.open), "length": len(data)})
        self.open += data
        self.size += len(data)

    def close_frame(self) -> None:
        if self.open:
            packed = self.packer.compress(bytes(self.open))
            self.frames.append((len(packed), len(self.open)))
            self.out.append(packed)
            self.open = bytearray()

    def content(self) -> bytes:
        self.close_frame()
        return b"".join(self.out) + seek_table(self.frames)


def bundles(referenced: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Bundles of the rows of ``with_reference``, each task's rows into its own."""
    ship(referenced.sparkSession)
    schema = pa.schema([
        ("path", pa.string()), ("content", pa.binary()),
        ("records", pa.list_(pa.struct([("record_id", pa.int64()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())]))),
    ])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made, b = TaskContext.get().partitionId(), 0, _Bundle()

        def row() -> pa.RecordBatch:
            name = f"part-{part:06d}-{made:05d}.warc.zst"
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([b.content()], pa.binary()), pa.array([b.index], schema.field(2).type)], schema=schema)

        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, payload, digest, refers_to = (batch.column(k)[i].as_py() for k in range(5))
                b.add(page_id, record(page_id, url, payload, digest, refers_to, date))
                if b.size >= BUNDLE:
                    yield row()
                    made, b = made + 1, _Bundle()
        if b.index:
            yield row()

    return referenced.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(pack, BUNDLES)


def parse_record(data: bytes) -> dict:
    """One record's headers and payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {version[:40]!r}")
    fields = dict(x.split(": ", 1) for x in lines)
    http, _, body = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    declared = next(int(x.split(b": ")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    number = lambda x: None if x is None or x == "<urn:page:>" else int(x[len("<urn:page:") : -1])
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    kind = fields["WARC-Type"]
    if kind == "response" and (len(body) != declared or hashlib.sha1(body).hexdigest() != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} doesn't match its digest or length")
    return {
        "record_id": number(fields["WARC-Record-ID"]), "record_type": kind, "refers_to": number(fields.get("WARC-Refers-To")), "url": fields.get("WARC-Target-URI"),
        "payload_bytes": declared, "payload_digest": digest, "payload": body if kind == "response" else None,
    }


def opened(content: bytes, places: list[dict]) -> Iterator[bytes]:
    """The records at ``places`` (frame, offset, length), each frame that holds any decompressed once."""
    ranges, opener = frame_ranges(content), zstandard.ZstdDecompressor()
    by_frame: dict[int, list[dict]] = {}
    for p in places:
        by_frame.setdefault(p["frame"], []).append(p)
    for frame, own in sorted(by_frame.items()):
        start, packed, plain = ranges[frame]
        data = opener.decompress(content[start : start + packed], max_output_size=plain)
        for p in own:
            yield data[p["offset"] : p["offset"] + p["length"]]


def _records(rows: DataFrame, payloads: bool) -> DataFrame:
    """The records of ``path, content, places``, as ``PARSED``, a frame's worth or so in a batch; digests and lengths of responses are verified."""
    ship(rows.sparkSession)
    schema = pa.schema([
        ("path", pa.string()), ("record_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()),
        ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()),
    ])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                path, held, size = batch.column(0)[i].as_py(), [], 0
                for data in opened(batch.column(1)[i].as_py(), batch.column(2)[i].as_py()):
                    held.append({"path": path} | parse_record(data))
                    size += len(data)
                    if not payloads:
                        held[-1]["payload"] = None
                    if size > FRAME:
                        yield pa.RecordBatch.from_pylist(held, schema=schema)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=schema)

    return rows.select("path", "content", "places").mapInArrow(unpack, PARSED)


def read(bundle_rows: DataFrame, payloads: bool = True) -> DataFrame:
    """Every record of every bundle, found by the map of its bundle."""
    return _records(bundle_rows.select("path", "content", F.transform("records", lambda r: r.dropFields("record_id")).alias("places")), payloads)


def index(bundle_rows: DataFrame) -> DataFrame:
    """``path, record_id, frame, offset, length`` of each record; reads no content."""
    return bundle_rows.select("path", F.explode("records").alias("r")).select("path", "r.*")


def fetch(bundle_rows: DataFrame, wanted: DataFrame, few: int = FEW) -> DataFrame:
    """The records whose ids are in ``wanted.record_id``: only the frames that hold them are opened.

    The map is joined without the content. The bundles that are hit are found by a broadcast of their paths and places where these are
    ``few`` records at most, so that no content is shuffled; a lookup of more records joins.
    """
    hits = index(bundle_rows).join(wanted.select("record_id").distinct(), "record_id")
    places = hits.groupBy("path").agg(F.collect_list(F.struct("frame", "offset", "length")).alias("places"))  # as many as a bundle has at most
    if hits.limit(few + 1).count() <= few:
        places = F.broadcast(places)
    return _records(bundle_rows.select("path", "content").join(places, "path"), True)


def export(bundle_rows: DataFrame, folder: str) -> None:
    """Each bundle as a file of its own under a folder, given as a URI that Arrow's file systems know or a mounted path."""

    def put(rows) -> None:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        store.create_dir(base, recursive=True)
        for r in rows:
            with store.open_output_stream(f"{base}/{r.path}.tmp") as f:
                f.write(r.content)
            store.move(f"{base}/{r.path}.tmp", f"{base}/{r.path}")

    bundle_rows.select("path", "content").foreachPartition(put)
