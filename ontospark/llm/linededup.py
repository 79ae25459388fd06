"""Line deduplication with two Bloom filters.

One pass sets the hashes of each task's lines in two filters, "seen once" and "seen
twice"; merged, the second holds every line that is in two documents (and a few others).
Only lines that it suspects are shuffled, as text and counted per task before, to
confirm in how many documents they are and where they come first. A last pass drops them.

Filters grow with the input: ``BITS_A_LINE`` bits for each line of the corpus (lines are counted first, in the JVM),
in segments by ranges of the hash. Both bits of a line lie in the segment of its hash. Filters travel as
sorted positions, segment by segment, merged ``FAN`` tasks at a time. A filter of ``FILTER`` bits at most is broadcast; a
larger one stays a table, and the hashes go to their segments to be tested there. Confirmed lines are broadcast if
they take ``BROADCAST`` bytes at most, else joined. Which way is taken changes no result: lines have one key
function, and every suspicion is confirmed by the text.

A line's key is the line without white space (space, \\t to \\r) at its ends, A-Z in lower
case. Defined cases: null and empty texts are one empty line; empty keys are never dropped; a line counts
once per row, however often it is in it; repeated rows are documents of their own; the first occurrence is that of the smallest
(doc_id, line), null ids last, ties to one text by its hash: rows that repeat an id and the text are alike, of others one keeps it; an
empty table gives no row; all other columns are kept, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship, slices, written

#: A segment has ``LEAST_BITS`` up to ``SEGMENTS`` of them, then more, up to ``MOST_BITS``; beyond that there are more segments again.
BITS_A_LINE, LEAST_BITS, MOST_BITS, SEGMENTS, FAN = 8, 1 << 20, 1 << 23, 1 << 14, 64
FILTER, BROADCAST = 1 << 28, 64 << 20
SPACE = b" \t\n\x0b\x0c\r"
LAST = (1 << 63) - 1
MIX = np.uint64(0x9E3779B97F4A7C15)
SUSPECTS = "rid bigint, doc bigint, line int, key binary"


def key(line: bytes) -> bytes:
    return line.strip(SPACE).lower()


def lines(text: bytes | None) -> list[bytes]:
    return (text or b"").split(b"\n")


def own_keys(text: bytes | None) -> dict[bytes, int]:
    """Each key of a text but the empty one, and the line where it comes first."""
    out: dict[bytes, int] = {}
    for i, line in enumerate(lines(text)):
        if k := key(line):
            out.setdefault(k, i)
    return out


def hashes(keys) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))


def shape_of(n_lines: int, bits: int | None = None) -> tuple[int, int]:
    """(segments, bits of a segment), both powers of two, for so many lines or so many bits."""
    bits = bits or max(LEAST_BITS, 1 << math.ceil(math.log2(max(1, BITS_A_LINE * n_lines))))
    each = min(bits, max(LEAST_BITS, min(bits // SEGMENTS, MOST_BITS)))
    return bits // each, each


def segment_of(h: np.ndarray, segments: int) -> np.ndarray:
    return (h >> np.uint64(64 - segments.bit_length() + 1)).astype(np.int64) if segments > 1 else np.zeros(len(h), np.int64)


def places(h: np.ndarray, bits: int) -> np.ndarray:
    """Two bits of its segment for each hash."""
    mask = np.uint64(bits - 1)
    return np.stack([h & mask, ((h * MIX) >> np.uint64(20)) & mask]).astype(np.int64)


def _pack(at: np.ndarray) -> bytes:
    """Sorted numbers as compressed differences."""
    return zstandard.ZstdCompressor(level=1).compress(np.diff(at, prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").reshape(-1), dtype=np.int64)


def count_lines(docs: DataFrame) -> int:
    text = F.coalesce("text", F.lit(""))
    return docs.agg(F.coalesce(F.sum(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1), F.lit(0)).alias("n")).first().n


def twice_filter(docs: DataFrame, segments: int, bits: int) -> DataFrame:
    """``segment, twice``: sorted positions of the bits of lines seen in two rows at least, for each segment that has any line."""
    ship(docs.sparkSession)
    kinds = pa.schema([("part", pa.int64()), ("segment", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), []
        for batch in slices(batches, "text", 8 << 20):
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                seen.append(hashes({k for line in lines(text) if (k := key(line))}))
        if not seen:
            return
        h, n = np.unique(np.concatenate(seen), return_counts=True)  # by hash, so by segment
        edges = np.searchsorted(segment_of(h, segments), np.arange(segments + 1))
        rows = []
        for s in np.flatnonzero(np.diff(edges)).tolist():
            at = places(h[edges[s] : edges[s + 1]], bits)
            rows.append((part, s, _pack(np.unique(at)), _pack(np.unique(at[:, n[edges[s] : edges[s + 1]] > 1]))))
        for k in range(0, len(rows), 64):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[k : k + 64], strict=True), kinds, strict=True)], schema=kinds)

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        once, n = np.unique(np.concatenate([_unpack(x) for x in pdf.once]), return_counts=True)
        twice = np.unique(np.concatenate([once[n > 1], *(_unpack(x) for x in pdf.twice)]))
        return pd.DataFrame({"part": [int(pdf.part.iloc[0]) // FAN], "segment": [int(pdf.segment.iloc[0])], "once": [_pack(once)], "twice": [_pack(twice)]})

    schema = "part bigint, segment int, once binary, twice binary"
    filters = written(docs.select("text").mapInArrow(fill, schema), "filters", "none")
    parts = filters.agg(F.max("part").alias("p")).first().p
    while parts:
        filters = filters.groupBy("segment", F.floor(F.col("part") / FAN)).applyInPandas(merge, schema)
        parts //= FAN
    return written(filters.select("segment", "twice"), "twice", "none")


def _bitmap(twice: bytes, bits: int) -> np.ndarray:
    out = np.zeros(bits, bool)
    out[_unpack(twice)] = True
    return np.packbits(out)


def _set(bitmap: np.ndarray, at: np.ndarray) -> np.ndarray:
    return ((bitmap[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=0)


def collected(twice: DataFrame, segments: int, bits: int) -> np.ndarray:
    """The whole filter as packed bits: ``FILTER`` bits at most."""

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [zlib.compress(_bitmap(x, bits).tobytes(), 1) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["segment", "twice"])

    out = np.zeros((segments, bits // 8), np.uint8)
    for r in twice.mapInArrow(maps, "segment int, twice binary").collect():
        out[r.segment] = np.frombuffer(zlib.decompress(r.twice), np.uint8)
    return out.reshape(-1)


def _rid() -> Column:
    """A row's number by its id and text, the same in every pass however the table is read."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text"))


def _numbered(docs: DataFrame) -> DataFrame:
    return docs.select(_rid().alias("rid"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), "text")


def _batches(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def suspects_by_broadcast(docs: DataFrame, twice: DataFrame, segments: int, bits: int, counted: bool) -> DataFrame:
    """The suspected lines: counted per task (``key, n, doc, line, rid``) or each of them (``SUSPECTS``)."""
    given = docs.sparkSession.sparkContext.broadcast(collected(twice, segments, bits))
    each = pa.schema([("rid", pa.int64()), ("doc", pa.int64()), ("line", pa.int32()), ("key", pa.binary())])
    sums = pa.schema([("key", pa.binary()), ("n", pa.int64()), ("doc", pa.int64()), ("line", pa.int32()), ("rid", pa.int64())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[bytes, list] = {}
        rows, held = [], 0
        for batch in slices(batches, "text", 8 << 20):
            for rid, doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), strict=True):
                own = own_keys(text)
                if not own:
                    continue
                keys = list(own)
                h = hashes(keys)
                for j in np.flatnonzero(_set(given.value, segment_of(h, segments) * bits + places(h, bits))):
                    k = keys[j]
                    if not counted:
                        rows.append((rid, doc, own[k], k))
                        held += len(k) + 100
                    elif (was := found.get(k)) is None:
                        found[k] = [1, (doc, own[k], rid)]
                        held += len(k) + 100
                    else:
                        was[0] += 1
                        was[1] = min(was[1], (doc, own[k], rid))
            if held > 32 << 20:
                yield _batches([(k, n, *first) for k, (n, first) in found.items()], sums) if counted else _batches(rows, each)
                found, rows, held = {}, [], 0
        if found or rows:
            yield _batches([(k, n, *first) for k, (n, first) in found.items()], sums) if counted else _batches(rows, each)

    return _numbered(docs).mapInArrow(find, "key binary, n bigint, doc bigint, line int, rid bigint" if counted else SUSPECTS)


def suspects_by_segment(docs: DataFrame, twice: DataFrame, segments: int, bits: int) -> DataFrame:
    """``SUSPECTS`` for a filter of any size: hashes are tested where their segment lies, then lines meet the suspected hashes by a join.

    Of lines that aren't suspected only (row, hash) is shuffled; texts come in by their row's number.
    """

    def hash_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 8 << 20):
            rid, all_ = [], []
            for r, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                h = hashes({k for line in lines(text) if (k := key(line))})
                rid.append(np.full(len(h), r, np.int64))
                all_.append(h)
            h = np.concatenate(all_)
            yield pa.RecordBatch.from_arrays([pa.array(segment_of(h, segments).astype(np.int32)), pa.array(np.concatenate(rid)), pa.array(h.view(np.int64))], ["segment", "rid", "h"])

    def test(mine: pa.Table, filters: pa.Table) -> pa.Table:
        if not filters.num_rows:
            return pa.table({"h": pa.array([], pa.int64())})
        h = mine.column("h").to_numpy().view(np.uint64)
        return pa.table({"h": h[_set(_bitmap(filters.column("twice")[0].as_py(), bits), places(h, bits))].view(np.int64)})

    numbered = _numbered(docs)
    each = written(numbered.select("rid", "text").mapInArrow(hash_rows, "segment int, rid bigint, h bigint"), "hashes")
    # distinct hashes of a segment are about an eighth of its bits, however often its lines occur
    tested = each.select("segment", "h").distinct().groupBy("segment").cogroup(twice.groupBy("segment")).applyInArrow(test, "h bigint")
    wanted = each.join(written(tested, "suspected"), "h").groupBy("rid").agg(F.collect_set("h").alias("wanted"))
    kinds = pa.schema([("rid", pa.int64()), ("doc", pa.int64()), ("line", pa.int32()), ("key", pa.binary())])

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 8 << 20):
            rows = []
            for rid, doc, text, want in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), batch.column(3).to_pylist(), strict=True):
                own = own_keys(text)
                want = set(want)
                for k, h in zip(own, hashes(own).view(np.int64).tolist(), strict=True):
                    if h in want:
                        rows.append((rid, doc, own[k], k))
            if rows:
                yield _batches(rows, kinds)

    return numbered.join(wanted, "rid").select("rid", "doc", "text", "wanted").mapInArrow(texts, SUSPECTS)


def confirm(suspects: DataFrame, least_docs: int) -> DataFrame:
    """``key, n_docs, first`` (doc, line, rid) of each key in ``least_docs`` rows at least, by its text."""
    n = F.sum("n") if "n" in suspects.columns else F.count("*")
    all_ = suspects.groupBy("key").agg(n.alias("n_docs"), F.min(F.struct("doc", "line", "rid")).alias("first"))
    return all_.where(F.col("n_docs") >= least_docs)


def repeated(docs: DataFrame, least_docs: int, bits: int | None = None, filter_bits: int = FILTER) -> tuple[DataFrame, DataFrame | None]:
    """The confirmed keys, and all suspected lines where they were written down (with a filter too large to broadcast)."""
    if least_docs < 2:
        raise ValueError("a repeated line is in two documents at least")
    segments, own = shape_of(0 if bits else count_lines(docs), bits)
    twice = twice_filter(docs, segments, own)
    if segments * own <= filter_bits:
        return written(confirm(suspects_by_broadcast(docs, twice, segments, own, True), least_docs), "repeated"), None
    suspects = written(suspects_by_segment(docs, twice, segments, own), "suspects")
    return written(confirm(suspects, least_docs), "repeated"), suspects


def dedup(docs: DataFrame, least_docs: int = 10, keep_first: bool = False, bits: int | None = None, broadcast_bytes: int = BROADCAST, filter_bits: int = FILTER) -> DataFrame:
    """``row`` (a struct of all columns, text without the repeated lines), ``n_lines`` and ``n_dropped``.

    ``keep_first`` leaves a repeated line where it comes first (smallest doc_id, then line).
    """
    spark = docs.sparkSession
    ship(spark)
    confirmed, suspects = repeated(docs, least_docs, bits, filter_bits)
    size = confirmed.agg(F.coalesce(F.sum(F.octet_length("key") + 250), F.lit(0)).alias("b")).first().b  # as a Python worker holds it
    rows = docs.select(_rid().alias("rid"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    if size <= broadcast_bytes:
        known = spark.sparkContext.broadcast({bytes(r.key): (r.first.line, r.first.rid) for r in confirmed.collect()})
        given = rows.select("row", "rid", F.col("row.text").alias("text"))
    else:
        known = None
        given = rows.join(_gone(docs, suspects, confirmed, keep_first), "rid", "left").select("row", "rid", F.col("row.text").alias("text"), "gone")
    out = f"row {rows.schema['row'].dataType.simpleString()}, kept string, n_lines bigint, n_dropped bigint"

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 16 << 20):
            kept, n_lines, n_dropped = [], [], []
            rids, texts = batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist()
            gone = batch.column(3).to_pylist() if known is None else [None] * len(texts)
            for rid, text, own in zip(rids, texts, gone, strict=True):
                all_lines, left = lines(text), []
                firsts = {bytes(x["key"]): x["stays"] for x in own or ()} if known is None else known.value
                for i, x in enumerate(all_lines):
                    first = firsts.get(key(x))
                    if first is None or keep_first and first == (i if known is None else (i, rid)):
                        left.append(x)
                kept.append(b"\n".join(left))
                n_lines.append(len(all_lines))
                n_dropped.append(len(all_lines) - len(left))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], ["row", "kept", "n_lines", "n_dropped"])

    done = given.mapInArrow(drop, out)
    return done.select(F.col("row").withField("text", F.col("kept")).alias("row"), "n_lines", "n_dropped")


def _gone(docs: DataFrame, suspects: DataFrame | None, confirmed: DataFrame, keep_first: bool) -> DataFrame:
    """``rid, gone``: the repeated keys of each row, and the line that stays (-1: none). A key in very many rows is split by the adaptive skew join."""
    if suspects is None:
        suspects = _all_keys(docs)
    stays = F.when((F.col("first.rid") == F.col("rid")) & F.lit(keep_first), F.col("first.line")).otherwise(-1)
    return suspects.join(confirmed, "key").groupBy("rid").agg(F.collect_set(F.struct("key", stays.alias("stays"))).alias("gone"))


def _all_keys(docs: DataFrame) -> DataFrame:
    kinds = pa.schema([("rid", pa.int64()), ("key", pa.binary())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            rows = [(rid, k) for rid, text in zip(batch.column(0).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), strict=True) for k in own_keys(text)]
            if rows:
                yield _batches(rows, kinds)

    return _numbered(docs).mapInArrow(each, "rid bigint, key binary")
