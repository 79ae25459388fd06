"""Best-fit packing: best-two-fit over the lengths of token pieces.

Only how many pieces each length has decides a packing, and there are at most
``capacity`` lengths. So: tokenize (each task numbers its pieces within a length), sum
the counts, plan the bins on those counts on the driver, and give each piece its place
from its number among the pieces of its length. No task or driver ever holds more than
``capacity`` counters of the corpus, and the packing is that of one sequential pass over
all pieces. Pieces carry their ids, ``sequences`` joins them to the packed ids, and what ``pack``
says of each piece is read back from the written sequences.

The plan fills a bin greedily (longest piece that fits, again and again), then takes out the
smallest piece if two unpacked pieces together fill the gap it leaves more tightly. A bin
that repeats with the same lengths is planned once with a multiplicity.

Defined cases: null and empty texts are one end token; a document longer than the capacity
is cut so that all pieces but the first are full; equal documents and repeated
rows are separate documents; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ship, slices, written

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids binary, part int, nth bigint"
PLACED = "doc_id bigint, piece int, start bigint, length bigint, ids binary, sequence_id bigint, offset bigint"
#: Numbers (one for each length of each task, 8 bytes) that are broadcast at most; with more the pieces are joined to them by a shuffle.
FEW = 1 << 23


def encoder(vocabulary: str, ranks: str | None = None) -> Callable[[str], np.ndarray]:
    """Text to ids of the byte-level BPE in ``vocabulary`` (a tokenizers file), no special tokens added.

    ``ranks`` is the same vocabulary as a tiktoken file: a faster encoder with equal ids. It takes the
    texts of Latin letters, where both libraries split words alike; every other text goes to tokenizers itself.
    """
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(vocabulary)
    by_tokenizers = lambda text: np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)
    if not ranks:
        return by_tokenizers
    import base64

    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as f:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    special = {x.content: i for i, x in slow.get_added_tokens_decoder().items()}
    fast = tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens=special)
    other = re.compile("[^\n\r\t -~¡-ſ‐-‧]").search
    core, ours = fast._core_bpe, set(special)

    def encode(text: str) -> np.ndarray:
        if other(text):
            return by_tokenizers(text)
        return np.frombuffer(core.encode_to_tiktoken_buffer(text, ours), np.uint32)

    return encode


def kind_of(vocabulary: str, end: int) -> str:
    """How pieces hold their ids: 16 bits where the vocabulary allows it, else 32."""
    from tokenizers import Tokenizer

    return "<u2" if max(Tokenizer.from_file(vocabulary).get_vocab_size(), end + 1) <= 1 << 16 else "<u4"


def pieces(docs: DataFrame, vocabulary: str, ranks: str | None = None, capacity: int = 1024, end: int = 2) -> DataFrame:
    """One row per piece with its ids (``kind_of``); ``part`` is the task that made it, ``nth`` counts the task's pieces of that length."""
    ship(docs.sparkSession)
    kind = kind_of(vocabulary, end)
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("part", pa.int32()), ("nth", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen, encode = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64), encoder(vocabulary, ranks)
        for batch in slices(batches, "text", 16 << 20):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(encode(text) if text else np.empty(0, np.uint32), np.uint32(end)).astype(kind)
                n, start, k = len(ids), 0, 0
                while start < n:
                    size = (n - start) % capacity or capacity
                    rows.append((doc_id, k, start, size, ids[start : start + size].tobytes(), part, int(seen[size])))
                    seen[size] += 1
                    start, k = start + size, k + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECES)


def plan(counts: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Bins for ``counts[length]`` pieces: ({length: uses}, how many such bins), in order."""
    counts, bins = counts.copy(), []
    while counts.any():
        uses, gap = {}, capacity
        there = np.flatnonzero(counts)
        while gap and (k := np.searchsorted(there, gap, "right")):
            length = int(there[k - 1])
            uses[length] = min(int(counts[length]), gap // length)
            gap -= length * uses[length]
            there = there[: k - 1]
        needed = dict(uses)
        if gap:
            smallest = min(uses)
            left = counts.copy()
            for length, n in uses.items():
                left[length] -= n
            if pair := two_fit(left, gap + smallest, smallest):
                uses[smallest] -= 1
                for length in pair:
                    uses[length] = uses.get(length, 0) + 1
                uses = {length: n for length, n in uses.items() if n}
                needed = {length: max(needed.get(length, 0), uses.get(length, 0)) for length in needed | uses}
        times = min(int(counts[length]) // n for length, n in needed.items())
        for length, n in uses.items():
            counts[length] -= n * times
        bins.append((uses, times))
    return bins


def two_fit(left: np.ndarray, room: int, more_than: int) -> tuple[int, int] | None:
    """The two unpacked lengths with the largest sum up to ``room``, if it is over ``more_than``; ties: the longer first piece."""
    a = np.flatnonzero(left)
    a = a[a < room]
    if not len(a):
        return None
    k = np.searchsorted(a, np.minimum(room - a, a), "right") - 1  # the longest partner that isn't longer
    same = (k >= 0) & (a[np.maximum(k, 0)] == a) & (left[a] < 2)
    k = k - same
    total = np.where(k >= 0, a + a[np.maximum(k, 0)], 0)
    best = len(total) - 1 - int(np.argmax(total[::-1]))
    return (int(a[best]), int(a[k[best]])) if total[best] > more_than else None


def runs(bins: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """length → rows (first number, first bin, uses in a bin, offset in the bin) for pieces numbered within their length."""
    out, numbered, first = {}, {}, 0
    for uses, times in bins:
        offset = 0
        for length in sorted(uses, reverse=True):
            out.setdefault(length, []).append((numbered.get(length, 0), first, uses[length], offset))
            numbered[length] = numbered.get(length, 0) + uses[length] * times
            offset += length * uses[length]
        first += times
    return {length: np.array(x, np.int64) for length, x in out.items()}


def place(made: DataFrame, capacity: int = 1024) -> DataFrame:
    """Gives the rows of ``pieces`` (read back from a table) their ``sequence_id`` and ``offset``."""
    counts = made.groupBy("part", "length").agg(F.count("*").alias("n"))
    totals = np.zeros(capacity + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `capacity` rows
        totals[r.length] = r.n
    where = runs(plan(totals, capacity))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    each = counts.select("part", "length", before.alias("before"))
    firsts = each.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct(F.col("length").cast("int"), "before"))).alias("m"))
    offsets = firsts.select("part", F.transform(F.sequence(F.lit(1), F.lit(capacity)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0))).alias("firsts"))
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = batch.column("length").to_numpy(), batch.column("number").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for one in np.unique(length):
                at, table = np.flatnonzero(length == one), where[int(one)]
                row = table[np.searchsorted(table[:, 0], number[at], "right") - 1]
                nth = number[at] - row[:, 0]
                sequence[at] = row[:, 1] + nth // row[:, 2]
                offset[at] = row[:, 3] + nth % row[:, 2] * one
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], schema=schema)

    if counts.select("part").distinct().count() * capacity <= FEW:
        offsets = F.broadcast(offsets)  # the ids stay where they are
    first = F.element_at("firsts", F.col("length").cast("int"))
    numbered = made.join(offsets, "part").select("doc_id", "piece", "start", "length", "ids", (F.col("nth") + first).alias("number"))
    return numbered.mapInArrow(put, PLACED)


def sequences(placed: DataFrame, kind: str) -> DataFrame:
    """``sequence_id, ids, pieces``: the packed ids (32 bits each, little-endian) of every sequence, and which piece of which document lies where in them."""
    held = placed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "length", "doc_id", "piece", "start", "ids"))).alias("held"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(b"".join(row), kind).astype("<u4").tobytes() for row in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), batch.column(2)], ["sequence_id", "ids", "pieces"])

    rows = held.select("sequence_id", "held.ids", F.transform("held", lambda x: x.dropFields("ids")).alias("pieces"))
    return rows.mapInArrow(joined, "sequence_id bigint, ids binary, pieces array<struct<offset:bigint,length:bigint,doc_id:bigint,piece:int,start:bigint>>")


def members(packed: DataFrame) -> DataFrame:
    """The pieces of ``sequences``, each with its ids as the sequence holds them and their CRC."""
    own = packed.select("sequence_id", F.col("ids").alias("all"), F.explode("pieces").alias("x")).select("sequence_id", "all", "x.*")
    own = own.withColumn("ids", F.substring("all", (F.col("offset") * 4 + 1).cast("int"), (F.col("length") * 4).cast("int")))
    return own.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset", "ids")


def pack(docs: DataFrame, vocabulary: str, ranks: str | None = None, capacity: int = 1024, end: int = 2) -> DataFrame:
    placed = place(written(pieces(docs, vocabulary, ranks, capacity, end), "pieces"), capacity)
    return members(written(sequences(placed, kind_of(vocabulary, end)), "sequences"))
