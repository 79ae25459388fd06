"""SimHash near-duplicates by pigeonhole blocks.

Fingerprints of equal texts are equal, so documents are first reduced to distinct fingerprints
(counted before the shuffle). A fingerprint's 64 bits are split into five blocks; two
fingerprints that differ in three bits or fewer agree on two blocks at least, so they meet under one of ten
keys of two blocks (25 or 26 bits). Rows that meet are compared by Hamming distance, all
pairs of a key's rows without writing pairs out: each task hands on only a spanning forest of the links it
verified. A key with more than ``HOT`` rows is dealt out as pairs of
chunks, so that no task compares more than two chunks. Components of the forest are found by
alternating star steps on written tables.

Defined cases: null and empty texts, and texts of white space, have fingerprint zero, linked like any
other; texts of fewer words than a shingle are one shingle; shingles count as
often as they occur; equal fingerprints are one component; component ids are the smallest doc_id reachable
(null ids never, unless a component has no other: then null); an empty table
gives no row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ship, slices, written

DISTANCE, SHINGLE, SEED = 3, 3, 42
#: (first bit, width) of the five blocks.
BLOCKS = [(0, 13), (13, 13), (26, 13), (39, 13), (52, 12)]
HOT = 2048


def fingerprint(text: bytes | None, width: int = SHINGLE) -> int:
    """A bit is 1 if it is set in over half of the shingles' hashes."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    n = max(1, len(words) - width + 1)
    stops = (ends[width - 1 :] - 1).tolist() if len(words) >= width else [len(joined)]
    starts = [0, *ends[: n - 1].tolist()]
    digest = xxhash.xxh64_intdigest
    h = np.fromiter([digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)], np.uint64, n)
    ones = np.zeros(64, np.int64)
    for k in range(0, n, 1 << 16):
        ones += np.unpackbits(h[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """``doc_id, fp``: fp holds the 64 bits as a signed number."""
    ship(docs.sparkSession)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 8 << 20):
            done: dict[bytes | None, int] = {}
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            for t in texts:
                if t not in done:
                    done[t] = fingerprint(t, width)
            fp = np.array([done[t] for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(make, "doc_id bigint, fp bigint")


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of each member's component, for links a–b among 0..n-1."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        low, high = np.minimum(ra, rb), np.maximum(ra, rb)
        np.minimum.at(root, high, low)
        while (jumped := root[root] != root).any():
            root[jumped] = root[root[jumped]]
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
    return root


def forest(key: np.ndarray, chunk: np.ndarray, fp: np.ndarray, distance: int, most: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest among rows with equal keys (rows sorted by key).

    chunk: 0 compares all rows of the key; 1 and 2 compare only rows of different chunks.
    """
    values, code = np.unique(fp, return_inverse=True)
    root, held = np.arange(len(values)), ([], [], 0)
    bits, live, d = fp.view(np.uint64), np.arange(len(fp)), 1
    while len(live):
        live = live[live + d < len(fp)]
        live = live[key[live] == key[live + d]]
        across = (chunk[live] == 0) | (chunk[live] != chunk[live + d])
        near = live[across & (np.bitwise_count(bits[live] ^ bits[live + d]) <= distance)]
        held[0].append(code[near])
        held[1].append(code[near + d])
        held = (held[0], held[1], held[2] + len(near))
        if held[2] > most:
            root = roots(len(values), np.concatenate([np.arange(len(values)), *held[0]]), np.concatenate([root, *held[1]]))
            held = ([], [], 0)
        d += 1
    root = roots(len(values), np.concatenate([np.arange(len(values)), *held[0]]), np.concatenate([root, *held[1]]))
    linked = np.flatnonzero(root != np.arange(len(values)))
    return values[linked], values[root[linked]]


def links(distinct: DataFrame, distance: int = DISTANCE, hot: int = HOT) -> DataFrame:
    """``a, b``: links between distinct fingerprints ``fp`` whose components are those of all pairs within ``distance``."""
    if distance > 3:
        raise ValueError("five blocks, two of them equal, find distances up to 3")
    block = [F.shiftrightunsigned("fp", s).bitwiseAND(F.lit((1 << w) - 1)) for s, w in BLOCKS]
    keys = F.array(*[F.lit(k) * (1 << 26) + block[i] * (1 << 13) + block[j] for k, (i, j) in enumerate(combinations(range(5), 2))])
    keyed = distinct.select("fp", F.explode(keys).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    # rows of a key are dealt to chunks of about `hot`; a row goes to each pair of chunks that its own is in
    shared = keyed.join(sizes, "key").withColumn("chunks", F.ceil(F.col("n") / hot).cast("int"))
    own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    cold = shared.where("chunks = 1").select("key", F.lit(-1).alias("pair"), F.lit(0).cast("byte").alias("chunk"), "fp")
    other = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda j: F.struct(
        (F.least(j, F.col("own")) * F.col("chunks") + F.greatest(j, F.col("own"))).cast("int").alias("pair"),
        F.when(j == F.col("own"), 0).when(F.col("own") < j, 1).otherwise(2).cast("byte").alias("chunk"),
    ))
    warm = shared.where("chunks > 1").withColumn("own", own).select("key", "fp", F.explode(other).alias("x")).select("key", "x.pair", "x.chunk", "fp")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None
        for batch in batches:
            now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            now = [np.concatenate(x) for x in zip(left, now, strict=True)] if left else now
            last = (now[0] == now[0][-1]) & (now[1] == now[1][-1])
            cut = int(np.argmax(last))  # the last key may go on in the next batch
            left = [x[cut:] for x in now]
            if cut:
                yield linked([x[:cut] for x in now])
        if left and len(left[0]):
            yield linked(left)

    def linked(rows: list[np.ndarray]) -> pa.RecordBatch:
        group = np.cumsum(np.concatenate([[0], (np.diff(rows[0]) != 0) | (np.diff(rows[1]) != 0)]))
        a, b = forest(group, rows[2], rows[3], distance)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=schema)

    ship(distinct.sparkSession)
    dealt = cold.unionByName(warm).repartition("key", "pair").sortWithinPartitions("key", "pair")
    return dealt.mapInArrow(compare, "a bigint, b bigint").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node, root``: the smallest node of the component of every node in ``a, b``, by alternating star steps.

    Large star: a node's larger neighbours point to its smallest neighbour (or itself); small
    star: so do its smaller ones and itself. Each step keeps at most as many links as before and cuts
    the lineage with a written table. Both steps aggregate a minimum per node before the shuffle.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    pairs = written(pairs.distinct(), "links")
    for _ in range(most_rounds):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.when(F.col("v") == F.col("m"), F.array(F.struct("u", F.col("m").alias("v")))).otherwise(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v"))))).alias("x")).select("x.u", "x.v").distinct()
        after = written(small, "links")
        same = pairs.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h"))
        now = after.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h"))
        done, pairs = same.first() == now.first(), after
        if done:
            break
    else:
        raise RuntimeError("the links did not settle")
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, width: int = SHINGLE) -> DataFrame:
    """``doc_id, fp, component_id`` of every row.

    The last join is on the fingerprint, where the adaptive skew join splits one that a large part of all rows has.
    """
    fps = written(fingerprints(docs, width), "fingerprints")
    distinct = written(fps.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct")
    member = components(links(distinct.select("fp"), distance))
    known = distinct.join(member, distinct.fp == member.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    known = written(known, "members")
    least = known.groupBy("root").agg(F.min("low").alias("component_id"))
    by_fp = known.join(least, "root").select(F.col("fp").alias("of"), "component_id")
    return fps.join(by_fp, fps.fp == by_fp.of).select("doc_id", "fp", "component_id")


# Similar texts: pairs of a shingle similarity (Jaccard, of the sets) that is asked for, found by SimHash fingerprints of many bits.
#
# A bit is the side of a random hyperplane on which a text's set of shingles lies. Two sets of a similarity s have a cosine of 2s / (1 + s) or more,
# at 0.8 an angle of 27.3 degrees or less, so they differ in a bit with a chance of 0.152 at most, whatever the edit. The fingerprint is
# cut into tables of some bits each. The bits that differ are mostly those whose hyperplane is near to one of the two texts, so in each table a text
# goes to the places of all its variants with its nearest bits flipped, and two texts meet there if they differ in such bits alone.

#: Least similarity of two linked texts.
SIMILAR = 0.8
#: Up to so many texts: bits of a table, bits that are flipped, tables. The bits follow the number of texts, so that variants fill at most a sixth of a table's
#: places: texts that meet by chance stay a share of all places, however many texts there are. A pair of a similarity of 0.8 meets in one table
#: with a chance of 0.224, 0.198, 0.173, 0.240, 0.211, 0.189, 0.166, 0.148, 0.130, 0.114, 0.099, 0.088, 0.124, 0.096 and 0.058 (simulated), and so in none with
#: one of about 0.0004.
TABLES = [
    ((1 << 20) // 24, 20, 2, 31), ((1 << 21) // 24, 21, 2, 36), ((1 << 22) // 24, 22, 2, 42),
    (1 << 18, 24, 3, 29), (1 << 19, 25, 3, 33), (1 << 20, 26, 3, 38), (1 << 21, 27, 3, 44), (1 << 22, 28, 3, 50), (1 << 23, 29, 3, 57), (1 << 24, 30, 3, 65),
    (1 << 25, 31, 3, 75), (1 << 26, 32, 3, 86), (1 << 27, 34, 4, 59), (1 << 29, 36, 4, 78), (1 << 63, 40, 4, 132),
]
#: Texts that meet are candidates if at most ``APART`` of the first ``FIRST`` bits differ: at 0.8 more do with a chance of about 0.00001.
FIRST, APART = 256, 64
#: Bytes of text in a chunk of a candidate group.
CHUNK = 16 << 20
#: Keys that are broadcast at most, as numbers of 8 bytes; more are joined.
FEW = 1 << 21
LANES = np.uint64(0x00FF00FF00FF00FF)


def tables_for(texts: int) -> tuple[int, int, int]:
    """Bits of a table, bits that are flipped and tables for so many texts."""
    return next(x[1:] for x in TABLES if texts <= x[0])


def spread(h: np.ndarray, words: int) -> np.ndarray:
    """(n × words) hashes from one of each, by the splitmix64 finalizer."""
    x = h[:, None] + np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sides(h: np.ndarray, bits: int) -> np.ndarray:
    """Where a set of shingles lies from each of the hyperplanes: sums of the shingles' weights, which are the bytes of their hashes less 127.5, times 2."""
    words = -(-bits // 8)
    total = np.zeros((words, 4, 2), np.int64)
    for k in range(0, len(h), 256):  # 256 bytes have a sum below 2^16, so four of them are added in one word
        x = spread(h[k : k + 256], words)
        total[:, :, 0] += (x & LANES).sum(axis=0).view(np.uint16).reshape(words, 4)
        total[:, :, 1] += (x >> np.uint64(8) & LANES).sum(axis=0).view(np.uint16).reshape(words, 4)
    return (2 * total - 255 * len(h)).reshape(-1)[:bits]


def sketch(h: np.ndarray, bits: int, flips: int, tables: int) -> tuple[bytes, bytes]:
    """The fingerprint of a set of shingles, and in each table the places of the ``flips`` bits that are the least certain."""
    at = sides(h, bits * tables)
    near = np.argpartition(np.abs(at).reshape(tables, bits), flips - 1, axis=1)[:, :flips]
    return np.packbits(at > 0, bitorder="little").tobytes(), near.astype(np.uint8).tobytes()


def places(fp: np.ndarray, near: np.ndarray, bits: int, flips: int, tables: int) -> np.ndarray:
    """(n × places) of n fingerprints and their least certain bits, as bytes of equal lengths: a table's number above its bits."""
    on = np.unpackbits(fp, axis=1, bitorder="little")[:, : bits * tables].reshape(len(fp), tables, bits)
    code = on @ (1 << np.arange(bits, dtype=np.int64)) | np.arange(tables, dtype=np.int64) << 40
    flip = np.int64(1) << near.reshape(len(fp), tables, flips).astype(np.int64)
    variants = [code ^ sum((flip[:, :, j] for j in range(flips) if v >> j & 1), np.int64(0)) for v in range(1 << flips)]
    return np.concatenate(variants, axis=1)


def shingles(words: list[bytes], width: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles; fewer words than a shingle are one."""
    digest = xxhash.xxh3_64_intdigest
    grams = {digest(b" ".join(words[i : i + width])) for i in range(max(1, len(words) - width + 1))}
    return np.sort(np.fromiter(grams, np.uint64, len(grams)))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sorted sets."""
    both = np.sort(np.concatenate([a, b]))
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return shared / (len(both) - shared)


def dealt(shared: DataFrame, key: str) -> DataFrame:
    """``key, pair, chunk, node`` of the rows ``key, node, chunks``: a row goes to each pair of chunks that its own is in."""
    own = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    other = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda j: F.struct(
        (F.least(j, F.col("own")) * F.col("chunks") + F.greatest(j, F.col("own"))).cast("int").alias("pair"),
        F.when(j == F.col("own"), 0).when(F.col("own") < j, 1).otherwise(2).cast("byte").alias("chunk"),
    ))
    return shared.withColumn("own", own).select(key, "node", F.explode(other).alias("x")).select(key, "x.pair", "x.chunk", "node")


def size_classes(n: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The class of each size, from a power of four up to the next, and whether a set of it can be similar to a larger one of the next class, so that it goes there too."""
    kind = (np.frexp(n.astype(float))[1].astype(np.int64) + 1) // 2
    return kind, n >= least * 4.0**kind


def among(rows: DataFrame, keys: DataFrame, column: str, how: str) -> DataFrame:
    """``rows`` with (``left_semi``) or without (``left_anti``) those whose ``column`` is in the written table ``keys``; few keys are broadcast, so that no row moves."""
    return rows.join(F.broadcast(keys) if keys.count() <= FEW else keys.hint("merge"), column, how)


def similar(rows: DataFrame, width: int = 5, least: float = SIMILAR, hot: int = HOT) -> DataFrame:
    """``row_id, root`` for the rows ``row_id, text`` of a written table: groups of texts linked by a shingle similarity of ``least`` or more.

    Texts that meet in a table of their SimHash fingerprints, have about as many shingles and differ in few enough bits are candidates. The
    groups that candidates form hold all links, so each group's texts are sent to one place (hot ones
    as pairs of chunks) and linked there by the exact similarity. ``root`` is a row of the group.
    """
    if least < SIMILAR:
        raise ValueError(f"the tables find similarities of {SIMILAR} or more")
    shape = tables_for(rows.count())
    ship(rows.sparkSession)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 8 << 20):
            same, fps, near, count, size = [], [], [], [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                words = (text or b"").lower().split()
                h = shingles(words, width)
                fp, low = sketch(h, *shape)
                same.append(xxhash.xxh3_128_digest(b" ".join(words)))
                fps.append(fp)
                near.append(low)
                count.append(len(h))
                size.append(len(text or b""))
            kinds = [pa.array(same, pa.binary()), pa.array(fps, pa.binary()), pa.array(near, pa.binary()), pa.array(count, pa.int64()), pa.array(size, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *kinds], ["row_id", "same", "fp", "near", "count", "size"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 1024):
                batch = whole.slice(k, 1024)
                fp, near = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for i in (1, 2))
                at, node = places(fp, near, *shape), batch.column(0).to_numpy()
                n = batch.column(3).to_numpy()
                kind, more = size_classes(n, least)
                keys = np.concatenate([at | (kind << 48)[:, None], at[more] | ((kind[more] + 1) << 48)[:, None]])
                nodes = np.repeat(np.concatenate([node, node[more]]), at.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(keys.ravel())], ["node", "key"])

    made = written(rows.select("row_id", "text").mapInArrow(make, "row_id bigint, same binary, fp binary, near binary, count bigint, size bigint"), "sketches")
    nodes = written(made.groupBy("same").agg(F.min("row_id").alias("node")), "nodes")
    distinct = written(made.join(nodes.select(F.col("node").alias("row_id")), "row_id").select(F.col("row_id").alias("node"), "fp", "near", "count", "size"), "distinct")
    first = distinct.select("node", F.substring("fp", 1, FIRST // 8).alias("fp"))
    keyed = distinct.select("node", "fp", "near", "count").mapInArrow(meet, "node bigint, key bigint")
    shared = keyed.withColumn("n", F.count("*").over(Window.partitionBy("key"))).where("n > 1")
    met = dealt(shared.withColumn("chunks", F.ceil(F.col("n") / hot).cast("int")), "key")
    maybe = _linked(met.join(first, "node").select("key", "pair", "chunk", "node", "fp"), "key")
    group = written(components(maybe), "candidates")
    held = group.join(distinct.select("node", "size"), "node").groupBy("root").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    chunks = F.greatest(F.ceil(F.col("n") / hot), F.ceil(F.col("bytes") / CHUNK)).cast("int")
    sent = dealt(group.join(held.select("root", chunks.alias("chunks")), "root"), "root")
    texts = among(rows.select(F.col("row_id").alias("node"), "text"), group.select("node"), "node", "left_semi")
    sent = sent.join(first, "node").join(texts, "node").select("root", "pair", "chunk", "node", "fp", "text")
    sure = _linked(sent, "root", width, least)
    member = components(sure)
    known = nodes.join(member, "node", "left").select("same", F.coalesce("root", "node").alias("root"))
    return made.select("row_id", "same").join(known, "same").select("row_id", "root")


def _linked(rows: DataFrame, key: str, width: int = 0, least: float = 0.0) -> DataFrame:
    """``a, b``: spanning forests of the links within each key and pair of the rows ``key, pair, chunk, node, fp[, text]``; with a width links are checked by the texts."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None
        for batch in batches:
            sets = np.empty(batch.num_rows, object)
            for i, text in enumerate(batch.column(5).cast(pa.binary()).to_pylist() if width else ()):
                sets[i] = shingles((text or b"").lower().split(), width)
            fps = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint64).reshape(-1, FIRST // 64)
            now = [*(batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)), fps, sets]
            now = [np.concatenate(x) for x in zip(left, now, strict=True)] if left else now
            cut = int(np.argmax((now[0] == now[0][-1]) & (now[1] == now[1][-1])))  # the last key may go on in the next batch
            left = [x[cut:] for x in now]
            if cut:
                yield linked([x[:cut] for x in now])
        if left and len(left[0]):
            yield linked(left)

    def linked(rows: list[np.ndarray]) -> pa.RecordBatch:
        group = np.cumsum(np.concatenate([[0], (np.diff(rows[0]) != 0) | (np.diff(rows[1]) != 0)]))
        a, b = similar_forest(group, *rows[2:5], rows[5] if width else None, least)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return rows.repartition(key, "pair").sortWithinPartitions(key, "pair").mapInArrow(compare, "a bigint, b bigint").distinct()


def similar_forest(group: np.ndarray, chunk: np.ndarray, node: np.ndarray, fps: np.ndarray, sets: np.ndarray | None, least: float) -> tuple[np.ndarray, np.ndarray]:
    """``forest`` for nodes with fingerprints and, if given, sets of shingles; compares no pair that is already connected when much is."""
    values, code = np.unique(node, return_inverse=True)
    root, live, d = np.arange(len(values)), np.arange(len(node)), 1
    while len(live):
        live = live[live + d < len(node)]
        live = live[group[live] == group[live + d]]
        ask = live[((chunk[live] == 0) | (chunk[live] != chunk[live + d])) & (root[code[live]] != root[code[np.minimum(live + d, len(node) - 1)]])]
        near = ask[np.bitwise_count(fps[ask] ^ fps[ask + d]).sum(axis=1) <= APART]
        if sets is not None:
            near = near[[jaccard(sets[i], sets[i + d]) >= least for i in near.tolist()]] if len(near) else near
        if len(near):
            root = roots(len(values), np.concatenate([np.arange(len(values)), code[near]]), np.concatenate([root, code[near + d]]))
        d += 1
    moved = np.flatnonzero(root != np.arange(len(values)))
    return values[moved], values[root[moved]]
