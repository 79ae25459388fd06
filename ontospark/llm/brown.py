"""LM scoring: Brown class-based n-grams.

Words belong to classes; a word's probability is that of its class after the class before it,
times that of the word in its class. Classes come from exchange clustering: words move to
the class that fits their neighbours' classes best, many words at a time, half of them in each round.

How it runs: documents become blocks of about ``BLOCK`` bytes of text, each with its own dictionary
and the text as numbers in it. Counts are grouped over the blocks' dictionaries, joined to them on the
word, and the blocks written with the counts beside their dictionaries; after that no word is
shuffled. Words seen ``MIN_COUNT`` times or more are clustered, at every size of corpus, numbered by frequency (so nothing depends on
partitions). Their classes, a byte for each, are broadcast for up to ``MOST`` words; with more they are a table by ranges of words that is
joined to the blocks' dictionaries. When the exchange has ended, one more pass gives each rarer word that occurs ``RARE`` times or more
the class that fits its neighbours best. Words that occur once stand for those never seen: they share a class that follows from their
shape alone. Each round sums the neighbours' classes
of the moving words per task before it shuffles them, packed by ranges of words. A round whose moves together lower the
likelihood of the classes is undone; a round that gains less than a ``GAIN``-th of it, or ``ROUNDS``, ends the exchange.

Tokens: A-Z lower-cased, words without white space (space, \\t to \\r), one end for each document.
Defined cases: null and empty texts are one end token; repeated rows count as often as
they occur; null ids belong to the training part; an empty table gives no row, a training part without
words still scores the others; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, slices, written

BLOCK, CLASSES, SHAPES, ROUNDS, RANGE = 8 << 20, 64, 16, 6, 512
MIN_COUNT, RARE, MOST, GAIN = 20, 2, 1 << 26, 0.002
#: The class before a document's first and after its last word.
EDGE = CLASSES + SHAPES
ALL = EDGE + 1
MOVES_NOT = 255


def packed(x: np.ndarray) -> bytes:
    """The first bytes of all numbers, then the second ones and so on, compressed: high bytes are nearly all zero."""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(planes).tobytes())


def unpacked(data: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)


def tokenize(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(number of each token's word, the distinct words, first token of each text and the end)."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat, doc = pc.list_flatten(split), pc.list_parent_indices(split)
    there = pc.not_equal(flat, "")
    flat, doc = flat.filter(there), doc.filter(there).to_numpy()
    coded = flat.dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary, np.searchsorted(doc, np.arange(len(texts) + 1))


def shape(words: pa.Array) -> np.ndarray:
    """The class of a word by length, letters and signs, 0 to SHAPES - 1."""
    size = pc.binary_length(words).to_numpy()
    plain = pc.string_is_ascii(words).to_numpy(zero_copy_only=False)
    signs = pc.match_substring_regex(words, r"[^\pL]$").to_numpy(zero_copy_only=False)
    return (np.digitize(size, [5, 9, 14]) * 4 + plain * 2 + signs).astype(np.uint8)


BLOCKS = "block bigint, doc_ids array<bigint>, held array<boolean>, starts array<int>, codes binary, shapes binary, words array<string>, seen array<int>, train_docs bigint"


def blocks(docs: DataFrame) -> DataFrame:
    """Rows ``doc_id, text, held`` as blocks; ``seen`` counts each word of the dictionary in the block's training part."""
    ship(docs.sparkSession)
    schema = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("starts", pa.list_(pa.int32())), ("codes", pa.binary()), ("shapes", pa.binary()), ("words", pa.list_(pa.string())), ("seen", pa.list_(pa.int32())), ("train_docs", pa.int64())])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for k, batch in enumerate(slices(batches, "text", BLOCK)):
            codes, words, starts = tokenize(batch.column(1))
            held = batch.column(2).to_numpy(zero_copy_only=False)
            train = np.repeat(~held, np.diff(starts))
            seen = np.bincount(codes[train], minlength=len(words))
            one = lambda x, t: pa.array([x], t)
            yield pa.RecordBatch.from_arrays([
                one((part << 32) + k, pa.int64()), one(batch.column(0).to_pylist(), pa.list_(pa.int64())), one(held.tolist(), pa.list_(pa.bool_())), one(starts.astype(np.int32), pa.list_(pa.int32())),
                one(packed(codes.astype(np.int32)), pa.binary()), one(packed(shape(words)), pa.binary()), pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), one(seen.astype(np.int32), pa.list_(pa.int32())), one(int((~held).sum()), pa.int64()),
            ], schema=schema)

    return docs.select("doc_id", "text", "held").mapInArrow(build, BLOCKS)


RESOLVED = "block bigint, doc_ids array<bigint>, held array<boolean>, starts array<int>, codes binary, counts binary, cand binary, shapes binary"


def resolve(built: DataFrame, vocab: DataFrame) -> DataFrame:
    """Blocks whose dictionaries carry each word's count, its number among the clustered words (or -1) and its shape.

    The join is on the word, a row for each block that has it; the adaptive skew join splits the most frequent words.
    """
    ship(built.sparkSession)
    each = built.select("block", F.posexplode("words").alias("i", "word"))
    # count and number of a word of the training part in one long where they fit: less to shuffle
    top = vocab.agg(F.coalesce(F.max("c"), F.lit(0)).alias("c"), F.coalesce(F.max("cand"), F.lit(0)).alias("n")).first()
    bits = (top.n + 1).bit_length()
    one = bits + top.c.bit_length() < 63
    columns = [(F.shiftleft("c", bits) + F.col("cand") + 1).alias("x")] if one else [F.col("c").alias("x"), "cand"]
    found = each.join(vocab, "word").select(F.col("block").alias("of"), "i", *columns)
    schema = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("starts", pa.list_(pa.int32())), ("codes", pa.binary()), ("counts", pa.binary()), ("cand", pa.binary()), ("shapes", pa.binary())])

    def attach(rows: pa.Table, words: pa.Table) -> pa.Table:
        shapes = rows.column("shapes")[0].as_py()
        x, i = np.zeros(len(unpacked(shapes, np.uint8)), np.int64), words.column("i").to_numpy()
        x[i] = words.column("x").to_numpy()
        if one:
            count, cand = x >> bits, (x & (1 << bits) - 1) - 1
        else:
            count, cand = x, np.full(len(x), -1, np.int64)
            cand[i] = words.column("cand").to_numpy()
        extra = [packed(count), packed(cand.astype(np.int32)), shapes]
        return pa.Table.from_arrays([*(rows.column(n).cast(schema.field(n).type) for n in ("block", "doc_ids", "held", "starts", "codes")), *(pa.array([e], pa.binary()) for e in extra)], schema=schema)

    return built.drop("words", "seen", "train_docs").groupBy("block").cogroup(found.groupBy("of")).applyInArrow(attach, RESOLVED)


def with_candidates(vocab: DataFrame, least: int) -> tuple[DataFrame, int]:
    """``word, c, cand``: words with ``c >= least`` numbered by (count, word) from 0 without gaps, others -1; and how many."""
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranked = vocab.where(F.col("c") >= least).select("word", "c").orderBy(F.desc("c"), "word")  # by ranges, in order of their partitions
    often = written(ranked.select("word", "c", F.spark_partition_id().alias("part"), at.alias("at")), "often")
    sizes = sorted((r.part, r.n) for r in often.groupBy("part").agg(F.count("*").alias("n")).collect())
    rare, first, total = vocab.where(F.col("c") < least).withColumn("cand", F.lit(-1)), [], 0
    for part, n in sizes:
        first.append((part, total))
        total += n
    if not total:
        return rare, 0
    base = F.broadcast(often.sparkSession.createDataFrame(first, "part int, first bigint"))  # one row for each task
    return often.join(base, "part").select("word", "c", (F.col("first") + F.col("at")).cast("int").alias("cand")).unionByName(rare), total


@dataclass
class Classes:
    """The class of each clustered word: ``range, classes`` with ``RANGE`` words a row, and as an array where that is broadcast."""

    table: DataFrame
    array: np.ndarray | None

    @classmethod
    def of(cls, table: DataFrame, words: int, most: int) -> Classes:
        if words > most:
            return cls(table, None)
        array = np.full(words, MOVES_NOT, np.uint8)
        for r in table.collect():  # a byte for each of `most` words at most
            array[r.range * RANGE : r.range * RANGE + len(r.classes)] = np.frombuffer(r.classes, np.uint8)
        return cls(table, array)

    @classmethod
    def start(cls, spark: SparkSession, words: int, most: int) -> Classes:
        """Each of the most frequent words starts a class of its own."""

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in batch.column(0).to_pylist():
                    own = np.full(min(RANGE, words - k * RANGE), MOVES_NOT, np.uint8)
                    if not k:
                        own[:CLASSES] = np.arange(min(CLASSES, words))
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([own.tobytes()], pa.binary())], ["range", "classes"])

        return cls.of(written(spark.range(-(-words // RANGE)).mapInArrow(rows, CLASS_ROWS), "classes"), words, most)

    def each(self) -> DataFrame:
        """``cand, class``, one row for each word."""

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for first, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    yield pa.RecordBatch.from_arrays([pa.array(first * RANGE + np.arange(len(own)), pa.int32()), pa.array(np.frombuffer(own, np.uint8).astype(np.int16))], ["cand", "class"])

        return self.table.mapInArrow(rows, "cand int, class smallint")

    def on(self, resolved: DataFrame) -> tuple[DataFrame, object]:
        """The blocks and the array for them; without an array the classes of a block's dictionary come in its row."""
        if self.array is not None:
            return resolved, resolved.sparkSession.sparkContext.broadcast(self.array)

        def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block, cand in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    cand = unpacked(cand, np.int32)
                    i = np.flatnonzero(cand >= 0)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), block)), pa.array(i.astype(np.int32)), pa.array(cand[i])], ["of", "i", "cand"])

        def attach(rows: pa.Table, words: pa.Table) -> pa.Table:
            own = np.full(len(unpacked(rows.column("cand")[0].as_py(), np.int32)), MOVES_NOT, np.uint8)
            own[words.column("i").to_numpy()] = words.column("class").to_numpy()
            return rows.append_column("classes", pa.array([packed(own)], pa.binary()))

        found = resolved.select("block", "cand").mapInArrow(words, "of bigint, i int, cand int").join(self.each(), "cand").select("of", "i", "class")
        return resolved.groupBy("block").cogroup(found.groupBy("of")).applyInArrow(attach, RESOLVED + ", classes binary"), None


CLASS_ROWS = "range int, classes binary"


def likelihood(pairs: np.ndarray) -> float:
    """What the choice of classes adds to the log likelihood of the training part."""
    n = pairs.sum(axis=1).astype(float)
    p = pairs[pairs > 0].astype(float)
    return float((p * np.log(p)).sum() - 2 * (n[n > 0] * np.log(n[n > 0])).sum())


def classes_of(cand: np.ndarray, shapes: np.ndarray, given: np.ndarray) -> np.ndarray:
    """The class of each word of a dictionary; ``given``: of the first numbered words."""
    has = (cand >= 0) & (cand < len(given))
    own = np.full(len(cand), MOVES_NOT)
    own[has] = given[cand[has]]
    return settled(shapes, own)


def settled(shapes: np.ndarray, given: np.ndarray) -> np.ndarray:
    """The given classes, and the shape's where a word has none."""
    return np.where(given != MOVES_NOT, given, CLASSES + shapes.astype(np.int64)).astype(np.int64)


def with_edges(codes: np.ndarray, starts: np.ndarray, keep: np.ndarray) -> np.ndarray:
    """The kept documents' codes, -1 before, between and after them."""
    sizes = np.diff(starts)
    codes = codes[np.repeat(keep, sizes)]
    ends = np.cumsum(sizes[keep])
    return np.insert(codes, np.concatenate([[0], ends]), -1)


def _parts(batch: pa.RecordBatch, given) -> Iterator[tuple]:
    """Row, held documents, starts, codes, numbers of the clustered words and classes of the dictionary."""
    for r in batch.to_pylist():
        cand, shapes = unpacked(r["cand"], np.int32), unpacked(r["shapes"], np.uint8)
        own = classes_of(cand, shapes, given.value) if given is not None else settled(shapes, unpacked(r["classes"], np.uint8))
        yield r, np.array(r["held"], bool), np.array(r["starts"]), unpacked(r["codes"], np.int32), cand, own


def transitions(resolved: DataFrame, classes: Classes) -> np.ndarray:
    """Counts of class pairs over the training part, ALL × ALL."""
    blocks, given = classes.on(resolved)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(ALL * ALL, np.int64)
        for batch in batches:
            for _, held, starts, codes, _, own in _parts(batch, given):
                c = np.append(own, EDGE)[with_edges(codes, starts, ~held)]
                total += np.bincount(c[:-1] * ALL + c[1:], minlength=ALL * ALL)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], ["pair", "n"])

    out = np.zeros(ALL * ALL, np.int64)
    for r in blocks.mapInArrow(count, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).collect():  # ALL² rows at most
        out[r.pair] = r.n
    return out.reshape(ALL, ALL)


def exchange(resolved: DataFrame, classes: Classes, pairs: np.ndarray, turn: int, words: int, most: int = MOST, first_moving: int = 0) -> Classes:
    """One round: the clustered words of this turn go to the class that makes their neighbours likeliest.

    ``words`` have numbers below it; those below ``first_moving`` stay. Words that the table of classes doesn't have yet are added to it.

    A word's gain in class k is sum L[c] log N(c,k) + sum R[c] log N(k,c) - 2 n log N(k), with the word taken
    out of its own class: the exchange criterion with all other words where they are.
    """
    blocks, given = classes.on(resolved)
    side = 2 * ALL

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sums, held_rows = [], [], 0

        def merge() -> tuple[np.ndarray, np.ndarray]:
            k, inverse = np.unique(np.concatenate(keys), return_inverse=True)
            return k, np.bincount(inverse, np.concatenate(sums)).astype(np.int64)

        for batch in batches:
            for _, held, starts, codes, cand, own in _parts(batch, given):
                code = with_edges(codes, starts, ~held)
                c, w = np.append(own, EDGE)[code], np.append(np.where((cand >= first_moving) & (cand < words), cand, -1), -1)[code].astype(np.int64)
                if turn:
                    w = np.where(mixed(w) % 2 == turn % 2, w, -1)
                left, right = w[1:] >= 0, w[:-1] >= 0
                k = np.concatenate([w[1:][left] * side + c[:-1][left], w[:-1][right] * side + ALL + c[1:][right]])
                k, n = np.unique(k, return_counts=True)
                keys.append(k)
                sums.append(n)
                held_rows += len(k)
                if held_rows > 1 << 23:
                    k, n = merge()
                    keys, sums, held_rows = [k], [n], len(k)
        if not keys:
            return
        k, n = merge()
        edges = np.flatnonzero(np.diff(k // (side * RANGE), prepend=-1)) if len(k) else []
        for i, j in zip(edges, [*edges[1:], len(k)], strict=True):
            first = int(k[i]) // (side * RANGE)
            yield pa.RecordBatch.from_arrays([pa.array([first], pa.int32()), pa.array([packed(np.diff(k[i:j], prepend=first * side * RANGE).astype(np.int32))], pa.binary()), pa.array([packed(n[i:j].astype(np.int32))], pa.binary())], ["range", "keys", "sums"])

    near = np.log(pairs[:CLASSES].astype(float) + 0.5), np.log(pairs[:, :CLASSES].astype(float) + 0.5)
    size = np.log(pairs[:CLASSES].sum(axis=1) + 0.5 * ALL)

    def settle(first: int, before: bytes | None, counts: np.ndarray) -> pa.RecordBatch:
        before = np.frombuffer(before or b"", np.uint8)
        own = np.full(min(RANGE, words - first * RANGE), MOVES_NOT, np.uint8)
        own[: len(before)] = before
        counts = counts[: len(own)]
        left, right = counts[:, :ALL].astype(float), counts[:, ALL:].astype(float)
        n = left.sum(axis=1)
        moving = np.flatnonzero(n)
        score = left[moving] @ near[1] + right[moving] @ near[0].T - 2 * n[moving, None] * size
        now = own[moving]
        for j in np.flatnonzero(now != MOVES_NOT):  # without the word itself in its class
            a = int(now[j])
            l, r = left[moving[j]], right[moving[j]]
            into, out = np.log(np.maximum(pairs[:, a] - l, 0) + 0.5), np.log(np.maximum(pairs[a] - r, 0) + 0.5)
            score[j, a] = l @ into + r @ out - 2 * n[moving[j]] * math.log(max(pairs[a].sum() - n[moving[j]], 0) + 0.5 * ALL)
        own[moving] = np.argmax(score, axis=1)
        return pa.RecordBatch.from_arrays([pa.array([first], pa.int32()), pa.array([own.tobytes()], pa.binary())], ["range", "classes"])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, before, counts = None, None, None
        for batch in batches:
            for first, now, k, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if first != at:
                    if at is not None:
                        yield settle(at, before, counts.reshape(RANGE, side))
                    at, before, counts = first, now, np.zeros(RANGE * side, np.int64)
                if k is not None:
                    counts[np.cumsum(unpacked(k, np.int32), dtype=np.int64)] += unpacked(n, np.int32)
        if at is not None:
            yield settle(at, before, counts.reshape(RANGE, side))

    sent = blocks.mapInArrow(gather, "range int, keys binary, sums binary")
    table = classes.table
    if first_moving:
        table = table.sparkSession.range(-(-words // RANGE)).select(F.col("id").cast("int").alias("range")).join(table, "range", "left")
    met = table.join(sent, "range", "left").select("range", "classes", "keys", "sums").repartition("range").sortWithinPartitions("range")
    return Classes.of(written(met.mapInArrow(assign, CLASS_ROWS), "classes"), words, most)


def mixed(w: np.ndarray) -> np.ndarray:
    return (w.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64)


@dataclass
class ClassModel:
    """log10 of transitions; of each class: occurrences, words, discount."""

    trans: np.ndarray
    occurrences: np.ndarray
    types: np.ndarray
    discount: np.ndarray
    tokens: int
    words: int
    ends: int

    def emission(self, counts: np.ndarray, own: np.ndarray) -> np.ndarray:
        """log10 of each dictionary word in its class. Words of a shape that were never seen are one word, which gets what discounting leaves."""
        total = np.maximum(self.occurrences[own], 1e-9)
        left = np.where(self.types[own] > 0, self.discount[own] * self.types[own] / total, 1.0)
        return np.log10(np.maximum(np.where(counts > 0, np.maximum(counts - self.discount[own], 1e-9) / total, left), 1e-300))

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 1.0) / (self.tokens + self.words + 1.0))


def class_model(vocab: DataFrame, classes: Classes, pairs: np.ndarray, tokens: int, words: int, ends: int) -> ClassModel:
    given = None if classes.array is None else vocab.sparkSession.sparkContext.broadcast(classes.array)
    named = vocab.select("word", "c", F.col("cand").alias("x"))
    if given is None:
        named = vocab.join(classes.each().hint("merge"), "cand", "left").select("word", "c", F.coalesce("class", F.lit(MOVES_NOT)).cast("int").alias("x"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((ALL, 4), np.int64)
        for batch in batches:
            c, x, shapes = batch.column(1).to_numpy(), batch.column(2).to_numpy(), shape(batch.column(0))
            own = settled(shapes, x) if given is None else classes_of(x, shapes, given.value)
            for k, n in enumerate((c, np.ones_like(c), c == 1, c == 2)):
                sums[:, k] += np.bincount(own, n, minlength=ALL).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(ALL)), *(pa.array(x) for x in sums.T)], ["class", "c", "types", "ones", "twos"])

    rows = named.mapInArrow(count, "class bigint, c bigint, types bigint, ones bigint, twos bigint")
    sums = np.zeros((ALL, 4))
    for r in rows.groupBy("class").agg(*(F.sum(x).alias(x) for x in ("c", "types", "ones", "twos"))).collect():
        sums[r["class"]] = r.c, r.types, r.ones, r.twos
    discount = np.where(sums[:, 2] > 0, sums[:, 2] / np.maximum(sums[:, 2] + 2 * sums[:, 3], 1), 0.5)
    discount = np.clip(discount, 0.1, 0.9)
    discount[:CLASSES] = 0  # no unseen word belongs to these
    sums[EDGE] = ends, 1, 0, 0
    discount[EDGE] = 0
    n = pairs.sum(axis=1, keepdims=True).astype(float)
    follow = (pairs > 0).sum(axis=1, keepdims=True)
    alone = (pairs.sum(axis=0) + 1.0) / (pairs.sum() + ALL)
    trans = (pairs + np.maximum(follow, 1) * alone) / (n + np.maximum(follow, 1))  # Witten-Bell
    return ClassModel(np.log10(trans), sums[:, 0], sums[:, 1], discount, tokens, words, ends)


SCORED = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def scores(resolved: DataFrame, classes: Classes, model: ClassModel) -> DataFrame:
    blocks, given = classes.on(resolved)
    told = resolved.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = told.value
        end_base = float(m.base(np.array([m.ends]))[0])
        for batch in batches:
            for r, held, starts, codes, _, own in _parts(batch, given):
                counts = unpacked(r["counts"], np.int64)
                emit, base = np.append(m.emission(counts, own), 0.0), np.append(m.base(counts), end_base)
                known, own = np.append(counts > 0, m.ends > 0), np.append(own, EDGE)
                code = with_edges(codes, starts, np.ones(len(held), bool))
                c = own[code]
                # the first edge is no token; every later one is the end of a document
                each = m.trans[c[:-1], c[1:]] + emit[code[1:]]
                first = starts[:-1] + np.arange(len(held))
                sums = [np.add.reduceat(x, first) for x in (each, base[code[1:]], known[code[1:]].astype(np.int64))]
                yield pa.RecordBatch.from_arrays([pa.array(r["doc_ids"], pa.int64()), pa.array(held), pa.array(np.diff(starts).astype(np.int64) + 1), pa.array(sums[2]), pa.array(np.full(len(held), m.tokens)), pa.array(sums[1]), pa.array(sums[0])], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return blocks.mapInArrow(score, SCORED)


@dataclass
class Fitted:
    """Blocks, ``word, c, cand`` of the training part, the classes and the model made of them."""

    resolved: DataFrame
    vocab: DataFrame
    classes: Classes
    model: ClassModel


def fit(docs: DataFrame, held_out, rounds: int = ROUNDS, min_count: int = MIN_COUNT, most: int = MOST) -> Fitted:
    """Classes and model of the documents of ``doc_id, text`` where the column ``held_out`` is false."""
    built = written(blocks(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out.alias("held"))), "blocks", "zstd")
    each = built.select(F.explode(F.arrays_zip("words", "seen")).alias("x")).select(F.col("x.words").alias("word"), F.col("x.seen").cast("long").alias("n")).where("n > 0")
    vocab = written(each.groupBy("word").agg(F.sum("n").alias("c")), "vocabulary")
    sums = vocab.agg(F.count("*").alias("v"), F.coalesce(F.sum("c"), F.lit(0)).alias("n")).first()
    ends = built.agg(F.coalesce(F.sum("train_docs"), F.lit(0)).alias("n")).first().n
    tokens, words = sums.n + ends, sums.v + (ends > 0)
    clustered = vocab.where(F.col("c") >= min_count).count()
    vocab, numbered = with_candidates(vocab, min(RARE, min_count) if clustered else min_count)
    resolved = written(resolve(built, vocab), "resolved", "none")
    classes = Classes.start(docs.sparkSession, clustered, most)
    pairs = transitions(resolved, classes)
    for turn in range(rounds if clustered else 0):
        moved = exchange(resolved, classes, pairs, turn, clustered, most)
        after = transitions(resolved, moved)
        gain = likelihood(after) - likelihood(pairs)
        if gain > 0:
            classes, pairs = moved, after
        if turn and abs(gain) < GAIN * abs(likelihood(pairs)):
            break
    if numbered > clustered:
        classes = exchange(resolved, classes, pairs, 0, numbered, most, first_moving=clustered)
        pairs = transitions(resolved, classes)
    return Fitted(resolved, vocab, classes, class_model(vocab, classes, pairs, tokens, words, ends))


def score_documents(docs: DataFrame, held_out, rounds: int = ROUNDS, min_count: int = MIN_COUNT, most: int = MOST) -> DataFrame:
    """Every document of ``doc_id, text`` scored by a model of those where the column ``held_out`` is false."""
    done = fit(docs, held_out, rounds, min_count, most)
    return scores(done.resolved, done.classes, done.model)
