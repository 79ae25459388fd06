"""Ranked lexical search by dual trees.

Terms are maximal runs of ASCII letters and digits and of all characters beyond ASCII, A-Z lower-cased. A document's score for an item
is the sum over the item's terms, repeats included, of a term weight times a saturated term frequency, all in integers (``weights``,
``saturated``). So an item is a sparse vector of weights, a document one of frequencies, and the score is their product: the search is for
the largest products.

Items make a hierarchy, and the documents of a task make trees of ``TREE`` documents; both are sorted so that vectors with the same heaviest
term lie together. A node holds the maximum of each coordinate over what lies below it. The product of two nodes' maxima bounds every
score between them, so a pair of nodes is left alone, exactly, if its bound is below the weakest kth score among the node's items (or
equals it, while no document below has a smaller id than that item's kth). Pairs that stay go on to their children, and
single items meet leaves of ``LEAF`` documents, whose scores are computed.

Items come in blocks of ``BLOCK_TERMS`` terms at most (or one item), so what a task holds of them is bounded; each block is searched against
all documents. Documents are read once a block, into vectors over the block's terms, which are written. Kth scores of a first search over
one in ``SEED`` documents are lower bounds for the search over all: they only save work, and keep what a task hands on to about k rows an item.

Defined cases: a null text has no term, and neither have some others: those documents count for nothing; a document without an item's terms isn't
found by it; repeated rows are documents of their own; null ids come after all others at equal scores; an item without terms, an empty
table of items or of documents gives no row; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ship, slices, written

#: Distinct terms of a block's items, summed over items.
BLOCK_TERMS = 1 << 18
#: Documents of a tree and of its leaves, and children of a node.
TREE, LEAF, FAN = 1 << 14, 64, 8
#: The first search takes one in so many documents.
SEED = 64
#: Bytes of text that a task handles at once.
SLICE = 8 << 20
LAST = 2**63 - 1

_KEEP = b"0123456789abcdefghijklmnopqrstuvwxyz"
_TABLE = bytes(c if c >= 128 else ord(chr(c).lower()) if ord(chr(c).lower()) in _KEEP else 32 for c in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8. Bytes of characters beyond ASCII are all 128 or more, so they stay together."""
    return text.translate(_TABLE).split()


def weights(df: np.ndarray, n: int) -> np.ndarray:
    """floor(1000 ln((2N + 2) / (2 df + 1))) for terms found in df of N documents."""
    return np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(x) + 1))) for x in df], dtype=np.int64)


def saturated(tf: np.ndarray, lengths: np.ndarray, n: int, total: int) -> np.ndarray:
    """(10^9 tf) div (1000 tf + 8 m), where m = 25 + (75 · length · N) div (all terms)."""
    if len(lengths) and 75 * int(lengths.max()) * n >= 2**62:
        m = np.array([25 + 75 * int(x) * n // total for x in lengths], dtype=np.int64)
    else:
        m = 25 + 75 * lengths * n // max(total, 1)
    return 10**9 * tf // (1000 * tf + 8 * m)


class Sparse(NamedTuple):
    """Rows of sparse vectors: row i has ``terms[at[i]:at[i + 1]]`` and ``values`` there."""

    at: np.ndarray
    terms: np.ndarray
    values: np.ndarray

    def rows(self, order: np.ndarray) -> Sparse:
        size = np.diff(self.at)[order]
        at = np.concatenate([[0], np.cumsum(size)])
        take = np.arange(at[-1]) - np.repeat(at[:-1], size) + np.repeat(self.at[:-1][order], size)
        return Sparse(at, self.terms[take], self.values[take])

    def maxima(self, fan: int) -> Sparse:
        """The coordinate maxima of each run of ``fan`` rows."""
        n = len(self.at) - 1
        group = np.repeat(np.arange(n) // fan, np.diff(self.at))
        order = np.lexsort((self.terms, group))
        group, terms, values = group[order], self.terms[order], self.values[order]
        new = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (terms[1:] != terms[:-1])])) if len(terms) else np.zeros(0, dtype=np.int64)
        values = np.maximum.reduceat(values, new) if len(new) else values
        at = np.searchsorted(group[new], np.arange(-(-n // fan) + 1))
        return Sparse(at, terms[new], values)

    def times(self, dense: np.ndarray) -> np.ndarray:
        """The product of each row with a dense vector."""
        sums = np.concatenate([[0], np.cumsum(self.values * dense[self.terms])])
        return sums[self.at[1:]] - sums[self.at[:-1]]


def by_heaviest(rows: Sparse, worth: np.ndarray) -> np.ndarray:
    """An order in which rows with the same heaviest term, by value times ``worth``, lie together, the heavier first."""
    n = len(rows.at) - 1
    weight = rows.values * worth[rows.terms]
    group = np.repeat(np.arange(n), np.diff(rows.at))
    order = np.lexsort((-weight, group))
    first = order[np.minimum(rows.at[:-1], max(len(order) - 1, 0))] if len(order) else np.zeros(n, dtype=np.int64)
    some = np.diff(rows.at) > 0
    return np.lexsort((np.where(some, -weight[first], 0), np.where(some, rows.terms[first], -1))) if len(order) else np.arange(n)


def levels_of(rows: Sparse, first: int) -> list[Sparse]:
    """The hierarchy over rows: runs of ``first``, then of ``FAN`` nodes, up to one node; lowest nodes first."""
    out = [rows.maxima(first)]
    while len(out[-1].at) > 2:
        out.append(out[-1].maxima(FAN))
    return out


class Items(NamedTuple):
    """A block's items as a task has them: ids, vectors and the levels above them, and the terms' numbers."""

    ids: list
    rows: Sparse
    levels: list[Sparse]
    size: int


def item_tree(ids: list, counts: list[dict[int, int]], weight: np.ndarray) -> Items:
    at = np.concatenate([[0], np.cumsum([len(c) for c in counts])]).astype(np.int64)
    terms = np.array([t for c in counts for t in sorted(c)], dtype=np.int64)
    times = np.array([c[t] for c in counts for t in sorted(c)], dtype=np.int64)
    rows = Sparse(at, terms, times * weight[terms])
    order = by_heaviest(rows, np.ones(len(weight), dtype=np.int64))
    rows = rows.rows(order)
    return Items([ids[i] for i in order], rows, levels_of(rows, FAN), len(weight))


class Search:
    """The k best documents so far for each item of a block; trees of documents are added one after the other."""

    def __init__(self, items: Items, k: int, least: np.ndarray | None) -> None:
        n = len(items.ids)
        self.items, self.k = items, k
        self.best: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]
        # the kth score and id of each item so far: what is not above it can't be among the k best
        self.score = np.zeros(n, dtype=np.int64) if least is None else least.copy()
        self.key = np.full(n, LAST, dtype=np.int64)
        if least is not None:
            self.score -= 1  # equal scores still count
            self.score = np.maximum(self.score, 0)
        self.pairs = self.scored = 0

    def add(self, keys: np.ndarray, docs: Sparse) -> None:
        """A tree of documents; ``keys`` order those of equal scores."""
        worth = np.zeros(self.items.size, dtype=np.int64)
        for level in self.items.levels[-1:]:
            worth[level.terms] = level.values
        order = by_heaviest(docs, worth)
        self.docs, self.keys = docs.rows(order), keys[order]
        self.tree = levels_of(self.docs, LEAF)
        self.least = [np.minimum.reduceat(self.keys, np.arange(0, len(keys), LEAF))]
        while len(self.least) < len(self.tree):
            self.least.append(np.minimum.reduceat(self.least[-1], np.arange(0, len(self.least[-1]), FAN)))
        self._visit(len(self.tree) - 1, 0, len(self.items.levels) - 1, np.zeros(1, dtype=np.int64))

    def _open(self, bound: np.ndarray, nodes: np.ndarray, height: int, first: int) -> np.ndarray:
        """The item nodes (single items at height -1) that a document node with these bounds may still change."""
        if height < 0:
            score, key = self.score[nodes], self.key[nodes]
            return nodes[(bound > score) | ((bound == score) & (bound > 0) & (first < key))]
        width = FAN ** (height + 1)
        stay = [b > 0 and bool(((b > self.score[x * width : (x + 1) * width]) | ((b == self.score[x * width : (x + 1) * width]) & (first < self.key[x * width : (x + 1) * width]))).any()) for x, b in zip(nodes, bound, strict=True)]
        return nodes[np.array(stay, dtype=bool)]

    def _visit(self, height: int, node: int, above: int, nodes: np.ndarray) -> None:
        """Document ``node`` of a level against item ``nodes`` of another."""
        docs = self.tree[height]
        dense = np.zeros(self.items.size, dtype=np.int64)
        part = slice(docs.at[node], docs.at[node + 1])
        dense[docs.terms[part]] = docs.values[part]
        first = int(self.least[height][node])
        while True:
            level = self.items.rows if above < 0 else self.items.levels[above]
            self.pairs += len(nodes)
            nodes = self._open(level.rows(nodes).times(dense), nodes, above, first)
            if not len(nodes) or above < 0:
                break
            # both go down together, but at the documents' leaves the items go down to single ones
            below = self.items.rows if above == 0 else self.items.levels[above - 1]
            nodes = (nodes[:, None] * FAN + np.arange(FAN)).ravel()
            nodes, above = nodes[nodes < len(below.at) - 1], above - 1
            if height > 0:
                break
        if not len(nodes):
            return
        if height == 0:
            self._score(node, nodes)
        else:
            last = len(self.tree[height - 1].at) - 1
            for child in range(node * FAN, min((node + 1) * FAN, last)):
                self._visit(height - 1, child, above, nodes)

    def _score(self, leaf: int, items: np.ndarray) -> None:
        rows = np.arange(leaf * LEAF, min((leaf + 1) * LEAF, len(self.keys)))
        docs = Sparse(self.docs.at[rows[0] : rows[-1] + 2] - self.docs.at[rows[0]], *(x[self.docs.at[rows[0]] : self.docs.at[rows[-1] + 1]] for x in (self.docs.terms, self.docs.values)))
        keys, dense = self.keys[rows], np.zeros(self.items.size, dtype=np.int64)
        for i in items:
            part = slice(self.items.rows.at[i], self.items.rows.at[i + 1])
            dense[self.items.rows.terms[part]] = self.items.rows.values[part]
            scores = docs.times(dense)
            dense[self.items.rows.terms[part]] = 0
            self.scored += len(rows)
            for j in np.flatnonzero((scores > self.score[i]) | ((scores == self.score[i]) & (scores > 0) & (keys < self.key[i]))):
                self._put(int(i), int(scores[j]), int(keys[j]))

    def _put(self, i: int, score: int, key: int) -> None:
        best = self.best[i]
        heapq.heappush(best, (score, -key))
        if len(best) > self.k:
            heapq.heappop(best)
        if len(best) == self.k:
            self.score[i], self.key[i] = best[0][0], -best[0][1]

    def found(self) -> pa.RecordBatch:
        rows = [(x, score, -key) for x, best in zip(self.items.ids, self.best, strict=True) for score, key in best]
        return pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([None if r[2] == LAST else r[2] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], ["item", "doc_id", "score"])


def _vectors(numbers: dict[bytes, int]) -> Callable:
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            ids, lengths, terms, times = [], [], [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                words = terms_of(text.as_buffer().to_pybytes() if text.is_valid else b"")
                if not words:
                    continue
                counts = Counter(x for x in map(numbers.get, words) if x is not None)
                ids.append(doc)
                lengths.append(len(words))
                terms.append(list(counts))
                times.append(list(counts.values()))
            yield pa.record_batch(
                [pa.array(ids, pa.int64()), pa.array(lengths, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int32()))], ["doc_id", "length", "terms", "times"]
            )

    return make


def _searcher(items: Items, k: int, n: int, total: int, least: np.ndarray | None) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, held, size = Search(items, k, least), [], 0

        def add() -> None:
            t = pa.Table.from_batches(held).combine_chunks()
            terms, times = (t[c].combine_chunks() for c in ("terms", "times"))
            terms, times = (x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in (terms, times))
            at = terms.offsets.to_numpy().astype(np.int64)
            flat, tf = terms.values.to_numpy()[at[0] : at[-1]].astype(np.int64), times.values.to_numpy()[times.offsets[0].as_py() : times.offsets[-1].as_py()].astype(np.int64)
            lengths = np.repeat(t["length"].to_numpy(), np.diff(at))
            search.add(t["doc_id"].fill_null(LAST).to_numpy(), Sparse(at - at[0], flat, saturated(tf, lengths, n, total)))

        for batch in batches:
            for start in range(0, batch.num_rows, TREE):
                part = batch.slice(start, TREE)
                held.append(part)
                size += part.num_rows
                if size >= TREE:
                    add()
                    held, size = [], 0
        if size:
            add()
        yield search.found()

    return run


def _blocks(items: DataFrame, most: int) -> list[tuple[list, list[list[bytes]]]]:
    """Items with terms, in blocks of so many terms at most (or one item): each is read by itself, so the driver holds one."""
    size = F.size(F.split("text", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")).cast("bigint")
    sized = written(items.where("text IS NOT NULL").select("item_id", "text", size.alias("size")), "items")
    total = sized.agg(F.sum("size").alias("n")).first().n or 0
    parts = max(1, -(-int(total) // most))
    for part in range(parts):
        # dealt by hash: about ``most`` terms in each, whatever their order
        rows = sized.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).select("item_id", "text").collect()
        yield [r.item_id for r in rows], [terms_of(r.text.encode()) for r in rows]


def search(docs: DataFrame, items: DataFrame, k: int = 10, most: int = BLOCK_TERMS, seed: int = SEED) -> DataFrame:
    """``item_id, rank, doc_id, score``: the k documents of the highest scores above 0 for each item, equal scores by ascending id."""
    spark = docs.sparkSession
    ship(spark)
    found = None
    for ids, words in _blocks(items, most):
        numbers = {t: i for i, t in enumerate(sorted({w for ws in words for w in ws}))}
        vectors = written(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(_vectors(numbers), "doc_id bigint, length bigint, terms array<int>, times array<int>"), "vectors")
        whole = vectors.agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("total")).first()
        held = dict(vectors.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect())  # a number for each term of the block
        weight = weights(np.array([held.get(i, 0) for i in range(len(numbers))]), whole.n)
        tree = item_tree(list(range(len(ids))), [Counter(numbers[w] for w in ws) for ws in words], weight)
        some = vectors.where(F.size("terms") > 0)
        schema = "item bigint, doc_id bigint, score bigint"
        best = lambda rows: rows.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))).where(F.col("rank") <= k)
        tenth = some.where(F.pmod(F.xxhash64("doc_id", "length"), F.lit(seed)) == 0).mapInArrow(_searcher(tree, k, whole.n, whole.total, None), schema)
        at_least = dict(best(tenth).where(F.col("rank") == k).select("item", "score").collect())  # a number for each item of the block
        least = np.array([at_least.get(i, 0) for i in tree.ids], dtype=np.int64)
        names = spark.createDataFrame(list(enumerate(ids)), "item bigint, item_id bigint")
        rows = best(some.mapInArrow(_searcher(tree, k, whole.n, whole.total, least), schema))
        one = written(rows.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"), "ranked")
        found = one if found is None else found.unionByName(one)
    return found
