"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are words (lower case, ``\\w+``). Windows of ``least`` words that a document shares with an
item are seeds; an item whose words shared seeds can't cover up to the threshold is passed over. For each other
(document, item) the longest common unmarked run is found by running Karp-Rabin hashes (a search over its length), all its matches are marked,
first places first, and so on with shorter runs until none of ``least`` words is left. The part of the
item's words that is marked is its coverage, which catches passages in another order. Memory is linear in a document and
an item, however often their words repeat: matches of one length pair up in order, no table of all pairs of places is made.

Items go to the tasks with the plan's closure if their text takes ``BROADCAST`` bytes at most
(measured first); the documents are then read once and not shuffled at all. A larger benchmark is
joined on the hashes of its seeds: of each item as many of its most frequent seeds are left out as can't reach the threshold alone, pairs whose
seeds can't reach it go, and only then texts meet, ``TOGETHER`` items at a time.

Defined cases: null and empty texts and items without words match nothing; an item of fewer
words than ``least`` must occur whole; equal items are all reported; ties of
matches of one length go to the first place in the document, then in the item; empty tables give no row; all
columns of the documents are kept, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ship, slices, written

LEAST, THRESHOLD = 5, 0.8
BROADCAST, TOGETHER = 16 << 20, 64
BASE, INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
words = re.compile(r"\w+").findall
LEAKS = "array<struct<item_id:bigint,matched:int,item_words:int,coverage:double,tiles:array<struct<doc_at:int,item_at:int,length:int>>>>"
KIND = pa.list_(pa.struct([("item_id", pa.int64()), ("matched", pa.int32()), ("item_words", pa.int32()), ("coverage", pa.float64()), ("tiles", pa.list_(pa.struct([("doc_at", pa.int32()), ("item_at", pa.int32()), ("length", pa.int32())])))]))


class Running:
    """Karp-Rabin hashes of all windows of any width, by prefix sums modulo 2^64."""

    def __init__(self, ids: np.ndarray) -> None:
        n = len(ids)
        powers = np.full(n + 1, np.uint64(BASE))
        back = np.full(n + 1, np.uint64(INVERSE))
        powers[0] = back[0] = 1
        self.powers, back = np.cumprod(powers, dtype=np.uint64), np.cumprod(back, dtype=np.uint64)
        x = (ids.astype(np.uint64) ^ (ids.astype(np.uint64) >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * back[:n], dtype=np.uint64)])

    def windows(self, width: int) -> np.ndarray:
        n = max(0, len(self.sums) - width)
        return (self.sums[width : width + n] - self.sums[:n]) * self.powers[:n]


def running(ids: np.ndarray, width: int) -> np.ndarray:
    return Running(ids).windows(width)


def free_windows(free: np.ndarray, width: int) -> np.ndarray:
    """Where windows without a marked word begin."""
    taken = np.concatenate([[0], np.cumsum(~free)])
    return np.flatnonzero(taken[width:] == taken[: max(0, len(taken) - width)])


def tile(doc: np.ndarray, item: np.ndarray, width: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (document place, item place, length) of ``width`` words or more, for words as numbers."""
    rd, ri = Running(doc), Running(item)
    free_d, free_i, tiles = np.ones(len(doc), bool), np.ones(len(item), bool), []

    def common(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        d, i = free_windows(free_d, n), free_windows(free_i, n)
        if not len(d) or not len(i):
            return None
        hd, hi = rd.windows(n)[d], ri.windows(n)[i]
        d_in, i_in = np.isin(hd, hi), np.isin(hi, hd)
        return (d[d_in], hd[d_in], i[i_in], hi[i_in]) if d_in.any() else None

    limit = min(len(doc), len(item))
    while limit >= width and (shared := common(width)):
        low, high, size = width, limit, limit
        while low <= high:  # the longest length with a common run; tries the whole item first
            if found := common(size):
                low, shared, best = size + 1, found, size
            else:
                high = size - 1
            size = (low + high) // 2
        if low == width:
            best = width
        d, hd, i, hi = shared
        order = np.argsort(hi, kind="stable")
        keys, first = np.unique(hi[order], return_index=True)
        lists, last = dict(zip(keys.tolist(), np.split(i[order], first[1:]), strict=True)), 0
        at = dict.fromkeys(lists, 0)
        for a, h in zip(d.tolist(), hd.tolist(), strict=True):
            if a < last:
                continue
            own, k = lists[h], at[h]
            while k < len(own) and not (free_i[own[k] : own[k] + best].all() and (item[own[k] : own[k] + best] == doc[a : a + best]).all()):
                k += 1
            at[h] = k
            if k < len(own):
                b = int(own[k])
                tiles.append((a, b, best))
                free_d[a : a + best] = free_i[b : b + best] = False
                last = a + best
        limit = best - 1
    return sorted(tiles)


def dilated(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n words lie in windows that begin at ``starts``."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + width, -1)
    return np.cumsum(edges[:-1]) > 0


class Items:
    """The benchmark's seeds: of each width the distinct hashes, and which items have which."""

    def __init__(self, items: list[tuple[int, str | None]], least: int) -> None:
        self.least, self.codes, self.items, self.seeds = least, {}, [], {}
        for item_id, text in items:
            ids = np.array([self.codes.setdefault(w, len(self.codes) + 1) for w in words((text or "").lower())], np.int64)
            if len(ids):
                self.items.append((item_id, ids))
        for width in {min(least, len(ids)) for _, ids in self.items}:
            of = [k for k, (_, ids) in enumerate(self.items) if min(least, len(ids)) == width]
            each = [running(self.items[k][1], width) for k in of]
            hashes, code = np.unique(np.concatenate(each), return_inverse=True)
            own = dict(zip(of, np.split(code, np.cumsum([len(x) for x in each])[:-1]), strict=True))  # of each window its hash's number
            pairs = np.unique(np.concatenate([np.stack([np.unique(c), np.full(len(np.unique(c)), k)]) for k, c in own.items()], axis=1), axis=1)
            seen = np.zeros(1 << 20, bool)
            seen[(hashes >> np.uint64(44)).astype(np.int64)] = True
            self.seeds[width] = hashes, own, np.searchsorted(pairs[0], np.arange(len(hashes) + 1)), pairs[1], seen

    def leaks(self, texts: list[str | None], threshold: float) -> list[list[dict]]:
        """The items that each text holds at ``threshold`` or more."""
        out: list[list[dict]] = [[] for _ in texts]
        get = self.codes.get
        each = [[get(w, 0) for w in words(t.lower())] if t else [] for t in texts]
        starts = np.cumsum([0, *(len(x) + 1 for x in each)])
        ids = np.zeros(int(starts[-1]), np.int64)  # 0, which no item has, stands between documents and for other words
        for s, x in zip(starts, each, strict=False):
            ids[s : s + len(x)] = x
        rolling = Running(ids)
        for width, (hashes, own, first, having, seen) in self.seeds.items():
            h = rolling.windows(width)
            hit = np.flatnonzero(seen[(h >> np.uint64(44)).astype(np.int64)])
            k = np.minimum(np.searchsorted(hashes, h[hit]), len(hashes) - 1)
            same = hashes[k] == h[hit]
            hit, k = hit[same], k[same]
            if not len(hit):
                continue
            doc = np.searchsorted(starts, hit, "right") - 1
            edges = np.flatnonzero(np.diff(doc, prepend=-1))
            shared = np.zeros(len(hashes), bool)
            for i, j in zip(edges, [*edges[1:], len(hit)], strict=True):
                mine, begin = np.unique(k[i:j]), int(starts[doc[i]])
                shared[mine] = True
                for item in np.unique(np.concatenate([having[first[x] : first[x + 1]] for x in mine])).tolist():
                    item_id, theirs = self.items[item]
                    need = threshold * len(theirs) if len(theirs) >= self.least else len(theirs)
                    if dilated(np.flatnonzero(shared[own[item]]), width, len(theirs)).sum() < need:
                        continue
                    ours = np.zeros(len(hashes), bool)
                    ours[own[item]] = True
                    at = np.flatnonzero(dilated(hit[i:j][ours[k[i:j]]] - begin, width, int(starts[doc[i] + 1]) - begin))
                    gaps = np.flatnonzero(np.diff(at) > 1) + 1
                    tiles = tile(np.insert(ids[begin + at], gaps, 0), theirs, width)  # only the words of shared windows; 0 where others lie between
                    matched = sum(n for *_, n in tiles)
                    if matched >= need:
                        spots = np.insert(at, gaps, -1)
                        out[doc[i]].append({"item_id": item_id, "matched": matched, "item_words": len(theirs), "coverage": matched / len(theirs), "tiles": [{"doc_at": int(spots[a]), "item_at": b, "length": n} for a, b, n in tiles]})
                shared[mine] = False
        for x in out:
            x.sort(key=lambda r: (r["item_id"] is not None, r["item_id"] or 0))
        return out


def flagged(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, threshold: float = THRESHOLD, broadcast_bytes: int = BROADCAST) -> DataFrame:
    """``row`` (a struct of all columns of the document) and ``leaks`` (an array, empty for clean documents)."""
    ship(docs.sparkSession)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = items.agg(F.coalesce(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16), F.lit(0)).alias("b")).first().b
    if size > broadcast_bytes:
        return _joined(rows, items, least, threshold)
    known = sorted(((r.item_id, r.text) for r in items.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = Items(known, least)
        for batch in slices(batches, "text", 4 << 20):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(seeds.leaks(batch.column(1).to_pylist(), threshold), KIND)], ["row", "leaks"])

    return rows.mapInArrow(find, f"row {rows.schema['row'].dataType.simpleString()}, leaks {LEAKS}")


def _word_ids(text: str | None) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(w.encode()) for w in words((text or "").lower())], np.uint64)


def _joined(rows: DataFrame, items: DataFrame, least: int, threshold: float) -> DataFrame:
    """The same for a benchmark of any size: seeds are joined on hashes, then each candidate pair is tiled."""
    rows = written(rows.withColumn("rid", F.monotonically_increasing_id()), "numbered")
    items = written(items.withColumn("iid", F.monotonically_increasing_id()), "items")

    def item_seed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for iid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = _word_ids(text)
                width = min(least, len(ids))
                if not width:
                    continue
                h = running(ids, width)
                distinct, code = np.unique(h, return_inverse=True)
                covers = np.minimum(np.bincount(code) * width, len(ids))  # words that a seed's windows can cover
                need = int(np.ceil(threshold * len(ids) - 1e-9)) if len(ids) >= least else len(ids)
                n = len(distinct)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, iid)), pa.array(distinct.view(np.int64)), pa.array(np.full(n, width, np.int32)), pa.array(covers.astype(np.int64)), pa.array(np.full(n, need, np.int64))], ["iid", "h", "width", "covers", "need"])

    theirs = written(items.select("iid", "text").mapInArrow(item_seed, "iid bigint, h bigint, width int, covers bigint, need bigint"), "item_seeds")
    widths = [r.width for r in theirs.select("width").distinct().collect()]  # `least` at most

    def seed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            for rid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rolling = Running(_word_ids(text))
                for width in widths:
                    h = np.unique(rolling.windows(width)).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), rid)), pa.array(h), pa.array(np.full(len(h), width, np.int32))], ["rid", "h", "width"])

    wanted = theirs.select("h", "width").distinct()
    mine = written(rows.select("rid", "text").mapInArrow(seed, "rid bigint, h bigint, width int").join(wanted, ["h", "width"], "left_semi"), "seeds")
    # of each item the seeds that most documents have are left out, as many as can't reach the threshold together
    often = theirs.join(mine.groupBy("h", "width").agg(F.count("*").alias("docs")), ["h", "width"])
    so_far = F.sum("covers").over(Window.partitionBy("iid").orderBy(F.desc("docs"), "h"))
    ranked = written(often.withColumn("without", F.greatest(F.lit(0), so_far)).withColumn("left_out", F.col("without") < F.col("need")), "ranked")
    spare = ranked.groupBy("iid").agg(F.coalesce(F.sum(F.when(F.col("left_out"), F.col("covers"))), F.lit(0)).alias("spare"))
    asked = ranked.where(~F.col("left_out")).join(spare, "iid").select("iid", "h", "width", "covers", "need", "spare")
    met = mine.join(asked, ["h", "width"]).groupBy("rid", "iid").agg(F.sum("covers").alias("covered"), F.first("need").alias("need"), F.first("spare").alias("spare"))
    pairs = met.where(F.col("covered") + F.col("spare") >= F.col("need")).select("rid", "iid")
    held = pairs.join(items.select("iid", "item_id", F.col("text").alias("item_text")), "iid").withColumn("chunk", F.pmod(F.hash("iid"), F.lit(1 << 20)))
    nth = F.floor((F.row_number().over(Window.partitionBy("rid").orderBy("chunk", "iid")) - 1) / TOGETHER)
    together = held.withColumn("nth", nth).groupBy("rid", "nth").agg(F.collect_list(F.struct("item_id", "item_text")).alias("candidates"))
    full = together.join(rows.select("rid", "text"), "rid").select("rid", "text", "candidates")

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            found = [Items([(c["item_id"], c["item_text"]) for c in cs], least).leaks([x], threshold)[0] for x, cs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, KIND)], ["rid", "leaks"])

    leaks = full.mapInArrow(test, f"rid bigint, leaks {LEAKS}").where(F.size("leaks") > 0).groupBy("rid").agg(F.array_sort(F.flatten(F.collect_list("leaks"))).alias("leaks"))
    return rows.join(leaks, "rid", "left").select("row", F.coalesce("leaks", F.from_json(F.lit("[]"), LEAKS)).alias("leaks"))
