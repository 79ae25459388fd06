"""Sharding: a uniform shuffle with exact shard sizes from a hypergeometric communication matrix.

How many rows each source partition sends to each shard is drawn first, exactly as a
uniform permutation of all rows would have it: rows of the matrix sum to the partitions,
columns to the shards. Then each partition permutes its own rows and deals them out by its
counts, whole rows go to their shards, and each shard permutes what arrives. The driver draws the matrix only for groups of
``GROUP`` partitions; each task draws its own partition's share of its group. Shards are
written as folders of Parquet, rows in the order of their slots; a large shard is made of cells that are permuted each in its own task.

Rows are read twice, to be counted and to be dealt. Both times a partition must have as many rows, as a table of files
has; a task that meets another number raises.

Defined cases: null texts have no bytes; an empty table gives no row; repeated rows and null
ids are rows like any other; with fewer rows than shards some shards are
empty; all columns are kept in the struct ``row``, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_dir, ship

GROUP = 256
#: Rows of a shard that one task permutes.
CELL = 1 << 16
#: Cells whose first slots are broadcast at most; with more they are joined.
FEW = 1 << 20


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of n draws without replacement are good, for populations of any size."""
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, n)) if n else 0
    low, high = max(0, n - bad), min(n, good)
    mode = min(high, max(low, (n + 1) * (good + 1) // (good + bad + 2)))
    p = good / (good + bad)
    width = int(14 * np.sqrt(n * p * (1 - p)) + 50)
    x = np.arange(max(low, mode - width), min(high, mode + width) + 1, dtype=np.float64)
    up = np.log(good - x[:-1]) + np.log(n - x[:-1]) - np.log(x[1:]) - np.log(bad - n + x[1:])  # log of successive ratios
    logs = np.concatenate([[0.0], np.cumsum(up)])
    weights = np.cumsum(np.exp(logs - logs.max()))
    return int(x[min(np.searchsorted(weights, rng.random() * weights[-1], "right"), len(x) - 1)])


def deal(sources: list[int], targets: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The matrix (sources × targets) of a uniform permutation, given its row and column sums."""
    left, out = targets.astype(np.int64).copy(), np.zeros((len(sources), len(targets)), np.int64)
    for i, n in enumerate(sources):
        rest = int(left.sum())
        for j in range(len(left)):
            if not n:
                break
            rest -= int(left[j])
            out[i, j] = x = hypergeometric(rng, int(left[j]), rest, n)
            n -= x
        left -= out[i]
    return out


def shard_sizes(total: int, shards: int) -> np.ndarray:
    return np.array([total // shards + (s < total % shards) for s in range(shards)], np.int64)


def group_shares(counts: np.ndarray, shards: int, seed: int, group: int = GROUP) -> np.ndarray:
    """(groups of partitions × shards): how many rows a group sends to each shard."""
    groups = [int(counts[k : k + group].sum()) for k in range(0, len(counts), group)]
    return deal(groups, shard_sizes(int(counts.sum()), shards), np.random.default_rng([seed, 1]))


def quotas(counts: np.ndarray, shares: np.ndarray, part: int, seed: int, group: int = GROUP) -> np.ndarray:
    """How many rows one partition sends to each shard, given its group's."""
    nth, k = divmod(part, group)
    own = counts[nth * group : (nth + 1) * group].tolist()
    return deal(own, shares[nth], np.random.default_rng([seed, 2, nth]))[k]


def uniform_shards(rows: DataFrame, shards: int, seed: int = 42, group: int = GROUP, cell_rows: int = CELL, few: int = FEW) -> DataFrame:
    """``row`` (a struct of all columns), ``shard`` and ``slot``, as read back from the written shards.

    ``shard`` counts differ by one at most; ``slot`` is gapless from 0 in a shard; every
    assignment of rows to (shard, slot) is equally likely.
    """
    spark = rows.sparkSession
    ship(spark)
    whole = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"))
    found = rows.groupBy(F.spark_partition_id().alias("part")).agg(F.count("*").alias("n")).collect()  # one row for each input partition
    counts = np.zeros(max((r.part for r in found), default=-1) + 1, np.int64)
    for r in found:
        counts[r.part] = r.n
    given = spark.sparkContext.broadcast((counts, group_shares(counts, shards, seed, group)))  # a number for each partition, some for each group
    cells = max(1, -(-int(counts.sum()) // (shards * cell_rows)))

    def permute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at, drawn = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            counts, shares = given.value
            n = int(counts[part]) if part < len(counts) else 0
            if drawn is None and n:
                rng = np.random.default_rng([seed, 3, part])
                drawn = rng.permutation(np.repeat(np.arange(shards, dtype=np.int32), quotas(counts, shares, part, seed, group))), rng.integers(0, 1 << 62, n)
            if at + batch.num_rows > n:
                raise ValueError("a partition has other rows than when it was counted: write the table first")
            shard, key = (x[at : at + batch.num_rows] for x in drawn or (np.zeros(0, np.int32), np.zeros(0, np.int64)))
            at += batch.num_rows
            cell = (key // ((1 << 62) // cells + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shard), pa.array(cell), pa.array(key)], ["row", "shard", "cell", "key"])
        counts = given.value[0]
        if at != (counts[part] if part < len(counts) else 0):
            raise ValueError("a partition has other rows than when it was counted: write the table first")

    kind = whole.schema["row"].dataType.simpleString()
    sent = whole.mapInArrow(permute, f"row {kind}, shard int, cell int, key bigint").repartition("shard", "cell")
    nth = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("key")) - 1
    made = sent.select("row", "shard", "cell", nth.alias("nth"))
    path = f"{shared_dir(spark)}/ontospark-{uuid.uuid4().hex}/shards"
    made.write.option("compression", "zstd").partitionBy("shard").parquet(path)
    back = spark.read.schema(made.schema).parquet(path)
    sizes = back.groupBy("shard", "cell").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = sizes.select("shard", "cell", before.alias("first"))
    if shards * cells <= few:
        first = F.broadcast(first)
    return back.join(first, ["shard", "cell"]).select("row", "shard", (F.col("first") + F.col("nth")).alias("slot"))
