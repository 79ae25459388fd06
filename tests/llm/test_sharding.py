import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ontospark.llm import queries, sharding
from ontospark.llm.common import written

DATA = "/root/testdata/sf0.001"


def test_query(spark):
    rows = queries.op9_sharding(spark, DATA).collect()
    want = Counter((r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
    shards = {}
    for r in rows:
        assert r.law == "rows" and r.grown_shard is None
        shards.setdefault(r.shard, []).append(r.slot)
    sizes = [len(shards.get(s, [])) for s in range(40)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(x) == list(range(len(x))) for x in shards.values())


def test_odd_and_empty(spark, odd, none):
    docs = written(odd, "odd").withColumn("at", F.lit(1)).withColumn("shard", F.lit(2)).withColumn("slot", F.lit(3)).withColumn("cell", F.lit(4))
    done = sharding.uniform_shards(docs, 4)
    rows = done.collect()
    assert done.select("row.*").columns == docs.columns
    key = lambda r: str(tuple(r))
    assert sorted((r.row for r in rows), key=key) == sorted(docs.collect(), key=key)
    assert sorted(Counter(r.shard for r in rows).values()) == [2, 3, 3, 3]
    assert sharding.uniform_shards(none, 4).count() == 0


def test_more_groups_of_partitions_than_one(spark):
    many = written(spark.range(1000).repartition(20), "many")
    for few in (sharding.FEW, 0):
        rows = sharding.uniform_shards(many, 7, group=3, cell_rows=16, few=few).collect()
        assert {r.row.id for r in rows} == set(range(1000)) and len(rows) == 1000
        by = {}
        for r in rows:
            by.setdefault(r.shard, []).append(r.slot)
        assert all(sorted(x) == list(range(len(x))) for x in by.values())
        assert max(map(len, by.values())) - min(map(len, by.values())) <= 1


def test_partitions_draw_what_their_group_was_dealt():
    counts = np.array([5, 0, 17, 3, 40, 1, 9], np.int64)
    shares = sharding.group_shares(counts, 4, 1)
    each = np.array([sharding.quotas(counts, shares, k, 1) for k in range(len(counts))])
    assert each.sum(1).tolist() == counts.tolist() and each.sum(0).tolist() == [19, 19, 19, 18]


def test_every_place_is_equally_likely(spark):
    """Mean slot and spread of the first partition's rows over many seeds."""
    rows, hits = spark.range(0, 24, 1, 3), np.zeros((24, 3))
    for seed in range(12):
        for r in sharding.uniform_shards(rows, 3, seed).collect():
            hits[r.row.id, r.shard] += 1
    by_part = hits.reshape(3, 8, 3).sum(axis=1)
    assert np.abs(by_part / 96 - 1 / 3).max() < 0.15


def test_matrix_sums_and_mean():
    got = np.zeros((3, 4))
    for s in range(400):
        m = sharding.deal([10, 0, 30], np.array([10, 10, 10, 10]), np.random.default_rng(s))
        assert m.sum(1).tolist() == [10, 0, 30] and m.sum(0).tolist() == [10] * 4
        got += m
    assert np.allclose(got[0] / 400, 2.5, atol=0.25)


@pytest.mark.parametrize("n", [1, 1000, 10**6])
def test_large_populations(n):
    good, bad = 7 * 10**9, 3 * 10**9
    x = [sharding.hypergeometric(np.random.default_rng(s), good, bad, n) for s in range(300)]
    assert abs(np.mean(x) - 0.7 * n) < 5 * np.sqrt(0.21 * n / 300) + 1e-9
    assert all(0 <= v <= n for v in x)
