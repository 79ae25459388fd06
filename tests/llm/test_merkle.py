import hashlib
import os
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ontospark.llm import merkle

H = lambda x: hashlib.sha256(x.encode()).hexdigest()


def climb(nodes, arity):
    """All levels of a tree over digests."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        n = levels[-1]
        levels.append([H("".join(n[i : i + arity])) for i in range(0, len(n), arity)])
    return levels


def siblings(levels, i, arity, value):
    """The proof of node i, and the top that a value in its place gives."""
    proof = ""
    for nodes in levels[:-1]:
        first = i - i % arity
        run = nodes[first : first + arity]
        k = i - first
        proof += "".join(run[:k] + run[k + 1 :])
        value = H("".join(run[:k] + [value] + run[k + 1 :]))
        i //= arity
    return proof, value


def brute(rows, arity):
    """rows: (grp, key, leaf, changed)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        trees[g] = climb([r[2] for r in groups[g]], arity)
    top = climb([trees[g][-1][0] for g in names], arity)
    out = []
    for k, g in enumerate(names):
        for i, r in enumerate(groups[g]):
            low, value = siblings(trees[g], i, arity, r[3])
            high, value = siblings(top, k, arity, value)
            out.append((r[1], r[2], trees[g][-1][0], top[-1][0], H(low + high), value, value == top[-1][0]))
    return sorted(out, key=str)


@settings(max_examples=20, deadline=None)
@given(st.integers(1, 40), st.integers(2, 5))
def test_compression_is_sha256(n, arity):
    nodes = np.frombuffer(os.urandom(32 * n), dtype=">u4").reshape(-1, 8).astype(np.uint32)
    text = [bytes(x).decode() for x in merkle._hex(nodes)]
    up, states = merkle.parents(nodes, arity)
    assert [bytes(x).decode() for x in merkle._hex(up)] == [H("".join(text[i : i + arity])) for i in range(0, n, arity)]
    assert states.shape == (-(-n // arity), arity - 1, 8)


@pytest.mark.parametrize("arity,levels", [(2, 1), (2, 3), (3, 2), (4, 12)])
def test_tree_and_folding(spark, arity, levels):
    rng = random.Random(arity)
    rows = []
    for i in range(70):
        grp = rng.choice(["en", "en", "en", "de", None, "é", ""]) if i else "alone"
        leaf = H(str(i))
        rows.append((grp, rng.choice([i, i, None, 7]), leaf, leaf if i % 3 else H(f"x{i}")))
    rows += rows[5:7]
    df = spark.createDataFrame([(*r, 1, "b") for r in rows], "grp string, key bigint, leaf string, changed string, pos int, block string").repartition(5)
    m = merkle.manifest(df.select("*", F.col("key").alias("id")).withColumn("leaf", F.unhex("leaf")).withColumn("changed", F.unhex("changed")), arity, levels)
    assert sorted((tuple(r) for r in merkle.fold(m).collect()), key=str) == brute(rows, arity)


def test_one_leaf_and_none(spark):
    df = spark.createDataFrame([(None, 1, bytes(32))], "grp string, key bigint, leaf binary").selectExpr("*", "leaf AS changed", "key AS id")
    (r,) = merkle.fold(merkle.manifest(df)).collect()
    assert (r.subroot, r.root, r.folded_root, r.proof_sha256, r.verified) == ("0" * 64, "0" * 64, "0" * 64, H(""), True)
    assert merkle.fold(merkle.manifest(df.where("false"))).count() == 0


def test_row_digest(spark):
    df = spark.createDataFrame([("é", None, -12)], "a string, b string, c bigint").select(merkle.row_digest(F.col("a"), F.col("b"), F.col("c")).alias("x"))
    assert df.first().x == H("2:é-3:-12")


def test_states_are_what_folding_resumes(spark):
    """A block whose left siblings are overwritten folds to the same top: only states and right siblings are read."""
    nodes = np.frombuffer(os.urandom(32 * 8), dtype=">u4").reshape(-1, 8).astype(np.uint32)
    built, top = merkle._block(nodes, 0, 2, 3)
    for at in range(8):
        value, i = nodes[at : at + 1], at
        for level in built:
            parent, slot = divmod(i, 2)
            gone = level.nodes.copy()
            gone[: i + 1] = 0
            state = level.states[parent, :1] if slot else merkle.START[None]
            value = merkle._step(value, np.array([slot]), np.array([2]), state.copy(), lambda r, has, gone=gone, i=i: gone[[i + r]], 2)
            i = parent
        assert (value[0] == top).all()
