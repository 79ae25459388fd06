"""Merkle dataset manifest over SHA-256 midstates.

Rows are leaves, ordered by a key within groups; runs of ``arity`` consecutive nodes are hashed into parents until one is left, the group's
subroot, and the subroots, ordered by group, are hashed the same way into the root. What a node hashes is its children's digests as hex
text. Such a text is 64 bytes, one block of SHA-256, so the state of the hash before any child slot is eight words: every parent retains
them. Folding a changed leaf resumes its parent's state at its slot, takes the new digest and the siblings to the right of it, and
goes on with the parent; nothing to the left is hashed again. The compression function runs over arrays of nodes.

The tree is stored in tiers of blocks. A block has ``arity ** levels`` consecutive nodes of one group at most, all levels above them, and
the states; it is one row of a written table, made by one task. The tops of a tier's blocks are the nodes of the next tier. So a group
of any size is spread over blocks, and a lost executor costs blocks. Folding goes from the top tier down: each block hands its
members the path above them, and the lowest tier's blocks fold all their leaves at once.

Defined cases: null values have a mark of their own in a leaf; a null group is a group, the first; null keys come first, equal keys by
digest; repeated rows are leaves of their own; a group of one leaf has it as subroot; an empty table has no root and gives no row; columns
that aren't asked for are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.order import placed
from .common import ship, written

#: Levels of a block: 2^12 leaves of a binary tree.
LEVELS = 12


def _primes(n: int) -> list[int]:
    found: list[int] = []
    k = 2
    while len(found) < n:
        if all(k % p for p in found):
            found.append(k)
        k += 1
    return found


def _fraction(prime: int, root: int) -> int:
    """The first 32 bits of the fraction of a prime's square or cube root."""
    whole = prime << (32 * root)
    if root == 2:
        return math.isqrt(whole) & 0xFFFFFFFF
    x = round(whole ** (1 / 3))
    while x**3 > whole:
        x -= 1
    while (x + 1) ** 3 <= whole:
        x += 1
    return x & 0xFFFFFFFF


START = np.array([_fraction(p, 2) for p in _primes(8)], dtype=np.uint32)
ROUND = np.array([_fraction(p, 3) for p in _primes(64)], dtype=np.uint32)
HEX = np.frombuffer(b"0123456789abcdef", dtype=np.uint8)


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> n) | (x << (32 - n))


def compress(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    """SHA-256's compression of blocks (n or 1, 16) into states (n, 8)."""
    w = list(np.ascontiguousarray(block.T))
    for t in range(16, 64):
        x, y = w[t - 15], w[t - 2]
        w.append(w[t - 16] + w[t - 7] + (_turn(x, 7) ^ _turn(x, 18) ^ (x >> 3)) + (_turn(y, 17) ^ _turn(y, 19) ^ (y >> 10)))
    a, b, c, d, e, f, g, h = np.ascontiguousarray(state.T)
    for t in range(64):
        more = h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + (g ^ (e & (f ^ g))) + (w[t] + ROUND[t])
        both = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + ((a & b) | (c & (a | b)))
        a, b, c, d, e, f, g, h = more + both, a, b, c, d + more, e, f, g
    return np.stack([a, b, c, d, e, f, g, h], axis=1) + state


def _padding(blocks: int) -> np.ndarray:
    """The last block of a message of so many whole blocks."""
    out = np.zeros(16, dtype=np.uint32)
    out[0], out[14], out[15] = 0x80000000, (blocks * 512) >> 32, (blocks * 512) & 0xFFFFFFFF
    return out


def _bytes(digests: np.ndarray) -> np.ndarray:
    return digests.astype(">u4").view(np.uint8).reshape(len(digests), 32)


def _digests(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, dtype=">u4").reshape(-1, 8).astype(np.uint32)


def _hex(digests: np.ndarray) -> np.ndarray:
    """Digests (n, 8) as hex text (n, 64)."""
    raw = _bytes(digests)
    return HEX[np.stack([raw >> 4, raw & 15], axis=2).reshape(len(raw), 64)]


def _words(text: np.ndarray) -> np.ndarray:
    """Hex text (n, 64) as blocks (n, 16)."""
    return np.ascontiguousarray(text).view(">u4").astype(np.uint32)


class Level(NamedTuple):
    """Nodes of one level in a block, and their parents' retained states (parents, arity - 1, 8) before slots 1, 2, …"""

    nodes: np.ndarray
    states: np.ndarray


def _sizes(n: int, arity: int) -> np.ndarray:
    """Children of each parent of n nodes."""
    out = np.full(-(-n // arity), arity)
    if len(out):
        out[-1] = n - (len(out) - 1) * arity
    return out


def parents(nodes: np.ndarray, arity: int) -> tuple[np.ndarray, np.ndarray]:
    """The digests of the next level, and the states that it retains."""
    size = _sizes(len(nodes), arity)
    words, state = _words(_hex(nodes)), np.tile(START, (len(size), 1))
    states = np.zeros((len(size), arity - 1, 8), dtype=np.uint32)
    for slot in range(arity):
        n = int((size > slot).sum())  # only the last run is shorter
        if slot:
            states[:n, slot - 1] = state[:n]
        if n:
            state[:n] = compress(state[:n], words[np.arange(n) * arity + slot])
    pad = np.stack([_padding(k) for k in range(arity + 1)])
    return compress(state, pad[size]), states


def _height(n: int, block: int, arity: int, levels: int) -> int:
    """Levels above a block's n nodes: all, but in the only block of its group as many as lead to one node."""
    if block > 0 or n == arity**levels:
        return levels
    height = 0
    while n > 1:
        n, height = -(-n // arity), height + 1
    return height


def _block(nodes: np.ndarray, block: int, arity: int, levels: int) -> tuple[list[Level], np.ndarray]:
    out = []
    for _ in range(_height(len(nodes), block, arity, levels)):
        up, states = parents(nodes, arity)
        out.append(Level(nodes, states))
        nodes = up
    return out, nodes[0]


def _restore(n: int, block: int, digests: bytes, states: bytes, arity: int, levels: int) -> tuple[list[Level], np.ndarray]:
    """The levels of a stored block, and its top."""
    d, s, out = _digests(digests), _digests(states), []
    for _ in range(_height(n, block, arity, levels)):
        p = -(-n // arity)
        out.append(Level(d[:n], s[: p * (arity - 1)].reshape(p, arity - 1, 8)))
        d, s, n = d[n:], s[p * (arity - 1) :], p
    return out, d[0]


BLOCK = "grp string, block bigint, n int, top binary, digests binary, states binary, changed binary, ids array<{}>"
PATH = "array<struct<slot:int,size:int,state:binary,siblings:binary>>"


def _store(arity: int, levels: int, ids: pa.DataType) -> Callable:
    def make(key: tuple, rows: pa.Table) -> pa.Table:
        grp, block = (k.as_py() for k in key)
        rows = rows.sort_by("pos").combine_chunks()
        nodes = _digests(b"".join(rows["digest"].to_pylist()))
        built, top = _block(nodes, block, arity, levels)
        digests = b"".join(_bytes(x.nodes).tobytes() for x in built)
        top = _bytes(top[None]).tobytes()
        column = rows["id"].combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
        many = pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column)
        values = {
            "grp": [grp], "block": [block], "n": pa.array([len(nodes)], pa.int32()), "top": [top], "digests": [digests + top], "states": [b"".join(_bytes(x.states.reshape(-1, 8)).tobytes() for x in built)],
            "changed": [b"".join(rows["changed"].to_pylist())],
        }
        return pa.table({k: x if isinstance(x, pa.Array) else pa.array(x, pa.binary() if isinstance(x[0], bytes) else pa.int64() if isinstance(x[0], int) else pa.string()) for k, x in values.items()} | {"ids": many})

    return make


class Manifest(NamedTuple):
    """Tiers of blocks, lowest first: of the groups' trees, and of the tree over their subroots."""

    groups: list[DataFrame]
    top: list[DataFrame]
    arity: int
    levels: int


def _tiers(nodes: DataFrame, arity: int, levels: int) -> list[DataFrame]:
    """``nodes``: grp, pos (from 0), digest, changed, id."""
    kind, tiers = nodes.schema["id"].dataType, []
    while True:
        made = nodes.withColumn("block", F.floor(F.col("pos") / arity**levels).cast("bigint")).groupBy("grp", "block")
        tier = written(made.applyInArrow(_store(arity, levels, kind), BLOCK.format(kind.simpleString())), "tier")
        tiers.append(tier)
        if tier.where("block > 0").isEmpty():
            return tiers
        none = F.lit(None).cast("bigint")
        nodes, kind = tier.select("grp", F.col("block").alias("pos"), F.col("top").alias("digest"), F.col("top").alias("changed"), none.alias("id")), none_type()


def none_type():
    from pyspark.sql.types import LongType

    return LongType()


def manifest(leaves: DataFrame, arity: int = 2, levels: int = LEVELS) -> Manifest:
    """The stored tree of ``grp, key, id, leaf, changed``: digests are binary, ``changed`` is the leaf after a change (or the same), ``id`` names a leaf in results."""
    ship(leaves.sparkSession)
    group = F.when(F.col("grp").isNull(), "0").otherwise(F.concat(F.lit("1"), F.col("grp").cast("string")))
    rows = placed(leaves.select(group.alias("grp"), "key", "id", F.col("leaf").alias("digest"), "changed"), "grp", F.struct("key", "digest"))
    low = _tiers(rows.select("grp", (F.col("place") - 1).alias("pos"), "digest", "changed", "id"), arity, levels)
    last = low[-1].select(F.lit("").alias("one"), F.col("grp").alias("id"), F.col("top").alias("digest"))
    last = placed(last, "one", F.col("id")).select(F.col("one").alias("grp"), (F.col("place") - 1).alias("pos"), "digest", F.col("digest").alias("changed"), "id")
    return Manifest(low, _tiers(last, arity, levels), arity, levels)


def _up(path: list[Level], at: int, arity: int) -> list[dict]:
    """What node ``at`` of a block needs of each level above it: its slot, the state before it, its siblings."""
    out = []
    for level in path:
        parent, slot = divmod(at, arity)
        run = level.nodes[parent * arity : (parent + 1) * arity]
        state = level.states[parent, slot - 1] if slot else START
        rest = np.concatenate([run[:slot], run[slot + 1 :]])
        out.append({"slot": slot, "size": len(run), "state": _bytes(state[None]).tobytes(), "siblings": _bytes(rest).tobytes() if len(rest) else b""})
        at = parent
    return out


ABOVE = "subroot binary, root binary, path " + PATH
_ARROW = pa.list_(pa.struct([("slot", pa.int32()), ("size", pa.int32()), ("state", pa.binary()), ("siblings", pa.binary())]))


def _paths(arity: int, levels: int) -> Callable:
    """A block of a higher tier hands its members what lies above them: ``grp, block`` (their own block), ``name``, subroot, root, path."""

    def hand(key: tuple, blocks: pa.Table, above: pa.Table) -> pa.Table:
        b, a = blocks.to_pylist()[0], above.to_pylist()[0]
        built, top = _restore(b["n"], b["block"], b["digests"], b["states"], arity, levels)
        nodes = built[0].nodes if built else top[None]
        own = [_bytes(x[None]).tobytes() for x in nodes]
        first = b["block"] * arity**levels
        return pa.table({
            "grp": pa.array([b["grp"]] * len(nodes), pa.string()), "block": pa.array(range(first, first + len(nodes)), pa.int64()), "name": pa.array([None if x is None else str(x) for x in b["ids"]], pa.string()), "own": pa.array(own, pa.binary()),
            "subroot": pa.array([a["subroot"]] * len(nodes), pa.binary()), "root": pa.array([a["root"]] * len(nodes), pa.binary()), "path": pa.array([_up(built, j, arity) + a["path"] for j in range(len(nodes))], _ARROW),
        })

    return hand


def _step(value: np.ndarray, slot: np.ndarray, size: np.ndarray, state: np.ndarray, right: Callable[[int, np.ndarray], np.ndarray], arity: int) -> np.ndarray:
    """One level of folding: resume the state, take the value and what is right of it, end the message."""
    state = compress(state, _words(_hex(value)))
    for r in range(1, arity):
        has = np.flatnonzero(slot + r < size)
        if len(has):
            state[has] = compress(state[has], _words(_hex(right(r, has))))
    return compress(state, np.stack([_padding(k) for k in range(arity + 1)])[size])


def _leaves(arity: int, levels: int) -> Callable:
    """All leaves of a block folded: their digests, proofs and the roots that their changed digests lead to."""

    def fold(key: tuple, blocks: pa.Table, above: pa.Table) -> pa.Table:
        b = {c: blocks[c][0].as_py() for c in ("n", "block", "digests", "states", "changed")}
        a, n = above.to_pylist()[0], b["n"]
        built, top = _restore(n, b["block"], b["digests"], b["states"], arity, levels)
        leaves, value = (built[0].nodes if built else top[None]), _digests(b["changed"])
        at, parts, there = np.arange(n), [], []
        for level in built:
            parent, slot = np.divmod(at, arity)
            size = _sizes(len(level.nodes), arity)[parent]
            text = _hex(level.nodes)
            for j in range(arity):
                parts.append(text[np.minimum(parent * arity + j, len(text) - 1)])
                there.append((j != slot) & (j < size))
            state = np.where(slot[:, None] == 0, START, level.states[parent, np.maximum(slot, 1) - 1])
            value = _step(value, slot, size, state, lambda r, has, at=at, level=level: level.nodes[at[has] + r], arity)
            at = parent
        beyond = b""
        for x in a["path"]:
            rest, slot, size = _digests(x["siblings"]), x["slot"], x["size"]
            beyond += _hex(rest).tobytes() if len(rest) else b""
            state = np.tile(_digests(x["state"]), (n, 1))
            value = _step(value, np.full(n, slot), np.full(n, size), state, lambda r, has, rest=rest, slot=slot: np.tile(rest[slot + r - 1], (len(has), 1)), arity)
        if parts:
            text, there = np.stack(parts, axis=1), np.stack(there, axis=1)
            proofs = [hashlib.sha256(text[i][there[i]].tobytes() + beyond).hexdigest() for i in range(n)]
        else:
            proofs = [hashlib.sha256(beyond).hexdigest()] * n
        root = a["root"].hex()
        folded = [bytes(x).decode() for x in _hex(value)]
        return pa.table({
            "id": blocks["ids"].combine_chunks().values if isinstance(blocks["ids"].combine_chunks(), pa.Array) else blocks["ids"].chunk(0).values, "leaf": pa.array([bytes(x).decode() for x in _hex(leaves)]), "subroot": pa.array([a["subroot"].hex()] * n), "root": pa.array([root] * n),
            "proof_sha256": pa.array(proofs), "folded_root": pa.array(folded), "verified": pa.array([x == root for x in folded]),
        })

    return fold


def fold(m: Manifest) -> DataFrame:
    """``id, leaf, subroot, root, proof_sha256, folded_root, verified`` of every leaf: the root that its changed digest gives, and whether it is the manifest's."""
    def down(tier: DataFrame, above: DataFrame) -> DataFrame:
        pairs = tier.groupBy("grp", "block").cogroup(above.groupBy("grp", "block"))
        return written(pairs.applyInArrow(_paths(m.arity, m.levels), "grp string, block bigint, name string, own binary, " + ABOVE), "paths")

    above = m.top[-1].select("grp", "block", F.lit(None).cast("binary").alias("subroot"), F.col("top").alias("root"), F.expr(f"CAST(array() AS {PATH})").alias("path"))
    for tier in reversed(m.top):
        above = down(tier, above)
    above = above.select(F.col("name").alias("grp"), F.lit(0).cast("bigint").alias("block"), F.col("own").alias("subroot"), "root", "path")
    for tier in reversed(m.groups[1:]):
        above = down(tier, above).select("grp", "block", "subroot", "root", "path")
    kind = m.groups[0].schema["ids"].dataType.elementType.simpleString()
    pairs = m.groups[0].groupBy("grp", "block").cogroup(above.groupBy("grp", "block"))
    return pairs.applyInArrow(_leaves(m.arity, m.levels), f"id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def row_digest(*values: Column) -> Column:
    """Hex digest of a row: each value as its length in bytes, a colon and its text; null as a dash."""
    def field(x: Column) -> Column:
        text = x.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*map(field, values)), 256)
