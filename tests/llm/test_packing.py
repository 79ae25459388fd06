import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ontospark.llm import packing

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def check(rows, texts, capacity):
    """rows against the contract; texts: list of (doc_id, text)."""
    slow = Tokenizer.from_file(JSON)
    want = Counter()
    for doc_id, text in texts:
        ids = np.array([*slow.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        cuts = [0, *range(len(ids) % capacity or min(capacity, len(ids)), len(ids) + 1, capacity)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for placed in bins.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= capacity
    return bins


@pytest.mark.parametrize("ranks", [None, RANKS])
def test_pack_matches_the_tokenizer_and_wastes_little(spark, documents, ranks):
    texts = [(r.doc_id, r.text) for r in documents.collect()]
    bins = check(packing.pack(documents.repartition(5), JSON, ranks).collect(), texts, 1024)
    total = sum(n for b in bins.values() for _, n in b)
    assert len(bins) <= 1.02 * -(-total // 1024)


def test_odd_documents(spark, odd, none):
    texts = [(r.doc_id, r.text) for r in odd.collect()]
    check(packing.pack(odd, JSON, RANKS, capacity=64).collect(), texts, 64)
    assert packing.pack(none, JSON, RANKS).count() == 0


def sequential(lengths, capacity):
    """One bin at a time over the pieces themselves."""
    left, out = sorted(lengths), []
    while left:
        used, gap = [], capacity
        while fits := [x for x in left if x <= gap]:
            used.append(fits[-1])
            left.remove(fits[-1])
            gap -= fits[-1]
        if gap:
            room, small = gap + min(used), min(used)
            best = max(((a + b, a, b) for i, a in enumerate(left) for j, b in enumerate(left) if j < i and a + b <= room), default=(0, 0, 0))
            if best[0] > small:
                used.remove(small)
                used += best[1:]
                left.remove(best[1])
                left.remove(best[2])
                left = sorted([*left, small])
        out.append(tuple(sorted(used)))
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=60))
def test_plan_is_the_sequential_packing(lengths):
    counts = np.bincount(lengths, minlength=31)
    bins = packing.plan(counts, 30)
    flat = [tuple(sorted(x for length, n in uses.items() for x in [length] * n)) for uses, times in bins for _ in range(times)]
    assert Counter(x for b in flat for x in b) == Counter(lengths)
    assert all(sum(b) <= 30 for b in flat)
    assert len(flat) == len(sequential(lengths, 30))


def test_sequences_give_the_texts_back(spark, odd):
    placed = packing.place(packing.written(packing.pieces(odd, JSON, RANKS, 64), "pieces"), 64)
    packed = packing.sequences(placed, packing.kind_of(JSON, 2)).collect()
    slow, docs = Tokenizer.from_file(JSON), {}
    for r in packed:
        assert len(r.ids) == 4 * sum(x.length for x in r.pieces) <= 4 * 64
        ids = np.frombuffer(r.ids, "<u4")
        for x in r.pieces:
            docs.setdefault(x.doc_id, []).append((x.piece, x.start, ids[x.offset : x.offset + x.length].tolist()))
    for r in odd.where("doc_id in (0, 2, 6, 7, 8)").collect():
        own = sorted(docs[r.doc_id])
        assert [i for _, _, ids in own for i in ids] == [*slow.encode(r.text or "", add_special_tokens=False).ids, 2]
    rows = packing.pack(odd, JSON, RANKS, capacity=64).collect()
    assert all(len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32 for r in rows)
