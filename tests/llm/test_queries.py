"""The registered queries on the smallest tables, each against plain loops."""

import hashlib
import re
import zlib

import numpy as np
import pytest
import xxhash
from test_decontam import brute
from test_packing import check

from ontospark.llm import queries


DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]


def test_op2(spark, texts):
    got = {r.doc_id: r for r in queries.op2_telephony(spark, DATA).collect()}
    assert len(got) == len(texts)
    for doc, text in texts:
        data = (text or "").encode()
        full = data + b"\xff" * (-len(data) % 576 if data else 576)
        r = got[doc]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:]))
        assert r.media_bytes > len(full) and r.feature


def test_op4(spark):
    data = "/root/testdata/sf0.01"
    got = queries.op4_quality(spark, data).collect()
    assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id").collect())
    labels = {r.doc_id: (r.quality, r.toxic) for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    known = [(r.keep, labels[r.doc_id]) for r in got if r.doc_id in labels]
    assert np.mean([keep == (label == (1, 0)) for keep, label in known]) > 0.9


def test_op6(spark, texts):
    check(queries.op6_packing(spark, DATA).collect(), texts, 1024)


def plain_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", low) if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_op7(spark, texts):
    prints = {d: plain_fingerprint(t) for d, t in texts}
    root = {d: d for d in prints}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(prints)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = sorted((top(a), top(b)))
                root[y] = x
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in queries.op7_simhash(spark, DATA).collect()}
    assert got == {(d, f"{prints[d]:016x}", top(d)) for d in ids}


def test_op10(spark, texts):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id, r.matched) for r in queries.op10_decontam(spark, DATA).collect()}
    words = lambda t: set(re.findall(r"\w+", (t or "").lower()))
    asked = [words(t) for _, t in items]
    near = [(d, t) for d, t in texts if any(len(words(t) & i) >= 0.7 * len(i) for i in asked if i) and len(t) < 6000]
    assert {x for x in got if x[0] in dict(near)} == brute(near, items)
    assert {d for d, *_ in got} <= {d for d, t in texts if any(len(words(t) & i) >= 0.7 * len(i) for i in asked if i)}
