import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from ontospark.llm import decontam

ITEM = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"


def brute_tiles(doc, item, least):
    """Greedy string tiling as published: the longest unmarked match, first places first."""
    md, mi, out = set(), set(), []
    while True:
        best = (0, 0, 0)
        for a in range(len(doc)):
            for b in range(len(item)):
                n = 0
                while a + n < len(doc) and b + n < len(item) and doc[a + n] == item[b + n] and a + n not in md and b + n not in mi:
                    n += 1
                if n > best[0]:
                    best = (n, a, b)
        n, a, b = best
        if n < least:
            return sorted(out)
        out.append((a, b, n))
        md.update(range(a, a + n))
        mi.update(range(b, b + n))


@settings(max_examples=300, deadline=None)
@given(st.text("abc", max_size=24), st.text("abc", min_size=1, max_size=12), st.integers(1, 4))
def test_tiling(doc, item, width):
    as_ids = lambda s: np.array([ord(c) for c in s], np.int64)
    assert decontam.tile(as_ids(doc), as_ids(item), width) == brute_tiles(doc, item, width)


def test_repeated_words_take_memory_in_proportion():
    import tracemalloc

    known = decontam.Items([(1, "a " * 2000), (2, "a b " * 1000), (3, "b " * 20)], 5)
    text = "a " * 20000 + "c " + "a b " * 3000
    tracemalloc.start()
    found = {r["item_id"]: r["matched"] for r in known.leaks([text], 0.8)[0]}
    assert tracemalloc.get_traced_memory()[1] < 100 << 20
    tracemalloc.stop()
    assert found == {1: 2000, 2: 2000}


def test_tiles_lie_where_they_say():
    w = ITEM.split()
    text = "x y z " + " ".join(w[8:]) + " gap gap " + " ".join(w[:8]) + " z"
    (leak,) = decontam.Items([(1, ITEM)], 5).leaks([text], 0.8)[0]
    said = text.split()
    assert [said[t["doc_at"] : t["doc_at"] + t["length"]] == w[t["item_at"] : t["item_at"] + t["length"]] for t in leak["tiles"]] == [True, True]


def brute(rows, items, least=5, threshold=0.8):
    out = set()
    for doc, text in rows:
        d = re.findall(r"\w+", (text or "").lower())
        for item_id, t in items:
            i = re.findall(r"\w+", (t or "").lower())
            if i:
                matched = sum(n for *_, n in brute_tiles(d, i, min(least, len(i))))
                if matched >= (threshold * len(i) if len(i) >= least else len(i)):
                    out.add((doc, item_id, matched))
    return out


def found(df):
    return {(r.row.doc_id, x.item_id, x.matched) for r in df.collect() for x in r.leaks}


def cases():
    w = ITEM.split()
    texts = [
        ITEM, "Before. " + ITEM.title() + "! after", " ".join(w[8:] + ["gap"] + w[:8]), " ".join(w[10:] + w[5:10] + w[:5]), " ".join(w[:13]), " ".join(w[:12]),
        " ".join(x for p in zip(w, w) for x in p), None, "", "short item", "x " * 20000 + ITEM, "short", ITEM + " " + ITEM,
    ]
    return list(enumerate(texts)), [(1, ITEM), (2, "short item"), (3, None), (4, ""), (5, ITEM), (None, "short")]


def test_cases_both_ways(spark):
    rows, items = cases()
    docs = spark.createDataFrame([(*r, "k", 1) for r in rows], "doc_id bigint, text string, leaks string, rid int").repartition(3)
    bench = spark.createDataFrame([(*i, 0) for i in items], "item_id bigint, text string, iid int")
    want = brute([(i, t if t is None or len(t) < 1000 else "x x x x x x x x " + ITEM) for i, t in rows], items)
    for limit in (1 << 20, -1):
        done = decontam.flagged(docs, bench, broadcast_bytes=limit)
        assert found(done) == want
        assert done.count() == len(rows) and done.select("row.*").columns == docs.columns
        assert decontam.flagged(docs.limit(0), bench, broadcast_bytes=limit).count() == 0
        assert found(decontam.flagged(docs, bench.limit(0), broadcast_bytes=limit)) == set()


def test_documents(spark, documents):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    items = [(r.item_id, r.text) for r in bench.collect()]
    got = found(decontam.flagged(documents, bench))
    assert got == found(decontam.flagged(documents, bench, broadcast_bytes=-1))
    text = dict(rows)
    near = [d for d, t in rows if any(set(re.findall(r"\w+", i.lower())) <= set(re.findall(r"\w+", (t or "").lower())) for _, i in items)]
    near += [d for d, *_ in got] + [d for d, _ in rows[:3]]
    small = [(d, text[d]) for d in set(near) if len(text[d] or "") < 4000]
    want = brute(small, items)
    assert {x for x in got if x[0] in dict(small)} == want


def test_odd_documents(spark, odd):
    bench = spark.createDataFrame([(1, "the cat sat on the mat"), (2, "long long long")], "item_id bigint, text string")
    got = {(r.row.doc_id, x.item_id) for r in decontam.flagged(odd, bench).collect() for x in r.leaks}
    assert got == {(0, 1), (1, 1), (7, 2), (8, 2)}
