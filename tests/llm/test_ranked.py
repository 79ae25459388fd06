import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ontospark.llm import queries, ranked

PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return PATTERN.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k):
    read = [(doc, Counter(terms(t))) for doc, t in docs]
    read = [(doc, c, sum(c.values())) for doc, c in read if c]
    n, total = len(read), sum(x[2] for x in read)
    df = Counter(t for _, c, _ in read for t in c)
    out = []
    for item, text in items:
        wanted, scored = Counter(terms(text)), []
        for doc, c, length in read:
            m = 25 + 75 * length * n // total
            score = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, times in wanted.items() if t in c)
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        out += [(item, i + 1, None if none else doc, -score) for i, (score, none, doc) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def result(df):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in df.collect()), key=str)


@settings(max_examples=50, deadline=None)
@given(st.text(alphabet="aZ09é漢 _-@[`{\x7f\x80\n\x00\U0001f600", max_size=30))
def test_terms(text):
    assert [x.decode() for x in ranked.terms_of(text.encode())] == terms(text)


@pytest.mark.parametrize("k,most,seed", [(10, 1 << 18, 64), (3, 40, 2)])
def test_against_all_scores(spark, odd, k, most, seed, monkeypatch):
    rng = random.Random(k)
    vocabulary = [f"t{int(rng.paretovariate(0.7))}" for _ in range(300)] + ["É", "Ünïcödé", "THE"]
    docs = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(40)))) for i in range(400)]
    docs += docs[:40] + [(1000 + i, docs[5][1]) for i in range(60)] + [(r.doc_id, r.text) for r in odd.collect()] + [(None, docs[7][1])]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(12)))) for i in range(25)] + [(90, None), (91, ""), (92, "the mat"), (93, docs[5][1]), (94, "unheard")]
    d = spark.createDataFrame([(*x, 1, 2) for x in docs], "doc_id bigint, text string, item bigint, score bigint").repartition(3)
    b = spark.createDataFrame([(*x, 1) for x in items], "item_id bigint, text string, rank int").repartition(2)
    assert result(ranked.search(d, b, k, most, seed)) == brute(docs, items, k)
    assert ranked.search(d.where("false"), b).count() == 0
    assert ranked.search(d, b.where("false")).count() == 0


def test_trees_prune_exactly(monkeypatch):
    """Many trees and levels: the same results as all scores, from few of them."""
    monkeypatch.setattr(ranked, "LEAF", 4)
    rng = np.random.default_rng(1)
    size, n = 500, 3000
    weight = rng.integers(0, 9000, size)
    counts = [{int(t): 1 + int(t) % 2 for t in rng.choice(50, 6) + 50 * rng.integers(0, 10)} for _ in range(70)]
    tree = ranked.item_tree(list(range(70)), counts, weight)
    rows = [np.unique(rng.choice(50, 8) + 50 * rng.integers(0, 10)) for _ in range(n)]
    docs = ranked.Sparse(np.concatenate([[0], np.cumsum([len(r) for r in rows])]), np.concatenate(rows), rng.integers(1, 10**6, sum(map(len, rows))))
    found = ranked.Search(tree, 5, None)
    for part in np.array_split(np.arange(n), 4):
        found.add(part, docs.rows(part))
    dense = np.zeros((70, size), dtype=np.int64)
    for i, c in enumerate(counts):
        dense[i, list(c)] = [weight[t] * x for t, x in c.items()]
    for i, best in zip(tree.ids, found.best, strict=True):
        scores = docs.times(dense[i])
        want = sorted((-int(s), d) for d, s in enumerate(scores) if s > 0)[:5]
        assert sorted((-s, -k) for s, k in best) == want
    assert found.scored < 70 * n / 3


def test_registered_query(spark):
    data = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    assert result(queries.op13_ranked(spark, data)) == brute(docs, items, 10)
