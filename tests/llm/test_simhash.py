import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ontospark.llm import simhash


def brute(text, width=3):
    words = [w for w in (text or "").encode().lower().split()]
    if not words:
        return 0
    grams = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows):
    """doc → smallest id, by all pairs of fingerprints."""
    fps = sorted({fp for _, fp in rows})
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    low = {}
    for doc, fp in rows:
        if doc is not None:
            r = find(fp)
            low[r] = min(low.get(r, doc), doc)
    return sorted(((d, f, low.get(find(f))) for d, f in rows), key=str)


def result(df):
    return sorted(((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in df.collect()), key=str)


def test_documents_against_all_pairs(spark, documents):
    rows = [(r.doc_id, brute(r.text)) for r in documents.collect()]
    assert result(simhash.near_duplicates(documents)) == brute_components(rows)
    engine = documents.limit(5).select("doc_id", F.xxhash64(F.lit("a b c")).alias("h")).first().h
    assert engine & (1 << 64) - 1 == xxhash.xxh64_intdigest(b"a b c", 42)


def test_odd_documents(spark, odd, none):
    rows = [(r.doc_id, brute(r.text)) for r in odd.collect()]
    assert result(simhash.near_duplicates(odd)) == brute_components(rows)
    assert simhash.near_duplicates(none).count() == 0


def test_links_of_dense_groups_split_into_chunks(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    fps = {int(b) for b in base}
    for b in base:
        for _ in range(120):
            x = int(b)
            for bit in rng.choice(64, rng.integers(1, 5), replace=False):
                x ^= 1 << int(bit)
            fps.add(x)
    signed = [(int(np.uint64(f).astype(np.int64)),) for f in fps]
    df = spark.createDataFrame(signed, "fp bigint")
    for hot in (2048, 16):
        member = {r.node: r.root for r in simhash.components(simhash.links(df, 3, hot)).collect()}
        got = sorted((f, 0, member.get(f, f)) for (f,) in signed)
        groups = {}
        for f, _, c in got:
            groups.setdefault(c, set()).add(f & (1 << 64) - 1)
        want = {}
        for f, _, c in brute_components([(f, f) for f in fps]):
            want.setdefault(c, set()).add(f)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_components_of_a_long_chain(spark):
    n = 300
    order = np.random.default_rng(2).permutation(n).tolist()
    edges = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)] + [(1000, 1001)], "a bigint, b bigint")
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    assert got == {i: 0 for i in range(n)} | {1000: 1000, 1001: 1000}


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aB é\n\t\x85xyz", max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) == brute(text)


def words_of(text):
    return (text or "").encode().lower().split()


def test_similar_finds_copies_whatever_the_edit(spark, documents):
    base = [words_of(r.text) for r in documents.select("text").distinct().collect()]
    base = [w for w in base if 60 <= len(w) <= 3000][:60]
    texts = []
    for k, w in enumerate(base):
        cut = w[: int(len(w) * 0.83)]
        more = w + [b"new%d_%d" % (k, i) for i in range(int(len(w) * 0.2))]
        middle = w[: len(w) // 2] + [b"own%d_%d" % (k, i) for i in range(int(len(w) * 0.2))] + w[len(w) // 2 :]
        strewn = [b"odd%d" % k if i % 60 == 30 else x for i, x in enumerate(w)]
        texts += [w, cut, more, middle, strewn]
    sets = [simhash.shingles(w, 5) for w in texts]
    like = lambda i, j: len(set(sets[i].tolist()) & set(sets[j].tolist())) / len(set(sets[i].tolist()) | set(sets[j].tolist()))
    rows = spark.createDataFrame([(i, b" ".join(w).decode()) for i, w in enumerate(texts)], "row_id bigint, text string")
    got = {r.row_id: r.root for r in simhash.similar(rows).collect()}
    want = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if like(i, j) >= 0.8:
                a, b = want[i], want[j]
                want = [min(a, b) if x in (a, b) else x for x in want]
    assert sum(like(5 * k, 5 * k + e) >= 0.8 for k in range(len(base)) for e in (1, 2, 3)) >= 150
    assert [got[i] for i in range(len(texts))] == want


def test_similar_odd_documents_and_chunks(spark, odd, none):
    rows = odd.coalesce(1).select(F.col("row").cast("long").alias("row_id"), "text")
    for hot in (2048, 2):
        got = {r.row_id: r.root for r in simhash.similar(rows, hot=hot).collect()}
        assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 3, 6: 6, 7: 7, 8: 8, 9: 9, 10: 10}
    assert simhash.similar(none.select(F.col("row").cast("long").alias("row_id"), "text")).count() == 0

def test_similar_searches_by_fingerprints(spark, documents):
    """The candidates come from tables of SimHash bits: tables of every length find pairs of a similarity of 0.8, and equal sets share all places."""
    base = [w for w in (words_of(r.text) for r in documents.select("text").distinct().collect()) if 20 <= len(w) <= 2000][:40]
    for _, *shape in simhash.TABLES[:3]:
        for w in base:
            sets = [simhash.shingles(x, 5) for x in (w, w[: int(len(w) * 0.83)], w)]
            if simhash.jaccard(*sets[:2]) < 0.8:
                continue
            made = [[np.frombuffer(x, np.uint8)[None] for x in simhash.sketch(h, *shape)] for h in sets]
            a, b, c = (simhash.places(fp, near, *shape)[0] for fp, near in made)
            assert len(np.intersect1d(a, b)) and (a == c).all() and len(np.unique(a)) == len(a) == shape[2] << shape[1]
            assert np.bitwise_count(made[0][0] ^ made[1][0])[0, : simhash.FIRST // 8].sum() <= simhash.APART


def test_sides_of_hyperplanes_against_plain_sums():
    h = np.random.default_rng(3).integers(0, 1 << 63, 700).astype(np.uint64)
    weights = simhash.spread(h, 3).view(np.uint8).astype(np.int64)
    assert (simhash.sides(h, 22) == (2 * weights - 255).sum(axis=0)[:22]).all()


def test_rows_among_few_and_many_keys(spark, monkeypatch):
    from ontospark.llm.common import written

    rows, keys = spark.range(100).withColumnRenamed("id", "row_id"), written(spark.range(0, 100, 7).withColumnRenamed("id", "row_id"))
    for few in (1 << 21, 3):
        monkeypatch.setattr(simhash, "FEW", few)
        for how, want in (("left_semi", 0), ("left_anti", 1)):
            assert sorted(r.row_id for r in simhash.among(rows, keys, "row_id", how).collect()) == [i for i in range(100) if (i % 7 > 0) == want]


def test_size_classes_of_similar_sets_meet():
    n = np.arange(1, 3000)
    kind, more = simhash.size_classes(n, 0.8)
    into = [{k, k + 1} if m else {k} for k, m in zip(kind.tolist(), more.tolist(), strict=True)]
    for i in range(len(n)):
        assert all(into[i] & into[j] for j in (min(int(n[i] / 0.8), len(n)) - 1, min(i + 1, len(n) - 1)) if n[i] >= 0.8 * n[j])
    for a, b in ((4, 5), (13, 16), (15, 16), (52, 64), (800, 1000), (820, 1024)):
        assert into[a - 1] & into[b - 1]
    assert more.mean() < 0.3  # few sets go to two classes


def test_texts_that_meet_by_chance_grow_no_faster_than_all_places():
    for texts, bits, flips, tables in simhash.TABLES[:-1]:
        assert simhash.tables_for(texts) == (bits, flips, tables) and texts << flips <= (1 << bits) / 6 and tables < 256
    rng, met = np.random.default_rng(4), {}
    for texts in (8_000, 40_000, 200_000):  # unrelated texts: five tables of random bits
        bits, flips, tables = simhash.tables_for(texts)
        fp = rng.integers(0, 256, (texts, -(-bits * 5 // 8)), dtype=np.uint8)
        near = rng.permuted(np.tile(np.arange(bits, dtype=np.uint8), (texts * 5, 1)), axis=1)[:, :flips].reshape(texts, -1)
        _, n = np.unique(simhash.places(fp, near, bits, flips, 5), return_counts=True)
        met[texts] = n[n > 1].sum() * tables / 5
    assert met[200_000] <= 7 * met[40_000]


def test_tables_of_every_length_find_similar_sets():
    rng = np.random.default_rng(6)
    for _, *shape in simhash.TABLES:
        found = 0
        for k in range(60):
            h = rng.integers(0, 1 << 63, 300 + k).astype(np.uint64)
            a, b = np.sort(h), np.sort(h[: int(len(h) * 0.81)])
            assert simhash.jaccard(a, b) >= 0.8
            a, b = (simhash.places(*(np.frombuffer(x, np.uint8)[None] for x in simhash.sketch(x, *shape)), *shape)[0] for x in (a, b))
            assert len(np.unique(a)) == len(a) == shape[2] << shape[1] and a.min() >= 0 and a.max() < 1 << 48
            found += len(np.intersect1d(a, b)) > 0
        assert found >= 59  # one of about 2,500 such pairs is missed
