import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ontospark.llm import brown, queries

DATA = "/root/testdata/sf0.001"


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def base(rows, held):
    """(doc_id, held, tokens, known, N, base score) by counting."""
    counts, ends = Counter(), 0
    for (_, text), h in zip(rows, held):
        if not h:
            counts.update(words(text))
            ends += 1
    n, v = sum(counts.values()) + ends, len(counts) + (ends > 0)
    p = lambda c: math.log10((c + 1) / (n + v + 1))
    out = []
    for (doc, text), h in zip(rows, held):
        c = [counts[w] for w in words(text)] + [ends]
        out.append((doc, h, len(c), sum(x > 0 for x in c), n, sum(map(p, c))))
    return out


def close(got, want):
    key = lambda x: (str(x[0]), x[1:5], round(x[5], 4))
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want], rtol=1e-9)


def rows_of(df):
    return [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in df]


def test_query_against_counting_and_better_than_base(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    held = [zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in rows]
    got = queries.op3_brown(spark, DATA).collect()
    close(rows_of(got), base(rows, held))
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def plain_scores(rows, held, klass, emission_words):
    """(score by doc) from each word's class alone: counts of class pairs, Witten-Bell, Good-Turing in the classes by shape, in plain loops.

    ``klass(word)``: its class; ``emission_words``: counts of the training words.
    """
    edge, pairs = brown.EDGE, Counter()
    chain = lambda text: [edge, *map(klass, words(text)), edge]
    for (_, text), h in zip(rows, held):
        if not h:
            c = chain(text)
            pairs.update(zip(c, c[1:]))
    after, into = Counter(), Counter()
    kinds = Counter(a for a, _ in pairs)
    for (a, b), n in pairs.items():
        after[a] += n
        into[b] += n
    total = sum(pairs.values())

    def follows(a, b):
        kind = max(kinds[a], 1)
        return (pairs[a, b] + kind * (into[b] + 1) / (total + brown.ALL)) / (after[a] + kind)

    inside, types, ones, twos = Counter(), Counter(), Counter(), Counter()
    for w, n in emission_words.items():
        k = klass(w)
        inside[k] += n
        types[k] += 1
        ones[k] += n == 1
        twos[k] += n == 2

    def said(w):
        k, n = klass(w), emission_words.get(w, 0)
        if k < brown.CLASSES:
            return n / inside[k]
        if not types[k]:
            return 1.0
        cut = min(max(ones[k] / (ones[k] + 2 * twos[k]) if ones[k] else 0.5, 0.1), 0.9)
        return (n - cut) / inside[k] if n else cut * types[k] / inside[k]

    out = {}
    for doc, text in rows:
        c = chain(text)
        out[doc] = sum(math.log10(follows(a, b)) for a, b in zip(c, c[1:])) + sum(math.log10(said(w)) for w in words(text))
    return out


def test_scores_against_plain_counting(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    held = [zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in rows]
    done = brown.fit(spark.read.parquet(f"{DATA}/documents.parquet"), F.expr("crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 7 = 2"))
    known = {r.word: (r.c, r.cand) for r in done.vocab.collect()}
    every = {w for _, text in rows for w in words(text)}
    forms = dict(zip(sorted(every), brown.shape(pa.array(sorted(every), pa.string())).tolist()))

    def klass(w):
        cand = known[w][1] if w in known else -1
        return int(done.classes.array[cand]) if cand >= 0 else brown.CLASSES + forms[w]

    rare = [w for w, (c, _) in known.items() if brown.RARE <= c < brown.MIN_COUNT]
    assert rare and all(klass(w) < brown.CLASSES for w in rare)  # all have learned classes
    assert all(klass(w) >= brown.CLASSES for w in every if known.get(w, (0, 0))[0] < brown.RARE)
    want = plain_scores(rows, held, klass, {w: c for w, (c, _) in known.items()})
    got = {r.doc_id: r.score for r in brown.scores(done.resolved, done.classes, done.model).collect()}
    assert set(got) == set(want) and all(abs(got[d] - want[d]) <= 1e-9 * abs(want[d]) for d in want)


def test_rare_words_go_to_the_class_of_their_neighbours(spark):
    """Words seen 3 times, always where one group of frequent words stands, get a class of that group."""
    text = [f"the {noun} {verb} now" for noun in ("cat", "dog", "fox") for verb in ("runs", "eats", "naps") for _ in range(9)]
    text += ["the yak runs now", "the yak eats now", "the yak naps now"]
    docs = spark.createDataFrame(list(enumerate(text)), "doc_id bigint, text string")
    done = brown.fit(docs, F.lit(False))
    at = {r.word: r.cand for r in done.vocab.collect()}
    pairs = brown.transitions(done.resolved, done.classes)
    k = int(done.classes.array[at["yak"]])
    assert k in {int(done.classes.array[at[w]]) for w in ("cat", "dog", "fox")}
    assert pairs[:, k].sum() >= 30


def test_odd_and_empty(spark, odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    held = [d == 6 for d, _ in rows]
    flag = F.coalesce(F.col("doc_id") == 6, F.lit(False))
    got = brown.score_documents(odd, flag, min_count=2).collect()
    close(rows_of(got), base(rows, held))
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert brown.score_documents(none, flag).count() == 0
    alone = brown.score_documents(odd, F.lit(True)).collect()
    assert all(r.train_tokens == 0 and math.isfinite(r.score) for r in alone)


def test_probabilities_sum_to_one(spark, documents):
    built = brown.blocks(documents.select("doc_id", "text", F.lit(False).alias("held"))).cache()
    each = built.select(F.explode(F.arrays_zip("words", "seen")).alias("x")).select(F.col("x.words").alias("word"), F.col("x.seen").cast("long").alias("n"))
    vocab = each.groupBy("word").agg(F.sum("n").alias("c"))
    vocab, n = brown.with_candidates(vocab, 20)
    vocab = vocab.cache()
    resolved = brown.resolve(built, vocab).cache()
    table = np.arange(n).astype(np.uint8) % brown.CLASSES
    rows = [(k, table[k * brown.RANGE : (k + 1) * brown.RANGE].tobytes()) for k in range(-(-n // brown.RANGE))]
    classes = brown.Classes.of(spark.createDataFrame(rows, brown.CLASS_ROWS), n, brown.MOST)
    assert (classes.array == table).all()
    pairs = brown.transitions(resolved, classes)
    assert (brown.transitions(resolved, brown.Classes.of(classes.table, n, 0)) == pairs).all()
    rows = vocab.collect()
    tokens = sum(r.c for r in rows) + documents.count()
    model = brown.class_model(vocab, classes, pairs, tokens, len(rows) + 1, documents.count())
    assert np.allclose((10.0**model.trans).sum(axis=1), 1)
    own = brown.classes_of(np.array([r.cand for r in rows]), brown.shape(pa.array([r.word for r in rows])), table)
    mass = np.bincount(own, 10.0 ** model.emission(np.array([r.c for r in rows]), own), minlength=brown.ALL)
    unseen = 10.0 ** model.emission(np.zeros(brown.ALL, np.int64), np.arange(brown.ALL))
    for k in range(brown.ALL):
        if k < brown.CLASSES:
            assert mass[k] == 0 or abs(mass[k] - 1) < 1e-9
        elif k < brown.EDGE and model.types[k]:
            assert abs(mass[k] + unseen[k] - 1) < 1e-9
    before = brown.likelihood(pairs)
    for turn in range(2):
        classes = brown.exchange(resolved, classes, pairs, turn, n)
        pairs = brown.transitions(resolved, classes)
    assert brown.likelihood(pairs) > before


def test_scores_depend_neither_on_partitions_nor_on_what_is_broadcast(spark, documents):
    held = F.col("doc_id") % 7 == 2
    want = {r.doc_id: r for r in brown.score_documents(documents.repartition(1), held, rounds=3).collect()}
    for docs, most in ((documents.repartition(7), brown.MOST), (documents, 0)):
        got = {r.doc_id: r for r in brown.score_documents(docs, held, rounds=3, most=most).collect()}
        assert set(got) == set(want)
        assert all(abs(got[d].score - want[d].score) <= 1e-9 * abs(want[d].score) for d in want)


def test_words_are_numbered_by_frequency(spark):
    vocab = spark.createDataFrame([(f"w{i}", 5 + i % 7) for i in range(500)], "word string, c bigint").repartition(9)
    out, n = brown.with_candidates(vocab, 8)
    rows = sorted((r for r in out.collect() if r.cand >= 0), key=lambda r: r.cand)
    assert [(-r.c, r.word) for r in rows] == sorted((-r.c, r.word) for r in rows)
    assert [r.cand for r in rows] == list(range(n)) and all(r.c < 8 for r in out.collect() if r.cand < 0)


def test_tokens():
    codes, dictionary, starts = brown.tokenize(pa.array(["A b\x85 \tÉ a", None, "", " \n", "b"]))
    got = [[dictionary[int(c)].as_py() for c in codes[a:b]] for a, b in zip(starts, starts[1:])]
    assert got == [["a", "b\x85", "É", "a"], [], [], [], ["b"]]
