import numpy as np
from pyspark.sql import functions as F

from ontospark.llm import quality


def test_held_out_accuracy(spark):
    """Fitted on half of the labels, judged on the other half."""
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 6000")
    labels = spark.read.parquet(f"{sf}/labels.parquet").where("doc_id < 6000")
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    got = quality.classify(docs, labels.where(fold)).join(labels.where(~fold), "doc_id").toPandas()
    bad = (got.quality == 0) | (got.toxic == 1)
    assert (~got.keep[bad]).mean() > 0.93
    assert got.keep[~bad].mean() > 0.98


def test_odd_documents(spark, odd, none):
    labels = spark.createDataFrame([(0, 1, 0), (2, 0, None), (2, 1, 1), (None, 0, 1), (7, None, 0)], "doc_id bigint, quality int, toxic int")
    got = quality.classify(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r.p_reject <= 1 and r.keep is not None for r in got)
    kept = quality.accepted(odd, labels)
    assert kept.columns == odd.columns
    for nothing in (labels.limit(0), labels.where("doc_id = 0")):
        assert quality.accepted(odd, nothing).count() == odd.count()
    assert quality.classify(none, labels).count() == 0
    assert quality.accepted(none, labels).count() == 0


def worth(groups, centre, m):
    """Concentration of groups {key: (rows, sum)} by moments."""
    n, nn = sum(n for n, _ in groups.values()), sum(n * n for n, _ in groups.values())
    if len(groups) < 2 or n * n == nn:
        return 1e9
    d = sum(n * (s / n - centre(k)) ** 2 for k, (n, s) in groups.items())
    within = m * (1 - m)
    between = (d - (len(groups) - 1) * within) / (n - nn / n)
    return min(1e9, max(2.0, within / between - 1)) if between > 0 else 1e9


def by_hand(rows):
    """(host, path, p) → prior of each row, from all other rows."""
    m = sum(r[2] for r in rows) / len(rows)

    def grouped(key):
        out = {}
        for r in rows:
            n, s = out.get(key(r), (0, 0.0))
            out[key(r)] = (n + 1, s + r[2])
        return out

    hosts, sites = grouped(lambda r: r[0]), grouped(lambda r: r[:2])
    a = worth(hosts, lambda k: m, m)
    post = {h: (s + a * m) / (n + a) for h, (n, s) in hosts.items()}
    b = worth(sites, lambda k: post[k[0]], m)
    out = []
    for host, path, p in rows:
        (n, s), (hn, hs) = sites[host, path], hosts[host]
        out.append((s - p + b * (hs - p + a * m) / (hn - 1 + a)) / (n - 1 + b))
    return out, m


def test_shrinking_against_direct_sums(spark):
    rng = np.random.default_rng(5)
    rows = [("big", f"p{i % 3}", float(x)) for i, x in enumerate(rng.random(300))] + [("small", "q", 0.99), ("bad", "r", 0.9), ("bad", "r", 0.95), ("bad", "s", 0.97)]
    given = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, host string, path string, p double")
    got = {r.i: r for r in quality.decided(given, quality.site_priors(given)).collect()}
    want, m = by_hand(rows)
    for i, prior in enumerate(want):
        assert abs(got[i].prior - prior) < 1e-9
        odds = rows[i][2] / (1 - rows[i][2]) * (1 - m) / m * prior / (1 - prior)
        assert abs(got[i].p_reject - odds / (1 + odds)) < 1e-9
    assert m < got[301].prior < 0.97


def test_own_evidence_counts_once(spark):
    """A lone document of a site has the prior of the corpus, whatever its own probability."""
    rows = [(f"h{i % 20}", "p", 0.08 + 0.04 * (i % 2)) for i in range(200)]
    for p in (0.3, 0.9):
        given = spark.createDataFrame([*rows, ("alone", "p", p)], "host string, path string, p double")
        priors = quality.site_priors(given)
        r = quality.decided(given, priors).where("host = 'alone'").first()
        assert abs(r.prior - priors.mean) < 1e-9 and abs(r.p_reject - p) < 1e-6


def test_the_query_against_plain_loops(spark, documents):
    """Every document's probabilities and decision by loops over its features; and the weights by counting."""
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    model = quality.fit(documents, labels)
    got = {r.doc_id: r for r in quality.classify(documents, labels).collect()}
    docs = documents.collect()
    assert len(got) == len(docs) and model.weights

    def p_of(text, h):
        words = quality.tokens((text or "").lower())
        raw = sum(model.weights.get(f, (0, 0))[h] for f in quality.shapes(words, len(set(words)), text or ""))
        for w in set(words):
            raw += max((model.weights.get(f, (0, 0))[h] for f in quality.own_features(w)), key=abs)
        slope, intercept = model.calibration[h]
        return 1 / (1 + np.exp(-np.clip(slope * raw + intercept, -30, 30)))

    ps = [(p_of(r.text, 0), p_of(r.text, 1)) for r in docs]
    prior, m = by_hand([(r.source or "", r.lang or "", 1 - (1 - a) * (1 - b)) for r, (a, b) in zip(docs, ps, strict=True)])
    for r, (a, b), x in zip(docs, ps, prior, strict=True):
        g, p = got[r.doc_id], min(max(1 - (1 - a) * (1 - b), 1e-9), 1 - 1e-9)
        assert abs(g.p_low - a) < 1e-9 and abs(g.p_toxic - b) < 1e-9 and abs(g.prior - x) < 1e-9
        odds = p / (1 - p) * (1 - m) / m * x / (1 - x)
        assert abs(g.p_reject - odds / (1 + odds)) < 1e-6 and g.keep == (g.p_reject < 0.5)


def test_rows_that_repeat_a_labelled_id_are_fitted_once(spark):
    docs = spark.createDataFrame([(i, f"word{i % 2} text {i}") for i in range(40)] * 5, "doc_id bigint, text string").selectExpr("*", "'a' AS source", "'b' AS lang")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id bigint, quality int, toxic int")
    assert quality.fit(docs, labels) == quality.fit(docs.dropDuplicates(["doc_id"]), labels)
