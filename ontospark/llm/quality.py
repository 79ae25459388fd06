"""Quality classifier: hierarchical empirical Bayes.

Evidence of a document: log odds of the features it has (words, runs of signs, word beginnings, a few
shapes), one head for low quality and one for toxic, learned by grouped counts over labelled
documents and calibrated on a fold that the counts don't see. The site then moves
the prior: hosts shrink towards the corpus, paths of a host towards their host, each by
as much as the spread between them bears out (moments of grouped sums). A document's prior comes from the other
documents of its path and host only, so its own evidence counts once. A document is rejected if its posterior says so.
The host is the column ``source``, the path within it ``lang``.

Copies would make the words of one text look like marks of its label, so labelled documents that share a
sketch (the least hash of their five-word shingles, of two kinds) weigh as much as one together; and only
features that speak for a label count, as no word speaks against one.

Only the fit uses a sample, of ``FIT_ROWS`` labelled documents at most, those with the smallest hash of
their id (one row of each id); all documents are scored once and all enter the site sums. Every feature of the fitted documents that
passes the tests below is used; ``MIN_SHARE`` is a share of the fitted documents, whatever the corpus's size. Tables of sites are broadcast when
they have ``SITES`` rows at most, else joined, where the adaptive skew join splits a host with many
rows.

Defined cases: null text is empty, null host and path are the empty host and path; ids labelled twice
count once, with the worse label; without labels, or with labels of one kind, a head says nothing
(its probability is the prior) and rejects nothing; null ids are scored like others; repeated rows are each scored and
counted; empty tables give no row; all columns are kept, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship, slices, written

FIT_ROWS, SITES = 20_000, 50_000
#: A feature counts if it is in so many fitted documents and such a share of them, with so large log odds, so many deviations from chance.
MIN_DOCS, MIN_SHARE, MIN_ODDS, MIN_Z, MAX_ODDS = 5, 0.002, 1.5, 4.0, 12.0
tokens = re.compile(r"\w+|[^\w\s]+").findall
HEADS = ("low", "toxic")


def own_features(word: str) -> tuple[str, ...]:
    """The features of one word: itself and its beginnings."""
    return (word, "^4" + word[:4], "^5" + word[:5]) if len(word) > 5 else (word, "^4" + word[:4]) if len(word) > 4 else (word,)


def shapes(words: list[str], distinct: int, text: str) -> tuple[str, ...]:
    """Features of the whole document: repetition, its most frequent word, signs among the words, length of lines."""
    n = max(1, len(words))
    signs = sum(1 for w in words if not w[0].isalnum())
    top = max(Counter(words).values(), default=0) if n >= 8 else 0
    lines = int(math.log2(1 + len(text) / (1 + text.count("\n")) / 40))
    return f"#repeats {min(5, int(2 * math.log2(n / max(1, distinct))))}", f"#top {min(3, int(10 * top / n))}", f"#signs {int(10 * signs / n)}", f"#lines {min(3, lines)}"


def sketches(text: str | None) -> tuple[int, int]:
    """The least hash of the five-word shingles, for two seeds, as signed numbers."""
    words = (text or "").lower().split()
    grams = {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}
    return tuple(min(xxhash.xxh3_64_intdigest(g, seed) for g in grams) - (1 << 63) for seed in (1, 2))


def features(text: str | None) -> set[str]:
    text = text or ""
    words = tokens(text.lower())
    distinct = set(words)
    out = set(shapes(words, len(distinct), text))
    for w in distinct:
        out.update(own_features(w))
    return out


@dataclass
class Model:
    """weights: feature → (log odds low, toxic); calibration: (slope, intercept) of each head; prior: share of each label."""

    weights: dict[str, tuple[float, float]]
    calibration: list[tuple[float, float]]
    prior: list[float]

    def raw(self, texts: list[str | None]) -> np.ndarray:
        """Sums of log odds, (texts × heads). A word's weight is remembered."""
        get, known, none = self.weights.get, {}, (0.0, 0.0)
        out = np.zeros((len(texts), 2))
        for i, text in enumerate(texts):
            text = text or ""
            words = tokens(text.lower())
            distinct = set(words)
            low = toxic = 0.0
            for f in shapes(words, len(distinct), text):
                a, b = get(f, none)
                low, toxic = low + a, toxic + b
            for w in distinct:
                if (x := known.get(w)) is None:
                    found = [get(f, none) for f in own_features(w)]
                    x = known[w] = tuple(max((y[h] for y in found), key=abs) for h in (0, 1))
                if x != none:
                    low, toxic = low + x[0], toxic + x[1]
            if len(known) > 1 << 20:
                known.clear()
            out[i] = low, toxic
        return out

    def probabilities(self, texts: list[str | None]) -> np.ndarray:
        raw = self.raw(texts)
        out = np.empty_like(raw)
        for h, (slope, intercept) in enumerate(self.calibration):
            out[:, h] = 1 / (1 + np.exp(-np.clip(slope * raw[:, h] + intercept, -30, 30)))
        return out


def calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray, prior: float) -> tuple[float, float]:
    """Logistic regression on one number, by Newton steps with a weak pull to slope 0.5; slope stays positive."""
    if not len(y) or y.min() == y.max():
        p = min(max(prior, 1e-3), 0.3)
        return (0.5 if 0 < prior < 1 else 0.0), math.log(p / (1 - p))
    a, b = 0.5, math.log(max(prior, 1e-3) / (1 - min(prior, 0.999)))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = weight * p * (1 - p) + 1e-9
        g = np.array([(weight * (y - p) * x).sum() - (a - 0.5), (weight * (y - p)).sum()])
        h = np.array([[(w * x * x).sum() + 1, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = max(0.01, a + float(np.clip(step[0], -1, 1))), b + float(np.clip(step[1], -2, 2))
        if np.abs(step).max() < 1e-6:
            break
    return a, b


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """Learns from at most ``rows`` labelled documents: three quarters give the weights, a quarter the calibration."""
    ship(docs.sparkSession)
    one = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("of")).agg(
        F.coalesce(F.max(F.when(F.col("quality") == 0, 1).otherwise(0)), F.lit(0)).alias("low"),
        F.coalesce(F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)), F.lit(0)).alias("toxic"),
    )
    mixed = F.xxhash64(F.col("of"), F.lit(17))
    sample = one.orderBy(mixed, "of").limit(rows)  # `rows` small rows at most
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), F.col("doc_id") == F.col("of"))
    one_each = found.groupBy("of").agg(F.min(F.struct("text", "low", "toxic")).alias("x"))  # rows may repeat an id
    labelled = one_each.select("x.*")

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = np.array([sketches(t) for t in batch.column(0).to_pylist()], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s[:, 0]), pa.array(s[:, 1])], ["text", "low", "toxic", "s1", "s2"])

    labelled = written(labelled.mapInArrow(sketch, "text string, low int, toxic int, s1 bigint, s2 bigint"), "labelled")
    for s in ("s1", "s2"):
        sizes = labelled.groupBy(F.col(s).alias("of")).agg(F.count("*").alias(f"n_{s}"))
        labelled = labelled.join(F.broadcast(sizes), F.col(s) == F.col("of")).drop("of")  # `rows` rows at most
    labelled = labelled.select("text", "low", "toxic", (1 / F.greatest("n_s1", "n_s2")).alias("weight"), F.pmod(F.xxhash64("s1"), F.lit(4)).alias("fold"))
    schema = pa.schema([("feature", pa.string()), ("n", pa.float64()), ("low", pa.float64()), ("toxic", pa.float64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, low, toxic = Counter(), Counter(), Counter()
        for batch in batches:
            for text, a, b, weight in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                f = features(text)
                f.add("")  # every document has it
                for sums in (n, low if a else None, toxic if b else None):
                    if sums is not None:
                        for x in f:
                            sums[x] += weight
        for at in range(0, len(n), 50_000):
            part = list(n)[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), *(pa.array([float(c[x]) for x in part]) for c in (n, low, toxic))], schema=schema)

    counts = labelled.where("fold > 0").select("text", "low", "toxic", "weight").mapInArrow(count, "feature string, n double, low double, toxic double")
    counts = written(counts.groupBy("feature").agg(*(F.sum(c).alias(c) for c in ("n", *HEADS))).where((F.col("n") >= MIN_DOCS) | (F.col("feature") == "")), "features")
    every = counts.where("feature = ''").first()
    if every is None:
        return Model({}, [(0.0, -5.0)] * 2, [0.0, 0.0])
    total = every.n
    prior = [every[h] / total for h in HEADS]
    scored = counts.where("feature <> ''")
    for h, p in zip(HEADS, prior, strict=True):
        pos, neg = F.col(h) + 0.5, F.col("n") - F.col(h) + 0.5
        odds = F.log(pos / (every[h] + 1)) - F.log(neg / (total - every[h] + 1))
        z = (F.col(h) - F.col("n") * p) / F.sqrt(F.col("n") * max(p * (1 - p), 1e-9))
        use = (F.col("n") >= MIN_SHARE * total) & (odds >= MIN_ODDS) & (z >= MIN_Z) & F.lit(0 < p < 1)
        scored = scored.withColumn(f"{h}_w", F.when(use, F.least(F.lit(MAX_ODDS), odds)).otherwise(0.0))
    # features of `rows` documents, each in MIN_DOCS of them at least
    weights = {r.feature: (r.low_w, r.toxic_w) for r in scored.where("low_w > 0 OR toxic_w > 0").collect()}
    model = Model(weights, [(1.0, 0.0)] * 2, prior)

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = model.raw(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1]), *batch.columns[1:]], ["a", "b", "low", "toxic", "weight"])

    held = labelled.where("fold = 0").select("text", "low", "toxic", "weight").mapInArrow(raw, "a double, b double, low int, toxic int, weight double").toPandas()  # rows of five numbers
    model.calibration = [calibrate(held[x].to_numpy(float), held[h].to_numpy(float), held.weight.to_numpy(float), p) for x, h, p in zip(("a", "b"), HEADS, prior, strict=True)]
    return model


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``row`` (a struct of all columns), ``p_low``, ``p_toxic`` and ``p`` (either)."""
    ship(docs.sparkSession)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    given = docs.sparkSession.sparkContext.broadcast(model)  # features of FIT_ROWS documents

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 8 << 20):
            p = given.value.probabilities(batch.column(1).to_pylist())
            both = 1 - (1 - p[:, 0]) * (1 - p[:, 1])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x) for x in (p[:, 0], p[:, 1], both))], ["row", "p_low", "p_toxic", "p"])

    return rows.mapInArrow(score, f"row {rows.schema['row'].dataType.simpleString()}, p_low double, p_toxic double, p double")


def strength(n: str, s: str, mean: Column | float) -> tuple[Column, ...]:
    """Aggregates for the moments of beta-binomial groups with ``n`` rows and sum ``s``: groups, rows, squares of rows, weighted squared deviations."""
    rate = F.col(s) / F.col(n)
    return F.count("*").alias("k"), F.sum(n).alias("n"), F.sum(F.col(n) * F.col(n)).alias("nn"), F.sum(F.col(n) * (rate - mean) ** 2).alias("d")


def concentration(k: int, n: float, nn: float, d: float, mean: float) -> float:
    """Prior rows that a group's mean is worth, from the spread between groups beyond chance; very many if there is none."""
    if not k or k < 2 or not n or n * n == nn:
        return 1e9
    within = mean * (1 - mean)
    between = (d - (k - 1) * within) / (n - nn / n)
    return min(1e9, max(2.0, within / between - 1)) if between > 0 else 1e9


@dataclass
class Priors:
    """sites: ``host, path, n, s, hn, hs`` (rows and sums of the path and of its host); the corpus's mean; what a host's and a path's prior is worth in rows."""

    sites: DataFrame
    mean: float
    alpha: float
    beta: float

    def without(self, p: Column) -> Column:
        """The prior of a document with probability ``p`` by all others, shrunken path → host → corpus."""
        host = (F.col("hs") - p + self.alpha * self.mean) / (F.col("hn") - 1 + self.alpha)
        return (F.col("s") - p + self.beta * host) / (F.col("n") - 1 + self.beta)


def site_priors(evidence: DataFrame) -> Priors:
    """The sums of all sites of ``host, path, p``, added up before they are shuffled."""
    sites = written(evidence.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s")), "sites")
    hosts = sites.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"))
    all_ = hosts.agg(F.sum("hn").alias("n"), F.sum("hs").alias("s")).first()
    mean = min(max(all_.s / all_.n, 1e-6), 1 - 1e-6) if all_.n else 0.5
    alpha = concentration(*hosts.agg(*strength("hn", "hs", mean)).first(), mean)
    both = written(sites.join(hosts, "host"), "priors")
    post = (F.col("hs") + alpha * mean) / (F.col("hn") + alpha)
    return Priors(both, mean, alpha, concentration(*both.agg(*strength("n", "s", post)).first(), mean))


def decided(evidence: DataFrame, priors: Priors, threshold: float = 0.5) -> DataFrame:
    """Adds ``prior``, ``p_reject`` and ``keep`` to rows with ``host, path, p``."""
    few = priors.sites.limit(SITES + 1).count() <= SITES
    odds = lambda p: F.log(p / (1 - p))
    clipped = lambda p: F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), p))
    joined = evidence.join(F.broadcast(priors.sites) if few else priors.sites, ["host", "path"]).withColumn("prior", clipped(priors.without(F.col("p"))))
    logit = odds(clipped(F.col("p"))) - math.log(priors.mean / (1 - priors.mean)) + odds(F.col("prior"))
    return joined.withColumn("p_reject", 1 / (1 + F.exp(-logit))).withColumn("keep", F.col("p_reject") < threshold)


def site(row: str = "row", host: str = "source", path: str = "lang") -> list[Column]:
    return [F.coalesce(F.col(f"{row}.{c}").cast("string"), F.lit("")).alias(name) for c, name in ((host, "host"), (path, "path"))]


def classify(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, threshold: float = 0.5) -> DataFrame:
    """``doc_id, host, path, p_low, p_toxic, prior, p_reject, keep`` of every document."""
    skinny = docs.select("doc_id", "text", "source", "lang")
    evidence = scored(skinny, fit(docs, labels, rows)).select("row.doc_id", *site(), "p_low", "p_toxic", "p")
    evidence = written(evidence, "evidence")
    return decided(evidence, site_priors(evidence), threshold).select("doc_id", "host", "path", "p_low", "p_toxic", "prior", "p_reject", "keep")


def accepted(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, threshold: float = 0.5) -> DataFrame:
    """The documents that aren't rejected, columns as they are. Texts are scored once and written with their scores."""
    full = written(scored(docs, fit(docs, labels, rows)).select("row", *site(), "p"), "evidence")
    return decided(full, site_priors(full.select("host", "path", "p")), threshold).where("keep").select("row.*")
