import hashlib
import random
import re
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from ontospark.llm import fingerprint, queries

DATA = "/root/testdata/sf0.001"


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def shingles(text):
    words = [signed(xxhash.xxh64_intdigest(w.encode(), seed=42)) for w in re.split(r"[\x20\x09-\x0D]+", (text or "").lower()) if w]
    runs = [words[i : i + 5] for i in range(len(words) - 4)] or ([words] if words else [])
    out = set()
    for run in runs:
        h = 42
        for x in run:
            h = xxhash.xxh64_intdigest(struct.pack("<q", x), seed=h)
        out.add(signed(h))
    return out


def sketch(text, k=fingerprint.K):
    return sorted(shingles(text))[:k]


def near(a, b, k=fingerprint.K):
    union = sorted(set(a) | set(b))[:k]
    return len(set(union) & set(a) & set(b)) / len(union) if union else 1.0


def brute(docs):
    """docs: (doc_id, text); nulls last."""
    docs = sorted(docs, key=lambda d: (-(d[0] if d[0] is not None else -(2**63)), signed(xxhash.xxh64_intdigest((d[1] or "").encode(), seed=42))))
    out = []
    for i, (doc, text) in enumerate(docs):
        text, following = text or "", docs[(i + 1) % len(docs)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        a, b = sketch(text), sketch(edited)
        show = lambda x: ",".join(map(str, x))
        out.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), show(a), show(b), round(near(a, b), 12), round(near(a, sketch(following)), 12)))
    return sorted(out, key=str)


def result(df):
    return sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 12), round(r.near_next, 12)) for r in df.collect()), key=str)


def test_registered_query(spark):
    df = queries.op12_fingerprint(spark, DATA)
    plan = df._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "ArrowEval"))
    assert result(df) == brute([(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()])


@pytest.mark.parametrize("case", ["odd", "one", "none"])
def test_odd_documents(spark, odd, none, tmp_path, case):
    docs = {"odd": odd, "one": odd.where("doc_id = 5"), "none": none}[case]
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert result(queries.op12_fingerprint(spark, str(tmp_path))) == (brute([(r.doc_id, r.text) for r in docs.collect()]) if case != "none" else [])


def test_a_column_named_like_the_bucket(spark, odd):
    rows, _ = fingerprint.neighbours(odd, "doc_id", "text", 1000)
    kept = rows.where("NOT ghost")
    assert kept.count() == odd.count() and kept.select("row.*").columns == odd.columns


def test_estimates(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(5000)]
    words = [rng.choice(vocabulary) for _ in range(40_000)]
    texts = {"a": " ".join(words[:30_000]), "b": " ".join(words[15_000:]), "c": " ".join(words[:15_000]), "d": "few words", "e": ""}
    df = spark.createDataFrame([(n, t) for n, t in texts.items()], "name string, text string")
    made = {r.name: r.sketch for r in fingerprint.sketched(df, {"sketch": F.col("text")}, k=1024).select("name", "sketch").collect()}
    pairs = spark.createDataFrame([(x, y, made[x], made[y]) for x in made for y in made], "x string, y string, a array<bigint>, b array<bigint>")
    a, b = F.col("a"), F.col("b")
    for r in pairs.select("x", "y", fingerprint.resemblance(a, b, 1024).alias("j"), fingerprint.containment(a, b, 1024).alias("c"), fingerprint.distinct_shingles(a, 1024).alias("n")).collect():
        s, t = shingles(texts[r.x]), shingles(texts[r.y])
        assert r.j == pytest.approx(len(s & t) / len(s | t) if s | t else 1, abs=0.06)
        assert r.c == pytest.approx(len(s & t) / len(s) if s else float(not t), abs=0.12)
        assert r.n == pytest.approx(len(s), rel=0.12)


def test_sketches_of_parts_merge(spark):
    parts = [("x", "a b c d e f g"), ("x", "c d e f g h i"), ("x", None), (None, "q"), (None, "q"), ("y", ""), ("z", " ".join(f"t{i}" for i in range(900))), ("z", " ".join(f"t{i}" for i in range(400, 1900)))]
    df = spark.createDataFrame(parts, "grp string, text string").repartition(4)
    got = {r.grp: r.sketch for r in fingerprint.merge(fingerprint.sketched(df, {"sketch": F.col("text")}), ["grp"]).collect()}
    assert set(got) == {"x", "y", "z", None}
    for name, found in got.items():
        assert found == sorted(set().union(*(shingles(t) for g, t in parts if g == name)))[: fingerprint.K]
    two = fingerprint.sketched(df.where("grp = 'z'"), {"sketch": F.col("text")}).agg(F.min("sketch").alias("a"), F.max("sketch").alias("b"))
    assert two.select(fingerprint.merged(F.col("a"), F.col("b")).alias("x")).first().x == got["z"]
