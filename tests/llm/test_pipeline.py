"""The pipeline's stages against plain rules on small tables."""

import re

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    from ontospark.llm.common import written

    docs, out = spark.read.parquet(f"{DATA}/documents.parquet"), []
    for name, f in corpus_pipeline.STAGES:
        after = written(f(spark, docs, DATA), "stage")
        out.append((name, docs, after))
        docs = after
    return out


def test_columns_and_order(spark, stages):
    assert [n for n, *_ in stages] == ["quality classifier", "line dedup", "SimHash near-dedup", "benchmark decontamination", "best-fit packing"]
    for _, before, after in stages[:-1]:
        assert after.columns == before.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert after.count() <= before.count()


def test_line_dedup_stage(stages):
    _, before, after = stages[1]
    key = lambda s: s.strip(" \t\n\x0b\x0c\r").lower()
    docs = {}
    for r in before.collect():
        for k in {key(x) for x in r.text.split("\n")} - {""}:
            docs.setdefault(k, set()).add(r.doc_id)
    often = {k for k, d in docs.items() if len(d) >= 10}
    want = {}
    for r in before.collect():
        kept = [x for i, x in enumerate(r.text.split("\n")) if key(x) not in often or r.doc_id == min(docs[key(x)]) and key(x) not in [key(y) for y in r.text.split("\n")[:i]]]
        if kept == r.text.split("\n") or "\n".join(kept).strip(" \t\n\x0b\x0c\r"):
            want[r.doc_id] = "\n".join(kept)
    assert {r.doc_id: r.text for r in after.collect()} == want


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_near_duplicate_stage(stages):
    _, before, after = stages[2]
    texts = {r.doc_id: shingles(r.text) for r in before.collect()}
    kept = {r.doc_id for r in after.collect()}
    like = lambda a, b: len(texts[a] & texts[b]) / len(texts[a] | texts[b])
    for a in kept:
        assert not any(like(a, b) >= 0.85 for b in kept if b < a)
    for d in set(texts) - kept:
        assert any(like(d, k) >= 0.5 for k in kept) or any(like(d, k) >= 0.6 for k in texts if k != d)


def test_decontamination_stage(spark, stages):
    _, before, after = stages[3]
    words = lambda s: re.findall(r"\w+", s.lower())
    items = [" ".join(words(r.text)) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    gone = {r.doc_id for r in before.collect()} - {r.doc_id for r in after.collect()}
    whole = {r.doc_id for r in before.collect() if any(f" {i} " in f" {' '.join(words(r.text))} " for i in items)}
    assert whole <= gone
    share = {r.doc_id for r in before.collect() if any(len(set(words(r.text)) & set(i.split())) >= 0.7 * len(set(i.split())) for i in items)}
    assert gone <= share


def test_packing_stage(stages):
    _, before, after = stages[4]
    assert {r.doc_id for r in after.select("doc_id").distinct().collect()} == {r.doc_id for r in before.collect()}
    assert after.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0


def test_odd_documents_at_every_stage(spark, odd, none):
    docs = odd.withColumn("n_chars", F.length("text"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    stages = dict(corpus_pipeline.STAGES)
    seen = lambda df: sorted(((r.doc_id, r.text or "") for r in df.collect()), key=str)
    for name in list(stages)[:-1]:
        assert stages[name](spark, docs, DATA).columns == docs.columns
    # nothing here is toxic, repeats a line ten times or holds a benchmark item
    everything = sorted(((d, t or "") for d, t in rows), key=str)
    assert seen(stages["quality classifier"](spark, docs, DATA)) == everything
    assert seen(stages["line dedup"](spark, docs, DATA)) == everything
    assert seen(stages["benchmark decontamination"](spark, docs, DATA)) == everything
    # one of three equal documents, of three without words, and of two long ones (equal sets of shingles but for one of two)
    kept = seen(stages["SimHash near-dedup"](spark, docs, DATA))
    assert [d for d, _ in kept] == sorted([0, 2, None, 5, 6, 7, 8], key=str)
    pieces = stages["best-fit packing"](spark, docs, DATA)
    assert pieces.where("piece = 0").count() == len(rows) and pieces.where("doc_id in (2, 3)").select("length").distinct().count() == 1
    for f in stages.values():
        assert f(spark, none.withColumn("n_chars", F.lit(0)), DATA).count() == 0


def test_near_duplicate_stage_tells_rows_apart_by_their_texts(spark):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    rows = [(None, text(1)), (None, text(2)), (None, text(2) + " more"), (7, text(3)), (7, text(4)), (7, text(4)), (9, text(1) + " end"), (None, text(5)), (None, text(5))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, DATA).collect()]
    assert sorted(got, key=str) == sorted([(9, text(1) + " end"), (None, text(2)), (7, text(3)), (7, text(4)), (None, text(5))], key=str)


def test_documents_of_repeated_and_blank_lines_go(spark):
    docs = spark.createDataFrame([(i, "Repeated line\n\n \t\n") for i in range(12)] + [(20, " \n"), (21, None), (22, "own\n\n")], "doc_id bigint, text string")
    got = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs, DATA).collect()}
    assert got == {0: "Repeated line\n\n \t\n", 20: " \n", 21: "", 22: "own\n\n"}
