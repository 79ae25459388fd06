from collections import Counter, defaultdict

from pyspark.sql import functions as F

from ontospark.llm import linededup


def brute(rows, least, keep_first=False):
    """rows: (doc_id, text) → (doc_id, kept text, lines, dropped)."""
    strip = " \t\n\x0b\x0c\r"
    lower = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s)
    docs, first = defaultdict(set), {}
    for r, (doc, text) in enumerate(rows):
        for i, line in enumerate((text or "").split("\n")):
            k = lower(line.strip(strip))
            if k:
                docs[k].add(r)
                at = (1 << 63) - 1 if doc is None else doc
                first[k] = min(first.get(k, (at, i)), (at, i))
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        at = (1 << 63) - 1 if doc is None else doc
        keys = [lower(x.strip(strip)) for x in lines]
        kept = [x for i, (x, k) in enumerate(zip(lines, keys)) if len(docs[k]) < least or keep_first and first[k] == (at, i)]
        out.append((doc, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return Counter(out)


def result(df):
    return Counter((r.row.doc_id, r.row.text, r.n_lines, r.n_dropped) for r in df.collect())


#: Small and large: what is broadcast, and what is joined instead.
WAYS = [{}, {"broadcast_bytes": -1}, {"filter_bits": 0}, {"broadcast_bytes": -1, "filter_bits": 0, "bits": 1 << 23}]


def test_documents(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    for (least, keep), way in zip(((10, False), (2, True), (2, False), (2, True)), WAYS, strict=True):
        assert result(linededup.dedup(documents.repartition(6), least, keep, **way)) == brute(rows, least, keep)


def test_a_full_filter_changes_nothing(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(999)), lambda i: F.concat(F.lit("l "), F.hash("id", i) % 300000)), "\n").alias("text"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert result(linededup.dedup(docs, 3, bits=linededup.LEAST_BITS)) == brute(rows, 3)


def test_few_lines_that_occur_once_are_suspected(spark):
    rows = spark.range(40000).select(F.col("id").alias("doc_id"), F.concat(F.lit("line "), "id", F.lit("\nother "), F.col("id") % 100).alias("text"))
    segments, bits = linededup.shape_of(linededup.count_lines(rows))
    twice = linededup.twice_filter(rows, segments, bits)
    found = linededup.suspects_by_broadcast(rows, twice, segments, bits, True).select("key").distinct().count()
    assert 100 <= found <= 100 + 0.05 * 40000
    other = linededup.suspects_by_segment(rows, twice, segments, bits)
    assert other.select("key").distinct().count() == found


def test_odd_documents_keep_their_columns(spark, odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    for way in WAYS:
        done = linededup.dedup(odd, 2, **way)
        assert result(done) == brute(rows, 2)
        assert done.select("row.*").columns == odd.columns
        assert linededup.dedup(none, 2, **way).count() == 0


def test_white_space_of_all_kinds_and_repeated_ids(spark):
    ends = ["", " ", "\t", "\r", "\x0b", "\x0c", "\x1c", "\x1f", "\x85", "\xa0", "\u1680", "\u2003", "\u2028", "\u2029", "\u202f", "\u3000", "\ufeff", "\r\r", " \x85 "]
    rows = [(i % 5 if i % 7 else None, f"{a}Hello W\u0130orld{b}\nown {i}") for i, (a, b) in enumerate((a, b) for a in ends for b in ends)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    for way in WAYS:
        assert result(linededup.dedup(docs, 2, **way)) == brute(rows, 2)
    tied = spark.createDataFrame([(1, f"same\nown {i}") for i in range(6)] + [(None, "same")], "doc_id bigint, text string")
    for way in WAYS:
        kept = [r.row.text for r in linededup.dedup(tied, 2, keep_first=True, **way).collect()]
        assert sum("same" in x.split("\n") for x in kept) == 1


def test_one_line_in_most_documents_over_many_tasks(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("  Same LINE \nown "), "id").alias("text")).repartition(70)
    done = linededup.dedup(docs, 10, keep_first=True).collect()
    assert sum(r.n_dropped for r in done) == 2999
    assert next(r for r in done if not r.n_dropped).row.doc_id == 0


def test_segments_of_any_corpus():
    assert linededup.shape_of(0) == (1, 1 << 20) and linededup.shape_of(10**6) == (8, 1 << 20) and linededup.shape_of(2 * 10**9) == (1 << 14, 1 << 20)
    for n in (10**10, 10**12, 10**14):
        segments, bits = linededup.shape_of(n)
        assert bits <= linededup.MOST_BITS and segments * bits >= linededup.BITS_A_LINE * n
