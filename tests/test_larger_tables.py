"""Steps whose cost must not grow with pairs, one key's rows or a wrong guess: the same results, and plans without the costly exchange."""

import pytest
from pyspark.sql import functions as F

from ontospark.functions import vocab as v
from ontospark.operators import closure, docs, nested, patterns, refactor, rules, shacl, spaces
from ontospark.sources import lines, projection

X = "http://x/"


def graph(spark, rows):
    term = lambda x: ("bnode", x[2:]) if x.startswith("_:") else ("literal", x[1:]) if x.startswith('"') else ("iri", x)
    full = [(term(s)[1], term(s)[0], p, term(o)[1], term(o)[0], "", "") for s, p, o in rows]
    return spark.createDataFrame(full, "s string, s_kind string, p string, o string, o_kind string, o_dt string, o_lang string")


def same(a, b):
    assert sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect()))


@pytest.fixture(scope="module")
def shaped(spark):
    """Classes below two tops with properties, one of them with a closed list; some have properties of their own, two have one local name."""
    rows = [(X + t, v.TYPE, v.OWL_CLASS) for t in ("A", "B", "T")] + [(X + "A", v.SUBCLASS, X + "T"), (X + "B", v.SUBCLASS, X + "T")]
    for k in range(23):
        c = X + ("y/C" if k == 7 else "C") + str(k if k != 7 else 8)
        rows += [(c, v.TYPE, v.OWL_CLASS), (c, v.SUBCLASS, X + "AB"[k % 2])] + ([(c, v.SUBCLASS, X + "B")] if k % 5 == 0 else [])
    for k in range(11):
        rows += [(f"{X}p{k}", v.TYPE, v.OBJECT_PROPERTY), (f"{X}p{k}", v.DOMAIN, X + "ABT"[k % 3]), (f"{X}p{k}", v.RANGE, v.XSD + "string" if k % 4 else X + "L")]
        rows += [(f"{X}p{k}", v.LABEL, f'"label {k}')] * (k % 2) + [(f"{X}p{k}", v.TYPE, v.FUNCTIONAL)] * (k % 3 == 0) + [(f"{X}p{k}", v.DOMAIN, X + "C3")] * (k in (2, 5))
    rows += [(X + "L", v.ONE_OF, "_:a"), ("_:a", v.FIRST, '"one'), ("_:a", v.REST, "_:b"), ("_:b", v.FIRST, X + "two"), ("_:b", v.REST, v.NIL), (X + "L", v.TYPE, v.RDFS + "Datatype")]
    return graph(spark, dict.fromkeys(rows)).cache()


def test_totals_of_shapes_are_those_of_the_triples(shaped, monkeypatch):
    found = shacl.full_shapes(shaped, X, ignored=[v.LABEL]).cache()
    assert found.count() == found.distinct().count()
    want = found.groupBy("p").agg(F.count("*").alias("n"), F.min("s").alias("first_s"), F.max("o").alias("last_o")).cache()
    assert want.where(F.col("p").isin(shacl.SH + "in", v.REST)).count() == 2
    same(shacl.full_shape_totals(shaped, X, ignored=[v.LABEL]), want)
    monkeypatch.setattr(shacl, "BLOCK", (2, 3))
    monkeypatch.setattr(shacl, "PAIRS", 7)
    same(shacl.full_shape_totals(shaped, X, ignored=[v.LABEL]), want)


def test_nodes_beyond_a_bound_and_forms_without_one(shaped, monkeypatch):
    found = shacl.full_shapes(shaped, X, ignored=[v.LABEL])
    want = found.groupBy("p").agg(F.count("*").alias("n"), F.min("s").alias("first_s"), F.max("o").alias("last_o")).cache()
    for likely in (2, 0.1):  # some forms have a node that begins with 0 and one with f; then hardly any
        monkeypatch.setattr(shacl, "LIKELY", likely)
        same(shacl.full_shape_totals(shaped, X, ignored=[v.LABEL]), want)


def test_inherited_constraints_are_made_once_for_each_kind(shaped):
    members, rows = shacl._by_kind(shaped, "strict", True)
    assert rows.select("kind").distinct().count() < members.count() / 2
    whole = shacl.constraints(shaped, "strict", True)
    same(whole, shacl._expanded(members, rows, together=2))
    # a class on paths of its own has none of those above; all others are merged from above
    own = shaped.where((F.col("p") == v.DOMAIN) & (F.col("o") == X + "C3")).select(F.col("s").alias("path"))
    assert whole.where(F.col("class") == X + "C3").join(own, "path").count() == 2 and whole.where(F.col("class") == X + "C3").count() == 11 - sum(k % 3 == 0 and k not in (2, 5) for k in range(11))
    one = shacl.inherited(shaped).groupBy("class").agg(F.count("*").alias("n"), F.min("from_class").alias("first_from"))
    same(shacl.inherited_counts(shaped), one)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_whole_predicates_are_not_broadcast_by_their_files_sizes(spark, tmp_path):
    rows = [(f"{X}o{k}", v.TYPE, f"{X}c{k % 3}") for k in range(20)] + [(f"{X}o{k}", X + "status", '"F') for k in range(20)]
    graph(spark, rows).write.parquet(str(tmp_path / "g"))
    g, asked = spark.read.parquet(str(tmp_path / "g")), [("?order", v.TYPE, "?c"), ("?order", X + "status", "?status")]
    counts = {v.TYPE: (1_000_000, 1_000_000, 3), X + "status": (1_000_000, 1_000_000, 1)}
    for df in (patterns.bgp(g, *asked), patterns.bgp(g, *asked, counts=counts)):
        assert "SortMergeJoin" in plan(df) and "BroadcastHashJoin" not in plan(df) and df.count() == 20


@pytest.mark.parametrize("made, kind", [(docs.literal_notes, v.DATATYPE_PROPERTY), (docs.instance_links, v.OBJECT_PROPERTY)])
def test_triples_are_not_dealt_by_predicate(spark, tmp_path, made, kind):
    rows = [(X + "C", v.TYPE, v.OWL_CLASS), (X + "p", v.TYPE, kind), (X + "q", v.TYPE, v.ANNOTATION_PROPERTY)]
    rows += [t for k in range(9) for t in ((f"{X}i{k}", v.TYPE, X + "C"), (f"{X}i{k}", X + "p", f'"{k}' if kind == v.DATATYPE_PROPERTY else f"{X}i{k // 2}"), (f"{X}i{k}", X + "q", f'"{k}'))]
    graph(spark, rows).write.parquet(str(tmp_path / "g"))
    g = spark.read.parquet(str(tmp_path / "g"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = made(g, g.where(F.col("o") == v.OWL_CLASS).select(F.col("s").alias("uri")), {"x": X})
        assert "hashpartitioning(p" not in plan(df) and df.count() == 9
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_renaming_by_a_large_mapping_keeps_literals_out_of_the_join(spark, monkeypatch):
    rows = [(f"{X}a{k}", v.TYPE, X + "C") for k in range(30)] + [(f"{X}a{k}", X + "p", '"F') for k in range(30)] + [("_:a1", X + "p", f"{X}a1"), (f"{X}a2", X + "q", f'"{X}a1')]
    g, mapping = graph(spark, rows), spark.createDataFrame([(f"{X}a{k}", f"{X}b{k}") for k in range(20)] + [(X + "C", X + "D"), (X + "p", X + "r")], "old string, new string")
    want = refactor.rename_entities(g, mapping).cache()
    assert want.count() == len(rows) and want.where(F.col("o") == X + "D").count() == 30 and want.where(F.col("o") == X + "a1").count() == 1
    monkeypatch.setattr(refactor, "FEW", 0)
    same(refactor.rename_entities(g, mapping), want)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = refactor.mapped(g, mapping, "o", "o_kind")
        assert "_deal" in plan(df)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_lines_of_a_folder_are_numbered_across_its_files(spark, tmp_path):
    rows = [(f"{k // 90}", f"{k:03d} <{X}a{k % 7}>") for k in range(180)]
    df = spark.createDataFrame(rows, "part string, value string").repartitionByRange(5, "part", "value").sortWithinPartitions("part", "value")
    df.write.partitionBy("part").option("compression", "gzip").text(str(tmp_path / "f"))
    assert len(list((tmp_path / "f").glob("part=0/*.gz"))) > 1
    got = lines.numbered(spark, str(tmp_path / "f"), folders=True)
    assert sorted((r.file[-1], r.line, r.value) for r in got.collect()) == [(part, k % 90 + 1, value) for k, (part, value) in enumerate(rows)]
    found = lines.first_mentions(got, spark.createDataFrame([(f"{X}a{k}",) for k in range(9)], "uri string"))
    assert {(r.uri, r.file[-1]): r.line for r in found.collect()} == {(f"{X}a{k}", part): (k - 90 * int(part)) % 7 + 1 for k in range(7) for part in "01"}


def test_mentions_are_found_in_one_reading_of_the_lines(spark, tmp_path):
    rows = [f"<{X}a{k % 5}> <{X}p> <{X}a{k % 3}> ." for k in range(20)] + ["ex:a7 ex:p <http://y/a6> .", " <http://y/a6> ex:p ex:a3 .", "\tx:a9 x:p 'a<b:c>' ."]
    for name in "ab":
        (tmp_path / f"{name}.nt").write_text("\n".join(rows[k] for k in range(len(rows)) if name == "a" or k % 2) + "\n")
    read = lines.numbered(spark, str(tmp_path)).withColumn("file", F.substring_index("file", "/", -1))
    uris = [f"{X}a{k}" for k in range(10)] + ["http://y/a6", "b:c"]
    found = lines.first_mentions(read, spark.createDataFrame([(x,) for x in uris], "uri string"))
    assert plan(found).count("FileScan text") == 1
    whole = {(r.uri, r.file): r.line for r in found.collect()}
    assert whole[X + "a7", "a.nt"] == 21 and whole[X + "a3", "a.nt"] == 4 and whole["http://y/a6", "a.nt"] == 22 and whole[X + "a9", "a.nt"] == 23 and whole["b:c", "a.nt"] == 23
    # entities of one file are looked up in it alone
    of = [(x, "ab"[k % 2] + ".nt") for k, x in enumerate(uris)]
    own = lines.first_mentions(read, spark.createDataFrame(of, "uri string, file string"))
    assert {(r.uri, r.file): r.line for r in own.collect()} == {k: n for k, n in whole.items() if k in of}


def test_sources_that_meet_after_their_mapping(spark, monkeypatch):
    def triples(k):
        return [(f"{X}a{i}", X + "knows", f"{X}b{i % 3}") for i in range(k, k + 6)] + [(f"http://y/a{i}", X + "note", f'"{i}') for i in range(k + 3)] + [("_:n", X + "note", '"0'), ("_:n", X + "knows", X + "a1")]

    sources = [(f"s{k}", graph(spark, triples(k % 4) * 2).coalesce(1)) for k in range(5)]
    monkeypatch.setattr(rules, "BITS", 2)
    # subjects of two namespaces become equal, and one more by the mapping
    names = spark.createDataFrame([(X + "a", "n:", 1), ("http://y/a", "n:", 2), (X, "z:", 3), (X + "b", "never", 4), (X + "b1", None, 0), (None, "n", 0), ("", "n", 0)], "ns string, value string, place int")
    mapping = spark.createDataFrame([("n:3", "n:2"), ("z:knows", "z:near")], "old string, new string")
    made = [rules.Rule("notes", [("?x", "z:note", "?n")], [("?x", "z:said", "?n"), ("?x", "z:note", '"9')]), rules.Rule("back", [("?x", "z:said", '"1')], [("?x", "z:note", '"1')])]

    def moved(x, p):
        if p is not None and (p, x) != (0, X + "b1"):
            x = next((v + x[len(n):] for n, v in ((X + "a", "n:"), ("http://y/a", "n:"), (X, "z:")) if x.startswith(n)), x)
        return {"n:3": "n:2", "z:knows": "z:near"}.get(x, x) if p is not None else x

    all_ = {}
    for k, (name, _) in enumerate(sources):
        for s, p, o in triples(k % 4):
            key = (moved(s, 0) if not s.startswith("_:") else "n", moved(p, 0), moved(o, 0) if not o.startswith('"') else o[1:])
            all_.setdefault(key, set()).add(name)
    done = {t for t in all_ if t[1] != "z:note"} | {(s, "z:said", o) for s, p, o in all_ if p == "z:note" and o != "1"} | {(s, "z:note", o) for s, p, n in all_ if p == "z:note" for o in ("9", *(["1"] if n == "1" else []))}
    want = sorted((*t, x or "") for t in done for x in all_.get(t, {None}))
    got, _ = rules.migrate(sources, names, mapping, made)
    assert sorted((r.s, r.p, r.o, r.source or "") for r in got.collect()) == want
    monkeypatch.setattr(spaces, "FEW", 0)
    monkeypatch.setattr(refactor, "FEW", 0)
    got, _ = rules.migrate(sources, names, mapping, made)
    assert sorted((r.s, r.p, r.o, r.source or "") for r in got.collect()) == want


def test_sources_are_merged_where_they_lie(spark, monkeypatch):
    old, new = (projection.graph(spark, "/root/testdata/sf0.001", k) for k in (1, 2))
    names = spark.createDataFrame([(projection.EX + "type_", "n:kind-", 0), (projection.EX, "n:", 1)], "ns string, value string, place int")
    dealt, keep = {}, rules.written
    monkeypatch.setattr(rules, "written", lambda df, name="table": (dealt.__setitem__(name, plan(df).count("Exchange hashpartitioning")), keep(df, name))[1])
    rules.migrate([("old", old), ("new", new)], names)
    assert dealt["sources"] == 0


def test_large_mappings_are_merged_though_their_files_are_small(spark, tmp_path, monkeypatch):
    """Files of many equal texts are small; what they hold isn't."""
    monkeypatch.setattr(refactor, "FEW", 20)
    graph(spark, [(f"{X}a{k}/x", v.SUBCLASS, f"{X}a{k // 2}/x") for k in range(50)] + [("_:n", X + "a7/p", f'"{X}a1/')]).write.parquet(str(tmp_path / "g"))
    spark.createDataFrame([(f"{X}a{k}/", f"{X}b{k}/", k) for k in range(50)], "ns string, value string, place int").write.parquet(str(tmp_path / "n"))
    g, names = spark.read.parquet(str(tmp_path / "g")), spark.read.parquet(str(tmp_path / "n"))
    assert "SortMergeJoin" in plan(spaces.matched(g.select(F.col("s").alias("iri")), names)) and "BroadcastExchange" not in plan(spaces.matched(g.select(F.col("s").alias("iri")), names))
    df = spaces.rename(g, names)
    assert plan(df).count("SortMergeJoin") >= 2 and "_deal" in plan(df)
    want = {(f"{X}b{k}/x", v.SUBCLASS, f"{X}b{k // 2}/x") for k in range(50)} | {("n", X + "b7/p", f"{X}a1/")}
    assert {(r.s, r.p, r.o) for r in df.collect()} == want


def test_many_short_rings_take_few_rounds(spark, monkeypatch):
    """Rounds follow the longest ring, not the number of nodes on all of them; a ring's places need no search for a way."""
    rings = [[f"r{k:03d}_{(i * 5 + k) % 7}" for i in range(1 + k % 7)] for k in range(150)]
    edges = [e for ring in rings for e in zip(ring, ring[1:] + ring[:1])]
    # a component that is no ring, and what leads to and from rings
    edges += [("x1", "x2"), ("x2", "x3"), ("x3", "x1"), ("x2", "x1"), ("t1", "t2"), ("t2", rings[6][3]), (rings[5][0], "u")]
    tables, keep = [], closure.written
    monkeypatch.setattr(closure, "written", lambda df, name="table": (tables.append(name), keep(df, name))[1])
    got = {(r.component, r.position): r.uri for r in closure.cycle_paths(spark.createDataFrame(edges, "src string, dst string").coalesce(2)).collect()}
    want = {("x1", 0): "x1", ("x1", 1): "x2"}
    for ring in rings:
        at = ring.index(min(ring))
        want |= {(min(ring), k): x for k, x in enumerate(ring[at:] + ring[:at])}
    assert got == want
    assert tables.count("chains") < 25


def test_only_triples_of_referring_subjects_are_grouped(spark, monkeypatch):
    rows = [(f"{X}a{k}", X + "p", f'"{k}') for k in range(30)] + [(X + "a1", X + "q", "_:n"), ("_:n", X + "q", "_:m"), ("_:m", X + "p", '"1')]
    kept, keep = {}, nested.written
    monkeypatch.setattr(nested, "written", lambda df, name="table": kept.setdefault(name, keep(df, name)) if name in ("refer", "referring") else keep(df, name))
    got = nested.blocks(graph(spark, rows).coalesce(1), {"x": X}).where("nested > 0").collect()
    assert [(r.subject, r.nested) for r in got] == [("x:a1", 1)]
    assert {r.s for r in kept["refer"].collect()} == {X + "a1"} and kept["referring"].count() == 2
