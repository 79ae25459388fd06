"""Operators on small hand-made graphs."""

import subprocess
import sys
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ontospark.functions import terms
from ontospark.functions import vocab as v
from ontospark.operators import closure, diff, lint, merge, order, patterns, refactor, select, split, stats
from ontospark.sources import ntriples

ROOT = Path(__file__).resolve().parents[1]
EX = "http://e.org/o#"
TTL = [
    f"<{EX}Animal> <{v.TYPE}> <{v.OWL_CLASS}> .", f"<{EX}Dog> <{v.TYPE}> <{v.OWL_CLASS}> . # a comment", f"<{EX}Dog> <{v.SUBCLASS}> <{EX}Animal> .",
    f'<{EX}Dog> <{v.LABEL}> "D\\"og \\\\n \\n"@en .', f"<{EX}Dog> <{v.SUBCLASS}> _:r1 .", f'_:r1 <{EX}n> "1"^^<{v.XSD}integer> .', "# nothing", "", "this is no triple", f'<{EX}Dog> <{v.LABEL}> "Hund"@de <{EX}graph> .',
]


@pytest.fixture(scope="module")
def parsed(spark):
    return ntriples.parse(spark.createDataFrame([(x,) for x in TTL], "value string"))


def test_ntriples(spark, parsed, tmp_path):
    got = {(r.g, r.s, r.s_kind, r.p, r.o, r.o_kind, r.o_dt, r.o_lang) for r in parsed.where("error IS NULL").collect()}
    assert len(got) == 7
    assert ("", EX + "Dog", "iri", v.LABEL, 'D"og \\n \n', "literal", "", "en") in got
    assert (EX + "graph", EX + "Dog", "iri", v.LABEL, "Hund", "literal", "", "de") in got
    assert ("", "r1", "bnode", EX + "n", "1", "literal", v.XSD + "integer", "") in got
    assert [r.error for r in parsed.where("error IS NOT NULL").collect()] == ["this is no triple"]
    g = ntriples.graph(parsed)
    ntriples.write(g, str(tmp_path / "out"))
    back = ntriples.graph(ntriples.read(spark, str(tmp_path / "out")))
    assert back.exceptAll(g).isEmpty() and g.exceptAll(back).isEmpty()
    assert ntriples.format_of("x/y.nq") == "nquads"
    with pytest.raises(ValueError):
        ntriples.format_of("a.doc")


def graph_of(spark, triples):
    return spark.createDataFrame([(s, "iri", p, o, "literal" if p in (v.LABEL, v.COMMENT) else "iri", "", "") for s, p, o in triples], "s string, s_kind string, p string, o string, o_kind string, o_dt string, o_lang string")


def test_stats_of_a_small_hierarchy(spark):
    t = [(c, v.TYPE, v.OWL_CLASS) for c in "ABCDE"] + [("B", v.SUBCLASS, "A"), ("C", v.SUBCLASS, "A"), ("D", v.SUBCLASS, "B"), ("D", v.SUBCLASS, "C")]
    got = {r.metric: (r.num, r.den) for r in stats.collect(graph_of(spark, t), ["hierarchy", "complexity"]).collect()}
    assert got["root_classes"] == (2, 1) and got["leaf_classes"] == (2, 1) and got["max_depth"] == (2, 1) and got["orphan_classes"] == (1, 1)
    assert got["avg_branching"] == (4, 3) and got["avg_depth"] == (4, 5) and got["multiple_inheritance_count"] == (1, 1)
    with pytest.raises(ValueError):
        stats.collect(graph_of(spark, t), ["nonsense"])


def brute_reach(pairs):
    seen = set(pairs)
    while new := {(a, d) for a, b in seen for c, d in pairs if b == c} - seen:
        seen |= new
    return seen


@settings(max_examples=6, deadline=None)
@given(st.sets(st.tuples(st.integers(0, 6), st.integers(0, 6)), min_size=1, max_size=10))
def test_closure_on_any_graph(spark, pairs):
    e = spark.createDataFrame([(str(a), str(b)) for a, b in pairs], "src string, dst string")
    want = {(str(a), str(b)) for a, b in brute_reach(pairs)}
    assert {(r.src, r.dst) for r in closure.reach(e).collect()} == want
    assert {r.uri for r in closure.cycle_members(e).collect()} == {a for a, b in want if a == b}


def bfs(pairs, start):
    depth, front, k = {x: 0 for x in start}, set(start), 0
    while front:
        k += 1
        front = {b for a, b in pairs if a in front} - set(depth)
        depth |= dict.fromkeys(front, k)
    return depth


def longest(pairs, nodes):
    """Longest paths up, edges whose ends reach each other left out."""
    all_ = brute_reach(pairs)
    open_ = {(a, b) for a, b in pairs if (b, a) not in all_ and a != b}
    depth = lambda x: max((1 + depth(b) for a, b in open_ if a == x), default=0)
    return {x: depth(x) for x in nodes}


@settings(max_examples=3, deadline=None)
@given(st.sets(st.tuples(st.integers(0, 9), st.integers(0, 9)), min_size=1, max_size=14), st.booleans())
def test_bound_walks_on_any_graph(spark, pairs, chain):
    pairs = pairs | ({(i, i + 1) for i in range(10, 30)} | {(9, 10)} if chain else set())  # deep enough for chains
    e = spark.createDataFrame([(str(a), str(b)) for a, b in pairs], "src string, dst string")
    named = {(str(a), str(b)) for a, b in pairs}
    nodes = {x for p in named for x in p}
    some = spark.createDataFrame([("0",), ("9",), ("29",)], "uri string")
    assert {r.uri: r.depth for r in closure.walk(e, some).collect()} == bfs(named, ["0", "9", "29"])
    all_ = {(str(a), str(b)) for a, b in brute_reach(pairs)}
    assert {(r.src, r.dst) for r in closure.reach(e, to=some).collect()} == {x for x in all_ if x[1] in ("0", "9", "29")}
    assert {(r.src, r.dst, r.dist) for r in closure.reach(e, most=3).collect()} == {(a, b, d) for a in nodes for b, d in _steps(named, a).items() if d <= 3}
    marks = {r.uri: (r.dist, r.mark) for r in closure.nearest(e, some).collect()}
    back = {m: bfs({(b, a) for a, b in named}, [m]) for m in ("0", "9", "29")}
    assert marks == {x: min((d[x], m) for m, d in back.items() if x in d) for x in nodes | {"0", "9", "29"} if any(x in d for d in back.values())}
    every = spark.createDataFrame([(x,) for x in nodes], "uri string")
    assert {r.uri: r.depth for r in closure.longest_depth(e, every).collect()} == longest(named, nodes)
    assert {r.uri for r in closure.cycle_members(e).collect()} == {a for a, b in all_ if a == b}


def strong(pairs):
    """Each node of a cycle with the smallest node that it reaches and that reaches it."""
    all_ = brute_reach(pairs)
    on = {a for a, b in all_ if a == b}
    return {a: min(b for b in on if b == a or ((a, b) in all_ and (b, a) in all_)) for a in on}


@settings(max_examples=4, deadline=None)
@given(st.sets(st.tuples(st.integers(0, 8), st.integers(0, 8)), min_size=1, max_size=14), st.booleans())
def test_components_of_any_graph(spark, pairs, ring):
    pairs = {(str(a), str(b)) for a, b in pairs} | ({(str(i), str(10 + (i + 1) % 20)) for i in range(10, 30)} if ring else set()) | ({("3", "15"), ("20", "3")} if ring and (1, 2) in pairs else set())
    e = spark.createDataFrame(list(pairs), "src string, dst string")
    want = strong(pairs)
    assert {r.uri: r.component for r in closure.components(e).collect()} == want
    kept = {(want.get(a, a), want.get(b, b)) for a, b in pairs}
    assert {(r.src, r.dst) for r in closure.condensed(e).collect()} == {(a, b) for a, b in kept if a != b}
    paths = {}
    for r in closure.cycle_paths(e).collect():
        paths.setdefault(r.component, {})[r.position] = r.uri
    assert set(paths) == set(want.values())
    for name, at in paths.items():
        steps = [at[i] for i in range(len(at))]
        assert steps[0] == name and all(x in pairs for x in zip(steps, steps[1:] + steps[:1], strict=True))
        assert len(steps) == _steps(pairs, name)[name]


def test_traversal_is_bounded_by_edges(spark, monkeypatch):
    """Layers with many ways between them: no table of a walk has more rows than twice the edges; a long chain ends in few rounds."""
    import random

    rng, rows = random.Random(2), []
    plain = closure.written

    def counted(df, *name):
        out = plain(df, *name)
        rows.append(out.count())
        return out

    monkeypatch.setattr(closure, "written", counted)
    layers = sorted({(f"{k}.{i}", f"{k - 1}.{rng.randrange(30)}") for k in range(1, 9) for i in range(30) for _ in range(5)})
    e = spark.createDataFrame(layers, "src string, dst string").cache()
    root = spark.createDataFrame([("0.0",)], "uri string")
    assert {r.uri: r.depth for r in closure.descendants(e, root).collect()} == bfs({(b, a) for a, b in layers}, ["0.0"])
    every = spark.createDataFrame(sorted({(x,) for p in layers for x in p}), "uri string")
    assert {r.uri: r.depth for r in closure.longest_depth(e, every).collect()} == {x: int(x.split(".")[0]) for p in layers for x in p}
    assert closure.nearest(e, root).count() == closure.descendants(e, root).count() and closure.components(e).isEmpty()
    assert max(rows) <= 2 * len(layers)
    rows.clear()
    chain = spark.range(600).select(F.format_string("n%04d", "id").alias("dst"), F.format_string("n%04d", F.col("id") + 1).alias("src"))
    assert closure.descendants(chain, spark.createDataFrame([("n0000",)], "uri string")).agg(F.max("depth")).first()[0] == 600
    ring = chain.unionByName(spark.createDataFrame([("n0000", "n0600")], "src string, dst string"))
    assert closure.components(ring).groupBy("component").count().collect() == [("n0000", 601)]
    assert max(rows) <= 1300 and len(rows) < 60


def _steps(pairs, a):
    """Fewest edges, one at least, from a to each node."""
    first = {b for x, b in pairs if x == a}
    out = {b: d + 1 for b, d in bfs(pairs, first).items()} if first else {}
    return out


def test_lists_of_any_length_and_in_circles(spark):
    cells = [(f"c{i}", "bnode", v.FIRST, f"x{i}", "literal", "", "") for i in range(40)] + [(f"c{i}", "bnode", v.REST, f"c{i + 1}", "bnode", "", "") for i in range(39)] + [("c39", "bnode", v.REST, v.NIL, "iri", "", "")]
    ring = [(f"r{i}", "bnode", v.FIRST, f"y{i}", "literal", "", "") for i in range(5)] + [(f"r{i}", "bnode", v.REST, f"r{(i + 1) % 5}", "bnode", "", "") for i in range(5)]
    g = spark.createDataFrame(cells + ring, "s string, s_kind string, p string, o string, o_kind string, o_dt string, o_lang string")
    heads = spark.createDataFrame([("c0",), ("c30",), ("r2",), ("gone",)], "head string")
    got = {(r.head, r.position, r.o) for r in closure.list_items(g, heads).collect()}
    assert got == {("c0", i, f"x{i}") for i in range(40)} | {("c30", i, f"x{30 + i}") for i in range(10)} | {("r2", i, f"y{(2 + i) % 5}") for i in range(5)}


def test_places_are_gapless_in_groups_over_many_tasks(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), F.sha2(F.col("id").cast("string"), 256).alias("k")).repartition(7)
    got = order.placed(df, "g", F.col("k")).collect()
    for g in range(3):
        mine = sorted((r.k, r.place) for r in got if r.g == g)
        assert [p for _, p in mine] == list(range(1, len(mine) + 1))


def test_graph_is_stored_once_and_again_when_files_change(spark, tmp_path):
    import shutil

    from ontospark.sources import projection

    for t in projection.TABLES:
        shutil.copyfile(f"/root/testdata/sf0.001/{t}.parquet", tmp_path / f"{t}.parquet")
    first = projection.graph(spark, str(tmp_path))
    assert first.inputFiles() == projection.graph(spark, str(tmp_path)).inputFiles()
    n = first.count()
    assert len(first.where(F.col("p") == v.SUBCLASS).inputFiles()) > 0
    spark.read.parquet(f"{tmp_path}/region.parquet").limit(2).toPandas().to_parquet(tmp_path / "region.parquet")
    assert projection.graph(spark, str(tmp_path)).count() == n - 3 * 4  # three regions less, four triples each


def test_long_literals_in_lines(spark):
    text = ('a "quote", a \\ and a line\n' * 20000)
    g = graph_of(spark, [("http://x/a", v.LABEL, text)])
    back = ntriples.parse(ntriples.lines(g)).first()
    assert back.error is None and back.o == text


def test_lint_registry_takes_new_rules(spark):
    @lint.rule("no-x", "error")
    def no_x(g):
        return select.match(g, s="X").select(F.col("s").alias("entity"), F.lit("").alias("detail")).distinct()

    try:
        g = graph_of(spark, [("X", v.TYPE, v.OWL_CLASS)])
        issues = lint.run(g, ["no-x", "missing-label"], {"no-x": "info"})
        assert {(r.rule_id, r.severity) for r in issues.collect()} == {("no-x", "info"), ("missing-label", "warning")}
        assert lint.exit_code(issues).first().exit_code == 1
        assert "no-x" not in lint.effective(disable=["no-x"]) and lint.effective(level="error")[0] == "orphan-class"
    finally:
        lint.RULES.pop("no-x")


def test_diff_and_rename_round_trip(spark):
    old = graph_of(spark, [("http://a/x", v.LABEL, "1"), ("http://a/x", "http://a/p", "http://a/y")])
    new = refactor.rename_namespaces(old, [("http://a/", "http://b/")])
    assert {(r.s, r.p) for r in new.collect()} == {("http://b/x", v.LABEL), ("http://b/x", "http://b/p")}
    assert diff.triples(old, refactor.rename_namespaces(new, [("http://b/", "http://a/")])).isEmpty()
    kinds = {r.uri: r.change_type for r in diff.entities(old, new).collect()}
    assert kinds == {"http://a/x": "removed", "http://b/x": "added"}


def test_merge_conflicts_and_precedence(spark):
    a, b = graph_of(spark, [("x", v.LABEL, "one")]), graph_of(spark, [("x", v.LABEL, "two"), ("y", v.LABEL, "z")])
    all_ = merge.tagged([(a, "a", 9), (b, "b", 1)])
    found = merge.conflicts(all_)
    assert [(r.s, r.value, r.value_last, r.n_values) for r in found.collect()] == [("x", "one", "two", 2)]
    assert {(r.s, r.o) for r in merge.resolved(all_, found).collect()} == {("x", "one"), ("y", "z")}
    assert {(r.s, r.o) for r in merge.authoritative(b, a, [v.LABEL]).collect()} == {("x", "two"), ("y", "z")}


def test_split_then_union_is_the_whole(spark):
    t = [(c, v.TYPE, v.OWL_CLASS) for c in ("m/A", "m/B", "n/C")] + [("m/B", v.SUBCLASS, "m/A"), ("n/C", v.SUBCLASS, "m/B")]
    g = graph_of(spark, t)
    assigned = split.assign(g, [split.Module("m", classes=["m/A"]), split.Module("rest", namespaces=["n/"])])
    assert {(r.uri, r.module) for r in assigned.collect()} == {("m/A", "m"), ("m/B", "common"), ("n/C", "rest")}
    assert {(r.s, r.p, r.o) for r in split.module_triples(g, assigned).collect()} == set(t)


def test_terms_and_order(spark):
    one = spark.range(1).select(F.lit("http://e/a#b#c").alias("x"), F.lit("http://e/d/f").alias("y"))
    r = one.select(terms.local_name(F.col("x")).alias("a"), terms.namespace(F.col("x")).alias("b"), terms.local_name(F.col("y")).alias("c"), terms.namespace(F.col("y")).alias("d")).first()
    assert tuple(r) == ("c", "http://e/a#b#", "f", "http://e/d/")
    g = graph_of(spark, [("http://e/B", v.SUBCLASS, "http://e/A"), ("http://e/A", v.TYPE, v.OWL_CLASS), ("http://e/B", v.TYPE, v.OWL_CLASS), ("http://e/B", v.COMMENT, "c")])
    prefixes = {"e": "http://e/", "rdfs": v.RDFS, "owl": v.OWL}
    assert [(r.uri, r.level) for r in order.topological(g, select.classes(g), prefixes).orderBy("level", "place").collect()] == [("http://e/A", 0), ("http://e/B", 1)]
    blocks = {r.subject: r.block for r in order.blocks(g, prefixes).collect()}
    assert blocks["e:B"] == 'e:B a owl:Class ;\n    rdfs:subClassOf e:A ;\n    rdfs:comment "c" .'
    with pytest.raises(ValueError):
        patterns.bgp(g, ("?a", v.TYPE, "?b"), ("?c", v.LABEL, "?d"))


def test_stream_of_ntriples(spark, tmp_path):
    from ontospark.streaming import ingest

    for k in range(2):
        (tmp_path / f"{k}.nt").write_text("\n".join(x for x in TTL if x.endswith(".")) + f"\n<{EX}s{k}> <{EX}p> <{EX}o> .\n")
    q = ingest.counts(ingest.triples(spark, str(tmp_path))).writeStream.outputMode("complete").format("memory").queryName("triples_by_p").start()
    try:
        q.processAllAvailable()
        got = {r.p: r.n for r in spark.sql("SELECT * FROM triples_by_p").collect()}
    finally:
        q.stop()
    assert got[EX + "p"] == 2 and got[v.TYPE] == 1


def test_entry_without_the_training_subpackage(tmp_path):
    """The entry imports and registers the engine's queries where the subpackage and the pipeline are gone."""
    import shutil

    shutil.copytree(ROOT / "ontospark", tmp_path / "ontospark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copyfile(ROOT / "__spark_entry__.py", tmp_path / "__spark_entry__.py")
    code = "import __spark_entry__ as e; q = e.queries(); assert 'stats_basic' in q and not any(x.startswith('op1_') for x in q) and set(q) == set(e.oracle_sql())"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin", "PYTHONPATH": str(tmp_path)}, timeout=120)


def test_model_names(spark):
    from ontospark.operators import model

    one = lambda f, *xs: [r.x for r in spark.createDataFrame([(x,) for x in xs], "a string").select(f(F.col("a")).alias("x")).collect()]
    assert one(model.camel_to_label, "wingSpan", "usesXMLFile", "ABTest", "plain", "") == ["wing span", "uses xml file", "ab test", "plain", ""]
    assert one(model.label_to_property, "flownBy", "flown by", " lands  at GATE ", "flown-By!", None) == ["flownBy", "flownBy", "landsAtGate", "flownBy", None]
    assert [x.rsplit("#", 1)[1] for x in one(model.datatype, "Int", " text", "xsd:gDay", "money", "gYear")] == ["integer", "string", "gDay", "string", "gYear"]


def test_model_of_empty_and_ambiguous_classes(spark):
    from ontospark.operators import model, validate

    attributes = spark.createDataFrame([], "package string, class string, name string, datatype string")
    classes = spark.createDataFrame([("b", "A", None, None), ("a", "A", "An A", "n"), (None, "B", None, None)], "package string, name string, display string, note string")
    relations = spark.createDataFrame([("A", "B", "inheritance", None), ("b.A", "B", "association", "is part of"), ("A", "C", "association", None)], "source string, target string, kind string, label string")
    made = {(r.s, r.p, r.o) for r in model.to_graph(classes, attributes, relations, "http://x/m#", "M").collect()}
    sub, dom = "http://www.w3.org/2000/01/rdf-schema#subClassOf", "http://www.w3.org/2000/01/rdf-schema#domain"
    assert ("http://x/m/a#A", sub, "http://x/m#B") in made and ("http://x/m/b#isPartOf", dom, "http://x/m/b#A") in made
    assert len([x for x in made if x[1] == dom]) == 1
    found = {(r.code, r.entity, r.n) for r in validate.model_issues(classes, attributes, relations).collect()}
    assert found == {("DUPLICATE_CLASS", "A", 1), ("UNKNOWN_CLASS", "C", 1)}
    nothing = model.to_graph(classes.limit(0), attributes, relations.limit(0), "http://x/m#", "M")
    assert nothing.count() == 2 and validate.model_issues(classes.limit(0), attributes, relations.limit(0)).isEmpty()


def test_quads_and_imports(spark):
    from ontospark.operators import merge
    from ontospark.sources import ntriples

    g = spark.createDataFrame([("http://x/s", "iri", "http://x/p", 'say "a" .', "literal", "", "en"), ("b0", "bnode", "http://x/p", "http://x/o", "iri", "", "")], "s string, s_kind string, p string, o string, o_kind string, o_dt string, o_lang string")
    back = ntriples.parse(ntriples.quad_lines(g, F.when(F.col("s_kind") == "iri", "http://x/g")))
    assert sorted((r.g, r.s, r.o, r.error) for r in back.collect()) == [("", "b0", "http://x/o", None), ("http://x/g", "http://x/s", 'say "a" .', None)]
    kept = merge.with_imports(g, "merge", ["http://x/other"], "http://x/")
    assert kept.count() == 3 and merge.with_imports(kept, "remove").count() == 2 and merge.with_imports(kept, "update").count() == 3


def test_style_nearest_above(spark):
    from ontospark.functions import vocab as v
    from ontospark.operators import docs

    rows = [(c, "iri", v.TYPE, v.OWL_CLASS, "iri", "", "") for c in "abcd"] + [(a, "iri", v.SUBCLASS, b, "iri", "", "") for a, b in ("ba", "cb", "bc")]
    g = spark.createDataFrame(rows, "s string, s_kind string, p string, o string, o_kind string, o_dt string, o_lang string")
    given = spark.createDataFrame([("a", "red"), ("b", "blue")], "uri string, style string")
    assert {r.uri: (r.style, r.how) for r in docs.styles(g, given, [("d", "green")], "white").collect()} == {"a": ("red", "own"), "b": ("blue", "own"), "c": ("blue", "inherited"), "d": ("green", "namespace")}
