"""Rules, mentions, namespaces, nested nodes, lines, storage and pattern order."""

import json
import random

import pytest
from pyspark.sql import functions as F

from ontospark.functions import vocab as v
from ontospark.operators import describe, diff, docs, lint, localise, mentions, merge, nested, order, patterns, rules, shacl, spaces, split
from ontospark.sources import lines, projection

DATA = "/root/testdata/sf0.001"
EX = "http://e.org/o#"
COLUMNS = "s string, s_kind string, p string, o string, o_kind string, o_dt string, o_lang string"


def graph_of(spark, triples):
    """``_:x`` is a blank node, ``"x`` a literal, anything else the name of an IRI, or an IRI."""
    def term(x):
        return (x[2:], "bnode") if x.startswith("_:") else (x[1:], "literal") if x.startswith('"') else (x if ":" in x else EX + x, "iri")

    return spark.createDataFrame([(*term(s), term(p)[0], *term(o), "", "") for s, p, o in triples], COLUMNS)


def test_mentions_equal_contains(spark):
    rng = random.Random(5)
    names = ["", None, "aa", "aab", "b", "é", "漢字", "never said"] + ["".join(rng.choice("ab") for _ in range(rng.randrange(1, 7))) for _ in range(200)]
    texts = ["", "aab", "é漢字é"] + ["".join(rng.choice("ab c") for _ in range(30)) for _ in range(60)] + ["aab"]
    g = graph_of(spark, [(f"s{i}", "p", '"' + t) for i, t in enumerate(texts)] + [("x", "p", "aab")]).repartition(3)
    wanted = {n: sum(n in t for t in texts) for n in set(names) if n}
    n = spark.createDataFrame([(x, 1) for x in names], "name string, n int")
    for most in (1 << 24, 50):
        assert {r.name: r.n for r in mentions.mentions(g, n, most).collect()} == {k: c for k, c in wanted.items() if c}
    assert mentions.mentions(g, n.where("false")).count() == 0 and mentions.mentions(g.where("false"), n).count() == 0


def test_a_hundred_thousand_names_in_one_pass(spark):
    names = spark.range(100_000).select(F.format_string("name%06d", "id").alias("name"))
    g = graph_of(spark, [("a", "p", '"name000001 and name099999'), ("b", "p", '"name0000012')])
    assert {r.name: r.n for r in mentions.mentions(g, names).collect()} == {"name000001": 2, "name099999": 1}


def test_namespaces_first_and_longest(spark):
    rng = random.Random(1)
    names = ["".join(rng.choice("ab/") for _ in range(rng.randrange(1, 9))) for _ in range(300)]
    iris = sorted({"".join(rng.choice("ab/") for _ in range(rng.randrange(1, 14))) for _ in range(200)} | {"zzz"})
    table = spark.createDataFrame([(n, f"v{i}", i) for i, n in enumerate(names)] + [("", "x", -1), (None, "x", -1)], "ns string, value string, place bigint")
    df = spark.createDataFrame([(x,) for x in iris], "iri string")
    place = {n: i for i, n in reversed(list(enumerate(names)))}
    for longest in (True, False):
        got = {r.iri: (r.ns, r.value) for r in spaces.matched(df, table, longest).collect()}
        want = {}
        for x in iris:
            if fits := [n for n in place if x.startswith(n)]:
                best = max(fits, key=len) if longest else min(fits, key=place.get)
                want[x] = (best, f"v{place[best]}")
        assert got == want
    assert {r.qname for r in spaces.qnames(df.where("iri = 'zzz'"), table).collect()} == {"<zzz>"}
    many = spark.range(10_000).select(F.concat(F.lit(EX), F.col("id").cast("string"), F.lit("/")).alias("ns"), F.concat(F.lit("n:"), "id").alias("value"), F.col("id").alias("place"))
    g = graph_of(spark, [(f"{EX}{i}/a", "p", f"{EX}{i + 1}/b") for i in (0, 17, 9998)] + [("_:n", "p", f'"{EX}1/x')])
    assert {(r.s, r.o) for r in spaces.rename(g, many).select("s", "o").collect()} == {(f"n:{i}a", f"n:{i + 1}b") for i in (0, 17, 9998)} | {("n", f"{EX}1/x")}
    assert spaces.matched(df, table.where("false")).count() == 0


def test_rules_in_order(spark):
    g = graph_of(spark, [("a", "knows", "b"), ("b", "knows", "c"), ("a", "name", '"Ann'), ("b", "name", '"Bob'), ("c", "knows", "c"), ("_:n", "knows", "a")])
    two = rules.Rule("steps", [("?x", EX + "knows", "?y"), ("?y", EX + "knows", "?z")], [("?x", EX + "far", "?z")], gone=[])
    named = rules.Rule("named", [("?x", EX + "far", "?z"), ("?x", EX + "name", "?n")], [("?z", EX + "of", rules.Made(lambda t: F.concat(t["n"], F.lit("'s")), lang="en")), ("?n", EX + "of", "?x")], gone=[0])
    loop = rules.Rule("loops", [("?x", EX + "knows", "?x")], [("?x", EX + "self", '"yes'), ("?x", EX + "none", rules.Made(lambda t: F.lit(None).cast("string")))])
    only = rules.Rule("only", [("?x", EX + "name", "?n")], [], only=lambda t: t["n"] == "Bob")
    done, counts = rules.apply(g, [two, named, loop, only])
    got = {(r.s.replace(EX, ""), r.p.replace(EX, ""), r.o.replace(EX, ""), r.o_kind, r.o_lang) for r in done.collect()}
    assert got == {
        ("a", "knows", "b", "iri", ""), ("b", "knows", "c", "iri", ""), ("n", "knows", "a", "iri", ""), ("a", "name", "Ann", "literal", ""), ("c", "of", "Ann's", "literal", "en"), ("c", "of", "Bob's", "literal", "en"),
        ("c", "far", "c", "iri", ""), ("n", "far", "b", "iri", ""), ("c", "self", "yes", "literal", ""),
    }
    assert [(r.rule, r.matched, r.removed, r.made) for r in counts.orderBy("place").collect()] == [("steps", 4, 0, 4), ("named", 2, 2, 2), ("loops", 1, 1, 1), ("only", 1, 1, 0)]
    with pytest.raises(ValueError):
        rules.apply(g, [rules.Rule("bad", [("?x", EX + "knows", "?y")], [("?x", EX + "p", "?w")])])
    empty, none = rules.apply(g.where("false"), [two])
    assert empty.count() == 0 and none.first().matched == 0
    typed = g.unionByName(g.where("o = 'Bob'").withColumn("o_dt", F.lit(v.XSD + "string"))).unionByName(g.where("o = 'Bob'").withColumn("o_lang", F.lit("en")))
    kept, counts = rules.apply(typed, [rules.Rule("any literal", [("?x", EX + "name", '"Bob')], [("?x", EX + "name", '"Bob')])])
    assert [tuple(r)[2:] for r in counts.collect()] == [(3, 3, 1)]
    assert [(r.o_dt, r.o_lang) for r in kept.where("o = 'Bob'").collect()] == [("", "")]
    again = rules.Rule("again", [("?x", EX + "far", "?z")], [("?x", EX + "knows", "?z")])
    last, _ = rules.apply(g, [rules.Rule("knows", [("?x", EX + "knows", "?z")], [("?x", EX + "far", "?z")]), again])
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, g.collect()))
    moved, _ = rules.migrate([("one", g), ("two", g.limit(0))], spark.createDataFrame([(EX, "n:", 0)], "ns string, value string, place int"), spark.createDataFrame([("n:a", "n:A")], "old string, new string"))
    assert {(r.s, r.p, r.source) for r in moved.where("o = 'n:b'").collect()} == {("n:A", "n:knows", "one")}


def test_nested_nodes(spark):
    g = graph_of(spark, [
        ("x", "has", "_:a"), ("_:a", "to", "_:b"), ("_:b", "v", '"one\ntwo'), ("_:a", v.TYPE, "T"), ("x", "has", "_:shared"), ("y", "has", "_:shared"), ("_:shared", "v", '"s'),
        ("_:r1", "to", "_:r2"), ("_:r2", "to", "_:r1"), ("_:r2", "to", "_:leaf"), ("y", "has", "_:bare"), ("z", "has", "_:st"), ("_:st", v.TYPE, v.RDF + "Statement"),
    ])
    got = {r.subject: (r.nested, r.block) for r in nested.blocks(g.unionByName(g.limit(2)), {"e": EX, "rdf": v.RDF}).collect()}
    assert set(got) == {"e:x", "e:y", "e:z", "_:shared", "_:r1", "_:r2", "_:st"}
    assert got["e:x"] == (1, 'e:x e:has [\n        a e:T ;\n        e:to [\n            e:v "one\\ntwo"\n        ]\n    ], _:shared .')
    assert got["e:y"] == (1, "e:y e:has [\n    ], _:shared .")
    assert got["_:r2"] == (1, "_:r2 e:to [\n    ], _:r1 .") and got["e:z"][1] == "e:z e:has _:st ."
    assert nested.blocks(g.where("false"), {"e": EX}).count() == 0


def test_nested_in_depth_and_in_circles(spark):
    """A list of 40 cells takes few rounds; a ring keeps labels, what hangs from it is nested."""
    cells = [x for i in range(40) for x in ((f"_:c{i}", v.FIRST, f'"{i}'), (f"_:c{i}", v.REST, f"_:c{i + 1}" if i < 39 else v.NIL))]
    ring = [("_:r1", "p", "_:r2"), ("_:r2", "p", "_:r3"), ("_:r3", "p", "_:r1"), ("_:r2", "q", "_:leaf"), ("_:leaf", "p", '"deep')]
    g = graph_of(spark, [("s", "list", "_:c0"), *cells, *ring, ("t", "p", "_:gone")])
    got = {r.subject: (r.nested, r.block) for r in nested.blocks(g, {"e": EX, "rdf": v.RDF}).collect()}
    assert set(got) == {"e:s", "e:t", "_:r1", "_:r2", "_:r3"}
    text = "rdf:nil"
    for i in reversed(range(40)):
        body = "".join(f'rdf:{p} {o}' + (" ;\n    " if p == "first" else "") for p, o in (("first", f'"{i}"'), ("rest", text)))
        text = "[\n    " + body + "\n]"
        text = text.replace("\n", "\n    ")
    assert got["e:s"] == (1, f"e:s e:list {text} .")
    assert got["e:t"] == (1, "e:t e:p [\n    ] .")
    assert got["_:r1"] == (0, "_:r1 e:p _:r2 .")
    assert got["_:r2"] == (1, '_:r2 e:p _:r3 ;\n    e:q [\n        e:p "deep"\n    ] .')


def test_line_numbers_in_many_splits(spark, tmp_path):
    rng = random.Random(0)
    files = {"a.ttl": [f"ex:s{rng.randrange(40)} ex:p <{EX}o{rng.randrange(60)}> ." for _ in range(500)] + [f"  <{EX}s3> a ex:T .", "", "ex:last"], "b.ttl": ["# only a comment on ex:s1"]}
    for name, rows in files.items():
        (tmp_path / name).write_text("\n".join(rows) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        found = lines.numbered(spark, str(tmp_path))
        assert {(r.file.split("/")[-1], r.line): r.value for r in found.collect()} == {(f, i + 1): x for f, rows in files.items() for i, x in enumerate(rows)}
        wanted = [f"{EX}s{i}" for i in range(41)] + [f"{EX}o{i}" for i in range(61)]
        got = {(r.uri, r.file.split("/")[-1]): r.line for r in lines.first_mentions(found, spark.createDataFrame([(x,) for x in wanted], "uri string")).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    want = {}
    for f, rows in files.items():
        for uri in wanted:
            name = uri.split("#")[1]
            tests = [lambda x, u=uri: x.strip().startswith(f"<{u}> "), lambda x, n=name: x.startswith(f"ex:{n} "), lambda x, u=uri: f"<{u}>" in x, lambda x, n=name: f"ex:{n}" in x.replace(".", " ").split()]
            for t in tests:
                if at := [i + 1 for i, x in enumerate(rows) if t(x)]:
                    want[uri, f] = at[0]
                    break
    assert got == want


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_graph_lies_in_buckets_by_subject(spark):
    g, h = projection.graph(spark, DATA), projection.graph(spark, DATA, 2)
    assert exchanges(g.groupBy("s").count()) == 0 and exchanges(order.lines(g, projection.PREFIXES)) == 0
    assert exchanges(g.where(F.col("p") == v.LABEL).select("s").join(h.where(F.col("p") == v.SUBCLASS).select("s", "o").hint("merge"), "s")) == 0
    assert exchanges(diff.entities(g, h)) <= 1


def test_patterns_have_one_order(spark):
    from itertools import permutations

    counts = projection.counts(spark, DATA)
    assert counts[v.SUBCLASS][0] == projection.graph(spark, DATA).where(F.col("p") == v.SUBCLASS).count()
    g = projection.graph(spark, DATA)
    ask = [("?order", v.TYPE, "?customer"), ("?customer", v.SUBCLASS, "?nation"), ("?nation", v.SUBCLASS, projection.EX + "Region_2")]
    dfs = [patterns.bgp(g, *p, counts=counts) for p in permutations(ask)]
    assert all(d.sameSemantics(dfs[0]) for d in dfs) and patterns.planned(ask, counts)[0][0] == ask[2]
    assert sorted(dfs[0].collect()) == sorted(patterns.bgp(g, *ask).select("customer", "nation", "order").collect())
    with pytest.raises(ValueError):
        patterns.bgp(g, ("?a", v.TYPE, "?b"), ("?c", v.TYPE, "?d"), counts=counts)


def test_small_helpers(spark, tmp_path):
    tests = [{"name": "a", "tags": ["x", "y"]}, {"name": "b", "tags": ["y"]}, {"name": "c"}]
    names = lambda *a, **k: [t["name"] for t in patterns.by_tags(tests, *a, **k)]
    assert names() == ["a", "b", "c"] and names(["x"]) == ["a"] and names(["y"], ["x"]) == ["b"] and names(exclude=["y"]) == ["c"]
    needed = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "a")], "module string, needs string")
    assert split.tree(needed, ["a", "b", "c", "d"]) == ["c.ttl", "d.ttl"]  # nothing needs these two
    circle = spark.createDataFrame([("b", "a"), ("a", "b")], "module string, needs string")
    assert split.tree(circle, ["a", "b"]) == ["a.ttl", "  b.ttl", "    a.ttl"]
    split.write(spark.createDataFrame([("m1", "s"), ("m2", "t")], "module string, s string"), str(tmp_path / "modules"))
    assert sorted(x.name for x in (tmp_path / "modules").iterdir() if x.is_dir()) == ["module=m1", "module=m2"]
    record = docs.as_json(spark.createDataFrame([("u", 1)], "uri string, n int")).first().json
    assert json.loads(record) == {"uri": "u", "n": 1}


def test_translations_of_several_languages(spark):
    g = spark.createDataFrame([(EX + "a", "iri", v.LABEL, "House", "literal", "", "en")], COLUMNS)
    table = lambda text: spark.createDataFrame([(EX + "a", v.LABEL, text, "approved")], "uri string, property string, translation string, status string")
    got = {(r.o, r.o_lang) for r in localise.merge_all(g, [(table("Haus"), "de"), (table("Maison"), "fr")]).collect()}
    assert got == {("House", "en"), ("Haus", "de"), ("Maison", "fr")}


def test_only_full_ontologies_have_classes_of_classes(spark):
    base = [("A", v.TYPE, v.OWL_CLASS), ("B", v.TYPE, v.OWL_CLASS), ("C", v.TYPE, v.OWL_CLASS)]
    g = graph_of(spark, base + [("A", v.TYPE, "B"), ("C", v.EQUIVALENT_CLASS, "_:n"), ("_:n", v.COMPLEMENT, "C")])
    assert {(r.uri, r.issue) for r in describe.full_issues(g).collect()} == {(EX + "A", "metaclass"), (EX + "C", "contradiction")}
    assert describe.profile(g).first().profile == "owl_full" and describe.full_issues(graph_of(spark, base)).count() == 0


def test_registered_rules_and_converters(spark):
    g = graph_of(spark, [("A", v.TYPE, v.OWL_CLASS)])
    lint.rule("mine", "info")(lambda g: g.select(F.col("s").alias("entity"), F.lit("seen").alias("detail")))
    lint.rule("broken", "info")(lambda g: g.select("no_such_column"))
    lint.rule("failing", "info")(lambda g: 1 / 0)
    try:
        got = {(r.rule_id, r.severity, r.entity) for r in lint.run(g, ["mine", "broken"]).collect()}
        assert got == {("mine", "info", EX + "A"), ("rule-error", "error", "broken")}
        assert "no_such_column" in lint.run(g, ["broken"]).first().detail
        with pytest.raises(ZeroDivisionError):
            lint.run(g, ["failing"])
    finally:
        for n in ("mine", "broken", "failing"):
            del lint.RULES[n]

    @shacl.converter
    def named(g):
        return g.where(F.col("p") == v.TYPE).select(F.col("s").alias("class"), F.lit(EX + "path").alias("path"), F.lit("a name").alias("name"))

    try:
        assert [(r["class"], r.path, r.name) for r in shacl._parts(g, ["named"]).collect()] == [(EX + "A", EX + "path", "a name")]
    finally:
        del shacl.CONVERTERS["named"]


def test_tables_are_dealt_to_the_graph_once_and_versions_share_their_triples(spark):
    """Rows and not triples move, nothing is sorted by folder, and a merge of both versions groups where the triples lie."""
    plan = projection._graph(spark, DATA, 8)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression [concat(http://example.org/tpch#order_") == 1  # three triples an order, one row dealt
    name = projection._table(spark, DATA)
    alone = spark.table(name).where("v > 0").select("p", "s").distinct()
    assert alone.join(projection.graph(spark, DATA).where(F.col("p") == projection.EX + "contains"), ["s", "p"]).isEmpty()
    sources = [(projection.graph(spark, DATA), "core", 1), (projection.graph(spark, DATA, 2), "extension", 5)]
    one, two = projection.tagged(spark, DATA, [("core", 1), ("extension", 5)]), merge.tagged(sources).select(*projection.COLUMNS, "source", "priority", "ord")
    assert one.exceptAll(two).isEmpty() and two.exceptAll(one).isEmpty()
    assert exchanges(one.groupBy("s", "p", "o").count().groupBy("s", "p").count()) == 0


def test_inherited_properties_are_counted_by_kind_of_class(spark):
    """Classes below the same domains are counted once; own properties, repeated ones and cycles count as in the pairs."""
    e, iri = "http://x#", lambda x: "http://x#" + x
    up = [("b", "a"), ("c", "b"), ("d", "b"), ("x", "y"), ("y", "x"), ("d", "x"), *((f"leaf{i}", "c") for i in range(50))]
    domains = [("p", "a"), ("q", "a"), ("q", "b"), ("r", "b"), ("p", "d"), ("s", "x"), ("r", "y")]
    triples = [(iri(a), v.SUBCLASS, iri(b)) for a, b in up] + [(iri(a), v.DOMAIN, iri(b)) for a, b in domains]
    g = projection.constants(spark, triples)
    want = docs.inherited_properties(g).groupBy("class").agg(F.count("*").alias("n"), F.min("property").alias("first_property"))
    got = docs.inherited_property_counts(g)
    assert sorted(got.collect()) == sorted(want.collect()) and got.where(f"class = '{e}leaf7'").first().n == 3


def test_changed_entities_are_found_where_the_graph_lies(spark):
    g, h = projection.graph(spark, DATA), projection.graph(spark, DATA, 2)
    for ignore in (None, [v.LABEL]):
        found = diff.entities_of(projection.changing(spark, DATA), ignore)
        assert exchanges(found) == 0
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, diff.entities(g, h, ignore).collect()))
