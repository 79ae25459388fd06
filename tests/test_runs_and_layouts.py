"""Whole merges and splits, and layouts of diagrams, on small graphs."""

import pytest
from pyspark.sql import functions as F
from test_rules_and_names import EX, graph_of

from ontospark.functions import vocab as v
from ontospark.operators import docs, merge, spaces, split


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_a_whole_merge(spark):
    a = graph_of(spark, [("x", "name", '"A'), ("x", "name", '"A'), ("x", v.SUBCLASS, "y"), ("o", v.IMPORTS, "up")])
    b = graph_of(spark, [("x", "name", '"B'), ("x", v.SUBCLASS, "y")])
    none = a.where("false")
    given = [merge.Source(a, "a", 9), merge.Source(b, "b", 1), merge.Source(none, "none", 1)]
    for strategy, winner in (("priority", "A"), ("first", "A"), ("last", "B"), ("mark_all", None)):
        done = merge.run(given, strategy)
        assert rows(done.conflicts) == [(EX + "x", EX + "name", "value", 2, winner)]
        told = {(r.measure, r.name): r.n for r in done.summary.collect()}
        assert told == {
            ("source", "a"): 3, ("source", "b"): 2, ("source", "none"): 0, ("conflicts", "value"): 1, ("conflicts", "resolved"): int(winner is not None),
            ("conflicts", "unresolved"): int(winner is None), ("result", "triples"): 4,
        }
    assert merge.run(given, imports="remove").graph.where(F.col("p") == v.IMPORTS).count() == 0
    added = merge.run(given, imports="merge", head=EX + "o").graph.where(F.col("p") == v.IMPORTS)
    assert {r.o for r in added.collect()} == {EX + "up", "a", "b", "none"}
    moved = merge.run([merge.Source(a, "a", 1), merge.Source(b, "b", 1, [(EX, "n:")])])
    assert moved.conflicts.count() == 0 and moved.graph.where("s = 'n:x' AND p = 'n:name'").count() == 1
    assert {r.n for r in merge.run([merge.Source(none, "none", 1)]).summary.collect()} == {0}
    for bad in (lambda: merge.run([]), lambda: merge.run(given, "best"), lambda: merge.run(given, imports="maybe")):
        with pytest.raises(ValueError):
            bad()


def test_a_whole_split(spark):
    g = graph_of(spark, [
        ("A", v.TYPE, v.OWL_CLASS), ("B", v.TYPE, v.OWL_CLASS), ("B", v.SUBCLASS, "A"), ("C", v.TYPE, v.OWL_CLASS), ("C", v.SUBCLASS, "B"), ("C", v.SUBCLASS, "B"),
        ("i", v.TYPE, "B"), ("i", "name", '"one'),
    ])
    done = split.run(g, [split.Module("a", classes=[EX + "A"]), split.Module("b", classes=[EX + "B"]), split.Module("nothing", classes=[EX + "Z"])], {"b": ["http://up"], "nothing": ["http://up"]})
    got = {(r.module, r.s.replace(EX, ""), r.p, r.o.replace(EX, "")) for r in done.triples.collect()}
    head = "http://example.org/"
    assert got == {
        ("a", "A", v.TYPE, v.OWL_CLASS), ("a", head + "a", v.TYPE, v.ONTOLOGY), ("b", "B", v.TYPE, v.OWL_CLASS), ("b", "B", v.SUBCLASS, "A"), ("b", head + "b", v.TYPE, v.ONTOLOGY),
        ("b", head + "b", v.IMPORTS, "a.ttl"), ("b", head + "b", v.IMPORTS, "http://up"), ("common", "C", v.TYPE, v.OWL_CLASS), ("common", "C", v.SUBCLASS, "B"),
        ("common", head + "common", v.TYPE, v.ONTOLOGY), ("common", head + "common", v.IMPORTS, "b.ttl"), ("data_b", "i", v.TYPE, "B"), ("data_b", "i", EX + "name", "one"),
    }
    assert done.triples.count() == len(got) and done.error.count() == 0 and done.manifest.count() == 3
    assert split.run(g, [], rest="error").error.first().n == 3
    empty = split.run(g.where("false"), [split.Module("a", classes=[EX + "A"])], rest="error")
    assert empty.triples.count() == empty.error.count() == 0
    with pytest.raises(ValueError):
        split.run(g, [], rest="drop")


def test_layouts(spark):
    assert docs.directives() == docs.directives("sideways") == ["top to bottom direction"]
    assert docs.directives("RTL", True, "Ortho", 2, {"nodesep": 40}) == ["hide empty members", "skinparam linetype ortho", "skinparam groupInheritance 2", "skinparam nodesep 40"]
    assert docs.directives("lr", line_type="wavy") == ["left to right direction"]
    kinds = spark.createDataFrame([("subclass",), ("instance",), ("object_property",), (None,)], "k string")
    shown = lambda *x: [r.a for r in kinds.select(docs.arrow(F.col("k"), *x).alias("a")).collect()]
    assert shown() == shown("nowhere") == ["-up-|>", "-up-|>", "->", "->"]
    assert shown("DOWN")[0] == "-down-|>" and shown("up", False) == ["--"] * 4
    groups = spark.createDataFrame([("g", EX + "a"), ("g", EX + "a"), ("g", EX + "b"), (None, EX + "c"), ("h", None)], "group string, uri string")
    assert rows(docs.together(groups, {"e": EX})) == [("g", 0, "together {"), ("g", 1, "  class e.a"), ("g", 1, "  class e.b"), ("g", 2, "}")]
    hints = spark.createDataFrame([(EX + "a", EX + "b", "left", 2), (EX + "a", EX + "c", None, None), (EX + "a", EX + "d", "", 0), (None, EX + "d", "", 3)], "src string, dst string, direction string, weight int")
    assert [x for (x,) in rows(docs.hidden_links(hints, {"e": EX}))] == ["e.a -[hidden,left]-> e.b"] * 2 + ["e.a -[hidden]-> e.c"]
    assert docs.together(groups.where("false"), {}).count() == docs.hidden_links(hints.where("false"), {}).count() == 0


def test_prefixes_of_files(spark):
    said = [("a", 1, "@prefix e: <http://old#> ."), ("a", 2, "  PREFIX e: <http://e#>"), ("a", 3, "@prefix : <http://none#> ."), ("b", 1, "prefix e: <http://b#>"), ("b", 2, "@prefix x: <http://x#> ."),
            ("b", 3, None), ("b", 4, ""), ("b", 5, "e:a e:b <http://c> .")]
    lines = spark.createDataFrame(said, "file string, line bigint, value string").repartition(3)
    found = spaces.declared(lines)
    assert rows(found) == [("a", "", "http://none#"), ("a", "e", "http://e#"), ("b", "e", "http://b#"), ("b", "x", "http://x#")]
    assert rows(spaces.bound(found)) == [("", "http://none#", 0), ("e", "http://e#", 0), ("x", "http://x#", 0)]
    assert rows(spaces.bound(found, [("x", "n:"), ("y", "m:")], ["y", "gone", "e", "y"])) == [("", "http://none#", 3), ("e", "http://e#", 2), ("x", "n:", 3), ("y", "m:", 0)]
    assert spaces.bound(spaces.declared(lines.where("false"))).count() == 0
