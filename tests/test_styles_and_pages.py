"""Predicate orders by kind, styles, pages, functions of terms, verdicts."""

import math

import pytest
from pyspark.sql import functions as F

from ontospark.functions import values
from ontospark.functions import vocab as v
from ontospark.operators import describe, docs, order, split

EX = "http://e.org/o#"
P = {"ex": EX, "rdfs": v.RDFS, "owl": v.OWL}
COLUMNS = "s string, s_kind string, p string, o string, o_kind string, o_dt string, o_lang string"


def graph_of(spark, triples):
    """``_:x`` is a blank node, ``"x`` a literal, anything else the name of an IRI, or an IRI."""
    def term(x):
        return (x[2:], "bnode") if x.startswith("_:") else (x[1:], "literal") if x.startswith('"') else (x if "://" in x else EX + x, "iri")

    return spark.createDataFrame([(*term(s), term(p)[0], *term(o), "", "") for s, p, o in triples], COLUMNS)


def told(df, *columns):
    return {tuple(r[c] for c in columns) for r in df.collect()}


@pytest.fixture(scope="module")
def zoo(spark):
    return graph_of(spark, [
        ("Animal", v.TYPE, v.OWL_CLASS), ("Dog", v.TYPE, v.OWL_CLASS), ("Dog", v.SUBCLASS, "Animal"), ("Pup", v.TYPE, v.RDFS_CLASS), ("Pup", v.SUBCLASS, "Dog"), ("Dog", v.COMMENT, '"barks'), ("Dog", v.LABEL, '"dog'),
        ("Animal", v.COMMENT, '"' + "é" * 101), ("Pup", v.COMMENT, '"' + "x" * 100), ("Animal", v.LABEL, '"'),
        ("owns", v.TYPE, v.OBJECT_PROPERTY), ("owns", v.TYPE, v.FUNCTIONAL), ("owns", v.DOMAIN, "Animal"), ("owns", v.LABEL, '"owns'), ("name", v.TYPE, v.DATATYPE_PROPERTY), ("note", v.TYPE, v.ANNOTATION_PROPERTY), ("plain", v.TYPE, v.RDF_PROPERTY),
        ("rex", v.TYPE, "Dog"), ("rex", "name", '"Rex'), ("rex", v.LABEL, '"R'), ("bit", v.TYPE, "Pup"), ("bit", v.TYPE, "Animal"), ("stone", v.TYPE, "Rock"), ("thing", v.TYPE, v.NAMED_INDIVIDUAL), ("_:b", "name", '"none'),
    ])


def test_predicates_in_the_order_of_their_kind(zoo):
    orders = {"classes": ([v.LABEL], [v.SUBCLASS]), "individuals": ([], [EX + "name"]), "default": ([v.LABEL, v.DOMAIN], [])}
    got = {}
    for r in order.lines_by_kind(zoo, P, orders).orderBy("subject", "ord").collect():
        got.setdefault((r.subject, r.kind), []).append(r.line.split(" ")[0])
    assert got["ex:Dog", "classes"] == ["a", "rdfs:label", "rdfs:comment", "rdfs:subClassOf"]
    assert got["ex:owns", "properties"] == ["a", "rdfs:label", "rdfs:domain"]  # no lists of their own: the default's
    assert got["ex:rex", "individuals"] == ["a", "rdfs:label", "ex:name"]
    assert got["_:b", "individuals"] == ["ex:name"]
    same = lambda df: told(df, "subject", "ord", "line")
    assert same(order.lines_by_kind(zoo, P, None)) == same(order.lines(zoo, P, [], []))
    assert order.lines_by_kind(zoo.limit(0), P, orders).count() == 0


def test_a_profile_with_any_list_hides_the_general_orders():
    mine, general = {"default": ([], ["b"])}, {"classes": (["a"], [])}
    assert order.effective_orders(mine, general) is mine
    assert order.effective_orders({"classes": ([], [])}, general) is general
    assert order.effective_orders(None, {}) is None and order.effective_orders({}, {"default": ([], [])}) is None


def test_styles_of_instances(spark, zoo):
    few = lambda *rows: spark.createDataFrame(rows, "uri string, style string")
    made = lambda by_type, by_class, text: {r.uri[len(EX):]: (r.style, r.text, r.how) for r in docs.instance_styles(zoo, by_type, by_class, [(EX + "R", "green")], "black", "white", text).collect()}
    got = made(few((EX + "Rock", "grey")), few((EX + "Animal", "red"), (EX + "Dog", "brown")), True)
    # a style of the type as a class isn't that of its instances, only one above it is; bit's first type is Animal
    assert got == {"rex": ("red", "red", "inherited"), "bit": ("black", "red", "default"), "stone": ("grey", "green", "type"), "thing": ("black", "white", "default")}
    got = made(few((EX + "Dog", "tan")), few((EX + "Nowhere", "red")), False)
    assert got == {"rex": ("tan", None, "type"), "bit": ("black", None, "default"), "stone": ("black", None, "default"), "thing": ("black", None, "default")}
    assert docs.instance_styles(zoo.limit(0), few(("x", "y")), few(("x", "y")), [], "a", "b").count() == 0


def test_styles_of_properties(zoo):
    made = lambda spaces, kinds: {r.uri[len(EX):]: (r.style, r.how) for r in docs.property_styles(zoo, spaces, kinds).collect()}
    got = made([(EX + "na", "blue")], [(v.FUNCTIONAL, "teal"), (v.OBJECT_PROPERTY, "navy"), (v.ANNOTATION_PROPERTY, "gold")])
    assert got == {"owns": ("teal", "type"), "name": ("blue", "namespace"), "note": ("gold", "type"), "plain": ("#CCCCCC", "default")}
    assert set(made([], []).values()) == {("#CCCCCC", "default")}


def test_index_and_pages(zoo):
    got = {r.uri[len(EX):]: r.line for r in docs.index_lines(zoo, P, ["class"]).collect()}
    assert got == {
        "Dog": "- [dog](classes/Dog.md) — barks", "Animal": "- [ex:Animal](classes/Animal.md) — " + "é" * 100 + "...",  # an empty label is none
        "Pup": "- [ex:Pup](classes/Pup.md) — " + "x" * 100,
    }
    pages = {r.path: r.page for r in docs.class_pages(zoo, P).collect()}
    assert pages["classes/Dog.md"] == (
        f"---\ntitle: dog\ntype: class\nparents:\n  - ex:Animal\n---\n\n# dog\n\n**URI:** `{EX}Dog`\n\nbarks\n\n## Superclasses\n\n- [ex:Animal](classes/Animal.md)\n"
    )
    assert "parents" not in pages["classes/Animal.md"] and "Superclasses" not in pages["classes/Animal.md"]


def test_verdict_and_parts(spark, zoo):
    assert describe.verdict(zoo).collect()[0].verdict == "OWL 2 DL (simple) | 25 triples, 3 classes, 4 properties, 4 individuals"
    more = zoo.unionByName(graph_of(spark, [("o", v.IMPORTS, "x"), ("o", v.IMPORTS, "y"), ("o2", v.IMPORTS, "y")]))
    assert describe.verdict(more).collect()[0].verdict.endswith(" | 2 imports")
    assert describe.verdict(zoo.limit(0)).collect()[0].verdict == "RDF | 0 triples"
    brief, whole = describe.describe(zoo, brief=True), describe.describe(more)
    assert set(brief) == {"metadata", "metrics", "profile", "verdict"} < set(whole)
    assert {r.uri for r in whole["imports"].collect()} == {EX + "x", EX + "y"} and whole["hierarchy"].collect()[0].classes == 3


def test_unmatched_entities(spark):
    rows = lambda n: spark.createDataFrame([(f"u{k}", "common" if k < n else "m") for k in range(9)], "uri string, module string")
    assert split.unmatched(rows(0)).count() == 0
    assert [tuple(r) for r in split.unmatched(rows(5)).collect()] == [(5, "Unmatched entities (5): u0, u1, u2, u3, u4")]
    assert [tuple(r) for r in split.unmatched(rows(7)).collect()] == [(7, "Unmatched entities (7): u0, u1, u2, u3, u4...")]


def test_functions_of_terms(spark):
    xsd = v.XSD
    rows = [("12.5", "literal", xsd + "decimal", ""), ("-12.5", "literal", xsd + "double", ""), ("x", "literal", xsd + "int", ""), ("7", "literal", "", ""), ("a b", "literal", "", "en-GB"), ("7", "iri", xsd + "int", ""), (None, "literal", "", "")]
    df = spark.createDataFrame(rows, "o string, k string, dt string, lang string")
    o, k, dt, lang = map(F.col, df.columns)
    x = values.number(o, k, dt)
    got = [tuple(r) for r in df.select(x, values.round_up(x), values.datatype(k, dt, lang), values.lang_matches(lang, "EN"), values.lang_matches(lang, "*")).collect()]
    assert got[:4] == [(12.5, 13, xsd + "decimal", False, False), (-12.5, -12, xsd + "double", False, False), (None, None, xsd + "int", False, False), (None, None, xsd + "string", False, False)]
    assert got[4:6] == [(None, None, v.RDF + "langString", True, True), (None, None, None, False, False)]
    texts = spark.createDataFrame([("a.b.c",), ("",), (None,), ("née.*~ /+",)], "t string")
    got = [tuple(r) for r in texts.select(values.before(F.col("t"), "."), values.after(F.col("t"), "."), values.before(F.col("t"), ""), values.after(F.col("t"), ""), values.before(F.col("t"), "#"), values.after(F.col("t"), "#"), values.encode_for_uri(F.col("t"))).collect()]
    assert got[0] == ("a", "b.c", "", "a.b.c", "", "", "a.b.c") and got[1] == ("", "", "", "", "", "", "")
    assert got[2][:2] == (None, None) and got[3] == ("née", "*~ /+", "", "née.*~ /+", "", "", "n%C3%A9e.%2A~%20%2F%2B")
    dates = spark.createDataFrame([("2024-02-29T23:05:07.25Z",), ("2024-02-29",), ("-0044-03-15",), ("29/02/2024",), (None,)], "t string")
    parts = [tuple(r) for r in dates.select(*(values.date_part(F.col("t"), p) for p in ("year", "month", "day", "hours", "minutes", "seconds"))).collect()]
    assert parts[0][:5] == (2024, 2, 29, 23, 5) and math.isclose(parts[0][5], 7.25)
    assert parts[1] == (2024, 2, 29, None, None, None) and parts[2][0] == -44 and set(parts[3]) == set(parts[4]) == {None}
    lit = lambda *t: tuple(map(F.lit, t))
    pairs = [(("a", "literal", "", "en"), ("a", "literal", "", "EN"), True), (("a", "iri", "", ""), ("a", "literal", "", ""), False), (("1", "literal", xsd + "int", ""), ("1", "literal", xsd + "long", ""), False), (("a", "iri", "x", ""), ("a", "iri", "", ""), True)]
    assert [spark.range(1).select(values.same_term(lit(*a), lit(*b))).first()[0] for a, b, _ in pairs] == [w for *_, w in pairs]
