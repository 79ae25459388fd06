"""Terms as columns: names, namespaces, formatting, categories."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab as v


def namespace(iri: Column) -> Column:
    """Up to the last ``#``, else the last ``/``; empty without either."""
    cut = F.when(iri.contains("#"), F.length(iri) - F.locate("#", F.reverse(iri)) + 1).otherwise(F.when(iri.contains("/"), F.length(iri) - F.locate("/", F.reverse(iri)) + 1).otherwise(0))
    return F.substr(iri, F.lit(1), cut)


def local_name(iri: Column) -> Column:
    """After the last ``#``, else after the last ``/``."""
    return F.when(iri.contains("#"), F.element_at(F.split(iri, "#"), -1)).otherwise(F.element_at(F.split(iri, "/"), -1))


def qname(iri: Column, prefixes: dict[str, str]) -> Column:
    """``prefix:name`` by the longest namespace that matches, else ``<iri>``."""
    out = F.concat(F.lit("<"), iri, F.lit(">"))
    for prefix, ns in sorted(prefixes.items(), key=lambda x: (len(x[1]), x[0])):
        out = F.when(iri.startswith(ns), F.concat(F.lit(prefix + ":"), F.substr(iri, F.lit(len(ns) + 1)))).otherwise(out)
    return out


def is_builtin(iri: Column) -> Column:
    return reduce(Column.__or__, [iri.startswith(ns) for ns in v.BUILTIN])


def escaped(text: Column) -> Column:
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def turtle(o: Column, kind: Column, dt: Column, lang: Column, prefixes: dict[str, str]) -> Column:
    """A term as Turtle."""
    quoted = F.concat(F.lit('"'), escaped(o), F.lit('"'))
    literal = F.when(lang != "", F.concat(quoted, F.lit("@"), lang)).when(dt != "", F.concat(quoted, F.lit("^^"), qname(dt, prefixes))).otherwise(quoted)
    return F.when(kind == "iri", qname(o, prefixes)).when(kind == "bnode", F.concat(F.lit("_:"), o)).otherwise(literal)


def category(p: Column) -> Column:
    """What a changed predicate is about. The words and the order of the tests."""
    low, has = F.lower(p), lambda c, *xs: reduce(Column.__or__, [c.contains(x) for x in xs])
    axiom = low.contains("owl") & has(p, "disjoint", "inverse", "functional", "cardinality", "restriction", "union", "intersection")
    return (
        F.when(p.endswith("type") | p.contains("rdf-syntax-ns#type"), "type")
        .when(has(p, "subClassOf", "subPropertyOf", "equivalentClass", "equivalentProperty"), "hierarchy")
        .when(has(p, "domain", "range"), "domain_range")
        .when(low.contains("label") | p.contains("prefLabel"), "label")
        .when(has(low, "comment", "description", "definition", "note"), "documentation")
        .when(axiom, "owl_axiom")
        .otherwise("other")
    )


def keywords(text: Column) -> Column:
    """Distinct words of over two letters or digits that aren't stop words, in order of first use."""
    words = F.split(F.lower(text), "[^a-z0-9]+")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(v.STOP_WORDS)))


def expand(text: Column, prefixes: dict[str, str]) -> Column:
    """A name as an IRI: ``<iri>``, a full IRI, or ``prefix:name``; null for an unbound prefix and anything else."""
    x = F.trim(text)
    bound = F.lit(None).cast("string")
    for prefix, ns in prefixes.items():
        bound = F.when(F.split_part(x, F.lit(":"), F.lit(1)) == prefix, F.concat(F.lit(ns), F.substr(x, F.lit(len(prefix) + 2)))).otherwise(bound)
    return F.when(x.startswith("<") & x.endswith(">"), F.substr(x, F.lit(2), F.length(x) - 2)).when(x.contains("://"), x).when(x.contains(":"), bound)


def shorten_property(iri: Column) -> Column:
    """The prefixes of translation files in place of their namespaces."""
    out = iri
    for prefix, ns in v.TRANSLATION_PREFIXES.items():
        out = F.when(iri.startswith(ns), F.concat(F.lit(prefix), F.substr(iri, F.lit(len(ns) + 1)))).otherwise(out)
    return out


def expand_property(name: Column) -> Column:
    out = name
    for prefix, ns in v.TRANSLATION_PREFIXES.items():
        out = F.when(name.startswith(prefix), F.concat(F.lit(ns), F.substr(name, F.lit(len(prefix) + 1)))).otherwise(out)
    return out


def file_name(q: Column) -> Column:
    """A qualified name as a file name: without its prefix, path signs as underscores."""
    local = F.when(q.contains(":"), F.substr(q, F.locate(":", q) + 1)).otherwise(q)
    return F.translate(local, "/\\#", "___")
