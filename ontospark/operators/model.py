"""Class models (as a class diagram gives them) to an ontology.

A model is three tables: ``classes`` (package, name, display, note), ``attributes`` (package, class, name, datatype) and
``relations`` (source, target, kind, label), whose ends are a local or a qualified name (``package.name``) and whose kind is
``inheritance`` or ``association``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab as v
from . import select

#: Type names of diagrams and their datatypes.
DATATYPES = {
    "string": "string", "str": "string", "text": "string", "integer": "integer", "int": "integer", "decimal": "decimal", "float": "float", "double": "double",
    "number": "decimal", "boolean": "boolean", "bool": "boolean", "date": "date", "datetime": "dateTime", "time": "time", "gyear": "gYear",
    "duration": "duration", "uri": "anyURI", "anyuri": "anyURI", "url": "anyURI", "base64": "base64Binary", "language": "language", "token": "token",
}


def datatype(name: Column) -> Column:
    """The XSD datatype of a type name; ``xsd:x`` is itself, names that aren't known are strings."""
    known = F.create_map(*[F.lit(x) for pair in DATATYPES.items() for x in pair])
    alias = F.element_at(known, F.lower(F.trim(name)))
    return F.concat(F.lit(v.XSD), F.coalesce(alias, F.when(name.startswith("xsd:"), F.substr(name, F.lit(5))), F.lit("string")))


def camel_to_label(name: Column) -> Column:
    """``wingSpanOfXMLFile`` to ``wing span of xml file``: a gap where a small letter meets a capital, and before a word that follows capitals."""
    return F.lower(F.regexp_replace(name, "(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", " "))


def label_to_property(label: Column) -> Column:
    """``is located in`` to ``isLocatedIn``; a single word keeps its case."""
    words = F.split(F.trim(label), r"\s+")
    camel = F.array_join(F.transform(words, lambda w, i: F.when(i == 0, F.lower(w)).otherwise(F.initcap(w))), "")
    return F.regexp_replace(F.when(F.trim(label).contains(" "), camel).otherwise(F.trim(label)), "[^a-zA-Z0-9]", "")


def qualified(package: Column, name: Column) -> Column:
    return F.when(package.isNull(), name).otherwise(F.concat(package, F.lit("."), name))


def namespace(base: str, package: Column) -> Column:
    """The base itself for classes without a package."""
    return F.when(package.isNull(), F.lit(base)).otherwise(F.concat(F.lit(base.rstrip("#/") + "/"), package, F.lit("#")))


def names(classes: DataFrame, base: str) -> DataFrame:
    """``name, uri, ns`` of local and qualified names; a local name in several packages means the smallest of them."""
    ns = namespace(base, F.col("package"))
    each = classes.select(F.explode(F.array(F.col("name"), qualified(F.col("package"), F.col("name")))).alias("known"), F.struct(F.concat(ns, "name").alias("uri"), ns.alias("ns")).alias("x"))
    return each.groupBy("known").agg(F.min("x").alias("x")).select(F.col("known").alias("name"), "x.uri", "x.ns")


def to_graph(classes: DataFrame, attributes: DataFrame, relations: DataFrame, base: str, title: str, lang: str = "en") -> DataFrame:
    """The ontology of a model as triples. Relations whose ends aren't known give none (``validate.model_issues`` lists them)."""

    lit, bare = F.lit, base.rstrip("#/")

    def star(df: DataFrame, *rows: tuple[Column, str, Column, bool]) -> DataFrame:
        """All triples of each row in one pass; those with a null object are none."""
        cells = [
            F.struct(s.alias("s"), lit("iri").alias("s_kind"), lit(p).alias("p"), o.alias("o"), lit("literal" if literal else "iri").alias("o_kind"), lit("").alias("o_dt"), lit(lang if literal else "").alias("o_lang"))
            for s, p, o, literal in rows
        ]
        return df.select(F.explode(F.filter(F.array(*cells), lambda x: x["o"].isNotNull())).alias("x")).select("x.*")

    uri, owner = F.concat(namespace(base, F.col("package")), "name"), F.concat(namespace(base, F.col("package")), "class")
    known = names(classes, base)
    a, b = (known.select(F.col("name").alias(end), F.col("uri").alias(f"{end}_uri"), F.col("ns").alias(f"{end}_ns")) for end in ("source", "target"))
    own = F.coalesce(label_to_property(F.col("label")), F.concat(lit("has"), "target"))
    linked = relations.join(a, "source").join(b, "target").withColumn("own", own).withColumn("path", F.concat("source_ns", "own"))
    path, assoc = F.col("path"), lambda x: F.when(F.col("kind") != "inheritance", x)
    parts = [
        star(classes.sparkSession.range(1), (lit(bare), v.TYPE, lit(v.ONTOLOGY), False), (lit(bare), v.LABEL, lit(title), True)),
        star(classes, (uri, v.TYPE, lit(v.OWL_CLASS), False), (uri, v.LABEL, F.coalesce("display", camel_to_label(F.col("name"))), True), (uri, v.COMMENT, F.col("note"), True)),
        star(
            attributes, (uri, v.TYPE, lit(v.DATATYPE_PROPERTY), False), (uri, v.DOMAIN, owner, False), (uri, v.LABEL, camel_to_label(F.col("name")), True),
            (uri, v.RANGE, F.when(F.col("datatype").isNotNull(), datatype(F.col("datatype"))), False),
        ),
        star(
            linked, (F.col("source_uri"), v.SUBCLASS, F.when(F.col("kind") == "inheritance", F.col("target_uri")), False), (path, v.TYPE, assoc(lit(v.OBJECT_PROPERTY)), False),
            (path, v.DOMAIN, assoc(F.col("source_uri")), False), (path, v.RANGE, assoc(F.col("target_uri")), False), (path, v.LABEL, assoc(F.coalesce("label", camel_to_label(F.col("own")))), True),
        ),
    ]
    return reduce(DataFrame.unionByName, parts).select(*select.TERM).distinct()
