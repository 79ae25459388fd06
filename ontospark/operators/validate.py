"""Validation of class models and of the ontologies made from them: ``code, severity, entity, n`` (how often)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab as v
from . import closure, model, select


def _issues(df: DataFrame, code: str, severity: str, entity: Column, n: Column | None = None) -> DataFrame:
    return df.groupBy(entity.alias("entity")).agg(F.coalesce(F.sum(F.lit(1) if n is None else n), F.lit(0)).alias("n")).select(F.lit(code).alias("code"), F.lit(severity).alias("severity"), "entity", "n")


def graph_issues(g: DataFrame) -> DataFrame:
    """Superclass statements of untyped classes, object and datatype properties without domain or range, and domains and
    ranges that are no class of the graph (an outside range is only worth a note)."""
    c, iri = select.classes(g), (F.col("s_kind") == "iri")
    untyped = g.where((F.col("p") == v.SUBCLASS) & iri).join(c.select(F.col("uri").alias("s")), "s", "left_anti")
    objects, data = select.typed(g, [v.OBJECT_PROPERTY], True), select.typed(g, [v.DATATYPE_PROPERTY], True)
    has = lambda p: g.where(F.col("p") == p).select(F.col("s").alias("uri"))
    without = objects.join(has(v.DOMAIN), "uri", "left_anti")
    unbound = objects.unionByName(data).join(has(v.RANGE), "uri", "left_anti")

    def outside(p: str) -> DataFrame:
        ends = g.where((F.col("p") == p) & (F.col("o_kind") == "iri")).join(select.typed(g, [v.OBJECT_PROPERTY]).withColumnRenamed("uri", "s"), "s", "left_semi")
        return ends.join(c.select(F.col("uri").alias("o")), "o", "left_anti")

    pair = F.concat("s", F.lit(" -> "), "o")
    parts = [
        _issues(untyped, "UNTYPED_CLASS", "warning", F.col("s")), _issues(without, "MISSING_DOMAIN", "info", F.col("uri")), _issues(unbound, "MISSING_RANGE", "info", F.col("uri")),
        _issues(outside(v.DOMAIN), "UNDEFINED_DOMAIN", "warning", pair), _issues(outside(v.RANGE), "EXTERNAL_RANGE", "info", pair),
    ]
    return reduce(DataFrame.unionByName, parts)


def model_issues(classes: DataFrame, attributes: DataFrame, relations: DataFrame) -> DataFrame:
    """Names of several classes, relations to unknown classes, members of inheritance cycles, unknown datatypes, and
    classes without relations or attributes."""
    again = classes.groupBy("name").agg((F.count("*") - 1).alias("more")).where("more > 0")
    known = classes.select(F.explode(F.array(F.col("name"), model.qualified(F.col("package"), F.col("name")))).alias("end")).distinct()
    ends = relations.select(F.explode(F.array("source", "target")).alias("end"))
    up = relations.where("kind = 'inheritance'").select(F.col("source").alias("src"), F.col("target").alias("dst"))
    low = F.lower("datatype")
    odd = attributes.where(F.col("datatype").isNotNull() & ~low.isin(list(model.DATATYPES)) & ~F.col("datatype").startswith("xsd:"))
    used = ends.select(F.col("end").alias("name")).distinct()
    bare = classes.join(used, "name", "left_anti").join(attributes.select("package", F.col("class").alias("name")).distinct().alias("x"), (F.col("x.name") == classes.name) & F.col("x.package").eqNullSafe(classes.package), "left_anti")
    parts = [
        _issues(again, "DUPLICATE_CLASS", "error", F.col("name"), F.col("more")), _issues(ends.join(known, "end", "left_anti"), "UNKNOWN_CLASS", "error", F.col("end")),
        _issues(closure.cycle_members(up), "INHERITANCE_CYCLE", "error", F.col("uri")), _issues(odd, "UNKNOWN_DATATYPE", "warning", F.concat("class", F.lit("."), "name")),
        _issues(bare, "ISOLATED_CLASS", "info", F.col("name")),
    ]
    return reduce(DataFrame.unionByName, parts)


def counts(issues: DataFrame) -> DataFrame:
    """``code, severity, entities, n``."""
    return issues.groupBy("code", "severity").agg(F.count("*").alias("entities"), F.sum("n").alias("n"))
