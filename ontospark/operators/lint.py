"""Lint rules: a registry of functions from triples to ``rule_id, severity, entity, detail``."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import terms
from ..functions import vocab as v
from ..sources.scratch import written
from . import closure, select

RULES: dict[str, tuple[str, Callable[[DataFrame], DataFrame]]] = {}


def rule(rule_id: str, severity: str):
    """Registers a function that gives ``entity, detail``; users add their own the same way."""
    def put(f: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        RULES[rule_id] = severity, f
        return f

    return put


def run(g: DataFrame, rules: list[str] | None = None, severities: dict[str, str] | None = None) -> DataFrame:
    """The issues of the given rules (all by default) under their severities or the overriding ones."""
    found = []
    for name in rules or list(RULES):
        severity, f = RULES[name]
        severity = (severities or {}).get(name, severity)
        try:
            issues = f(g)
        except AnalysisException as e:  # a rule that can't be planned is an issue of its own, the others still run; whatever fails at run time fails
            issues, name, severity = g.sparkSession.createDataFrame([(name, str(e).split("\n")[0])], "entity string, detail string"), "rule-error", "error"
        found.append(issues.select(F.lit(name).alias("rule_id"), F.lit(severity).alias("severity"), "entity", "detail"))
    return reduce(DataFrame.unionByName, found)


def effective(enable: list[str] | None = None, disable: list[str] | None = None, level: str = "info") -> list[str]:
    """Rules after enabling, disabling and the least severity."""
    order = ["error", "warning", "info"]
    return [n for n, (s, _) in RULES.items() if (not enable or n in enable) and n not in (disable or []) and order.index(s) <= order.index(level)]


def summary(issues: DataFrame) -> DataFrame:
    """``severity, n`` of the issues."""
    return issues.groupBy("severity").agg(F.count("*").alias("n"))


def exit_code(issues: DataFrame) -> DataFrame:
    """2 with errors, 1 with warnings, else 0."""
    worst = F.max(F.when(F.col("severity") == "error", 2).when(F.col("severity") == "warning", 1).otherwise(0))
    return issues.agg(F.coalesce(worst, F.lit(0)).cast("long").alias("exit_code"))


def _plain(df: DataFrame, detail: str = "") -> DataFrame:
    return df.select(F.col("uri").alias("entity"), F.lit(detail).alias("detail"))


@rule("orphan-class", "error")
def orphan_class(g: DataFrame) -> DataFrame:
    """Classes without a named superclass; top classes and built-in terms aside."""
    c = select.classes(g, True).where(~terms.is_builtin(F.col("uri")))
    return _plain(c.join(select.edges(g).select(F.col("src").alias("uri")), "uri", "left_anti"))


@rule("dangling-reference", "error")
def dangling_reference(g: DataFrame) -> DataFrame:
    """Terms that are used but never typed, in a namespace where something is."""
    defined = g.where((F.col("p") == v.TYPE) & (F.col("s_kind") == "iri")).select(F.col("s").alias("uri")).distinct()
    spaces = defined.select(terms.namespace(F.col("uri")).alias("ns")).distinct()
    used = select.referenced(g).where(~terms.is_builtin(F.col("uri"))).join(defined, "uri", "left_anti")
    return _plain(used.withColumn("ns", terms.namespace(F.col("uri"))).join(spaces, "ns", "left_semi"))


@rule("circular-subclass", "error")
def circular_subclass(g: DataFrame) -> DataFrame:
    return _plain(closure.cycle_members(select.edges(g)).join(select.classes(g, True), "uri", "left_semi"))


@rule("property-no-type", "error")
def property_no_type(g: DataFrame) -> DataFrame:
    """Subjects of domains (each triple), else of ranges, that aren't typed as properties."""
    of = lambda p: g.where((F.col("p") == p) & (F.col("s_kind") == "iri")).select(F.col("s").alias("uri")).join(select.properties(g), "uri", "left_anti")
    domain, range_ = of(v.DOMAIN), of(v.RANGE)
    return _plain(domain, "domain").unionByName(_plain(range_.join(domain, "uri", "left_anti"), "range"))


@rule("empty-ontology", "error")
def empty_ontology(g: DataFrame) -> DataFrame:
    noted = g.where(F.col("p").isin(v.HEADER_NOTES)).select(F.col("s").alias("uri"))
    return _plain(select.typed(g, [v.ONTOLOGY], True).join(noted, "uri", "left_anti"))


def _missing(g: DataFrame, predicate: str) -> DataFrame:
    there = g.where(F.col("p") == predicate).select(F.col("s").alias("uri"))
    gone = lambda e: e.where(~terms.is_builtin(F.col("uri"))).join(there, "uri", "left_anti")
    return _plain(gone(select.classes(g, True)), "class").unionByName(_plain(gone(select.properties(g, True)), "property"))


@rule("missing-label", "warning")
def missing_label(g: DataFrame) -> DataFrame:
    return _missing(g, v.LABEL)


@rule("missing-comment", "warning")
def missing_comment(g: DataFrame) -> DataFrame:
    return _missing(g, v.COMMENT)


@rule("redundant-subclass", "info")
def redundant_subclass(g: DataFrame) -> DataFrame:
    """Pairs of direct parents of which one is above the other; the detail names the pair."""
    e = select.edges(g).join(select.classes(g, True), F.col("src") == F.col("uri"), "left_semi")
    e = written(e, "edges")
    pairs = written(e.select("src", F.col("dst").alias("a")).join(e.select("src", F.col("dst").alias("b")), "src").where("a < b"), "pairs")
    above = closure.reach(select.edges(g), to=pairs.select(F.explode(F.array("a", "b")).alias("uri"))).select("src", "dst")
    up = pairs.join(above, (F.col("a") == above.src) & (F.col("b") == above.dst), "left_semi")
    down = pairs.join(above, (F.col("b") == above.src) & (F.col("a") == above.dst), "left_semi")
    return up.unionByName(down).distinct().select(F.col("src").alias("entity"), F.concat_ws(" ", "a", "b").alias("detail"))


def without_inherited(g: DataFrame, predicate: str) -> DataFrame:
    """Object properties that neither they nor any property above give a domain or range."""
    given = g.where(F.col("p") == predicate).select(F.col("s").alias("uri"))
    below = closure.descendants(select.edges(g, v.SUBPROPERTY), given).select("uri")
    return select.typed(g, [v.OBJECT_PROPERTY], True).join(below, "uri", "left_anti")


@rule("property-no-domain", "info")
def property_no_domain(g: DataFrame) -> DataFrame:
    return _plain(without_inherited(g, v.DOMAIN))


@rule("property-no-range", "info")
def property_no_range(g: DataFrame) -> DataFrame:
    return _plain(without_inherited(g, v.RANGE))


@rule("inconsistent-naming", "info")
def inconsistent_naming(g: DataFrame) -> DataFrame:
    """Classes begin with a capital letter, properties with a small one."""
    first = F.substring(terms.local_name(F.col("uri")), 1, 1)
    letter = F.upper(first) != F.lower(first)
    own = lambda e: e.where(~terms.is_builtin(F.col("uri")) & letter)
    c = own(select.classes(g, True)).where(first != F.upper(first))
    q = own(select.properties(g, True)).where(first != F.lower(first))
    return _plain(c, "class").unionByName(_plain(q, "property"))
