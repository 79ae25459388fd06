"""Splitting a graph into modules, and its data with them."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import terms
from ..functions import vocab as v
from ..sources.scratch import written
from . import closure, select

TERM = select.TERM


@dataclass
class Module:
    """classes and properties by IRI (with all below them among the graph's entities if ``descendants``), and namespaces."""

    name: str
    classes: list[str] = field(default_factory=list)
    properties: list[str] = field(default_factory=list)
    namespaces: list[str] = field(default_factory=list)
    descendants: bool = False


def assign(g: DataFrame, modules: list[Module], common: str = "common") -> DataFrame:
    """``uri, module, kind`` of all classes and properties: explicit ones before descendants before namespaces, then the
    earlier module; the rest are common."""
    known = written(select.classes(g, True).withColumn("kind", F.lit("class")).unionByName(select.properties(g, True).withColumn("kind", F.lit("property"))).groupBy("uri").agg(F.min("kind").alias("kind")), "known")
    spark, claims = g.sparkSession, []
    for k, m in enumerate(modules):
        explicit = [x for x in [*m.classes, *m.properties]]
        if explicit:
            claims.append(known.where(F.col("uri").isin(explicit)).select("uri", F.lit(0).alias("step"), F.lit(k).alias("ord"), F.lit(m.name).alias("module")))
        for given, predicate in ((m.classes, v.SUBCLASS), (m.properties, v.SUBPROPERTY)):
            if m.descendants and given:
                down = select.edges(g, predicate).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
                below = closure.walk(down, known.where(F.col("uri").isin(given)).select("uri"), within=known).where("depth > 0")
                claims.append(below.select("uri", F.lit(1).alias("step"), F.lit(k).alias("ord"), F.lit(m.name).alias("module")))
        for ns in m.namespaces:
            claims.append(known.where(F.col("uri").startswith(ns)).select("uri", F.lit(2).alias("step"), F.lit(k).alias("ord"), F.lit(m.name).alias("module")))
    empty = spark.sql("SELECT '' uri, 0 step, 0 ord, '' module WHERE false")
    best = reduce(DataFrame.unionByName, claims, empty).groupBy("uri").agg(F.min_by("module", F.struct("step", "ord")).alias("module"))
    return known.join(best, "uri", "left").select("uri", F.coalesce("module", F.lit(common)).alias("module"), "kind")


def by_namespace(g: DataFrame) -> DataFrame:
    """``uri, module``: each entity in the module of its namespace, the web's own vocabularies left out."""
    e = select.classes(g, True).unionByName(select.properties(g, True)).distinct()
    ns = terms.namespace(F.col("uri"))
    # fixed values: the domains that are left out
    return e.where(~ns.rlike("w3\\.org|purl\\.org|xmlns\\.com")).select("uri", ns.alias("module"))


def module_triples(g: DataFrame, assigned: DataFrame) -> DataFrame:
    return g.join(assigned.select(F.col("uri").alias("s"), "module"), "s")


def dependencies(g: DataFrame, assigned: DataFrame) -> DataFrame:
    """``module, needs, n``: triples of one module whose object belongs to another."""
    mine = module_triples(g, assigned).where("o_kind = 'iri'")
    other = assigned.select(F.col("uri").alias("o"), F.col("module").alias("needs"))
    return mine.join(other, "o").where("module <> needs").groupBy("module", "needs").agg(F.count("*").alias("n"))


def module_stats(g: DataFrame, assigned: DataFrame) -> DataFrame:
    """``module, classes, properties, triples``."""
    sizes = module_triples(g, assigned).groupBy("module").agg(F.count("*").alias("triples"))
    kinds = assigned.groupBy("module").agg(F.sum(F.when(F.col("kind") == "class", 1).otherwise(0)).alias("classes"), F.sum(F.when(F.col("kind") == "property", 1).otherwise(0)).alias("properties"))
    return kinds.join(sizes, "module", "left").select("module", "classes", "properties", F.coalesce("triples", F.lit(0)).alias("triples"))


def imports(needed: DataFrame, explicit: dict[str, list[str]], base: str = "http://example.org/", suffix: str = ".ttl") -> DataFrame:
    """``s, p, o``: a header for each module of ``dependencies``, its explicit imports and one for each module it needs."""
    head = F.concat(F.lit(base), "module")
    given = [needed.select("module").distinct().where(F.col("module") == m).select(head.alias("s"), F.lit(v.IMPORTS).alias("p"), F.lit(x).alias("o")) for m, xs in explicit.items() for x in xs]
    own = [needed.select(head.alias("s"), F.lit(v.TYPE).alias("p"), F.lit(v.ONTOLOGY).alias("o")), needed.select(head.alias("s"), F.lit(v.IMPORTS).alias("p"), F.concat("needs", F.lit(suffix)).alias("o"))]
    return reduce(DataFrame.unionByName, [*own, *given]).distinct()


def manifest(g: DataFrame, assigned: DataFrame, explicit: dict[str, list[str]], suffix: str = ".ttl") -> DataFrame:
    """``module, file, classes, properties, triples, imports, dependencies``: what the split made, a row a module."""
    needed = written(dependencies(g, assigned), "dependencies").groupBy("module").agg(F.array_join(F.array_sort(F.collect_set("needs")), " ").alias("dependencies"))
    given = F.lit("")
    for name, xs in explicit.items():
        given = F.when(F.col("module") == name, " ".join(sorted(xs))).otherwise(given)
    return module_stats(g, assigned).join(needed, "module", "left").select("module", F.concat("module", F.lit(suffix)).alias("file"), "classes", "properties", "triples", given.alias("imports"), F.coalesce("dependencies", F.lit("")).alias("dependencies"))


def tree(needed: DataFrame, modules: list[str], suffix: str = ".ttl") -> list[str]:
    """Lines of a tree of modules: those that no module needs, and below each module those that need it."""
    pairs = sorted((r.module, r.needs) for r in needed.select("module", "needs").distinct().collect())  # modules are the user's own few
    out: list[str] = []

    def show(name: str, indent: str, path: tuple[str, ...]) -> None:
        out.append(f"{indent}{name}{suffix}")
        below = [m for m in modules if (m, name) in pairs] if name not in path else []
        for m in below:
            show(m, indent + "  ", (*path, name))

    for root in [m for m in modules if m not in {n for _, n in pairs}] or modules[:1]:
        show(root, "", ())
    return out


def totals(stats: DataFrame) -> DataFrame:
    """One row over ``module_stats``."""
    return stats.agg(F.count("*").alias("modules"), *(F.sum(c).alias(c) for c in ("classes", "properties", "triples")))


def data_modules(g: DataFrame, assigned: DataFrame) -> DataFrame:
    """``s, p, …, module``: triples of individuals, in each module that one of their types belongs to."""
    kinds = g.where(F.col("p") == v.TYPE).select("s", F.col("o").alias("uri")).join(assigned.where("kind = 'class'").select("uri", "module"), "uri")
    homes = kinds.select("s", "module").distinct().join(assigned.select(F.col("uri").alias("s")), "s", "left_anti")
    return g.select(*TERM).join(homes, "s")


def unmatched(assigned: DataFrame, common: str = "common", shown: int = 5) -> DataFrame:
    """``n, error`` for a split that must have no rest: how many entities no module takes, and the first by URI. No row if there are none."""
    rest = assigned.where(F.col("module") == common)
    first = rest.orderBy("uri").limit(shown).agg(F.array_join(F.array_sort(F.collect_list("uri")), ", ").alias("first"))
    one = rest.agg(F.count("*").alias("n")).join(F.broadcast(first)).where("n > 0")  # one row each
    more = F.when(F.col("n") > shown, "...").otherwise("")
    return one.select("n", F.concat(F.lit("Unmatched entities ("), F.col("n").cast("string"), F.lit("): "), "first", more).alias("error"))


def write(triples: DataFrame, path: str) -> None:
    """One folder a module."""
    triples.write.partitionBy("module").parquet(path)


class Split(NamedTuple):
    #: ``uri, module, kind``
    assigned: DataFrame
    #: ``module`` and a triple: the entities' own, each module's header and imports, and individuals in modules named with ``data_``.
    triples: DataFrame
    #: What ``manifest`` tells of each module.
    manifest: DataFrame
    #: A row if entities are left that no module takes, and that is an error.
    error: DataFrame


#: What becomes of entities that no module takes.
UNMATCHED = ("common", "error")


def run(g: DataFrame, modules: list[Module], explicit: dict[str, list[str]] | None = None, rest: str = "common", data: bool = True, base: str = "http://example.org/", suffix: str = ".ttl") -> Split:
    """A whole split: assignment, what is left over, triples by module, dependencies, imports and data.

    ``explicit`` has modules' own imports. With ``rest`` as ``error`` the caller reads ``error`` before ``triples``. Defined cases: a module that takes nothing has no triples
    and no header; each other module has one, whether it needs others or not; repeated triples count once; an empty graph gives no rows.
    """
    if rest not in UNMATCHED:
        raise ValueError(f"unknown way with unmatched entities {rest!r}")
    explicit = explicit or {}
    assigned = written(assign(g, modules), "assigned")
    own = module_triples(g, assigned).select("module", *TERM).distinct()
    needed = written(dependencies(g, assigned).select("module", "needs"), "needs")
    iri, none = F.lit("iri"), F.lit("")

    def about(rows: DataFrame, p: str, o) -> DataFrame:
        return rows.select("module", F.concat(F.lit(base), "module").alias("s"), iri.alias("s_kind"), F.lit(p).alias("p"), o.alias("o"), iri.alias("o_kind"), none.alias("o_dt"), none.alias("o_lang"))

    names = assigned.select("module").distinct()
    heads = [about(names, v.TYPE, F.lit(v.ONTOLOGY)), about(needed, v.IMPORTS, F.concat("needs", F.lit(suffix)))]
    heads += [about(names.where(F.col("module") == m), v.IMPORTS, F.lit(x)) for m, xs in explicit.items() for x in xs]
    parts = [own, reduce(DataFrame.unionByName, heads).distinct()]
    if data:
        parts.append(data_modules(g, assigned).select(F.concat(F.lit("data_"), "module").alias("module"), *TERM).distinct())
    left = unmatched(assigned)
    return Split(assigned, reduce(DataFrame.unionByName, parts), manifest(g, assigned, explicit, suffix), left if rest == "error" else left.where("false"))
