"""Selections on the triple relation: patterns, entity kinds, classifiers, set algebra."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import terms
from ..functions import vocab as v
from ..sources.scratch import written

TERM = ["s", "s_kind", "p", "o", "o_kind", "o_dt", "o_lang"]


def match(g: DataFrame, s: str | None = None, p: str | None = None, o: str | None = None) -> DataFrame:
    """Triples that equal the given parts; None is a wildcard."""
    for column, value in (("s", s), ("p", p), ("o", o)):
        if value is not None:
            g = g.where(F.col(column) == value)
    return g


def typed(g: DataFrame, types: list[str], iri_only: bool = False) -> DataFrame:
    """``uri`` of the subjects with one of the types."""
    found = g.where((F.col("p") == v.TYPE) & F.col("o").isin(types))
    return (found.where("s_kind = 'iri'") if iri_only else found).select(F.col("s").alias("uri")).distinct()


def with_predicates(g: DataFrame, types: list[str]) -> DataFrame:
    """The triples whose predicate has one of the types.

    A graph uses few predicates, so those of the types that it uses are broadcast; no task gets all triples of a predicate.
    """
    from .refactor import FEW

    used = written(g.select("p").distinct().join(typed(g, types).select(F.col("uri").alias("p")), "p", "left_semi"), "predicates")
    few = used.limit(FEW + 1).count() <= FEW
    return g.join(F.broadcast(used) if few else used, "p", "left_semi")


def classes(g: DataFrame, iri_only: bool = False) -> DataFrame:
    return typed(g, v.CLASS_TYPES, iri_only)


def properties(g: DataFrame, iri_only: bool = False) -> DataFrame:
    return typed(g, v.PROPERTY_TYPES, iri_only)


def edges(g: DataFrame, predicate: str = v.SUBCLASS) -> DataFrame:
    """``src, dst`` of a predicate between IRIs."""
    return g.where((F.col("p") == predicate) & (F.col("s_kind") == "iri") & (F.col("o_kind") == "iri")).select(F.col("s").alias("src"), F.col("o").alias("dst"))


def individuals(g: DataFrame) -> DataFrame:
    """Typed subjects, blank nodes too, that are no class, property, ontology or vocabulary term."""
    there = g.where(F.col("p") == v.TYPE).select(F.col("s").alias("uri")).distinct().where(~terms.is_builtin(F.col("uri")))
    return there.join(typed(g, [*v.CLASS_TYPES, *v.PROPERTY_TYPES, v.ONTOLOGY]), "uri", "left_anti")


def named_individuals(g: DataFrame) -> DataFrame:
    """The same, IRIs only."""
    there = g.where((F.col("p") == v.TYPE) & (F.col("s_kind") == "iri")).select(F.col("s").alias("uri")).distinct()
    return there.join(typed(g, [*v.CLASS_TYPES, *v.PROPERTY_TYPES, v.ONTOLOGY]), "uri", "left_anti")


def untyped_individuals(g: DataFrame) -> DataFrame:
    """All subjects that are neither classes nor properties: what the selector ``individuals`` means."""
    return g.select(F.col("s").alias("uri")).distinct().join(typed(g, v.CLASS_TYPES + v.PROPERTY_TYPES), "uri", "left_anti")


SELECTORS = {"classes": v.CLASS_TYPES, "obj_props": [v.OBJECT_PROPERTY], "data_props": [v.DATATYPE_PROPERTY], "ann_props": [v.ANNOTATION_PROPERTY]}


def select_subjects(g: DataFrame, key: str) -> DataFrame:
    """Subjects by the name of a selector."""
    if key == "individuals":
        return untyped_individuals(g)
    if key not in SELECTORS:
        raise ValueError(f"unknown selector {key!r}; known: {sorted(SELECTORS)} and individuals")
    return typed(g, SELECTORS[key])


def subject_kind(g: DataFrame) -> DataFrame:
    """``uri, kind``: class before property before individual, in one grouping."""
    has = lambda types: F.max(F.when((F.col("p") == v.TYPE) & F.col("o").isin(types), 1).otherwise(0)) == 1
    return g.groupBy(F.col("s").alias("uri")).agg(F.when(has(v.CLASS_TYPES), "class").when(has(v.PROPERTY_TYPES), "property").otherwise("individual").alias("kind"))


#: Entity types by precedence.
RANKED = [
    (v.ONTOLOGY, "ontology"), (v.OWL_CLASS, "class"), (v.RDFS_CLASS, "class"), (v.OBJECT_PROPERTY, "object_property"), (v.DATATYPE_PROPERTY, "datatype_property"),
    (v.ANNOTATION_PROPERTY, "annotation_property"), (v.RDF_PROPERTY, "object_property"),
]


def type_rank() -> Column:
    """The place of a type triple's object in the precedence; individuals after them, untyped subjects last."""
    out = F.when(F.col("p") != v.TYPE, len(RANKED) + 1)
    for k, (iri, _) in enumerate(RANKED):
        out = out.when(F.col("o") == iri, k)
    return out.otherwise(len(RANKED))


def rank_name(rank: Column) -> Column:
    out = F.when(rank == len(RANKED), "individual").when(rank > len(RANKED), "other")
    for k, (_, name) in enumerate(RANKED):
        out = out.when(rank == k, name)
    return out


def entity_type(g: DataFrame) -> DataFrame:
    """``uri, entity_type`` of every subject by precedence."""
    return g.groupBy(F.col("s").alias("uri")).agg(F.min(type_rank()).alias("rank")).select("uri", rank_name(F.col("rank")).alias("entity_type"))


def referenced(g: DataFrame) -> DataFrame:
    """IRIs in any position, read in one pass."""
    parts = F.array(F.when(F.col("s_kind") == "iri", F.col("s")), F.col("p"), F.when(F.col("o_kind") == "iri", F.col("o")))
    return g.select(F.explode(parts).alias("uri")).where("uri IS NOT NULL").distinct()


def section(g: DataFrame, subjects: DataFrame) -> DataFrame:
    """All triples of the given subjects ``uri``."""
    return g.join(subjects, g.s == subjects.uri, "left_semi")


def used_namespaces(g: DataFrame, prefixes: dict[str, str]) -> DataFrame:
    """``prefix`` of each bound namespace that is the longest match of some term or datatype."""
    parts = F.array(F.when(F.col("s_kind") == "iri", F.col("s")), F.col("p"), F.when(F.col("o_kind") == "iri", F.col("o")), F.when(F.col("o_dt") != "", F.col("o_dt")))
    q = terms.qname(F.col("iri"), prefixes)
    each = g.select(F.explode(parts).alias("iri")).where("iri IS NOT NULL").select(q.alias("q")).where(~F.col("q").startswith("<"))
    return each.select(F.split_part("q", F.lit(":"), F.lit(1)).alias("prefix")).distinct()


def inline_bnodes(g: DataFrame) -> DataFrame:
    """Blank nodes that are the object of one triple: a writer can nest them."""
    return g.where("o_kind = 'bnode'").groupBy(F.col("o").alias("bnode")).agg(F.count("*").alias("n")).where("n = 1").select("bnode").join(
        typed(g, [v.RDF + "Statement"]).withColumnRenamed("uri", "bnode"), "bnode", "left_anti"
    )


def deprecated(g: DataFrame) -> DataFrame:
    """Entities marked deprecated by a true literal or by type."""
    flag = (F.col("p") == v.DEPRECATED) & F.lower("o").isin("true", "1")
    kind = (F.col("p") == v.TYPE) & F.col("o").isin(v.OWL + "DeprecatedClass", v.OWL + "DeprecatedProperty")
    return g.where(flag | kind).select(F.col("s").alias("uri")).distinct()


def select_classes(g: DataFrame, roots: list[str] = (), focus: list[str] = (), selector: str | None = None, descendants: bool = False, max_depth: int | None = None) -> DataFrame:
    """``uri`` of a diagram's classes: given roots before given classes before a selector; with all below them if ``descendants``."""
    from . import closure

    chosen = list(roots or focus)
    if not chosen:
        return select_subjects(g, selector) if selector else typed(g, [])
    start = g.sparkSession.createDataFrame([(x,) for x in chosen], "uri string")
    return closure.descendants(edges(g), start, max_depth).select("uri") if descendants else start.distinct()


#: Kinds of properties by precedence.
PROPERTY_KINDS = [("object", v.OBJECT_PROPERTY), ("datatype", v.DATATYPE_PROPERTY), ("annotation", v.ANNOTATION_PROPERTY)]


def select_properties(g: DataFrame, mode: str, chosen: DataFrame, include: list[str] = (), exclude: list[str] = ()) -> DataFrame:
    """``uri, kind`` of a diagram's properties.

    Modes: ``none``; ``all``; ``explicit`` (those of ``include``); ``domain_based`` (a domain among ``chosen.uri``); ``connected`` (object
    properties with a domain and a range among them, datatype properties with a domain). Those of ``exclude`` go.
    """
    each = [typed(g, [kind]).select("uri", F.lit(name).alias("kind")) for name, kind in PROPERTY_KINDS]
    every = each[0].unionByName(each[1]).unionByName(each[2])
    one = every.groupBy("uri").agg(F.min_by("kind", F.when(F.col("kind") == "object", 0).when(F.col("kind") == "datatype", 1).otherwise(2)).alias("kind"))
    ends = lambda p: g.where(F.col("p") == p).join(chosen.select(F.col("uri").alias("o")), "o", "left_semi").select(F.col("s").alias("uri"))
    if mode == "none":
        found = one.where("false")
    elif mode == "all":
        found = every
    elif mode == "explicit":
        found = one.where(F.col("uri").isin(list(include)))
    elif mode == "domain_based":
        found = one.join(ends(v.DOMAIN), "uri", "left_semi")
    elif mode == "connected":
        near = every.where("kind <> 'annotation'").join(ends(v.DOMAIN), "uri", "left_semi")
        found = near.where("kind = 'datatype'").unionByName(near.where("kind = 'object'").join(ends(v.RANGE), "uri", "left_semi"))
    else:
        raise ValueError(f"unknown mode {mode!r}; known: none, all, explicit, domain_based, connected")
    return found.where(~F.col("uri").isin(list(exclude))) if exclude else found


def explicit_entities(g: DataFrame, names: list[str], prefixes: dict[str, str]) -> DataFrame:
    """``uri, kind`` of entities listed by name; a name with an unbound prefix raises, an entity the graph doesn't type is ``unknown``."""
    given = g.sparkSession.createDataFrame([(x,) for x in names], "name string").select("name", terms.expand(F.col("name"), prefixes).alias("uri"))
    if bad := [r.name for r in given.where("uri IS NULL").collect()]:  # as many as the user listed
        raise ValueError(f"names that can't be expanded: {bad}")
    kinds = {"class": v.CLASS_TYPES, "object": [v.OBJECT_PROPERTY], "datatype": [v.DATATYPE_PROPERTY], "annotation": [v.ANNOTATION_PROPERTY]}
    kind = F.lit(None).cast("string")
    for name, types in reversed(kinds.items()):
        kind = F.when(F.max(F.when((F.col("p") == v.TYPE) & F.col("o").isin(types), 1).otherwise(0)) == 1, name).otherwise(kind)
    own = g.where(F.col("p") == v.TYPE).join(F.broadcast(given.select(F.col("uri").alias("s"))), "s", "left_semi").groupBy(F.col("s").alias("uri")).agg(F.coalesce(kind, F.lit("instance")).alias("kind"))
    return given.select("uri").distinct().join(own, "uri", "left").select("uri", F.coalesce("kind", F.lit("unknown")).alias("kind"))


def named_like(entities: DataFrame, include: list[str] = (), exclude: list[str] = ()) -> DataFrame:
    """Entities whose URI contains one of ``include`` (all if empty) and none of ``exclude``."""
    has = lambda xs: F.exists(F.array(*[F.lit(x) for x in xs]), lambda x: F.contains(F.col("uri"), x))
    out = entities.where(has(include)) if include else entities
    return out.where(~has(exclude)) if exclude else out


def described_individuals(g: DataFrame) -> DataFrame:
    """Individuals as a description counts them: typed subjects, blank nodes too, but for classes, properties, ontologies and OWL's own terms."""
    there = g.where(F.col("p") == v.TYPE).select(F.col("s").alias("uri")).distinct().where(~F.col("uri").isin(v.NO_INDIVIDUALS))
    return there.join(typed(g, [*v.CLASS_TYPES, *v.PROPERTY_TYPES, v.ONTOLOGY]), "uri", "left_anti")
