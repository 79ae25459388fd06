"""Descriptions: namespaces, profiles, metadata, coverage, hierarchy."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import terms
from ..functions import vocab as v
from ..sources.scratch import written
from . import closure, order, select, stats


def namespace_usage(g: DataFrame) -> DataFrame:
    """``ns, n``: how many positions of all triples use a namespace."""
    parts = F.array(F.when(F.col("s_kind") == "iri", F.col("s")), F.col("p"), F.when(F.col("o_kind") == "iri", F.col("o")))
    return g.select(F.explode(parts).alias("iri")).where("iri IS NOT NULL").groupBy(terms.namespace(F.col("iri")).alias("ns")).agg(F.count("*").alias("n"))


def local_namespace(g: DataFrame) -> DataFrame:
    """The namespace of most classes; ties: the smallest."""
    c = select.classes(g, True).groupBy(terms.namespace(F.col("uri")).alias("ns")).agg(F.count("*").alias("n"))
    return c.agg(F.min_by("ns", F.struct(-F.col("n"), "ns")).alias("ns"))


def namespace_categories(g: DataFrame) -> DataFrame:
    """``ns, n, category``: local, imported or external."""
    imported = g.where((F.col("p") == v.IMPORTS)).select(F.when(F.col("o").rlike("[#/]$"), F.col("o")).otherwise(F.concat("o", F.lit("#"))).alias("ns")).distinct().withColumn("imp", F.lit(1))
    mine = local_namespace(g).withColumn("own", F.lit(1)).where("ns IS NOT NULL")  # one row
    return namespace_usage(g).join(F.broadcast(mine), "ns", "left").join(imported, "ns", "left").select("ns", "n", F.when(F.col("own") == 1, "local").when(F.col("imp") == 1, "imported").otherwise("external").alias("category"))


def construct_counts(g: DataFrame) -> DataFrame:
    """``construct, n``: expressive, basic and characteristic constructs that occur, in one grouping."""
    by_type = [*v.EXPRESSIVE_TYPES, *v.BASIC_TYPES, *v.CHARACTERISTICS]
    by_predicate = [*v.EXPRESSIVE_PREDICATES, v.INVERSE_OF, v.SUBCLASS, v.SUBPROPERTY, v.DOMAIN, v.RANGE]
    key = F.when((F.col("p") == v.TYPE) & F.col("o").isin(by_type), F.col("o")).when(F.col("p").isin(by_predicate), F.col("p"))
    return g.select(key.alias("construct")).where("construct IS NOT NULL").groupBy("construct").agg(F.count("*").alias("n"))


def full_issues(g: DataFrame) -> DataFrame:
    """What only OWL Full allows: classes that are instances of classes, and classes equal to their own complement."""
    c = select.classes(g)
    kinds = g.where((F.col("p") == v.TYPE) & ~F.col("o").isin(*v.CLASS_TYPES, v.NAMED_INDIVIDUAL)).select(F.col("s").alias("uri"), "o")
    meta = kinds.join(c, "uri", "left_semi").join(c.select(F.col("uri").alias("o")), "o", "left_semi").select("uri", F.lit("metaclass").alias("issue"))
    eq = g.where(F.col("p").isin(v.EQUIVALENT_CLASS, v.SUBCLASS)).select(F.col("s").alias("uri"), F.col("o").alias("mid"))
    comp = g.where(F.col("p") == v.COMPLEMENT).select(F.col("s").alias("mid"), F.col("o").alias("back"))
    odd = eq.join(comp, "mid").where("uri = back").select("uri", F.lit("contradiction").alias("issue"))
    return meta.unionByName(odd).distinct()


def profile(g: DataFrame) -> DataFrame:
    """The least profile that covers the graph, with the counts that decide."""
    inside = lambda names: stats.counted(F.col("construct").isin(names))
    one = construct_counts(g).agg(
        inside([*v.EXPRESSIVE_TYPES, *v.EXPRESSIVE_PREDICATES]).alias("expressive"), inside([*v.BASIC_TYPES, *v.CHARACTERISTICS, v.INVERSE_OF]).alias("basic"),
        inside([v.SUBCLASS, v.SUBPROPERTY, v.DOMAIN, v.RANGE]).alias("rdfs"),
    )
    full = full_issues(g).agg(F.count("*").alias("full"))
    name = F.when(F.col("full") > 0, "owl_full").when(F.col("expressive") > 0, "owl_dl_expressive").when(F.col("basic") > 0, "owl_dl_simple").when(F.col("rdfs") > 0, "rdfs").otherwise("rdf")
    return one.join(F.broadcast(full)).select(name.alias("profile"), "full", "expressive", "basic", "rdfs")


def coverage(g: DataFrame) -> DataFrame:
    """``kind, total, labelled, documented``; shares are the formatter's, 100 % where nothing is to cover."""
    kinds = {"label": F.col("p").isin(v.LABELS), "doc": F.col("p").isin(v.DEFINITIONS)}
    out = None
    for name, e in (("class", select.classes(g, True)), ("property", select.properties(g, True))):
        one = stats.flags(g, e, kinds).agg(F.count("*").alias("total"), stats.counted(F.col("label")).alias("labelled"), stats.counted(F.col("doc")).alias("documented")).select(F.lit(name).alias("kind"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def hierarchy_depths(g: DataFrame) -> DataFrame:
    """``uri, depth``: levels below the classes without a named parent that isn't a top class; members of closed cycles have none."""
    c = select.classes(g, True)
    e = select.edges(g).where(~F.col("dst").isin(v.TOP_CLASSES)).join(c.select(F.col("uri").alias("src")), "src", "left_semi").join(c.select(F.col("uri").alias("dst")), "dst", "left_semi")
    roots = c.join(select.edges(g).where(~F.col("dst").isin(v.TOP_CLASSES)).select(F.col("src").alias("uri")), "uri", "left_anti")
    return closure.descendants(e, roots)


def top_roots(g: DataFrame, n: int = 10) -> DataFrame:
    """The first roots by URI: what a description shows before "and more"."""
    c = select.classes(g, True)
    return c.join(select.edges(g).select(F.col("src").alias("uri")), "uri", "left_anti").orderBy("uri").limit(n)


def best_literal(predicates: list[str], lang: str = "en") -> Column:
    """In a grouping by subject: the literal of the best predicate in the language or untagged, else of any language."""
    rank = F.when(F.col("p") == predicates[0], 0)
    for k, p in enumerate(predicates[1:], 1):
        rank = rank.when(F.col("p") == p, k)
    other = F.when(F.col("o_lang").isin(lang, ""), 0).otherwise(1)
    return F.min_by(F.when(rank.isNotNull() & (F.col("o_kind") == "literal"), F.col("o")), F.when(rank.isNotNull() & (F.col("o_kind") == "literal"), F.struct(other, rank, F.col("o"))))


def labels(g: DataFrame, lang: str = "en") -> DataFrame:
    """``uri, label, definition`` of all subjects that have either."""
    use = [*v.LABELS, *v.DEFINITIONS]
    return g.where(F.col("p").isin(use)).groupBy(F.col("s").alias("uri")).agg(best_literal(v.LABELS, lang).alias("label"), best_literal(v.DEFINITIONS, lang).alias("definition"))


def metadata(g: DataFrame) -> DataFrame:
    """The ontology header: URI (the smallest), title, description, version, number of imports, license, its label or else the rights, creators.

    Each text comes from the first predicate of its list that has any, English before others. Creators and licenses that are named by IRI have
    their labels, creators without one their local names.
    """
    head = select.typed(g, [v.ONTOLOGY], True).agg(F.min("uri").alias("uri"))
    own = written(g.join(F.broadcast(head), g.s == F.col("uri")), "header")
    named = own.where(F.col("p").isin(v.DCTERMS + "creator", v.DC + "creator", v.DCTERMS + "license", v.CC + "license") & (F.col("o_kind") == "iri")).select(F.col("o").alias("s")).distinct()
    names = g.where(F.col("p") == v.LABEL).join(named, "s", "left_semi").groupBy(F.col("s").alias("o")).agg(_told([v.LABEL]).alias("name"))
    rows = own.join(names, "o", "left")
    first = lambda *ps: F.coalesce(*(F.min(F.when(F.col("p") == p, F.col("o"))) for p in ps))
    creator = F.when(F.col("p").isin(v.DCTERMS + "creator", v.DC + "creator"), F.when(F.col("o_kind") == "literal", F.col("o")).when(F.col("o_kind") == "iri", F.coalesce("name", terms.local_name(F.col("o")))))
    license_, rights = first(v.DCTERMS + "license", v.CC + "license"), _told([v.DCTERMS + "rights", v.DC + "rights"])
    return rows.groupBy("uri").agg(
        _told([v.LABEL, v.DCTERMS + "title", v.DC + "title"]).alias("title"), _told([v.COMMENT, v.DCTERMS + "description", v.DC + "description"]).alias("description"),
        F.min(F.when(F.col("p") == v.VERSION_INFO, F.col("o"))).alias("version"), stats.counted(F.col("p") == v.IMPORTS).alias("n_imports"), license_.alias("license"),
        F.coalesce(F.min(F.when(F.col("p").isin(v.DCTERMS + "license", v.CC + "license"), F.col("name"))), F.when(license_.isNull(), rights)).alias("license_label"),
        F.array_join(F.array_sort(F.collect_set(creator)), ", ").alias("creators"),
    )


def _told(predicates: list[str]) -> Column:
    """In a grouping by subject: a literal of the first predicate that has one; English ones before others, then the smallest."""
    each = []
    for p in predicates:
        there = (F.col("p") == p) & (F.col("o_kind") == "literal")
        each.append(F.min_by(F.when(there, F.col("o")), F.when(there, F.struct((F.col("o_lang") != "en").alias("other"), "o"))))
    return F.coalesce(*each)


def metrics(g: DataFrame) -> DataFrame:
    """``metric, n``: what a description counts, plain RDF properties (typed as no OWL property) among them."""
    has = lambda *types: F.max(F.when(F.col("o").isin(*types), 1).otherwise(0))
    owl = [v.OBJECT_PROPERTY, v.DATATYPE_PROPERTY, v.ANNOTATION_PROPERTY]
    kinds = {"classes": v.CLASS_TYPES, "object_properties": owl[:1], "datatype_properties": owl[1:2], "annotation_properties": owl[2:], "rdf": [v.RDF_PROPERTY], "owl": owl}
    per = g.where((F.col("p") == v.TYPE) & F.col("o").isin([*v.CLASS_TYPES, *v.PROPERTY_TYPES])).groupBy("s").agg(*(has(*t).alias(n) for n, t in kinds.items()))
    one = per.agg(*(stats.counted(F.col(n) == 1).alias(n) for n in list(kinds)[:4]), stats.counted((F.col("rdf") == 1) & (F.col("owl") == 0)).alias("rdf_properties"))
    both = one.join(F.broadcast(g.agg(F.count("*").alias("total_triples")))).join(F.broadcast(select.described_individuals(g).agg(F.count("*").alias("individuals"))))  # one row each
    names = ["total_triples", "classes", "object_properties", "datatype_properties", "annotation_properties", "rdf_properties", "individuals"]
    return both.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("n")) for n in names])).alias("x")).select("x.*")


def profile_texts(found: DataFrame) -> DataFrame:
    """Adds ``display`` and ``guidance`` to the row of ``profile``."""
    text = lambda k: F.element_at(F.create_map(*[F.lit(x) for n, t in v.PROFILE_TEXTS.items() for x in (n, t[k])]), F.col("profile"))
    return found.withColumn("display", text(0)).withColumn("guidance", text(1))


def hierarchy_summary(g: DataFrame) -> DataFrame:
    """One row: classes, roots, orphans (neither parents nor children among the classes), deepest level, members of cycles."""
    c = select.classes(g, True)
    up = select.edges(g).where(~F.col("dst").isin(v.TOP_CLASSES))
    inside = up.join(c.select(F.col("uri").alias("src")), "src", "left_semi").join(c.select(F.col("uri").alias("dst")), "dst", "left_semi")
    roots = c.join(up.select(F.col("src").alias("uri")), "uri", "left_anti")
    orphans = roots.join(inside.select(F.col("dst").alias("uri")), "uri", "left_anti")
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
    deepest = hierarchy_depths(g).agg(F.coalesce(F.max("depth"), F.lit(0)).cast("long").alias("n")).select(F.lit("max_depth").alias("name"), "n")
    parts = [count(c, "classes"), count(roots, "roots"), count(orphans, "orphans"), deepest, count(closure.cycle_members(inside), "in_cycles")]
    names = ["classes", "roots", "orphans", "max_depth", "in_cycles"]
    return reduce(DataFrame.unionByName, parts).agg(*(F.max(F.when(F.col("name") == x, F.col("n"))).alias(x) for x in names))


def unimported(g: DataFrame) -> DataFrame:
    """``ns, n`` of outside namespaces that are neither imported nor the vocabularies' own."""
    return namespace_categories(g).where((F.col("category") == "external") & ~F.col("ns").isin(v.BUILTIN) & (F.col("ns") != "")).select("ns", "n")


def class_tree(g: DataFrame, prefixes: dict[str, str]) -> DataFrame:
    """``parent, child, place``: children of each class in the order of their names; roots are children of nothing."""
    c = select.classes(g, True)
    inside = select.edges(g).join(c.select(F.col("uri").alias("src")), "src", "left_semi").join(c.select(F.col("uri").alias("dst")), "dst", "left_semi").distinct()
    roots = c.join(inside.select(F.col("src").alias("uri")), "uri", "left_anti")
    all_ = inside.select(F.col("dst").alias("parent"), F.col("src").alias("child")).unionByName(roots.select(F.lit("").alias("parent"), F.col("uri").alias("child")))
    return order.placed(all_, "parent", terms.qname(F.col("child"), prefixes)).select("parent", "child", "place")


def verdict(g: DataFrame) -> DataFrame:
    """One row ``verdict``: the profile, the sizes and the number of imports in a line. Sizes of nothing are left out, but not that of the triples."""
    n = lambda *names: F.coalesce(F.sum(F.when(F.col("metric").isin(*names), F.col("n"))), F.lit(0))
    kinds = ["object_properties", "datatype_properties", "annotation_properties", "rdf_properties"]
    sizes = metrics(g).agg(n("total_triples").alias("triples"), n("classes").alias("classes"), n(*kinds).alias("properties"), n("individuals").alias("individuals"))
    brought = g.where(F.col("p") == v.IMPORTS).agg(F.count_distinct("o").alias("imports"))
    some = lambda name: F.when(F.col(name) > 0, F.concat(F.col(name).cast("string"), F.lit(f" {name}")))
    line = F.concat_ws(", ", F.concat(F.col("triples").cast("string"), F.lit(" triples")), some("classes"), some("properties"), some("individuals"))
    one = profile_texts(profile(g)).join(F.broadcast(sizes)).join(F.broadcast(brought))  # one row each
    return one.select(F.concat_ws(" | ", "display", line, some("imports")).alias("verdict"))


def describe(g: DataFrame, brief: bool = False) -> dict[str, DataFrame]:
    """The parts of a description by name; ``brief`` has the header, the sizes, the profile and the verdict alone, and nothing else is planned."""
    parts = {"metadata": metadata(g), "metrics": metrics(g), "profile": profile_texts(profile(g)), "verdict": verdict(g)}
    if brief:
        return parts
    imported = g.where(F.col("p") == v.IMPORTS).select(F.col("o").alias("uri")).distinct()
    return parts | {"namespaces": namespace_categories(g), "imports": imported, "unimported": unimported(g), "hierarchy": hierarchy_summary(g), "roots": top_roots(g), "documentation": coverage(g)}
