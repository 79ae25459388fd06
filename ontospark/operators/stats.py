"""Ontology statistics, in long form: ``category, metric, num, den`` (a ratio is num / den; counts have den 1).

Ratios stay unrounded; whoever shows them rounds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab as v
from ..sources.scratch import written
from . import closure, select


def long_form(df: DataFrame, category: str, names: list[str]) -> DataFrame:
    """One row with ``names`` and, for ratios, ``<name>__den``, as a row for each metric."""
    parts = [F.struct(F.lit(n).alias("metric"), F.col(n).cast("long").alias("num"), (F.col(f"{n}__den") if f"{n}__den" in df.columns else F.lit(1)).cast("long").alias("den")) for n in names]
    return df.select(F.explode(F.array(*parts)).alias("x")).select(F.lit(category).alias("category"), "x.*")


def counted(flag: Column) -> Column:
    return F.coalesce(F.sum(F.when(flag, 1).otherwise(0)), F.lit(0)).cast("long")


def basic(g: DataFrame) -> DataFrame:
    has = lambda *types: F.count_distinct(F.when((F.col("p") == v.TYPE) & F.col("o").isin(*types), F.col("s")))
    one = g.agg(F.count("*").alias("triples"))
    kinds = g.where(F.col("p") == v.TYPE).agg(has(*v.CLASS_TYPES).alias("classes"), has(v.OBJECT_PROPERTY).alias("object_properties"), has(v.DATATYPE_PROPERTY).alias("datatype_properties"), has(v.ANNOTATION_PROPERTY).alias("annotation_properties"))
    who = select.individuals(g).agg(F.count("*").alias("individuals"))
    both = one.join(F.broadcast(kinds)).join(F.broadcast(who))  # one row each
    return long_form(both, "basic", ["triples", "classes", "object_properties", "datatype_properties", "annotation_properties", "individuals"])


def class_edges(g: DataFrame) -> DataFrame:
    """Subclass edges with known classes at both ends."""
    c = select.classes(g)
    e = g.where(F.col("p") == v.SUBCLASS).select(F.col("s").alias("src"), F.col("o").alias("dst"))
    return e.join(c.withColumnRenamed("uri", "src"), "src", "left_semi").join(c.withColumnRenamed("uri", "dst"), "dst", "left_semi").select("src", "dst")


def hierarchy(g: DataFrame) -> DataFrame:
    """Roots (no parent), leaves (no child), orphans (neither), longest depths, branching of parents."""
    c = written(select.classes(g), "classes")
    e = written(class_edges(g), "edges")
    depth = closure.longest_depth(e, c)
    up, down = e.select(F.col("src").alias("uri")).distinct().withColumn("up", F.lit(1)), e.groupBy(F.col("dst").alias("uri")).agg(F.count_distinct("src").alias("children"))
    node = c.join(up, "uri", "left").join(down, "uri", "left").join(depth, "uri", "left")
    no_parent, no_child = F.col("up").isNull(), F.col("children").isNull()
    one = node.agg(
        counted(no_parent).alias("root_classes"), counted(no_child).alias("leaf_classes"), F.coalesce(F.max("depth"), F.lit(0)).alias("max_depth"),
        F.coalesce(F.sum("depth"), F.lit(0)).alias("avg_depth"), F.count("depth").alias("avg_depth__den"),
        F.coalesce(F.sum("children"), F.lit(0)).alias("avg_branching"), F.count("children").alias("avg_branching__den"),
        counted(no_parent & no_child).alias("orphan_classes"), counted(no_parent & no_child).alias("orphan_rate"), F.count("*").alias("orphan_rate__den"),
    )
    return long_form(one, "hierarchy", ["root_classes", "leaf_classes", "max_depth", "avg_depth", "avg_branching", "orphan_classes", "orphan_rate"])


def flags(g: DataFrame, entities: DataFrame, named: dict[str, Column]) -> DataFrame:
    """Each entity ``uri`` with booleans: does it have a triple of the kind? One grouping of the triples that matter."""
    any_ = reduce(Column.__or__, named.values())
    seen = g.where(any_).groupBy(F.col("s").alias("uri")).agg(*(F.max(F.when(c, 1).otherwise(0)).alias(n) for n, c in named.items()))
    return entities.join(seen, "uri", "left").select("uri", *((F.coalesce(n, F.lit(0)) == 1).alias(n) for n in named))


def property_stats(g: DataFrame) -> DataFrame:
    p = F.col("p")
    f = flags(g, select.properties(g), {"domain": p == v.DOMAIN, "range": p == v.RANGE})
    one = f.agg(counted(F.col("domain")).alias("with_domain"), counted(F.col("range")).alias("with_range"), F.count("*").alias("n"))
    one = one.select("*", F.col("with_domain").alias("domain_coverage"), F.col("n").alias("domain_coverage__den"), F.col("with_range").alias("range_coverage"), F.col("n").alias("range_coverage__den"))
    typed = lambda t: F.count_distinct(F.when((p == v.TYPE) & (F.col("o") == t), F.col("s")))
    rest = g.where((p == v.INVERSE_OF) | (p == v.TYPE)).agg(F.count_distinct(F.when(p == v.INVERSE_OF, F.col("s"))).alias("inverse_pairs"), typed(v.FUNCTIONAL).alias("functional"), typed(v.SYMMETRIC).alias("symmetric"))
    return long_form(one.join(F.broadcast(rest)), "properties", ["with_domain", "with_range", "domain_coverage", "range_coverage", "inverse_pairs", "functional", "symmetric"])


def documentation(g: DataFrame) -> DataFrame:
    kinds = {"label": F.col("p").isin(v.LABELS), "doc": F.col("p").isin(v.DEFINITIONS)}
    c = flags(g, select.classes(g), kinds).agg(counted(F.col("label")).alias("classes_labelled"), counted(F.col("doc")).alias("classes_documented"), F.count("*").alias("n"))
    q = flags(g, select.properties(g), {"label": kinds["label"]}).agg(counted(F.col("label")).alias("properties_labelled"), F.count("*").alias("m"))
    one = c.join(F.broadcast(q)).select("*", *(F.col(x).alias(f"{x}_pct") for x in ("classes_labelled", "classes_documented", "properties_labelled")), F.col("n").alias("classes_labelled_pct__den"), F.col("n").alias("classes_documented_pct__den"), F.col("m").alias("properties_labelled_pct__den"))
    return long_form(one, "documentation", ["classes_labelled", "classes_labelled_pct", "classes_documented", "classes_documented_pct", "properties_labelled", "properties_labelled_pct"])


def complexity(g: DataFrame) -> DataFrame:
    c = written(select.classes(g), "classes")
    uses = g.where(F.col("p").isin(v.DOMAIN, v.RANGE)).join(c, F.col("o") == F.col("uri"), "left_semi").agg(F.count("*").alias("refs"))
    supers = g.where((F.col("p") == v.SUBCLASS) & (F.col("o_kind") == "iri")).join(c, F.col("s") == F.col("uri"), "left_semi").groupBy("s").agg(F.count("*").alias("n"))
    up = supers.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("supers"), counted(F.col("n") >= 2).alias("multiple_inheritance_count"))
    axioms = g.where(((F.col("p") == v.TYPE) & (F.col("o") == v.RESTRICTION)) | (F.col("p") == v.EQUIVALENT_CLASS)).agg(F.count_distinct(F.when(F.col("p") == v.TYPE, F.col("s"))).alias("owl_restriction_count"), counted(F.col("p") == v.EQUIVALENT_CLASS).alias("owl_equivalent_count"))
    one = c.agg(F.count("*").alias("n")).join(F.broadcast(uses)).join(F.broadcast(up)).join(F.broadcast(axioms))
    one = one.select("*", F.col("refs").alias("avg_properties_per_class"), F.col("n").alias("avg_properties_per_class__den"), F.col("supers").alias("avg_superclasses_per_class"), F.col("n").alias("avg_superclasses_per_class__den"))
    return long_form(one, "complexity", ["avg_properties_per_class", "avg_superclasses_per_class", "multiple_inheritance_count", "owl_restriction_count", "owl_equivalent_count"])


def references(g: DataFrame) -> DataFrame:
    """``uri, n``: classes by how often domains and ranges name them."""
    c = select.classes(g)
    used = g.where(F.col("p").isin(v.DOMAIN, v.RANGE)).groupBy(F.col("o").alias("uri")).agg(F.count("*").alias("k"))
    return c.join(used, "uri", "left").select("uri", F.coalesce("k", F.lit(0)).alias("n"))


def connectivity(g: DataFrame) -> DataFrame:
    """The most referenced class (ties: the smallest URI) and how many classes no property names."""
    return references(g).agg(F.max(F.struct("n", (F.lit(0)).alias("z"))).alias("m"), counted(F.col("n") == 0).alias("isolated_classes"), F.min_by("uri", F.struct(-F.col("n"), "uri")).alias("most_connected_class")).select(F.when(F.col("m.n") > 0, F.col("most_connected_class")).alias("most_connected_class"), F.col("m.n").alias("most_connected_count"), "isolated_classes")


def connectivity_metrics(g: DataFrame) -> DataFrame:
    return long_form(connectivity(g), "connectivity", ["most_connected_count", "isolated_classes"])


CATEGORIES = {"basic": basic, "hierarchy": hierarchy, "properties": property_stats, "documentation": documentation, "complexity": complexity, "connectivity": connectivity_metrics}


def collect(g: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """The metrics of the wanted categories; plans of others aren't built."""
    unknown = {*(include or []), *(exclude or [])} - set(CATEGORIES)
    if unknown:
        raise ValueError(f"unknown categories {sorted(unknown)}")
    wanted = [f for n, f in CATEGORIES.items() if (not include or n in include) and n not in (exclude or [])]
    return reduce(DataFrame.unionByName, (f(g) for f in wanted))


def compare(old: DataFrame, new: DataFrame) -> DataFrame:
    """Metrics that changed: values, difference, change in percent (null from 0), whether it is an improvement."""
    value = lambda df, n: df.select("category", "metric", F.when(F.col("den") > 0, F.col("num") / F.col("den")).otherwise(F.lit(0.0)).alias(n))
    both = value(old, "old").join(value(new, "new"), ["category", "metric"], "full").na.fill(0.0, ["old", "new"])
    delta = F.col("new") - F.col("old")
    key = F.concat_ws(".", "category", "metric")
    better = F.when(key.isin(v.HIGHER), delta > 0).when(key.isin(v.LOWER), delta < 0)
    return both.where(delta != 0).select("category", "metric", "old", "new", delta.alias("delta"), F.when(F.col("old") != 0, delta / F.col("old") * 100).alias("pct_change"), better.alias("improved"))
