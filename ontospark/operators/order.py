"""Semantic order: subjects by kind and hierarchy level, predicates by list, Turtle lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import terms
from ..functions import vocab as v
from ..sources.scratch import written
from . import closure, select


def predicate_place(p: Column, first: list[str], last: list[str]) -> Column:
    """A sort key: type, the ``first`` list, others, the ``last`` list."""
    out = F.when(p == v.TYPE, F.lit(-1))
    for k, iri in enumerate(first):
        out = out.when(p == iri, k)
    for k, iri in enumerate(last):
        out = out.when(p == iri, 20_000 + k)
    return out.otherwise(10_000)


def lines(g: DataFrame, prefixes: dict[str, str], first: list[str] = (v.SUBCLASS, v.LABEL), last: list[str] = (v.COMMENT,)) -> DataFrame:
    """``subject, ord, line``: each subject's predicates in order with their objects sorted, as Turtle text."""
    objects = F.array_join(F.array_sort(F.collect_set(terms.turtle(F.col("o"), F.col("o_kind"), F.col("o_dt"), F.col("o_lang"), prefixes))), ", ")
    p = F.when(F.col("p") == v.TYPE, "a").otherwise(terms.qname(F.col("p"), prefixes))
    each = g.groupBy("s", "s_kind", "p").agg(objects.alias("objects"))
    # a subject's lines are sorted as one array: both groupings are by subject
    line = F.struct(predicate_place(F.col("p"), list(first), list(last)).alias("place"), p.alias("q"), F.concat(p, F.lit(" "), "objects").alias("line"))
    subject = F.when(F.col("s_kind") == "bnode", F.concat(F.lit("_:"), "s")).otherwise(terms.qname(F.col("s"), prefixes))
    own = each.groupBy("s").agg(F.min(subject).alias("subject"), F.array_sort(F.collect_list(line)).alias("lines"))
    return own.select("subject", F.posexplode("lines").alias("ord", "x")).select("subject", (F.col("ord") + 1).cast("long").alias("ord"), "x.line")


def effective_orders(profile: dict | None, general: dict | None) -> dict | None:
    """The predicate orders that count: a profile's own if any of its lists has an entry, else the general ones if any has, else none.

    Orders give (first, last), lists of IRIs, for ``classes``, ``properties``, ``individuals`` and ``default``.
    """
    for orders in (profile, general):
        if any(first or last for first, last in (orders or {}).values()):
            return orders
    return None


def lines_by_kind(g: DataFrame, prefixes: dict[str, str], orders: dict | None) -> DataFrame:
    """``subject, kind, ord, line``: the lines of ``lines`` with an order of predicates for each kind of subject.

    A subject typed as a class is one, else a property if typed as one, else an individual; a kind without lists of its own has the default's.
    The type comes first in any order, a predicate in both lists counts as one of the first, all others are between by their names.
    """
    objects = F.array_join(F.array_sort(F.collect_set(terms.turtle(F.col("o"), F.col("o_kind"), F.col("o_dt"), F.col("o_lang"), prefixes))), ", ")
    typed = lambda types: F.max((F.col("p") == v.TYPE) & F.col("o").isin(types))
    each = g.groupBy("s", "s_kind", "p").agg(objects.alias("objects"), typed(v.CLASS_TYPES).alias("is_class"), typed(v.PROPERTY_TYPES).alias("is_property"))
    q = F.when(F.col("p") == v.TYPE, "a").otherwise(terms.qname(F.col("p"), prefixes))
    subject = F.when(F.col("s_kind") == "bnode", F.concat(F.lit("_:"), "s")).otherwise(terms.qname(F.col("s"), prefixes))
    kind = F.when(F.max("is_class"), "classes").when(F.max("is_property"), "properties").otherwise("individuals")
    own = each.groupBy("s").agg(F.min(subject).alias("subject"), kind.alias("kind"), F.collect_list(F.struct("p", q.alias("q"), F.concat(q, F.lit(" "), "objects").alias("line"))).alias("lines"))
    lists, nothing = orders or {}, ([], [])

    def place(p: Column) -> Column:
        default = lists.get("default", nothing)
        out = predicate_place(p, *default)
        for name in ("classes", "properties", "individuals"):
            mine = lists.get(name, nothing)
            if mine[0] or mine[1]:
                out = F.when(F.col("kind") == name, predicate_place(p, *mine)).otherwise(out)
        return out

    ordered = F.array_sort(F.transform("lines", lambda x: F.struct(place(x["p"]).alias("place"), x["q"].alias("q"), x["line"].alias("line"))))
    return own.select("subject", "kind", F.posexplode(ordered).alias("ord", "x")).select("subject", "kind", (F.col("ord") + 1).cast("long").alias("ord"), "x.line")


def blocks(g: DataFrame, prefixes: dict[str, str]) -> DataFrame:
    """``subject, block``: a subject's lines as one Turtle statement."""
    each = lines(g, prefixes)
    return each.groupBy("subject").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"]), " ;\n    ").alias("body")).select("subject", F.concat("subject", F.lit(" "), "body", F.lit(" .")).alias("block"))


def header(prefixes: dict[str, str]) -> str:
    return "".join(f"PREFIX {p}: <{ns}>\n" for p, ns in sorted(prefixes.items()))


def placed(df: DataFrame, group: str, key: Column) -> DataFrame:
    """Adds ``place``, counted from 1 in each ``group`` in the order of ``key``.

    All rows are sorted by ranges; a row's place is its number in its range, less that of the group's first row there, and the rows of the
    group in earlier ranges. So no task holds a group, however large.
    """
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows = written(df.withColumn("_key", key).orderBy(group, "_key").select("*", F.spark_partition_id().alias("_part"), at.alias("_at")), "sorted")
    parts = rows.groupBy(group, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a range
    starts = parts.select(group, "_part", "_first", before.alias("_before"))
    return rows.join(starts, [group, "_part"]).withColumn("place", F.col("_at") - F.col("_first") + F.col("_before") + 1).drop("_key", "_part", "_at", "_first", "_before")


def topological(g: DataFrame, chosen: DataFrame, prefixes: dict[str, str]) -> DataFrame:
    """``uri, level, place``: parents before children, by longest path and then qualified name; edges inside cycles don't count.

    ``place`` counts within a level.
    """
    inside = select.edges(g).join(chosen.select(F.col("uri").alias("src")), "src", "left_semi").join(chosen.select(F.col("uri").alias("dst")), "dst", "left_semi")
    level = closure.longest_depth(inside, chosen)
    return placed(level.select("uri", F.col("depth").cast("long").alias("level")), "level", terms.qname(F.col("uri"), prefixes)).select("uri", "level", "place")


def sections(g: DataFrame, names: list[str]) -> DataFrame:
    """``uri, section``: each subject in the first of the named sections that selects it; ``header`` is the ontologies' own."""
    found = None
    for k, n in enumerate(names):
        own = select.typed(g, [v.ONTOLOGY]) if n == "header" else select.select_subjects(g, n)
        one = own.select("uri", F.lit(k).alias("k"), F.lit(n).alias("section"))
        found = one if found is None else found.unionByName(one)
    return found.groupBy("uri").agg(F.min_by("section", "k").alias("section"))


def sort_subjects(g: DataFrame, chosen: DataFrame, mode: str, prefixes: dict[str, str], roots: list[str] = ()) -> DataFrame:
    """``uri, branch, level, place`` of ``chosen.uri``.

    ``topological`` and ``topological_then_alpha``: the branch of each root in the order of ``roots``, then all others, each by level and
    name; without roots one branch. Any other mode: by name alone. Subproperties count instead of subclasses where properties are chosen.
    """
    q = terms.qname(F.col("uri"), prefixes)
    if mode.lower() not in ("topological", "topological_then_alpha"):
        return placed(chosen.select("uri", F.lit(0).alias("branch"), F.lit(0).cast("long").alias("level")), "branch", q).select("uri", "branch", "level", "place")
    props = not select.typed(g, [v.OBJECT_PROPERTY, v.DATATYPE_PROPERTY]).join(chosen, "uri", "left_semi").isEmpty()
    edges = select.edges(g, v.SUBPROPERTY if props else v.SUBCLASS)
    inside = written(edges.join(chosen.select(F.col("uri").alias("src")), "src", "left_semi").join(chosen.select(F.col("uri").alias("dst")), "dst", "left_semi").select("src", "dst"), "inside")
    branch = None
    for k, root in enumerate(roots):
        one = closure.descendants(inside, chosen.where(F.col("uri") == root)).select("uri", F.lit(k).alias("k"))
        branch = one if branch is None else branch.unionByName(one)
    level = closure.longest_depth(inside, chosen).select("uri", F.col("depth").cast("long").alias("level"))
    if branch is None:
        own = level.withColumn("branch", F.lit(0))
    else:
        own = level.join(branch.groupBy("uri").agg(F.min("k").alias("branch")), "uri", "left").select("uri", "level", F.coalesce("branch", F.lit(len(roots))).alias("branch"))
    return placed(own, "branch", F.struct("level", q)).select("uri", "branch", "level", "place")
