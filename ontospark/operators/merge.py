"""Merging graphs: union, conflicts, resolution, imports, precedence."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import terms
from ..functions import vocab as v
from ..sources.scratch import written
from . import refactor, select

TERM = select.TERM


def union(*sources: DataFrame) -> DataFrame:
    """All triples of all sources, once."""
    return _together(reduce(DataFrame.unionByName, (s.select(*TERM) for s in sources))).distinct()


def _together(rows: DataFrame) -> DataFrame:
    """Rows dealt by subject, once: groupings by triple and by subject and predicate, and joins on these, start from there."""
    return rows.repartition("s")


def tagged(sources: list[tuple[DataFrame, str, int]]) -> DataFrame:
    """Triples with ``source``, ``priority`` and ``ord`` (place among the sources)."""
    return reduce(DataFrame.unionByName, (g.select(*TERM, F.lit(name).alias("source"), F.lit(priority).alias("priority"), F.lit(k).alias("ord")) for k, (g, name, priority) in enumerate(sources)))


def conflicts(all_: DataFrame, ignore: list[str] | None = None) -> DataFrame:
    """``s, p, conflict_type, n_values, value, value_first, value_last``: subjects and predicates with several objects.

    ``value`` has the highest priority (ties: the earlier source), ``value_first`` and ``value_last`` come from the first
    and last source; among equals the smallest term counts. Values of one source conflict too. The values of a pair are
    reduced before the shuffle, never gathered.
    """
    rows = all_.where("s_kind = 'iri'")
    if ignore:
        rows = rows.where(~F.col("p").isin(ignore))
    term = F.concat_ws("\x1f", "o", "o_kind", "o_dt", "o_lang")
    one = rows.groupBy("s", "p", "o", "o_kind", "o_dt", "o_lang").agg(F.max("priority").alias("priority"), F.min("ord").alias("first"), F.max("ord").alias("last"))
    best = one.groupBy("s", "p").agg(
        F.count("*").alias("n_values"), F.min_by("o", F.struct(-F.col("priority"), "first", term)).alias("value"),
        F.min_by("o", F.struct("first", term)).alias("value_first"), F.min_by("o", F.struct(-F.col("last"), term)).alias("value_last"),
    )
    kind = (
        F.when(F.col("p") == v.TYPE, "type").when(F.col("p").isin(v.SUBCLASS, v.SUBPROPERTY), "hierarchy")
        .when(F.col("p").isin(v.DISJOINT, v.EQUIVALENT_CLASS), "contradiction").otherwise("value")
    )
    return best.where("n_values > 1").select("s", "p", kind.alias("conflict_type"), "n_values", "value", "value_first", "value_last")


def semantic(found: DataFrame) -> DataFrame:
    """Conflicts of hierarchies and contradictions: those a reasoner minds."""
    return found.where(F.col("conflict_type").isin("hierarchy", "contradiction"))


def resolved(all_: DataFrame, found: DataFrame, column: str = "value") -> DataFrame:
    """The merged graph with only the winning object of each conflict."""
    win = found.select("s", "p", F.col(column).alias("winner"))
    rows = all_.select(*TERM).distinct().join(win, ["s", "p"], "left")
    return rows.where("winner IS NULL OR o = winner").select(*TERM)


def without_imports(g: DataFrame) -> DataFrame:
    return g.where(F.col("p") != v.IMPORTS)


def with_imports(g: DataFrame, strategy: str, sources: list[str] = (), head: str | None = None) -> DataFrame:
    """Imports kept (``preserve``, ``update``), dropped (``remove``), or kept with those of ``sources`` added to ``head`` (``merge``)."""
    if strategy == "remove":
        return without_imports(g)
    if strategy not in ("preserve", "update", "merge"):
        raise ValueError(f"unknown strategy {strategy!r}")
    if strategy != "merge" or not sources or head is None:
        return g.select(*TERM)
    added = g.sparkSession.createDataFrame([(head, "iri", v.IMPORTS, x, "iri", "", "") for x in sources], ", ".join(f"{c} string" for c in TERM))
    return union(g, added)


def authoritative(new: DataFrame, existing: DataFrame, predicates: list[str]) -> DataFrame:
    """``new`` over ``existing``: where new has an authoritative predicate of a subject, the existing values go."""
    replaced = new.where(F.col("p").isin(predicates)).select("s", "p").distinct()
    return union(new, existing.join(replaced, ["s", "p"], "left_anti"))


def markers(all_: DataFrame, found: DataFrame, prefixes: dict[str, str], resolved_by: str | None = None) -> DataFrame:
    """``s, p, marker``: a comment block for each conflict that names its values and their sources, for the head of the merged file.

    Without ``resolved_by`` (a column of ``found``) the conflict is marked as unresolved; all its values stay in the merged graph then.
    """
    values = all_.join(found.select("s", "p"), ["s", "p"], "left_semi").where("s_kind = 'iri'").select("s", "p", "source", "priority", "ord", "o").distinct()
    line = F.concat(F.lit("# Source: "), "source", F.lit(" (priority "), F.col("priority").cast("string"), F.lit("): "), "o")
    told = values.groupBy("s", "p").agg(F.array_sort(F.collect_list(F.struct("ord", "o", line.alias("line")))).alias("told"))  # the values of one subject and predicate
    end = F.concat(F.lit("# Resolution: Used "), F.col(resolved_by), F.lit(" (highest priority)")) if resolved_by else F.lit("# Resolution: UNRESOLVED - values differ, manual review required")
    head = F.concat(F.lit("# === CONFLICT: "), terms.qname(F.col("s"), prefixes), F.lit(" "), terms.qname(F.col("p"), prefixes), F.lit(" ==="))
    text = F.concat_ws("\n", head, F.array_join(F.transform("told", lambda x: x["line"]), "\n"), end, F.lit("# === END CONFLICT ==="))
    return told.join(found, ["s", "p"]).select("s", "p", text.alias("marker"))


class Source(NamedTuple):
    """A graph with its name, its priority, and namespaces (old, new) to replace in it, the first that fits."""

    graph: DataFrame
    name: str
    priority: int
    remap: list[tuple[str, str]] = []


class Merged(NamedTuple):
    #: All triples of all sources, imports handled; those of conflicts stay.
    graph: DataFrame
    #: ``s, p, conflict_type, n_values, winner``; no winner where a conflict is only marked.
    conflicts: DataFrame
    #: ``measure, name, n``: triples of each source and of the result, conflicts of each type, resolved and unresolved ones.
    summary: DataFrame


#: The column of ``conflicts`` that wins under each strategy.
STRATEGIES = {"priority": "value", "first": "value_first", "last": "value_last", "mark_all": None}


def run(sources: list[Source], strategy: str = "priority", ignore: list[str] | None = None, imports: str = "preserve", head: str | None = None) -> Merged:
    """A whole merge: namespaces of each source, conflicts and their winners, union, imports, counts.

    Conflicts are found once and written, as the result and its counts both read them. Defined cases: no source, and an unknown strategy, are errors; a source
    without triples counts 0; a triple that several sources have counts in each of them, and once in the result.
    """
    if not sources:
        raise ValueError("no sources to merge")
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}")
    graphs = [refactor.remapped(x.graph, x.remap) if x.remap else x.graph for x in sources]
    all_ = _together(tagged([(g, x.name, x.priority) for g, x in zip(graphs, sources, strict=True)]))
    column = STRATEGIES[strategy]
    found = written(conflicts(all_, ignore).select("s", "p", "conflict_type", "n_values", F.lit(None).cast("string").alias("winner") if column is None else F.col(column).alias("winner")), "conflicts")
    graph = with_imports(union(*graphs), imports, [x.name for x in sources], head)
    spark = all_.sparkSession
    given = spark.createDataFrame([(x.name, k) for k, x in enumerate(sources)], "name string, ord int")
    # repeated rows of a source are one triple; one grouping by triple gives the sizes of the sources and of the result
    held = [f"in_{k}" for k in range(len(sources))]
    each = all_.groupBy(*TERM).agg(*(F.max(F.col("ord") == k).alias(c) for k, c in enumerate(held)))
    alike = written(each.groupBy(*held, (F.col("p") == v.IMPORTS).alias("imports")).agg(F.count("*").alias("n")), "alike")  # a row for each set of sources
    sizes = alike.select(F.explode(F.array(*(F.struct(F.lit(k).alias("ord"), F.when(F.col(c), F.col("n")).alias("n")) for k, c in enumerate(held)))).alias("x")).groupBy("x.ord").agg(F.sum("x.n").alias("n"))
    sizes = F.broadcast(given).join(sizes, "ord", "left").select(F.lit("source").alias("measure"), "name", F.coalesce("n", F.lit(0)).alias("n"))
    if imports == "merge":
        whole = graph.agg(F.count("*").alias("n"))  # with the triples that are added
    else:
        whole = (alike.where("NOT imports") if imports == "remove" else alike).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    whole = whole.select(F.lit("result").alias("measure"), F.lit("triples").alias("name"), "n")
    kinds = found.groupBy("conflict_type").agg(F.count("*").alias("n")).select(F.lit("conflicts").alias("measure"), F.col("conflict_type").alias("name"), "n")
    won = found.agg(F.count("winner").alias("resolved"), (F.count("*") - F.count("winner")).alias("unresolved"))
    won = won.select(F.lit("conflicts").alias("measure"), F.expr("stack(2, 'resolved', resolved, 'unresolved', unresolved) AS (name, n)"))
    return Merged(graph, found, reduce(DataFrame.unionByName, [sizes, kinds, won, whole]))
