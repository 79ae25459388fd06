"""Differences between two versions of a graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import terms
from ..functions import vocab as v
from ..sources.scratch import written
from . import select

TERM = select.TERM


def triples(old: DataFrame, new: DataFrame, ignore: list[str] | None = None) -> DataFrame:
    """Triples of one version only, with ``change`` added or removed: one grouping of both versions, one shuffle."""
    both = old.select(*TERM, F.lit(1).alias("v")).unionByName(new.select(*TERM, F.lit(2).alias("v")))
    if ignore:
        both = both.where(~F.col("p").isin(ignore))
    one = both.groupBy(*TERM).agg(F.min("v").alias("a"), F.max("v").alias("b")).where("a = b")
    return one.select(*TERM, F.when(F.col("a") == 2, "added").otherwise("removed").alias("change"))


def entities(old: DataFrame, new: DataFrame, ignore: list[str] | None = None) -> DataFrame:
    """Changed subjects: ``uri, change_type, entity_type, label, n_added, n_removed``; blank nodes are left out.

    A subject is added or removed if the other version has no triple of it, else modified. Type and label come from the
    new version, or the old one for removed subjects.
    """
    both = reduce(DataFrame.unionByName, (g.select(*TERM, F.lit(k).alias("first"), F.lit(k).alias("last")) for k, g in ((1, old), (2, new))))
    # one exchange, by subject: equal triples meet in their subject's task, which sorts and spills them if they are many, and then its subjects
    return entities_of(both.where("s_kind = 'iri'").repartition("s"), ignore)


def entities_of(both: DataFrame, ignore: list[str] | None = None) -> DataFrame:
    """``entities`` of triples with ``first`` and ``last``, the versions (1 old, 2 new) that a row stands for; a table that lies by subject isn't exchanged."""
    counts = ~F.col("p").isin(list(ignore)) if ignore else F.lit(True)
    one = both.where("s_kind = 'iri'").groupBy(*TERM).agg(F.min("first").alias("a"), F.max("last").alias("b"))
    is_new, is_old = (F.col("a") == 2) & counts, (F.col("b") == 1) & counts
    lit = lambda p, of: F.min(F.when((F.col("p") == p) & of, F.col("o")))
    of_old, of_new = F.col("a") == 1, F.col("b") == 2
    about = lambda of: F.struct(F.min(F.when(of, select.type_rank())).alias("rank"), lit(v.LABEL, of).alias("a"), lit(v.PREF_LABEL, of).alias("b"))
    each = one.groupBy(F.col("s").alias("uri")).agg(
        F.sum(F.when(is_new, 1).otherwise(0)).alias("n_added"), F.sum(F.when(is_old, 1).otherwise(0)).alias("n_removed"), F.min("a").alias("first"), F.max("b").alias("last"),
        about(of_new).alias("now"), about(of_old).alias("then"),
    ).where("n_added + n_removed > 0")
    kind = F.when(F.col("first") == 2, "added").when(F.col("last") == 1, "removed").otherwise("modified")
    x = F.when(F.col("last") == 2, F.col("now")).otherwise(F.col("then"))
    return each.select("uri", kind.alias("change_type"), select.rank_name(x["rank"]).alias("entity_type"), F.coalesce(x["a"], x["b"], terms.local_name(F.col("uri"))).alias("label"), "n_added", "n_removed")


def filtered(changed: DataFrame, show: list[str] | None = None, hide: list[str] | None = None, kinds: list[str] | None = None) -> DataFrame:
    """Changes by type of change and of entity; ``properties`` stands for all kinds of them."""
    if show:
        changed = changed.where(F.col("change_type").isin(show))
    if hide:
        changed = changed.where(~F.col("change_type").isin(hide))
    if kinds:
        wide = [x for k in kinds for x in (["object_property", "datatype_property", "annotation_property"] if k == "properties" else [k])]
        changed = changed.where(F.col("entity_type").isin(wide))
    return changed


def summary(changed: DataFrame) -> DataFrame:
    return changed.groupBy("change_type", "entity_type").agg(F.count("*").alias("n"))


def categories(old: DataFrame, new: DataFrame) -> DataFrame:
    """Changed triples by what their predicate is about."""
    return triples(old, new).groupBy("change", terms.category(F.col("p")).alias("category")).agg(F.count("*").alias("n"))


def superclasses(g: DataFrame) -> DataFrame:
    """``uri, supers``: named superclasses, sorted and joined."""
    return select.edges(g).groupBy(F.col("src").alias("uri")).agg(F.array_join(F.array_sort(F.collect_set("dst")), " ").alias("supers"))


def changes(old: DataFrame, new: DataFrame, ignore: list[str] | None = None) -> DataFrame:
    """``uri, added, removed``: what changed of each subject, its statements as sorted lines. A subject's changes are one value."""
    line = F.concat_ws(" ", "p", "o")
    of = lambda x: F.array_join(F.array_sort(F.collect_list(F.when(F.col("change") == x, line))), "\n").alias(x)
    return triples(old, new, ignore).where("s_kind = 'iri'").groupBy(F.col("s").alias("uri")).agg(of("added"), of("removed"))


def listed(found: DataFrame) -> DataFrame:
    """``entities`` with ``place``: by label, else URI, for a report."""
    from .order import placed

    # written, as the sort reads its input twice
    return placed(written(found, "changed").withColumn("of", F.lit(0)), "of", F.struct(F.coalesce("label", "uri"), "uri")).drop("of")
