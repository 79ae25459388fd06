"""Renaming, deprecation and data migration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import terms
from ..functions import vocab as v
from ..sources.scratch import written
from . import select

TERM = select.TERM
#: Rows of a mapping that are broadcast; larger ones are joined.
FEW = 100_000
#: Places that the rows of one term are dealt to in a join with a larger mapping.
DEALS = 8


def remap(iri: Column, namespaces: list[tuple[str, str]]) -> Column:
    """The first namespace that matches replaced."""
    out = iri
    for old, new in reversed(namespaces):
        out = F.when(iri.startswith(old), F.concat(F.lit(new), F.substr(iri, F.lit(len(old) + 1)))).otherwise(out)
    return out


def remapped(g: DataFrame, namespaces: list[tuple[str, str]], more: list[str] = ()) -> DataFrame:
    """Namespaces replaced in all IRIs; triples that become equal stay several. Columns of ``more`` stay."""
    iri = lambda c, kind: F.when(F.col(kind) == "iri", remap(F.col(c), namespaces)).otherwise(F.col(c))
    return g.select(iri("s", "s_kind").alias("s"), "s_kind", remap(F.col("p"), namespaces).alias("p"), iri("o", "o_kind").alias("o"), "o_kind", "o_dt", "o_lang", *more)


def rename_namespaces(g: DataFrame, namespaces: list[tuple[str, str]]) -> DataFrame:
    """Namespaces replaced in all IRIs: no join, one distinct."""
    return remapped(g, namespaces).distinct()


def mapped(g: DataFrame, mapping: DataFrame, column: str, kind: str | None) -> DataFrame:
    """One column's IRIs replaced by ``old, new``; a mapping of up to ``FEW`` rows is broadcast.

    A larger one is merged, whatever its files' sizes say. Terms that aren't IRIs stay out of the join, and a frequent object is dealt to ``DEALS`` places, where the mapping goes too. Of predicates a graph uses few, and
    of the mapping only those are needed.
    """
    few = mapping.limit(FEW + 1).count() <= FEW
    if column == "p" and not few:
        used = written(g.select(F.col("p").alias("old")).distinct(), "predicates")
        if few := used.limit(FEW + 1).count() <= FEW:
            mapping = written(mapping.join(F.broadcast(used), "old", "left_semi"), "map")
    m = mapping.select(F.col("old").alias("_old"), F.col("new").alias("_new"))
    is_iri = (F.col(kind) == "iri") if kind else F.lit(True)
    renamed = lambda df: df.withColumn(column, F.coalesce("_new", column)).select(*g.columns)
    if few:
        return renamed(g.join(F.broadcast(m), (F.col(column) == F.col("_old")) & is_iri, "left"))
    own = g.where(is_iri)
    if column == "s":
        own = own.join(m.hint("merge"), F.col(column) == F.col("_old"), "left")
    else:
        m = m.withColumn("_of", F.explode(F.sequence(F.lit(0), F.lit(DEALS - 1))))
        own = own.withColumn("_deal", F.pmod(F.xxhash64("s"), F.lit(DEALS)).cast("int"))
        own = own.join(m.hint("merge"), (F.col(column) == F.col("_old")) & (F.col("_deal") == F.col("_of")), "left")
    return renamed(own).unionByName(g.where(~is_iri)) if kind else renamed(own)


def rename_entities(g: DataFrame, mapping: DataFrame, predicates: bool = True) -> DataFrame:
    """IRIs replaced by ``old, new``, in subjects, objects and (unless it is a migration) predicates."""
    g = g.select(*TERM)
    out = mapped(g, mapping, "p", None) if predicates else g
    return mapped(mapped(out, mapping, "s", "s_kind"), mapping, "o", "o_kind").select(*TERM).distinct()


def rename_stats(g: DataFrame, mapping: DataFrame) -> DataFrame:
    """``position, n``: how many subjects, predicates and objects a mapping renames."""
    parts = F.array(
        F.struct(F.lit("subject").alias("position"), F.when(F.col("s_kind") == "iri", F.col("s")).alias("iri")), F.struct(F.lit("predicate").alias("position"), F.col("p").alias("iri")),
        F.struct(F.lit("object").alias("position"), F.when(F.col("o_kind") == "iri", F.col("o")).alias("iri")),
    )
    each = g.select(F.explode(parts).alias("x")).select("x.position", "x.iri").where("iri IS NOT NULL")
    return each.join(mapping, F.col("iri") == F.col("old"), "left_semi").groupBy("position").agg(F.count("*").alias("n"))


def literal_mentions(g: DataFrame, names: list[str]) -> DataFrame:
    """``name, n``: literals that mention a local name; names are few and given by the user."""
    found = F.filter(F.array(*[F.lit(n) for n in names]), lambda n: F.contains(F.col("o"), n))
    return g.where("o_kind = 'literal'").select(F.explode(found).alias("name")).groupBy("name").agg(F.count("*").alias("n"))


def deprecate(g: DataFrame, specs: DataFrame) -> DataFrame:
    """``entity, replaced_by, message, version``: marks entities that exist; earlier marks, replacements and messages go.

    The comment that is replaced begins with ``DEPRECATED``.
    """
    known = specs.join(g.select(F.col("s").alias("entity")).distinct(), "entity", "left_semi")
    old = F.col("p").isin(v.DEPRECATED, v.REPLACED_BY) | ((F.col("p") == v.COMMENT) & F.col("o").startswith("DEPRECATED"))
    rest = g.select(*TERM, old.alias("old")).join(known.select(F.col("entity").alias("s"), F.lit(1).alias("hit")), "s", "left").where("NOT (old AND hit IS NOT NULL)")
    text = F.concat(F.lit("DEPRECATED"), F.when(F.col("version").isNotNull(), F.concat(F.lit(" in "), "version")).otherwise(""), F.lit(": "), F.coalesce("message", F.lit("do not use")))
    row = lambda p, o, kind, dt="", lang="": F.struct(F.lit(p).alias("p"), o.alias("o"), F.lit(kind).alias("o_kind"), F.lit(dt).alias("o_dt"), F.lit(lang).alias("o_lang"))
    marks = F.array(row(v.DEPRECATED, F.lit("true"), "literal", v.XSD + "boolean"), row(v.REPLACED_BY, F.col("replaced_by"), "iri"), row(v.COMMENT, text, "literal", lang="en"))
    new = known.select(F.col("entity").alias("s"), F.lit("iri").alias("s_kind"), F.explode(marks).alias("x")).select("s", "s_kind", "x.*").where("o IS NOT NULL")
    return rest.select(*TERM).unionByName(new.select(*TERM)).distinct()


def strbefore(text: Column, mark: str) -> Column:
    """What stands before the mark; null without it."""
    return F.when(text.contains(mark), F.split_part(text, F.lit(mark), F.lit(1)))


def strafter(text: Column, mark: str) -> Column:
    return F.when(text.contains(mark), F.substr(text, F.locate(mark, text) + len(mark)))


def transform(g: DataFrame, predicate: str, makes: list[tuple[str, Column, str]], delete: bool = True) -> DataFrame:
    """A rule on one pattern: each match gives triples (predicate, object column, datatype); the matches go if ``delete``.

    Objects that come out null make no triple.
    """
    hit = g.where(F.col("p") == predicate)
    made = F.array(*[F.struct(F.lit(p).alias("p2"), o.cast("string").alias("o2"), F.lit(dt).alias("dt2")) for p, o, dt in makes])
    new = hit.select("s", "s_kind", F.explode(made).alias("x")).where("x.o2 IS NOT NULL").select(
        "s", "s_kind", F.col("x.p2").alias("p"), F.col("x.o2").alias("o"), F.lit("literal").alias("o_kind"), F.col("x.dt2").alias("o_dt"), F.lit("").alias("o_lang")
    )
    rest = g.where(F.col("p") != predicate) if delete else g
    return rest.select(*TERM).unionByName(new).distinct()


def scaled(text: Column, minus: str, times: str, over: str = "1") -> Column:
    """``((?v - minus) * times / over)`` as a decimal."""
    number = text.cast("decimal(18,2)") - F.lit(minus).cast("decimal(10,2)")
    return (number * F.lit(times).cast("decimal(10,2)") / F.lit(over).cast("decimal(10,2)")).cast("decimal(18,2)")


def namespaces_of(g: DataFrame) -> DataFrame:
    """``ns, n`` of the subjects."""
    return g.where("s_kind = 'iri'").groupBy(terms.namespace(F.col("s")).alias("ns")).agg(F.count_distinct("s").alias("n"))


def rename_stats_by_source(all_: DataFrame, mapping: DataFrame) -> DataFrame:
    """``source, position, n`` for triples with a ``source``."""
    parts = F.array(
        F.struct(F.lit("subject").alias("position"), F.when(F.col("s_kind") == "iri", F.col("s")).alias("iri")), F.struct(F.lit("predicate").alias("position"), F.col("p").alias("iri")),
        F.struct(F.lit("object").alias("position"), F.when(F.col("o_kind") == "iri", F.col("o")).alias("iri")),
    )
    each = all_.select("source", F.explode(parts).alias("x")).select("source", "x.*").where("iri IS NOT NULL")
    return each.join(mapping, F.col("iri") == F.col("old"), "left_semi").groupBy("source", "position").agg(F.count("*").alias("n"))


def transform_counts(g: DataFrame, predicate: str, makes: list[tuple[str, Column, str]]) -> DataFrame:
    """One row: how many triples a rule matches and how many it makes."""
    made = F.size(F.filter(F.array(*[o.cast("string") for _, o, _ in makes]), lambda x: x.isNotNull()))
    return g.where(F.col("p") == predicate).agg(F.count("*").alias("matched"), F.coalesce(F.sum(made), F.lit(0)).alias("made"))
