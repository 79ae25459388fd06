"""Translations: extraction, coverage, merging."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vocab as v
from . import select

TERM = select.TERM
TEXTS = [v.LABEL, v.COMMENT, v.PREF_LABEL, v.DEFINITION]
#: Types whose entities are translated; the first that an entity has is its type.
KINDS = [v.OWL_CLASS, v.RDFS_CLASS, v.OBJECT_PROPERTY, v.DATATYPE_PROPERTY, v.ANNOTATION_PROPERTY, v.NAMED_INDIVIDUAL]
#: From worst to best.
STATUSES = ["pending", "needs_review", "translated", "approved"]


def in_language(lang: str, source: str):
    """Literals of a language; those without one are in the source language."""
    return (F.col("o_kind") == "literal") & ((F.col("o_lang") == lang) | ((F.col("o_lang") == "") & F.lit(lang == source)))


def entities(g: DataFrame, deprecated: bool = True) -> DataFrame:
    """``uri, type``."""
    rank = F.when(F.col("o") == KINDS[0], 0)
    for k, kind in enumerate(KINDS[1:], 1):
        rank = rank.when(F.col("o") == kind, k)
    found = g.where((F.col("p") == v.TYPE) & (F.col("s_kind") == "iri") & F.col("o").isin(KINDS)).groupBy(F.col("s").alias("uri")).agg(F.min_by("o", rank).alias("type"))
    return found if deprecated else found.join(select.deprecated(g), "uri", "left_anti")


def extract(g: DataFrame, source: str, target: str, missing_only: bool = False, deprecated: bool = True) -> DataFrame:
    """``uri, type, property, source, translation, status`` of each text in the source language."""
    rows = g.where(F.col("p").isin(TEXTS))
    texts = rows.where(in_language(source, source)).select(F.col("s").alias("uri"), F.col("p").alias("property"), F.col("o").alias("source"))
    there = rows.where(in_language(target, source)).groupBy(F.col("s").alias("uri"), F.col("p").alias("property")).agg(F.min("o").alias("translation"))
    out = texts.join(entities(g, deprecated), "uri").join(there, ["uri", "property"], "left_anti" if missing_only else "left")
    done = F.lit(None).cast("string") if missing_only else F.col("translation")
    return out.select("uri", "type", "property", "source", F.coalesce(done, F.lit("")).alias("translation"), F.when(done.isNull(), "pending").otherwise("translated").alias("status"))


def by_status(found: DataFrame) -> DataFrame:
    return found.groupBy("status").agg(F.count("*").alias("n"))


def coverage(g: DataFrame, source: str, languages: list[str]) -> DataFrame:
    """``language, property, total, translated``: pairs of entity and property with a source text, and with one of the language."""
    rows = g.where(F.col("p").isin(TEXTS)).join(entities(g).select(F.col("uri").alias("s")), "s", "left_semi")
    each = rows.groupBy("s", "p").agg(F.max(in_language(source, source).cast("int")).alias("src"), *(F.max(in_language(x, source).cast("int")).alias(f"l_{x}") for x in languages))
    total = each.groupBy(F.col("p").alias("property")).agg(F.sum("src").alias("total"), *(F.sum(f"l_{x}").alias(f"l_{x}") for x in languages))
    lang = F.explode(F.array(*[F.struct(F.lit(x).alias("language"), F.col(f"l_{x}").alias("translated")) for x in languages])).alias("x")
    return total.select("property", "total", lang).select("x.language", "property", "total", "x.translated")


def missing(g: DataFrame, source: str, target: str) -> DataFrame:
    """``uri`` of the entities with some source text and no text in the target language."""
    rows = g.where(F.col("p").isin(TEXTS)).join(entities(g).select(F.col("uri").alias("s")), "s", "left_semi")
    each = rows.groupBy("s").agg(F.max(in_language(source, source).cast("int")).alias("a"), F.max(in_language(target, source).cast("int")).alias("b"))
    return each.where("a = 1 AND b = 0").select(F.col("s").alias("uri"))


def merge(g: DataFrame, translations: DataFrame, lang: str, least: str = "translated", overwrite: bool = False) -> DataFrame:
    """The graph with ``uri, property, translation, status`` of at least a status; existing texts stay unless overwritten."""
    good = translations.where(F.col("status").isin(STATUSES[STATUSES.index(least) :]) & (F.col("translation") != ""))
    there = g.where((F.col("o_kind") == "literal") & (F.col("o_lang") == lang)).select("s", "p").distinct()
    new = good.select(F.col("uri").alias("s"), F.lit("iri").alias("s_kind"), F.col("property").alias("p"), F.col("translation").alias("o"), F.lit("literal").alias("o_kind"), F.lit("").alias("o_dt"), F.lit(lang).alias("o_lang"))
    if not overwrite:
        return g.select(*TERM).unionByName(new.join(there, ["s", "p"], "left_anti").select(*TERM)).distinct()
    gone = new.select("s", "p", F.lit("literal").alias("o_kind"), F.lit(lang).alias("o_lang")).distinct()
    return g.join(gone, ["s", "p", "o_kind", "o_lang"], "left_anti").select(*TERM).unionByName(new).distinct()


def merge_all(g: DataFrame, files: list[tuple[DataFrame, str]], least: str = "translated", overwrite: bool = False) -> DataFrame:
    """Several translation tables with their languages, one after the other."""
    for translations, lang in files:
        g = merge(g, translations, lang, least, overwrite)
    return g


def merge_counts(g: DataFrame, translations: DataFrame, lang: str, least: str = "translated", overwrite: bool = False) -> DataFrame:
    """``outcome, n``: translations that a merge adds, that replace others, that are there already, that are empty, and that lack the status."""
    there = g.where((F.col("o_kind") == "literal") & (F.col("o_lang") == lang)).groupBy(F.col("s").alias("uri"), F.col("p").alias("property")).agg(F.lit(1).alias("there"))
    known = g.select(F.col("s").alias("uri")).distinct().withColumn("known", F.lit(1))
    outcome = (
        F.when(F.coalesce("translation", F.lit("")) == "", "empty").when(~F.col("status").isin(STATUSES[STATUSES.index(least) :]), "status").when(F.col("known").isNull(), "missing entity")
        .when(F.col("there").isNull(), "added").otherwise("updated" if overwrite else "existing")
    )
    return translations.join(there, ["uri", "property"], "left").join(known, "uri", "left").groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))
