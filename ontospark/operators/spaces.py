"""Namespaces in tables: the first or the longest that an IRI begins with, for any number of them.

Prefixes that files declare are tables too. An IRI gives its prefixes of the lengths that occur among the namespaces, a few, and these are joined; so the work grows with IRIs and lengths, not
with IRIs times namespaces.

Defined cases: equal namespaces count as the one that comes first; an IRI that is a namespace begins with it; null and empty namespaces are none; an
IRI without a match has no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import bounded, written
from . import refactor, select


#: Namespaces that are tested one by one in each row.
FEW = 32


def few(spaces: DataFrame) -> list[tuple[str, str]] | None:
    """``ns, value`` of up to ``FEW`` rows of namespaces, the first that counts first; None for more. One without a value stays as it is."""
    rows = _distinct(spaces).limit(FEW + 1).collect()
    if len(rows) > FEW:
        return None
    return [(r.ns, r.ns if r.value is None else r.value) for r in sorted(rows, key=lambda r: (r.place is not None, r.place or 0, r.ns))]


def _distinct(spaces: DataFrame) -> DataFrame:
    return spaces.where("ns <> ''").groupBy("ns").agg(F.min("place").alias("place"), F.min_by("value", F.struct("place", "value")).alias("value"))


def matched(iris: DataFrame, spaces: DataFrame, longest: bool = True) -> DataFrame:
    """``iri, ns, value`` for distinct ``iris.iri``: the longest of ``spaces.ns``, or the one of the smallest ``spaces.place``, that begins it."""
    spaces = _distinct(spaces)
    lengths = sorted(r.n for r in spaces.select(F.length("ns").alias("n")).distinct().collect())  # a number for each length
    if not lengths:
        return iris.select("iri", F.lit("").alias("ns"), F.lit("").alias("value")).where("false")
    fits = F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length("iri"))
    begun = iris.select("iri", F.explode(F.transform(fits, lambda n: F.substr("iri", F.lit(1), n))).alias("ns"))
    met = begun.join(bounded(spaces, refactor.FEW), "ns")
    rank = -F.length("ns") if longest else F.col("place")
    return met.groupBy("iri").agg(F.min_by(F.struct("ns", "value"), F.struct(rank, "ns")).alias("x")).select("iri", "x.ns", "x.value")


def rename(g: DataFrame, spaces: DataFrame, longest: bool = False) -> DataFrame:
    """The graph with namespaces ``ns`` replaced by ``value`` in all its IRIs, the first that matches or the longest."""
    found = matched(select.referenced(g).withColumnRenamed("uri", "iri"), spaces, longest)
    moved = found.select(F.col("iri").alias("old"), F.concat("value", F.substr("iri", F.length("ns") + 1)).alias("new"))
    return refactor.rename_entities(g, written(moved, "map"))


def qnames(iris: DataFrame, prefixes: DataFrame) -> DataFrame:
    """``iri, qname`` of distinct IRIs, by the longest namespace ``ns`` of a prefix ``value``; ``<iri>`` without one."""
    found = matched(iris, prefixes)
    name = F.concat("value", F.lit(":"), F.substr("iri", F.length("ns") + 1))
    return iris.select("iri").distinct().join(found, "iri", "left").select("iri", F.coalesce(name, F.concat(F.lit("<"), "iri", F.lit(">"))).alias("qname"))


#: A line that declares a prefix, in either form.
DECLARED = r"^\s*(?:@prefix|(?i:PREFIX))\s+([^\s:]*):\s*<([^>]*)>"


def declared(lines: DataFrame) -> DataFrame:
    """``file, prefix, ns`` of the prefixes that each file declares (``file, line, value``); of several declarations the last counts.

    The empty prefix is one too; null lines declare nothing.
    """
    rows = lines.where(F.col("value").rlike(DECLARED)).select("file", "line", F.regexp_extract("value", DECLARED, 1).alias("prefix"), F.regexp_extract("value", DECLARED, 2).alias("ns"))
    return rows.groupBy("file", "prefix").agg(F.max_by("ns", "line").alias("ns"))


def bound(found: DataFrame, preferred: list[tuple[str, str]] = (), order: list[str] = ()) -> DataFrame:
    """``prefix, ns, place``: one map of all files: preferred (prefix, namespace) first, else that of the first file; those in ``order`` come first and in it.

    The others have the place after them and are told apart by their names.
    """
    one = found.groupBy("prefix").agg(F.min_by("ns", F.struct("file", "ns")).alias("ns"))
    spark = found.sparkSession
    given = F.broadcast(spark.createDataFrame(list(dict(preferred).items()), "prefix string, own string"))  # the user's own few
    ranks = F.broadcast(spark.createDataFrame([(x, k) for k, x in enumerate(dict.fromkeys(order))], "prefix string, rank int"))
    both = one.join(given, "prefix", "left_anti").unionByName(given.select("prefix", F.col("own").alias("ns")))
    return both.join(ranks, "prefix", "left").select("prefix", "ns", F.coalesce("rank", F.lit(len(dict.fromkeys(order)))).alias("place"))
