"""Rules on patterns of triples: what matches goes, what templates say comes.

A rule has patterns (s, p, o) of IRIs, literals (``"text``) and ``?variables``, which must agree wherever they occur; templates of the same form, in
which an object may also be a ``Made`` literal; and the places of the patterns whose triples go. Rules apply in order, each to what the rules
before it left. The graph itself is never written: a table of the triples that have come or gone so far stands beside it, so a rule costs what it
matches and changes, and a lost executor costs tasks of one rule.

Defined cases: a template whose variable isn't in the patterns is an error; a literal that comes out null, and a literal as a subject or a predicate, make no
triple; a literal of a pattern matches any datatype and language, and the triples it matched go; triples are a set, so what is made twice or is there already counts once as a triple; an empty graph gives an empty one and counts of 0.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import bounded, written
from . import patterns, refactor, select

TERM = select.TERM


class Made(NamedTuple):
    """A literal of a template: its text from the texts of the variables."""

    text: Callable[[dict[str, Column]], Column]
    dt: str = ""
    lang: str = ""


class Rule(NamedTuple):
    name: str
    where: list[tuple[str, str, str]]
    make: list[tuple[str, str, str | Made]]
    #: Places of the patterns whose triples go; all of them by default.
    gone: list[int] | None = None
    #: A condition on the texts of the variables.
    only: Callable[[dict[str, Column]], Column] | None = None


_KIND = ["v", "kind", "dt", "lang"]


def _term(*parts: Column) -> Column:
    return F.struct(*(x.alias(n) for x, n in zip(parts, _KIND, strict=True)))


def _pattern(g: DataFrame, s: str, p: str, o: str) -> DataFrame:
    """The answers of a pattern, each variable a term with its kind, datatype and language."""
    none, found = F.lit(""), {}
    for end, x, term in (("s", s, _term(F.col("s"), F.col("s_kind"), none, none)), ("p", p, _term(F.col("p"), F.lit("iri"), none, none)), ("o", o, _term(*map(F.col, TERM[3:])))):
        if x.startswith("?"):
            if x[1:] in found:
                g = g.where(found[x[1:]] == term)
            found.setdefault(x[1:], term)
        elif x.startswith('"'):
            g = g.where((F.col(end) == x[1:]) & (F.col("o_kind") == "literal"))
        else:
            g = g.where((F.col(end) == x) & ((F.col(f"{end}_kind") == "iri") if end != "p" else F.lit(True)))
    return g.select(*(t.alias(n) for n, t in found.items()))


def _triples(answers: DataFrame, templates: list[tuple[str, str, str | Made]]) -> DataFrame:
    """One triple of each template for each answer."""
    texts = {c: F.col(f"`{c}`.v") for c in answers.columns}

    def term(x: str | Made) -> Column:
        if isinstance(x, Made):
            return _term(x.text(texts).cast("string"), F.lit("literal"), F.lit(x.dt), F.lit(x.lang))
        if x.startswith("?"):
            return F.col(f"`{x[1:]}`")
        return _term(F.lit(x.lstrip('"') if x.startswith('"') else x), F.lit("literal" if x.startswith('"') else "iri"), F.lit(""), F.lit(""))

    each = [F.struct(term(s).alias("s"), term(p).alias("p"), term(o).alias("o")) for s, p, o in templates]
    rows = answers.select(F.explode(F.array(*each)).alias("x")).where("x.s.kind <> 'literal' AND x.p.kind = 'iri' AND x.o.v IS NOT NULL")
    return rows.select(F.col("x.s.v").alias("s"), F.col("x.s.kind").alias("s_kind"), F.col("x.p.v").alias("p"), F.col("x.o.v").alias("o"), F.col("x.o.kind").alias("o_kind"), F.col("x.o.dt").alias("o_dt"), F.col("x.o.lang").alias("o_lang")).distinct()


def _went(now: DataFrame, answers: DataFrame, pattern: tuple[str, str, str]) -> DataFrame:
    """The triples that a pattern matched; a literal of a pattern has any datatype and language, so these are looked up."""
    rows, object_ = _triples(answers, [pattern]), pattern[2]
    if not object_.startswith('"'):
        return rows
    same = now.where((F.col("o") == object_[1:]) & (F.col("o_kind") == "literal"))
    if not pattern[1].startswith("?"):
        same = same.where(F.col("p") == pattern[1])
    return same.join(rows.select("s", "s_kind", "p"), ["s", "s_kind", "p"], "left_semi").select(*TERM)


def _changed(g: DataFrame, changed: DataFrame | None) -> DataFrame:
    """The graph with the changes so far (``TERM, there``, one row a triple). A filter on ``p`` reaches both tables."""
    if changed is None:
        return g
    return g.join(changed.select(*TERM), TERM, "left_anti").unionByName(changed.where("there").select(*TERM))


def apply(g: DataFrame, rules: list[Rule]) -> tuple[DataFrame, DataFrame]:
    """The graph after all rules, and ``place, rule, matched, removed, made``: answers, triples that went and triples that came, rule by rule."""
    g = g.select(*TERM).distinct()
    changed, counts = _applied(g, rules)
    return _changed(g, changed), counts


def _applied(g: DataFrame, rules: list[Rule]) -> tuple[DataFrame | None, DataFrame]:
    """What all rules change in distinct triples (``TERM, there``), and the counts of the rules."""
    counts: list[DataFrame] = []
    changed: DataFrame | None = None
    for place, rule in enumerate(rules):
        now = _changed(g, changed)
        answers = reduce(patterns.joined, (_pattern(now, *x) for x in rule.where))
        unbound = {x[1:] for t in rule.make for x in t if isinstance(x, str) and x.startswith("?")} - set(answers.columns)
        if unbound:
            raise ValueError(f"rule {rule.name!r} has unbound variables {sorted(unbound)}")
        if rule.only:
            answers = answers.where(rule.only({c: F.col(f"`{c}`.v") for c in answers.columns}))
        answers = written(answers, "answers")
        gone = [rule.where[i] for i in (range(len(rule.where)) if rule.gone is None else rule.gone)]
        went = written(reduce(DataFrame.unionByName, (_went(now, answers, x) for x in gone)).distinct(), "gone") if gone else None
        came = written(_triples(answers, rule.make), "made") if rule.make else None
        parts = [df.withColumn("there", F.lit(there)) for df, there in ((went, False), (came, True)) if df is not None]
        if parts:
            # the last change of a triple counts, and what a rule makes stays though it also removes it
            own = reduce(DataFrame.unionByName, parts).groupBy(*TERM).agg(F.max("there").alias("there"))
            changed = written(own if changed is None else changed.join(own, TERM, "left_anti").unionByName(own), "changed")
        n = lambda df: F.lit(0).cast("bigint") if df is None else F.count("*")
        row = answers.agg(F.count("*").alias("matched"))
        for name, df in (("removed", went), ("made", came)):
            row = row.crossJoin(F.broadcast((answers if df is None else df).agg(n(df).alias(name))))  # one row each
        counts.append(row.select(F.lit(place).alias("place"), F.lit(rule.name).alias("rule"), "matched", "removed", "made"))
    none = g.sparkSession.createDataFrame([], "place int, rule string, matched bigint, removed bigint, made bigint")
    return changed, reduce(DataFrame.unionByName, counts, none)


#: Bits of sources in a column.
BITS = 63


def _merged(all_: DataFrame, names: list[str]) -> DataFrame:
    """``TERM, bits_0, ...``: each triple of ``all_`` (``TERM, was, source``) once, with a bit for each of its sources; ``was`` is the subject before it was mapped.

    Triples are grouped where those of one subject lie. Only those whose subject had been several before, told by hashes, are dealt by triple.
    """
    k = F.array_position(F.array(*map(F.lit, names)), F.col("source")) - 1
    own = [F.when(F.floor(k / BITS) == n, F.call_function("shiftleft", F.lit(1).cast("bigint"), (k % BITS).cast("int"))).otherwise(0).cast("bigint").alias(f"bits_{n}") for n in range(-(-len(names) // BITS))]
    bits = [F.bit_or(f"bits_{n}").alias(f"bits_{n}") for n in range(len(own))]
    was = all_.groupBy(F.xxhash64("s").alias("hash")).agg(F.min(F.xxhash64("was")).alias("a"), F.max(F.xxhash64("was")).alias("b"))
    met = written(was.where("a <> b").select("hash"), "met")
    rows = all_.select(*TERM, "was", *own)
    if met.isEmpty():
        return rows.groupBy("was", *TERM).agg(*bits).drop("was")
    if met.limit(refactor.FEW + 1).count() > refactor.FEW:
        return rows.groupBy(*TERM).agg(*bits)
    rows, met = rows.withColumn("hash", F.xxhash64("s")), F.broadcast(met)
    return rows.join(met, "hash", "left_anti").groupBy("was", *TERM).agg(*bits).drop("was").unionByName(rows.join(met, "hash", "left_semi").groupBy(*TERM).agg(*bits))


def _with_predicates_of(rows: DataFrame, of: DataFrame, how: str = "left_semi") -> DataFrame:
    """The rows with a predicate of ``of``, or without one (``left_anti``); a graph uses few predicates, beyond ``refactor.FEW`` they are joined."""
    return rows.join(bounded(of, refactor.FEW), "p", how)


def migrate(sources: list[tuple[str, DataFrame]], spaces: DataFrame | None = None, mapping: DataFrame | None = None, rules: list[Rule] = ()) -> tuple[DataFrame, DataFrame]:
    """Several data sources in one pass: namespaces (``ns, value, place``), then entities (``old, new``), then rules.

    Up to ``spaces.FEW`` namespaces are replaced as the triples are read; for more, a map of the union's IRIs is made. A triple is written once, whatever number of sources has it, and only those with predicates that the rules change
    meet what they change. Returns the migrated union with ``source`` for triples that the rules didn't make, and the counts of the rules.
    """
    from . import spaces as names

    all_ = reduce(DataFrame.unionByName, (g.select(*TERM, F.col("s").alias("was"), F.lit(name).alias("source")) for name, g in sources))
    maps = []
    if spaces is not None:
        few = names.few(spaces)
        if few is None:
            found = names.matched(select.referenced(all_).withColumnRenamed("uri", "iri"), spaces, longest=False)
            maps.append(found.select(F.col("iri").alias("old"), F.concat("value", F.substr("iri", F.length("ns") + 1)).alias("new")))
        else:
            all_ = refactor.remapped(all_, few, ["was", "source"])
    if mapping is not None:
        maps.append(mapping.select("old", "new"))
    for m in maps:
        one = written(m, "map")
        for column, kind in (("p", None), ("s", "s_kind"), ("o", "o_kind")):
            all_ = refactor.mapped(all_, one, column, kind)
    known = list(dict.fromkeys(name for name, _ in sources))
    all_ = written(_merged(all_, known).sortWithinPartitions("p"), "sources")
    changed, counts = _applied(all_.select(*TERM), list(rules))
    by = F.array(*(F.when(F.getbit(f"bits_{k // BITS}", F.lit(k % BITS)) == 1, F.lit(name)) for k, name in enumerate(known)))
    told = lambda rows: rows.select(*TERM, F.explode(F.array_compact(by)).alias("source"))
    if changed is None:
        return told(all_), counts
    of = written(changed.select("p").distinct(), "predicates")
    same = _with_predicates_of(all_, of)
    left = same.join(bounded(changed.where("NOT there").select(*TERM), refactor.FEW), TERM, "left_anti")
    came = changed.where("there").select(*TERM).join(same.select(*TERM), TERM, "left_anti")
    return told(_with_predicates_of(all_, of, "left_anti")).unionByName(told(left)).unionByName(came.withColumn("source", F.lit(None).cast("string"))), counts
