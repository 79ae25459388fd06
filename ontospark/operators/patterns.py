"""Graph patterns as DataFrame joins, and assertions on their answers.

A pattern is (s, p, o) of constants and ``?variables``; answers are columns named like the variables.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import closure, select


def pattern(g: DataFrame, s: str, p: str, o: str) -> DataFrame:
    """The answers of one pattern; a variable that occurs twice must agree."""
    columns: dict[str, str] = {}
    for name, part in (("s", s), ("p", p), ("o", o)):
        if not part.startswith("?"):
            g = g.where(F.col(name) == part)
        elif part[1:] in columns:
            g = g.where(F.col(name) == F.col(columns[part[1:]]))
        else:
            columns[part[1:]] = name
    return g.select(*(F.col(c).alias(n) for n, c in columns.items()))


def joined(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    """Natural join on the shared variables."""
    shared = [c for c in a.columns if c in b.columns]
    if not shared:
        raise ValueError("patterns without a shared variable would make a cross product")
    return a.join(b, shared, how)


#: A pattern is first reduced to the keys of what is joined so far if it has so many times as many rows.
LARGER = 8
#: Two sides of more rows than this, by the counts, are merged: neither is broadcast, whatever its files' sizes let expect.
FEW = 100_000


def _size(x: tuple[str, str, str], counts: dict[str, tuple[int, int, int]]) -> tuple[float, dict[str, float]]:
    """About how many answers a pattern has, and how many values each of its variables."""
    known = [counts.get(x[1], (0, 0, 0))] if not x[1].startswith("?") else list(counts.values())
    n, subjects, objects = (float(sum(c[k] for c in known)) for k in range(3))
    for end, values in ((x[0], subjects), (x[2], objects)):
        n = n if end.startswith("?") else n / max(values, 1)
    values = {x[0]: subjects, x[1]: float(len(known)), x[2]: objects}
    return n, {name[1:]: min(v, n) for name, v in values.items() if name.startswith("?")}


def planned(patterns: list[tuple[str, str, str]], counts: dict[str, tuple[int, int, int]]) -> list[tuple[tuple[str, str, str], float, float]]:
    """The patterns in the order to join them, each with its size and that of what it is joined to.

    The smallest comes first, then always the one that leaves the fewest answers: sizes divide by the values of the shared variables. The
    order given only counts where a pattern occurs twice.
    """
    sizes = {x: _size(x, counts) for x in patterns}
    left = sorted(patterns, key=lambda x: (sizes[x][0], x))
    first = left.pop(0)
    rows, values = sizes[first][0], dict(sizes[first][1])
    out = [(first, rows, rows)]
    while left:
        made = {}
        for x in left:
            shared = values.keys() & sizes[x][1].keys()
            n = rows * sizes[x][0]
            for v in shared:
                n /= max(values[v], sizes[x][1][v], 1.0)
            made[x] = (not shared, n)
        best = min(left, key=lambda x: (made[x], x))
        if made[best][0]:
            raise ValueError("patterns without a shared variable would make a cross product")
        left.remove(best)
        out.append((best, sizes[best][0], rows))
        rows = made[best][1]
        for v, k in sizes[best][1].items():
            values[v] = min(values.get(v, k), k, max(rows, 1.0))
    return out


def bgp(g: DataFrame, *patterns: tuple[str, str, str], counts: dict[str, tuple[int, int, int]] | None = None) -> DataFrame:
    """The answers of all patterns together. With ``counts`` of the predicates (triples, subjects, objects) they are joined in the order of
    ``planned``, whatever order they are given in, and a much larger pattern is first reduced to the keys that can match."""
    if counts is None:
        # by the compressed sizes of files a whole predicate may seem small enough to be broadcast: two without a constant end are merged
        wide = [x[0].startswith("?") and x[2].startswith("?") for x in patterns]
        each = [pattern(g, *x) for x in patterns]
        return reduce(joined, (own.hint("merge") if k and wide[k] and all(wide[:k]) else own for k, own in enumerate(each)))
    out = None
    for x, n, so_far in planned(list(patterns), counts):
        own = pattern(g, *x)
        if out is not None and n > LARGER * so_far:
            own = own.join(out.select(*[c for c in own.columns if c in out.columns]).distinct(), [c for c in own.columns if c in out.columns], "left_semi")
        out = own if out is None else joined(out, own.hint("merge") if min(n, so_far) > FEW else own)
    return out.select(*sorted(out.columns))


def optional(a: DataFrame, b: DataFrame) -> DataFrame:
    return joined(a, b, "left")


def minus(a: DataFrame, b: DataFrame) -> DataFrame:
    """Answers of a that agree with none of b (NOT EXISTS and MINUS alike, as no shared variable is unbound here)."""
    return joined(a, b, "left_anti")


def exists(a: DataFrame, b: DataFrame) -> DataFrame:
    return joined(a, b, "left_semi")


def either(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b, allowMissingColumns=True)


def path_plus(g: DataFrame, predicate: str, s: str = "s", o: str = "o", to: DataFrame | None = None) -> DataFrame:
    """Pairs joined by one step or more; with ``to.uri`` those that end there."""
    return closure.reach(select.edges(g, predicate), to=to).select(F.col("src").alias(s), F.col("dst").alias(o))


def path_star(g: DataFrame, predicate: str, s: str = "s", o: str = "o", to: DataFrame | None = None) -> DataFrame:
    """The same and each node of the predicate with itself."""
    nodes = select.edges(g, predicate).select(F.explode(F.array("src", "dst")).alias("uri")).distinct()
    if to is not None:
        nodes = nodes.join(to, "uri", "left_semi")
    return path_plus(g, predicate, s, o, to).unionByName(nodes.select(F.col("uri").alias(s), F.col("uri").alias(o))).distinct()


def path_optional(g: DataFrame, predicate: str, s: str = "s", o: str = "o") -> DataFrame:
    """Pairs joined by one step, and each node of the predicate with itself (``p?``)."""
    e = select.edges(g, predicate)
    nodes = e.select(F.explode(F.array("src", "dst")).alias(s)).distinct()
    return e.select(F.col("src").alias(s), F.col("dst").alias(o)).unionByName(nodes.select(s, F.col(s).alias(o))).distinct()


def path_sequence(g: DataFrame, *predicates: str) -> DataFrame:
    """``s, o`` joined by the predicates one after the other (``p1/p2/…``); a leading ``^`` walks one backwards."""
    def step(p: str) -> DataFrame:
        a, b = ("o", "s") if p.startswith("^") else ("s", "o")
        e = g.where((F.col("p") == p.lstrip("^")) & (F.col("o_kind") != "literal")) if a == "o" else g.where(F.col("p") == p)
        return e.select(F.col(a).alias("s"), F.col(b).alias("o"))

    out = step(predicates[0])
    for p in predicates[1:]:
        out = out.withColumnRenamed("o", "mid").join(step(p).withColumnRenamed("s", "mid"), "mid").select("s", "o")
    return out


def path_alternative(g: DataFrame, *predicates: str) -> DataFrame:
    """``s, o`` joined by any of the predicates (``p1|p2|…``), as often as they are."""
    return g.where(F.col("p").isin(list(predicates))).select("s", "o")


def construct(answers: DataFrame, *templates: tuple[str, str, str]) -> DataFrame:
    """Triples ``s, p, o`` of IRIs from answers: one of each template for each answer, each once."""
    part = lambda x: F.col(x[1:]) if x.startswith("?") else F.lit(x)
    made = [answers.select(part(s).alias("s"), part(p).alias("p"), part(o).alias("o")) for s, p, o in templates]
    return reduce(DataFrame.unionByName, made).where("s IS NOT NULL AND o IS NOT NULL").distinct()


def describe(g: DataFrame, resources: DataFrame) -> DataFrame:
    """DESCRIBE: all triples of ``resources.uri``, and of the blank nodes that they lead to."""
    through = g.where("o_kind = 'bnode'").select(F.col("s").alias("src"), F.col("o").alias("dst"))
    return g.join(closure.walk(through, resources).select(F.col("uri").alias("s")), "s", "left_semi").select(*select.TERM)


def by_tags(tests: list[dict], include: list[str] = (), exclude: list[str] = ()) -> list[dict]:
    """Tests with any of the tags ``include`` (all if empty) and none of ``exclude``."""
    return [t for t in tests if (not include or set(include) & set(t.get("tags", ()))) and not set(exclude) & set(t.get("tags", ()))]


def totals(results: DataFrame) -> DataFrame:
    """One row: how many tests passed, failed, broke and were skipped."""
    n = lambda x: F.coalesce(F.sum(F.when(F.col("status") == x, 1).otherwise(0)), F.lit(0)).alias(x)
    return results.agg(F.count("*").alias("total"), n("passed"), n("failed"), n("error"), n("skipped"))


def has_results(df: DataFrame) -> bool:
    return not df.isEmpty()


def expect_count(df: DataFrame, exact: int | None = None, least: int | None = None, most: int | None = None) -> bool:
    n = df.count()
    return (exact is None or n == exact) and (least is None or n >= least) and (most is None or n <= most)


def expect_values(df: DataFrame, rows: DataFrame) -> bool:
    """The answers are these rows, as often."""
    rows = rows.select(*df.columns)
    return df.exceptAll(rows).isEmpty() and rows.exceptAll(df).isEmpty()


def expect_contains(df: DataFrame, rows: DataFrame) -> bool:
    """Every given row (of some of the variables) is among the answers."""
    return rows.join(df, rows.columns, "left_anti").isEmpty()


def assertions(spark, tests: list[tuple[str, DataFrame, str, DataFrame | int | bool]], skip: dict[str, str] | None = None, fail_fast: bool = False) -> DataFrame:
    """``name, status, message`` of named tests: kind ``values``, ``contains``, ``count``, ``has_results`` or ``ask``; failures of a plan are errors.

    ``skip`` gives reasons for tests that aren't run; ``fail_fast`` ends after the first that fails or breaks.
    """
    out = []
    for name, df, kind, expected in tests:
        if name in (skip or {}):
            out.append((name, "skipped", skip[name]))
            continue
        if fail_fast and any(status in ("failed", "error") for _, status, _ in out):
            break
        try:
            ok = {
                "values": lambda: expect_values(df, expected), "contains": lambda: expect_contains(df, expected), "count": lambda: expect_count(df, exact=expected),
                "has_results": lambda: has_results(df), "ask": lambda: has_results(df) == expected,
            }[kind]()
            out.append((name, "passed" if ok else "failed", "" if ok else f"{kind} not met"))
        except Exception as e:  # a broken question is a result of the suite, not its end
            out.append((name, "error", type(e).__name__))
    return spark.createDataFrame(out, "name string, status string, message string")
