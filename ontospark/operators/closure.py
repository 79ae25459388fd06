"""Graph traversal in rounds that are written tables.

Short paths are followed edge by edge. What is left after ``STEPS`` rounds is contracted first: a node with one way on only passes on what
its way leads to, so such nodes point ahead to the first node that isn't one (``chains``: pointers that double, one row a node), and the rounds
go on among the others. So a chain or a tree of any depth takes about log n rounds, and a graph with many ways as many as it is deep; no
table of a traversal has more rows than there are edges, but for ``reach``, whose result is pairs. Cycles are found as strongly connected
components, one row a node. Rounds are written, so lineage stays short and a lost executor costs tasks of one round; the driver sees counts.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import removed, written

#: Rounds of one edge before chains are contracted.
STEPS = 3
#: A round of ``reach`` doubles its paths where that makes at most so many times the pairs so far, before equal ones meet.
MOST = 4


def _edges(edges: DataFrame) -> DataFrame:
    return written(edges.select("src", "dst").distinct(), "edges")


def _flipped(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def chains(single: DataFrame) -> DataFrame:
    """``node, at, far, last, low, ring`` for ``node, at``: nodes with one edge that counts, to ``at``.

    ``at`` becomes the first node ahead that isn't one of them, ``far`` edges on, ``last`` the node before it. Nodes whose way never ends are
    on or before a ring: ``ring`` is set, and ``low`` is the smallest node of it if all of them are on it.
    """
    ahead, before = single.select("node", "at", F.lit(1).cast("bigint").alias("far"), F.col("node").alias("last"), F.col("node").alias("low")), None
    ahead = written(ahead, "chains")
    while True:
        nxt = ahead.select(F.col("node").alias("at"), F.col("at").alias("at2"), F.col("far").alias("far2"), F.col("last").alias("last2"), F.col("low").alias("low2"))
        open_, less = F.col("at2").isNotNull().alias("ring"), F.coalesce(F.col("low2") < F.col("low"), F.lit(False)).alias("less")
        both = ahead.join(nxt, "at", "left").select("node", F.coalesce("at2", "at").alias("at"), (F.col("far") + F.coalesce("far2", F.lit(0))).alias("far"), F.coalesce("last2", "last").alias("last"), F.least("low", F.coalesce("low2", "low")).alias("low"), open_, less)
        last, ahead = ahead, written(both, "chains")
        removed(last)
        left, fell = ahead.agg(F.count_if("ring"), F.count_if("less")).first()
        # where as many ways stay open as before, only rings are left; where twice as far no node finds a smaller one, its ring has none
        if left == 0 or (left == before and fell == 0):
            return ahead.drop("less")
        ahead, before = ahead.drop("ring", "less"), left


def _single(edges: DataFrame, but: DataFrame | None = None) -> DataFrame:
    """``node, at``: nodes with exactly one edge out, and where it leads; without those of ``but.node``."""
    one = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n"), F.min("dst").alias("at")).where("n = 1").select("node", "at")
    return one if but is None else one.join(but.select("node"), "node", "left_anti")


def _contracted(edges: DataFrame, ahead: DataFrame) -> DataFrame:
    """``at, to, far``: the edges of nodes that no chain passes through, each to the end of the chain that it enters."""
    own = edges.join(ahead.select(F.col("node").alias("src")), "src", "left_anti")
    on = ahead.where("NOT ring").select(F.col("node").alias("dst"), F.col("at").alias("end"), F.col("far").alias("more"))
    rows = own.join(on, "dst", "left").select("src", F.coalesce("end", "dst").alias("to"), (F.coalesce("more", F.lit(0)) + 1).alias("far"))
    return rows.groupBy(F.col("src").alias("at"), "to").agg(F.min("far").alias("far"))


def _spread(ways: DataFrame, rounds: list[DataFrame], key: list[str], most: int | None = None, limit: int | None = None) -> bool:
    """Adds rounds of better values: one at ``ways.at`` gives one at ``ways.to``, ``far`` farther. Values are ``node, *key, dist, mark``, less is better.

    Ends when a round finds nothing (True) or after ``limit`` rounds; nothing beyond ``most`` is made.
    """
    same = ["node", *key]
    for _ in count() if limit is None else range(limit):
        made = rounds[-1].join(ways, F.col("node") == F.col("at")).select(F.col("to").alias("node"), *key, F.struct((F.col("dist") + F.col("far")).alias("dist"), "mark").alias("x"))
        made = (made if most is None else made.where(F.col("x.dist") <= most)).groupBy(*same).agg(F.min("x").alias("x"))
        seen = _union(rounds).select(*(F.col(c).alias(f"_{c}") for c in same), F.struct("dist", "mark").alias("_x"))
        on = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"_{c}") for c in same])
        new = written(made.join(seen, on & (F.col("_x") <= F.col("x")), "left_anti").select(*same, "x.dist", "x.mark"), "round")
        if new.isEmpty():
            return True
        rounds.append(new)
    return False


def _best(rounds: list[DataFrame], key: list[str]) -> DataFrame:
    return _union(rounds).groupBy("node", *key).agg(F.min(F.struct("dist", "mark")).alias("x")).select("node", *key, "x.dist", "x.mark")


def _values(node, dist: int = 0, mark=None):
    return [node.alias("node"), F.lit(dist).cast("bigint").alias("dist"), (F.lit("") if mark is None else mark).alias("mark")]


def walk(edges: DataFrame, start: DataFrame, most: int | None = None, within: DataFrame | None = None) -> DataFrame:
    """``uri, depth``: breadth first along ``src → dst`` from ``start.uri`` (depth 0), each node once, only to nodes of ``within.uri`` if given."""
    edges = edges.select("src", "dst")
    if within is not None:
        edges = edges.join(within.select(F.col("uri").alias("dst")), "dst", "left_semi")
    edges = _edges(edges)
    found = [written(start.select("uri").distinct().select(*_values(F.col("uri"))), "round")]
    ways = edges.select(F.col("src").alias("at"), F.col("dst").alias("to"), F.lit(1).alias("far"))
    if _spread(ways, found, [], most, limit=STEPS if most is None else None):
        return _union(found).select(F.col("node").alias("uri"), F.col("dist").cast("int").alias("depth"))
    # nodes beyond with one edge in hang from the node before them
    seen = written(_union(found), "seen")
    rest = written(edges.join(seen.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst"), "rest")
    back = written(chains(_single(_flipped(rest))).where("NOT ring"), "back")
    own = rest.join(back.select(F.col("node").alias("dst")), "dst", "left_anti")
    from_ = back.select(F.col("node").alias("src"), F.col("at").alias("head"), F.col("far").alias("more"))
    ways = written(own.join(from_, "src", "left").groupBy(F.coalesce("head", "src").alias("at"), F.col("dst").alias("to")).agg(F.min(F.coalesce("more", F.lit(0)) + 1).alias("far")), "ways")
    found = [seen]
    _spread(ways, found, [])
    heads = _best(found, [])
    hung = back.join(heads.select(F.col("node").alias("at"), "dist"), "at").select("node", (F.col("dist") + F.col("far")).alias("dist"))
    return heads.select("node", "dist").unionByName(hung).select(F.col("node").alias("uri"), F.col("dist").cast("int").alias("depth"))


def nearest(edges: DataFrame, marked: DataFrame) -> DataFrame:
    """``uri, mark, dist`` for nodes with a marked node (``marked.uri``) ahead of them: the nearest, ties to the smallest; marked ones are their own.

    A node has one mark, so no pairs are made.
    """
    edges = _edges(edges)
    first = written(marked.select("uri").distinct().select(*_values(F.col("uri"), 0, F.col("uri"))), "found")
    found = [first]
    if not _spread(edges.select(F.col("dst").alias("at"), F.col("src").alias("to"), F.lit(1).alias("far")), found, [], limit=STEPS):
        ahead = written(chains(_single(edges, first)), "ahead")
        ways = written(_contracted(edges, ahead).select(F.col("to").alias("at"), F.col("at").alias("to"), "far"), "ways")
        found = [written(_best(found, []), "found")]
        _spread(ways, found, [])
        heads = _best(found, []).join(ahead.where("NOT ring").select("node"), "node", "left_anti")
        hung = ahead.where("NOT ring").join(heads.select(F.col("node").alias("at"), "dist", "mark"), "at").select("node", (F.col("dist") + F.col("far")).alias("dist"), "mark")
        found = [heads, hung]
    return _best(found, []).select(F.col("node").alias("uri"), "mark", F.col("dist").cast("int").alias("dist"))


def reach(edges: DataFrame, most: int | None = None, to: DataFrame | None = None) -> DataFrame:
    """``src, dst, dist`` for every pair with a path of one edge or more (``most`` at most); dist is the shortest. Cycles end by themselves.

    With ``to.uri`` only the pairs that end there are ever made.
    """
    edges = _edges(edges)
    if to is not None:
        return _reach_to(edges, most, written(to.select(F.col("uri").alias("node")).distinct(), "ends"))
    pairs, length = edges.withColumn("dist", F.lit(1)), 1
    while most is None or length < most:
        # pairs has all shortest paths of `length` edges or fewer: a longer one begins with a shortest one of exactly `length`
        begin = pairs.where(F.col("dist") == length)
        ahead, step = pairs, length
        if length > 1:
            into, out = begin.groupBy(F.col("dst").alias("mid")).agg(F.count("*").alias("a")), pairs.groupBy(F.col("src").alias("mid")).agg(F.count("*").alias("b"))
            met, so_far = into.join(out, "mid").agg(F.sum(F.col("a") * F.col("b")).alias("n")).first().n or 0, pairs.count()
            if met > MOST * so_far:
                ahead, step = edges.withColumn("dist", F.lit(1)), 1
        more = ahead.select(F.col("src").alias("mid"), F.col("dst").alias("end"), F.col("dist").alias("more"))
        far = begin.join(more, F.col("dst") == F.col("mid")).groupBy("src", F.col("end").alias("dst")).agg((F.min("more") + length).alias("dist"))
        if most is not None:
            far = far.where(F.col("dist") <= most)
        new = written(far.join(pairs, ["src", "dst"], "left_anti"), "round")
        if new.isEmpty():
            break
        pairs, length = written(pairs.unionByName(new), "pairs"), length + step
    return pairs


def _reach_to(edges: DataFrame, most: int | None, ends: DataFrame) -> DataFrame:
    into = edges.join(ends.select(F.col("node").alias("dst")), "dst", "left_semi")
    found = [written(into.select(F.col("src").alias("node"), F.col("dst").alias("end"), F.lit(1).cast("bigint").alias("dist"), F.lit("").alias("mark")), "pairs")]
    ways = edges.select(F.col("dst").alias("at"), F.col("src").alias("to"), F.lit(1).alias("far"))
    if most is not None:
        _spread(ways, found, ["end"], most)
    elif not _spread(ways, found, ["end"], limit=STEPS):
        ahead = written(chains(_single(edges, ends)), "ahead")
        ways = written(_contracted(edges, ahead).select(F.col("to").alias("at"), F.col("at").alias("to"), "far"), "ways")
        # pairs of nodes inside chains come last, from those of the chains' ends, and an end's own
        first = _best(found, ["end"]).join(ahead.select("node"), "node", "left_anti")
        own = ways.join(ends.select(F.col("node").alias("at")), "at", "left_semi").select(F.col("to").alias("node"), F.col("at").alias("end"), F.col("far").alias("dist"), F.lit("").alias("mark"))
        found = [written(_best([first, own], ["end"]), "pairs")]
        _spread(ways, found, ["end"])
        heads = written(_best(found, ["end"]), "heads")
        line = ahead.where("NOT ring")
        hung = line.join(heads.select(F.col("node").alias("at"), "end", "dist"), "at").select("node", "end", (F.col("dist") + F.col("far")).alias("dist"), F.lit("").alias("mark"))
        last = line.join(ends.select(F.col("node").alias("at")), "at", "left_semi").select("node", F.col("at").alias("end"), F.col("far").alias("dist"), F.lit("").alias("mark"))
        found = [heads, hung, last]
    return _best(found, ["end"]).select(F.col("node").alias("src"), F.col("end").alias("dst"), F.col("dist").cast("int").alias("dist"))


def kinds(above: DataFrame, own: DataFrame, *by: str) -> DataFrame:
    """``class, kind`` of the nodes ``above.src``: those with equal rows of the columns ``by`` above them are one kind, told by a digest; a node of ``own.class`` is one by itself."""
    digest = lambda salt: F.sum(F.xxhash64(*by, F.lit(salt)).cast("decimal(20,0)")).alias(salt)
    each = above.groupBy(F.col("src").alias("class")).agg(F.count("*").alias("k"), digest("a"), digest("b"))
    itself = own.select("class", F.col("class").alias("own")).distinct()
    return each.join(itself, "class", "full").select("class", F.sha2(F.concat_ws(" ", F.when(F.col("own").isNull(), F.concat_ws(" ", "k", "a", "b")), "own"), 256).alias("kind"))


def descendants(edges: DataFrame, roots: DataFrame, most: int | None = None) -> DataFrame:
    """``uri, depth`` of the roots and all below them, for ``src → dst`` from child to parent."""
    return walk(_flipped(edges), roots, most)


def _trimmed(left: DataFrame, rounds: int = STEPS) -> DataFrame:
    """Without nodes that have no edge in or none out, for some rounds."""
    before = None
    for _ in range(rounds):
        into, out = left.select(F.col("dst").alias("src")).distinct(), left.select(F.col("src").alias("dst")).distinct()
        left = written(left.join(into, "src", "left_semi").join(out, "dst", "left_semi").select("src", "dst"), "trimmed")
        after = left.count()
        if after in (0, before):
            break
        before = after
    return left


def components(edges: DataFrame) -> DataFrame:
    """``uri, component`` of the nodes on cycles (a node with an edge to itself too): strongly connected components, named by their smallest node."""
    found = _components(_edges(edges), 0)
    return found.join(found.groupBy("component").agg(F.min("uri").alias("least")), "component").select("uri", F.col("least").alias("component"))


def _components(edges: DataFrame, turn: int) -> DataFrame:
    """Nodes that lead nowhere or come from nowhere are trimmed, nodes with one edge in and one out contracted, and the rest is coloured: a node's
    colour is the first node, in an order by chance, that reaches it; what of its colour reaches that node is its component. Edges between
    colours, and found components, go, and the rest begins again: by chance about half of a long way each time."""
    left = _trimmed(edges)
    none = left.select(F.col("src").alias("uri"), F.col("dst").alias("component"))
    if left.isEmpty():
        return none
    one_in = _single(_flipped(left)).select("node")
    thin = _single(left).join(one_in, "node", "left_semi").where("node <> at")
    if not thin.isEmpty():
        line = written(chains(thin), "thin")
        rings = line.where("ring").select(F.col("node").alias("uri"), F.col("low").alias("component"))
        path = line.where("NOT ring")
        # a whole chain is an edge from the node before it to the one after it
        enter = left.join(line.select(F.col("node").alias("src")), "src", "left_anti")
        if enter.isEmpty():
            return rings
        via = enter.join(path.select(F.col("node").alias("dst"), "at", "last"), "dst", "left")
        whole = written(via.select("src", F.coalesce("at", "dst").alias("dst"), "last"), "whole")
        inner = written(_components(written(whole.select("src", "dst").distinct(), "contracted"), turn + 1), "inner")
        name = lambda end: inner.select(F.col("uri").alias(end), F.col("component").alias(f"of_{end}"))
        inside = whole.where("last IS NOT NULL").join(name("src"), "src").join(name("dst"), "dst").where("of_src = of_dst").select("last", F.col("of_src").alias("component"))
        hung = path.join(inside, "last").select(F.col("node").alias("uri"), "component")
        return written(_union([rings, inner, hung]), "components")
    nodes = left.select(F.explode(F.array("src", "dst")).alias("uri")).distinct()
    chance = F.concat(F.lpad(F.hex(F.xxhash64("uri", F.lit(turn))), 16, "0"), F.lit(" "), "uri")
    first = nodes.select("uri", chance.alias("c"))
    rounds = [written(first.select(F.col("uri").alias("node"), F.lit(0).cast("bigint").alias("dist"), F.col("c").alias("mark")), "colours")]
    _spread(left.select(F.col("src").alias("at"), F.col("dst").alias("to"), F.lit(0).alias("far")), rounds, [])
    colour = written(_best(rounds, []).select(F.col("node").alias("uri"), F.substr("mark", F.lit(18)).alias("component")), "colours")
    of = lambda end: colour.select(F.col("uri").alias(end), F.col("component").alias(f"of_{end}"))
    same = written(left.join(of("src"), "src").join(of("dst"), "dst").where("of_src = of_dst").select("src", "dst"), "same")
    reached = walk(_flipped(same), colour.where("uri = component").select("uri")).select("uri")
    met = written(colour.join(reached, "uri", "left_semi"), "met")
    gone = met.select("uri")
    rest = same.join(gone.select(F.col("uri").alias("src")), "src", "left_anti").join(gone.select(F.col("uri").alias("dst")), "dst", "left_anti")
    # a component of one node is a cycle only with an edge to itself
    loops = left.where("src = dst").select(F.col("src").alias("component"))
    big = met.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").select("component").unionByName(loops).distinct()
    return written(met.join(big, "component", "left_semi").select("uri", "component").unionByName(_components(written(rest.select("src", "dst"), "rest"), turn + 1)), "components")


def cycle_members(edges: DataFrame) -> DataFrame:
    """``uri`` of the nodes that reach themselves."""
    return components(edges).select("uri")


def _inside(edges: DataFrame, found: DataFrame) -> DataFrame:
    """``src, dst, component`` of the edges within a component."""
    of = lambda end: found.select(F.col("uri").alias(end), F.col("component").alias(f"of_{end}"))
    return edges.select("src", "dst").distinct().join(of("src"), "src").join(of("dst"), "dst").where("of_src = of_dst").select("src", "dst", F.col("of_src").alias("component"))


def acyclic(edges: DataFrame) -> DataFrame:
    """The edges whose ends don't reach each other: without those inside a cycle."""
    return edges.select("src", "dst").distinct().join(_inside(edges, components(edges)).select("src", "dst"), ["src", "dst"], "left_anti")


def condensed(edges: DataFrame) -> DataFrame:
    """``src, dst``: the acyclic graph of components and of the nodes outside them, under their names."""
    found = written(components(edges), "components")
    of = lambda end: found.select(F.col("uri").alias(end), F.col("component").alias(f"of_{end}"))
    both = edges.select("src", "dst").distinct().join(of("src"), "src", "left").join(of("dst"), "dst", "left")
    return both.select(F.coalesce("of_src", "src").alias("src"), F.coalesce("of_dst", "dst").alias("dst")).where("src <> dst").distinct()


def cycle_paths(edges: DataFrame) -> DataFrame:
    """``component, position, uri``: a shortest cycle through each component's smallest node, from it (position 0), each step an edge, the smallest node first where several are as near."""
    edges = _edges(edges)
    found = written(components(edges), "components")
    inside = written(_inside(edges, found), "inside")
    # a component of as many edges as nodes is a ring, and its own cycle: places are distances from the smallest node
    nodes, lines = found.groupBy("component").agg(F.count("*").alias("n")), inside.groupBy("component").agg(F.count("*").alias("m"))
    ring = written(nodes.join(lines, "component").where("n = m").select("component"), "rings")
    around = chains(inside.where("dst <> component").join(ring, "component", "left_semi").select(F.col("dst").alias("node"), F.col("src").alias("at")))
    rings = ring.select("component", F.lit(0).cast("bigint").alias("position"), F.col("component").alias("uri")).unionByName(around.select(F.col("at").alias("component"), F.col("far").alias("position"), F.col("node").alias("uri")))
    inside, found = (written(x.join(ring, "component", "left_anti"), "others") for x in (inside, found))
    if inside.isEmpty():
        return rings
    depth = written(walk(inside, found.where("uri = component").select("uri")), "depth")
    deep = lambda end: depth.select(F.col("uri").alias(end), F.col("depth").alias(f"{end}_depth"))
    far = written(inside.join(deep("src"), "src").join(deep("dst"), "dst"), "far")
    # the node before each on a way from the smallest, and the last node of the cycle
    back = written(far.where("dst_depth = src_depth + 1").groupBy(F.col("dst").alias("uri")).agg(F.min("src").alias("before")), "before")
    path = written(far.where("dst = component").groupBy("component").agg(F.min(F.struct("src_depth", "src")).alias("x")).select("component", F.col("x.src").alias("uri")), "path")
    while True:
        more = path.join(back, "uri").select("component", F.col("before").alias("uri"))
        new = written(more.join(path, ["component", "uri"], "left_anti").distinct(), "round")
        if new.isEmpty():
            break
        path = written(path.unionByName(new), "path")
        ahead = back.select(F.col("uri").alias("before"), F.col("before").alias("farther"))
        back = written(back.join(ahead, "before").select("uri", F.col("farther").alias("before")), "before")
    return rings.unionByName(path.join(depth, "uri").select("component", F.col("depth").cast("long").alias("position"), "uri"))


def longest_depth(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``uri, depth``: the longest path up to a node without a parent, edges inside cycles left out."""
    open_ = written(acyclic(edges), "acyclic")
    level = written(nodes.select("uri").distinct().join(open_.select(F.col("src").alias("uri")), "uri", "left_anti"), "level")
    # the nodes with a path of so many edges; a node's depth is its last one
    levels = [level.withColumn("depth", F.lit(0))]
    for step in range(1, STEPS + 2):
        below = open_.join(levels[-1].select(F.col("uri").alias("dst")), "dst", "left_semi")
        new = written(below.select(F.col("src").alias("uri")).distinct().withColumn("depth", F.lit(step)), "level")
        if new.isEmpty():
            return _union(levels).groupBy("uri").agg(F.max("depth").alias("depth"))
        levels.append(new)
    # deeper ones: nodes with one parent left hang from it, the others wait for all of theirs
    ahead = written(chains(_single(open_)), "ahead")
    on = ahead.select(F.col("node").alias("dst"), F.col("at").alias("end"), F.col("far").alias("more"))
    own = open_.join(ahead.select(F.col("node").alias("src")), "src", "left_anti").join(on, "dst", "left")
    wait = written(own.groupBy("src", F.coalesce("end", "dst").alias("dst")).agg(F.max(F.coalesce("more", F.lit(0)) + 1).alias("far")), "wait")
    new = level.select("uri", F.lit(0).cast("bigint").alias("depth"))
    done, got = [new], wait.limit(0).select(F.col("src").alias("uri"), F.col("far").alias("depth"))
    while not wait.isEmpty():
        hit = wait.join(new.select(F.col("uri").alias("dst"), "depth"), "dst").select(F.col("src").alias("uri"), (F.col("depth") + F.col("far")).alias("depth"))
        got = written(got.unionByName(hit).groupBy("uri").agg(F.max("depth").alias("depth")), "got")
        wait = written(wait.join(new.select(F.col("uri").alias("dst")), "dst", "left_anti").select("src", "dst", "far"), "wait")
        new = written(got.join(wait.select(F.col("src").alias("uri")), "uri", "left_anti"), "done")
        if new.isEmpty():
            break
        got = written(got.join(new.select("uri"), "uri", "left_anti"), "got")
        done.append(new)
    tops = _union(done)
    hung = ahead.join(tops.select(F.col("uri").alias("at"), "depth"), "at").select(F.col("node").alias("uri"), (F.col("depth") + F.col("far")).alias("depth"))
    return tops.unionByName(hung).select("uri", F.col("depth").cast("int").alias("depth"))


def _leap(leaps: DataFrame) -> DataFrame:
    """Twice as far along lists; a cell has one next cell, so there are no more leaps than cells."""
    ahead = leaps.select(F.col("src").alias("mid"), F.col("dst").alias("end"))
    return written(leaps.join(ahead, F.col("dst") == F.col("mid")).select("src", F.col("end").alias("dst")).distinct(), "leaps")


def list_items(g: DataFrame, heads: DataFrame) -> DataFrame:
    """``head, position, o, o_kind`` of the RDF lists that begin at ``heads.head``; steps along the list double."""
    from ..functions import vocab as v

    first = g.where(F.col("p") == v.FIRST).select(F.col("s").alias("cell"), "o", "o_kind")
    leaps = _edges(g.where((F.col("p") == v.REST) & (F.col("o") != v.NIL)).select(F.col("s").alias("src"), F.col("o").alias("dst")))
    found, length = written(heads.select("head", F.col("head").alias("cell")).distinct().withColumn("position", F.lit(0)), "found"), 1
    while True:
        # found has the cells at positions below `length`
        new = found.join(leaps, F.col("cell") == F.col("src")).select("head", F.col("dst").alias("cell"), (F.col("position") + length).alias("position"))
        new = written(new.join(found.select("head", "cell"), ["head", "cell"], "left_anti"), "round")
        if new.isEmpty():
            return found.join(first, "cell").select("head", "position", "o", "o_kind")
        found, leaps, length = written(found.unionByName(new), "found"), _leap(leaps), 2 * length
