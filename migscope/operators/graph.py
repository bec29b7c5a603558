"""Dependency graphs of a portfolio: strong components, levels and reachability.

Edges are rows (group columns, ``a``, ``b``): a needs b, inside one group (a project).  All loops
run on the driver round by round, the work on Spark; what a round leaves is written to the shared
folder (``materialize``), so a round reads its frontier and never the plans of the rounds before.
The driver sees one count a round.  No round joins the union of the earlier ones."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from migscope.session import materialize

c = F.col


def _join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join by shuffles.  A broadcast side goes through the driver, some megabytes each: over the
    joins of all rounds that is more than the driver is to see."""
    return left.join(right.hint("merge"), on, how)


def _edges(edges: DataFrame, group: list[str], source: str, target: str) -> DataFrame:
    """Distinct edges (group, a, b) without loops."""
    return edges.select(*group, c(source).alias("a"), c(target).alias("b")).where(c("a").isNotNull() & c("b").isNotNull() & (c("a") != c("b"))).distinct()


def _trimmed(live: DataFrame, group: list[str]) -> DataFrame:
    """The edges that can lie on a cycle: something leads to their source, and something follows their target."""
    while True:
        before = live.count()
        heads = live.select(*group, c("b").alias("a")).distinct()
        tails = live.select(*group, c("a").alias("b")).distinct()
        live = materialize(_join(_join(live, heads, [*group, "a"], "left_semi"), tails, [*group, "b"], "left_semi").select(*group, "a", "b"))
        if live.count() in (before, 0):
            return live


def _colours(live: DataFrame, group: list[str]) -> DataFrame:
    """(group, node, colour): the greatest node from which each one can be reached, itself included."""
    ends = live.select(*group, c("a").alias("node")).union(live.select(*group, c("b").alias("node"))).distinct()
    colours = materialize(ends.withColumn("colour", c("node")))
    changed = colours
    while True:
        sent = _join(live, changed.withColumnRenamed("node", "a"), [*group, "a"]).groupBy(*group, c("b").alias("node")).agg(F.max("colour").alias("sent"))
        changed = materialize(_join(colours, sent, [*group, "node"]).where(c("sent") > c("colour")).select(*group, "node", c("sent").alias("colour")))
        if changed.isEmpty():
            return colours
        colours = materialize(_join(colours, changed.withColumnRenamed("colour", "new"), [*group, "node"], "left").select(*group, "node", F.coalesce("new", "colour").alias("colour")))


def _backward(live: DataFrame, colours: DataFrame, group: list[str]) -> DataFrame:
    """(group, node, colour) of the nodes that reach the node their colour is named by: a strong component a colour."""
    near = materialize(_join(_join(live, colours.withColumnRenamed("node", "a"), [*group, "a"]), colours.select(*group, c("node").alias("b"), c("colour").alias("other")), [*group, "b"]).where(c("colour") == c("other")).select(*group, "a", "b", "colour"))
    frontier = colours.where(c("node") == c("colour"))
    found, waiting = [materialize(frontier)], materialize(colours.where(c("node") != c("colour")))
    while True:
        hit = _join(near, found[-1].withColumnRenamed("node", "b"), [*group, "b", "colour"]).select(*group, c("a").alias("node"), "colour").distinct()
        new = materialize(_join(waiting, hit, [*group, "node", "colour"], "left_semi").select(*group, "node", "colour"))
        if new.isEmpty():
            return reduce(DataFrame.unionByName, found)
        waiting = materialize(_join(waiting, new, [*group, "node", "colour"], "left_anti").select(*group, "node", "colour"))
        found.append(new)


def strong_components(edges: DataFrame, group: list[str]) -> DataFrame:
    """(group, node, unit) of the nodes on a cycle, ``unit`` the least node of the component; every
    other node is a component of its own.  Trimming takes the edges on no cycle off; colours run
    forward along the rest, and what reaches a colour's node backward inside its colour is a
    component; components are taken off until no edge is left."""
    live, found = _trimmed(edges, group), []
    while not live.isEmpty():
        part = materialize(_backward(live, _colours(live, group), group))
        found.append(part)
        gone = part.select(*group, "node")
        live = _join(_join(live, gone.withColumnRenamed("node", "a"), [*group, "a"], "left_anti"), gone.withColumnRenamed("node", "b"), [*group, "b"], "left_anti")
        live = _trimmed(materialize(live.select(*group, "a", "b")), group)
    if not found:
        return edges.select(*group, c("a").alias("node"), c("a").alias("unit")).limit(0)
    # A colour names one component: its node is gone after the round.
    every = reduce(DataFrame.unionByName, found)
    units = every.groupBy(*group, "colour").agg(F.min("node").alias("unit"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return _join(every, units, [*group, "colour"]).select(*group, "node", "unit")


def levels(nodes: DataFrame, edges: DataFrame, group: list[str], cycles: bool = False) -> DataFrame:
    """(group, node, level): 0 for a node that needs nothing, else one more than the greatest level it
    needs.  A round takes the edges to the last level's nodes off; a node whose last edge went follows.
    Edges and frontier shrink from round to round.  Nodes in a cycle or in need of one have no
    level: an error, or with ``cycles`` no row."""
    rest = materialize(edges)
    frontier = materialize(_join(nodes, rest.select(*group, c("a").alias("node")).distinct(), [*group, "node"], "left_anti").select(*group, "node", F.lit(0).alias("level")))
    rounds = [frontier]
    while not rest.isEmpty():
        done = frontier.select(*group, c("node").alias("b"))
        after = materialize(_join(rest, done, [*group, "b"], "left_anti").select(*group, "a", "b"))
        freed = _join(rest, done, [*group, "b"], "left_semi").select(*group, c("a").alias("node")).distinct()
        held = after.select(*group, c("a").alias("node")).distinct()
        frontier = materialize(_join(freed, held, [*group, "node"], "left_anti").select(*group, "node", F.lit(len(rounds)).alias("level")))
        if frontier.isEmpty():
            if not cycles:
                raise ValueError("the graph has a cycle")
            break
        rounds.append(frontier)
        rest = after
    return reduce(DataFrame.unionByName, rounds)


def load_units(nodes: DataFrame, edges: DataFrame, group: list[str], node: str = "table", needs: str = "parent") -> DataFrame:
    """An order that cycles do not stop: each strong component is one unit, units are ordered by level
    (what is needed first).  Columns: group, ``node``, unit (its least member), unit_size, level, and
    ``deferred``: what the node needs inside its own unit, itself included -- in a load, the keys to
    enable when the whole unit is there.  What is needed but not among the nodes does not count."""
    known = nodes.select(*group, c(node).alias("node")).distinct()
    every = _join(_join(edges.select(*group, c(node).alias("a"), c(needs).alias("b")), known.withColumnRenamed("node", "a"), [*group, "a"], "left_semi"), known.withColumnRenamed("node", "b"), [*group, "b"], "left_semi").distinct()
    every = materialize(every.select(*group, "a", "b"))
    proper = materialize(_edges(every, group, "a", "b"))
    units = materialize(_join(known, strong_components(proper, group), [*group, "node"], "left").select(*group, "node", F.coalesce("unit", "node").alias("unit")))
    ends = _join(_join(every, units.select(*group, c("node").alias("a"), c("unit").alias("ua")), [*group, "a"]), units.select(*group, c("node").alias("b"), c("unit").alias("ub")), [*group, "b"])
    ends = materialize(ends.select(*group, "a", "b", "ua", "ub"))
    order = levels(units.select(*group, c("unit").alias("node")).distinct(), _edges(ends, group, "ua", "ub"), group)
    inside = ends.where(c("ua") == c("ub")).groupBy(*group, c("a").alias("node")).agg(F.array_join(F.array_sort(F.collect_set("b")), ",").alias("deferred"))
    sizes = units.groupBy(*group, "unit").agg(F.count(F.lit(1)).alias("unit_size"))
    return _join(_join(_join(units, sizes, [*group, "unit"]), order.withColumnRenamed("node", "unit"), [*group, "unit"]), inside, [*group, "node"], "left").select(*group, c("node").alias(node), "unit", "unit_size", "level", F.coalesce("deferred", F.lit("")).alias("deferred"))


def closure(edges: DataFrame, group: list[str]) -> DataFrame:
    """(group, a, b): b is needed by a, directly or through others (a node on a cycle needs itself).
    Semi-naive with doubling: after r rounds all paths of up to 2**r steps are there, and a round
    extends only the pairs of the last one by all pairs.  Each round's new pairs are
    written once, beside those of the rounds before."""
    total = frontier = materialize(edges.select(*group, "a", "b"))
    while True:
        onward = total.select(*group, c("a").alias("b"), c("b").alias("end"))
        reached = _join(frontier, onward, [*group, "b"]).select(*group, "a", c("end").alias("b")).distinct()
        new = materialize(_join(reached, total, [*group, "a", "b"], "left_anti").select(*group, "a", "b"))
        if new.isEmpty():
            return total
        total, frontier = materialize(total.unionByName(new)), new


def impact(edges: DataFrame, group: list[str], source: str = "source", target: str = "target") -> DataFrame:
    """Per target: what needs it directly, and what needs it at all (itself not counted)."""
    direct = materialize(_edges(edges, group, source, target))
    near = direct.groupBy(*group, "b").agg(F.count(F.lit(1)).alias("direct"))
    far = closure(direct, group).where(c("a") != c("b")).groupBy(*group, "b").agg(F.count(F.lit(1)).alias("reached_by"))
    return _join(near, far, [*group, "b"]).select(*group, c("b").alias(target), "direct", "reached_by")
