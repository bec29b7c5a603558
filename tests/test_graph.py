"""Strong components, load units, reachability: against direct computation, cycles included."""

import itertools
import random

import pytest

from migscope.operators import graph as GR
from migscope.plans import project as M


def reach(edges):
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
    return {a: set(walk(a, out)) for a in {x for e in edges for x in e}}


def walk(a, out):
    seen, todo = set(), [a]
    while todo:
        for b in out.get(todo.pop(), ()):
            if b not in seen:
                seen.add(b)
                todo.append(b)
    return seen


def brute_units(nodes, edges):
    edges = {(a, b) for a, b in edges if a in nodes and b in nodes}
    far = reach({(a, b) for a, b in edges if a != b})
    unit = {n: min([n, *[m for m in far.get(n, ()) if n in far.get(m, ())]]) for n in nodes}

    def level(u, held=()):
        return max((1 + level(unit[b]) for a, b in edges if unit[a] == u and unit[b] != u), default=0)
    size = {u: sum(v == u for v in unit.values()) for u in unit.values()}
    return {n: (unit[n], size[unit[n]], level(unit[n]), ",".join(sorted(b for a, b in edges if a == n and unit[b] == unit[n]))) for n in nodes}


def graphs():
    rng = random.Random(3)
    yield {"a", "b", "c"}, set()
    yield {"a"}, {("a", "a")}
    yield {"a", "b", "c", "d", "e"}, {("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("e", "a"), ("d", "gone"), ("e", "e")}
    yield {"a", "b", "c", "d"}, {("a", "b"), ("b", "a"), ("c", "d"), ("d", "c"), ("b", "c")}  # one cycle below another
    for n, m in ((9, 12), (14, 18), (12, 40)):
        nodes = [f"n{k}" for k in range(n)]
        yield set(nodes), {(rng.choice(nodes), rng.choice(nodes)) for _ in range(m)}


def test_load_units(spark):
    nodes, edges, want = [], [], {}
    for k, (n, e) in enumerate(graphs()):
        g = f"p{k}"
        nodes += [(g, x) for x in n]
        edges += [(g, a, b) for a, b in e] * 2
        want |= {(g, x): v for x, v in brute_units(n, e).items()}
    edges += [("p0", None, "a"), ("p0", "a", None)]
    got = GR.load_units(spark.createDataFrame(nodes, "project_id string, table string"), spark.createDataFrame(edges, "project_id string, table string, parent string"), ["project_id"])
    assert {(r.project_id, r.table): (r.unit, r.unit_size, r.level, r.deferred) for r in got.collect()} == want


def test_empty_graph(spark):
    nodes = spark.createDataFrame([], "project_id string, table string")
    edges = spark.createDataFrame([], "project_id string, table string, parent string")
    assert GR.load_units(nodes, edges, ["project_id"]).collect() == []
    assert GR.impact(edges, ["project_id"], "table", "parent").collect() == []


def test_impact_ends_on_cycles(spark):
    e = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "c"), ("d", "d"), *itertools.pairwise(f"k{j:02}" for j in range(20))]
    got = {r.target: (r.direct, r.reached_by) for r in GR.impact(spark.createDataFrame([("p", *x) for x in e], "project_id string, source string, target string"), ["project_id"]).collect()}
    far = reach({x for x in e if x[0] != x[1]})
    want = {t: (sum(x[1] == t and x[0] != t for x in set(e)), sum(t in v for a, v in far.items() if a != t)) for t in {x[1] for x in e if x[0] != x[1]}}
    assert got == want and got["k19"] == (1, 19)


def test_levels_of_a_cycle(spark):
    with pytest.raises(ValueError):
        GR.levels(spark.createDataFrame([("a",), ("b",)], "node string"), spark.createDataFrame([("a", "b"), ("b", "a")], "a string, b string"), [])


def test_rollup_of_null_groups(spark):
    """A null project or type is a group like others, told from a total by the grouping id."""
    rows = [("p", "x", 1), ("p", "x", 2), ("p", None, 4), (None, "x", 8), (None, None, 16)]
    got = {(r.project_id, r.type, r.grouping): (r["count"], r.loc, r.percentage) for r in M.portfolio_rollup(spark.createDataFrame(rows, "project_id string, type string, loc long")).collect()}
    assert got == {("p", "x", 0): (2, 3, 67), ("p", None, 0): (1, 4, 33), (None, "x", 0): (1, 8, 50), (None, None, 0): (1, 16, 50),
                   ("p", None, 1): (3, 7, 60), (None, None, 1): (2, 24, 40), (None, None, 3): (5, 31, 100)}


def test_no_join_passes_the_driver(spark):
    """Broadcast sides of all rounds were the most of what the driver received."""
    tables = spark.createDataFrame([("g", x) for x in "abc"], "project_id string, `table` string")
    keys = spark.createDataFrame([("g", "a", "b"), ("g", "b", "a"), ("g", "c", "a")], "project_id string, `table` string, parent string")
    units = GR.load_units(tables, keys, ["project_id"])
    assert "Broadcast" not in units._jdf.queryExecution().executedPlan().toString()
    assert {(r.table, r.unit, r.level) for r in units.collect()} == {("a", "a", 0), ("b", "a", 0), ("c", "c", 1)}
