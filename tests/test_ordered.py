"""Ordered checksum: a fold in key order, independent of the partitions, that leads to the differing ranges."""

import hashlib

import pytest

from migscope.operators import validate as V

SCHEMA = "k long, v string"


def top(tree):
    rows = tree.orderBy("level").collect()
    return [(r.rows, r.h0, r.s0, r.h1, r.s1) for r in rows if r.level == rows[-1].level]


def fold(rows):
    """Direct: the digests in key order, one after another."""
    out = []
    for prime, base in V.ORDERED:
        h, s = 0, 1
        for k, v in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, digest(r))):
            h, s = (h * base + digest((k, v)) % prime + 1) % prime, s * base % prime
        out += [h, s]
    return [(len(rows), *out)]


def digest(row):
    text = "".join("N;" if x is None else f"{len(str(x))}:{x};" for x in row)
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


@pytest.mark.parametrize("keys", [range(300), [5], [-70_000, -3, -1, 0, 2, 90_000], [1 << 62, -(1 << 62), 0], [None, None, 3, 3, 9]])
def test_top_is_the_fold(spark, keys):
    rows = [(k, f"v{j}") for j, k in enumerate(keys)]
    for parts in (1, 5):
        tree = V.ordered_checksum(spark.createDataFrame(rows[::-1], SCHEMA).repartition(parts), "k", width_bits=3, fan_bits=2)
        assert top(tree) == fold(rows)


def test_a_swap_shows(spark):
    rows = [(k, f"v{k}") for k in range(200)]
    swapped = [(k, f"v{ {50: 51, 51: 50}.get(k, k) }") for k in range(200)]
    a, b = (V.ordered_checksum(spark.createDataFrame(r, SCHEMA), "k", cols=["v"], width_bits=3) for r in (rows, swapped))
    assert top(a) != top(b)
    same = V.reconcile_checksum(*[spark.createDataFrame(r, SCHEMA) for r in (rows, swapped)], ["k"], cols=["v"], buckets=1).collect()[0]
    assert same.status == "MATCH"  # the unordered form cannot see it
    d = V.ordered_diff(a, b).collect()
    assert {r.node for r in d if r.level == 0} == {6}


def test_differing_ranges(spark):
    src = spark.createDataFrame([(k, f"v{k}") for k in range(-500, 5000)] + [(None, "n")], SCHEMA)
    tgt = spark.createDataFrame([(k, "x" if k == 77 else f"v{k}") for k in range(-500, 5000) if k != 3000] + [(None, "m"), (60_000, "new")], SCHEMA)
    a, b = (V.ordered_checksum(t, "k", width_bits=4) for t in (src, tgt))
    d = V.ordered_diff(a, b)
    leaves = {r.node: (r.source_rows, r.target_rows) for r in d.where("level = 0").collect()}
    assert leaves == {77 >> 4: (16, 16), 3000 >> 4: (16, 15), 60_000 >> 4: (0, 1), -(1 << 63) >> 4: (1, 1)}
    near = [V.differing_rows(t, d, "k", width_bits=4) for t in (src, tgt)]
    assert near[0].count() == 33
    assert {(r.k, r.status) for r in V.diff_rows(*near, ["k"]).collect()} == {(77, "changed"), (3000, "missing"), (60_000, "extra"), (None, "changed")}
    assert V.ordered_diff(a, a).collect() == [] and V.differing_rows(src, V.ordered_diff(a, a), "k", width_bits=4).count() == 0


def test_empty_side(spark):
    src, none = spark.createDataFrame([(k, "v") for k in range(40)], SCHEMA), spark.createDataFrame([], SCHEMA)
    d = V.ordered_diff(V.ordered_checksum(src, "k", width_bits=2), V.ordered_checksum(none, "k", width_bits=2))
    assert sum(r.source_rows for r in d.where("level = 0").collect()) == 40
    assert V.ordered_checksum(none, "k").collect() == []


def test_merged_quantiles(spark):
    """Weekly figures from daily sketches: rank error under 1 % of the rows, exact count and mean."""
    import random
    from pyspark.sql import functions as F
    rng = random.Random(2)
    rows = [(d, rng.lognormvariate(3, 1.5)) for d in range(14) for _ in range(8000)] + [(3, None)]
    df = spark.createDataFrame(rows, "day int, ms double").repartition(6)
    daily = V.latency_sketches(df, [F.col("day")], "ms")
    weekly = {r.week: r for r in V.merged_latency(daily, [F.floor(F.col("day") / 7).alias("week")]).collect()}
    for w, r in weekly.items():
        values = sorted(v for d, v in rows if d // 7 == w and v is not None)
        assert r.n == len(values) and abs(r.mean_latency - sum(values) / len(values)) < 1e-6
        for q, got in ((0.5, r.p50), (0.95, r.p95), (0.99, r.p99)):
            at = sum(v <= got for v in values) / len(values)
            assert abs(at - q) < 0.01
    exact = {r.week: r.p for r in V.exact_percentile(df.withColumn("week", F.floor(F.col("day") / 7)), ["week"], "ms", 0.5, "p").collect()}
    assert all(abs(weekly[w].p50 / exact[w] - 1) < 0.05 for w in weekly)
