"""Migration data checks on small literal tables."""

from migscope.operators import validate as V


def _orders(spark, rows):
    return spark.createDataFrame(rows, "k long, a string, b double")


def test_counts_checksum_diff(spark):
    src = _orders(spark, [(1, "x", 1.0), (2, "y", 2.0), (3, None, 3.0)])
    tgt = _orders(spark, [(1, "x", 1.0), (3, None, 4.0), (4, "z", 5.0)])
    cnt = {r.table_name: r for r in V.reconcile_counts([("o", src, tgt), ("only_src", src, None)]).collect()}
    assert cnt["o"].status == "PASS" and cnt["only_src"].status == "FAIL" and cnt["only_src"].target_rows is None
    d = {r.k: (r.status, r.changed_columns) for r in V.diff_rows(src, tgt, ["k"]).collect()}
    assert d == {2: ("missing", ""), 3: ("changed", "b"), 4: ("extra", "")}
    assert V.diff_rows(src, src, ["k"]).count() == 0
    same = V.reconcile_checksum(src, src, ["k"], buckets=4).where("status <> 'MATCH'").count()
    diff = V.reconcile_checksum(src, tgt, ["k"], buckets=4).where("status <> 'MATCH'").count()
    assert same == 0 and diff >= 1


def test_orphans_nulls_rules_conversion(spark):
    parent = spark.createDataFrame([(1,), (2,)], "id long")
    child = spark.createDataFrame([(10, 1), (11, 3), (12, None)], "cid long, pid long")
    assert [r.cid for r in V.orphans(child, parent, ["pid"], ["id"]).collect()] == [11]
    n = {r.column_name: r.nulls for r in V.null_profile(child, "c").collect()}
    assert n == {"cid": 0, "pid": 1}
    r = {x.rule: x.violations for x in V.check_rules(child, [("pos", "cid > 10"), ("has_parent", "pid IS NOT NULL")]).collect()}
    assert r == {"pos": 1, "has_parent": 1}
    df = spark.createDataFrame([(1.25, "abcdef"), (100000.5, "ab")], "x double, s string")
    loss = {x.column_name: x.lost for x in V.conversion_loss(df, [("x", "decimal(6,1)"), ("s", "varchar(3)")]).collect()}
    assert loss == {"x": 2, "s": 1}


def test_delta_and_load_order(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k long, v string")
    ch = spark.createDataFrame([(2, "b1", "U", 1), (2, "b2", "U", 2), (3, None, "D", 1), (4, "d", "I", 1)],
                               "k long, v string, op string, seq int")
    out = {r.k: r.v for r in V.apply_delta(base, ch, ["k"]).collect()}
    assert out == {1: "a", 2: "b2", 4: "d"}
    nodes = spark.createDataFrame([("p", t) for t in ["a", "b", "c", "x", "y"]], "project_id string, table string")
    edges = spark.createDataFrame([("p", "b", "a"), ("p", "c", "b"), ("p", "c", "a"), ("p", "x", "y"), ("p", "y", "x")],
                                  "project_id string, table string, parent string")
    lv = {r.table: r.level for r in V.load_order(nodes, edges, ["project_id"]).collect()}
    assert lv == {"a": 0, "b": 1, "c": 2, "x": None, "y": None}     # x <-> y is a cycle


def test_alerts_and_slo(spark):
    import datetime as dt
    t0 = dt.datetime(2024, 1, 1, 0, 0, 0)
    rows = [(t0 + dt.timedelta(seconds=s), et, v) for s, et, v in
            [(1, "view", 100.0), (2, "error", 3000.0), (61, "view", 10.0), (62, "view", 20.0)]]
    ev = spark.createDataFrame(rows, "ts timestamp, event_type string, value double")
    a = {r.window_start.minute: (r.error_level, r.response_level) for r in V.alerts(ev).collect()}
    assert a == {0: ("CRITICAL", "WARNING"), 1: ("OK", "OK")}
    from pyspark.sql import functions as F
    s = V.latency_slo(ev, [F.lit(1).alias("g")], "value", F.col("event_type") == "error", 2000.0, 5000.0).collect()[0]
    assert s.errors == 1 and s.status == "FAIL"


def test_migrate_table_writes_and_reconciles(spark, tmp_path):
    from pyspark.sql import functions as F
    src = spark.createDataFrame([(1, 1.25, True), (2, 2.5, None)], "k long, amount double, flag boolean")
    conv = {"amount": F.col("amount").cast("decimal(10,2)"), "flag": V.bool_to_number(F.col("flag"), keep_null=True)}
    out, differing = V.migrate_table(src, conv, ["k"], sink=str(tmp_path / "t"))
    assert differing.collect() == []
    rows = {r.k: (float(r.amount), r.flag) for r in out.collect()}
    assert rows == {1: (1.25, 1), 2: (2.5, None)}
    nulls = {r.column_name: r.status for r in V.compare_nulls(src, out, "t").collect()}
    assert nulls == {"k": "PASS", "amount": "PASS", "flag": "PASS"}


def _status(df):
    return {r.status for r in df.collect()}


def test_checksum_sees_every_change(spark):
    import datetime as dt
    t = dt.datetime(2024, 1, 1, 1, 1, 1, 5)
    schema = "k long, a string, b string, x double, t timestamp"
    row = (1, None, "x", 1.0, t)
    changed = [(1, "x", None, 1.0, t), (1, None, "x", 1.00001, t), (1, None, "x", 1.0, t.replace(microsecond=6)), (1, None, "x", 1.0 + 2**-52, t)]
    src = spark.createDataFrame([row], schema)
    for digest in ("xxhash64", "md5"):
        sums = lambda a, b: V.reconcile_checksum(a, b, ["k"], buckets=2, digest=digest, bucket_by="key")  # noqa: B023, E731
        assert _status(sums(src, src)) == {"MATCH"}
        for other in changed:
            assert _status(sums(src, spark.createDataFrame([other], schema))) == {"MISMATCH"}, (digest, other)
        parts = lambda a, b: spark.createDataFrame([(1, a, b, 0.0, t)], schema)
        assert _status(sums(parts("a|b", "c"), parts("a", "b|c"))) == {"MISMATCH"}
        assert _status(sums(parts("1:a;", "c"), parts("1", "a;c"))) == {"MISMATCH"}
        twice = lambda v: spark.createDataFrame([(1, v, v, 0.0, t)] * 2, schema)
        assert _status(sums(twice("u"), twice("v"))) == {"MISMATCH"}


def test_diff_of_null_and_repeated_keys(spark):
    rows = [(None, "n", 1.0), (1, "x", 1.0), (1, "y", 2.0), (1, "y", 2.0), (2, None, None)]
    src = _orders(spark, rows)
    assert V.diff_rows(src, _orders(spark, rows[::-1]), ["k"]).collect() == []
    assert V.diff_rows(src, src, ["k"], keep_same=True).groupBy("status").count().collect()[0]["count"] == 5
    tgt = _orders(spark, [(None, "n", 2.0), (1, "x", 1.0), (1, "y", 2.0), (2, None, None), (2, None, None), (3, "z", 0.0)])
    got = sorted(((r.k, r.status, r.changed_columns) for r in V.diff_rows(src, tgt, ["k"]).collect()), key=str)
    assert got == sorted([(None, "changed", "b"), (1, "missing", ""), (2, "extra", ""), (3, "extra", "")], key=str)


def test_diff_rows_set_and_sample_n(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "k long")
    b = spark.createDataFrame([(1,), (3,)], "k long")
    assert sorted((r.k, r.side) for r in V.diff_rows_set(a, b).collect()) == [(1, "source_only"), (2, "source_only"), (3, "target_only")]
    big = spark.range(1000).withColumnRenamed("id", "k")
    first = {r.k for r in V.sample_n(big, "k", 17).collect()}
    assert len(first) == 17 and first == {r.k for r in V.sample_n(big.repartition(7), "k", 17).collect()}
    assert first != {r.k for r in V.sample_n(big, "k", 17, seed=1).collect()}


def test_array_to_csv(spark):
    df = spark.createDataFrame([(1, [1, 2]), (2, []), (3, None)], "k long, v array<int>")
    assert {r.k: r.v for r in V.array_to_csv(df, "v").collect()} == {1: "1,2", 2: "", 3: None}


def test_orphans_of_a_table_that_references_itself(spark):
    t = spark.createDataFrame([(1, None), (2, 1), (3, 9)], "id long, boss long")
    assert [r.id for r in V.orphans(t, t, ["boss"], ["id"]).collect()] == [3]


def test_charset_counts_lost_rows(spark):
    src = spark.createDataFrame([(1, "é"), (2, "b"), (None, "n")], "k long, v string")
    tgt = spark.createDataFrame([(1, "e"), (4, "d"), (None, "n")], "k long, v string")
    r = V.charset_check(src, tgt, "k", "v").collect()[0]
    assert (r["rows"], r.missing_rows, r.extra_rows, r.value_mismatches, r.byte_length_mismatches) == (2, 1, 1, 1, 1)


def test_json_compare(spark):
    src = spark.createDataFrame([(1, '{"a": 1}'), (2, '{"a":1}'), (3, '{"a":1}'), (4, "{}"), (5, None)], "k long, v string")
    tgt = spark.createDataFrame([(1, '{"a":1}'), (2, '{"a":2}'), (3, '{"a":'), (5, None), (6, "{}")], "k long, v string")
    got = {r.k: r.status for r in V.json_compare(src, tgt, "k", "v").collect()}
    assert got == {1: "same", 2: "changed", 3: "invalid", 4: "missing", 5: "same", 6: "extra"}


def test_delta_without_operation_and_with_late_changes(spark):
    schema = "k long, v string, op string, seq int"
    base = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k long, v string")
    ch = spark.createDataFrame([(1, "x", None, 5), (2, "y", "?", 5), (3, "z1", "U", 7), (3, "z2", "U", 7)], schema)
    want = {1: "a", 2: "b", 3: "z2"}
    assert {r.k: r.v for r in V.apply_delta(base, ch, ["k"]).collect()} == want
    state = base.selectExpr("k", "v", "cast(null as long) _seq", "false _deleted")
    one = V.apply_delta_state(state, spark.createDataFrame([(1, "new", "U", 9), (2, None, "D", 9)], schema), ["k"])
    for _ in range(2):      # the second time nothing changes
        one = V.apply_delta_state(one, spark.createDataFrame([(1, "old", "U", 2), (2, "old", "U", 3), (4, "d", "I", 1)], schema), ["k"])
    assert {r.k: (r.v, r._deleted) for r in one.collect()} == {1: ("new", False), 2: ("b", True), 3: ("c", False), 4: ("d", False)}


def test_load_order_of_a_long_chain(spark):
    n = 70
    nodes = spark.createDataFrame([("p", f"t{k}") for k in range(n)] + [("p", "x"), ("p", "y"), ("p", "below")], "project_id string, table string")
    edges = spark.createDataFrame([("p", f"t{k + 1}", f"t{k}") for k in range(n - 1)] + [("p", "t69", "t3"), ("p", "x", "y"), ("p", "y", "x"), ("p", "below", "x")],
                                  "project_id string, table string, parent string")
    got = {r.table: (r.level, r.status) for r in V.load_order(nodes, edges, ["project_id"]).collect()}
    assert got == {f"t{k}": (k, "ordered") for k in range(n)} | {t: (None, "cycle") for t in ("x", "y", "below")}


def test_object_diff(spark):
    schema = "table_name string, kind string, name string, definition string"
    a = spark.createDataFrame([("t", "primary key", "pk", "id"), ("t", "index", "i1", "a"), ("t", "check", "c1", "x > 0"), ("t", "table", "t", None)], schema)
    b = spark.createDataFrame([("t", "primary key", "pk", "id"), ("t", "index", "i1", "b"), ("t", "view", "v", "q"), ("t", "table", "t", None)], schema)
    assert {(r.kind, r.name): r.status for r in V.object_diff(a, b, ["table_name"]).collect()} == {
        ("index", "i1"): "different", ("check", "c1"): "missing_in_target", ("view", "v"): "extra_in_target"}


def test_exact_percentile(spark):
    import random
    rng = random.Random(1)
    rows = [(g, rng.choice([rng.gauss(0, 1), rng.expovariate(0.001), 5.0])) for g in ["a", "b", None] for _ in range(500)]
    rows += [("one", 3.0), ("same", 2.0), ("same", 2.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    for q in (0.0, 0.5, 0.95, 1.0):
        got = {r.g: r.p for r in V.exact_percentile(df, ["g"], "v", q, "p").collect()}
        for g in {g for g, _ in rows}:
            v = sorted(x for h, x in rows if h == g and x is not None)
            if not v:
                assert got[g] is None
                continue
            pos = q * (len(v) - 1)
            lo, hi = v[int(pos)], v[min(len(v) - 1, int(pos) + (pos > int(pos)))]
            assert abs(got[g] - (lo + (hi - lo) * (pos - int(pos)))) < 1e-9 * max(1, abs(hi))
    assert V.exact_percentile(df.limit(0), ["g"], "v", 0.5, "p").collect() == []
