"""Stream = batch for the streaming twins (availableNow triggers)."""

import datetime as dt
import os

from migscope.operators import cobol as C
from migscope.operators import validate as V
from migscope.sources.corpus import read_corpus, to_lines
from migscope.streaming import stream as ST

PROG_A = "       IDENTIFICATION DIVISION.\n       MAIN.\n           IF A > 1\n           END-IF.\n"
PROG_B = "      * comment\n           EVALUATE X\n              WHEN 1 GO TO Z\n"


def test_stream_corpus_equals_batch(spark, tmp_path):
    land = tmp_path / "land"
    for proj, name, text in [("p1", "src/A.cbl", PROG_A), ("p2", "B C+d.cbl", PROG_B)]:
        os.makedirs((land / proj / name).parent, exist_ok=True)
        (land / proj / name).write_text(text)
    sink, ck = str(tmp_path / "sink"), str(tmp_path / "ck")
    q = ST.stream_corpus(spark, str(land), sink, ck)
    q.awaitTermination(120)
    got = {r.path: (r.project_id, r.loc, r.complexity) for r in ST.read_metrics(spark, sink).collect()}
    batch = C.cobol_files(to_lines(read_corpus(spark, str(land), "*.cbl")))
    assert got == {r.path: (r.project_id, r.loc, r.complexity) for r in batch.collect()}
    assert set(got) == {"p1/src/A.cbl", "p2/B C+d.cbl"} and got["p1/src/A.cbl"][0] == "p1"
    # a program uploaded again counts once, as it is now; a new checkpoint runs every file again
    (land / "p1" / "src" / "A.cbl").write_text(PROG_A + PROG_A)
    ST.stream_corpus(spark, str(land), sink, ck).awaitTermination(120)
    ST.stream_corpus(spark, str(land), sink, str(tmp_path / "ck-again")).awaitTermination(120)
    again = {r.path: r.loc for r in ST.read_metrics(spark, sink).collect()}
    assert again["p1/src/A.cbl"] > got["p1/src/A.cbl"][1] and again["p2/B C+d.cbl"] == got["p2/B C+d.cbl"][1] and len(again) == 2


def test_stream_alerts_equals_batch(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, t0 + dt.timedelta(seconds=17 * i), 1, "error" if i % 5 == 0 else "view", float(i), "{}")
            for i in range(200)]
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    ev = spark.createDataFrame(rows, schema)
    src = str(tmp_path / "events")
    ev.write.parquet(src)
    sink, ck = str(tmp_path / "alerts"), str(tmp_path / "ck2")
    q = ST.stream_alerts(spark, src, ev.schema, sink, ck, watermark="0 seconds")
    q.awaitTermination(120)
    streamed = {(r.window_start, r.events, r.errors) for r in spark.read.parquet(sink).collect()}
    batch = {(r.window_start, r.events, r.errors) for r in V.alerts(ev).collect()}
    # availableNow closes with the final watermark: every window but possibly the last is emitted
    assert streamed <= batch and len(batch - streamed) <= 1 and len(streamed) > 0


def test_stream_delta_equals_batch(spark, tmp_path):
    base = spark.createDataFrame([(k, f"v{k}") for k in range(1, 41)], "k long, v string")
    base_path = str(tmp_path / "base")
    ST.write_bucketed(base, ["k"], base_path, buckets=8)
    ch = spark.createDataFrame([(2, "b2", "U", 1), (3, None, "D", 1), (41, "d", "I", 1), (2, "b3", "U", 2)]
                               + [(k, None, "D", 1) for k in range(5, 41)],   # empties whole buckets
                               "k long, v string, op string, seq int")
    cdir = str(tmp_path / "changes")
    ch.write.parquet(cdir)
    q = ST.stream_delta(spark, cdir, ch.schema, base_path, ["k"], str(tmp_path / "ck3"))
    q.awaitTermination(120)
    got = {r.k: r.v for r in ST.read_bucketed(spark, base_path).collect()}
    assert got == {r.k: r.v for r in V.apply_delta(base, ch, ["k"]).collect()} == {1: "v1", 2: "b3", 4: "v4", 41: "d"}


def test_stream_delta_keeps_the_newer_change(spark, tmp_path):
    """A change that arrives late, and a batch that runs again."""
    schema = "k long, v string, op string, seq int"
    base_path, cdir = str(tmp_path / "base"), str(tmp_path / "changes")
    assert ST.write_bucketed(spark.createDataFrame([(k, f"v{k}") for k in range(9)], "k long, v string"), ["k"], base_path) == 1
    run = lambda ck: ST.stream_delta(spark, cdir, spark.createDataFrame([], schema).schema, base_path, ["k"], str(tmp_path / ck)).awaitTermination(120)
    rows = lambda: {r.k: r.v for r in ST.read_bucketed(spark, base_path).collect()}
    spark.createDataFrame([(1, "nine", "U", 9), (2, None, "D", 9)], schema).write.mode("append").parquet(cdir)
    run("ck")
    spark.createDataFrame([(1, "two", "U", 2), (2, "two", "U", 2), (3, "two", "U", 2)], schema).write.mode("append").parquet(cdir)
    run("ck")
    want = {k: f"v{k}" for k in range(9) if k != 2} | {1: "nine", 3: "two"}
    assert rows() == want
    run("ck-again")
    assert rows() == want


def test_stream_episodes_equal_batch(spark, tmp_path):
    """Four runs on one checkpoint, rows late but within the watermark, and one beyond it that both leave out."""
    import random

    from pyspark.sql import functions as F
    rng = random.Random(1)
    t0 = dt.datetime(2024, 1, 1)
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    rows = [(i, t0 + dt.timedelta(seconds=rng.randint(0, 4 * 3600)), rng.randint(0, 2), "error" if rng.random() < 0.3 else "view", rng.random() * 1000, "") for i in range(400)]
    rows.sort(key=lambda r: r[1])
    for k in (149, 299):  # change places with a row up to nine minutes later
        late = next(j for j in range(k + 1, len(rows)) if rows[j][1] > rows[k][1] + dt.timedelta(minutes=4))
        rows[k], rows[late - 1] = rows[late - 1], rows[k]
    flush = [(9999, t0 + dt.timedelta(days=2), 99, "view", 1.0, "")]
    dropped = [(10000, t0, 0, "error", 999.0, "")]
    limits = {"error_rate": (0.2, 0.6), "response": (500.0, 800.0)}
    src, sink, ck = (str(tmp_path / x) for x in ("events", "episodes", "ck"))
    for part in (rows[:150], rows[150:300], rows[300:] + flush, dropped):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
        q = ST.stream_alert_episodes(spark, src, spark.createDataFrame([], schema).schema, F.col("user_id"), sink, ck, 1800, watermark="10 minutes", limits=limits)
        q.awaitTermination(180)
        assert q.exception() is None
    events = spark.createDataFrame(rows + flush, schema)
    want = V.alert_episodes(V.alert_windows(events, F.col("user_id"), limits=limits), 1800)
    got = spark.read.parquet(sink)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.select(got.columns).collect()), key=str)
    reasons = {r.reason for r in got.collect()}
    assert reasons == {"cleared", "no data"} and got.where("windows > 1").count() > 5


def test_episodes_by_hand(spark):
    t0 = dt.datetime(2024, 1, 1)
    m = lambda k: t0 + dt.timedelta(minutes=k)
    w = [("s", "x", m(a), m(a + 1), r) for a, r in [(0, 0), (1, 1), (2, 2), (3, 0), (4, 1), (9, 1), (15, 1), (16, 0), (20, 2)]] + [("t", "x", m(0), m(1), 1), ("u", "x", m(30), m(31), 0)]
    got = V.alert_episodes(spark.createDataFrame(w, "series string, metric string, window_start timestamp, window_end timestamp, rank int"), 300)
    at = lambda x: x and (x - t0).seconds // 60
    rows = sorted((r.series, at(r.raised_at), at(r.last_seen), r.windows, r.level, at(r.closed_at), r.reason) for r in got.collect())
    assert rows == [("s", 1, 3, 2, "CRITICAL", 3, "cleared"), ("s", 4, 10, 2, "WARNING", 15, "no data"), ("s", 15, 16, 1, "WARNING", 16, "cleared"),
                    ("s", 20, 21, 1, "CRITICAL", 26, "no data"), ("t", 0, 1, 1, "WARNING", 6, "no data")]
    still = V.alert_episodes(spark.createDataFrame(w[:2], "series string, metric string, window_start timestamp, window_end timestamp, rank int"), 300).collect()
    assert [(r.reason, r.closed_at) for r in still] == [("open", None)]
