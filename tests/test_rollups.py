"""Kept roll-ups equal the batch job, whatever the order of the uploads."""

import os

from migscope.operators import cobol as C
from migscope.plans import project as M
from migscope.plans import rollups as RU
from migscope.plans import score as K
from migscope.sources.corpus import read_corpus, to_lines
from migscope.sources.versioned import VersionedTable
from migscope.streaming import stream as ST

PROG = "       IDENTIFICATION DIVISION.\n       MAIN.\n" + "           IF A > 1\n           GO TO X\n           END-IF.\n"
FACTS = "project_id string, path string, type string, loc long, logic long, data long, risk long, seq long"


def totals_of(spark, path):
    return {(r.project_id, r.type): tuple(r[x] for x in RU.SUMS) for r in VersionedTable(spark, path).read().collect()}


def direct(state):
    out = {}
    for (p, _), (t, *v) in state.items():
        now = out.setdefault((p, t), [0] * 5)
        for k, x in enumerate((1, *v[:4])):
            now[k] += x
    return {k: tuple(v) for k, v in out.items()}


def test_totals_follow(spark, tmp_path):
    files, totals = str(tmp_path / "files"), str(tmp_path / "totals")
    RU.create(spark, spark.createDataFrame([("p", f"p/{k}", "a", k, 1, 2, 3, 1) for k in range(20)], FACTS), files, totals, 8)
    state = {("p", f"p/{k}"): ("a", k, 1, 2, 3, 1) for k in range(20)}
    assert totals_of(spark, totals) == direct(state)
    batches = [[("p", "p/3", "b", 50, 0, 0, 9, 5), ("q", "q/1", "a", 7, 1, 1, 1, 1)],  # a new type, a new project
               [("p", "p/3", "a", 1, 1, 1, 1, 4), ("p", "p/4", "a", 60, 5, 5, 5, 2), ("p", "p/4", "a", 70, 6, 6, 6, 3)],  # late, twice in a batch
               []]
    for n, rows in enumerate(batches):
        RU.upsert(VersionedTable(spark, files), spark.createDataFrame(rows, FACTS), "w", n)
        for p, f, *v in rows:
            if (p, f) not in state or state[p, f][5] < v[5]:
                state[p, f] = tuple(v)
        RU.upsert(VersionedTable(spark, files), spark.createDataFrame(rows, FACTS), "w", n)  # again: nothing happens
        read = RU.refresh(spark, files, totals)
        assert totals_of(spark, totals) == direct(state) and read <= len(rows) and RU.refresh(spark, files, totals) == 0
    # A refresh that did not happen in time: several versions at once, then more than are kept.
    for n in range(3, 9):
        RU.upsert(VersionedTable(spark, files), spark.createDataFrame([("p", f"p/{n}", "a", 1000 + n, 0, 0, 0, 9)], FACTS), "w", n)
        state["p", f"p/{n}"] = ("a", 1000 + n, 0, 0, 0, 9)
        if n in (4, 8):
            RU.refresh(spark, files, totals)
            assert totals_of(spark, totals) == direct(state)


def test_stream_portfolio_equals_batch(spark, tmp_path):
    land, files, totals, ck = (str(tmp_path / x) for x in ("land", "files", "totals", "ck"))
    RU.create(spark, spark.createDataFrame([], FACTS), files, totals, 4)

    now = str(tmp_path / "now")

    def put(upload, rel, text, when, last=True):
        for path in (os.path.join(land, upload, rel), *([os.path.join(now, rel)] if last else [])):
            os.makedirs(os.path.dirname(path), exist_ok=True)
            with open(path, "w") as f:
                f.write(text)
            os.utime(path, (when, when))

    def run():
        ST.stream_portfolio(spark, land, files, totals, ck).awaitTermination(120)
        metrics = C.cobol_files(to_lines(read_corpus(spark, now, "*.cbl")))
        assert {r.project_id: (r.total_files, r.total_loc) for r in RU.totals(spark, totals).collect()} == \
            {r.project_id: (r.total_files, r.total_loc) for r in M.totals(metrics).collect()}
        keep = ["project_id", "files", "total_loc", "logic_score", "data_score", "risk_score", "overall", "difficulty"]
        projects = metrics.select("project_id").distinct()
        assert sorted(map(tuple, RU.project_scores(spark, totals).select(keep).collect())) == \
            sorted(map(tuple, K.cobol_project_scores(projects, K.cobol_file_scores(metrics), with_details=False).select(keep).collect()))
        assert sorted(map(tuple, RU.type_distribution(spark, totals).collect())) == sorted(map(tuple, M.type_distribution(metrics).collect()))

    put("u1", "p1/A.cbl", PROG, 1_000_000)
    put("u1", "p1/B.cbl", PROG * 3, 1_000_000)
    put("u1", "p2/C.cbl", "       MAIN.\n", 1_000_000)
    run()
    put("u2", "p1/B.cbl", PROG, 1_000_100)
    put("u2", "p2/D.cbl", PROG * 20, 1_000_100)
    put("u3", "p1/B.cbl", PROG * 9, 1_000_050, last=False)  # an older state of it comes late
    run()
    assert len(VersionedTable(spark, files)._names("manifests")) <= 3
