"""Corpus scan from files, extension selection, admission, sinks."""

import os

from pyspark.sql import functions as F

from migscope.plans import report as R
from migscope.sources import corpus as S


def _write(root, rel, data: bytes):
    p = os.path.join(root, rel)
    os.makedirs(os.path.dirname(p), exist_ok=True)
    with open(p, "wb") as f:
        f.write(data)


def test_read_corpus_select_and_admit(spark, tmp_path):
    root = str(tmp_path / "uploads")
    _write(root, "p1/A.cbl", b"       MAIN.\n")
    _write(root, "p1/sub/B.CBL", b"X\n")
    _write(root, "p1/bad.java", b"class A { String s = \"\xff\xfe\"; }\n")
    _write(root, "p2/c.sql", b"CREATE TABLE t (a INT);\n")
    files = S.read_corpus(spark, root)
    rows = {r.path: r for r in files.collect()}
    assert set(rows) == {"p1/A.cbl", "p1/sub/B.CBL", "p1/bad.java", "p2/c.sql"}
    assert rows["p1/A.cbl"].project_id == "p1" and rows["p1/A.cbl"].ext == ".cbl"
    assert "�" in rows["p1/bad.java"].content          # invalid UTF-8 repaired, not failed
    # analysis-time selection is case-sensitive: .CBL is not analysed
    assert [r.path for r in S.select_kind(files, [".cbl"]).collect()] == ["p1/A.cbl"]
    # listing only: no content column read
    assert "content" not in S.read_corpus(spark, root, with_content=False).columns
    projects = spark.createDataFrame([("p1", "COBOL-to-Java"), ("p2", "Unknown-type")],
                                     "project_id string, migration_type string")
    adm = {r.path: r.admitted for r in S.admit(files, projects).collect()}
    # admission is case-insensitive; unknown migration type admits everything
    assert adm == {"p1/A.cbl": True, "p1/sub/B.CBL": True, "p1/bad.java": False, "p2/c.sql": True}
    rep = {r.project_id: r for r in S.admission_report(S.admit(files, projects)).collect()}
    assert rep["p1"].valid_files == 2 and rep["p1"].skipped_files == 1 and rep["p1"].first_skipped == "bad.java"


def test_lines_keep_trailing_empty_line(spark):
    f = spark.createDataFrame([("p", "a", "x\ny\n")], "project_id string, path string, content string")
    assert [r.line for r in S.to_lines(f).orderBy("line_no").collect()] == ["x", "y", ""]


def test_write_reports_and_metadata(spark, tmp_path):
    rows = spark.createDataFrame(
        [("p1", "doc", 0, "0000", "# T"), ("p1", "doc", 10, "1|b", "line b"), ("p1", "doc", 10, "1|a", "line a"),
         ("p2", "doc", 0, "0000", "# U")], "project_id string, doc string, section int, sub string, line string")
    out = str(tmp_path / "reports")
    R.write_reports(rows, out)
    txt = spark.read.text(f"{out}/project_id=p1/doc=doc").collect()
    assert [r.value for r in txt] == ["# T", "line a", "line b"]
    assert {(r.project_id, r.doc, r.lines, r.sections) for r in R.document_list(rows).collect()} == {("p1", "doc", 3, 2), ("p2", "doc", 1, 1)}
    md = spark.createDataFrame([("p1", 3, "Low")], "project_id string, total_files int, difficulty string")
    R.write_metadata(md, str(tmp_path / "meta"))
    j = spark.read.json(str(tmp_path / "meta/json")).collect()[0]
    assert j.project_id == "p1" and '"total_files":3' in j.json


def test_dashboard_tiles_by_family(spark):
    """One literal project of each migration type."""
    types = ["COBOL-to-Java", "PostgreSQL-to-Oracle", "Oracle-to-PostgreSQL", "MySQL-to-Oracle", "Unknown"]
    ctx = spark.createDataFrame([(f"p{k}", t) for k, t in enumerate(types)], "project_id string, migration_type string")
    db = spark.createDataFrame([(f"p{k}", 7, 2, 3) for k in range(4)], "project_id string, tables long, stored_procedures long, functions long")
    totals = spark.createDataFrame([(f"p{k}", 11, 500) for k in range(4)], "project_id string, total_files long, total_loc long")
    scores = spark.createDataFrame([("p0", "High"), ("p1", "Low")], "project_id string, difficulty string")
    tiles = lambda **k: {r.project_id: tuple(r)[1:] for r in R.dashboard_tiles(ctx, db, totals, scores, **k).collect()}
    assert tiles() == {"p0": (11, 500, 7, "High"), "p1": (7, 500, 3, "Low"), "p2": (7, 500, 3, "Unknown"), "p3": (7, 500, 3, "Unknown"), "p4": (0, 0, 0, "Unknown")}
    assert tiles(corrected=True)["p1"] == (7, 500, 5, "Low")


def test_read_lines_over_small_splits(spark, tmp_path):
    """Lines and numbers are those of whole files, with borders of splits everywhere."""
    import random

    from migscope.operators import cobol as C
    rng = random.Random(4)
    root = str(tmp_path / "big")
    atoms = ["a", "é", "中文", "🙂", "\r", " ", "x" * 40, "\t", "\x0b", "\x0c", "\u2028", "\x85"]
    for k in range(4):
        text = "\n".join("".join(rng.choices(atoms, k=rng.randint(0, 9))) + rng.choice(["", "\r"]) for _ in range(rng.randint(0, 30)))
        _write(root, f"p{k % 3}/dir {k}/f+{k}.cbl", (text + rng.choice(["", "\n", "\r\n", "\n\n"])).encode())
    for name, data in {"empty": b"", "feed": b"\n", "bom": "\ufeffone\ntwo\n".encode(), "bom1": "\ufeffone".encode(), "bad": b"\xff\n\xe4\xb8\n\xad x\n" * 9, "cr": b"a\rb\rc",
                       "one": b"no feed", "long": b"z" * 300 + b"\n" + b"y" * 150}.items():
        _write(root, f"q/{name}.cbl", data)
    _write(root, "q/code.cbl", b"       PROCEDURE DIVISION.\n" + b"           IF A > 1\n             IF B > 1\n             END-IF\n           END-IF.\r\n" * 4)
    _write(root, "q/other.txt", b"not chosen")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    want = S.to_lines(S.read_corpus(spark, root, "*.cbl"))
    lines = sorted(map(tuple, want.collect()))
    metrics = sorted(map(tuple, C.cobol_files(want).collect()))
    try:
        for size in ("64", "1000000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            got = S.read_lines(spark, root, "*.cbl")
            assert sorted(map(tuple, got.collect())) == lines
        assert sorted(map(tuple, C.cobol_files(got).collect())) == metrics
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
