"""COBOL metrics on literal programs with hand-computed values, quirks, and the
blocked depth scan against a sequential loop."""

import random
import re

from tests.conftest import SF, lines_df

from migscope.operators import cobol as C
from migscope.plans import project as M
from migscope.plans import queries as Q
from migscope.plans import score as K

PROG = "\n".join([
    "       IDENTIFICATION DIVISION.",
    "       PROGRAM-ID. DEMO.",
    "      * IF THIS IS A COMMENT CALL 'LOGGER'",
    "       DATA DIVISION.",
    "       01 WS-TAB OCCURS 5 TIMES.",
    "       05 WS-AMT PIC S9999V99 COMP-3.",
    "       PROCEDURE DIVISION.",
    "       MAIN-PARA.",
    "           IF WS-A > 1",
    "              IF WS-B > 2",
    "                 PERFORM CALC UNTIL WS-DONE",
    "              END-IF",
    "           END-IF.",
    "           EVALUATE WS-C",
    "              WHEN 1 GO TO EXIT-PARA",
    "           END-EVALUATE.",
    "           CALL 'SUBPGM' USING WS-A",
    "           COPY CUSTREC.",
    "           EXEC SQL SELECT 1 INTO :X FROM T END-EXEC.",
    "           OPEN INPUT F1 READ-F1",
    "\tif ws-x = 1",
    "       exit-para.",
    "       END-IF.",
    "",
])


def test_program_metrics(spark):
    f = C.cobol_files(lines_df(spark, {"p0/DEMO.cbl": PROG})).collect()[0].asDict()
    # LOC: 24 lines, 1 comment, 1 blank -> 22
    assert f["loc"] == 22
    assert f["name"] == "DEMO"
    # IF lines: ' IF ' twice (the tab-indented 'if' is neither ' IF ' nor 'IF ')
    # cc = 1 + 2 IF + 2 EVALUATE (incl. END-EVALUATE) + 1 PERFORM..UNTIL + 1 WHEN + 1 GO TO = 8
    assert f["complexity"] == 8
    assert f["max_if_depth"] == 2
    assert (f["goto"], f["evaluate"], f["perform"], f["copybook"], f["sql"]) == (1, 2, 1, 1, 1)
    assert f["fileops"] == 1 and f["occurs"] == 1 and f["comp3"] == 1 and f["pic"] == 1
    assert f["asm"] == 0 and f["sort_merge"] == 0 and f["report_writer"] is False


def test_lists_and_edges(spark):
    df = lines_df(spark, {"p0/DEMO.cbl": PROG})
    paras = [r.paragraph for r in C.cobol_paragraphs(df).orderBy("line_no").collect()]
    # END-IF. / END-EVALUATE. count as paragraphs, lower-case exit-para. does not
    assert paras == ["MAIN-PARA", "END-IF", "END-EVALUATE", "END-IF"]
    divs = [r.division for r in C.cobol_divisions(df).orderBy("line_no").collect()]
    assert divs == ["IDENTIFICATION DIVISION", "DATA DIVISION", "PROCEDURE DIVISION"]
    deps = list(C.dependency_lists(C.cobol_edges(df)).collect()[0].dependencies)
    # comment lines still yield edges, first-seen order
    assert deps == ["LOGGER", "SUBPGM", "CUSTREC"]


def _depth_loop(lines):
    cur = mx = 0
    for ln in lines:
        u, t = ln.upper(), ln.strip()
        if t.startswith("*"):
            continue
        if " IF " in u or u.startswith("IF "):
            cur += 1
            mx = max(mx, cur)
        if "END-IF" in u:
            cur = max(0, cur - 1)
    return mx


def test_blocked_depth_scan_equals_loop(spark):
    rnd = random.Random(7)
    vocab = ["   IF A", "   END-IF", "IF X END-IF", "   MOVE 1 TO A", "  * IF COMMENT", "   END-IF."]
    progs = {f"p0/R{i}.cbl": "\n".join(rnd.choice(vocab) for _ in range(rnd.randint(1, 60))) for i in range(60)}
    expect = {p: _depth_loop(t.split("\n")) for p, t in progs.items()}
    df = lines_df(spark, progs)
    for block in (3, 7, 1 << 16):     # tiny blocks force the cross-block combination
        got = {r.path: r.max_if_depth for r in C.cobol_files(df, block_lines=block).collect()}
        assert got == expect, block


def test_scores_and_top10(spark):
    df = lines_df(spark, {"p0/DEMO.cbl": PROG})
    files = C.cobol_files(df)
    s = K.cobol_file_scores(files).collect()[0]
    # logic: min(8/22*100*2, 40)=40 ; depth 2 -> 0 ; goto 10 ; evaluate 4 -> 54
    assert s.logic_score == 54
    # data: copy 5 + min(1/22*100*5,30)=22.727 + fileops 2 + occurs 3 -> 32.7 -> 33
    assert s.data_score == 33
    # risk: comp3 5 + pic 3 -> 8
    assert s.risk_score == 8
    assert s.overall == round(54 * 0.35 + 33 * 0.35 + 8 * 0.30)
    assert s.overall == 33 and s.difficulty == "Medium"
    assert list(s.logic_details) == ["GOTO statements present (1) - requires refactoring"]
    assert M.high_complexity_top10(files).count() == 0


def test_project_without_files_scores_zero(spark):
    projects = spark.createDataFrame([("p0",), ("empty",)], "project_id string")
    files = C.cobol_files(lines_df(spark, {"p0/DEMO.cbl": PROG}))
    ps = {r.project_id: r for r in K.cobol_project_scores(projects, K.cobol_file_scores(files)).collect()}
    assert ps["empty"].overall == 0 and ps["empty"].description == "No files analyzed"
    assert ps["p0"].files == 1


def test_project_metadata_reads_the_lines_once(spark):
    """Totals, scores and summary were three passes over the lines."""
    plan = Q.project_metadata(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan


def test_line_flags_with_guards(spark):
    """Lines around the guarded expressions, against Python's."""
    lines = ["  GO TO X", "GOTO Y", "GOTOX", " re-read", "READ-EMP", "REWRITE R", "UNDELETE", "DELETE D", "COMP-3.", "COMP-33", "packed-decimal", "PIC S9(5)", "pic 99999",
             "SORT-FILE", "RESORT", "release r", "\t* SORT", " IF A", "CALL 'A'", "copy b", "recall \"c\" copy d"]
    d = spark.createDataFrame([("p", str(i), 1, x) for i, x in enumerate(lines)], "project_id string, path string, line_no int, line string")
    got = {int(r.path): r for r in C.line_facts(d, hits=True).collect()}
    for i, x in enumerate(lines):
        code = not x.strip().startswith("*")
        for name, pattern in (("goto", C.RE_GOTO), ("fileops", C.RE_FILEOP), ("comp3", C.RE_COMP3), ("pic", C.RE_PIC), ("sort_merge", C.RE_SORT)):
            assert got[i][name] == int(code and re.search(pattern, x.upper(), re.A) is not None), (name, x)
        want = [m.group(1) for p in (C.RE_CALL, C.RE_COPY) if (m := re.search(p, x.upper()))]
        assert [h.target for h in got[i].hits] == want, x


def test_lines_without_targets_make_no_list(spark):
    """A line without CALL and COPY has no list of targets, and the trim of a line with a printable first
    character gives the same flags as the whole list of blanks (F11, F14, F18, F19)."""
    texts = ["MOVE A TO B", "CALL 'X' COPY B", "call y", "\t* CALL 'Z'", "", "\u3000\u00a0A", "\ufeff*IF ", "  *", "\x7f*"]
    lines = spark.createDataFrame([("p", "p/a.cbl", i, x) for i, x in enumerate(texts, start=1)], "project_id string, path string, line_no int, line string")
    rows = C.line_facts(lines, hits=True).orderBy("line_no").collect()
    assert [r.hits is None for r in rows] == [True, False, False, False, True, True, True, True, True]
    assert [[h.target for h in r.hits or []] for r in rows] == [[], ["X", "B"], [], ["Z"], [], [], [], [], []]
    assert [r.loc for r in rows] == [1, 1, 1, 0, 0, 1, 0, 0, 1]


def test_words_by_their_rare_letters(spark):
    """Flags of words found by a part first, against Python's search (F1)."""
    import random
    rng = random.Random(7)
    atoms = ["EVALUATE", "valuate", "PERFORM", "FORM", " UNTIL", "WHEN", "COPY ", "PY ", "EXEC SQL", "exec-sql", "EXEC", "OCCURS", "CURS", "REDEFINES", "FINES", "REPORT", "PORT", " SECTION", "END-IF", "-IF",
             " IF ", "IF ", "F ", "open", "PEN", "COMP-3", "MP-3", "PACKED-DECIMAL", " ", ".", "*"]
    lines = ["".join(rng.choice(atoms) for _ in range(rng.randint(1, 6))) for _ in range(2000)]
    d = spark.createDataFrame([("p", str(i), 1, x) for i, x in enumerate(lines)], "project_id string, path string, line_no int, line string")
    for r in C.line_facts(d).collect():
        x, u = lines[int(r.path)], lines[int(r.path)].upper()
        code = not x.strip().startswith("*")
        is_if = code and (" IF " in u or u.startswith("IF "))
        want = {"if_lines": is_if, "evaluate": "EVALUATE" in u, "perform": "PERFORM" in u, "perform_until": "PERFORM" in u and "UNTIL" in u, "when_lines": "WHEN" in u, "copybook": "COPY " in u,
                "sql": "EXEC SQL" in u or "EXEC-SQL" in u, "occurs": "OCCURS" in u, "redefines": "REDEFINES" in u, "report": "REPORT" in u and "SECTION" in u,
                "fileops": re.search(C.RE_FILEOP, u, re.A) is not None, "comp3": re.search(C.RE_COMP3, u, re.A) is not None}
        assert {n: bool(r[n]) for n in want} == {n: bool(code and v) for n, v in want.items()}, x
        assert r.delta == int(is_if) - int(code and "END-IF" in u), x
