"""DuckDB oracle for the COBOL operators: the straightforward one-window form of
every rule (whole file in one window), written independently of the Spark plan."""

from migscope.plans.rules import PROJECTS_SQL
from migscope.sources.generated import COBOL_BY_PART, COBOL_BY_SUPP, cobol_lines_sql
from oracle.common import b, for_duckdb, js_trim, load_units_ctes, rnd


def lines_cte(variant=COBOL_BY_PART) -> str:
    return f"lines AS ({for_duckdb(cobol_lines_sql(**variant))})"


def files_cte(variant=COBOL_BY_PART) -> str:
    """CTEs lines, fl, run, files (one row per program)."""
    return f"""{lines_cte(variant)},
prep AS (
  SELECT project_id, path, line_no, line, upper(line) AS u, {js_trim('line')} AS t FROM lines),
fl AS (
  SELECT project_id, path, line_no, NOT starts_with(t, '*') AS code, u, t,
    {b("t <> '' AND NOT starts_with(t, '*')")} AS loc,
    {b("NOT starts_with(t, '*') AND (contains(u, ' IF ') OR starts_with(u, 'IF '))")} AS is_if,
    {b("NOT starts_with(t, '*') AND contains(u, 'END-IF')")} AS end_if,
    {b("NOT starts_with(t, '*') AND contains(u, 'EVALUATE')")} AS evaluate,
    {b("NOT starts_with(t, '*') AND contains(u, 'PERFORM')")} AS perform,
    {b("NOT starts_with(t, '*') AND contains(u, 'PERFORM') AND contains(u, 'UNTIL')")} AS perform_until,
    {b("NOT starts_with(t, '*') AND contains(u, 'WHEN')")} AS when_l,
    {b("NOT starts_with(t, '*') AND (regexp_matches(u, '\\bGO\\s+TO\\b') OR regexp_matches(u, '\\bGOTO\\b'))")} AS goto,
    {b("NOT starts_with(t, '*') AND contains(u, 'COPY ')")} AS copybook,
    {b("NOT starts_with(t, '*') AND (contains(u, 'EXEC SQL') OR contains(u, 'EXEC-SQL'))")} AS sql,
    {b("NOT starts_with(t, '*') AND regexp_matches(u, '\\b(OPEN|READ|WRITE|CLOSE|REWRITE|DELETE)\\b')")} AS fileops,
    {b("NOT starts_with(t, '*') AND contains(u, 'OCCURS')")} AS occurs,
    {b("NOT starts_with(t, '*') AND contains(u, 'REDEFINES')")} AS redefines,
    {b("NOT starts_with(t, '*') AND (regexp_matches(u, '\\bCOMP-3\\b') OR regexp_matches(u, '\\bPACKED-DECIMAL\\b'))")} AS comp3,
    {b("NOT starts_with(t, '*') AND contains(u, 'CALL') AND (contains(u, 'ILBOA') OR contains(u, 'ASMX'))")} AS asm,
    {b("NOT starts_with(t, '*') AND regexp_matches(u, 'PIC\\s+[^.\\s]*[SVP9X]{5,}')")} AS pic,
    {b("NOT starts_with(t, '*') AND regexp_matches(u, '\\b(SORT|MERGE|RELEASE|RETURN)\\b')")} AS sort_merge,
    {b("NOT starts_with(t, '*') AND contains(u, 'REPORT') AND contains(u, 'SECTION')")} AS report
  FROM prep),
run AS (
  SELECT *, sum(is_if - end_if) OVER w AS s FROM fl
  WINDOW w AS (PARTITION BY project_id, path ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
run2 AS (
  SELECT *, s - least(0, min(s) OVER w) AS d FROM run
  WINDOW w AS (PARTITION BY project_id, path ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
run3 AS (
  SELECT *, CASE WHEN is_if = 1 THEN lag(d, 1, 0) OVER (PARTITION BY project_id, path ORDER BY line_no) + 1 END AS peak
  FROM run2),
files AS (
  SELECT project_id, path,
    upper(CASE WHEN regexp_extract(path, '([^/]+)$', 1) LIKE '%.cbl' AND length(regexp_extract(path, '([^/]+)$', 1)) > 4
               THEN left(regexp_extract(path, '([^/]+)$', 1), length(regexp_extract(path, '([^/]+)$', 1)) - 4)
               ELSE regexp_extract(path, '([^/]+)$', 1) END) AS name,
    'COBOL Program' AS type,
    CAST(sum(loc) AS BIGINT) AS loc,
    CAST(1 + sum(is_if) + sum(evaluate) + sum(perform_until) + sum(when_l) + sum(goto) AS BIGINT) AS complexity,
    CAST(coalesce(max(peak), 0) AS BIGINT) AS max_if_depth,
    CAST(sum(goto) AS BIGINT) AS goto, CAST(sum(evaluate) AS BIGINT) AS evaluate,
    CAST(sum(perform) AS BIGINT) AS perform, CAST(sum(copybook) AS BIGINT) AS copybook,
    CAST(sum(sql) AS BIGINT) AS sql, CAST(sum(fileops) AS BIGINT) AS fileops,
    CAST(sum(occurs) AS BIGINT) AS occurs, CAST(sum(redefines) AS BIGINT) AS redefines,
    CAST(sum(comp3) AS BIGINT) AS comp3, CAST(sum(asm) AS BIGINT) AS asm,
    CAST(sum(pic) AS BIGINT) AS pic, CAST(sum(sort_merge) AS BIGINT) AS sort_merge,
    max(report) = 1 AS report_writer
  FROM run3 GROUP BY project_id, path)"""


def scores_cte() -> str:
    """fs: file scores (after files_cte)."""
    return f""",
fs0 AS (
  SELECT *,
    least({rnd("least(CAST(complexity AS DOUBLE) / greatest(loc, 1) * 100 * 2, 40) + (CASE WHEN max_if_depth > 5 THEN 20 WHEN max_if_depth > 3 THEN 10 WHEN max_if_depth > 2 THEN 5 ELSE 0 END) + least(goto * 10, 30) + least(evaluate * 2, 10)")}, 100) AS logic_score,
    least({rnd("least(copybook * 5, 25) + least(CAST(sql AS DOUBLE) / greatest(loc, 1) * 100 * 5, 30) + least(fileops * 2, 20) + least(occurs * 3, 15) + least(redefines * 3, 10)")}, 100) AS data_score,
    least({rnd("least(comp3 * 5, 25) + least(asm * 20, 40) + least(pic * 3, 15) + least(sort_merge * 3, 10) + (CASE WHEN report_writer THEN 10 ELSE 0 END)")}, 100) AS risk_score
  FROM files),
fs AS (
  SELECT *, {rnd("logic_score * CAST(0.35 AS DOUBLE) + data_score * CAST(0.35 AS DOUBLE) + risk_score * CAST(0.30 AS DOUBLE)")} AS overall FROM fs0)"""


def difficulty(x: str) -> str:
    return (f"CASE WHEN {x} < 30 THEN 'Low' WHEN {x} < 60 THEN 'Medium' WHEN {x} < 80 THEN 'High' "
            f"ELSE 'Very High' END")


DESC = ("CASE WHEN {x} < 30 THEN 'Low migration difficulty - straightforward conversion expected with minimal refactoring' "
        "WHEN {x} < 60 THEN 'Medium migration difficulty - moderate refactoring required, standard migration patterns applicable' "
        "WHEN {x} < 80 THEN 'High migration difficulty - significant redesign needed, complex legacy patterns present' "
        "ELSE 'Very high migration difficulty - extensive redesign required, critical COBOL-specific features in use' END")


def details_cte() -> str:
    """det(project_id, path, cat, i, detail) after scores_cte."""
    rows = [
        ("logic", 1, "complexity > 20", "'High cyclomatic complexity (' || complexity || ')'"),
        ("logic", 2, "max_if_depth > 3", "'Deep nesting detected (' || max_if_depth || ' levels)'"),
        ("logic", 3, "goto > 0", "'GOTO statements present (' || goto || ') - requires refactoring'"),
        ("logic", 4, "evaluate > 5", "'Multiple EVALUATE statements (' || evaluate || ')'"),
        ("data", 1, "copybook > 3", "'High COPYBOOK usage (' || copybook || ') - data structure mapping needed'"),
        ("data", 2, "sql > 10", "'Embedded SQL detected (' || sql || ' statements)'"),
        ("data", 3, "fileops > 10", "'Multiple file operations (' || fileops || ')'"),
        ("data", 4, "occurs > 2", "'Arrays/tables present (' || occurs || ' OCCURS clauses)'"),
        ("data", 5, "redefines > 2", "'Union types detected (' || redefines || ' REDEFINES)'"),
        ("risk", 1, "comp3 > 0", "'COMP-3/Packed decimal fields (' || comp3 || ') - custom conversion required'"),
        ("risk", 2, "asm > 0", "'Assembly language calls detected (' || asm || ') - critical risk'"),
        ("risk", 3, "pic > 5", "'Complex PIC clauses (' || pic || ')'"),
        ("risk", 4, "sort_merge > 0", "'SORT/MERGE operations (' || sort_merge || ')'"),
        ("risk", 5, "report_writer", "'Report Writer in use - requires complete redesign'"),
    ]
    u = " UNION ALL ".join(
        f"SELECT project_id, path, '{cat}' AS cat, {i} AS i, {expr} AS detail FROM fs WHERE {cond}"
        for cat, i, cond, expr in rows)
    return f""",
det AS ({u}),
detf AS (
  SELECT project_id, cat, detail, path, i,
         row_number() OVER (PARTITION BY project_id, cat, detail ORDER BY path, i) AS rn FROM det),
pdet AS (
  SELECT project_id, cat, detail, row_number() OVER (PARTITION BY project_id, cat ORDER BY path, i) AS ord
  FROM detf WHERE rn = 1)"""


def file_detail_string(cat: str) -> str:
    return (f"coalesce((SELECT string_agg(detail, '; ' ORDER BY i) FROM det d WHERE d.project_id = fs.project_id "
            f"AND d.path = fs.path AND d.cat = '{cat}'), '')")


def project_scores_cte() -> str:
    return f""",
projects AS ({for_duckdb(PROJECTS_SQL)}),
pagg AS (
  SELECT project_id, count(*) AS files,
    {rnd("CAST(sum(logic_score) AS DOUBLE) / count(*)")} AS logic_score,
    {rnd("CAST(sum(data_score) AS DOUBLE) / count(*)")} AS data_score,
    {rnd("CAST(sum(risk_score) AS DOUBLE) / count(*)")} AS risk_score
  FROM fs GROUP BY project_id),
ps0 AS (
  SELECT p.project_id, CAST(coalesce(a.files, 0) AS BIGINT) AS files,
    coalesce(a.logic_score, 0) AS logic_score, coalesce(a.data_score, 0) AS data_score,
    coalesce(a.risk_score, 0) AS risk_score,
    CASE WHEN a.files IS NULL THEN 0 ELSE {rnd("a.logic_score * CAST(0.35 AS DOUBLE) + a.data_score * CAST(0.35 AS DOUBLE) + a.risk_score * CAST(0.30 AS DOUBLE)")} END AS overall
  FROM projects p LEFT JOIN pagg a USING (project_id)),
ps AS (
  SELECT *, {difficulty('overall')} AS difficulty,
    CASE WHEN files > 0 THEN {DESC.format(x='overall')} ELSE 'No files analyzed' END AS description,
    coalesce((SELECT string_agg(detail, '; ' ORDER BY ord) FROM pdet WHERE pdet.project_id = ps0.project_id AND cat = 'logic'), '') AS logic_details,
    coalesce((SELECT string_agg(detail, '; ' ORDER BY ord) FROM pdet WHERE pdet.project_id = ps0.project_id AND cat = 'data'), '') AS data_details,
    coalesce((SELECT string_agg(detail, '; ' ORDER BY ord) FROM pdet WHERE pdet.project_id = ps0.project_id AND cat = 'risk'), '') AS risk_details
  FROM ps0)"""


def edges_cte() -> str:
    """edges(project_id, path, target, first_pos, kind) after lines_cte."""
    return """,
hits AS (
  SELECT project_id, path, line_no * 2 AS pos, regexp_extract(upper(line), 'CALL\\s+[''"]([^''"]+)[''"]', 1) AS target, 'CALL' AS kind FROM lines
  UNION ALL
  SELECT project_id, path, line_no * 2 + 1, regexp_extract(upper(line), 'COPY\\s+([A-Z0-9\\-]+)', 1), 'COPY' FROM lines),
edges AS (
  SELECT project_id, path, target, CAST(min(pos) AS BIGINT) AS first_pos, arg_min(kind, pos) AS kind
  FROM hits WHERE target <> '' GROUP BY project_id, path, target)"""


METRIC_COLS = ("project_id, path, name, type, loc, complexity, max_if_depth, goto, evaluate, perform, copybook, "
               "sql, fileops, occurs, redefines, comp3, asm, pic, sort_merge, report_writer")


def sql() -> dict[str, str]:
    F = "WITH " + files_cte()
    S = F + scores_cte()
    q = {}
    q["cobol_metrics"] = F + f"\nSELECT {METRIC_COLS} FROM files"
    q["cobol_loc"] = F + "\nSELECT project_id, path, name, loc FROM files"
    q["cobol_if_depth"] = F + "\nSELECT project_id, path, max_if_depth FROM files"
    q["cobol_divisions"] = "WITH " + lines_cte() + """
SELECT project_id, path, line_no, upper(regexp_extract(line, '(?i)(IDENTIFICATION|ENVIRONMENT|DATA|PROCEDURE)\\s+DIVISION', 1)) || ' DIVISION' AS division
FROM lines WHERE regexp_extract(line, '(?i)(IDENTIFICATION|ENVIRONMENT|DATA|PROCEDURE)\\s+DIVISION', 1) <> ''"""
    q["cobol_paragraphs"] = "WITH " + lines_cte() + f""",
p AS (SELECT project_id, path, line_no, regexp_extract({js_trim('line')}, '^([A-Z][A-Z0-9\\-]+)\\.\\s*\\z', 1) AS paragraph FROM lines)
SELECT * FROM p WHERE paragraph <> '' AND paragraph <> 'DIVISION'"""
    q["cobol_edges"] = "WITH " + lines_cte() + edges_cte() + "\nSELECT * FROM edges"
    q["cobol_file_scores"] = S + details_cte() + f"""
SELECT project_id, path, name, logic_score, data_score, risk_score, overall,
  {difficulty('overall')} AS difficulty, {DESC.format(x='overall')} AS description,
  {file_detail_string('logic')} AS logic_details, {file_detail_string('data')} AS data_details,
  {file_detail_string('risk')} AS risk_details
FROM fs"""
    q["cobol_project_scores"] = S + details_cte() + project_scores_cte() + """
SELECT project_id, files, logic_score, data_score, risk_score, overall, difficulty, description,
  logic_details, data_details, risk_details FROM ps"""
    q["cobol_details"] = S + details_cte() + "\nSELECT project_id, cat AS category, CAST(ord AS BIGINT) AS ord, detail FROM pdet"
    q["cobol_priority"] = F + """
SELECT project_id, path, name, type, loc, complexity,
  CASE WHEN complexity > 30 OR loc > 1000 THEN 'High' WHEN complexity > 15 OR loc > 500 THEN 'Medium' ELSE 'Low' END AS priority
FROM files"""
    q["cobol_type_distribution"] = F + """,
g AS (SELECT project_id, type, count(*) AS cnt FROM files GROUP BY project_id, type)
SELECT project_id, type, CAST(cnt AS BIGINT) AS count,
  CAST(floor(CAST(cnt AS DOUBLE) / sum(cnt) OVER (PARTITION BY project_id) * 100 + 0.5) AS BIGINT) AS percentage
FROM g"""
    q["kept_scores"] = S + details_cte() + project_scores_cte() + """
SELECT project_id, files, (SELECT CAST(sum(loc) AS BIGINT) FROM files f WHERE f.project_id = ps.project_id) AS total_loc, logic_score, data_score, risk_score, overall, difficulty
FROM ps WHERE files > 0"""
    q["portfolio_rollup"] = F + """,
g AS (SELECT project_id, type, count(*) AS cnt, sum(loc) AS loc, grouping(project_id, type) AS grp FROM files GROUP BY ROLLUP (project_id, type))
SELECT project_id, type, CAST(cnt AS BIGINT) AS count, CAST(loc AS BIGINT) AS loc, CAST(grp AS BIGINT) AS grouping,
  CAST(floor(CAST(cnt AS DOUBLE) / CASE grp WHEN 0 THEN (SELECT count(*) FROM files f WHERE f.project_id = g.project_id) ELSE (SELECT count(*) FROM files) END * 100 + 0.5) AS BIGINT) AS percentage
FROM g"""
    calls = "WITH RECURSIVE " + files_cte() + edges_cte() + """,
e AS (SELECT DISTINCT e.project_id, f.name AS a, e.target AS b FROM edges e JOIN files f USING (project_id, path) WHERE f.name <> e.target),
reach(project_id, a, b) AS (SELECT project_id, a, b FROM e UNION SELECT r.project_id, r.a, e.b FROM reach r JOIN e ON e.project_id = r.project_id AND e.a = r.b)"""
    q["dep_impact"] = calls + """
SELECT project_id, b AS target, CAST(direct AS BIGINT) AS direct, CAST(reached AS BIGINT) AS reached_by
FROM (SELECT project_id, b, count(*) AS direct FROM e GROUP BY ALL) JOIN (SELECT project_id, b, count(*) AS reached FROM reach WHERE a <> b GROUP BY ALL) USING (project_id, b)"""
    q["dep_waves"] = "WITH RECURSIVE " + files_cte() + edges_cte() + """,
nodes AS (SELECT project_id, name AS node FROM files),
every AS (SELECT DISTINCT e.project_id, f.name AS a, e.target AS b FROM edges e JOIN files f USING (project_id, path) JOIN files t ON t.project_id = e.project_id AND t.name = e.target)""" \
        + load_units_ctes() + "\nSELECT project_id, node AS name, unit, unit_size, CAST(level + 1 AS INTEGER) AS wave FROM load_units"
    q["cobol_top10"] = top10_sql(files_cte(COBOL_BY_SUPP))
    q["dep_graph"] = "WITH " + files_cte() + edges_cte() + """,
e AS (SELECT DISTINCT e.project_id, f.name AS source, e.target FROM edges e JOIN files f USING (project_id, path)),
o AS (SELECT project_id, source AS name, count(*) AS c FROM e GROUP BY 1, 2),
i AS (SELECT project_id, target AS name, count(*) AS c FROM e GROUP BY 1, 2)
SELECT f.project_id, f.name, CAST(coalesce(o.c, 0) AS BIGINT) AS out_degree, CAST(coalesce(i.c, 0) AS BIGINT) AS in_degree
FROM files f LEFT JOIN o USING (project_id, name) LEFT JOIN i USING (project_id, name)"""
    q["dep_unresolved"] = "WITH " + files_cte() + edges_cte() + """
SELECT DISTINCT project_id, target FROM edges e
WHERE NOT EXISTS (SELECT 1 FROM files f WHERE f.project_id = e.project_id AND f.name = e.target)"""
    q["cobol_risks"] = S + details_cte() + project_scores_cte() + edges_cte_after_files() + """,
tl AS (SELECT project_id, sum(loc) AS total_loc FROM files GROUP BY 1),
td AS (SELECT project_id, count(*) AS total_deps FROM edges GROUP BY 1),
x AS (SELECT ps.*, coalesce(tl.total_loc, 0) AS total_loc, coalesce(td.total_deps, 0) AS total_deps
      FROM ps LEFT JOIN tl USING (project_id) LEFT JOIN td USING (project_id))
SELECT project_id, 'R-001' AS id, 'Migration Complexity' AS category,
  'Migration difficulty score is ' || overall || '/100 (' || difficulty || ')' AS description,
  CASE WHEN overall >= 80 THEN 'Critical' ELSE 'High' END AS severity FROM x WHERE overall >= 60
UNION ALL SELECT project_id, 'R-002', 'Logic Complexity', 'Logic complexity score: ' || logic_score || '/100. ' || logic_details, 'High' FROM x WHERE logic_score >= 60
UNION ALL SELECT project_id, 'R-003', 'Data Complexity', 'Data complexity score: ' || data_score || '/100. ' || data_details, 'High' FROM x WHERE data_score >= 60
UNION ALL SELECT project_id, 'R-004', 'COBOL-specific Risk', 'COBOL-specific risk score: ' || risk_score || '/100. ' || risk_details, 'Critical' FROM x WHERE risk_score >= 60
UNION ALL SELECT project_id, 'R-005', 'Scale', 'Large codebase with ' || format('{:,}', total_loc) || ' lines of code', 'Medium' FROM x WHERE total_loc > 100000
UNION ALL SELECT project_id, 'R-006', 'Dependencies', 'High number of inter-module dependencies (' || total_deps || ')', 'Medium' FROM x WHERE total_deps > 50"""
    q["metadata_lists"] = metadata_lists_sql(q)
    return q


def top10_sql(cte: str) -> str:
    return "WITH " + cte + """,
r AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY complexity DESC, path) AS rk
      FROM files WHERE complexity > 20)
SELECT project_id, CAST(rk AS BIGINT) AS rank, path, name, complexity AS score,
  CASE WHEN complexity > 40 THEN 'High' ELSE 'Medium' END AS risk,
  CASE WHEN complexity > 40 THEN 'Consider breaking into smaller modules during migration'
       ELSE 'Review and simplify logic where possible' END AS recommendation
FROM r WHERE rk <= 10"""


def metadata_lists_sql(q: dict[str, str]) -> str:
    deps = "WITH " + files_cte() + edges_cte() + """
SELECT f.project_id, f.path, f.name AS source, string_agg(e.target, ', ' ORDER BY e.first_pos) AS targets
FROM files f JOIN edges e USING (project_id, path) GROUP BY f.project_id, f.path, f.name"""
    lists = [("programs", q["cobol_priority"], "path", ["name", "type", "loc", "complexity", "priority"]),
             ("file_type_distribution", q["cobol_type_distribution"], "type", ["type", "count", "percentage"]),
             ("dependencies", deps, "path", ["source", "targets"]),
             ("high_complexity_modules", top10_sql(files_cte()), "path", ["name", "score", "risk", "recommendation"]),
             ("risks", q["cobol_risks"], "id", ["id", "category", "description", "severity"])]
    item = lambda cols: "{" + ", ".join(f"'{x}': {x}" for x in cols) + "}"
    return "\nUNION ALL ".join(f"SELECT project_id, '{n}' AS list, {k} AS key, CAST(to_json({item(cols)}) AS VARCHAR) AS item FROM ({sql})"
                               for n, sql, k, cols in lists)


def edges_cte_after_files() -> str:
    return edges_cte()
