"""DuckDB oracle for corpus admission, uploads, lines and report tables."""

from migscope.operators import validate as V
from migscope.plans import queries as Q
from migscope.plans import report as R
from migscope.plans.rules import ADMISSION_RULES, MIGRATION_TYPES, PROJECTS_SQL
from migscope.sources.generated import (COBOL_BY_PART, cobol_paths_sql, ddl_files_sql, java_files_sql,
                                        orm_files_sql)
from oracle import cobol as OC
from oracle import ddl as OD
from oracle import pg as OP
from oracle.common import for_duckdb


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


LISTING = f"""listing AS (
  SELECT project_id, path, regexp_extract(path, '([^/]+)$', 1) AS file_name FROM (
    {for_duckdb(cobol_paths_sql(**COBOL_BY_PART))}
    UNION ALL SELECT project_id, path FROM ({for_duckdb(ddl_files_sql())})
    UNION ALL SELECT project_id, path FROM ({for_duckdb(java_files_sql())})
    UNION ALL SELECT project_id, path FROM ({for_duckdb(orm_files_sql())})))"""
RULES = " UNION ALL ".join(f"SELECT {lit(t)} AS migration_type, {lit(e)} AS ext" for t, exts in ADMISSION_RULES for e in exts)
ADMIT = f"""{LISTING},
projects AS ({for_duckdb(PROJECTS_SQL)}),
rules AS ({RULES}),
adm AS (
  SELECT l.project_id, l.path, l.file_name, p.migration_type,
    CASE WHEN NOT EXISTS (SELECT 1 FROM rules r WHERE r.migration_type = p.migration_type) THEN true
         ELSE EXISTS (SELECT 1 FROM rules r WHERE r.migration_type = p.migration_type AND ends_with(lower(l.file_name), r.ext)) END AS admitted
  FROM listing l LEFT JOIN projects p USING (project_id))"""


def sql() -> dict[str, str]:
    q = {}
    q["admission"] = "WITH " + ADMIT + "\nSELECT project_id, path, file_name, migration_type, admitted FROM adm"
    q["admission_report"] = "WITH " + ADMIT + """,
sk AS (SELECT project_id, file_name, row_number() OVER (PARTITION BY project_id ORDER BY file_name, path) AS rk
       FROM adm WHERE NOT admitted)
SELECT project_id, CAST(count(*) FILTER (WHERE admitted) AS BIGINT) AS valid_files,
  CAST(count(*) FILTER (WHERE NOT admitted) AS BIGINT) AS skipped_files,
  coalesce((SELECT string_agg(file_name, ', ' ORDER BY rk) FROM sk WHERE sk.project_id = adm.project_id AND rk <= 10), '') AS first_skipped
FROM adm GROUP BY project_id"""
    q["latest_files"] = f"""WITH u AS ({for_duckdb(Q.UPLOADS_SQL)})
SELECT project_id, file_name, arg_max(path, (upload_ts, path)) AS path,
  strftime(arg_max(upload_ts, (upload_ts, path)), '%Y-%m-%d %H:%M:%S') AS upload_ts, arg_max(size, (upload_ts, path)) AS size
FROM u GROUP BY project_id, file_name"""
    q["java_lines"] = f"""WITH jf AS ({for_duckdb(java_files_sql())})
SELECT project_id, path, CAST(generate_subscripts(string_split(content, chr(10)), 1) AS INTEGER) AS line_no,
  unnest(string_split(content, chr(10))) AS line FROM jf"""
    d = R.CONTEXT_DEFAULTS
    mt = " UNION ALL ".join(f"SELECT {lit(v)} AS migration_type, {lit(sl)} AS sl, {lit(tl)} AS tl"
                            for v, _, sl, tl in MIGRATION_TYPES)
    q["report_context"] = f"""WITH projects AS ({for_duckdb(PROJECTS_SQL)}), mt AS ({mt})
SELECT project_id, name AS project_name, migration_type,
  coalesce(sl, {lit(d['source_language'])}) AS source_language, {lit(d['source_database'])} AS source_database,
  {lit(d['app_server'])} AS app_server, {lit(d['os'])} AS os, coalesce(tl, {lit(d['target_language'])}) AS target_language,
  {lit(d['framework'])} AS framework, {lit(d['target_database'])} AS target_database, {lit(d['deployment'])} AS deployment,
  {lit(Q.REPORT_DATE)} AS generated_date, {lit(d['version'])} AS version, {lit(d['author'])} AS author
FROM projects LEFT JOIN mt USING (migration_type)"""
    checks = "\nUNION ALL ".join(
        f"SELECT doc_id, {lit(n)} AS \"check\", {'' if must else 'NOT '}regexp_matches(text, {lit(p)}) AS passed FROM documents"
        for n, p, must in V.DOC_CHECKS)
    q["doc_quality"] = checks
    # totals and database blocks of the PostgreSQL plans
    jfo = f"jf AS ({for_duckdb(java_files_sql())}), of0 AS ({for_duckdb(orm_files_sql())})"
    q["total_files"] = f"""WITH {jfo},
a AS (SELECT project_id, count(*) AS n FROM jf GROUP BY 1), b AS (SELECT project_id, count(*) AS n FROM of0 GROUP BY 1)
SELECT coalesce(a.project_id, b.project_id) AS project_id, CAST(coalesce(a.n, 0) + coalesce(b.n, 0) AS BIGINT) AS total_files
FROM a FULL JOIN b ON a.project_id = b.project_id"""
    allddl = f"files AS ({for_duckdb(ddl_files_sql())})"
    q["expected_objects"] = "WITH " + allddl + OD.STMTS + """,
db AS (SELECT project_id, sum(tables) AS tables, sum(sequences) AS sequences, sum(views) AS views,
         sum(functions) AS functions, sum(stored_procedures) AS stored_procedures FROM ftot GROUP BY project_id)
SELECT project_id, tables || ' tables created' AS ddl_001, sequences || ' sequences + new SERIAL sequences' AS ddl_007,
  views || ' views work correctly' AS ddl_010, CAST(functions AS BIGINT) AS functions_to_test,
  CAST(stored_procedures AS BIGINT) AS procedures_to_test FROM db"""
    q["pg_source_block"] = ("WITH jf AS (" + for_duckdb(java_files_sql()) + ")" + OP.BASE + OP.QUERIES + ",\n" + allddl
                            + OD.STMTS + OP.ddl_feature_ctes() + OP.java_project_ctes() + OP.scores_cte() + """
SELECT project_id, array_to_string(extension_list, ', ') AS extensions, native_queries AS native_query_count,
  coalesce((SELECT string_agg(type, ', ' ORDER BY fat) FROM ptu WHERE ptu.project_id = sc.project_id), '') AS data_types,
  coalesce((SELECT string_agg(type, ', ' ORDER BY fat) FROM pix WHERE pix.project_id = sc.project_id), '') AS index_types
FROM sc""")
    # COBOL dashboard tiles and the as-is report rows
    CW = "WITH " + OC.files_cte() + OC.scores_cte() + OC.details_cte() + OC.project_scores_cte()
    ddl_all = f",\nallddl AS ({for_duckdb(ddl_files_sql())})"
    ddlw = ddl_all + OD.STMTS.replace("FROM files)", "FROM allddl)").replace("FROM (SELECT DISTINCT project_id, path FROM st) f)",
                                                                          "FROM (SELECT DISTINCT project_id, path FROM st) f)")
    PGW = ("WITH jf AS (" + for_duckdb(java_files_sql()) + ")" + OP.BASE + OP.QUERIES + ",\n" + allddl + OD.STMTS
           + OP.ddl_feature_ctes() + OP.java_project_ctes() + OP.scores_cte())
    q["dashboard_tiles"] = f"""
SELECT p.project_id,
  CAST(CASE WHEN p.is_db THEN coalesce(db.tables, 0) ELSE coalesce(ct.total_files, 0) END AS BIGINT) AS tile_files_or_tables,
  CAST(CASE WHEN p.is_db THEN coalesce(jt.total_loc, 0) ELSE coalesce(ct.total_loc, 0) END AS BIGINT) AS tile_loc,
  CAST(CASE WHEN p.is_db THEN coalesce(db.functions, 0) ELSE coalesce(db.tables, 0) END AS BIGINT) AS tile_programs,
  coalesce(CASE WHEN p.is_db THEN pg.difficulty ELSE cs.difficulty END, 'Unknown') AS tile_difficulty
FROM (SELECT *, migration_type IN ('PostgreSQL-to-Oracle', 'Oracle-to-PostgreSQL', 'MySQL-to-Oracle') AS is_db FROM ({for_duckdb(PROJECTS_SQL)})) p
LEFT JOIN (WITH {allddl}{OD.STMTS} SELECT project_id, sum(tables) AS tables, sum(functions) AS functions FROM ftot GROUP BY project_id) db USING (project_id)
LEFT JOIN ({CW} SELECT project_id, count(*) AS total_files, sum(loc) AS total_loc FROM files GROUP BY project_id) ct USING (project_id)
LEFT JOIN ({CW} SELECT project_id, difficulty FROM ps) cs USING (project_id)
LEFT JOIN ({PGW} SELECT project_id, difficulty FROM sc) pg USING (project_id)
LEFT JOIN ({PGW} SELECT project_id, sum(loc) AS total_loc FROM jfile GROUP BY project_id) jt USING (project_id)"""
    q.update(sql_rollups())
    q.update(report_sql())
    q["project_metadata"] = metadata_sql()
    return q


def sql_rollups() -> dict[str, str]:
    q = {}
    q["cobol_totals"] = "WITH " + OC.files_cte() + """
SELECT project_id, count(*) AS total_files, CAST(sum(loc) AS BIGINT) AS total_loc FROM files GROUP BY project_id"""
    q["cobol_dependencies"] = "WITH " + OC.files_cte() + OC.edges_cte() + """
SELECT f.project_id, f.path, f.name AS source, string_agg(e.target, ', ' ORDER BY e.first_pos) AS targets
FROM files f JOIN edges e USING (project_id, path) GROUP BY f.project_id, f.path, f.name"""
    allddl = f"files AS ({for_duckdb(ddl_files_sql())})"
    q["cobol_database"] = "WITH " + allddl + OD.STMTS + f""",
projects AS ({for_duckdb(PROJECTS_SQL)}),
db AS (SELECT project_id, sum(tables) AS tables, sum(views) AS views, sum(stored_procedures) AS stored_procedures,
         sum(indexes) AS indexes, sum(triggers) AS triggers, sum(functions) AS functions FROM ftot GROUP BY project_id)
SELECT p.project_id, {', '.join(f'CAST(coalesce(db.{x}, 0) AS BIGINT) AS {x}' for x in ['tables', 'views', 'stored_procedures', 'indexes', 'triggers', 'functions'])}
FROM projects p LEFT JOIN db USING (project_id)"""
    q["cobol_summary"] = "WITH " + OC.files_cte() + OC.scores_cte() + OC.details_cte() + OC.project_scores_cte() + """
SELECT project_id, difficulty || ' difficulty (score: ' || overall || '/100) - ' || description AS summary FROM ps"""
    return q


def report_rows_sql() -> str:
    """M22 rows of the COBOL as-is document."""
    from migscope.plans.project import COBOL_RISKS
    from migscope.plans.rules import MIGRATION_TYPES
    mt = " UNION ALL ".join(f"SELECT {lit(v)} AS migration_type, {lit(sl)} AS sl" for v, _, sl, _ in MIGRATION_TYPES)
    W = ("WITH " + OC.files_cte() + OC.scores_cte() + OC.details_cte() + OC.project_scores_cte() + OC.edges_cte()
         + f",\nallddl AS ({for_duckdb(ddl_files_sql())}),\n"
         "lastf AS (SELECT * FROM allddl a WHERE path = (SELECT max(path) FROM allddl b WHERE b.project_id = a.project_id))"
         + OD.STMTS.replace("FROM files)", "FROM allddl)") + f""",
mt AS ({mt}),
db AS (SELECT project_id, sum(tables) AS tables, sum(views) AS views, sum(indexes) AS indexes,
         sum(stored_procedures) AS stored_procedures, sum(triggers) AS triggers, sum(functions) AS functions
       FROM ftot GROUP BY project_id),
tot AS (SELECT project_id, count(*) AS total_files, sum(loc) AS total_loc FROM files GROUP BY project_id),
p AS (
  SELECT pr.project_id, pr.name, coalesce(mt.sl, 'COBOL') AS sl, coalesce(tot.total_files, 0) AS tf,
    coalesce(tot.total_loc, 0) AS tl, ps.difficulty || ' difficulty (score: ' || ps.overall || '/100) - ' || ps.description AS summary,
    coalesce(db.tables, 0) AS tables, coalesce(db.views, 0) AS views, coalesce(db.indexes, 0) AS indexes,
    coalesce(db.stored_procedures, 0) AS sp, coalesce(db.triggers, 0) AS triggers, coalesce(db.functions, 0) AS functions
  FROM projects pr LEFT JOIN mt USING (migration_type) LEFT JOIN tot USING (project_id) LEFT JOIN ps USING (project_id)
    LEFT JOIN db USING (project_id)),
inv AS (SELECT *, CASE WHEN complexity > 30 OR loc > 1000 THEN 'High' WHEN complexity > 15 OR loc > 500 THEN 'Medium' ELSE 'Low' END AS priority FROM files),
dist AS (SELECT project_id, type, count(*) AS cnt FROM files GROUP BY ALL),
distp AS (SELECT *, CAST(floor(CAST(cnt AS DOUBLE) / sum(cnt) OVER (PARTITION BY project_id) * 100 + 0.5) AS BIGINT) AS pct FROM dist),
deps AS (SELECT f.project_id, f.path, f.name, string_agg(e.target, ', ' ORDER BY e.first_pos) AS targets
         FROM files f JOIN edges e USING (project_id, path) GROUP BY ALL),
top AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY complexity DESC, path) AS rk FROM files WHERE complexity > 20),
top10 AS (SELECT * FROM top WHERE rk <= 10),
td AS (SELECT project_id, count(*) AS n FROM edges GROUP BY 1),
x AS (SELECT ps.*, coalesce(tot.total_loc, 0) AS total_loc, coalesce(td.n, 0) AS total_deps
      FROM ps LEFT JOIN tot USING (project_id) LEFT JOIN td USING (project_id)),
risks AS (
  SELECT project_id, 'R-001' AS id, 'Migration Complexity' AS category,
    'Migration difficulty score is ' || overall || '/100 (' || difficulty || ')' AS description,
    CASE WHEN overall >= 80 THEN 'Critical' ELSE 'High' END AS severity FROM x WHERE overall >= 60
  UNION ALL SELECT project_id, 'R-002', 'Logic Complexity', 'Logic complexity score: ' || logic_score || '/100. ' || logic_details, 'High' FROM x WHERE logic_score >= 60
  UNION ALL SELECT project_id, 'R-003', 'Data Complexity', 'Data complexity score: ' || data_score || '/100. ' || data_details, 'High' FROM x WHERE data_score >= 60
  UNION ALL SELECT project_id, 'R-004', 'COBOL-specific Risk', 'COBOL-specific risk score: ' || risk_score || '/100. ' || risk_details, 'Critical' FROM x WHERE risk_score >= 60
  UNION ALL SELECT project_id, 'R-005', 'Scale', 'Large codebase with ' || format('{{:,}}', total_loc) || ' lines of code', 'Medium' FROM x WHERE total_loc > 100000
  UNION ALL SELECT project_id, 'R-006', 'Dependencies', 'High number of inter-module dependencies (' || total_deps || ')', 'Medium' FROM x WHERE total_deps > 50),
rimp AS ({' UNION ALL '.join(f"SELECT {lit(k)} AS id, {lit(v[2])} AS impact, {lit(v[3])} AS mitigation" for k, v in COBOL_RISKS.items())}),
d AS ('as-is-analysis'),
rows AS (
  SELECT project_id, 0 AS section, '0000' AS sub, '# As-Is System Analysis - ' || name AS line FROM p
  UNION ALL SELECT project_id, 5, '0000', '## Executive Summary' FROM p
  UNION ALL SELECT project_id, 5, '0001', '### Key Findings' FROM p
  UNION ALL SELECT project_id, 10, '0000', '- **Total Source Files:** ' || tf FROM p
  UNION ALL SELECT project_id, 10, '0001', '- **Total Lines of Code:** ' || tl FROM p
  UNION ALL SELECT project_id, 10, '0002', '- **Source Language:** ' || sl FROM p
  UNION ALL SELECT project_id, 10, '0003', '- **Source Database:** Oracle 11g' FROM p
  UNION ALL SELECT project_id, 10, '0004', '- **Complexity Assessment:** ' || coalesce(summary, '') FROM p
  UNION ALL SELECT project_id, 15, '0000', '## 1. Source Code Analysis' FROM p
  UNION ALL SELECT project_id, 15, '0001', '#### File Inventory' FROM p
  UNION ALL SELECT DISTINCT project_id, 20, '0000', '| File Name | Type | LOC | Complexity | Priority |' FROM inv
  UNION ALL SELECT DISTINCT project_id, 20, '0001', '|-----------|------|-----|------------|----------|' FROM inv
  UNION ALL SELECT project_id, 20, '1|' || path, '| ' || name || ' | ' || type || ' | ' || loc || ' | ' || complexity || ' | ' || priority || ' |' FROM inv
  UNION ALL SELECT project_id, 20, '0000', '*[No source files analyzed yet]*' FROM p WHERE project_id NOT IN (SELECT project_id FROM inv)
  UNION ALL SELECT project_id, 21, '0000', '**Total Files:** ' || tf FROM p
  UNION ALL SELECT project_id, 21, '0001', '**Total LOC:** ' || tl FROM p
  UNION ALL SELECT DISTINCT project_id, 30, '0000', '| File Type | Count | Percentage |' FROM distp
  UNION ALL SELECT DISTINCT project_id, 30, '0001', '|-----------|-------|------------|' FROM distp
  UNION ALL SELECT project_id, 30, '1|' || type, '| ' || type || ' | ' || cnt || ' | ' || pct || '% |' FROM distp
  UNION ALL SELECT project_id, 35, '0000', '### 2.2 Program Dependencies' FROM p
  UNION ALL SELECT project_id, 35, '0001', '#### Key Dependencies' FROM p
  UNION ALL SELECT project_id, 40, '1|' || path, '- **' || name || '** depends on: ' || targets FROM deps
  UNION ALL SELECT project_id, 40, '0000', '*[No critical dependencies identified yet]*' FROM p WHERE project_id NOT IN (SELECT project_id FROM deps)
  UNION ALL SELECT project_id, 45, '0000', '## 3. Database Analysis' FROM p
  UNION ALL SELECT project_id, 45, '0001', '### 3.1 Schema Overview' FROM p
  UNION ALL SELECT project_id, 50, '0000', '| Metric | Count |' FROM p
  UNION ALL SELECT project_id, 50, '0001', '|--------|-------|' FROM p
  UNION ALL SELECT project_id, 51, '0000', '| Total Tables | ' || tables || ' |' FROM p
  UNION ALL SELECT project_id, 51, '0001', '| Total Views | ' || views || ' |' FROM p
  UNION ALL SELECT project_id, 51, '0002', '| Total Indexes | ' || indexes || ' |' FROM p
  UNION ALL SELECT project_id, 51, '0003', '| Stored Procedures | ' || sp || ' |' FROM p
  UNION ALL SELECT project_id, 51, '0004', '| Triggers | ' || triggers || ' |' FROM p
  UNION ALL SELECT project_id, 51, '0005', '| Functions | ' || functions || ' |' FROM p
  UNION ALL SELECT project_id, 55, '0000', '## 4. Complexity & Quality Assessment' FROM p
  UNION ALL SELECT project_id, 55, '0001', '### 4.2 High Complexity Modules' FROM p
  UNION ALL SELECT DISTINCT project_id, 60, '0000', '| Module | Complexity Score | Risk Level | Recommendation |' FROM top10
  UNION ALL SELECT DISTINCT project_id, 60, '0001', '|--------|------------------|------------|----------------|' FROM top10
  UNION ALL SELECT project_id, 60, '1|' || lpad(CAST(rk AS VARCHAR), 19, '0'), '| ' || name || ' | ' || complexity || ' | ' ||
      CASE WHEN complexity > 40 THEN 'High' ELSE 'Medium' END || ' | ' ||
      CASE WHEN complexity > 40 THEN 'Consider breaking into smaller modules during migration' ELSE 'Review and simplify logic where possible' END || ' |' FROM top10
  UNION ALL SELECT project_id, 60, '0000', '*[No high-complexity modules identified]*' FROM p WHERE project_id NOT IN (SELECT project_id FROM top10)
  UNION ALL SELECT project_id, 65, '0000', '## 6. Risk Assessment' FROM p
  UNION ALL SELECT project_id, 65, '0001', '### 6.1 Identified Risks' FROM p
  UNION ALL SELECT DISTINCT project_id, 70, '0000', '| Risk ID | Category | Description | Severity | Impact | Mitigation |' FROM risks
  UNION ALL SELECT DISTINCT project_id, 70, '0001', '|---------|----------|-------------|----------|--------|------------|' FROM risks
  UNION ALL SELECT r.project_id, 70, '1|' || r.id, '| R-' || r.id || ' | ' || r.category || ' | ' || r.description || ' | ' || r.severity
      || ' | ' || i.impact || ' | ' || i.mitigation || ' |' FROM risks r JOIN rimp i USING (id)
  UNION ALL SELECT project_id, 70, '0000', '*[Risk assessment to be completed]*' FROM p WHERE project_id NOT IN (SELECT project_id FROM risks))""")
    return W.replace("d AS ('as-is-analysis'),\n", "")


def report_sql() -> dict[str, str]:
    from migscope.operators import validate as V
    base = report_rows_sql()
    q = {"report_rows": base + "\nSELECT project_id, 'as-is-analysis' AS doc, section, sub, line FROM rows"}
    checks = ", ".join(
        (f"bool_or(regexp_matches(line, {lit(p.replace('(?m)', ''))})) AS {n}" if must
         else f"NOT bool_or(regexp_matches(line, {lit(p)})) AS {n}") for n, p, must in V.DOC_CHECKS)
    sel = " UNION ALL ".join(f"SELECT project_id, doc, {lit(n)} AS \"check\", {n} AS passed FROM g" for n, _, _ in V.DOC_CHECKS)
    q["report_quality"] = base + f""",
g AS (SELECT project_id, 'as-is-analysis' AS doc, {checks} FROM rows GROUP BY project_id)
{sel}"""
    return q


def metadata_sql() -> str:
    """M16 document as JSON (DuckDB struct -> to_json; same key order, nulls absent)."""
    allddl = f"allddl AS ({for_duckdb(ddl_files_sql())})"
    W = ("WITH " + OC.files_cte() + OC.scores_cte() + OC.details_cte() + OC.project_scores_cte() + ",\n" + allddl
         + OD.STMTS.replace("FROM files)", "FROM allddl)"))
    lst = lambda cat: (f"coalesce((SELECT list(detail ORDER BY ord) FROM pdet WHERE pdet.project_id = ps.project_id "  # noqa: E731
                       f"AND cat = '{cat}'), [])")
    return W + f""",
db AS (SELECT project_id, sum(tables) AS tables, sum(views) AS views, sum(stored_procedures) AS stored_procedures,
         sum(indexes) AS indexes, sum(triggers) AS triggers, sum(functions) AS functions FROM ftot GROUP BY project_id),
tot AS (SELECT project_id, count(*) AS total_files, sum(loc) AS total_loc FROM files GROUP BY project_id)
SELECT ps.project_id, CAST(to_json({{
  'source_analysis': {{'total_files': coalesce(tot.total_files, 0), 'total_loc': CAST(coalesce(tot.total_loc, 0) AS BIGINT),
    'database': {{'tables': CAST(coalesce(db.tables, 0) AS BIGINT), 'views': CAST(coalesce(db.views, 0) AS BIGINT),
                 'stored_procedures': CAST(coalesce(db.stored_procedures, 0) AS BIGINT), 'indexes': CAST(coalesce(db.indexes, 0) AS BIGINT),
                 'triggers': CAST(coalesce(db.triggers, 0) AS BIGINT), 'functions': CAST(coalesce(db.functions, 0) AS BIGINT)}}}},
  'complexity_summary': ps.difficulty || ' difficulty (score: ' || ps.overall || '/100) - ' || ps.description,
  'migrationComplexity': {{'overall': ps.overall, 'logicComplexity': ps.logic_score, 'dataComplexity': ps.data_score,
    'cobolSpecificRisk': ps.risk_score, 'difficulty': ps.difficulty, 'description': ps.description,
    'details': {{'logic': {lst('logic')}, 'data': {lst('data')}, 'risk': {lst('risk')}}}}}
}}) AS VARCHAR) AS metadata
FROM ps LEFT JOIN tot USING (project_id) LEFT JOIN db USING (project_id)"""
