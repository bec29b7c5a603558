"""DuckDB oracle for the PostgreSQL -> Oracle project plans (K10-K18, M9, M11,
M12, M14)."""

from migscope.operators import pgfeat as G
from migscope.plans import pgscore as PG
from migscope.plans.rules import PROJECTS_SQL
from migscope.sources.generated import ddl_files_sql, java_files_sql, orm_files_sql
from oracle.common import for_duckdb, rnd
from oracle.ddl import STMTS, _regex_rows, esc
from oracle.java import BASE, QUERIES


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def ddl_feature_ctes() -> str:
    """After ``files`` (the DDL files) and STMTS."""
    tmap = " UNION ALL ".join(f"SELECT '{t}' AS type, '{o}' AS oracle_type, '{cx}' AS complexity"
                              for t, o, cx in G.PG_TYPE_MAP)
    fn = _regex_rows(esc(G.RE_FUNCTION), ["name", "returns", "body"], [1, 2, 4])
    pr = _regex_rows(esc(G.RE_PARTITIONED), ["name", "strategy"], [1, 2])
    usage = ", ".join(f"CASE WHEN regexp_matches(content, '{esc(p)}') THEN '{n}' END" for n, p in G.EXTENSION_USAGE)

    def cnt(p):
        return f"len(regexp_extract_all(content, '{esc(p)}', 0))"
    return f""",
tmap AS ({tmap}),
tu0 AS (
  SELECT c.project_id, c.path, c.data_type AS type, 1 AS n, [table_name] AS tl, 0 AS o1, c.stmt_no AS o2, c.col_no AS o3
  FROM cols c JOIN tmap ON tmap.type = c.data_type
  UNION ALL
  SELECT project_id, path, upper(m), 1, NULL, 1, i - 1, 0 FROM (
    SELECT project_id, path, unnest(regexp_extract_all(content, '(?i)(SMALL|BIG)?SERIAL', 0)) AS m,
           generate_subscripts(regexp_extract_all(content, '(?i)(SMALL|BIG)?SERIAL', 0), 1) AS i FROM files)),
tu1 AS (
  SELECT project_id, path, type, sum(n) AS count, min((o1, o2, o3)) AS seen,
    list(tl[1] ORDER BY o2, o3) FILTER (WHERE tl IS NOT NULL) AS tlist
  FROM tu0 GROUP BY ALL),
tu AS (
  SELECT tu1.project_id, tu1.path, tu1.type, tu1.count, tu1.seen,
    coalesce(list_filter(tlist, lambda v, i: list_position(tlist, v) = i), []) AS tables,
    tmap.complexity, tmap.oracle_type
  FROM tu1 JOIN tmap USING (type)),
ixm AS (
  SELECT project_id, path, CASE WHEN coalesce(m, '') = '' THEN 'BTREE' ELSE upper(m) END AS type, i FROM (
    SELECT project_id, path, unnest(regexp_extract_all(content, '{esc(G.RE_INDEX)}', 1)) AS m,
           generate_subscripts(regexp_extract_all(content, '{esc(G.RE_INDEX)}', 1), 1) AS i FROM files)),
ix AS (SELECT project_id, path, type, count(*) AS count, min(i) AS first_ord,
         type IN ('BTREE', 'HASH') AS oracle_support FROM ixm GROUP BY ALL),
fns AS (
  SELECT project_id, path, ord,
    CAST(len(list_filter(string_split(body, chr(10)), lambda l: length(trim(l, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ')) > 0)) AS BIGINT) AS complexity,
    regexp_matches(body, '(?i)EXECUTE\\s+') AS dyn,
    regexp_matches(body, '(?i)ARRAY\\[|array_') OR regexp_matches(body, '(?i)jsonb_|json_|->|->>') AS arrjson,
    regexp_matches(returns, '(?i)RETURNS\\s+TABLE') OR regexp_matches(returns, '(?i)RETURNS\\s+SETOF') AS rtab
  FROM {fn}),
ext0 AS (SELECT project_id, path, regexp_extract_all(content, '{esc(G.RE_EXTENSION)}', 1) AS ex,
        list_filter([{usage}], lambda x: x IS NOT NULL) AS added FROM files),
ext AS (SELECT project_id, path, list_concat(ex, list_filter(added, lambda x: NOT list_contains(ex, x))) AS l FROM ext0),
fc AS (
  SELECT project_id, path, {cnt(G.RE_CHECK)} AS checks, {cnt(G.RE_EXCLUDE)} AS exclusions,
    {cnt(G.RE_INHERITS)} AS inheritance_tables, {cnt(G.RE_PARTITIONED)} AS partitioned_tables,
    {cnt(G.RE_TRIGGER)} AS trigger_count, {cnt(G.RE_RLS)} AS rls, {cnt(G.RE_PARTIAL)} AS partial_indexes
  FROM files),
ptu AS (SELECT project_id, type, complexity, oracle_type, sum(count) AS count, min((path, seen)) AS fat FROM tu GROUP BY ALL),
pix AS (SELECT project_id, type, oracle_support, sum(count) AS count, min((path, first_ord)) AS fat FROM ix GROUP BY ALL),
pext0 AS (SELECT project_id, path, unnest(l) AS extension, generate_subscripts(l, 1) AS i FROM ext),
pext1 AS (SELECT project_id, extension, min((path, i)) AS fat FROM pext0 GROUP BY ALL),
pext AS (SELECT project_id, list(extension ORDER BY fat) AS l FROM pext1 GROUP BY project_id),
pfc AS (SELECT project_id, sum(checks) AS checks, sum(exclusions) AS exclusions, sum(inheritance_tables) AS inheritance_tables,
          sum(partitioned_tables) AS partitioned_tables, sum(trigger_count) AS trigger_count, sum(rls) AS rls,
          sum(partial_indexes) AS partial_indexes FROM fc GROUP BY project_id),
dproj AS (
  SELECT f.project_id, true AS has_ddl,
    coalesce((SELECT sum(count) FROM tu WHERE tu.project_id = f.project_id AND type IN ({', '.join(lit(t) for t in PG.COMPLEX_TYPES)})), 0) AS complex_type_count,
    coalesce((SELECT sum(count) FROM tu WHERE tu.project_id = f.project_id AND contains(type, 'SERIAL')), 0) AS serial_count,
    coalesce((SELECT sum(len(tables)) FROM tu WHERE tu.project_id = f.project_id AND type IN ({', '.join(lit(t) for t in PG.VOLUME_TYPES)})), 0) AS complex_data_tables,
    (SELECT count(*) FROM fns WHERE fns.project_id = f.project_id) AS plpgsql_functions,
    (SELECT avg(complexity) FROM fns WHERE fns.project_id = f.project_id) AS avg_function_lines,
    (SELECT count(*) FROM fns WHERE fns.project_id = f.project_id AND dyn) AS dynamic_functions,
    (SELECT count(*) FROM fns WHERE fns.project_id = f.project_id AND arrjson) AS array_json_functions,
    (SELECT count(*) FROM fns WHERE fns.project_id = f.project_id AND rtab) AS table_functions,
    f.checks, f.exclusions, f.inheritance_tables, f.partitioned_tables, f.trigger_count, f.rls, f.partial_indexes,
    coalesce((SELECT len(l) FROM pext WHERE pext.project_id = f.project_id), 0) AS extension_count,
    coalesce((SELECT sum(count) FROM ix WHERE ix.project_id = f.project_id AND type IN ('GIN', 'GIST', 'BRIN', 'SPGIST') AND NOT oracle_support), 0) AS advanced_index_count,
    coalesce((SELECT 10000 * count(*) FROM tb WHERE tb.project_id = f.project_id), 0) AS total_rows,
    0 AS large_tables,
    coalesce((SELECT list(count || ' ' || type || ' columns (' || complexity || ' complexity → ' || oracle_type || ')' ORDER BY fat)
              FROM ptu WHERE ptu.project_id = f.project_id AND count > 0), []) AS type_lines,
    coalesce((SELECT l FROM pext WHERE pext.project_id = f.project_id), []) AS extension_list,
    coalesce((SELECT list(type ORDER BY fat) FROM pix WHERE pix.project_id = f.project_id AND NOT oracle_support), []) AS advanced_index_types
  FROM pfc f)"""


def java_project_ctes() -> str:
    """After jf/jfile (BASE) and jq (QUERIES)."""
    return """,
jproj AS (
  SELECT project_id, count(*) AS java_files, sum(loc) AS total_loc,
    sum(len(pg_functions)) AS function_uses, sum(len(pg_operators)) AS operator_uses,
    count(*) FILTER (WHERE list_contains(pg_data_types, 'BOOLEAN')) AS boolean_files,
    count(*) FILTER (WHERE orm_framework = 'Plain JDBC') AS plain_jdbc_files,
    count(*) FILTER (WHERE orm_framework = 'MyBatis') AS mybatis_files,
    sum(jdbc_calls) AS jdbc_calls, sum(len(schema_code)) AS schema_code_uses,
    count(*) FILTER (WHERE type = 'Entity') AS entity_files,
    count(*) FILTER (WHERE type = 'Repository') AS repository_files
  FROM jfile GROUP BY project_id),
jqp AS (
  SELECT project_id, count(*) AS native_queries, count(*) FILTER (WHERE has_pg_syntax) AS pg_native_queries,
    count(*) FILTER (WHERE regexp_matches(query, '(?i)LIMIT|OFFSET')) AS limit_offset_queries,
    count(*) FILTER (WHERE regexp_matches(query, '(?i)RETURNING')) AS returning_queries
  FROM jq GROUP BY project_id),
svc AS (
  SELECT project_id, count(*) AS service_files_with_queries FROM jfile f
  WHERE type = 'Service' AND EXISTS (SELECT 1 FROM jq WHERE jq.project_id = f.project_id AND jq.path = f.path)
  GROUP BY project_id),
fnx AS (SELECT project_id, path, unnest(pg_functions) AS v, generate_subscripts(pg_functions, 1) AS i FROM jfile),
fnf AS (SELECT project_id, v, min((path, i)) AS fat FROM fnx GROUP BY ALL),
fnset AS (SELECT project_id, list(v ORDER BY fat) AS function_set FROM fnf GROUP BY project_id),
opx AS (SELECT project_id, path, unnest(pg_operators) AS v, generate_subscripts(pg_operators, 1) AS i FROM jfile),
opf AS (SELECT project_id, v, min((path, i)) AS fat FROM opx GROUP BY ALL),
opset AS (SELECT project_id, list(v ORDER BY fat) AS operator_set FROM opf GROUP BY project_id),
ormc AS (SELECT project_id, orm_framework, count(*) AS n, min(path) AS first_path FROM jfile GROUP BY ALL),
ormd AS (
  SELECT project_id, list(n || ' files using ' || orm_framework ORDER BY first_path) FILTER (WHERE orm_framework <> 'None') AS orm_lines
  FROM ormc GROUP BY project_id)"""


def scores_cte() -> str:
    D = "CAST({} AS DOUBLE)"
    return f""",
projects AS ({for_duckdb(PROJECTS_SQL)}),
base AS (
  SELECT p.project_id, coalesce(d.has_ddl, false) AS has_ddl,
    {', '.join(f"coalesce({x}, 0) AS {x}" for x in ['java_files', 'total_loc', 'function_uses', 'operator_uses', 'boolean_files', 'plain_jdbc_files', 'mybatis_files', 'jdbc_calls', 'schema_code_uses', 'entity_files', 'repository_files', 'native_queries', 'pg_native_queries', 'limit_offset_queries', 'returning_queries', 'service_files_with_queries', 'complex_type_count', 'serial_count', 'complex_data_tables', 'plpgsql_functions', 'dynamic_functions', 'array_json_functions', 'table_functions', 'checks', 'exclusions', 'inheritance_tables', 'partitioned_tables', 'trigger_count', 'rls', 'partial_indexes', 'extension_count', 'advanced_index_count', 'total_rows', 'large_tables'])},
    avg_function_lines,
    coalesce(type_lines, []) AS type_lines, coalesce(extension_list, []) AS extension_list,
    coalesce(advanced_index_types, []) AS advanced_index_types,
    coalesce(function_set, []) AS function_set, coalesce(operator_set, []) AS operator_set,
    coalesce(orm_lines, []) AS orm_lines
  FROM projects p LEFT JOIN jproj USING (project_id) LEFT JOIN jqp USING (project_id) LEFT JOIN svc USING (project_id)
    LEFT JOIN fnset USING (project_id) LEFT JOIN opset USING (project_id) LEFT JOIN ormd USING (project_id)
    LEFT JOIN dproj d USING (project_id)),
sc0 AS (
  SELECT *,
    CASE WHEN has_ddl THEN least({rnd("least(complex_type_count * 5, 30) + least(serial_count * 2, 10) + least(checks * 2, 15) + least(exclusions * 5, 15) + (CASE WHEN inheritance_tables > 0 THEN 10 ELSE 0 END) + least(partitioned_tables * 5, 20)")}, 100) ELSE 0 END AS schema_score,
    least({rnd("least(pg_native_queries * 3, 30) + least(function_uses * 2, 25) + least(operator_uses * 2, 20) + least(limit_offset_queries, 10) + least(returning_queries * 2, 10) + least(boolean_files, 5)")}, 100) AS sql_score,
    CASE WHEN has_ddl THEN least({rnd("least(plpgsql_functions * 5, 25) + (CASE WHEN plpgsql_functions > 0 THEN (CASE WHEN avg_function_lines > 100 THEN 20 WHEN avg_function_lines > 50 THEN 10 WHEN avg_function_lines > 20 THEN 5 ELSE 0 END) ELSE 0 END) + least(dynamic_functions * 8, 20) + least(array_json_functions * 5, 15) + least(table_functions * 3, 10) + least(trigger_count * 3, 10)")}, 100) ELSE 0 END AS proc_score,
    CASE WHEN has_ddl THEN least({rnd("(CASE WHEN total_rows > 1000000000 THEN 40 WHEN total_rows > 100000000 THEN 30 WHEN total_rows > 10000000 THEN 20 WHEN total_rows > 1000000 THEN 10 ELSE 0 END) + least(large_tables * 5, 20) + least(partitioned_tables * 8, 20) + least(complex_data_tables * 5, 20)")}, 100) ELSE 0 END AS volume_score,
    least({rnd("least(plain_jdbc_files * 8, 30) + least(native_queries * 2, 25) + least(mybatis_files * 3, 20) + least(jdbc_calls * 2, 15) + least(schema_code_uses * 5, 10)")}, 100) AS app_score,
    CASE WHEN has_ddl THEN least({rnd("least(extension_count * 10, 30) + least(advanced_index_count * 5, 20) + (CASE WHEN rls > 0 THEN 15 ELSE 0 END) + least(partial_indexes * 3, 15) + 20")}, 100) ELSE 15 END AS ops_score
  FROM base),
sc1 AS (
  SELECT *, {rnd(f"schema_score * {D.format('0.20')} + sql_score * {D.format('0.20')} + proc_score * {D.format('0.20')} + volume_score * {D.format('0.15')} + app_score * {D.format('0.15')} + ops_score * {D.format('0.10')}")} AS overall
  FROM sc0),
sc AS (
  SELECT *,
    CASE WHEN overall < 30 THEN 'Low' WHEN overall < 60 THEN 'Medium' WHEN overall < 80 THEN 'High' ELSE 'Very High' END AS difficulty,
    CASE WHEN overall < 30 THEN {lit(PG.PG_DESCRIPTIONS[0])} WHEN overall < 60 THEN {lit(PG.PG_DESCRIPTIONS[1])}
         WHEN overall < 80 THEN {lit(PG.PG_DESCRIPTIONS[2])} ELSE {lit(PG.PG_DESCRIPTIONS[3])} END AS description,
    CASE WHEN has_ddl THEN list_concat(type_lines, list_filter([
        CASE WHEN inheritance_tables > 0 THEN inheritance_tables || ' tables using inheritance (requires redesign for Oracle)' END,
        CASE WHEN partitioned_tables > 0 THEN partitioned_tables || ' partitioned tables (migration strategy needed)' END], lambda x: x IS NOT NULL))
      ELSE [] END AS schema_details,
    list_filter([
        CASE WHEN native_queries > 0 THEN native_queries || ' native SQL queries requiring review' END,
        CASE WHEN len(function_set) > 0 THEN 'PostgreSQL-specific functions: ' || array_to_string(function_set, ', ') END,
        CASE WHEN len(operator_set) > 0 THEN 'PostgreSQL-specific operators requiring conversion: ' || array_to_string(operator_set, ', ') END],
      lambda x: x IS NOT NULL) AS sql_details,
    CASE WHEN has_ddl THEN list_filter([
        CASE WHEN plpgsql_functions > 0 THEN plpgsql_functions || ' PL/pgSQL functions need conversion to PL/SQL' END,
        CASE WHEN plpgsql_functions > 0 AND dynamic_functions > 0 THEN dynamic_functions || ' functions use dynamic SQL (high conversion risk)' END,
        CASE WHEN plpgsql_functions > 0 AND array_json_functions > 0 THEN array_json_functions || ' functions use arrays/JSON (complex conversion)' END,
        CASE WHEN trigger_count > 0 THEN trigger_count || ' triggers require conversion' END], lambda x: x IS NOT NULL)
      ELSE [] END AS proc_details,
    CASE WHEN has_ddl THEN list_filter([
        CASE WHEN total_rows > 0 THEN 'Estimated ' || js_fixed || 'M total rows to migrate' END,
        CASE WHEN large_tables > 0 THEN large_tables || ' large tables requiring careful migration strategy' END,
        CASE WHEN partitioned_tables > 0 THEN partitioned_tables || ' partitioned tables (partition strategy conversion needed)' END],
      lambda x: x IS NOT NULL) ELSE [] END AS volume_details,
    list_concat(orm_lines, list_filter([CASE WHEN plain_jdbc_files > 0 THEN plain_jdbc_files || ' files with direct JDBC calls (highest migration effort)' END], lambda x: x IS NOT NULL)) AS app_details,
    list_concat(CASE WHEN has_ddl THEN list_filter([
        CASE WHEN len(extension_list) > 0 THEN 'PostgreSQL extensions in use: ' || array_to_string(extension_list, ', ') END,
        CASE WHEN len(advanced_index_types) > 0 THEN 'Advanced index types requiring alternatives: ' || array_to_string(advanced_index_types, ', ') END,
        CASE WHEN rls > 0 THEN 'Row-level security policies require Oracle VPD implementation' END], lambda x: x IS NOT NULL)
      ELSE [] END, ['Transaction isolation and concurrency control differences require testing']) AS ops_details
  FROM (SELECT *, {fixed1('total_rows')} AS js_fixed FROM sc1))"""


def fixed1(v: str) -> str:
    """(v/1e6).toFixed(1) for an integer v: round half up on the exact decimal
    expansion of the double, read from printf('%.60f') (exact digits)."""
    x = f"printf('%.60f', CAST({v} AS DOUBLE) / 1e6)"
    ip = f"CAST(split_part({x}, '.', 1) AS BIGINT)"
    d1 = f"CAST(substr(split_part({x}, '.', 2), 1, 1) AS BIGINT)"
    d2 = f"CAST(substr(split_part({x}, '.', 2), 2, 1) AS BIGINT)"
    t = f"({ip} * 10 + {d1} + CASE WHEN {d2} >= 5 THEN 1 ELSE 0 END)"
    return f"(({t}) // 10) || '.' || (({t}) % 10)"


def sql() -> dict[str, str]:
    ddl_all = f"files AS ({for_duckdb(ddl_files_sql())})"
    W = ("WITH jf AS (" + for_duckdb(java_files_sql()) + ")" + BASE + QUERIES + ",\n" + ddl_all + STMTS
         + ddl_feature_ctes() + java_project_ctes() + scores_cte())
    dims = ", ".join(PG.DIMS)
    det = ["schema_details", "sql_details", "proc_details", "volume_details", "app_details", "ops_details"]
    q = {}
    q["pg_scores"] = W + f"""
SELECT project_id, {dims}, overall, difficulty, description, {', '.join(f"array_to_string({d}, '; ') AS {d}" for d in det)} FROM sc"""
    recs = [f"SELECT project_id, 0 AS rule_no, {lit(PG.PRINCIPLE[0])} AS dimension, {lit(PG.PRINCIPLE[1])} AS severity, "
            f"{lit(PG.PRINCIPLE[2])} AS issue, {lit(PG.PRINCIPLE[3])} AS mitigation FROM sc"]
    for i, (dim, col, issue, mit) in enumerate(PG.RECOMMENDATIONS, start=1):
        recs.append(f"SELECT project_id, {i}, {lit(dim)}, CASE WHEN {col} > 70 THEN 'High' ELSE 'Medium' END, "
                    f"{lit(issue)}, {lit(mit)} FROM sc WHERE {col} > 50")
    q["pg_recommendations"] = W + "\n" + "\nUNION ALL ".join(recs)

    def r(rid, cond, desc, sev=None, mit=None):
        cat, s, impact, m = PG.PG_RISKS[rid]
        return (f"SELECT project_id, '{rid}' AS id, {lit(cat)} AS category, {desc} AS description, "
                f"{sev or lit(s)} AS severity, {lit(impact)} AS impact, {mit or lit(m)} AS mitigation FROM sc WHERE {cond}")

    def scored(col, label):
        d = col.replace("_score", "_details")
        return f"'{label}: ' || {col} || '/100. ' || array_to_string({d}, '; ')"
    risks = [
        r("PG-R-001", "overall >= 60", "'Migration difficulty score is ' || overall || '/100 (' || difficulty || ')'",
          "CASE WHEN overall >= 80 THEN 'Critical' ELSE 'High' END"),
        r("PG-R-002", "schema_score >= 60", scored("schema_score", "Schema complexity score")),
        r("PG-R-003", "sql_score >= 60", scored("sql_score", "SQL rewrite complexity")),
        r("PG-R-004", "proc_score >= 60", scored("proc_score", "Procedure complexity")),
        r("PG-R-005", "volume_score >= 60", scored("volume_score", "Data migration complexity")),
        r("PG-R-006", "app_score >= 60",
          "'Application dependency complexity: ' || app_score || '/100. Java files with DB dependencies: ' || entity_files "
          "|| ' Entities, ' || repository_files || ' Repositories' || CASE WHEN service_files_with_queries > 0 THEN ', ' "
          "|| service_files_with_queries || ' Services (review required)' ELSE '' END",
          mit=f"{lit(PG.PG_R006_MITIGATION)} || CASE WHEN service_files_with_queries > 0 THEN "
              f"' Services with native queries require careful review.' ELSE '' END"),
        r("PG-R-007", "ops_score >= 60", scored("ops_score", "Operational risk")),
        r("PG-R-008", "has_ddl AND len(extension_list) > 0",
          "'PostgreSQL extensions in use: ' || array_to_string(extension_list, ', ')"),
    ]
    q["pg_risks"] = W + "\n" + "\nUNION ALL ".join(risks)
    q["pg_metadata"] = metadata_sql(W)
    q["pg_report_rows"] = report_rows_sql(W, "\nUNION ALL ".join(recs), "\nUNION ALL ".join(risks))
    JW = "WITH jf AS (" + for_duckdb(java_files_sql()) + ")" + BASE + QUERIES
    q["primary_orm"] = JW + """,
g AS (SELECT project_id, orm_framework, count(*) AS n, min(path) AS first_path FROM jfile GROUP BY ALL),
lab AS (SELECT project_id, count(*) AS labels,
          list(orm_framework ORDER BY first_path) FILTER (WHERE orm_framework <> 'None') AS nn FROM g GROUP BY project_id),
best AS (SELECT project_id, arg_min(orm_framework, (-n, first_path)) AS best FROM g WHERE orm_framework <> 'None' GROUP BY project_id)
SELECT lab.project_id, CASE WHEN labels > 2 THEN 'Mixed (' || array_to_string(nn, ', ') || ')' ELSE coalesce(best.best, 'None') END AS orm_framework
FROM lab LEFT JOIN best USING (project_id)"""
    inv = """,
nq AS (SELECT project_id, path, count(*) AS n FROM jq GROUP BY ALL),
inv AS (SELECT f.*, coalesce(nq.n, 0) > 0 OR len(f.pg_functions) > 0 OR len(f.pg_data_types) > 0 AS dep
        FROM jfile f LEFT JOIN nq USING (project_id, path))"""
    q["pg_changes"] = JW + inv + """
SELECT project_id, path, type,
  CASE WHEN type = 'Entity' THEN 'entity_mapping' WHEN type = 'Repository' THEN 'repository_query'
       WHEN type = 'Configuration' THEN 'configuration' ELSE 'requires_review' END AS category,
  CASE WHEN type IN ('Entity', 'Repository', 'Configuration') THEN path
       WHEN type IN ('Service', 'Controller') THEN path || ' (' || type || ' with native queries - review for business logic impact)'
       ELSE path || ' (' || type || ' - unexpected DB dependency)' END AS text
FROM inv WHERE dep"""
    q["pg_design_rows"] = design_sql()
    q["pg_change_summary"] = JW + inv + """
SELECT project_id, CAST(count(*) AS BIGINT) AS total_files,
  CAST(count(*) FILTER (WHERE dep AND type IN ('Entity', 'Repository', 'Configuration')) AS BIGINT) AS files_requiring_change,
  CAST(count(*) FILTER (WHERE dep AND type NOT IN ('Entity', 'Repository', 'Configuration')) AS BIGINT) AS files_requiring_review
FROM inv GROUP BY project_id"""
    return q


def design_sql() -> str:
    """M24-M25 rows of the migration strategy document."""
    from migscope.plans import report as R
    ddl_all = f"files AS ({for_duckdb(ddl_files_sql())})"
    W = ("WITH jf AS (" + for_duckdb(java_files_sql()) + ")" + BASE + QUERIES + ",\n" + ddl_all + STMTS
         + ddl_feature_ctes() + java_project_ctes() + scores_cte())
    orm_adv = " UNION ALL ".join(f"SELECT {lit(k)} AS orm_framework, {i} AS i, {lit(t)} AS line"
                                 for k, ls in R.ORM_ADVICE.items() for i, t in enumerate(ls))
    ext_adv = " UNION ALL ".join(f"SELECT {lit(k)} AS extension, {i} AS i, {lit(t)} AS line"
                                 for k, ls in R.EXTENSION_ADVICE.items() for i, t in enumerate(ls))
    other = R.EXTENSION_ADVICE_OTHER[0]
    iadv = " UNION ALL ".join(f"SELECT {lit(k)} AS type, {i} AS i, {lit(t)} AS line" for k, ls in R.INDEX_ADVICE.items() for i, t in enumerate(ls))
    return W + f""",
g AS (SELECT project_id, orm_framework, count(*) AS n, min(path) AS first_path FROM jfile GROUP BY ALL),
lab AS (SELECT project_id, count(*) AS labels,
          list(orm_framework ORDER BY first_path) FILTER (WHERE orm_framework <> 'None') AS nn FROM g GROUP BY project_id),
best AS (SELECT project_id, arg_min(orm_framework, (-n, first_path)) AS best FROM g WHERE orm_framework <> 'None' GROUP BY project_id),
porm AS (SELECT lab.project_id, CASE WHEN labels > 2 THEN 'Mixed (' || array_to_string(nn, ', ') || ')'
                                     ELSE coalesce(best.best, 'None') END AS orm_framework
         FROM lab LEFT JOIN best USING (project_id)),
oadv AS ({orm_adv}),
eadv AS ({ext_adv}),
ex AS (SELECT project_id, path, CAST(generate_subscripts(l, 1) - 1 AS BIGINT) AS ord, unnest(l) AS extension FROM ext),
exl AS (
  SELECT ex.project_id, ex.path, ex.ord, ex.extension,
    coalesce((SELECT list(line ORDER BY i) FROM eadv WHERE eadv.extension = ex.extension), [{lit(other)}]) AS adv
  FROM ex),
exr AS (
  SELECT project_id, path, ord, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS j FROM (
    SELECT project_id, path, ord, list_concat(['### Extension: ' || extension, '**Oracle Equivalent:**'], adv) AS l FROM exl)),
tk AS (SELECT *, '1|' || path || '|' || lpad(CAST(struct_extract(seen, 2) AS VARCHAR), 19, '0') || '|' ||
                 CAST(struct_extract(seen, 1) AS VARCHAR) || '|' || lpad(CAST(struct_extract(seen, 3) AS VARCHAR), 19, '0') AS k FROM tu),
rows AS (
  SELECT project_id, 10 AS section, k || '|a' AS sub, '**' || type || '** → **' || oracle_type || '**' AS line FROM tk
  UNION ALL SELECT project_id, 10, k || '|b', '- Complexity: ' || complexity FROM tk
  UNION ALL SELECT project_id, 10, k || '|c', '- Affected Tables: ' || array_to_string(tables, ', ') FROM tk
  UNION ALL SELECT project_id, 10, k || '|d', '- Required Actions: ' || CASE WHEN complexity = 'Complex'
      THEN 'Custom conversion logic required' ELSE 'Direct mapping' END FROM tk
  UNION ALL SELECT project_id, 10, k || '|e', CASE WHEN complexity = 'Complex' THEN '⚠️ **Entity Annotation Update Required**'
      ELSE '✓ **No Entity Change Required** - Automatic type mapping works' END FROM tk
  UNION ALL SELECT project_id, 21, '1|' || path || '|' || lpad(CAST(first_ord - 1 AS VARCHAR), 19, '0') || '|' || a.i, a.line
      FROM ix JOIN ({iadv}) a USING (type)
  UNION ALL SELECT project_id, 20, '1|' || path || '|' || lpad(CAST(first_ord - 1 AS VARCHAR), 19, '0'),
      '- **' || type || '** (' || count || ' indexes) - Oracle Support: ' ||
      CASE WHEN oracle_support THEN 'Native' ELSE 'Alternative approach needed' END FROM ix
  UNION ALL SELECT p.project_id, 30, lpad(CAST(a.i AS VARCHAR), 19, '0'), a.line FROM porm p JOIN oadv a USING (orm_framework)
  UNION ALL SELECT project_id, 40, '1|' || path || '|' || lpad(CAST(ord AS VARCHAR), 19, '0') || '|' || lpad(CAST(j AS VARCHAR), 19, '0'), line FROM exr
  UNION ALL SELECT project_id, 50, '0000', CASE WHEN volume_score > 60 THEN '**Primary: AWS Database Migration Service (DMS)**'
      ELSE '**Primary: Oracle SQL Developer + Ora2Pg**' END FROM sc
  UNION ALL SELECT project_id, 50, '0001', '**Recommended:** Based on complexity score ' || overall || '/100' FROM sc
  UNION ALL SELECT project_id, 50, '0002', CASE WHEN overall > 70 THEN '**Recommended: Phased Migration**'
      ELSE '**Recommended: Big Bang Cutover**' END FROM sc)
SELECT project_id, 'pg-migration-strategy' AS doc, section, sub, line FROM rows"""


def report_rows_sql(W: str, recs: str, risks: str) -> str:
    """M23 rows of the PostgreSQL as-is document (after the scores CTEs W)."""
    from migscope.plans import report as R
    from migscope.plans.rules import MIGRATION_TYPES
    dims = "\n  ".join(f"UNION ALL SELECT project_id, 20, '{i + 2:04d}', '| {lbl} | ' || {col} || '/100 | ' || difficulty || ' |' FROM p"
                        for i, (lbl, col) in enumerate(R.DIMENSION_LABELS))
    chlist = "list_concat(" + ", ".join(
        f"list_concat([{lit('### ' + t)}, '**Score:** ' || {k}_score || '/100', '**Key Challenges:**'], "
        f"list_concat(list_transform({k}_details, lambda d: '- ' || d), [{lit('**Impact:** ' + i)}, {lit('**Mitigation:** ' + m)}]))"
        for t, k, i, m in R.CHALLENGES) + ")"
    challenges = "UNION ALL SELECT project_id, 95, '1|' || lpad(CAST(i AS VARCHAR), 19, '0'), line FROM chl"
    return W + f""",
ofl AS ({for_duckdb(orm_files_sql())}),
tfiles AS (SELECT project_id, count(*) AS n FROM (SELECT project_id FROM jf UNION ALL SELECT project_id FROM ofl) GROUP BY 1),
g AS (SELECT project_id, orm_framework, count(*) AS n, min(path) AS first_path FROM jfile GROUP BY ALL),
lab AS (SELECT project_id, count(*) AS labels,
          list(orm_framework ORDER BY first_path) FILTER (WHERE orm_framework <> 'None') AS nn FROM g GROUP BY project_id),
best AS (SELECT project_id, arg_min(orm_framework, (-n, first_path)) AS best FROM g WHERE orm_framework <> 'None' GROUP BY project_id),
porm AS (SELECT lab.project_id, CASE WHEN labels > 2 THEN 'Mixed (' || array_to_string(nn, ', ') || ')'
                                     ELSE coalesce(best.best, 'None') END AS orm_framework
         FROM lab LEFT JOIN best USING (project_id)),
nq AS (SELECT project_id, path, count(*) AS n FROM jq GROUP BY ALL),
inv AS (SELECT f.*, coalesce(nq.n, 0) > 0 OR len(f.pg_functions) > 0 OR len(f.pg_data_types) > 0 AS dep
        FROM jfile f LEFT JOIN nq USING (project_id, path)),
chg AS (
  SELECT project_id, path,
    CASE WHEN type = 'Entity' THEN 'entity_mapping' WHEN type = 'Repository' THEN 'repository_query'
         WHEN type = 'Configuration' THEN 'configuration' ELSE 'requires_review' END AS category,
    CASE WHEN type IN ('Entity', 'Repository', 'Configuration') THEN path
         WHEN type IN ('Service', 'Controller') THEN path || ' (' || type || ' with native queries - review for business logic impact)'
         ELSE path || ' (' || type || ' - unexpected DB dependency)' END AS text
  FROM inv WHERE dep),
csum AS (SELECT project_id, count(*) FILTER (WHERE category <> 'requires_review') AS fc,
           count(*) FILTER (WHERE category = 'requires_review') AS fr FROM chg GROUP BY project_id),
pdb AS (SELECT project_id, sum(tables) AS tables, sum(views) AS views, sum(stored_procedures) AS sp, sum(functions) AS functions,
           sum(triggers) AS triggers, sum(indexes) AS indexes, sum(sequences) AS sequences FROM ftot GROUP BY project_id),
pparts AS (SELECT project_id, sum(partitioned_tables) AS n FROM fc GROUP BY project_id),
p AS (
  SELECT sc.*, coalesce(tfiles.n, 0) AS total_files_all, coalesce(porm.orm_framework, 'None') AS ormf,
    coalesce(csum.fc, 0) AS fc, coalesce(csum.fr, 0) AS fr,
    coalesce(pdb.tables, 0) AS db_tables, coalesce(pdb.views, 0) AS db_views, coalesce(pdb.sp, 0) AS db_sp,
    coalesce(pdb.functions, 0) AS db_functions, coalesce(pdb.triggers, 0) AS db_triggers, coalesce(pdb.indexes, 0) AS db_indexes,
    coalesce(pdb.sequences, 0) AS db_sequences, coalesce(pparts.n, 0) AS db_parts,
    difficulty || ' difficulty (score: ' || overall || '/100) - ' || description AS summary
  FROM sc LEFT JOIN tfiles USING (project_id) LEFT JOIN porm USING (project_id) LEFT JOIN csum USING (project_id)
    LEFT JOIN pdb USING (project_id) LEFT JOIN pparts USING (project_id)),
risks AS ({risks}),
nrisks AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY id) - 1 AS no FROM risks),
chl AS (SELECT project_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS i FROM (SELECT project_id, {chlist} AS l FROM sc)),
recs AS ({recs}),
tk AS (SELECT *, '1|' || path || '|' || CAST(struct_extract(seen, 1) AS VARCHAR) || '|' || lpad(CAST(struct_extract(seen, 2) AS VARCHAR), 19, '0')
                 || '|' || lpad(CAST(struct_extract(seen, 3) AS VARCHAR), 19, '0') AS k FROM tu),
ex AS (SELECT project_id, path, CAST(generate_subscripts(l, 1) - 1 AS BIGINT) AS ord, unnest(l) AS extension FROM ext),
rows AS (
  SELECT project_id, 10 AS section, '0000' AS sub, '- **Total Java Files:** ' || total_files_all AS line FROM p
  UNION ALL SELECT project_id, 10, '0001', '- **Total Lines of Code:** ' || total_loc FROM p
  UNION ALL SELECT project_id, 10, '0002', '- **ORM Framework:** ' || ormf FROM p
  UNION ALL SELECT project_id, 10, '0003', '- **Source Database:** Oracle 11g' FROM p
  UNION ALL SELECT project_id, 10, '0004', '- **Target Database:** PostgreSQL 15' FROM p
  UNION ALL SELECT project_id, 10, '0005', '- **Complexity Assessment:** ' || summary FROM p
  UNION ALL SELECT project_id, 20, '0000', '| Dimension | Score | Level |' FROM p
  UNION ALL SELECT project_id, 20, '0001', '|-----------|-------|-------|' FROM p
  {dims}
  UNION ALL SELECT project_id, 20, '0008', '| **Overall** | **' || overall || '/100** | **' || difficulty || '** |' FROM p
  UNION ALL SELECT project_id, 30, '1|' || path, '- **' || type || ':** `' || name || '` (' || loc || ' LOC) - PostgreSQL Dependencies: '
      || CASE WHEN dep THEN 'Yes' ELSE 'No' END FROM inv
  UNION ALL SELECT project_id, 40, '0000', '**Files Requiring Change:** ' || fc FROM p
  UNION ALL SELECT project_id, 40, '0001', '**Files Requiring Review:** ' || fr FROM p
  UNION ALL SELECT project_id, 41, '1|' || path, '- ' || text FROM chg WHERE category = 'entity_mapping'
  UNION ALL SELECT project_id, 42, '1|' || path, '- ' || text FROM chg WHERE category = 'repository_query'
  UNION ALL SELECT project_id, 44, '1|' || path, '- ⚠️ ' || text FROM chg WHERE category = 'requires_review'
  UNION ALL SELECT project_id, 44, '0000', '✓ No files requiring special review (good architecture - business logic separated from database layer)'
      FROM p WHERE project_id NOT IN (SELECT project_id FROM chg WHERE category = 'requires_review')
  UNION ALL SELECT project_id, 50, '0000', '| Component | Count |' FROM p
  UNION ALL SELECT project_id, 50, '0001', '|-----------|-------|' FROM p
  UNION ALL SELECT project_id, 50, '0002', '| Tables | ' || db_tables || ' |' FROM p
  UNION ALL SELECT project_id, 50, '0003', '| Views | ' || db_views || ' |' FROM p
  UNION ALL SELECT project_id, 50, '0004', '| Stored Procedures | ' || db_sp || ' |' FROM p
  UNION ALL SELECT project_id, 50, '0005', '| Functions | ' || db_functions || ' |' FROM p
  UNION ALL SELECT project_id, 50, '0006', '| Triggers | ' || db_triggers || ' |' FROM p
  UNION ALL SELECT project_id, 50, '0007', '| Indexes | ' || db_indexes || ' |' FROM p
  UNION ALL SELECT project_id, 50, '0008', '| Sequences | ' || db_sequences || ' |' FROM p
  UNION ALL SELECT project_id, 50, '0009', '| Partitioned Tables | ' || db_parts || ' |' FROM p
  UNION ALL SELECT project_id, 60, k || '|a', '**' || type || '** (' || count || ' occurrences)' FROM tk
  UNION ALL SELECT project_id, 60, k || '|b', '- Tables: ' || array_to_string(tables, ', ') FROM tk
  UNION ALL SELECT project_id, 60, k || '|c', '- Oracle Mapping Complexity: **' || complexity || '**' FROM tk
  UNION ALL SELECT project_id, 60, k || '|d', '- Suggested Oracle Type: `' || oracle_type || '`' FROM tk
  UNION ALL SELECT project_id, 70, '1|' || path || '|' || lpad(CAST(ord AS VARCHAR), 19, '0'),
      '- **' || extension || '** - Requires Oracle equivalent or custom implementation' FROM ex
  UNION ALL SELECT project_id, 70, '0000', 'No PostgreSQL extensions detected.' FROM p WHERE project_id NOT IN (SELECT project_id FROM ex)
  UNION ALL SELECT project_id, 80, '1|' || path || '|' || lpad(CAST(first_ord - 1 AS VARCHAR), 19, '0'),
      '- **' || type || '** (' || count || ' indexes) - Oracle Support: ' || CASE WHEN oracle_support THEN 'Yes' ELSE 'No - Requires redesign' END FROM ix
  UNION ALL SELECT project_id, 90, '0000', '**Total Native Queries:** ' || native_queries FROM p
  {challenges}
  UNION ALL SELECT project_id, 100, '1|' || id || '|0', '### Risk ' || no || ': ' || id || ' - ' || category FROM nrisks
  UNION ALL SELECT project_id, 100, '1|' || id || '|1', '**Severity:** ' || severity FROM risks
  UNION ALL SELECT project_id, 100, '1|' || id || '|2', '**Description:** ' || description FROM risks
  UNION ALL SELECT project_id, 100, '1|' || id || '|3', '**Impact:** ' || impact FROM risks
  UNION ALL SELECT project_id, 100, '1|' || id || '|4', '**Mitigation Strategy:** ' || mitigation FROM risks
  UNION ALL SELECT project_id, 110, '1|' || lpad(CAST(rule_no AS VARCHAR), 19, '0'),
      '- **' || dimension || '** (' || severity || '): ' || issue || ' - ' || mitigation FROM recs)
SELECT project_id, 'pg-as-is-analysis' AS doc, section, sub, line FROM rows"""


def metadata_sql(W: str) -> str:
    """M16 document of a PostgreSQL project, from the p CTE of the as-is report."""
    base = report_rows_sql(W, "SELECT 1 AS x", "SELECT '' AS project_id, '' AS id, '' AS category, '' AS severity, '' AS description, '' AS impact, '' AS mitigation")
    cut = base[:base.index(",\nrisks AS (")]
    db = [("tables", "db_tables"), ("views", "db_views"), ("functions", "db_functions"), ("stored_procedures", "db_sp"), ("triggers", "db_triggers"),
          ("indexes", "db_indexes"), ("sequences", "db_sequences"), ("partitioned_tables", "db_parts")]
    num = lambda k, v: f"'{k}': CAST({v} AS BIGINT)"
    return cut + f"""
SELECT project_id, CAST(to_json({{
  'source_analysis': {{{num('total_files', 'total_files_all')}, {num('total_loc', 'total_loc')}, 'ormFramework': ormf,
    'database': {{{', '.join(num(k, v) for k, v in db)}}}, {num('nativeQueryCount', 'native_queries')}}},
  'complexity_summary': summary,
  'migrationComplexity': {{{num('overall', 'overall')}, {', '.join(num(d, d) for d in PG.DIMS)}, 'difficulty': difficulty, 'description': description}}
}}) AS VARCHAR) AS metadata FROM p"""
