"""DuckDB oracle for DDL mining and the PostgreSQL feature inventory."""

from migscope.sources.generated import ddl_files_sql
from oracle.common import for_duckdb, js_trim


def files_cte() -> str:
    return f"files AS ({for_duckdb(ddl_files_sql())})"


STMTS = f""",
cleaned AS (
  SELECT project_id, path,
    string_split(regexp_replace(regexp_replace(content, '--[^\\n]*', '', 'g'), '/\\*[\\s\\S]*?\\*/', '', 'g'), ';') AS parts
  FROM files),
raw AS (SELECT project_id, path, unnest(parts) AS raw, generate_subscripts(parts, 1) - 1 AS stmt_no FROM cleaned),
st0 AS (SELECT project_id, path, CAST(stmt_no AS BIGINT) AS stmt_no, {js_trim('raw')} AS stmt FROM raw),
st AS (
  SELECT project_id, path, stmt_no,
    CASE WHEN starts_with(upper(stmt), 'CREATE TABLE') THEN 'TABLE'
         WHEN starts_with(upper(stmt), 'CREATE VIEW') THEN 'VIEW'
         WHEN starts_with(upper(stmt), 'CREATE SEQUENCE') THEN 'SEQUENCE'
         WHEN starts_with(upper(stmt), 'CREATE PROCEDURE') OR starts_with(upper(stmt), 'CREATE OR REPLACE PROCEDURE') THEN 'PROCEDURE'
         WHEN starts_with(upper(stmt), 'CREATE TRIGGER') THEN 'TRIGGER'
         WHEN starts_with(upper(stmt), 'CREATE FUNCTION') OR starts_with(upper(stmt), 'CREATE OR REPLACE FUNCTION') THEN 'FUNCTION'
    END AS kind, stmt
  FROM st0 WHERE length(stmt) > 0),
obj AS (
  SELECT project_id, path, stmt_no, kind, replace(replace(CASE kind
      WHEN 'TABLE' THEN regexp_extract(stmt, '(?i)CREATE\\s+TABLE\\s+([^\\s(]+)', 1)
      WHEN 'VIEW' THEN regexp_extract(stmt, '(?i)CREATE\\s+(?:OR\\s+REPLACE\\s+)?VIEW\\s+([^\\s(]+)', 1)
      WHEN 'SEQUENCE' THEN regexp_extract(stmt, '(?i)CREATE\\s+SEQUENCE\\s+([^\\s;]+)', 1)
      WHEN 'PROCEDURE' THEN regexp_extract(stmt, '(?i)CREATE\\s+(?:OR\\s+REPLACE\\s+)?PROCEDURE\\s+([^\\s(]+)', 1)
      WHEN 'TRIGGER' THEN regexp_extract(stmt, '(?i)CREATE\\s+TRIGGER\\s+([^\\s]+)', 1)
      WHEN 'FUNCTION' THEN regexp_extract(stmt, '(?i)CREATE\\s+(?:OR\\s+REPLACE\\s+)?FUNCTION\\s+([^\\s(]+)', 1)
    END, '"', ''), '`', '') AS name
  FROM st WHERE kind IS NOT NULL),
tbl AS (
  SELECT project_id, path, stmt_no,
    replace(replace(regexp_extract(stmt, '(?i)CREATE\\s+TABLE\\s+([^\\s(]+)', 1), '"', ''), '`', '') AS table_name,
    regexp_extract(stmt, '\\(([\\s\\S]+)\\)', 1) AS body
  FROM st WHERE kind = 'TABLE'),
tb AS (SELECT * FROM tbl WHERE table_name <> '' AND body <> ''),
it0 AS (SELECT project_id, path, stmt_no, table_name, string_split(body, ',') AS its FROM tb),
it AS (
  SELECT project_id, path, stmt_no, table_name, generate_subscripts(its, 1) - 1 AS pos, {js_trim('unnest(its)')} AS item
  FROM it0),
items AS (
  SELECT *, CASE
      WHEN starts_with(upper(item), 'CONSTRAINT') AND contains(upper(item), 'PRIMARY KEY') THEN 'pk'
      WHEN starts_with(upper(item), 'CONSTRAINT') AND contains(upper(item), 'FOREIGN KEY') THEN 'fk'
      WHEN starts_with(upper(item), 'PRIMARY KEY') THEN 'pk'
      WHEN NOT starts_with(upper(item), 'CONSTRAINT') THEN 'column' END AS role
  FROM it),
colp AS (
  SELECT *, regexp_split_to_array(item, '\\s+') AS parts FROM items WHERE role = 'column'),
colt AS (
  SELECT *, replace(replace(parts[1], '"', ''), '`', '') AS column_name,
    regexp_extract(parts[2], '(?i)^([A-Z0-9_]+)(?:\\((\\d+)(?:,(\\d+))?\\))?', 1) AS t1,
    regexp_extract(parts[2], '(?i)^([A-Z0-9_]+)(?:\\((\\d+)(?:,(\\d+))?\\))?', 2) AS t2,
    regexp_extract(parts[2], '(?i)^([A-Z0-9_]+)(?:\\((\\d+)(?:,(\\d+))?\\))?', 3) AS t3
  FROM colp WHERE len(parts) >= 2),
cols AS (
  SELECT project_id, path, stmt_no, table_name, CAST(pos AS BIGINT) AS col_no, column_name,
    upper(t1) AS data_type,
    CASE WHEN t2 <> '' THEN CAST(t2 AS INTEGER) END AS length,
    CASE WHEN t3 <> '' THEN CAST(t2 AS INTEGER) END AS precision,
    CASE WHEN t3 <> '' THEN CAST(t3 AS INTEGER) END AS scale,
    NOT contains(upper(item), 'NOT NULL') AS nullable,
    nullif(regexp_extract(item, '(?i)DEFAULT\\s+([^\\s,]+)', 1), '') AS default_value
  FROM colt WHERE t1 <> ''),
pk0 AS (
  SELECT project_id, path, stmt_no, pos, regexp_extract(item, '(?i)PRIMARY\\s+KEY\\s*\\(([^)]+)\\)', 1) AS pk
  FROM items WHERE role = 'pk'),
pk AS (
  SELECT project_id, path, stmt_no, arg_max(pk, pos) AS pk FROM pk0 WHERE pk <> '' GROUP BY ALL),
fk0 AS (
  SELECT project_id, path, stmt_no, table_name, pos,
    regexp_extract(item, '(?i)CONSTRAINT\\s+(\\S+)\\s+FOREIGN\\s+KEY\\s*\\(([^)]+)\\)\\s+REFERENCES\\s+([^\\s(]+)\\s*\\(([^)]+)\\)', ['n', 'c', 'r', 'rc']) AS m
  FROM items WHERE role = 'fk'),
fks AS (
  SELECT project_id, path, stmt_no, table_name, CAST(pos AS BIGINT) AS pos,
    replace(replace(m.n, '"', ''), '`', '') AS fk_name,
    array_to_string(list_transform(string_split(m.c, ','), lambda x: replace(replace({js_trim('x')}, '"', ''), '`', '')), ',') AS columns,
    replace(replace(m.r, '"', ''), '`', '') AS referenced_table,
    array_to_string(list_transform(string_split(m.rc, ','), lambda x: replace(replace({js_trim('x')}, '"', ''), '`', '')), ',') AS referenced_columns
  FROM fk0 WHERE m.n <> ''),
tables AS (
  SELECT tb.project_id, tb.path, tb.stmt_no, tb.table_name,
    CAST((SELECT count(*) FROM cols c WHERE c.project_id = tb.project_id AND c.path = tb.path AND c.stmt_no = tb.stmt_no) AS BIGINT) AS n_columns,
    (SELECT array_to_string(list_transform(string_split(pk.pk, ','), lambda x: replace(replace({js_trim('x')}, '"', ''), '`', '')), ',')
       FROM pk WHERE pk.project_id = tb.project_id AND pk.path = tb.path AND pk.stmt_no = tb.stmt_no) AS primary_key,
    CAST((SELECT count(*) FROM fks f WHERE f.project_id = tb.project_id AND f.path = tb.path AND f.stmt_no = tb.stmt_no) AS BIGINT) AS n_foreign_keys,
    CAST(0 AS BIGINT) AS n_indexes
  FROM tb),
ftot AS (
  SELECT f.project_id, f.path,
    CAST((SELECT count(*) FROM tb WHERE tb.project_id = f.project_id AND tb.path = f.path) AS BIGINT) AS tables,
    CAST((SELECT count(*) FROM cols WHERE cols.project_id = f.project_id AND cols.path = f.path) AS BIGINT) AS columns,
    CAST(0 AS BIGINT) AS indexes,
    CAST((SELECT count(*) FROM obj WHERE obj.project_id = f.project_id AND obj.path = f.path AND kind = 'VIEW') AS BIGINT) AS views,
    CAST((SELECT count(*) FROM obj WHERE obj.project_id = f.project_id AND obj.path = f.path AND kind = 'SEQUENCE') AS BIGINT) AS sequences,
    CAST((SELECT count(*) FROM obj WHERE obj.project_id = f.project_id AND obj.path = f.path AND kind = 'PROCEDURE') AS BIGINT) AS stored_procedures,
    CAST((SELECT count(*) FROM obj WHERE obj.project_id = f.project_id AND obj.path = f.path AND kind = 'TRIGGER') AS BIGINT) AS triggers,
    CAST((SELECT count(*) FROM obj WHERE obj.project_id = f.project_id AND obj.path = f.path AND kind = 'FUNCTION') AS BIGINT) AS functions
  FROM (SELECT DISTINCT project_id, path FROM st) f)"""

TOT_COLS = "tables, columns, indexes, views, sequences, stored_procedures, triggers, functions"


def _sum_cols():
    return ", ".join(f"CAST(sum({x}) AS BIGINT) AS {x}" for x in TOT_COLS.split(", "))


def _regex_rows(pattern: str, names: list[str], groups: list[int]) -> str:
    """All matches of pattern per file as rows with ord (0-based)."""
    arrs = ", ".join(f"regexp_extract_all(content, '{pattern}', {g}) AS a_{n}" for n, g in zip(names, groups))
    first = names[0]
    sel = ", ".join(f"coalesce(a_{n}[i], '') AS {n}" for n in names)
    return (f"(SELECT project_id, path, CAST(i - 1 AS BIGINT) AS ord, {sel} FROM "
            f"(SELECT project_id, path, {arrs} FROM files) x, "
            f"LATERAL (SELECT unnest(generate_series(1, len(a_{first}))) AS i))")


def esc(p: str) -> str:
    return p.replace("'", "''")


def sql() -> dict[str, str]:
    from migscope.operators import pgfeat as G
    W = "WITH " + files_cte() + STMTS
    q = {}
    q["ddl_statements"] = W + "\nSELECT project_id, path, stmt_no, kind, stmt FROM st"
    q["ddl_objects"] = W + "\nSELECT project_id, path, stmt_no, kind, name FROM obj WHERE name <> ''"
    q["ddl_columns"] = W + "\nSELECT * FROM cols"
    q["ddl_keys"] = W + "\nSELECT * FROM fks"
    q["ddl_tables"] = W + "\nSELECT * FROM tables"
    q["ddl_totals"] = W + f"\nSELECT project_id, {_sum_cols()} FROM ftot GROUP BY project_id"
    q["ddl_last_wins"] = W + f"""
SELECT project_id, {_sum_cols()} FROM ftot
WHERE path = (SELECT max(path) FROM ftot f2 WHERE f2.project_id = ftot.project_id) GROUP BY project_id"""
    tmap = " UNION ALL ".join(f"SELECT '{t}' AS type, '{o}' AS oracle_type, '{cx}' AS complexity"
                              for t, o, cx in G.PG_TYPE_MAP)
    q["pg_type_usage"] = W + f""",
tmap AS ({tmap}),
fc AS (
  SELECT project_id, path, data_type AS type, count(*) AS n,
    array_to_string(list_distinct_ordered, ',') AS tables
  FROM (SELECT c.*, list(table_name ORDER BY stmt_no, col_no) OVER (PARTITION BY project_id, path, data_type) AS l
        FROM cols c JOIN tmap ON tmap.type = c.data_type) x,
       LATERAL (SELECT list_filter(l, lambda v, i: list_position(l, v) = i) AS list_distinct_ordered)
  GROUP BY project_id, path, data_type, list_distinct_ordered),
sp AS (
  SELECT project_id, path, upper(m) AS type, count(*) AS n FROM
    (SELECT project_id, path, unnest(regexp_extract_all(content, '(?i)(SMALL|BIG)?SERIAL', 0)) AS m FROM files)
  GROUP BY ALL),
u AS (SELECT project_id, path, type, n, tables FROM fc UNION ALL SELECT project_id, path, type, n, NULL FROM sp)
SELECT u.project_id, u.path, u.type, CAST(sum(n) AS BIGINT) AS count, coalesce(max(tables), '') AS tables,
  any_value(tmap.complexity) AS complexity, any_value(tmap.oracle_type) AS oracle_type
FROM u JOIN tmap USING (type) GROUP BY u.project_id, u.path, u.type"""
    q["pg_index_types"] = "WITH " + files_cte() + f""",
m AS (SELECT project_id, path, unnest(regexp_extract_all(content, '{esc(G.RE_INDEX)}', 1)) AS m FROM files),
g AS (SELECT project_id, path, CASE WHEN coalesce(m, '') = '' THEN 'BTREE' ELSE upper(m) END AS type, count(*) AS count FROM m GROUP BY ALL)
SELECT project_id, path, type, count, type IN ('BTREE', 'HASH') AS oracle_support FROM g"""
    fn = _regex_rows(esc(G.RE_FUNCTION), ["name", "returns", "body"], [1, 2, 4])
    q["pg_functions"] = "WITH " + files_cte() + f""",
f AS {fn}
SELECT project_id, path, ord, name,
  CAST(len(list_filter(string_split(body, chr(10)), lambda l: length({js_trim('l')}) > 0)) AS BIGINT) AS complexity,
  regexp_matches(body, '(?i)EXECUTE\\s+') AS uses_dynamic_sql,
  regexp_matches(body, '(?i)ARRAY\\[|array_') AS uses_arrays,
  regexp_matches(body, '(?i)jsonb_|json_|->|->>') AS uses_json,
  regexp_matches(returns, '(?i)RETURNS\\s+TABLE') OR regexp_matches(returns, '(?i)RETURNS\\s+SETOF') AS returns_table
FROM f"""
    tr = _regex_rows(esc(G.RE_TRIGGER), ["name", "timing", "event", "for_each"], [1, 2, 3, 4])
    q["pg_triggers"] = "WITH " + files_cte() + f"""
SELECT *, false AS has_returning_clause FROM {tr}"""
    sq = _regex_rows(esc(G.RE_SEQUENCE), ["name", "dt", "inc"], [1, 2, 3])
    q["pg_sequences"] = W + f"""
SELECT project_id, path, name, CASE WHEN dt = '' THEN 'BIGINT' ELSE dt END AS data_type,
  CAST(CASE WHEN inc = '' THEN 1 ELSE CAST(inc AS BIGINT) END AS BIGINT) AS increment, false AS is_serial FROM {sq}
UNION ALL
SELECT project_id, path, table_name || '_' || column_name || '_seq',
  CASE WHEN contains(upper(data_type), 'BIG') THEN 'BIGINT' ELSE 'INTEGER' END, CAST(1 AS BIGINT), true
FROM cols WHERE regexp_matches(data_type, '(?i)SERIAL$')"""
    usage = ", ".join(f"CASE WHEN regexp_matches(content, '{esc(p)}') THEN '{n}' END" for n, p in G.EXTENSION_USAGE)
    q["pg_extensions"] = "WITH " + files_cte() + f""",
e AS (SELECT project_id, path, regexp_extract_all(content, '{esc(G.RE_EXTENSION)}', 1) AS ex,
        list_filter([{usage}], lambda x: x IS NOT NULL) AS added FROM files),
a AS (SELECT project_id, path, list_concat(ex, list_filter(added, lambda x: NOT list_contains(ex, x))) AS l FROM e)
SELECT project_id, path, CAST(generate_subscripts(l, 1) - 1 AS BIGINT) AS ord, unnest(l) AS extension FROM a"""
    pr = _regex_rows(esc(G.RE_PARTITIONED), ["name", "strategy"], [1, 2])
    q["pg_partitions"] = "WITH " + files_cte() + f""",
p AS {pr},
k AS (SELECT project_id, path, unnest(regexp_extract_all(content, '{esc(G.RE_PARTITION_OF)}', 1)) AS ref FROM files)
SELECT p.project_id, p.path, p.ord, p.name, upper(p.strategy) AS strategy,
  (SELECT count(*) FROM k WHERE k.project_id = p.project_id AND k.path = p.path
     AND starts_with(lower(k.ref), lower(p.name))) AS partition_count
FROM p"""
    q["pg_inheritance"] = "WITH " + files_cte() + f"\nSELECT * FROM {_regex_rows(esc(G.RE_INHERITS), ['name'], [1])}"
    q["pg_row_estimates"] = W + """
SELECT project_id, path, table_name, CAST(10000 AS BIGINT) AS estimated_rows, 'Small' AS size_category FROM tables"""

    def cnt(p):
        return f"CAST(len(regexp_extract_all(content, '{esc(p)}', 0)) AS BIGINT)"
    q["pg_counters"] = "WITH " + files_cte() + f"""
SELECT project_id, path,
  {cnt(G.RE_PARTIAL)} AS partial_indexes, {cnt(G.RE_EXPR_INDEX)} AS expression_indexes,
  {cnt(G.RE_RLS)} AS rls_policies, {cnt(G.RE_CHECK)} AS check_constraints,
  {cnt(G.RE_EXCLUDE)} AS exclusion_constraints, {cnt(G.RE_INDEX)} AS indexes,
  {cnt(G.RE_FUNCTION)} AS plpgsql_functions, {cnt(G.RE_TRIGGER)} AS triggers,
  {cnt(G.RE_PARTITIONED)} AS partitioned_tables, {cnt(G.RE_INHERITS)} AS inheritance_tables
FROM files"""

    def rows(pattern, names, groups, struct):
        return f"SELECT project_id, path, to_json(list({struct} ORDER BY ord)) AS j FROM {_regex_rows(esc(pattern), names, groups)} GROUP BY ALL"

    parts = {
        "types": f"""
SELECT project_id, path, to_json(list({{'type': type, 'count': count, 'tables': tables, 'complexity': complexity, 'oracle_type': oracle_type,
    'seen': {{'o1': seen[1], 'o2': seen[2], 'o3': seen[3]}}}} ORDER BY seen)) AS j
FROM (SELECT project_id, path, type, count(*) AS count, list_filter(l, lambda v, i: list_position(l, v) = i) AS tables, complexity, oracle_type, min([o1, o2, o3]) AS seen
      FROM (SELECT *, coalesce(list(tab ORDER BY o1, o2, o3) FILTER (WHERE tab IS NOT NULL) OVER (PARTITION BY project_id, path, type), []) AS l FROM met)
      JOIN tmap USING (type) GROUP BY ALL) GROUP BY ALL""",
        "indexes": """
SELECT project_id, path, to_json(list({'type': type, 'count': count, 'oracle_support': type IN ('BTREE', 'HASH'), 'first_ord': f} ORDER BY f)) AS j
FROM (SELECT project_id, path, type, count(*) AS count, min(i) - 1 AS f FROM ixm GROUP BY ALL) GROUP BY ALL""",
        "functions": rows(G.RE_FUNCTION, ["name", "returns", "body"], [1, 2, 4], f"""{{'ord': ord, 'name': name,
    'complexity': len(list_filter(string_split(body, chr(10)), lambda l: length({js_trim('l')}) > 0)),
    'uses_dynamic_sql': regexp_matches(body, '(?i)EXECUTE\\s+'), 'uses_arrays': regexp_matches(body, '(?i)ARRAY\\[|array_'),
    'uses_json': regexp_matches(body, '(?i)jsonb_|json_|->|->>'),
    'returns_table': regexp_matches(returns, '(?i)RETURNS\\s+TABLE') OR regexp_matches(returns, '(?i)RETURNS\\s+SETOF')}}"""),
        "triggers": rows(G.RE_TRIGGER, ["name", "timing", "event", "for_each"], [1, 2, 3, 4],
                         "{'ord': ord, 'name': name, 'timing': timing, 'event': event, 'for_each': for_each, 'has_returning_clause': false}"),
        "sequences": f"""
SELECT project_id, path, to_json(list({{'ord': o, 'name': name, 'data_type': dt, 'increment': inc, 'is_serial': serial}} ORDER BY o)) AS j
FROM (SELECT *, row_number() OVER (PARTITION BY project_id, path ORDER BY serial, a, b) - 1 AS o FROM (
  SELECT project_id, path, name, CASE WHEN dt = '' THEN 'BIGINT' ELSE dt END AS dt, CAST(CASE WHEN inc = '' THEN '1' ELSE inc END AS BIGINT) AS inc, false AS serial, ord AS a, 0 AS b
  FROM {_regex_rows(esc(G.RE_SEQUENCE), ["name", "dt", "inc"], [1, 2, 3])}
  UNION ALL
  SELECT project_id, path, table_name || '_' || column_name || '_seq', CASE WHEN contains(data_type, 'BIG') THEN 'BIGINT' ELSE 'INTEGER' END, 1, true, stmt_no, col_no
  FROM cols WHERE regexp_matches(data_type, 'SERIAL$'))) GROUP BY ALL""",
        "extensions": f"""
SELECT project_id, path, to_json(list_concat(ex, list_filter(added, lambda x: NOT list_contains(ex, x)))) AS j
FROM (SELECT project_id, path, regexp_extract_all(content, '{esc(G.RE_EXTENSION)}', 1) AS ex, list_filter([{usage}], lambda x: x IS NOT NULL) AS added FROM files)""",
        "partitions": f"""
SELECT p.project_id, p.path, to_json(list({{'ord': ord, 'name': name, 'strategy': upper(strategy),
    'partition_count': len(list_filter(kids, lambda k: starts_with(lower(k), lower(name))))}} ORDER BY ord)) AS j
FROM {_regex_rows(esc(G.RE_PARTITIONED), ["name", "strategy"], [1, 2])} p
JOIN (SELECT project_id, path, regexp_extract_all(content, '{esc(G.RE_PARTITION_OF)}', 1) AS kids FROM files) k ON k.project_id = p.project_id AND k.path = p.path GROUP BY ALL""",
        "inheritance": rows(G.RE_INHERITS, ["name"], [1], "{'ord': ord, 'name': name}"),
        "estimates": """
SELECT project_id, path, to_json(list({'stmt_no': stmt_no, 'table_name': table_name, 'estimated_rows': 10000, 'size_category': 'Small'} ORDER BY stmt_no)) AS j FROM tb GROUP BY ALL""",
        "objects": """
SELECT project_id, path, to_json(list({'stmt_no': stmt_no, 'kind': kind, 'name': name} ORDER BY stmt_no)) AS j FROM obj WHERE name <> '' GROUP BY ALL""",
    }
    counters = ", ".join(f"{cnt(p)} AS {n}" for n, p in G.COUNTERS.items())
    totals = {"n_tables": "tb", "n_columns": "cols", "n_statements": "st"}
    q["pg_file_features"] = W + f""",
tmap AS ({tmap}),
met AS (
  SELECT c.project_id, c.path, c.data_type AS type, c.table_name AS tab, 0 AS o1, c.stmt_no AS o2, c.col_no AS o3 FROM cols c JOIN tmap ON tmap.type = c.data_type
  UNION ALL
  SELECT project_id, path, upper(unnest(m)), NULL, 1, generate_subscripts(m, 1) - 1, 0 FROM (SELECT project_id, path, regexp_extract_all(content, '{G.RE_SERIAL}', 0) AS m FROM files)),
ixm AS (
  SELECT project_id, path, CASE WHEN coalesce(m, '') = '' THEN 'BTREE' ELSE upper(m) END AS type, i FROM (
    SELECT project_id, path, unnest(a) AS m, generate_subscripts(a, 1) AS i FROM (SELECT project_id, path, regexp_extract_all(content, '{esc(G.RE_INDEX)}', 1) AS a FROM files))),
{",".join(f"p_{n} AS ({text})" for n, text in parts.items())},
{",".join(f"n_{t} AS (SELECT project_id, path, count(*) AS n FROM {t} GROUP BY ALL)" for t in totals.values())}
SELECT files.project_id, files.path, {", ".join(f"CAST(coalesce(p_{n}.j, '[]') AS VARCHAR) AS {n}" for n in parts)}, {counters},
  {", ".join(f"CAST(coalesce(n_{t}.n, 0) AS BIGINT) AS {n}" for n, t in totals.items())}
FROM files {" ".join(f"LEFT JOIN p_{n} ON p_{n}.project_id = files.project_id AND p_{n}.path = files.path" for n in parts)}
{" ".join(f"LEFT JOIN n_{t} ON n_{t}.project_id = files.project_id AND n_{t}.path = files.path" for t in totals.values())}"""
    return q
