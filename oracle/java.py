"""DuckDB oracle for the Java and ORM configuration scans."""

from migscope.operators import java as J
from migscope.operators import orm as O
from migscope.sources.generated import java_files_sql, orm_files_sql
from oracle.common import for_duckdb, js_trim


def esc(p: str) -> str:
    return p.replace("'", "''")


def flags(rules, text="content") -> str:
    items = ", ".join(f"CASE WHEN regexp_matches({text}, '{esc(p)}') THEN '{esc(lbl)}' END" for lbl, p in rules)
    return f"list_filter([{items}], lambda x: x IS NOT NULL)"


def joined(expr: str, sep: str = "|") -> str:
    return f"array_to_string({expr}, '{sep}')"


def cnt(p: str, text="content") -> str:
    return f"CAST(len(regexp_extract_all({text}, '{esc(p)}', 0)) AS BIGINT)"


def ordered_distinct(expr: str) -> str:
    return f"list_filter({expr}, lambda v, i: list_position({expr}, v) = i)"


JFILES = f"jf AS ({for_duckdb(java_files_sql())})"
BASE = f""",
jb AS (
  SELECT project_id, path, content,
    CASE WHEN regexp_extract(path, '([^/]+)$', 1) LIKE '%.java' AND length(regexp_extract(path, '([^/]+)$', 1)) > 5
         THEN left(regexp_extract(path, '([^/]+)$', 1), length(regexp_extract(path, '([^/]+)$', 1)) - 5)
         ELSE regexp_extract(path, '([^/]+)$', 1) END AS name
  FROM jf),
jl AS (
  SELECT project_id, path, {js_trim('unnest(string_split(content, chr(10)))')} AS t,
         generate_subscripts(string_split(content, chr(10)), 1) AS n FROM jf),
jm AS (
  SELECT *, CASE WHEN contains(t, '*/') THEN false WHEN contains(t, '/*') THEN true END AS marker FROM jl),
js AS (
  SELECT *, coalesce(last_value(marker IGNORE NULLS) OVER (PARTITION BY project_id, path ORDER BY n
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS inb_before FROM jm),
loc AS (
  SELECT project_id, path, CAST(sum(CASE WHEN NOT contains(t, '*/') AND NOT (contains(t, '/*') OR inb_before)
      AND t <> '' AND NOT starts_with(t, '//') THEN 1 ELSE 0 END) AS BIGINT) AS loc
  FROM js GROUP BY project_id, path),
jfiles AS (
  SELECT jb.project_id, jb.path, jb.name,
    CASE {' '.join(f"WHEN regexp_matches(content, '{esc(p)}') THEN '{lbl}'" for lbl, p in J.TYPE_BY_ANNOTATION)}
         {' '.join(f"WHEN {' OR '.join(f'ends_with(name, {chr(39)}{s}{chr(39)})' for s in sufs)} THEN '{lbl}'" for lbl, sufs in J.TYPE_BY_SUFFIX)}
         ELSE 'Other' END AS type,
    loc.loc,
    CASE {' '.join(f"WHEN regexp_matches(content, '{esc(p)}') THEN '{lbl}'" for lbl, p in J.ORM_RULES)} ELSE 'None' END AS orm_framework,
    {cnt('@Repository')} AS repository_annotations,
    {cnt('@Entity|@Table')} AS entity_annotations,
    {cnt('@Mapper')} AS mapper_annotations,
    list_filter([{', '.join(f"CASE WHEN contains(content, '{a}') THEN '{a}' END" for a in J.JPA_ANNOTATIONS)}], lambda x: x IS NOT NULL) AS jpa_annotations,
    list_transform(list_concat({', '.join(f"regexp_extract_all(content, '(?i){esc(p)}', 0)" for p in J.PG_FUNCTION_PATTERNS)}),
                   lambda m: {js_trim("regexp_replace(m, '\\s*\\(', '', 'g')")}) AS fn_all,
    {flags([(w, rf'(?i)\b{w}\b') for w in J.PG_TYPE_WORDS])} AS pg_data_types,
    {flags(J.PG_OPERATORS)} AS pg_operators,
    {cnt(J.RE_JDBC)} AS jdbc_calls,
    {cnt('PreparedStatement')} AS prepared_statements,
    {flags(J.SCHEMA_CODE)} AS schema_code,
    {flags(J.EXTENSION_USAGE)} AS extension_usage
  FROM jb JOIN loc USING (project_id, path)),
jfile AS (SELECT * EXCLUDE (fn_all), {ordered_distinct('fn_all')} AS pg_functions FROM jfiles)"""


def matches_cte(name: str, pattern: str, groups: list[int]) -> str:
    """name(project_id, path, ord, line, g<k>...) : matches with 1-based start line."""
    gsel = ", ".join(f"regexp_extract_all(content, '{esc(pattern)}', {g}) AS g{g}" for g in groups)
    gpick = ", ".join(f"coalesce(g{g}[i], '') AS g{g}" for g in groups)
    return f""",
{name}_a AS (
  SELECT project_id, path, string_split_regex(content, '{esc(pattern)}') AS pieces,
         regexp_extract_all(content, '{esc(pattern)}', 0) AS ms, {gsel} FROM jf),
{name} AS (
  SELECT project_id, path, CAST(i - 1 AS BIGINT) AS ord,
    CAST(1 + list_sum(list_transform(pieces[1:i], lambda p: length(p) - length(replace(p, chr(10), ''))))
         + coalesce(list_sum(list_transform(ms[1:i-1], lambda p: length(p) - length(replace(p, chr(10), '')))), 0) AS BIGINT) AS line,
    {gpick}
  FROM {name}_a, LATERAL (SELECT unnest(generate_series(1, len(ms))) AS i) WHERE len(ms) > 0)"""


def features(q: str) -> str:
    items = [f"CASE WHEN regexp_matches({q}, '{esc(p)}') THEN '{esc(lbl)}' END" for lbl, p in J.QUERY_FEATURES]
    items += [f"CASE WHEN contains(upper({q}), '{f.upper()}') THEN '{f}() function' END" for f in J.QUERY_FUNCTION_FAMILIES]
    return f"list_filter([{', '.join(items)}], lambda x: x IS NOT NULL)"


QUERIES = (matches_cte("ann", J.RE_ANNOTATION_QUERY, [1, 2]) + matches_cte("lit", J.RE_LITERAL_QUERY, [1]) + f""",
jq0 AS (
  SELECT project_id, path, ord, line, CASE WHEN g1 <> '' THEN g1 ELSE g2 END AS query, 'annotation' AS type FROM ann
  UNION ALL
  SELECT project_id, path, ord, line, g1, 'string_literal' FROM lit),
jq1 AS (SELECT *, {features('query')} AS features FROM jq0),
jq AS (SELECT *, len(features) > 0 AS has_pg_syntax FROM jq1 WHERE type = 'annotation' OR len(features) > 0)""")


OFILES = f"of0 AS ({for_duckdb(orm_files_sql())})"
OKIND = f""",
ofk AS (
  SELECT project_id, path, content, regexp_extract(path, '([^/]+)$', 1) AS file_name,
    CASE WHEN lower(regexp_extract(regexp_extract(path, '([^/]+)$', 1), '(\\.[^.]*)$', 1)) = '.xml' THEN
      CASE WHEN contains(content, '<!DOCTYPE mapper') OR contains(content, '<mapper') THEN 'MyBatis'
           WHEN contains(content, '<persistence') OR contains(content, '<entity-mappings') THEN 'JPA'
           WHEN contains(content, '<!DOCTYPE hibernate-mapping') OR contains(content, '<hibernate-mapping') THEN 'Hibernate'
           ELSE 'Unknown' END
    ELSE 'Unknown' END AS kind
  FROM of0)"""


def orm_rows(kind: str, pattern: str, ngroups: int, tag_ord: int, qtype: str, two_alt: bool) -> str:
    arrs = ", ".join(f"regexp_extract_all(content, '{esc(pattern)}', {g}) AS a{g}" for g in range(1, ngroups + 1))
    picks = ", ".join(f"coalesce(a{g}[i], '') AS a{g}" for g in range(1, ngroups + 1))
    idv = "CASE WHEN a1 <> '' THEN a1 ELSE a3 END" if two_alt else "a1"
    rawv = "CASE WHEN a2 <> '' THEN a2 ELSE a4 END" if two_alt else "a2"
    return (f"SELECT project_id, path, {tag_ord} AS tag_ord, ord, {idv} AS id, '{qtype}' AS type, {rawv} AS raw FROM "
            f"(SELECT project_id, path, CAST(i - 1 AS BIGINT) AS ord, {picks} FROM "
            f"(SELECT project_id, path, {arrs} FROM ofk WHERE kind = '{kind}') x, "
            f"LATERAL (SELECT unnest(generate_series(1, len(a1))) AS i))")


def clean(x: str) -> str:
    for a, b in O.ENTITY_REPLACEMENTS:
        x = f"replace({x}, '{esc(a)}', '{esc(b)}')"
    return js_trim(x)


def orm_feature_lists(s: str) -> dict:
    syn = [(n, f, f"regexp_matches({s}, '{esc(p)}')") for n, f, p in O.SYNTAX_RULES]
    fun = [(n, f"{n}() function", f"regexp_matches({s}, '(?i)\\b{n}')") for n in O.FUNCTION_NAMES]
    typ = [(t, f"{t} data type", f"regexp_matches({s}, '(?i)\\b{t}\\b')") for t in O.TYPE_NAMES]
    ops = [(n, f, f"regexp_matches({s}, '{esc(p)}')") for n, f, p in O.OPERATOR_RULES]

    def lst(items):
        return "list_filter([" + ", ".join(f"CASE WHEN {h} THEN '{esc(v)}' END" for v, h in items) + "], lambda x: x IS NOT NULL)"
    return dict(features=lst([(f, h) for _, f, h in syn + fun + typ + ops]),
                functions=lst([(n, h) for n, _, h in fun]),
                data_types=lst([(n, h) for n, _, h in typ]),
                syntax=lst([(n, h) for n, _, h in syn + ops]))


def orm_queries_cte() -> str:
    rows = []
    for i, tag in enumerate(O.MYBATIS_TAGS):
        pat = rf"(?i)<{tag}[^>]*id=[\"']([^\"']+)[\"'][^>]*>([\s\S]*?)</{tag}>"
        rows.append(orm_rows("MyBatis", pat, 2, i, tag, False))
    rows.append(orm_rows("JPA", O.RE_JPA_NAMED, 4, 0, "select", True))
    rows.append(orm_rows("Hibernate", O.RE_HIBERNATE, 4, 0, "select", True))
    fl = orm_feature_lists("sql")
    return OKIND + f""",
oq0 AS ({' UNION ALL '.join(rows)}),
oq1 AS (SELECT project_id, path, tag_ord, ord, id, type, {clean('raw')} AS sql FROM oq0),
oq AS (SELECT *, {fl['features']} AS features, {fl['functions']} AS functions, {fl['data_types']} AS data_types,
              {fl['syntax']} AS syntax FROM oq1)"""


def ofile_union(col: str) -> str:
    return f"""(SELECT list(v ORDER BY tag_ord, ord, j) FROM (
      SELECT v, tag_ord, ord, j, row_number() OVER (PARTITION BY v ORDER BY tag_ord, ord, j) AS rn FROM (
        SELECT unnest({col}) AS v, generate_subscripts({col}, 1) AS j, tag_ord, ord FROM oq
        WHERE oq.project_id = ofk.project_id AND oq.path = ofk.path)) WHERE rn = 1)"""


def sql() -> dict[str, str]:
    W = "WITH " + JFILES + BASE
    q = {}
    q["java_loc"] = W + "\nSELECT project_id, path, name, loc FROM jfile"
    q["java_kind"] = W + "\nSELECT project_id, path, name, type FROM jfile"
    q["java_orm"] = W + "\nSELECT project_id, path, orm_framework FROM jfile"
    arr = ["jpa_annotations", "pg_functions", "pg_data_types", "pg_operators", "schema_code", "extension_usage"]
    q["java_features"] = W + f"""
SELECT project_id, path, repository_annotations, entity_annotations, mapper_annotations, jdbc_calls, prepared_statements,
  {', '.join(f"{joined(a)} AS {a}" for a in arr)} FROM jfile"""
    q["java_queries"] = "WITH " + JFILES + QUERIES + f"""
SELECT project_id, path, ord, line, query, type, {joined('features')} AS features, has_pg_syntax FROM jq"""
    q["java_inventory"] = W + QUERIES + """,
nq AS (SELECT project_id, path, count(*) AS n FROM jq GROUP BY ALL)
SELECT f.project_id, f.path, f.name, f.type, f.loc, f.orm_framework, CAST(coalesce(nq.n, 0) AS BIGINT) AS native_queries,
  coalesce(nq.n, 0) > 0 OR len(f.pg_functions) > 0 OR len(f.pg_data_types) > 0 AS has_pg_dependency
FROM jfile f LEFT JOIN nq USING (project_id, path)"""
    O_W = "WITH " + OFILES + orm_queries_cte()
    q["orm_queries"] = O_W + f"""
SELECT project_id, path, tag_ord, ord, id, type, sql, {joined('features')} AS features, {joined('functions')} AS functions,
  {joined('data_types')} AS data_types, {joined('syntax')} AS syntax, len(features) > 0 AS has_pg_features FROM oq"""
    q["orm_kind"] = O_W + f""",
ok AS (
  SELECT project_id, path, file_name, kind,
    CAST(CASE WHEN kind = 'MyBatis' THEN len(regexp_extract_all(content, '{esc(O.RE_RESULT_MAP)}', 0)) ELSE 0 END AS BIGINT) AS result_maps,
    CAST(CASE WHEN kind = 'MyBatis' THEN len(regexp_extract_all(content, '{esc(O.RE_DYNAMIC)}', 0)) ELSE 0 END AS BIGINT) AS dynamic_sql,
    CASE WHEN kind = 'MyBatis' THEN {ordered_distinct(f"regexp_extract_all(content, '{esc(O.RE_TYPE_HANDLER)}', 1)")} ELSE [] END AS type_handlers,
    CAST((SELECT count(*) FROM oq WHERE oq.project_id = ofk.project_id AND oq.path = ofk.path) AS BIGINT) AS native_queries,
    coalesce({ofile_union('functions')}, []) AS functions,
    coalesce({ofile_union('data_types')}, []) AS data_types,
    coalesce({ofile_union('syntax')}, []) AS syntax
  FROM ofk)
SELECT project_id, path, file_name, kind, result_maps, dynamic_sql, {joined('type_handlers')} AS type_handlers,
  native_queries, {joined('functions')} AS functions, {joined('data_types')} AS data_types, {joined('syntax')} AS syntax
FROM ok"""
    q["orm_counts"] = O_W + """
SELECT project_id, kind, count(*) AS files,
  CAST(sum((SELECT count(*) FROM oq WHERE oq.project_id = ofk.project_id AND oq.path = ofk.path)) AS BIGINT) AS native_queries
FROM ofk GROUP BY project_id, kind"""
    return q
