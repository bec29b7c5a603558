"""DuckDB oracle for the migration data checks."""

from migscope.operators import pgfeat as G
from migscope.operators import validate as V
from migscope.plans import queries as Q
from migscope.sources.generated import ORDERS_CHANGES_SQL, TABLE_KEYS_SQL, TABLES_SQL, TARGET_SQL
from oracle.common import for_duckdb, load_units_ctes
from oracle.cobol import files_cte as cobol_files_cte
from oracle.ddl import STMTS, files_cte as ddl_files_cte


def tgt(name: str) -> str:
    return f"t_{name} AS ({for_duckdb(TARGET_SQL[name])})"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def canon(cols_types) -> str:
    """Each field as length:text; (NULL as N;), fractions as whole part and 2**-53rds."""
    parts = []
    for col, t in cols_types:
        if t == "num":
            e = (f"(CAST(CAST(floor({col}) AS BIGINT) AS VARCHAR) || '+' || "
                 f"CAST(CAST(floor(({col} - floor({col})) * 9007199254740992.0::DOUBLE) AS BIGINT) AS VARCHAR))")
        elif t == "ts":
            e = f"strftime(CAST({col} AS TIMESTAMP), '%Y-%m-%d %H:%M:%S.%f')"
        else:
            e = f"CAST({col} AS VARCHAR)"
        parts.append(f"CASE WHEN {col} IS NULL THEN 'N;' ELSE length({e}) || ':' || {e} || ';' END")
    return " || ".join(parts)


def digest(cols_types) -> str:
    return f"CAST(('0x' || substr(md5({canon(cols_types)}), 1, 15)) AS BIGINT)"


ORDERS_COLS = [("o_orderkey", "int"), ("o_custkey", "int"), ("o_orderstatus", "str"), ("o_totalprice", "num"),
               ("o_orderdate", "ts"), ("o_orderpriority", "str")]


def checksum_sql(src: str, tgt_: str, key: str, cols, buckets: int) -> str:
    def side(t, p):
        return (f"SELECT CAST({key} % {buckets} AS BIGINT) AS bucket, count(*) AS {p}_rows, "
                f"bit_xor({digest(cols)}) AS {p}_checksum, CAST(sum(CAST({digest(cols)} AS HUGEINT)) AS VARCHAR) AS {p}_sum "
                f"FROM {t} GROUP BY 1")
    return f"""
SELECT coalesce(s.bucket, t.bucket) AS bucket, CAST(coalesce(source_rows, 0) AS BIGINT) AS source_rows,
  CAST(coalesce(target_rows, 0) AS BIGINT) AS target_rows, source_checksum, target_checksum, source_sum, target_sum,
  CASE WHEN coalesce(source_rows, 0) = coalesce(target_rows, 0) AND source_checksum IS NOT DISTINCT FROM target_checksum
       AND source_sum IS NOT DISTINCT FROM target_sum
       THEN 'MATCH' ELSE 'MISMATCH' END AS status
FROM ({side(src, 'source')}) s FULL JOIN ({side(tgt_, 'target')}) t ON s.bucket = t.bucket"""


def diff_sql(src: str, tgt_: str, key: str, cols: list[str], keep_same: bool) -> str:
    changed = "list_filter([" + ", ".join(f"CASE WHEN s.{x} IS DISTINCT FROM t.{x} THEN '{x}' END" for x in cols) + \
              "], lambda v: v IS NOT NULL)"
    return f"""
SELECT * FROM (
  SELECT coalesce(s.{key}, t.{key}) AS {key},
    CASE WHEN t.{key} IS NULL THEN 'missing' WHEN s.{key} IS NULL THEN 'extra'
         WHEN len({changed}) > 0 THEN 'changed' ELSE 'same' END AS status,
    CASE WHEN s.{key} IS NOT NULL AND t.{key} IS NOT NULL THEN array_to_string({changed}, ',') ELSE '' END AS changed_columns
  FROM {src} s FULL JOIN {tgt_} t ON s.{key} = t.{key}) x
{'' if keep_same else "WHERE status <> 'same'"}"""


def nulls_sql(name: str, src: str, tgt_: str, cols: list[str]) -> str:
    def prof(t):
        return " UNION ALL ".join(f"SELECT '{x}' AS column_name, CAST(count(*) FILTER (WHERE {x} IS NULL) AS BIGINT) AS n FROM {t}"
                                  for x in cols)
    return f"""
SELECT '{name}' AS table_name, coalesce(s.column_name, t.column_name) AS column_name, s.n AS source_nulls, t.n AS target_nulls,
  CASE WHEN s.n IS NOT DISTINCT FROM t.n THEN 'PASS' ELSE 'FAIL' END AS status
FROM ({prof(src)}) s FULL JOIN ({prof(tgt_)}) t ON s.column_name = t.column_name"""


SRC_TYPES = {"o_totalprice": "DOUBLE", "o_orderstatus": "VARCHAR", "o_custkey": "BIGINT",
             "c_acctbal": "DOUBLE", "c_nationkey": "INTEGER", "c_name": "VARCHAR",
             "l_quantity": "DOUBLE", "l_discount": "DOUBLE", "l_extendedprice": "DOUBLE"}


def conversion_sql() -> str:
    parts = []
    for table, rules in Q.CONVERSION_RULES.items():
        for col, t in rules:
            dt = t.upper()
            if dt.startswith("VARCHAR(") or dt.startswith("CHAR("):
                # Spark's char/varchar(n) try_cast keeps strings of length <= n only
                n = int(dt.split("(")[1].rstrip(")"))
                lost = f"{col} IS NOT NULL AND length({col}) > {n}"
            else:
                back = f"TRY_CAST(TRY_CAST({col} AS {dt}) AS {SRC_TYPES[col]})"
                lost = f"{col} IS NOT NULL AND (TRY_CAST({col} AS {dt}) IS NULL OR {back} IS DISTINCT FROM {col})"
            parts.append(f"SELECT '{table}' AS table_name, '{col}' AS column_name, '{t}' AS target_type, "
                         f"count(*) AS rows, CAST(count(*) FILTER (WHERE {lost}) AS BIGINT) AS lost FROM {table}")
    return "\nUNION ALL ".join(parts)


def sql() -> dict[str, str]:
    q = {}
    cnt_pairs = ["orders", "customer", "part", "lineitem", "documents"]
    src_counts = " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS c FROM {n}" for n in cnt_pairs + ["supplier"])
    tgt_counts = " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS c FROM t_{n}" for n in cnt_pairs)
    q["v_counts"] = "WITH " + ",\n".join(tgt(n) for n in cnt_pairs) + f"""
SELECT coalesce(s.table_name, t.table_name) AS table_name, CAST(s.c AS BIGINT) AS source_rows, CAST(t.c AS BIGINT) AS target_rows,
  CAST(coalesce(t.c, 0) - coalesce(s.c, 0) AS BIGINT) AS difference,
  CASE WHEN s.c IS NOT NULL AND t.c IS NOT NULL AND s.c = t.c THEN 'PASS' ELSE 'FAIL' END AS status
FROM ({src_counts}) s FULL JOIN ({tgt_counts}) t ON s.table_name = t.table_name"""
    q["v_checksum"] = "WITH " + tgt("orders") + checksum_sql("orders", "t_orders", "o_orderkey", ORDERS_COLS, 64)
    orph = [("lineitem->orders(target)", "lineitem", "t_orders", "l_orderkey", "o_orderkey"),
            ("orders->customer(target)", "orders", "t_customer", "o_custkey", "c_custkey"),
            ("lineitem->part", "lineitem", "part", "l_partkey", "p_partkey"),
            ("lineitem->supplier", "lineitem", "supplier", "l_suppkey", "s_suppkey"),
            ("labels->documents", "labels", "documents", "doc_id", "doc_id"),
            ("documents->labels", "documents", "labels", "doc_id", "doc_id")]
    q["v_orphans"] = "WITH " + tgt("orders") + ",\n" + tgt("customer") + "\n" + "\nUNION ALL ".join(
        f"SELECT '{n}' AS relation, count(*) AS orphans FROM {ch} c WHERE c.{fk} IS NOT NULL AND NOT EXISTS "
        f"(SELECT 1 FROM {pa} p WHERE p.{pk} = c.{fk})" for n, ch, pa, fk, pk in orph)
    ocols = ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
    q["v_diff"] = "WITH " + tgt("orders") + diff_sql("orders", "t_orders", "o_orderkey", ocols, False)
    q["v_nulls"] = "WITH " + tgt("orders") + ",\n" + tgt("customer") + "\n" + \
        nulls_sql("orders", "orders", "t_orders", ["o_orderkey"] + ocols) + "\nUNION ALL " + \
        nulls_sql("customer", "customer", "t_customer", ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"])
    q["v_conversion"] = conversion_sql()
    q["v_charset"] = "WITH " + tgt("documents") + """
SELECT count(*) FILTER (WHERE s.i AND t.i) AS rows, count(*) FILTER (WHERE t.i IS NULL) AS missing_rows,
  count(*) FILTER (WHERE s.i IS NULL) AS extra_rows, count(*) FILTER (WHERE regexp_matches(s.text, '[^\\x00-\\x7F]')) AS non_ascii_rows,
  count(*) FILTER (WHERE false) AS invalid_utf8_rows,
  count(*) FILTER (WHERE length(s.text) <> length(t.text)) AS char_length_mismatches,
  count(*) FILTER (WHERE strlen(s.text) <> strlen(t.text)) AS byte_length_mismatches,
  count(*) FILTER (WHERE s.i AND t.i AND s.text IS DISTINCT FROM t.text) AS value_mismatches,
  CAST(sum(strlen(s.text) - length(s.text)) AS BIGINT) AS multibyte_extra_bytes
FROM (SELECT *, true AS i FROM documents) s FULL JOIN (SELECT *, true AS i FROM t_documents) t ON s.doc_id = t.doc_id"""
    q["v_json"] = """
SELECT event_id, json_valid(props) AS valid, CAST(json(props) AS VARCHAR) AS canonical,
  json_extract_string(props, '$.k') AS k FROM events"""
    q["v_arrays"] = """
SELECT vec_id, CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS pos, unnest(embedding) AS value FROM embeddings"""
    q["v_bool"] = "WITH " + tgt("customer") + """
SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END AS as_written,
  CASE WHEN c_mktsegment = 'BUILDING' THEN 1 WHEN NOT (c_mktsegment = 'BUILDING') THEN 0 END AS null_keeping
FROM t_customer"""
    samp = "(SELECT * FROM orders WHERE CAST(('0x' || substr(md5(CAST(o_orderkey AS VARCHAR) || '#42'), 1, 8)) AS BIGINT) % 10000 < 1000)"
    q["v_sample"] = "WITH " + tgt("orders") + f""",
s AS {samp},
tt AS (SELECT * FROM t_orders WHERE o_orderkey IN (SELECT o_orderkey FROM s))""" + diff_sql("s", "tt", "o_orderkey", ocols, True)
    q["v_sample_n"] = "WITH " + tgt("orders") + """,
s AS (SELECT * FROM orders ORDER BY md5(CAST(o_orderkey AS VARCHAR) || '#42'), o_orderkey LIMIT 500),
tt AS (SELECT * FROM t_orders WHERE o_orderkey IN (SELECT o_orderkey FROM s))""" + diff_sql("s", "tt", "o_orderkey", ocols, True)
    some = "SELECT o_custkey, o_orderstatus, o_orderpriority FROM"
    q["v_diff_set"] = "WITH " + tgt("orders") + f"""
SELECT *, 'source_only' AS side FROM ({some} orders EXCEPT ALL {some} t_orders) UNION ALL SELECT *, 'target_only' FROM ({some} t_orders EXCEPT ALL {some} orders)"""
    q["v_array_csv"] = "SELECT o_orderkey, o_custkey || ',' || o_orderkey AS keys FROM orders"
    at = lambda x: f"strftime({x}, '%Y-%m-%d %H:%M:%S') AS {x}"
    lim = Q.HOURLY_LIMITS
    rank = lambda m, e: f"SELECT series, '{m}' AS metric, s, e, CASE WHEN {e} > {lim[m][1]} THEN 2 WHEN {e} > {lim[m][0]} THEN 1 ELSE 0 END AS r FROM g"
    q["v_alert_episodes"] = f"""WITH g AS (
  SELECT CAST(user_id AS VARCHAR) AS series, date_trunc('hour', ts) AS s, date_trunc('hour', ts) + INTERVAL 1 HOUR AS e,
    count(*) FILTER (WHERE event_type = 'error') / count(*) AS rate, avg(value) AS response FROM events GROUP BY ALL),
w AS ({rank("error_rate", "rate")} UNION ALL {rank("response", "response")}),
n AS (SELECT *, lead(s) OVER o AS nxt, lag(r) OVER o AS lr, lag(e) OVER o AS le FROM w WINDOW o AS (PARTITION BY series, metric ORDER BY s)),
i AS (SELECT *, sum(CASE WHEN r > 0 AND NOT (coalesce(lr, 0) > 0 AND le + INTERVAL {Q.HOURLY_SILENCE} SECOND > s) THEN 1 ELSE 0 END)
             OVER (PARTITION BY series, metric ORDER BY s) AS ep FROM n),
x AS (SELECT series, metric, min(s) AS raised_at, max(e) AS last_seen, count(*) AS windows, max(r) AS r, max(e) + INTERVAL {Q.HOURLY_SILENCE} SECOND AS lim, arg_max(nxt, s) AS n1,
        max(s) AS ls FROM i WHERE r > 0 GROUP BY series, metric, ep),
y AS (SELECT x.*, (SELECT i.nxt FROM i WHERE i.series = x.series AND i.metric = x.metric AND i.s = x.ls) AS nxt, (SELECT max(e) FROM w) AS horizon FROM x),
z AS (SELECT *, CASE WHEN nxt < lim THEN 'cleared' WHEN nxt IS NOT NULL OR horizon >= lim THEN 'no data' ELSE 'open' END AS reason FROM y),
c AS (SELECT *, CASE reason WHEN 'cleared' THEN nxt WHEN 'no data' THEN lim END AS closed_at FROM z)
SELECT series, metric, {at("raised_at")}, {at("last_seen")}, windows, CASE r WHEN 2 THEN 'CRITICAL' ELSE 'WARNING' END AS level, {at("closed_at")}, reason FROM c"""
    rules = []
    for table, rs in Q.BUSINESS_RULES.items():
        for name, expr in rs:
            rules.append(f"SELECT '{table}' AS table_name, '{name}' AS rule, count(*) AS rows, "
                         f"CAST(count(*) FILTER (WHERE NOT coalesce({expr}, false)) AS BIGINT) AS violations FROM {table}")
    q["v_rules"] = "SELECT *, CASE WHEN violations = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM (" + \
        "\nUNION ALL ".join(rules) + ")"
    tmap = " UNION ALL ".join(f"SELECT '{t}' AS type, '{o}' AS target_type" for t, o, _ in G.PG_TYPE_MAP)
    W = "WITH " + ddl_files_cte() + STMTS + f",\ntmap AS ({tmap})"
    q["v_type_map"] = W + """
SELECT c.project_id, c.path, c.table_name, c.column_name, c.data_type, coalesce(m.target_type, c.data_type) AS target_type,
  m.target_type IS NOT NULL AS mapped
FROM cols c LEFT JOIN tmap m ON m.type = c.data_type"""
    q["v_schema_diff"] = W + """,
a AS (SELECT c.project_id, c.path, c.table_name, c.column_name, coalesce(m.target_type, c.data_type) AS data_type, c.nullable, c.default_value
      FROM cols c LEFT JOIN tmap m ON m.type = c.data_type),
b AS (SELECT project_id, path, table_name, column_name, CASE WHEN k % 13 = 0 THEN 'CLOB' ELSE data_type END AS data_type,
        CASE WHEN k % 17 = 0 THEN true ELSE nullable END AS nullable, default_value
      FROM (SELECT *, CAST(regexp_extract(path, 'C(\\d+)\\.sql$', 1) AS BIGINT) AS k FROM a) WHERE k % 11 <> 0),
j AS (
  SELECT coalesce(a.project_id, b.project_id) AS project_id, coalesce(a.path, b.path) AS path,
    coalesce(a.table_name, b.table_name) AS table_name, coalesce(a.column_name, b.column_name) AS column_name,
    a.data_type AS a_data_type, b.data_type AS b_data_type, a.project_id IS NOT NULL AS ina, b.project_id IS NOT NULL AS inb,
    list_filter([CASE WHEN a.data_type IS DISTINCT FROM b.data_type THEN 'data_type' END,
                 CASE WHEN a.nullable IS DISTINCT FROM b.nullable THEN 'nullable' END,
                 CASE WHEN a.default_value IS DISTINCT FROM b.default_value THEN 'default_value' END], lambda v: v IS NOT NULL) AS d
  FROM a FULL JOIN b ON a.project_id = b.project_id AND a.path = b.path AND a.table_name = b.table_name
    AND a.column_name = b.column_name)
SELECT project_id, path, table_name, column_name,
  CASE WHEN NOT inb THEN 'missing_in_target' WHEN NOT ina THEN 'extra_in_target' WHEN len(d) > 0 THEN 'different' ELSE 'same' END AS status,
  CASE WHEN ina AND inb THEN array_to_string(d, ',') ELSE '' END AS differences, a_data_type, b_data_type
FROM j WHERE NOT (ina AND inb AND len(d) = 0)"""
    q["v_object_diff"] = W + """,
a AS (
  SELECT project_id, path, 'table' AS kind, table_name AS name, NULL AS definition FROM tables
  UNION ALL SELECT project_id, path, 'primary key', table_name, primary_key FROM tables WHERE primary_key IS NOT NULL
  UNION ALL SELECT project_id, path, 'foreign key', fk_name, table_name || '(' || columns || ') -> ' || referenced_table || '(' || referenced_columns || ')' FROM fks
  UNION ALL SELECT project_id, path, lower(kind), name, NULL FROM obj WHERE name <> '' AND kind <> 'TABLE'),
a1 AS (SELECT project_id, path, kind, name, min(definition) AS d FROM a GROUP BY ALL),
b0 AS (SELECT *, CAST(regexp_extract(path, 'C(\\d+)\\.sql$', 1) AS BIGINT) AS k FROM a),
b1 AS (SELECT project_id, path, kind, name, min(CASE WHEN k % 13 = 0 THEN reverse(definition) ELSE definition END) AS d, true AS there
       FROM b0 WHERE k % 11 <> 0 GROUP BY ALL)
SELECT a1.project_id, a1.path, a1.kind, a1.name, CASE WHEN there IS NULL THEN 'missing_in_target' ELSE 'different' END AS status,
  a1.d AS a_definition, b1.d AS b_definition
FROM a1 LEFT JOIN b1 ON a1.project_id = b1.project_id AND a1.path = b1.path AND a1.kind = b1.kind AND a1.name = b1.name
WHERE there IS NULL OR a1.d IS DISTINCT FROM b1.d"""
    q["v_type_map_oracle_pg"] = W + """,
o AS (SELECT c.project_id, c.path, c.table_name, c.column_name, c.length, coalesce(m.target_type, c.data_type) AS t
      FROM cols c LEFT JOIN tmap m ON m.type = c.data_type),
d AS (SELECT project_id, path, table_name, column_name,
        CASE WHEN t = 'VARCHAR' THEN 'VARCHAR2(' || coalesce(length, 255) || ')' WHEN t IN ('INTEGER', 'INT') THEN 'NUMBER(10,0)'
             WHEN t = 'TIMESTAMP' THEN 'DATE' WHEN t IN ('NUMERIC', 'DECIMAL') THEN 'NUMBER(10,2)' ELSE t END AS data_type FROM o),
e AS (SELECT *, CASE WHEN data_type = 'NUMBER(10,0)' THEN 'INTEGER'
        WHEN regexp_full_match(data_type, 'NUMBER(\\([0-9, ]+\\))?') THEN replace(data_type, 'NUMBER', 'NUMERIC')
        WHEN regexp_full_match(data_type, 'VARCHAR2\\([0-9]+\\)') THEN replace(data_type, 'VARCHAR2', 'VARCHAR')
        WHEN data_type = 'DATE' THEN 'TIMESTAMP' WHEN data_type = 'CLOB' THEN 'TEXT' WHEN data_type = 'BLOB' THEN 'BYTEA'
        WHEN regexp_full_match(data_type, 'RAW\\([0-9]+\\)') THEN 'BYTEA' END AS x FROM d)
SELECT project_id, path, table_name, column_name, data_type, coalesce(x, data_type) AS target_type, x IS NOT NULL AS mapped,
  CASE WHEN x IS NULL THEN NULL WHEN data_type = 'DATE' THEN 'Medium' ELSE 'Low' END AS risk FROM e"""
    q["v_json_compare"] = """
WITH t AS (SELECT event_id, CASE WHEN event_id % 103 = 0 THEN '{"k": -1}' WHEN event_id % 107 = 0 THEN '{"k":' ELSE ' ' || props END AS props
           FROM events WHERE event_id % 101 <> 0),
j AS (SELECT CASE WHEN t.event_id IS NULL THEN 'missing' WHEN NOT json_valid(t.props) THEN 'invalid'
        WHEN CAST(json(s.props) AS VARCHAR) = CAST(json(t.props) AS VARCHAR) THEN 'same' ELSE 'changed' END AS status
      FROM events s LEFT JOIN t ON s.event_id = t.event_id)
SELECT status, count(*) AS rows FROM j GROUP BY status"""
    q["v_load_order"] = "WITH RECURSIVE " + ddl_files_cte() + STMTS + """,
nodes AS (SELECT DISTINCT project_id, table_name AS tbl FROM tables),
edges AS (SELECT DISTINCT f.project_id, f.table_name AS tbl, f.referenced_table AS parent FROM fks f
          JOIN nodes n ON n.project_id = f.project_id AND n.tbl = f.referenced_table WHERE f.table_name <> f.referenced_table),
paths(project_id, tbl, depth) AS (
  SELECT project_id, tbl, 0 FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.project_id = n.project_id AND e.tbl = n.tbl)
  UNION ALL
  SELECT e.project_id, e.tbl, p.depth + 1 FROM paths p JOIN edges e ON e.project_id = p.project_id AND e.parent = p.tbl
  WHERE p.depth < 64)
SELECT project_id, tbl AS "table", level, CASE WHEN level IS NULL THEN 'cycle' ELSE 'ordered' END AS status
FROM (SELECT n.project_id, n.tbl, (SELECT max(depth) FROM paths p WHERE p.project_id = n.project_id AND p.tbl = n.tbl) AS level FROM nodes n)"""
    q["v_load_units"] = f"""WITH RECURSIVE nodes AS (SELECT DISTINCT project_id, "table" AS node FROM ({for_duckdb(TABLES_SQL)})),
every AS (SELECT DISTINCT k.project_id, k."table" AS a, k.parent AS b FROM ({for_duckdb(TABLE_KEYS_SQL)}) k
          JOIN nodes x ON x.project_id = k.project_id AND x.node = k."table" JOIN nodes y ON y.project_id = k.project_id AND y.node = k.parent)""" \
        + load_units_ctes() + """
SELECT project_id, node AS "table", unit, unit_size, level, deferred FROM load_units"""
    q["v_checksum_tree"] = "WITH " + tgt("orders") + f""",
rows AS (
  SELECT 's' AS side, o_orderkey AS k, {digest(ORDERS_COLS)} AS d FROM orders
  UNION ALL SELECT 't', o_orderkey, {digest(ORDERS_COLS)} FROM t_orders),
nodes AS (
  SELECT side, level, k >> (6 + 4 * level) AS node, count(*) AS rows, {", ".join(
        f"list_reduce(list_prepend(0::BIGINT, list(d % {p} + 1 ORDER BY k, d)), lambda a, x: (a * {base} + x) % {p}) AS h{i}" for i, (p, base) in enumerate(V.ORDERED))}
  FROM rows, range(16) r(level) GROUP BY ALL),
top AS (SELECT max(t) AS t FROM (SELECT side, min(level) AS t FROM (SELECT side, level, count(*) AS n FROM nodes GROUP BY ALL) WHERE n = 1 GROUP BY side)),
s AS (SELECT * FROM nodes WHERE side = 's'), t AS (SELECT * FROM nodes WHERE side = 't')
SELECT CAST(coalesce(s.level, t.level) AS INTEGER) AS level, coalesce(s.node, t.node) AS node, coalesce(s.rows, 0) AS source_rows, coalesce(t.rows, 0) AS target_rows,
  s.h0 || ':' || s.h1 AS source_hash, t.h0 || ':' || t.h1 AS target_hash
FROM s FULL JOIN t ON s.level = t.level AND s.node = t.node
WHERE (s.rows, s.h0, s.h1) IS DISTINCT FROM (t.rows, t.h0, t.h1) AND coalesce(s.level, t.level) <= (SELECT t FROM top)"""
    q["v_checksum_rows"] = q["v_diff"]
    q["v_delta"] = f"""WITH {tgt('orders')},
ch AS ({for_duckdb(ORDERS_CHANGES_SQL)}),
latest AS (SELECT o_orderkey, arg_max(ch, seq) AS c FROM ch GROUP BY o_orderkey)
SELECT coalesce(b.o_orderkey, l.o_orderkey) AS o_orderkey,
  CASE WHEN l.c IS NOT NULL THEN l.c.o_custkey ELSE b.o_custkey END AS o_custkey,
  CASE WHEN l.c IS NOT NULL THEN l.c.o_orderstatus ELSE b.o_orderstatus END AS o_orderstatus,
  CASE WHEN l.c IS NOT NULL THEN l.c.o_totalprice ELSE b.o_totalprice END AS o_totalprice,
  strftime(CASE WHEN l.c IS NOT NULL THEN l.c.o_orderdate ELSE b.o_orderdate END, '%Y-%m-%d %H:%M:%S') AS o_orderdate,
  CASE WHEN l.c IS NOT NULL THEN l.c.o_orderpriority ELSE b.o_orderpriority END AS o_orderpriority
FROM t_orders b FULL JOIN latest l ON b.o_orderkey = l.o_orderkey
WHERE l.c IS NULL OR l.c.op <> 'D'"""
    q["v_latency"] = """
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS requests, avg(value) AS mean_latency,
  quantile_cont(value, 0.95) AS p95_latency, count(*) FILTER (WHERE event_type = 'error') AS errors,
  CASE WHEN avg(value) < 2000.0 AND quantile_cont(value, 0.95) < 5000.0 AND count(*) FILTER (WHERE event_type = 'error') = 0
       THEN 'PASS' ELSE 'FAIL' END AS status
FROM events GROUP BY CAST(ts AS DATE)"""
    q["v_alerts"] = f"""
SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, strftime(w + INTERVAL 1 MINUTE, '%Y-%m-%d %H:%M:%S') AS window_end,
  count(*) AS events, count(*) FILTER (WHERE event_type = 'error') AS errors,
  count(*) FILTER (WHERE event_type = 'error') / count(*) AS error_rate, avg(value) AS avg_response,
  CASE WHEN count(*) FILTER (WHERE event_type = 'error') / count(*) > {V.ERROR_RATE_CRITICAL} THEN 'CRITICAL'
       WHEN count(*) FILTER (WHERE event_type = 'error') / count(*) > {V.ERROR_RATE_WARNING} THEN 'WARNING' ELSE 'OK' END AS error_level,
  CASE WHEN avg(value) > {V.RESPONSE_CRITICAL_MS} THEN 'CRITICAL' WHEN avg(value) > {V.RESPONSE_WARNING_MS} THEN 'WARNING' ELSE 'OK' END AS response_level
FROM (SELECT *, time_bucket(INTERVAL 1 MINUTE, ts) AS w FROM events) GROUP BY w"""
    base = " UNION ALL ".join(f"SELECT {lit(m)} AS metric, {lit(d)} AS description, {b} AS baseline, {t} AS target, {lit(e)} AS event_type"
                              for m, d, b, t, e in Q.PERF_BASELINE)
    q["v_baseline"] = f"""WITH base AS ({base}),
act AS (SELECT event_type, quantile_cont(value, 0.95) AS actual FROM events GROUP BY event_type)
SELECT metric, description, baseline, target, actual,
  CASE WHEN actual IS NULL THEN 'NO DATA' WHEN actual <= target THEN 'PASS' ELSE 'FAIL' END AS status
FROM base LEFT JOIN act USING (event_type)"""
    q["v_table_summary"] = "WITH " + ddl_files_cte() + STMTS + """
SELECT project_id, path, table_name, n_columns, n_foreign_keys, n_indexes, coalesce(replace(primary_key, ',', ', '), '') AS primary_key
FROM tables"""
    ccols = [("c_custkey", "int"), ("c_name", "str"), ("c_nationkey", "int"), ("c_acctbal", "dec"), ("c_mktsegment", "str")]
    q["v_migrate"] = """WITH m AS (
  SELECT c_custkey, c_name, c_nationkey, CAST(c_acctbal AS DECIMAL(12,2)) AS c_acctbal,
    CASE WHEN c_mktsegment = 'BUILDING' THEN '1' WHEN NOT (c_mktsegment = 'BUILDING') THEN '0' END AS c_mktsegment FROM customer)
""" + checksum_sql("m", "m", "c_custkey", ccols, 16)
    q["cobol_complexity_stats"] = "WITH " + cobol_files_cte() + """
SELECT project_id, avg(complexity) AS avg_complexity, max(complexity) AS max_complexity FROM files GROUP BY project_id"""
    return q
