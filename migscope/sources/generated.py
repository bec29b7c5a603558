"""Code corpora derived from the driver's TPC-H style tables.

The driver tables contain no source code, so the assessment operators are
exercised on corpora *derived* from them: every lineitem / orders / customer /
part row becomes one line or one snippet of a file.  The derivation is plain SQL
text shared by Spark (``spark.sql`` with DataFrame parameters) and by the DuckDB
oracle, so both sides analyse byte-identical corpora that grow with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from migscope.functions.text import quote_sql

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Generated text is ~100x larger than the key columns it is derived from, and the
# per-file mining is CPU bound (regular expressions).  A key table with fewer scan
# partitions than the session's shuffle partitions is spread over that many (an
# exchange of a few key columns, not of the text); a larger table is
# mined where it is read.  The rows are dealt by the hash of their keys: a round-robin
# exchange sorts them first.
SPREAD_KEYS = {"customer": ["c_custkey"], "orders": ["o_orderkey"], "part": ["p_partkey"],
               "lineitem": ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]}


def spread(spark: SparkSession, df: DataFrame, keys: list[str], expansion: int = 1) -> DataFrame:
    """``expansion`` multiplies the wanted number of partitions, for very costly mining."""
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))) * expansion
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n, *keys)


def run_sql(spark: SparkSession, sf_dir: str, template: str, spread_tables: tuple = (),
            expansion: int = 1) -> DataFrame:
    """Run a template whose table references are written ``{name}``."""
    used = {t: read_table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in template}
    for t in spread_tables:
        used[t] = spread(spark, used[t], SPREAD_KEYS[t], expansion)
    return spark.sql(template, **used)


def for_duckdb(template: str) -> str:
    """Same template for the oracle: ``{lineitem}`` -> the registered view ``lineitem``."""
    return template.format(**{t: t for t in TABLES})


# ---------------------------------------------------------------------------
# COBOL corpus: one line per lineitem row.
# The text of the generated COBOL lines, picked by
# (l_orderkey * 7 + l_linenumber) % 30.  ``{CALL}`` and ``{COPY}`` are filled with
# key-dependent targets.
COBOL_LINES = [
    "      * IF THIS COMMENT HAS CALL 'LOGGER' IT STILL COUNTS AS AN EDGE",
    "       IDENTIFICATION DIVISION.",
    "       DATA DIVISION.",
    "       01 WS-TABLE OCCURS 10 TIMES.",
    "       01 WS-ALT REDEFINES WS-REC.",
    "       05 WS-AMT PIC S9999V99 COMP-3.",
    "       05 WS-RATE PIC 9(3)V9 PACKED-DECIMAL.",
    "       REPORT SECTION.",
    "       PROCEDURE DIVISION.",
    "       MAIN-PARA.",
    "           IF WS-AMOUNT > 100",
    "           END-IF.",
    "           EVALUATE WS-CODE",
    "               WHEN 1 PERFORM CALC-PARA UNTIL WS-DONE",
    "           END-EVALUATE.",
    "           GO TO EXIT-PARA.",
    "{CALL}",
    "{COPY}",
    "           EXEC SQL SELECT NAME INTO :WS-NAME FROM EMP END-EXEC.",
    "           OPEN INPUT EMP-FILE READ-EMP",
    "           CALL 'ILBOABN0' USING WS-ABEND",
    "           SORT SORT-FILE ON ASCENDING KEY WS-KEY",
    "",
    "\tif ws-flag = 'y' perform check-para goto err-para",
    "IF WS-X = 1 MOVE 1 TO WS-Y END-IF",
    "       READ-EMP.",
    "       exit-para.",
    "      *    END-IF COMMENTED OUT",
    "           PERFORM INIT-PARA",
    "           IF WS-A > 1 IF WS-B > 2",
]


def _lit(s: str) -> str:
    """SQL literal with braces doubled (templates are str.format-ed)."""
    return quote_sql(s).replace("{", "{{").replace("}", "}}")


def _sql_text(s: str) -> str:
    """SQL expression for a fixed line; a tab becomes chr(9) (portable)."""
    parts = s.split("\t")
    return " || chr(9) || ".join(_lit(p) for p in parts)


def cobol_lines_sql(key: str = "l_partkey", pfx: str = "P", nproj: int = 25) -> str:
    """src_lines(project_id, path, line_no, line) of the generated COBOL corpus.

    file = one value of ``key``; project = key % nproj; line order = the unique
    lineitem tuple (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice).
    This is the oracle's form; Spark numbers the lines with ``with_line_numbers``."""
    return _cobol_sql(key, pfx, nproj, f"""CAST(row_number() OVER (PARTITION BY {key}
            ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INT) AS line_no""")


def cobol_raw_sql(key: str = "l_partkey", pfx: str = "P", nproj: int = 25) -> str:
    """The COBOL corpus without line numbers: (project_id, path, block, o1..o5,
    line), where (o1..o5) is the line order and block = l_orderkey DIV 65536 a
    consecutive range of it.  A file that holds a third of all rows still
    spreads over many blocks (each holds the lines of at most 65,536 orders)."""
    return _cobol_sql(key, pfx, nproj, f"{key} AS fid, CAST(l_orderkey DIV {ORDERKEY_BLOCK} AS BIGINT) AS block, "
                                       "l_orderkey AS o1, l_linenumber AS o2, l_partkey AS o3, l_suppkey AS o4, "
                                       "l_extendedprice AS o5")


def _cobol_sql(key: str, pfx: str, nproj: int, order_cols: str) -> str:
    proj = f"'{pfx.lower()}' || CAST({key} % {nproj} AS STRING)"
    call = (f"'           CALL ''{pfx}' || CAST({key} + l_linenumber * {nproj} AS STRING)"
            f" || ''' USING WS-REC'")
    copy = "'           COPY CPY' || CAST(l_orderkey % 13 AS STRING) || '.'"
    whens = []
    for i, text in enumerate(COBOL_LINES):
        e = call if text == "{CALL}" else copy if text == "{COPY}" else _sql_text(text)
        whens.append(f"WHEN {i} THEN {e}")
    n = len(COBOL_LINES)
    return f"""
SELECT {proj} AS project_id,
       {proj} || '/{pfx}' || CAST({key} AS STRING) || '.cbl' AS path,
       {order_cols},
       CASE CAST((l_orderkey * 7 + l_linenumber) % {n} AS INT) {' '.join(whens)} END AS line
FROM {{lineitem}}"""


def cobol_paths_sql(key: str = "l_partkey", pfx: str = "P", nproj: int = 25) -> str:
    """Listing of the generated COBOL programs (no text)."""
    proj = f"'{pfx.lower()}' || CAST({key} % {nproj} AS STRING)"
    return f"""
SELECT DISTINCT {proj} AS project_id, {proj} || '/{pfx}' || CAST({key} AS STRING) || '.cbl' AS path
FROM {{lineitem}}"""


# Corpus variants used by the registered queries.
COBOL_BY_PART = dict(key="l_partkey", pfx="P", nproj=25)     # ~30 lines per file
COBOL_BY_SUPP = dict(key="l_suppkey", pfx="S", nproj=10)     # ~600 lines per file


# Line order inside a generated file and the orderkey range that blocks it.
COBOL_ORDER = ["o1", "o2", "o3", "o4", "o5"]
ORDERKEY_BLOCK = 1 << 16


def cobol_raw(spark: SparkSession, sf_dir: str, variant: dict = COBOL_BY_PART) -> DataFrame:
    """One generated line per lineitem row (~2x the key bytes): the scan is spread
    so the per-line mining, which is map-side of the first aggregate, runs on
    every core even when the input is one row group."""
    return run_sql(spark, sf_dir, cobol_raw_sql(**variant), ("lineitem",), expansion=2)


def with_line_numbers(raw: DataFrame, keys: list[str] = ["fid"], order: list[str] = COBOL_ORDER) \
        -> DataFrame:
    """Dense 1-based line numbers without a per-file window: rows are numbered
    inside (file, block), block sizes are summed over the preceding blocks of
    the file (a window over the small block table) and joined back on
    (file, block) -- the big side keeps its partitioning."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F
    local = raw.withColumn("r", F.row_number().over(Window.partitionBy(*keys, "block").orderBy(*order)))
    sizes = local.groupBy(*keys, "block").agg(F.max("r").alias("n"))
    off = sizes.withColumn("off", F.coalesce(F.sum("n").over(
        Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    j = local.join(off.select(*keys, "block", "off"), [*keys, "block"])
    return j.select("project_id", "path", (F.col("off") + F.col("r")).cast("int").alias("line_no"), "line",
                    "block", *order)


def cobol_lines(spark: SparkSession, sf_dir: str, variant: dict = COBOL_BY_PART) -> DataFrame:
    """src_lines(project_id, path, line_no, line) of the generated COBOL corpus."""
    return with_line_numbers(cobol_raw(spark, sf_dir, variant))


# ---------------------------------------------------------------------------
# SQL / DDL corpus: one file per customer, project = nation.
# DDL snippets (PostgreSQL dialect) and the key residues that
# include them.  ``{k}`` is replaced by the customer key.
DDL_SNIPPETS = [
    (1, 0, "CREATE TABLE cust_{k} (\n  id SERIAL PRIMARY KEY,\n  name VARCHAR(50) NOT NULL,\n"
           "  balance DECIMAL(9,2) DEFAULT 0,\n  tags TEXT[],\n  profile JSONB,\n"
           "  active BOOLEAN DEFAULT true,\n  PRIMARY KEY (id)\n);"),
    (2, 0, "CREATE TABLE \"orders_{k}\" (\n\torder_id BIGSERIAL NOT NULL,\n\tcust_id INTEGER NOT NULL,\n"
           "\tamount NUMERIC(12,2),\n\tip INET,\n\tguid UUID DEFAULT uuid_generate_v4(),\n"
           "\tCONSTRAINT pk_orders_{k} PRIMARY KEY (order_id),\n"
           "\tCONSTRAINT fk_orders_{k} FOREIGN KEY (cust_id) REFERENCES cust_{k} (id)\n);"),
    (3, 0, "CREATE INDEX idx_cust_{k}_name ON cust_{k} (lower(name));"),
    (3, 1, "CREATE UNIQUE INDEX idx_o_{k} ON orders_{k} USING gin (cust_id) WHERE amount > 0;"),
    (3, 2, "CREATE INDEX idx_hash_{k} ON orders_{k} USING hash (cust_id);"),
    (5, 0, "CREATE INDEX IF NOT EXISTS idx_skip_{k} ON cust_{k} USING brin (id);"),
    (4, 0, "CREATE OR REPLACE FUNCTION calc_{k}(p INTEGER) RETURNS INTEGER AS $$\nBEGIN\n"
           "  EXECUTE 'SELECT 1';\n\n  RETURN p * 2;\nEND;\n$$ LANGUAGE plpgsql;"),
    (4, 1, "CREATE FUNCTION get_{k}() RETURNS SETOF cust_{k} LANGUAGE plpgsql AS $$\nBEGIN\n"
           "  RETURN QUERY SELECT * FROM cust_{k} WHERE profile->>'x' = 'y' AND tags = ARRAY['a'];\nEND;\n$$;"),
    (6, 0, "CREATE TRIGGER trg_{k} BEFORE INSERT OR UPDATE ON cust_{k} FOR EACH ROW EXECUTE FUNCTION calc_{k}();"),
    (6, 3, "CREATE TRIGGER trg_del_{k} AFTER DELETE ON orders_{k} FOR EACH STATEMENT EXECUTE FUNCTION calc_{k}();"),
    (7, 0, "CREATE EXTENSION IF NOT EXISTS \"uuid-ossp\";\nCREATE EXTENSION postgis;"),
    (8, 0, "CREATE TABLE events_{k} (id BIGINT, created DATE) PARTITION BY RANGE (created);\n"
           "CREATE TABLE events_{k}_2024 PARTITION OF events_{k} FOR VALUES FROM ('2024-01-01') TO ('2025-01-01');\n"
           "CREATE TABLE events_{k}_2025 PARTITION OF events_{k} FOR VALUES FROM ('2025-01-01') TO ('2026-01-01');"),
    (9, 0, "CREATE TABLE logs_{k} (msg VARCHAR(200), at DATE) PARTITION BY LIST (at);"),
    (10, 0, "CREATE TABLE child_{k} (extra TEXT) INHERITS (cust_{k});"),
    (11, 0, "CREATE POLICY p_{k} ON cust_{k} USING (true);\nALTER TABLE cust_{k} ENABLE ROW LEVEL SECURITY;"),
    (12, 0, "CREATE TABLE geo_{k} (loc geography, tsv TSVECTOR, mac MACADDR, hs HSTORE, CHECK (1 = 1),"
            " CONSTRAINT ex_{k} EXCLUDE USING gist (loc WITH &&));"),
    (13, 0, "CREATE VIEW v_cust_{k} AS SELECT * FROM cust_{k};\nCREATE SEQUENCE seq_{k} AS INTEGER INCREMENT BY 5;\n"
            "CREATE SEQUENCE plain_seq_{k};\n"
            "CREATE OR REPLACE PROCEDURE proc_{k}() LANGUAGE sql AS 'SELECT 1';"),
    (5, 1, "-- CREATE TABLE ghost_{k} (x INT); SMALLSERIAL mentioned in a comment\n"
           "/* CREATE TABLE ghost2_{k} (y INT);\n   similarity(a, b) */"),
    (7, 3, "CREATE TABLE IF NOT EXISTS audit_{k} (id BIGINT, note CITEXT, KEY idx_note (note),"
           " FOREIGN KEY (id) REFERENCES cust_{k} (id));"),
    (14, 0, "CREATE TEMP TABLE tmp_{k} (x INT);\nCREATE OR REPLACE VIEW ov_{k} AS SELECT 1;\n"
            "CREATE TABLE pair_{k} (a INT, b INT, CONSTRAINT pk_pair_{k} PRIMARY KEY (a, b), name BYTEA);"),
]


def _sql_text_k(s: str, key: str) -> str:
    """Snippet -> portable SQL expression (newline/tab via chr, {k} via the key)."""
    out = []
    for i, piece in enumerate(s.split("{k}")):
        if i:
            out.append(f"CAST({key} AS STRING)")
        lines = piece.split("\n")
        for j, ln in enumerate(lines):
            if j:
                out.append("chr(10)")
            tabs = ln.split("\t")
            for t, part in enumerate(tabs):
                if t:
                    out.append("chr(9)")
                if part:
                    out.append(_lit(part))
    return " || ".join(out) if out else "''"


def ddl_files_sql() -> str:
    """src_files(project_id, path, content) of the generated DDL corpus."""
    parts = [f"CASE WHEN c_custkey % {m} = {r} THEN {_sql_text_k(s, 'c_custkey')} END"
             for m, r, s in DDL_SNIPPETS]
    return f"""
SELECT 'p' || CAST(c_nationkey AS STRING) AS project_id,
       'p' || CAST(c_nationkey AS STRING) || '/C' || CAST(c_custkey AS STRING) || '.sql' AS path,
       concat_ws(chr(10), {', '.join(parts)}) AS content
FROM {{customer}}"""


def ddl_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(spark, sf_dir, ddl_files_sql(), ("customer",))


# ---------------------------------------------------------------------------
# Java corpus: one file per order, project = o_custkey % 25.
# Java snippets and the key residues (m, r) that include them;
# file-name suffixes by o_orderkey % 6.
JAVA_SUFFIXES = ["Controller", "Service", "Repository", "Entity", "Mapper", ""]
JAVA_SNIPPETS = [
    (2, 0, "import org.springframework.data.jpa.repository.JpaRepository;\n"
           "import org.springframework.data.jpa.repository.Query;"),
    (2, 1, "import java.sql.DriverManager;\nimport java.sql.PreparedStatement;"),
    (3, 0, "@Repository\npublic interface Order{k}Repository extends JpaRepository<Order, Long> {\n"
           "    @Query(value = \"SELECT o FROM orders o WHERE o.status = true LIMIT 10\", nativeQuery = true)\n"
           "    List<Order> findActive();\n"
           "    @Query(\"SELECT o FROM Order o WHERE o.name ILIKE :n\")\n"
           "    List<Order> byName(String n);\n}"),
    (3, 1, "@Service\npublic class Order{k}Service {\n    // returns the total\n"
           "    public int total() { return list.stream().map(x -> x.v).reduce(0, (a, b) -> a + b); }\n}"),
    (3, 2, "@Entity\n@Table(name = \"orders_{k}\")\npublic class Order{k} {\n"
           "    /* block comment start\n       still comment */ int trailing;\n"
           "    private UUID id;\n    private String tags; // JSONB column\n}"),
    (5, 0, "public class Dao{k} {\n"
           "    String sql = \"INSERT INTO orders (id, payload) VALUES (?, ?::jsonb) ON CONFLICT (id) DO NOTHING RETURNING id\";\n"
           "    String q2 = \"SELECT DISTINCT ON (cust) cust, array_agg(id) FROM orders GROUP BY cust\";\n"
           "    Connection conn = DriverManager.getConnection(url);\n"
           "    PreparedStatement ps = conn.prepareStatement(sql);\n}"),
    (7, 0, "@Mapper\n@MapperScan(\"x\")\npublic interface Order{k}Mapper {\n"
           "    String Q = \"SELECT id, payload->>'name' FROM orders WHERE tags @> ARRAY['a'] AND flag = false\";\n"
           "    String R = \"SELECT jsonb_build_object('a', 1), generate_series(1, 10), string_agg(name, ',') FROM pg_catalog.pg_class\";\n}"),
    (11, 0, "@Configuration\n@Transactional\n@NamedQuery(name = \"x\", query = \"select 1\")\n"
            "public class AppConfig{k} {\n    SessionFactory sf; JdbcTemplate jt;\n    /* multi\n * line\n */\n"
            "    boolean ok = a || b;\n"
            "    String s = \"SELECT ST_Distance(geom, x) FROM t WHERE name ~* 'a' AND doc @@ q\"; "
            "// similarity(a,b) uuid_generate_v4() hstore ltree\n}"),
    (13, 0, "@RestController\npublic class Api{k}Controller {\n    String short = \"SELECT 1\";\n"
            "    String sql = \"UPDATE orders SET note = 'x' WHERE id = 1 AND done = TRUE\";\n"
            "    @Query(value = \"SELECT * FROM orders FOR UPDATE SKIP LOCKED\")\n    void lock();\n"
            "    String s2 = \"SELECT unnest(ids), GREATEST(a, b), regexp_replace(x, 'a', 'b') FROM t OFFSET 5\";\n}"),
    (17, 0, "@PersistenceContext\n@Modifying\n@NamedQueries({})\nclass Misc{k} { String q = \"DELETE FROM t WHERE x <@ y AND z ~ w\"; }"),
]


def java_files_sql() -> str:
    """src_files(project_id, path, content) of the generated Java corpus."""
    parts = [f"CASE WHEN o_orderkey % {m} = {r} THEN {_sql_text_k(s, 'o_orderkey')} END"
             for m, r, s in JAVA_SNIPPETS]
    suffix = "CASE CAST(o_orderkey % 6 AS INT) " + " ".join(
        f"WHEN {i} THEN {quote_sql(s)}" for i, s in enumerate(JAVA_SUFFIXES)) + " END"
    return f"""
SELECT 'p' || CAST(o_custkey % 25 AS STRING) AS project_id,
       'p' || CAST(o_custkey % 25 AS STRING) || '/O' || CAST(o_orderkey AS STRING) || {suffix} || '.java' AS path,
       concat_ws(chr(10), {', '.join(parts)}) AS content
FROM {{orders}}"""


def java_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(spark, sf_dir, java_files_sql(), ("orders",))


# ---------------------------------------------------------------------------
# ORM configuration corpus: one file per part, project = p_size % 25,
# kind by p_partkey % 4 (MyBatis mapper, JPA orm.xml, Hibernate mapping, YAML).
ORM_TEMPLATES = [
    ("xml", "<?xml version=\"1.0\"?>\n<!DOCTYPE mapper PUBLIC \"-//mybatis.org//DTD Mapper 3.0//EN\">\n"
            "<mapper namespace=\"Part{k}Mapper\">\n"
            "  <resultMap id=\"partMap\" type=\"Part\"/>\n"
            "  <select id=\"find{k}\" resultType=\"Part\" databaseId=\"pg\">\n"
            "    SELECT * FROM part WHERE p_size &gt; 10 AND tags @&gt; ARRAY['x'] LIMIT 5 OFFSET 10\n"
            "    <if test=\"name != null\">AND name ILIKE #{name}</if>\n  </select>\n"
            "  <insert id=\"add{k}\" parameterType=\"Part\">\n"
            "    INSERT INTO part (id, doc) VALUES (#{id}, #{doc, typeHandler=\"JsonbHandler\"}::jsonb) RETURNING id\n  </insert>\n"
            "  <update id=\"touch{k}\">UPDATE part SET flag = true WHERE id = #{id}<where> </where></update>\n"
            "  <delete id=\"drop{k}\">DELETE FROM part WHERE id = ANY(#{ids}) <foreach item=\"i\"></foreach></delete>\n"
            "  <select id=\"agg{k}\">SELECT string_agg(name, ',') , array_agg(id), doc->>'k' FROM part</select>\n"
            "  <result typeHandler=\"JsonbHandler\"/><result typeHandler='UuidHandler'/>\n</mapper>"),
    ("xml", "<?xml version=\"1.0\"?>\n<entity-mappings version=\"2.1\">\n"
            "  <named-query name=\"Part{k}.byBrand\">\n    <query><![CDATA[SELECT p FROM Part p WHERE p.brand = :b AND p.size < 5]]></query>\n"
            "  </named-query>\n"
            "  <named-query name=\"Part{k}.json\">\n    <query>SELECT jsonb_agg(p) FROM part p WHERE p.doc -&gt; 'a' IS NOT NULL</query>\n"
            "  </named-query>\n</entity-mappings>"),
    ("xml", "<?xml version=\"1.0\"?>\n<!DOCTYPE hibernate-mapping PUBLIC \"-//Hibernate//DTD 3.0//EN\">\n"
            "<hibernate-mapping>\n"
            "  <sql-query name=\"part{k}Native\">\n    <![CDATA[SELECT * FROM part WHERE uuid_col = CAST(:u AS UUID) AND active = BOOLEAN 'true']]>\n"
            "  </sql-query>\n"
            "  <query name=\"part{k}Hql\"><![CDATA[from Part where size > 3 and GREATEST(a, b) > 1]]></query>\n"
            "</hibernate-mapping>"),
    ("yml", "spring:\n  datasource:\n    url: jdbc:postgresql://db/part{k}\n  jpa:\n    properties:\n"
            "      query: SELECT * FROM part LIMIT 10"),
]


def orm_files_sql() -> str:
    parts = " ".join(f"WHEN {i} THEN {_sql_text_k(s, 'p_partkey')}" for i, (_, s) in enumerate(ORM_TEMPLATES))
    names = ["'/mapper' || CAST(p_partkey AS STRING) || '.xml'", "'/orm' || CAST(p_partkey AS STRING) || '.xml'",
             "'/Part' || CAST(p_partkey AS STRING) || '.hbm.xml'", "'/application' || CAST(p_partkey AS STRING) || '.yml'"]
    name = " ".join(f"WHEN {i} THEN {n}" for i, n in enumerate(names))
    return f"""
SELECT 'p' || CAST(p_size % 25 AS STRING) AS project_id,
       'p' || CAST(p_size % 25 AS STRING) || CASE CAST(p_partkey % 4 AS INT) {name} END AS path,
       CASE CAST(p_partkey % 4 AS INT) {parts} END AS content
FROM {{part}}"""


def orm_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(spark, sf_dir, orm_files_sql(), ("part",))


# ---------------------------------------------------------------------------
# "Migrated" target tables: the source with deterministic damage.
# Rows whose key % 101 = 0 are lost, % 103 = 0 changed, % 107 = 0
# get a NULL in one column.
TARGET_SQL = {
    "orders": """
SELECT o_orderkey, o_custkey,
       CASE WHEN o_orderkey % 107 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus,
       CASE WHEN o_orderkey % 103 = 0 THEN o_totalprice + 1.0 ELSE o_totalprice END AS o_totalprice,
       o_orderdate, o_orderpriority
FROM {orders} WHERE o_orderkey % 101 <> 0""",
    "customer": """
SELECT c_custkey, c_name, c_nationkey,
       CASE WHEN c_custkey % 103 = 0 THEN c_acctbal * 2 ELSE c_acctbal END AS c_acctbal,
       CASE WHEN c_custkey % 107 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment
FROM {customer} WHERE c_custkey % 101 <> 0""",
    "part": """
SELECT p_partkey, p_name, p_brand,
       CASE WHEN p_partkey % 107 = 0 THEN NULL ELSE p_type END AS p_type,
       CASE WHEN p_partkey % 103 = 0 THEN p_size + 1 ELSE p_size END AS p_size, p_retailprice
FROM {part} WHERE p_partkey % 101 <> 0""",
    "lineitem": """
SELECT * FROM {lineitem} WHERE l_orderkey % 101 <> 0""",
    "documents": """
SELECT doc_id,
       CASE WHEN doc_id % 103 = 0 THEN translate(text, 'éèêàâüöäßñçÉÀ', 'eeeaauoasncEA') ELSE text END AS text,
       lang, source, n_chars
FROM {documents} WHERE doc_id % 101 <> 0""",
}


def target_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return run_sql(spark, sf_dir, TARGET_SQL[name])


# A schema catalogue with cycles: one table a part, 25 projects; a table has a key to the one at half its
# number in the project (the first one to itself), some are needed in turn by the one at a quarter.
TABLES_SQL = """
SELECT 'p' || CAST(p_partkey % 25 AS STRING) AS project_id, 'T' || CAST(p_partkey AS STRING) AS `table`
FROM {part}"""
TABLE_KEYS_SQL = """
SELECT 'p' || CAST(p_partkey % 25 AS STRING) AS project_id, 'T' || CAST(p_partkey AS STRING) AS `table`,
       'T' || CAST(25 * CAST(floor(floor(p_partkey / 25) / 2) AS BIGINT) + p_partkey % 25 AS STRING) AS parent
FROM {part}
UNION ALL
SELECT 'p' || CAST(p_partkey % 25 AS STRING), 'T' || CAST(25 * CAST(floor(floor(p_partkey / 25) / 4) AS BIGINT) + p_partkey % 25 AS STRING),
       'T' || CAST(p_partkey AS STRING)
FROM {part} WHERE CAST(floor(p_partkey / 25) AS BIGINT) % 7 = 3"""

# Delta capture during the load: inserts for the lost rows, updates for changed
# ones (two versions, the later wins), deletes for key % 109 = 0.
ORDERS_CHANGES_SQL = """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority, 'I' AS op, 1 AS seq
FROM {orders} WHERE o_orderkey % 101 = 0
UNION ALL
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice + 5.0, o_orderdate, o_orderpriority, 'U', 1
FROM {orders} WHERE o_orderkey % 103 = 0
UNION ALL
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority, 'U', 2
FROM {orders} WHERE o_orderkey % 103 = 0 OR o_orderkey % 107 = 0
UNION ALL
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority, 'D', 3
FROM {orders} WHERE o_orderkey % 109 = 0"""
