"""DDL, PostgreSQL feature and Java scans on literal files; the Java LOC fold
against a sequential loop."""

import random

from tests.conftest import SF, files_df

from pyspark.sql import functions as F

from migscope.operators import ddl as D
from migscope.operators import java as J
from migscope.operators import orm as O
from migscope.operators import pgfeat as G
from migscope.plans import pgscore as PG
from migscope.plans import queries as Q

EMP = """-- employee table
CREATE TABLE EMP (
  EMP_ID CHAR(5) NOT NULL,
  EMP_NAME VARCHAR(50),
  SALARY DECIMAL(9,2),
  HIRED DATE DEFAULT CURRENT_DATE,
  PRIMARY KEY (EMP_ID)
);
CREATE OR REPLACE PROCEDURE raise_pay() LANGUAGE sql AS 'SELECT 1';
"""


def test_ddl_table_columns_and_quirks(spark):
    st = D.ddl_statements(files_df(spark, {"p0/emp.sql": EMP}))
    kinds = [r.kind for r in st.orderBy("stmt_no").collect()]
    assert kinds == ["TABLE", "PROCEDURE"]
    t = D.ddl_tables(st).collect()[0]
    assert (t.table_name, t.n_columns, list(t.primary_key), t.n_indexes) == ("EMP", 4, ["EMP_ID"], 0)
    cols = {r.column_name: r for r in D.ddl_columns(D.table_items(st)).collect()}
    assert cols["EMP_ID"].data_type == "CHAR" and cols["EMP_ID"].length == 5 and cols["EMP_ID"].nullable is False
    # split on every comma: DECIMAL(9,2) keeps no length/precision/scale, '2)' is dropped
    assert cols["SALARY"].data_type == "DECIMAL" and cols["SALARY"].length is None
    assert "2)" not in cols
    assert cols["HIRED"].default_value == "CURRENT_DATE"
    obj = [(r.kind, r.name) for r in D.ddl_objects(st).collect()]
    assert ("PROCEDURE", "raise_pay") in obj


def test_pg_features(spark):
    text = """CREATE TABLE t1 (id SERIAL, doc JSONB);
-- bigserial in a comment counts too
CREATE INDEX i1 ON t1 USING gin (doc);
CREATE INDEX IF NOT EXISTS i2 ON t1 (id);
CREATE TABLE ev (id INT, d DATE) PARTITION BY RANGE (d);
CREATE TABLE ev_2024 PARTITION OF ev FOR VALUES FROM ('2024-01-01') TO ('2025-01-01');
CREATE EXTENSION IF NOT EXISTS "uuid-ossp";
"""
    files = files_df(spark, {"p0/a.sql": text})
    cols = D.ddl_columns(D.table_items(D.ddl_statements(files)))
    usage = {r.type: r["count"] for r in G.pg_type_usage(files).collect()}
    assert usage["SERIAL"] == 2 and usage["BIGSERIAL"] == 1 and usage["JSONB"] == 1
    idx = {r.type: r["count"] for r in G.pg_index_types(files).collect()}
    assert idx == {"GIN": 1}          # IF NOT EXISTS does not match
    parts = G.pg_partitions(files).collect()
    assert [(r.name, r.strategy, r.partition_count) for r in parts] == [("ev", "RANGE", 1)]
    ext = [r.extension for r in G.pg_extensions(files).orderBy("ord").collect()]
    assert ext == ["uuid"]            # "uuid-ossp" is captured as uuid


def _loc_loop(text):
    n, inb = 0, False
    for ln in text.split("\n"):
        t = ln.strip()
        if "/*" in t:
            inb = True
        if "*/" in t:
            inb = False
            continue
        if inb:
            continue
        if t and not t.startswith("//"):
            n += 1
    return n


def test_java_loc_fold_equals_loop(spark):
    rnd = random.Random(3)
    vocab = ["int a;", "// c", "/* open", "close */", "/* one */", "", "  x = y;", "*/ a /*",
             "\t// tab comment", "\u00a0", "b;\r", "\u3000 c", "  \t"]
    no_block = [v for v in vocab if "/*" not in v]
    files = {f"p0/F{i}.java": "\n".join(rnd.choice(vocab) for _ in range(rnd.randint(1, 40))) for i in range(80)}
    files.update({f"p0/G{i}.java": "\n".join(rnd.choice(no_block) for _ in range(rnd.randint(1, 40)))
                  for i in range(40)})
    got = {r.path: r.loc for r in J.java_files(files_df(spark, files)).collect()}
    assert got == {p: _loc_loop(t) for p, t in files.items()}


def test_java_queries_lines_and_features(spark):
    src = 'class A {\n  @Query(value = "SELECT * FROM t LIMIT 5")\n  void f();\n' \
          '  String s = "SELECT id FROM orders WHERE x ILIKE :p";\n}'
    q = J.java_queries(files_df(spark, {"p0/ARepository.java": src})).orderBy("line").collect()
    assert [(r.line, r.type) for r in q] == [(2, "annotation"), (4, "string_literal")]
    assert list(q[0].features) == ["LIMIT/OFFSET"] and list(q[1].features) == ["ILIKE"]
    f = J.java_files(files_df(spark, {"p0/ARepository.java": src})).collect()[0]
    assert f.type == "Repository" and f.native_queries == 2 and f.has_pg_dependency


def test_java_query_lines_of_many_matches(spark):
    """Matches that span lines, and far more of them than a usual file has."""
    n = 3000
    src = "\n".join(['@Query("SELECT a\nFROM t LIMIT 1")' if i % 3 == 0 else f"int x{i};" for i in range(n)])
    got = J.java_queries(files_df(spark, {"p0/BigRepository.java": src})).where("type = 'annotation'").collect()
    want = [k for k, line in enumerate(src.split("\n"), start=1) if line.startswith("@Query")]
    assert sorted((r.ord, r.line) for r in got) == list(enumerate(want))


def test_a_last_file_without_statements_replaces_the_others(spark):
    files = files_df(spark, {"p0/a.sql": "CREATE TABLE t (a INT, b INT);", "p0/b.sql": "-- nothing here", "p1/a.sql": "CREATE TABLE u (a INT);"})
    files = files.withColumn("project_id", F.substring("path", 1, 2))
    per_file = D.ddl_file_totals(D.ddl_statements(files))
    got = lambda **k: {r.project_id: (r.tables, r.columns) for r in D.ddl_totals(per_file, **k).collect()}
    assert got() == {"p0": (1, 2), "p1": (1, 1)}
    assert got(mode="last", files=files.select("project_id", "path")) == {"p0": (0, 0), "p1": (1, 1)}


def optimized(df) -> str:
    """The optimized plan, every field of it."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.debug.maxToStringFields", 10000)
    try:
        return df._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")


def test_lists_are_mined_once_and_above_the_spread(spark):
    """An inner generator made Catalyst test the list's size in the scan's tasks, below the spread."""
    plan = optimized(G.pg_type_usage(files_df(spark, {"p0/a.sql": EMP}).repartition(3)))
    above, below = plan.split("Repartition", 1)
    assert above.count("(SMALL|BIG)?SERIAL") == 1 and "SERIAL" not in below and "Filter" not in below
    empty = files_df(spark, {"p0/a.sql": "SELECT 1;", "p0/b.sql": ""})
    assert G.pg_type_usage(empty).count() == G.pg_extensions(empty).count() == G.pg_functions(empty).count() == 0


def test_body_is_the_greedy_match(spark):
    """``body`` against the expression it stands for, on random texts."""
    rng = random.Random(5)
    texts = ["".join(rng.choice("()a\n\u00e9,") for _ in range(rng.randint(0, 8))) for _ in range(1000)]
    d = spark.createDataFrame([(t,) for t in texts], "stmt string")
    got = d.select(D.body("stmt").alias("a"), F.regexp_extract("stmt", r"\(([\s\S]+)\)", 1).alias("b"))
    assert got.where("a <> b").count() == 0 and got.where("a <> ''").count() > 50


def test_java_queries_are_mined_above_the_spread(spark):
    plan = optimized(J.java_queries(files_df(spark, {"p0/A.java": 'String s = "SELECT 1";'}).repartition(3)))
    assert "@Query" not in plan.split("Repartition", 1)[1]
    scores = optimized(PG.java_project_facts(J.java_files(files_df(spark, {"p0/A.java": ""}).repartition(3))))
    assert "@Repository" not in scores.split("Repartition", 1)[1]


def test_orm_files_take_one_pass(spark):
    """Four minings and three joins before."""
    text = '<mapper><select id="a">SELECT unnest(x), doc->>1 FROM t LIMIT 5</select><delete id="b">DELETE FROM t RETURNING id LIMIT 1</delete></mapper>'
    f = O.orm_files(files_df(spark, {"p0/m.xml": text, "p0/n.xml": "<mapper/>", "p0/a.yml": text}))
    plan = optimized(f)
    assert "Join" not in plan and "Aggregate" not in plan
    got = {r.file_name: (r.native_queries, r.functions, r.syntax) for r in f.collect()}
    assert got == {"m.xml": (2, ["unnest"], ["LIMIT", "->", "->>", "RETURNING"]), "n.xml": (0, [], []), "a.yml": (0, [], [])}


def test_word_patterns_match_as_with_a_boundary_first(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice(["json", "JSONB", "_", " ", "x", "Json", "é", "("]) for _ in range(6)) for _ in range(500)]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    for w in ("JSON", "JSONB"):
        assert d.where(F.col("t").rlike(J.at_word(w) + r"\b") != F.col("t").rlike(rf"(?i)\b{w}\b")).count() == 0
    assert d.where(F.regexp_extract_all("t", F.lit(J.at_word("JSON") + r"\s*\("), 0) != F.regexp_extract_all("t", F.lit(r"(?i)\bJSON\s*\("), 0)).count() == 0


def test_object_diff_mines_the_files_once(spark):
    """Four kinds of objects on two sides mined every file eight times."""
    assert "c_custkey" not in optimized(Q.v_object_diff(spark, SF))


def test_plans_keep_the_java_columns_they_read(spark):
    """The plans store no Java facts that none of them reads."""
    kept = Q._PgParts(spark, SF).java
    assert kept.columns == PG.JAVA_COLUMNS
    assert "extension_usage" not in kept.columns and "jpa_annotations" not in kept.columns


def test_guarded_java_counts(spark):
    """The guards of the JDBC and system table rules (F4, F13) keep their counts."""
    texts = {"p0/A.java": "Connection  conn; DriverManager.getConnection(u); connection conn", "p0/B.java": "x INFORMATION_schema pg_STAT_x",
             "p0/C.java": "PG_Class", "p0/D.java": "pgclass"}
    files = J.java_files(files_df(spark, texts))
    got = {r.name: (r.jdbc_calls, len(r.schema_code)) for r in files.collect()}
    assert got == {"A": (2, 0), "B": (0, 2), "C": (0, 1), "D": (0, 0)}
    plan = files.select("schema_code")._jdf.queryExecution().optimizedPlan().toString()
    assert "PG_)" in plan       # the test that keeps the rules off a text


def test_difficulty_alone_mines_no_lists(spark):
    """F1: the dashboard reads LOC and difficulty of the scores; file types, type words and the places of the lists were mined for
    it too, added up by sorting, and all records of the DDL files were stored."""
    plan = optimized(Q._pg_scores(spark, SF).select("project_id", "total_loc", "difficulty"))
    assert "@REPOSITORY" in plan                                           # the ORM rule is read
    for unread in ("@RestController|@Controller", "MACCDDR", " min(", "CREATE\\s+SEQUENCE"):
        assert unread not in plan, unread
    assert "RepartitionByExpression" in plan                               # no round-robin exchange, which sorts


def test_java_rules_as_their_expressions(spark):
    """The guarded and literal forms against the expressions they stand for, on random texts with letters whose upper case is an ASCII one."""
    rng = random.Random(11)
    atoms = ["@Repository", "@entity", "@ſervice", "import org.springframework.data.jpa", "importXorg", "SQLſession", "SqlSession", "SessionFactory", "Factory", "jdbctemplate",
             "DriverManager.getConnection", "DriverManagerXgetConnection", "Connection conn", "connection conn", "@>", "<@", "->", ">", "@@", " ~ ", "~*", "||", "|", "pg_stat",
             "ſchema", "information_schema", "information_ſchema", "array_agg(", "ARRAY_AGG (", "strıng_agg(", "json_x(", "jsonb_y (", "unnest(", "greatest(", "xleast(", "least (",
             "LIMIT 5", "limıt 5", "offſet", "RETURNING", "ilike", "[", "where a = true", "boolean", "BOOLEAN_x", "é", "\n", " ", "\"", "x", "@Query(value = \"", "@Query( \"", "\"SELECT "]
    texts = ["".join(rng.choice(atoms) for _ in range(rng.randint(1, 7))) for _ in range(3000)]
    d = spark.createDataFrame([("p", f"p/F{k}.java", t) for k, t in enumerate(texts)], "project_id string, path string, content string")
    t, U = F.col("content"), F.upper("content")
    orm = None
    for label, p in J.ORM_RULES:
        orm = F.when(t.rlike(p), label) if orm is None else orm.when(t.rlike(p), label)
    labels = lambda rules: F.filter(F.array(*[F.when(t.rlike(p), F.lit(n)) for n, p in rules]), lambda x: x.isNotNull())
    feature = F.lit(False)
    for _, p in J.QUERY_FEATURES:
        feature = feature | t.rlike(p)
    for f in J.QUERY_FUNCTION_FAMILIES:
        feature = feature | t.rlike("(?i)" + f)
    names = F.flatten(F.array(*[F.regexp_extract_all(t, F.lit("(?i)" + p), 0) for p in J.PG_FUNCTION_PATTERNS]))
    groups = [F.regexp_extract_all(t, F.lit(J.RE_ANNOTATION_QUERY), g) for g in (1, 2)]
    want = d.select("path", orm.alias("o"), labels(J.PG_OPERATORS).alias("ops"), labels(J.SCHEMA_CODE).alias("sc"), F.regexp_count(t, F.lit(J.RE_JDBC)).alias("n"),
                    feature.alias("feature"), F.array_distinct(F.transform(names, lambda m: F.regexp_replace(m, r"\s*\(", ""))).alias("fn"), t.rlike(r"(?i)\bBOOLEAN\b").alias("b"),
                    F.transform(F.arrays_zip(groups[0].alias("a"), groups[1].alias("b")), lambda x: F.concat(x["a"], x["b"])).alias("q"), t.rlike("(?i)LIMIT|OFFSET").alias("lo"))
    got = J.java_files(d).select("path", "orm_framework", "pg_operators", "schema_code", "jdbc_calls", "pg_functions", "uses_boolean") \
        .join(d.select("path", J._any_feature(t, U).alias("any"), F.regexp_extract_all(t, F.lit(J.RE_ANNOTATION_TEXT), 1).alias("texts"), J.literals_match(t, U, "(?i)LIMIT|OFFSET").alias("lim")), "path")
    rows = got.join(want, "path").collect()
    assert len(rows) == 3000
    for r in rows:
        assert (r.orm_framework, r.pg_operators, r.schema_code, r.jdbc_calls, r.any, r.pg_functions, r.uses_boolean, r.texts, r.lim) == \
            (r.o or "None", r.ops, r.sc, r.n, r.feature, r.fn, r.b, r.q, r.lo), texts[int(r.path[3:-5])]
    assert sum(r.any for r in rows) > 500 and sum(r.orm_framework != "None" for r in rows) > 500 and sum(len(r.texts) for r in rows) > 20


def test_ddl_words_as_their_expressions(spark):
    """Columns, comments and the guarded lists of a record against the expressions they stand for, on random texts."""
    rng = random.Random(12)
    atoms = ["CREATE ", "create ", "TABLE t ", "TABLE t (", "a INT", " b Serial", "c", " ", "  ", "\t", ", ", ",", ")", ";", "--", "/*", "*/", "\n", "constraint x ", "Primary key", "BIGSERIAL", "smallserial",
             "serıal", "SEQUENCE s ", "INDEX i ON t (a)", "EXTENSION \"postgis\"", "ST_x", "similarity (", "CHECK (", "EXCLUDE USING", "POLICY", "ENABLE ROW LEVEL SECURITY", " WHERE ", "FUNCTION f()", "é", "ß"]
    texts = ["".join(rng.choice(atoms) for _ in range(rng.randint(1, 12))) for _ in range(3000)]
    d = spark.createDataFrame([("p", str(k), t) for k, t in enumerate(texts)], "project_id string, path string, content string")
    t, U = F.col("content"), F.upper("content")
    kind = F.regexp_extract(F.coalesce(F.get(F.split(t, r"\s+"), F.lit(1)), F.lit("")), D.RE_TYPE, 1)
    plain = F.split(F.regexp_replace(F.regexp_replace(t, r"--[^\n]*", ""), r"/\*[\s\S]*?\*/", ""), ";")
    pair = d.select("content", D._is_column(t).alias("a"), (~U.startswith("CONSTRAINT") & ~U.startswith("PRIMARY KEY") & (kind != "")).alias("b"), D._pieces("content").alias("c"), plain.alias("d"),
                    F.regexp_extract_all(t, F.lit(G.RE_SERIAL), 0).alias("e"), F.regexp_extract_all(t, F.lit(G.RE_SERIAL_AHEAD), 0).alias("f"))
    assert pair.where("a <> b or c <> d or e <> f").count() == 0 and pair.where("a").count() > 300 and pair.where("size(f) > 0").count() > 300
    record = G.pg_file_features(d)
    counts = d.select("path", *[F.regexp_count(t, F.lit(p)).alias("n_" + n) for n, p in G.COUNTERS.items()], F.regexp_extract_all(t, F.lit(G.RE_EXTENSION), 1).alias("ext"),
                      F.regexp_extract_all(t, F.lit(G.RE_INDEX), 1).alias("idx"), F.regexp_extract_all(t, F.lit(G.RE_SEQUENCE), 1).alias("seq"), *[t.rlike(p).alias(n) for n, p in G.EXTENSION_USAGE])
    for r in record.join(counts, "path").collect():
        assert [r[n] for n in G.COUNTERS] == [r["n_" + n] for n in G.COUNTERS], texts[int(r.path)]
        assert r.extensions == list(r.ext) + list(dict.fromkeys(n for n, _ in G.EXTENSION_USAGE if r[n] and n not in r.ext))
        assert sum(x["count"] for x in r.indexes) == len(r.idx) and [x.name for x in r.sequences if not x.is_serial] == list(r.seq)
