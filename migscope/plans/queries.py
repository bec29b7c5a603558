"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per operator
of the inventory, each over whole tables (or corpora derived from them)."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from migscope.operators import cobol as C
from migscope.operators import graph as GR
from migscope.plans import project as M
from migscope.plans import rollups as RU
from migscope.plans import score as K
from migscope.plans.rules import projects_from_nation
from migscope.session import materialize, scratch_path
from migscope.sources.versioned import VersionedTable
from migscope.sources.generated import COBOL_BY_PART, COBOL_BY_SUPP, COBOL_ORDER, cobol_lines, cobol_paths_sql, cobol_raw, run_sql

REGISTRY: dict = {}


def register(fn):
    REGISTRY[fn.__name__] = fn
    return fn


# ---------------------------------------------------------------- COBOL
def _files(spark, sf_dir, variant=COBOL_BY_PART) -> DataFrame:
    """Per-program metrics straight from the raw corpus: blocks and line order
    come with the rows, so the scan needs one exchange and no line numbering."""
    return C.cobol_files(cobol_raw(spark, sf_dir, variant), order=COBOL_ORDER, key="fid")


def _edges(spark, sf_dir, variant=COBOL_BY_PART) -> DataFrame:
    """Dependency edges from the raw corpus (first-seen position = line order)."""
    return C.cobol_edges(cobol_raw(spark, sf_dir, variant), order=COBOL_ORDER)


@register
def cobol_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir)


@register
def cobol_loc(spark, sf_dir):
    return _files(spark, sf_dir).select("project_id", "path", "name", "loc")


@register
def cobol_if_depth(spark, sf_dir):
    return _files(spark, sf_dir).select("project_id", "path", "max_if_depth")


@register
def cobol_divisions(spark, sf_dir):
    return C.cobol_divisions(cobol_lines(spark, sf_dir))


@register
def cobol_paragraphs(spark, sf_dir):
    return C.cobol_paragraphs(cobol_lines(spark, sf_dir))


@register
def cobol_edges(spark, sf_dir):
    return C.cobol_edges(cobol_lines(spark, sf_dir))


def _join_details(df: DataFrame) -> DataFrame:
    for col in ("logic_details", "data_details", "risk_details"):
        df = df.withColumn(col, F.array_join(col, "; "))
    return df


@register
def cobol_file_scores(spark, sf_dir):
    s = K.cobol_file_scores(_files(spark, sf_dir))
    return _join_details(s.select("project_id", "path", "name", "logic_score", "data_score", "risk_score",
                                  "overall", "difficulty", "description",
                                  "logic_details", "data_details", "risk_details"))


def _project_scores(spark, sf_dir) -> DataFrame:
    return K.cobol_project_scores(projects_from_nation(spark, sf_dir), K.cobol_file_scores(_files(spark, sf_dir)))


@register
def cobol_project_scores(spark, sf_dir):
    return _join_details(_project_scores(spark, sf_dir)).drop("total_loc")


@register
def cobol_details(spark, sf_dir):
    ps = _project_scores(spark, sf_dir)
    parts = [ps.select("project_id", F.lit(cat).alias("category"),
                       F.posexplode(f"{cat}_details").alias("pos", "detail"))
             for cat in ("logic", "data", "risk")]
    u = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return u.select("project_id", "category", (F.col("pos") + 1).cast("long").alias("ord"), "detail")


@register
def cobol_priority(spark, sf_dir):
    return M.program_inventory(_files(spark, sf_dir))


@register
def cobol_type_distribution(spark, sf_dir):
    return M.type_distribution(_files(spark, sf_dir))


@register
def portfolio_rollup(spark, sf_dir):
    """M3: the type distribution rolled up to projects and the portfolio."""
    return M.portfolio_rollup(_files(spark, sf_dir))


@register
def kept_scores(spark, sf_dir):
    """Project scores from kept roll-ups.  Every program arrives; a seventh of them had been longer
    before and come again, and their old state comes once more, late."""
    facts = RU.file_facts(_files(spark, sf_dir).withColumn("seq", F.lit(2)))
    facts = materialize(facts)
    again = F.crc32("path") % 7 == 0
    old = facts.withColumn("loc", F.when(again, F.col("loc") + 100).otherwise(F.col("loc"))).withColumn("seq", F.lit(1).cast("long"))
    files, totals = scratch_path(spark, "kept-files"), scratch_path(spark, "kept-totals")
    RU.create(spark, old, files, totals, 16)
    table = VersionedTable(spark, files)
    RU.upsert(table, facts.where(again), "uploads", 0)
    RU.refresh(spark, files, totals)
    RU.upsert(table, old.where(again), "uploads", 1)
    RU.refresh(spark, files, totals)
    return RU.project_scores(spark, totals)


@register
def cobol_top10(spark, sf_dir):
    return M.high_complexity_top10(_files(spark, sf_dir, COBOL_BY_SUPP))


def _programs(spark, sf_dir):
    """Project, path and name of every program, from the listing alone."""
    listed = run_sql(spark, sf_dir, cobol_paths_sql(**COBOL_BY_PART))
    return listed.select("project_id", "path", C.program_name(F.col("path")).alias("name"))


@register
def dep_graph(spark, sf_dir):
    return M.dependency_graph(_edges(spark, sf_dir), _programs(spark, sf_dir))


@register
def dep_unresolved(spark, sf_dir):
    return M.unresolved_targets(_edges(spark, sf_dir), _programs(spark, sf_dir))


def _calls(spark, sf_dir):
    """Program needs target, by name."""
    return _edges(spark, sf_dir).join(_programs(spark, sf_dir), ["project_id", "path"]).select("project_id", F.col("name").alias("source"), "target")


@register
def dep_impact(spark, sf_dir):
    """Per target the programs that need it, directly and at all."""
    return GR.impact(_calls(spark, sf_dir), ["project_id"])


@register
def dep_waves(spark, sf_dir):
    """The migration wave of every program; programs that call each other in a circle go together."""
    waves = GR.load_units(_programs(spark, sf_dir), _calls(spark, sf_dir).withColumnRenamed("source", "name"), ["project_id"], "name", "target")
    return waves.select("project_id", "name", "unit", "unit_size", (F.col("level") + 1).alias("wave"))


@register
def cobol_risks(spark, sf_dir):
    files, edges = _scan(spark, sf_dir)
    scores = K.cobol_project_scores(projects_from_nation(spark, sf_dir), K.cobol_file_scores(files))
    deps = edges.groupBy("project_id").agg(F.count(F.lit(1)).alias("total_deps"))
    r = M.cobol_risks(scores, deps)
    return r.select("project_id", "id", "category", "description", "severity")


# ---------------------------------------------------------------- DDL
from migscope.operators import ddl as D  # noqa: E402
from migscope.operators import pgfeat as G  # noqa: E402
from migscope.sources.generated import ddl_files  # noqa: E402


def _stmts(spark, sf_dir):
    return D.ddl_statements(ddl_files(spark, sf_dir))


def _csv(col):
    return F.array_join(col, ",")


@register
def ddl_statements(spark, sf_dir):
    return _stmts(spark, sf_dir)


@register
def ddl_tables(spark, sf_dir):
    return D.ddl_tables(_stmts(spark, sf_dir)).withColumn("primary_key", _csv("primary_key"))


@register
def ddl_columns(spark, sf_dir):
    return D.ddl_columns(D.table_items(_stmts(spark, sf_dir)))


@register
def ddl_keys(spark, sf_dir):
    fk = D.ddl_foreign_keys(D.table_items(_stmts(spark, sf_dir)))
    return fk.withColumn("columns", _csv("columns")).withColumn("referenced_columns", _csv("referenced_columns"))


@register
def ddl_objects(spark, sf_dir):
    return D.ddl_objects(_stmts(spark, sf_dir))


@register
def ddl_totals(spark, sf_dir):
    return D.ddl_totals(D.ddl_file_totals(_stmts(spark, sf_dir)), mode="union")


@register
def ddl_last_wins(spark, sf_dir):
    return D.ddl_totals(D.ddl_file_totals(_stmts(spark, sf_dir)), mode="last", files=ddl_files(spark, sf_dir).select("project_id", "path"))


# ---------------------------------------------------------------- PostgreSQL features
@register
def pg_type_usage(spark, sf_dir):
    return G.pg_type_usage(ddl_files(spark, sf_dir)).withColumn("tables", _csv("tables")).drop("seen")


@register
def pg_file_features(spark, sf_dir):
    """The record of every file, its lists as JSON."""
    f = G.pg_file_features(ddl_files(spark, sf_dir))
    return f.select(*[F.to_json(x).alias(x) if x in G.LISTS else F.col(x) for x in f.columns])


@register
def pg_index_types(spark, sf_dir):
    return G.pg_index_types(ddl_files(spark, sf_dir)).drop("first_ord")


@register
def pg_functions(spark, sf_dir):
    return G.pg_functions(ddl_files(spark, sf_dir))


@register
def pg_triggers(spark, sf_dir):
    return G.pg_triggers(ddl_files(spark, sf_dir))


@register
def pg_sequences(spark, sf_dir):
    return G.pg_sequences(ddl_files(spark, sf_dir)).select("project_id", "path", "name", "data_type", "increment", "is_serial")


@register
def pg_extensions(spark, sf_dir):
    return G.pg_extensions(ddl_files(spark, sf_dir))


@register
def pg_partitions(spark, sf_dir):
    return G.pg_partitions(ddl_files(spark, sf_dir))


@register
def pg_inheritance(spark, sf_dir):
    return G.pg_inheritance(ddl_files(spark, sf_dir))


@register
def pg_row_estimates(spark, sf_dir):
    return G.pg_row_estimates(ddl_files(spark, sf_dir))


@register
def pg_counters(spark, sf_dir):
    return G.pg_counters(ddl_files(spark, sf_dir))


# ---------------------------------------------------------------- Java / ORM
from migscope.operators import java as J  # noqa: E402
from migscope.operators import orm as O  # noqa: E402
from migscope.sources.generated import java_files, orm_files  # noqa: E402

_ARRAYS_J = ["jpa_annotations", "pg_functions", "pg_data_types", "pg_operators", "schema_code", "extension_usage"]


def _join_arrays(df, cols, sep="|"):
    for col in cols:
        df = df.withColumn(col, F.array_join(col, sep))
    return df


@register
def java_loc(spark, sf_dir):
    return J.java_files(java_files(spark, sf_dir)).select("project_id", "path", "name", "loc")


@register
def java_kind(spark, sf_dir):
    return J.java_files(java_files(spark, sf_dir)).select("project_id", "path", "name", "type")


@register
def java_orm(spark, sf_dir):
    return J.java_files(java_files(spark, sf_dir)).select("project_id", "path", "orm_framework")


@register
def java_features(spark, sf_dir):
    f = J.java_files(java_files(spark, sf_dir)).select(
        "project_id", "path", "repository_annotations", "entity_annotations", "mapper_annotations", "jdbc_calls",
        "prepared_statements", *_ARRAYS_J)
    return _join_arrays(f, _ARRAYS_J)


@register
def java_queries(spark, sf_dir):
    q = J.java_queries(java_files(spark, sf_dir))
    return _join_arrays(q, ["features"])


@register
def java_inventory(spark, sf_dir):
    return J.java_inventory(J.java_files(java_files(spark, sf_dir)))


@register
def orm_kind(spark, sf_dir):
    f = O.orm_files(orm_files(spark, sf_dir))
    return _join_arrays(f, ["type_handlers", "functions", "data_types", "syntax"])


@register
def orm_queries(spark, sf_dir):
    q = O.orm_queries(orm_files(spark, sf_dir)).drop("kind")
    return _join_arrays(q, ["features", "functions", "data_types", "syntax"])


@register
def orm_counts(spark, sf_dir):
    f = O.orm_files(orm_files(spark, sf_dir))
    return f.groupBy("project_id", "kind").agg(
        F.count(F.lit(1)).alias("files"), F.sum("native_queries").cast("long").alias("native_queries"))


# ---------------------------------------------------------------- PostgreSQL -> Oracle project plans
from migscope.plans import pgscore as PG  # noqa: E402

_DETAILS_PG = ["schema_details", "sql_details", "proc_details", "volume_details", "app_details", "ops_details"]


def _pg_scores(spark, sf_dir):
    jf = J.java_files(java_files(spark, sf_dir))
    ddl = PG.DdlFacts(spark, ddl_files(spark, sf_dir), store=False)
    return PG.pg_project_scores(spark, projects_from_nation(spark, sf_dir), jf, ddl)


@register
def pg_scores(spark, sf_dir):
    s = _pg_scores(spark, sf_dir).select("project_id", *PG.DIMS, "overall", "difficulty", "description",
                                         *_DETAILS_PG)
    return _join_arrays(s, _DETAILS_PG, "; ")


@register
def pg_recommendations(spark, sf_dir):
    return PG.pg_recommendations(_pg_scores(spark, sf_dir))


@register
def pg_risks(spark, sf_dir):
    return PG.pg_risks(_pg_scores(spark, sf_dir))


@register
def primary_orm(spark, sf_dir):
    return PG.primary_orm(J.java_files(java_files(spark, sf_dir)))


def _inventory(spark, sf_dir):
    return J.java_inventory(J.java_files(java_files(spark, sf_dir)))


@register
def pg_changes(spark, sf_dir):
    return PG.java_changes(_inventory(spark, sf_dir))


@register
def pg_change_summary(spark, sf_dir):
    return PG.change_summary(_inventory(spark, sf_dir))


# ---------------------------------------------------------------- migration data checks
from migscope.operators import validate as V  # noqa: E402
from migscope.sources.generated import ORDERS_CHANGES_SQL, TABLE_KEYS_SQL, TABLES_SQL, read_table, run_sql, target_table  # noqa: E402

# Checks configured for the generated migration (key columns,
# conversion rules, business rules, baseline).
CONVERSION_RULES = {
    "orders": [("o_totalprice", "decimal(8,2)"), ("o_orderstatus", "char(1)"), ("o_custkey", "int")],
    "customer": [("c_acctbal", "decimal(7,1)"), ("c_nationkey", "smallint"), ("c_name", "varchar(10)")],
    "lineitem": [("l_quantity", "smallint"), ("l_discount", "decimal(3,2)"), ("l_extendedprice", "decimal(9,2)")],
}
BUSINESS_RULES = {
    "lineitem": [("positive_quantity", "l_quantity > 0"),
                 ("discount_range", "l_discount BETWEEN 0 AND 0.1"),
                 ("tax_range", "l_tax BETWEEN 0 AND 0.08"),
                 ("price_not_negative", "l_extendedprice >= 0"),
                 ("known_return_flag", "l_returnflag IN ('A', 'N', 'R')")],
    "orders": [("positive_total", "o_totalprice > 0"),
               ("known_status", "o_orderstatus IN ('F', 'O', 'P')"),
               ("priority_prefix", "o_orderpriority LIKE '%-%'")],
}
# baseline (ms) and target (ms) per query class, and the event type measured for it
PERF_BASELINE = [("PERF-001", "Simple SELECT query", 10.0, 15.0, "view"),
                 ("PERF-002", "JOIN query (2 tables)", 50.0, 60.0, "click"),
                 ("PERF-003", "JOIN query (5+ tables)", 200.0, 250.0, "purchase"),
                 ("PERF-004", "Aggregation query", 100.0, 120.0, "signup"),
                 ("PERF-005", "Full-text search", 80.0, 100.0, "error"),
                 ("PERF-006", "Pagination query", 15.0, 20.0, "none")]


def _t(spark, sf_dir, name):
    return read_table(spark, sf_dir, name)


@register
def v_counts(spark, sf_dir):
    pairs = [(n, _t(spark, sf_dir, n), target_table(spark, sf_dir, n))
             for n in ("orders", "customer", "part", "lineitem", "documents")]
    pairs.append(("supplier", _t(spark, sf_dir, "supplier"), None))
    return V.reconcile_counts(pairs)


@register
def v_checksum(spark, sf_dir):
    return V.reconcile_checksum(_t(spark, sf_dir, "orders"), target_table(spark, sf_dir, "orders"),
                                ["o_orderkey"], buckets=64, digest="md5", bucket_by="key")


@register
def v_orphans(spark, sf_dir):
    li, od, cu = _t(spark, sf_dir, "lineitem"), _t(spark, sf_dir, "orders"), _t(spark, sf_dir, "customer")
    lab, doc = _t(spark, sf_dir, "labels"), _t(spark, sf_dir, "documents")
    checks = [
        ("lineitem->orders(target)", li, target_table(spark, sf_dir, "orders"), ["l_orderkey"], ["o_orderkey"]),
        ("orders->customer(target)", od, target_table(spark, sf_dir, "customer"), ["o_custkey"], ["c_custkey"]),
        ("lineitem->part", li, _t(spark, sf_dir, "part"), ["l_partkey"], ["p_partkey"]),
        ("lineitem->supplier", li, _t(spark, sf_dir, "supplier"), ["l_suppkey"], ["s_suppkey"]),
        ("labels->documents", lab, doc, ["doc_id"], ["doc_id"]),
        ("documents->labels", doc, lab, ["doc_id"], ["doc_id"]),
    ]
    parts = [V.orphans(ch, pa, fk, pk).agg(F.count(F.lit(1)).alias("orphans"))
             .select(F.lit(name).alias("relation"), "orphans") for name, ch, pa, fk, pk in checks]
    from functools import reduce
    return reduce(DataFrame.unionByName, parts)


@register
def v_diff(spark, sf_dir):
    return V.diff_rows(_t(spark, sf_dir, "orders"), target_table(spark, sf_dir, "orders"), ["o_orderkey"])


@register
def v_nulls(spark, sf_dir):
    a = V.compare_nulls(_t(spark, sf_dir, "orders"), target_table(spark, sf_dir, "orders"), "orders")
    b = V.compare_nulls(_t(spark, sf_dir, "customer"), target_table(spark, sf_dir, "customer"), "customer")
    return a.unionByName(b)


@register
def v_conversion(spark, sf_dir):
    from functools import reduce
    return reduce(DataFrame.unionByName, [V.conversion_loss(_t(spark, sf_dir, n), r, n)
                                          for n, r in CONVERSION_RULES.items()])


@register
def v_charset(spark, sf_dir):
    return V.charset_check(_t(spark, sf_dir, "documents"), target_table(spark, sf_dir, "documents"),
                           "doc_id", "text")


@register
def v_json(spark, sf_dir):
    return V.json_check(_t(spark, sf_dir, "events"), "event_id", "props")


@register
def v_arrays(spark, sf_dir):
    return V.array_to_child(_t(spark, sf_dir, "embeddings"), "vec_id", "embedding")


@register
def v_bool(spark, sf_dir):
    t = target_table(spark, sf_dir, "customer")
    b = F.col("c_mktsegment") == "BUILDING"
    return t.select("c_custkey", V.bool_to_number(b).alias("as_written"),
                    V.bool_to_number(b, keep_null=True).alias("null_keeping"))


@register
def v_sample(spark, sf_dir):
    src = V.sample_rows(_t(spark, sf_dir, "orders"), "o_orderkey", 0.1, method="md5")
    tgt = target_table(spark, sf_dir, "orders").join(src.select("o_orderkey"), "o_orderkey", "left_semi")
    return V.diff_rows(src, tgt, ["o_orderkey"], keep_same=True)


@register
def v_sample_n(spark, sf_dir):
    """V11 by number: the 500 orders with the least key hash against the target."""
    src = V.sample_n(_t(spark, sf_dir, "orders"), "o_orderkey", 500, method="md5")
    tgt = target_table(spark, sf_dir, "orders").join(src.select("o_orderkey"), "o_orderkey", "left_semi")
    return V.diff_rows(src, tgt, ["o_orderkey"], keep_same=True)


@register
def v_diff_set(spark, sf_dir):
    """V4 without keys: rows that one side alone has, as multisets."""
    cols = ["o_custkey", "o_orderstatus", "o_orderpriority"]
    return V.diff_rows_set(_t(spark, sf_dir, "orders").select(*cols), target_table(spark, sf_dir, "orders").select(*cols))


@register
def v_array_csv(spark, sf_dir):
    """V9 as text: the keys of an order as array, joined."""
    keys = _t(spark, sf_dir, "orders").select("o_orderkey", F.array("o_custkey", "o_orderkey").alias("keys"))
    return V.array_to_csv(keys, "keys")


@register
def v_rules(spark, sf_dir):
    return V.check_rules(_t(spark, sf_dir, "lineitem"), BUSINESS_RULES["lineitem"], "lineitem").unionByName(
        V.check_rules(_t(spark, sf_dir, "orders"), BUSINESS_RULES["orders"], "orders"))


def _oracle_map(spark):
    return G.type_map(spark).select("type", F.col("oracle_type").alias("target_type"))


@register
def v_type_map(spark, sf_dir):
    cols = D.ddl_columns(D.table_items(_stmts(spark, sf_dir)))
    return V.map_types(cols, _oracle_map(spark)).select(
        "project_id", "path", "table_name", "column_name", "data_type", "target_type", "mapped")


@register
def v_schema_diff(spark, sf_dir):
    """Expected catalogue (the source's after type mapping) vs the migrated one, which lost the
    columns of every table whose file key % 11 = 0, has CLOB for every type where it is
    % 13 = 0, and forgot NOT NULL where it is % 17 = 0."""
    cols = D.ddl_columns(D.table_items(_stmts(spark, sf_dir)))
    keys = ["project_id", "path", "table_name", "column_name"]
    expected = V.map_types(cols, _oracle_map(spark)).withColumn("data_type", F.col("target_type"))
    key_no = F.regexp_extract("path", r"C(\d+)\.sql$", 1).cast("long")
    migrated = expected.where(key_no % 11 != 0).withColumn("data_type", F.when(key_no % 13 == 0, "CLOB").otherwise(F.col("data_type"))) \
        .withColumn("nullable", F.when(key_no % 17 == 0, True).otherwise(F.col("nullable")))
    return V.schema_diff(expected, migrated, keys)


def _catalogue(spark, sf_dir):
    """Objects of the DDL corpus: tables with their primary keys, foreign keys, and the others by kind."""
    st = materialize(_stmts(spark, sf_dir))
    keys = ["project_id", "path"]
    t = D.ddl_tables(st)
    parts = [t.select(*keys, F.lit("table").alias("kind"), F.col("table_name").alias("name"), F.lit(None).cast("string").alias("definition")),
             t.where("primary_key is not null").select(*keys, F.lit("primary key").alias("kind"), F.col("table_name").alias("name"), _csv("primary_key").alias("definition")),
             D.ddl_foreign_keys(D.table_items(st)).select(*keys, F.lit("foreign key").alias("kind"), F.col("fk_name").alias("name"), F.concat(
                 F.col("table_name"), F.lit("("), _csv("columns"), F.lit(") -> "), F.col("referenced_table"), F.lit("("), _csv("referenced_columns"), F.lit(")")).alias("definition")),
             D.ddl_objects(st).where("kind <> 'TABLE'").select(*keys, F.lower("kind").alias("kind"), "name", F.lit(None).cast("string").alias("definition"))]
    from functools import reduce
    return reduce(DataFrame.unionByName, parts)


@register
def v_object_diff(spark, sf_dir):
    """Every kind of catalogue object, against a migrated catalogue that lost the objects of the
    files with key % 11 = 0 and whose keys are reversed where it is % 13 = 0."""
    a = materialize(_catalogue(spark, sf_dir))
    key_no = F.regexp_extract("path", r"C(\d+)\.sql$", 1).cast("long")
    b = a.where(key_no % 11 != 0).withColumn("definition", F.when(key_no % 13 == 0, F.reverse("definition")).otherwise(F.col("definition")))
    return V.object_diff(a, b, ["project_id", "path"])


@register
def v_type_map_oracle_pg(spark, sf_dir):
    """V14, Oracle to PostgreSQL, over the catalogue in Oracle types."""
    cols = V.map_types(D.ddl_columns(D.table_items(_stmts(spark, sf_dir))), _oracle_map(spark))
    cols = cols.select("project_id", "path", "table_name", "column_name", F.when(F.col("target_type") == "VARCHAR", F.concat(F.lit("VARCHAR2("), F.coalesce(F.col("length"), F.lit(255)).cast("string"), F.lit(")")))
                       .when(F.col("target_type").isin("INTEGER", "INT"), "NUMBER(10,0)").when(F.col("target_type") == "TIMESTAMP", "DATE")
                       .when(F.col("target_type").isin("NUMERIC", "DECIMAL"), "NUMBER(10,2)").otherwise(F.col("target_type")).alias("data_type"))
    return V.oracle_to_postgres(cols).select("project_id", "path", "table_name", "column_name", "data_type", "target_type", "mapped", "risk")


@register
def v_json_compare(spark, sf_dir):
    """V8: the JSON of events against a target with lost (% 101), changed (% 103) and cut (% 107) rows."""
    src = _t(spark, sf_dir, "events").select("event_id", "props")
    k = F.col("event_id")
    tgt = src.where(k % 101 != 0).withColumn("props", F.when(k % 103 == 0, '{"k": -1}').when(k % 107 == 0, '{"k":').otherwise(F.concat(F.lit(" "), F.col("props"))))
    return V.json_compare(src, tgt, "event_id", "props").groupBy("status").agg(F.count(F.lit(1)).alias("rows"))


@register
def v_load_order(spark, sf_dir):
    st = _stmts(spark, sf_dir)
    tables = D.ddl_tables(st).select("project_id", F.col("table_name").alias("table")).distinct()
    fks = D.ddl_foreign_keys(D.table_items(st)).select(
        "project_id", F.col("table_name").alias("table"), F.col("referenced_table").alias("parent"))
    return V.load_order(tables, fks, ["project_id"])


@register
def v_load_units(spark, sf_dir):
    """V15 with cycles: the tables of ``TABLES_SQL`` and their keys."""
    keys = run_sql(spark, sf_dir, TABLE_KEYS_SQL)
    tables = run_sql(spark, sf_dir, TABLES_SQL)
    return GR.load_units(tables, keys, ["project_id"])


@register
def v_checksum_tree(spark, sf_dir):
    """V2, ordered: the nodes in which source and target differ."""
    src, tgt = _t(spark, sf_dir, "orders"), target_table(spark, sf_dir, "orders")
    return V.ordered_diff(V.ordered_checksum(src, "o_orderkey", width_bits=6), V.ordered_checksum(tgt, "o_orderkey", width_bits=6))


@register
def v_checksum_rows(spark, sf_dir):
    """V2, ordered: the row differences, read from the differing ranges alone."""
    src, tgt = _t(spark, sf_dir, "orders"), target_table(spark, sf_dir, "orders")
    diff = V.ordered_diff(V.ordered_checksum(src, "o_orderkey", width_bits=2), V.ordered_checksum(tgt, "o_orderkey", width_bits=2))
    return V.diff_rows(*[V.differing_rows(df, diff, "o_orderkey", width_bits=2) for df in (src, tgt)], ["o_orderkey"])


@register
def v_delta(spark, sf_dir):
    base = target_table(spark, sf_dir, "orders")
    changes = run_sql(spark, sf_dir, ORDERS_CHANGES_SQL)
    return V.apply_delta(base, changes, ["o_orderkey"]) \
        .withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))


@register
def v_latency(spark, sf_dir):
    ev = _t(spark, sf_dir, "events")
    return V.latency_slo(ev, [F.to_date("ts").alias("day")], "value", F.col("event_type") == "error",
                         2000.0, 5000.0).withColumn("day", F.col("day").cast("string"))


@register
def v_latency_weekly(spark, sf_dir):
    """V19 merged: weekly figures from daily sketches, without the events."""
    daily = materialize(V.latency_sketches(_t(spark, sf_dir, "events"), [F.to_date("ts").alias("day")], "value"))
    return V.merged_latency(daily, [F.trunc("day", "week").alias("week")])


#: Thresholds of the hourly episodes (error rate, response) and the silence after which one ends.
HOURLY_LIMITS = {"error_rate": (0.2, 0.6), "response": (60.0, 85.0)}
HOURLY_SILENCE = 6 * 3600


@register
def v_alert_episodes(spark, sf_dir):
    """V20 life cycle: the alert episodes of every user's hourly windows."""
    w = V.alert_windows(_t(spark, sf_dir, "events"), F.col("user_id"), window="1 hour", limits=HOURLY_LIMITS)
    e = V.alert_episodes(w, HOURLY_SILENCE)
    at = lambda x: F.date_format(x, "yyyy-MM-dd HH:mm:ss").alias(x)
    return e.select("series", "metric", at("raised_at"), at("last_seen"), "windows", "level", at("closed_at"), "reason")


@register
def v_alerts(spark, sf_dir):
    a = V.alerts(_t(spark, sf_dir, "events"))
    return a.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss")) \
        .withColumn("window_end", F.date_format("window_end", "yyyy-MM-dd HH:mm:ss"))


@register
def v_baseline(spark, sf_dir):
    ev = _t(spark, sf_dir, "events")
    actual = V.exact_percentile(ev, ["event_type"], "value", 0.95, "actual")
    base = spark.createDataFrame(PERF_BASELINE, "metric string, description string, baseline double, "
                                                "target double, event_type string")
    j = base.join(actual, "event_type", "left").drop("event_type")
    return V.compare_baseline(j.select("metric", "actual"), base.drop("event_type"))


@register
def v_table_summary(spark, sf_dir):
    return V.table_summary(D.ddl_tables(_stmts(spark, sf_dir)))


@register
def v_migrate(spark, sf_dir):
    """Converted customers, written and read back, against the converted source: all columns."""
    from migscope.session import scratch_path
    src = _t(spark, sf_dir, "customer")
    conv = {"c_acctbal": F.col("c_acctbal").cast("decimal(12,2)"),
            "c_mktsegment": V.bool_to_number(F.col("c_mktsegment") == "BUILDING", keep_null=True).cast("string")}
    loaded, _ = V.migrate_table(src, conv, ["c_custkey"], sink=scratch_path(spark, "migrated"))
    expected = src.select(*[conv.get(x, F.col(x)).alias(x) for x in src.columns])
    cols = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
    return V.reconcile_checksum(expected, loaded, ["c_custkey"], cols, buckets=16, digest="md5", bucket_by="key")


@register
def cobol_complexity_stats(spark, sf_dir):
    return M.complexity_stats(_files(spark, sf_dir))


# ---------------------------------------------------------------- corpus, admission, reports
from migscope.plans import report as R  # noqa: E402
from migscope.sources import corpus as S  # noqa: E402
from migscope.sources.generated import COBOL_BY_PART as _CBP, cobol_paths_sql  # noqa: E402

REPORT_DATE = "2026-01-01"


def _listing(spark, sf_dir):
    """The upload listing of the generated portfolio: every generated file."""
    parts = [run_sql(spark, sf_dir, cobol_paths_sql(**_CBP)),
             ddl_files(spark, sf_dir).select("project_id", "path"),
             java_files(spark, sf_dir).select("project_id", "path"),
             orm_files(spark, sf_dir).select("project_id", "path")]
    from functools import reduce
    u = reduce(DataFrame.unionByName, parts)
    return u.withColumn("file_name", F.regexp_extract("path", r"([^/]+)$", 1))


@register
def admission(spark, sf_dir):
    a = S.admit(_listing(spark, sf_dir), projects_from_nation(spark, sf_dir))
    return a.select("project_id", "path", "file_name", "migration_type", "admitted")


@register
def admission_report(spark, sf_dir):
    return S.admission_report(S.admit(_listing(spark, sf_dir), projects_from_nation(spark, sf_dir)))


UPLOADS_SQL = """
SELECT 'p' || CAST(o_custkey % 25 AS STRING) AS project_id,
       'F' || CAST(o_orderkey % 997 AS STRING) || '.java' AS file_name,
       'u/' || CAST(o_orderkey AS STRING) || '/F' || CAST(o_orderkey % 997 AS STRING) || '.java' AS path,
       o_orderdate AS upload_ts, o_totalprice AS size
FROM {orders}"""


@register
def latest_files(spark, sf_dir):
    l = S.latest_files(run_sql(spark, sf_dir, UPLOADS_SQL))
    return l.withColumn("upload_ts", F.date_format("upload_ts", "yyyy-MM-dd HH:mm:ss"))


@register
def java_lines(spark, sf_dir):
    return S.to_lines(java_files(spark, sf_dir))


def _ctx(spark, sf_dir):
    return R.report_context(projects_from_nation(spark, sf_dir), F.lit(REPORT_DATE))


@register
def report_context(spark, sf_dir):
    return _ctx(spark, sf_dir)


def _ddl_db(spark, sf_dir):
    return D.ddl_totals(D.ddl_file_totals(_stmts(spark, sf_dir)))


def _scan(spark, sf_dir):
    """(files, edges) of the corpus from one pass over its lines."""
    blocks = materialize(C.cobol_scan(cobol_raw(spark, sf_dir, COBOL_BY_PART), order=COBOL_ORDER, key="fid"))
    return materialize(C.scanned_files(blocks, "fid")), C.scanned_edges(blocks)


def _cobol_report(spark, sf_dir):
    files, edges = _scan(spark, sf_dir)
    scores = K.cobol_project_scores(projects_from_nation(spark, sf_dir), K.cobol_file_scores(files), with_types=True)
    deps = materialize(C.dependency_lists(edges).select(
        "project_id", "path", C.program_name(F.col("path")).alias("source"), F.array_join("dependencies", ", ").alias("targets"), F.size("dependencies").alias("n")))
    return R.cobol_report_rows(_ctx(spark, sf_dir), scores, M.program_inventory(files), deps, _ddl_db(spark, sf_dir), M.high_complexity_top10(files))


@register
def report_rows(spark, sf_dir):
    return _cobol_report(spark, sf_dir)


@register
def report_quality(spark, sf_dir):
    """V21 on the generated documents: line-level checks folded per document."""
    rows = _cobol_report(spark, sf_dir)
    g = rows.groupBy("project_id", "doc").agg(
        *[(F.bool_or(F.col("line").rlike(p.replace("(?m)", ""))) if must
           else ~F.bool_or(F.col("line").rlike(p))).alias(n) for n, p, must in V.DOC_CHECKS])
    return g.select("project_id", "doc", F.explode(F.array(*[
        F.struct(F.lit(n).alias("check"), F.col(n).alias("passed")) for n, _, _ in V.DOC_CHECKS])).alias("r")) \
        .select("project_id", "doc", "r.*")


@register
def doc_quality(spark, sf_dir):
    """V21 on whole texts of the documents table."""
    return V.check_documents(read_table(spark, sf_dir, "documents"), ["doc_id"], "text")


class _PgParts:
    """Inputs of the PostgreSQL plans; each is made when it is first asked for."""

    def __init__(self, spark, sf_dir):
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def projects(self):
        return projects_from_nation(self.spark, self.sf_dir)

    @cached_property
    def java(self):
        """The facts of the Java files that the plans read; the others are not mined."""
        return materialize(J.java_files(java_files(self.spark, self.sf_dir)).select(*PG.JAVA_COLUMNS))

    @cached_property
    def ddl(self):
        return PG.DdlFacts(self.spark, ddl_files(self.spark, self.sf_dir))

    @cached_property
    def scores(self):
        """One row a project, read by the score, risk, recommendation and report branches."""
        return materialize(PG.pg_project_scores(self.spark, self.projects, self.java, self.ddl))

    @cached_property
    def total_files(self):
        """Counts of the Java and ORM listings; no file is mined."""
        listed = java_files(self.spark, self.sf_dir).select("project_id").union(orm_files(self.spark, self.sf_dir).select("project_id"))
        return listed.groupBy("project_id").agg(F.count(F.lit(1)).cast("long").alias("total_files"))

    @cached_property
    def database(self):
        return self.ddl.database() if "ddl" in vars(self) else G.object_totals(ddl_files(self.spark, self.sf_dir))

    @cached_property
    def orm(self):
        return PG.primary_orm(self.java)

    @cached_property
    def inventory(self):
        return J.java_inventory(self.java)


@register
def total_files(spark, sf_dir):
    return _PgParts(spark, sf_dir).total_files


@register
def pg_source_block(spark, sf_dir):
    """Data types, extensions, advanced indexes and native query count."""
    names = lambda x: F.coalesce(F.array_join(x, ", "), F.lit(""))
    ddl = PG.ddl_project_facts(G.pg_file_features(ddl_files(spark, sf_dir))).select(
        "project_id", "extension_list", "type_names", "index_names")
    native = J.java_files(java_files(spark, sf_dir)).groupBy("project_id").agg(F.sum("native_queries").alias("n"))
    return projects_from_nation(spark, sf_dir).select("project_id").join(native, "project_id", "left").join(ddl, "project_id", "left").select(
        "project_id", names("extension_list").alias("extensions"), F.coalesce("n", F.lit(0)).cast("long").alias("native_query_count"),
        names("type_names").alias("data_types"), names("index_names").alias("index_types"))


@register
def pg_report_rows(spark, sf_dir):
    p = _PgParts(spark, sf_dir)
    ddl = p.ddl
    scores = p.scores.join(p.total_files, "project_id", "left").fillna(0, ["total_files"])
    return R.pg_report_rows(_ctx(spark, sf_dir), scores, p.orm, p.inventory, PG.java_changes(p.inventory),
                            PG.change_summary(p.inventory).drop("total_files"), p.database, ddl.types, ddl.extensions,
                            ddl.indexes,
                            PG.pg_risks(p.scores), PG.pg_recommendations(p.scores))


@register
def pg_design_rows(spark, sf_dir):
    p = _PgParts(spark, sf_dir)
    return R.pg_design_rows(spark, p.scores, p.orm, p.ddl.types, p.ddl.extensions, p.ddl.indexes)


@register
def expected_objects(spark, sf_dir):
    return R.expected_objects(_PgParts(spark, sf_dir).database)


@register
def dashboard_tiles(spark, sf_dir):
    """Database projects show their Java totals and PostgreSQL difficulty, the others COBOL's."""
    files = materialize(_files(spark, sf_dir))
    p = _PgParts(spark, sf_dir)
    pg = materialize(_pg_scores(spark, sf_dir).select("project_id", "total_loc", "difficulty"))
    ctx = _ctx(spark, sf_dir)
    db = ctx.select("project_id", F.col("migration_type").isin(R.DATABASE_FAMILIES).alias("is_db"))
    of = lambda df, want: df.join(db.where(F.col("is_db") == want).select("project_id"), "project_id", "left_semi")
    cobol = K.cobol_project_scores(p.projects, K.cobol_file_scores(files), with_details=False).select("project_id", "difficulty")
    java_totals = p.total_files.join(pg.select("project_id", "total_loc"), "project_id", "left").select("project_id", "total_files", F.coalesce("total_loc", F.lit(0)).alias("total_loc"))
    totals = of(M.totals(files).select("project_id", "total_files", "total_loc"), False).unionByName(of(java_totals, True))
    difficulty = of(cobol, False).unionByName(of(pg.select("project_id", "difficulty"), True))
    return R.dashboard_tiles(ctx, _ddl_db(spark, sf_dir), totals, difficulty)


@register
def project_metadata(spark, sf_dir):
    """The project metadata document (nested struct as JSON)."""
    files = materialize(_files(spark, sf_dir))
    projects = projects_from_nation(spark, sf_dir)
    scores = materialize(K.cobol_project_scores(projects, K.cobol_file_scores(files)))
    tot = M.totals(files)
    db = M.database_block(projects, _ddl_db(spark, sf_dir))
    j = projects.select("project_id").join(tot, "project_id", "left").join(db, "project_id", "left") \
        .join(M.complexity_summary(scores), "project_id", "left") \
        .join(scores.drop("total_loc", "files"), "project_id", "left")
    doc = F.struct(
        F.struct(F.coalesce(F.col("total_files"), F.lit(0)).alias("total_files"),
                 F.coalesce(F.col("total_loc"), F.lit(0)).alias("total_loc"),
                 F.struct("tables", "views", "stored_procedures", "indexes", "triggers", "functions").alias("database"))
        .alias("source_analysis"),
        F.col("summary").alias("complexity_summary"),
        F.struct(F.col("overall"), F.col("logic_score").alias("logicComplexity"),
                 F.col("data_score").alias("dataComplexity"), F.col("risk_score").alias("cobolSpecificRisk"),
                 "difficulty", "description",
                 F.struct(F.col("logic_details").alias("logic"), F.col("data_details").alias("data"),
                          F.col("risk_details").alias("risk")).alias("details")).alias("migrationComplexity"))
    return j.select("project_id", F.to_json(doc).alias("metadata"))


@register
def metadata_lists(spark, sf_dir):
    """The lists of the metadata document, one row an entry (project, list, key, JSON)."""
    files, edges = _scan(spark, sf_dir)
    edges = materialize(edges)
    scores = K.cobol_project_scores(projects_from_nation(spark, sf_dir), K.cobol_file_scores(files))
    deps = edges.groupBy("project_id").agg(F.count(F.lit(1)).alias("total_deps"))
    lists = [("programs", M.program_inventory(files), "path", ["name", "type", "loc", "complexity", "priority"]),
             ("file_type_distribution", M.type_distribution(files), "type", ["type", "count", "percentage"]),
             ("dependencies", M.dependency_list(files, C.dependency_lists(edges)), "path", ["source", "targets"]),
             ("high_complexity_modules", M.high_complexity_top10(files), "path", ["name", "score", "risk", "recommendation"]),
             ("risks", M.cobol_risks(scores, deps), "id", ["id", "category", "description", "severity"])]
    from functools import reduce
    return reduce(DataFrame.unionByName, [
        df.select("project_id", F.lit(name).alias("list"), F.col(key).alias("key"), F.to_json(F.struct(*cols)).alias("item"))
        for name, df, key, cols in lists])


@register
def pg_metadata(spark, sf_dir):
    """The PostgreSQL metadata document per project; its lists are ``pg_changes``, ``pg_risks``
    and ``java_inventory``."""
    p = _PgParts(spark, sf_dir)
    counts = ["tables", "views", "functions", "stored_procedures", "triggers", "indexes", "sequences", "partitioned_tables"]
    j = p.scores.join(p.total_files, "project_id", "left").join(p.orm, "project_id", "left") \
        .join(p.database.select("project_id", *[F.col(x).cast("long").alias(f"db_{x}") for x in counts]), "project_id", "left")
    zero = lambda x: F.coalesce(F.col(x), F.lit(0)).cast("long")
    doc = F.struct(
        F.struct(zero("total_files").alias("total_files"), zero("total_loc").alias("total_loc"), F.coalesce("orm_framework", F.lit("None")).alias("ormFramework"),
                 F.struct(*[zero(f"db_{x}").alias(x) for x in counts]).alias("database"), zero("native_queries").alias("nativeQueryCount")).alias("source_analysis"),
        F.format_string("%s difficulty (score: %d/100) - %s", F.col("difficulty"), F.col("overall"), F.col("description")).alias("complexity_summary"),
        F.struct("overall", *PG.DIMS, "difficulty", "description").alias("migrationComplexity"))
    return j.select("project_id", F.to_json(doc).alias("metadata"))


# ---------------------------------------------------------------- remaining COBOL roll-ups
@register
def cobol_totals(spark, sf_dir):
    """M1"""
    return M.totals(_files(spark, sf_dir))


@register
def cobol_dependencies(spark, sf_dir):
    """M4"""
    return M.dependency_list(_programs(spark, sf_dir), C.dependency_lists(_edges(spark, sf_dir)))


@register
def cobol_database(spark, sf_dir):
    """M6: database block per project from the project's DDL files."""
    return M.database_block(projects_from_nation(spark, sf_dir), _ddl_db(spark, sf_dir))


@register
def cobol_summary(spark, sf_dir):
    """M8"""
    return M.complexity_summary(_project_scores(spark, sf_dir))
