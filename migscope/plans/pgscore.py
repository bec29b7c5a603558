"""PostgreSQL -> Oracle assessment of a project: six difficulty dimensions,
details, recommendations, risks, primary ORM and Java change categories.

Inputs are the per-file tables of the Java scan and of the DDL files of each
project.  Everything is reduced to one row of integer facts per project by
hash aggregates (partial aggregation before the exchange), then scored with
column arithmetic; ordered detail lists are deduplicated per (project, item)
first, so no group grows with the number of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from migscope.functions.text import js_round, js_to_fixed1_per_million
from migscope.session import materialize
from migscope.operators import pgfeat as G
from migscope.plans.score import banded, difficulty

c = F.col
KEYS = ["project_id", "path"]
DIMS = ["schema_score", "sql_score", "proc_score", "volume_score", "app_score", "ops_score"]

# Difficulty descriptions of the PostgreSQL scorer by band.
PG_DESCRIPTIONS = [
    "Low complexity migration - straightforward conversion with minimal PostgreSQL-specific features",
    "Medium complexity migration - some PostgreSQL-specific features require careful conversion",
    "High complexity migration - significant PostgreSQL-specific features and dependencies",
    "Very high complexity migration - extensive PostgreSQL-specific features requiring comprehensive migration strategy",
]
# The types and index methods that the dimensions count.
COMPLEX_TYPES = ["JSONB", "JSON", "ARRAY", "HSTORE", "UUID", "CITEXT", "TSQUERY", "TSVECTOR"]
VOLUME_TYPES = ["JSONB", "JSON", "ARRAY"]
ADVANCED_INDEX = ["GIN", "GIST", "BRIN", "SPGIST"]


def _cap(x: Column, hi: int) -> Column:
    return F.least(x, F.lit(hi))


class DdlFacts:
    """Facts of the projects' DDL files.  ``union`` (the default) takes every file; ``last`` keeps
    only the last file of a project, for compatibility with the rule that a later file
    replaces earlier results (D15).  The files are mined once, into their feature records;
    everything else reads these.  With ``store=False`` the records are not written down: for a plan that
    reads one table of them, once, so that the parts it does not read are not mined."""

    def __init__(self, spark: SparkSession, ddl_src: DataFrame, mode: str = "union", store: bool = True):
        if mode == "last":
            last = ddl_src.groupBy("project_id").agg(F.max("path").alias("path"))
            ddl_src = ddl_src.join(last, KEYS, "left_semi")
        records = G.pg_file_features(ddl_src)
        self.features = materialize(records) if store else records
        self.types = G.pg_type_usage(self.features)
        self.indexes = G.pg_index_types(self.features)
        self.extensions = G.pg_extensions(self.features)

    def database(self) -> DataFrame:
        return G.object_totals(self.features)

    def facts(self) -> DataFrame:
        return ddl_project_facts(self.features)


DDL_SUMS = ["complex_type_count", "serial_count", "complex_data_tables", "plpgsql_functions", "function_lines", "dynamic_functions",
            "array_json_functions", "table_functions", "checks", "exclusions", "inheritance_tables", "partitioned_tables", "trigger_count",
            "rls", "partial_indexes", "advanced_index_count", "total_rows", "large_tables"]


def ddl_project_facts(features: DataFrame) -> DataFrame:
    """Per-project DDL facts for K10, K12, K13, K15, K17 and M13 in one pass over the records: each
    file emits one row for its sums and one row per type, index method and extension, with the
    place where it was met; a hash aggregate on (project, kind, item) -- partially aggregated before
    the exchange -- adds them up, and a second, small one per project orders the lists."""
    def total(part: str, value, where=None) -> Column:
        rows = F.filter(part, where) if where else c(part)
        return F.aggregate(rows, F.lit(0).cast("long"), lambda a, x: a + value(x))

    def number(part: str, where) -> Column:
        return F.size(F.filter(part, where)).cast("long")

    sums = {
        "complex_type_count": total("types", lambda x: x["count"], lambda x: x["type"].isin(COMPLEX_TYPES)),
        "serial_count": total("types", lambda x: x["count"], lambda x: x["type"].contains("SERIAL")),
        "complex_data_tables": total("types", lambda x: F.size(x["tables"]).cast("long"), lambda x: x["type"].isin(VOLUME_TYPES)),
        "plpgsql_functions": F.size("functions").cast("long"),
        "function_lines": total("functions", lambda x: x["complexity"]),
        "dynamic_functions": number("functions", lambda x: x["uses_dynamic_sql"]),
        "array_json_functions": number("functions", lambda x: x["uses_arrays"] | x["uses_json"]),
        "table_functions": number("functions", lambda x: x["returns_table"]),
        "checks": c("check_constraints"), "exclusions": c("exclusion_constraints"),
        "inheritance_tables": F.size("inheritance").cast("long"), "partitioned_tables": F.size("partitions").cast("long"),
        "trigger_count": F.size("triggers").cast("long"), "rls": c("rls_policies"), "partial_indexes": c("partial_indexes"),
        "advanced_index_count": total("indexes", lambda x: x["count"], lambda x: x["type"].isin(ADVANCED_INDEX) & ~x["oracle_support"]),
        "total_rows": total("estimates", lambda x: x["estimated_rows"]),
        "large_tables": number("estimates", lambda x: x["size_category"].isin("Very Large", "Large")),
    }

    def fact(kind: str, item: Column, n: Column, place: list[Column]) -> Column:
        return F.struct(F.lit(kind).alias("kind"), item.cast("string").alias("item"), n.cast("long").alias("n"),
                        *[x.cast("long").alias(f"o{k}") for k, x in enumerate(place, start=1)])

    zero = F.lit(0)
    facts = F.concat(
        F.array(fact("file", F.lit(None), F.lit(1), [zero, zero, zero])),
        F.transform("types", lambda t: fact("type", t["type"], t["count"], [t["seen"]["o1"], t["seen"]["o2"], t["seen"]["o3"]])),
        F.transform("indexes", lambda x: fact("index", x["type"], x["count"], [x["first_ord"], zero, zero])),
        F.transform("extensions", lambda x, i: fact("extension", x, F.lit(1), [i, zero, zero])))
    # path and sums stay outside of the generated rows: a plan that asks for no ordered list prunes the places, and adds up by hash
    rows = features.select("project_id", "path", *[sums[n].alias(n) for n in DDL_SUMS], facts.alias("facts")) \
        .select("project_id", "path", *DDL_SUMS, F.explode_outer("facts").alias("f")) \
        .select("project_id", F.struct("path", "f.o1", "f.o2", "f.o3").alias("at"), *DDL_SUMS, "f.kind", "f.item", "f.n")
    g = rows.groupBy("project_id", "kind", "item").agg(F.sum("n").alias("n"), F.min("at").alias("at"), *[F.sum(n).alias(n) for n in DDL_SUMS])
    is_ = lambda kind: c("kind") == kind
    ordered = lambda cond, value: F.transform(
        F.array_sort(F.collect_list(F.when(cond, F.struct("at", value.alias("v"))))), lambda s: s["v"])
    type_line = F.format_string("%d %s columns (%s complexity → %s)", c("n"), c("item"), G.complexity(c("item")), G.oracle_type(c("item")))
    out = g.groupBy("project_id").agg(
        F.lit(True).alias("has_ddl"), *[F.sum(F.when(is_("file"), c(n))).alias(n) for n in DDL_SUMS],
        F.count_if(is_("extension")).alias("extension_count"),
        ordered(is_("type") & (c("n") > 0), type_line).alias("type_lines"), ordered(is_("extension"), c("item")).alias("extension_list"),
        ordered(is_("index") & ~G.oracle_support(c("item")), c("item")).alias("advanced_index_types"),
        ordered(is_("type"), c("item")).alias("type_names"), ordered(is_("index"), c("item")).alias("index_names"))
    return out.withColumn("avg_function_lines", F.when(c("plpgsql_functions") > 0, c("function_lines") / c("plpgsql_functions"))).drop("function_lines")


JAVA_SUMS = ["loc", "function_uses", "operator_uses", "boolean_files", "plain_jdbc_files", "mybatis_files",
             "jdbc_calls", "schema_code_uses", "entity_files", "repository_files", "native_queries",
             "pg_native_queries", "limit_offset_queries", "returning_queries", "service_files_with_queries"]


#: The columns of ``java_files`` that the facts, the inventory and the primary ORM read.
JAVA_COLUMNS = [*KEYS, "name", "type", "loc", "orm_framework", "pg_functions", "uses_boolean", "pg_operators", "jdbc_calls", "schema_code",
                "native_queries", "pg_native_queries", "limit_offset_queries", "returning_queries", "has_pg_dependency"]


def java_project_facts(java_files: DataFrame) -> DataFrame:
    """Per-project Java facts for K11, K14, K17 and M14 in one pass.

    Each file emits one 'orm' fact row with its label and sums, and one row per function and
    operator; a first hash aggregate on (project, kind, item) -- partially
    aggregated before the exchange -- dedupes items with their first-seen
    position; a second, tiny one per project assembles sums and ordered lists."""
    i = lambda b: F.when(b, 1).otherwise(0)
    sums = [
        c("loc").alias("loc"), F.size("pg_functions").alias("function_uses"),
        F.size("pg_operators").alias("operator_uses"),
        i(c("uses_boolean")).alias("boolean_files"),
        i(c("orm_framework") == "Plain JDBC").alias("plain_jdbc_files"),
        i(c("orm_framework") == "MyBatis").alias("mybatis_files"),
        c("jdbc_calls").alias("jdbc_calls"), F.size("schema_code").alias("schema_code_uses"),
        i(c("type") == "Entity").alias("entity_files"), i(c("type") == "Repository").alias("repository_files"),
        c("native_queries").alias("native_queries"), c("pg_native_queries").alias("pg_native_queries"),
        c("limit_offset_queries").alias("limit_offset_queries"), c("returning_queries").alias("returning_queries"),
        i((c("type") == "Service") & (c("native_queries") > 0)).alias("service_files_with_queries")]

    def fact(kind, item, pos):
        return F.struct(F.lit(kind).alias("kind"), item.cast("string").alias("item"), pos.cast("int").alias("i"))
    facts = F.concat(
        F.array(fact("orm", c("orm_framework"), F.lit(0))),
        F.transform("pg_functions", lambda x, k: fact("fn", x, k)),
        F.transform("pg_operators", lambda x, k: fact("op", x, k)))
    # ``facts`` is never empty; an inner generator would have Catalyst test that, and so mine, below the spread of the keys.
    # Path and sums stay outside of the generated rows: a plan that asks for neither all sums nor an ordered list prunes
    # them, with their mining, and adds up by hash.
    ex = java_files.select("project_id", "path", *sums, facts.alias("facts")).select("project_id", "path", *JAVA_SUMS, F.explode_outer("facts").alias("f")) \
        .select("project_id", F.struct("path", "f.i").alias("at"), *JAVA_SUMS, "f.*")
    g = ex.groupBy("project_id", "kind", "item").agg(
        F.count(F.lit(1)).alias("n"), F.min("at").alias("at"), *[F.sum(x).alias(x) for x in JAVA_SUMS])
    k = c("kind")
    ordered = lambda kind, val: F.transform(
        F.array_sort(F.collect_list(F.when(k == kind, F.struct(c("at").alias("at"), val.alias("v"))))),
        lambda s: s["v"])
    return g.groupBy("project_id").agg(
        F.sum(F.when(k == "orm", c("n"))).alias("java_files"),
        *[F.sum(F.when(k == "orm", c(x))).alias("total_loc" if x == "loc" else x) for x in JAVA_SUMS],
        ordered("fn", c("item")).alias("function_set"),
        ordered("op", c("item")).alias("operator_set"),
        ordered("orm", F.struct(c("item").alias("orm"), c("n").alias("n"))).alias("orm_counts"))


def pg_project_scores(spark: SparkSession, projects: DataFrame, java_files: DataFrame,
                      ddl: DdlFacts | None) -> DataFrame:
    """The six dimension scores, overall, difficulty, description and
    the six detail lists of every project."""
    p = projects.select("project_id").join(java_project_facts(java_files), "project_id", "left")
    if ddl is not None:
        p = p.join(ddl.facts(), "project_id", "left").drop("type_names", "index_names")
    else:
        p = p.withColumn("has_ddl", F.lit(None).cast("boolean"))
    num = ["java_files", "total_loc", "function_uses", "operator_uses", "boolean_files", "plain_jdbc_files",
           "mybatis_files", "jdbc_calls", "schema_code_uses", "entity_files", "repository_files", "native_queries",
           "pg_native_queries", "limit_offset_queries", "returning_queries", "complex_type_count", "serial_count",
           "complex_data_tables", "plpgsql_functions", "dynamic_functions", "array_json_functions",
           "table_functions", "checks", "exclusions", "inheritance_tables", "partitioned_tables", "trigger_count",
           "rls", "partial_indexes", "extension_count", "advanced_index_count", "total_rows", "large_tables",
           "service_files_with_queries"]
    empty = F.array().cast("array<string>")
    # one projection: a plan is analysed again for each
    known = p.columns
    filled = {n: F.coalesce(c(n), F.lit(0)).cast("long") if n in known else F.lit(0).cast("long") for n in num}
    filled |= {n: F.coalesce(c(n), empty) if n in known else empty for n in ["type_lines", "extension_list", "advanced_index_types", "function_set", "operator_set"]}
    missing = {"avg_function_lines": F.lit(None).cast("double"), "orm_counts": F.lit(None).cast("array<struct<orm:string,n:bigint>>")}
    filled |= {n: e for n, e in missing.items() if n not in known}
    p = p.select(*[c(n) for n in known if n not in filled], *[e.alias(n) for n, e in filled.items()])
    has = F.coalesce(c("has_ddl"), F.lit(False))
    score = lambda raw: F.least(js_round(raw), F.lit(100))
    avgl = c("avg_function_lines")
    schema = score(_cap(c("complex_type_count") * 5, 30) + _cap(c("serial_count") * 2, 10)
                   + _cap(c("checks") * 2, 15) + _cap(c("exclusions") * 5, 15)
                   + F.when(c("inheritance_tables") > 0, 10).otherwise(0)
                   + _cap(c("partitioned_tables") * 5, 20))
    sql = score(_cap(c("pg_native_queries") * 3, 30) + _cap(c("function_uses") * 2, 25)
                + _cap(c("operator_uses") * 2, 20) + _cap(c("limit_offset_queries"), 10)
                + _cap(c("returning_queries") * 2, 10) + _cap(c("boolean_files"), 5))
    proc = score(_cap(c("plpgsql_functions") * 5, 25)
                 + F.when(c("plpgsql_functions") > 0,
                          F.when(avgl > 100, 20).when(avgl > 50, 10).when(avgl > 20, 5).otherwise(0)).otherwise(0)
                 + _cap(c("dynamic_functions") * 8, 20) + _cap(c("array_json_functions") * 5, 15)
                 + _cap(c("table_functions") * 3, 10) + _cap(c("trigger_count") * 3, 10))
    tr = c("total_rows")
    volume = score(F.when(tr > 1000000000, 40).when(tr > 100000000, 30).when(tr > 10000000, 20)
                   .when(tr > 1000000, 10).otherwise(0)
                   + _cap(c("large_tables") * 5, 20) + _cap(c("partitioned_tables") * 8, 20)
                   + _cap(c("complex_data_tables") * 5, 20))
    app = score(_cap(c("plain_jdbc_files") * 8, 30) + _cap(c("native_queries") * 2, 25)
                + _cap(c("mybatis_files") * 3, 20) + _cap(c("jdbc_calls") * 2, 15)
                + _cap(c("schema_code_uses") * 5, 10))
    ops = score(_cap(c("extension_count") * 10, 30) + _cap(c("advanced_index_count") * 5, 20)
                + F.when(c("rls") > 0, 15).otherwise(0) + _cap(c("partial_indexes") * 3, 15) + F.lit(20))
    s = p.select(
        "*",
        F.when(has, schema).otherwise(0).cast("long").alias("schema_score"),
        sql.cast("long").alias("sql_score"),
        F.when(has, proc).otherwise(0).cast("long").alias("proc_score"),
        F.when(has, volume).otherwise(0).cast("long").alias("volume_score"),
        app.cast("long").alias("app_score"),
        F.when(has, ops).otherwise(15).cast("long").alias("ops_score"))
    overall = js_round(c("schema_score") * 0.20 + c("sql_score") * 0.20 + c("proc_score") * 0.20
                       + c("volume_score") * 0.15 + c("app_score") * 0.15 + c("ops_score") * 0.10)
    s = s.withColumn("overall", overall)
    s = s.withColumn("difficulty", difficulty(c("overall"))).withColumn(
        "description", banded(c("overall"), PG_DESCRIPTIONS))
    return _with_details(s, has)


def _lines(items: list[tuple[Column, Column]]) -> Column:
    return F.filter(F.array(*[F.when(cond, txt) for cond, txt in items]), lambda x: x.isNotNull())


def _with_details(s: DataFrame, has: Column) -> DataFrame:
    fmt = F.format_string
    n = c
    schema = F.when(has, F.concat(c("type_lines"), _lines([
        (n("inheritance_tables") > 0,
         fmt("%d tables using inheritance (requires redesign for Oracle)", n("inheritance_tables"))),
        (n("partitioned_tables") > 0, fmt("%d partitioned tables (migration strategy needed)", n("partitioned_tables"))),
    ]))).otherwise(F.array().cast("array<string>"))
    sql = _lines([
        (n("native_queries") > 0, fmt("%d native SQL queries requiring review", n("native_queries"))),
        (F.size("function_set") > 0,
         F.concat(F.lit("PostgreSQL-specific functions: "), F.array_join("function_set", ", "))),
        (F.size("operator_set") > 0,
         F.concat(F.lit("PostgreSQL-specific operators requiring conversion: "), F.array_join("operator_set", ", "))),
    ])
    pf = n("plpgsql_functions") > 0
    proc = F.when(has, _lines([
        (pf, fmt("%d PL/pgSQL functions need conversion to PL/SQL", n("plpgsql_functions"))),
        (pf & (n("dynamic_functions") > 0),
         fmt("%d functions use dynamic SQL (high conversion risk)", n("dynamic_functions"))),
        (pf & (n("array_json_functions") > 0),
         fmt("%d functions use arrays/JSON (complex conversion)", n("array_json_functions"))),
        (n("trigger_count") > 0, fmt("%d triggers require conversion", n("trigger_count"))),
    ])).otherwise(F.array().cast("array<string>"))
    volume = F.when(has, _lines([
        (n("total_rows") > 0,
         F.concat(F.lit("Estimated "), js_to_fixed1_per_million(n("total_rows")), F.lit("M total rows to migrate"))),
        (n("large_tables") > 0, fmt("%d large tables requiring careful migration strategy", n("large_tables"))),
        (n("partitioned_tables") > 0,
         fmt("%d partitioned tables (partition strategy conversion needed)", n("partitioned_tables"))),
    ])).otherwise(F.array().cast("array<string>"))
    orm_lines = F.transform(F.filter(F.coalesce(c("orm_counts"), F.array()), lambda x: x["orm"] != "None"),
                            lambda x: F.format_string("%d files using %s", x["n"], x["orm"]))
    app = F.concat(orm_lines, _lines([
        (n("plain_jdbc_files") > 0,
         fmt("%d files with direct JDBC calls (highest migration effort)", n("plain_jdbc_files")))]))
    ops = F.concat(F.when(has, _lines([
        (F.size("extension_list") > 0,
         F.concat(F.lit("PostgreSQL extensions in use: "), F.array_join("extension_list", ", "))),
        (F.size("advanced_index_types") > 0,
         F.concat(F.lit("Advanced index types requiring alternatives: "), F.array_join("advanced_index_types", ", "))),
        (n("rls") > 0, F.lit("Row-level security policies require Oracle VPD implementation")),
    ])).otherwise(F.array().cast("array<string>")),
        F.array(F.lit("Transaction isolation and concurrency control differences require testing")))
    return s.select("*", schema.alias("schema_details"), sql.alias("sql_details"), proc.alias("proc_details"),
                    volume.alias("volume_details"), app.alias("app_details"), ops.alias("ops_details"))


# Recommendation rules (dimension, score column, issue, mitigation).
RECOMMENDATIONS = [
    ("Schema & Data Types", "schema_score", "Complex PostgreSQL data types detected",
     "Update DDL scripts with Oracle equivalents (JSONB→JSON/CLOB, ARRAY→VARRAY, SERIAL→SEQUENCE+TRIGGER). "
     "Modify Entity class annotations if needed (@Type for custom types). Keep entity business logic unchanged."),
    ("SQL & Query Rewrite", "sql_score", "Numerous PostgreSQL-specific SQL features",
     "Rewrite SQL in @Query annotations and MyBatis XML (LIMIT→FETCH FIRST, array_agg→LISTAGG, "
     "RETURNING→OUTPUT). Keep repository method signatures and service layer unchanged. NO refactoring of "
     "business logic."),
    ("Procedures & Functions", "proc_score", "PL/pgSQL functions require conversion to PL/SQL",
     "Convert PL/pgSQL to PL/SQL in database layer only. If procedures are called from Java (@Procedure), update "
     "only the procedure name/parameters in Repository interface. Keep business logic in service layer unchanged."),
    ("Data Volume", "volume_score", "Large data volume migration",
     "Use Oracle Data Pump or AWS DMS for data migration. Recreate partitioning in Oracle DDL. Update Entity classes "
     "only if partition keys change. NO application logic changes required."),
    ("Application & ORM", "app_score", "Application code has PostgreSQL dependencies",
     "Update JDBC driver (org.postgresql.Driver→oracle.jdbc.OracleDriver) in config files. Rewrite SQL in @Query "
     "and MyBatis XML. **CRITICAL: Do NOT refactor repository methods or business logic.** Keep method signatures, "
     "return types, and service layer unchanged."),
    ("Operational & Runtime", "ops_score", "PostgreSQL extensions and operational differences",
     "Replace PostgreSQL extensions with Oracle equivalents in DDL (PostGIS→Oracle Spatial, pg_trgm→Oracle "
     "Text). Recreate GIN/GIST indexes as B-tree or function-based indexes. Update database config files only. NO "
     "Java code changes for indexing."),
]
PRINCIPLE = ("Migration Principle", "High", "Database migration from PostgreSQL to Oracle",
             "**KEEP JAVA APPLICATION LOGIC UNCHANGED**. Limited Java changes restricted to: (1) Entity mappings "
             "(@Entity, @Table, @Column), (2) Repository queries (@Query annotations, MyBatis XML), (3) Database "
             "configurations (JDBC driver, connection properties). NO business logic refactoring required.")


def pg_recommendations(scores: DataFrame) -> DataFrame:
    """The fixed principle first, then one row per dimension scoring > 50
    (High when > 70).  Candidate structs per project, exploded (no join)."""
    def rec(i, dim, sev, issue, mit):
        return F.struct(F.lit(i).alias("rule_no"), F.lit(dim).alias("dimension"), sev.alias("severity"),
                        F.lit(issue).alias("issue"), F.lit(mit).alias("mitigation"))
    cands = [rec(0, PRINCIPLE[0], F.lit(PRINCIPLE[1]), PRINCIPLE[2], PRINCIPLE[3])]
    for i, (dim, col, issue, mit) in enumerate(RECOMMENDATIONS, start=1):
        cands.append(F.when(c(col) > 50, rec(i, dim, F.when(c(col) > 70, "High").otherwise("Medium"), issue, mit)))
    return scores.select("project_id", F.explode(F.filter(F.array(*cands), lambda x: x.isNotNull())).alias("r")) \
        .select("project_id", "r.*")


# PostgreSQL project risks (id, category, severity, impact, mitigation).
PG_RISKS = {
    "PG-R-001": ("Migration Complexity", None,
                 "Complex PostgreSQL-to-Oracle migration may lead to longer timeline and increased resource requirements",
                 "Focus on database layer migration (DDL, SQL queries, procedures). Keep Java application logic unchanged. "
                 "Allocate database migration specialists and use tools (Ora2Pg, AWS DMS)."),
    "PG-R-002": ("Schema & Data Types", "High",
                 "Complex PostgreSQL data types may require Entity annotation updates",
                 "Update DDL scripts with Oracle equivalents (JSONB→JSON/CLOB, ARRAY→VARRAY). Modify Entity class "
                 "annotations (@Type, @Column) ONLY if type mapping fails. Keep entity business logic unchanged."),
    "PG-R-003": ("SQL Rewrite", "High",
                 "Extensive SQL query rewrites in @Query annotations and MyBatis XML required",
                 "Rewrite SQL in @Query and MyBatis XML with Oracle syntax (LIMIT→FETCH FIRST, array_agg→LISTAGG). "
                 "**CRITICAL: Keep repository method signatures, parameters, and return types unchanged.** No service "
                 "layer changes."),
    "PG-R-004": ("Procedures & Functions", "High", "PL/pgSQL to PL/SQL conversion requires careful review",
                 "Convert PL/pgSQL to PL/SQL in database layer. If called from Java (@Procedure), update only procedure "
                 "name/parameters in Repository interface. Keep business logic in service layer unchanged."),
    "PG-R-005": ("Data Volume", "Medium", "Large data volumes require careful migration planning",
                 "Use Oracle Data Pump or AWS DMS. Recreate partitioning in Oracle DDL. Update Entity classes only if "
                 "partition keys change. NO application logic changes."),
    "PG-R-006": ("Application Dependencies", "High", "Database layer Java code requires targeted updates", None),
    "PG-R-007": ("Operational & Runtime", "Medium",
                 "PostgreSQL extensions and operational differences may affect application behavior",
                 "Replace extensions in DDL with Oracle equivalents (PostGIS→Oracle Spatial). Recreate GIN/GIST "
                 "indexes. Update DB config files only. NO Java code changes for indexing."),
    "PG-R-008": ("Extensions", "High", "Extensions may not have direct Oracle equivalents",
                 "Research Oracle alternatives for each extension. Replace in DDL scripts. If Java code calls extension "
                 "functions, update SQL queries in repositories only. NO business logic changes."),
}
PG_R006_MITIGATION = ("**Acceptable Java changes (DB layer only):** (1) Update JDBC driver in config files, (2) Modify "
                      "Entity annotations if type mapping needed, (3) Rewrite SQL in Repository @Query/MyBatis XML. "
                      "**CRITICAL: Do NOT refactor repository methods or service layer logic.** Keep method signatures "
                      "and business logic unchanged.")


def pg_risks(scores: DataFrame) -> DataFrame:
    """PG-R-001 .. PG-R-008 per project."""
    fmt = F.format_string

    def risk(rid, cond, desc, sev=None, mitigation=None):
        cat, s, impact, mit = PG_RISKS[rid]
        return F.when(cond, F.struct(
            F.lit(rid).alias("id"), F.lit(cat).alias("category"), desc.alias("description"),
            (sev if sev is not None else F.lit(s)).alias("severity"), F.lit(impact).alias("impact"),
            (mitigation if mitigation is not None else F.lit(mit)).alias("mitigation")))

    def scored(col, label):
        return F.concat(fmt(f"{label}: %d/100. ", c(col)), F.array_join(c(col.replace("_score", "_details")), "; "))
    svc = c("service_files_with_queries")
    cands = F.array(
        risk("PG-R-001", c("overall") >= 60, fmt("Migration difficulty score is %d/100 (%s)", c("overall"), c("difficulty")),
             F.when(c("overall") >= 80, "Critical").otherwise("High")),
        risk("PG-R-002", c("schema_score") >= 60, scored("schema_score", "Schema complexity score")),
        risk("PG-R-003", c("sql_score") >= 60, scored("sql_score", "SQL rewrite complexity")),
        risk("PG-R-004", c("proc_score") >= 60, scored("proc_score", "Procedure complexity")),
        risk("PG-R-005", c("volume_score") >= 60, scored("volume_score", "Data migration complexity")),
        risk("PG-R-006", c("app_score") >= 60,
             F.concat(fmt("Application dependency complexity: %d/100. Java files with DB dependencies: %d Entities, "
                          "%d Repositories", c("app_score"), c("entity_files"), c("repository_files")),
                      F.when(svc > 0, fmt(", %d Services (review required)", svc)).otherwise(F.lit(""))),
             mitigation=F.concat(F.lit(PG_R006_MITIGATION),
                                 F.when(svc > 0, F.lit(" Services with native queries require careful review."))
                                 .otherwise(F.lit("")))),
        risk("PG-R-007", c("ops_score") >= 60, scored("ops_score", "Operational risk")),
        risk("PG-R-008", F.coalesce(c("has_ddl"), F.lit(False)) & (F.size("extension_list") > 0),
             F.concat(F.lit("PostgreSQL extensions in use: "), F.array_join("extension_list", ", "))),
    )
    return scores.select("project_id", F.explode(F.filter(cands, lambda x: x.isNotNull())).alias("r")) \
        .select("project_id", "r.*")


def primary_orm(java_files: DataFrame) -> DataFrame:
    """M9: the most frequent framework other than None (ties: first seen in path
    order); more than two distinct labels, None included, gives 'Mixed (...)'.
    Two hash aggregates, no window: the winner is ``min_by`` over (-count, first
    path) of the non-None labels.  (A filter on the derived label would be pushed
    into the file projection and re-evaluate its regexes.)"""
    g = java_files.groupBy("project_id", "orm_framework").agg(
        F.count(F.lit(1)).alias("n"), F.min("path").alias("first_path"))
    real = c("orm_framework") != "None"
    p = g.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("labels"),
        F.transform(F.array_sort(F.collect_list(F.struct("first_path", "orm_framework"))),
                    lambda s: s["orm_framework"]).alias("ordered"),
        F.min_by(F.when(real, c("orm_framework")), F.when(real, F.struct((-c("n")).alias("m"), c("first_path"))))
        .alias("best"))
    mixed = F.concat(F.lit("Mixed ("), F.array_join(F.filter("ordered", lambda x: x != "None"), ", "), F.lit(")"))
    return p.select("project_id", F.when(c("labels") > 2, mixed).otherwise(F.coalesce(c("best"), F.lit("None")))
                    .alias("orm_framework"))


def java_changes(inventory: DataFrame) -> DataFrame:
    """Change category of every Java file with a PostgreSQL dependency."""
    t = c("type")
    cat = (F.when(t == "Entity", "entity_mapping").when(t == "Repository", "repository_query")
           .when(t == "Configuration", "configuration").otherwise("requires_review"))
    text = (F.when(t.isin("Entity", "Repository", "Configuration"), c("path"))
            .when(t.isin("Service", "Controller"),
                  F.format_string("%s (%s with native queries - review for business logic impact)", c("path"), t))
            .otherwise(F.format_string("%s (%s - unexpected DB dependency)", c("path"), t)))
    return inventory.where("has_pg_dependency").select("project_id", "path", "type", cat.alias("category"),
                                                       text.alias("text"))


def change_summary(inventory: DataFrame) -> DataFrame:
    """M12"""
    ch = java_changes(inventory)
    tot = inventory.groupBy("project_id").agg(F.count(F.lit(1)).alias("total_files"))
    s = ch.groupBy("project_id").agg(
        F.count_if(c("category") != "requires_review").alias("files_requiring_change"),
        F.count_if(c("category") == "requires_review").alias("files_requiring_review"))
    return tot.join(s, "project_id", "left").select(
        "project_id", c("total_files").cast("long"),
        F.coalesce(c("files_requiring_change"), F.lit(0)).cast("long").alias("files_requiring_change"),
        F.coalesce(c("files_requiring_review"), F.lit(0)).cast("long").alias("files_requiring_review"))
