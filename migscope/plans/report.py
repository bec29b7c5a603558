"""Report tables behind the generated documents.

A document is a long table ``report_rows(project_id, doc, section, sub, line)``:
every row is one Markdown line, ``(section, sub)`` orders the lines.  Program and
file lines are keyed by their path, so no window and no per-project collection
is needed; the sink writes one text file per (project, document) from rows
sorted within their partition (``write_reports``)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from migscope.plans.project import risk_list

c = F.col
fmt = F.format_string

# Context defaults of the document generator.
CONTEXT_DEFAULTS = {
    "source_language": "COBOL", "source_database": "Oracle 11g", "app_server": "IBM WebSphere", "os": "z/OS",
    "target_language": "Java 17", "framework": "Spring Boot 3.x", "target_database": "PostgreSQL 15",
    "deployment": "Docker/Kubernetes", "version": "1.0", "author": "Auto-generated",
}


def report_context(projects: DataFrame, generated_date: Column | None = None) -> DataFrame:
    """Project, source and target with defaults, date, version, author.
    The date is an argument so that compared results stay fixed."""
    d = CONTEXT_DEFAULTS
    gd = generated_date if generated_date is not None else F.date_format(F.current_date(), "yyyy-MM-dd")
    col = lambda n: c(n) if n in projects.columns else F.lit(None).cast("string")
    return projects.select(
        "project_id", c("name").alias("project_name"), "migration_type",
        F.coalesce(col("source_language"), F.lit(d["source_language"])).alias("source_language"),
        F.coalesce(col("source_database"), F.lit(d["source_database"])).alias("source_database"),
        F.lit(d["app_server"]).alias("app_server"), F.lit(d["os"]).alias("os"),
        F.coalesce(col("target_language"), F.lit(d["target_language"])).alias("target_language"),
        F.lit(d["framework"]).alias("framework"),
        F.coalesce(col("target_database"), F.lit(d["target_database"])).alias("target_database"),
        F.lit(d["deployment"]).alias("deployment"),
        gd.alias("generated_date"), F.lit(d["version"]).alias("version"), F.lit(d["author"]).alias("author"))


def _rows(df: DataFrame, doc: str, section: int, sub: Column, line: Column) -> DataFrame:
    return df.select("project_id", F.lit(doc).alias("doc"), F.lit(section).alias("section"),
                     sub.alias("sub"), line.alias("line"))


def _fixed(projects: DataFrame, doc: str, section: int, lines: list[str]) -> DataFrame:
    arr = F.array(*[F.struct(F.lit(f"{i:04d}").alias("sub"), F.lit(t).alias("line")) for i, t in enumerate(lines)])
    return projects.select("project_id", F.explode(arr).alias("x")).select(
        "project_id", F.lit(doc).alias("doc"), F.lit(section).alias("section"), "x.sub", "x.line")


def _per_project(projects: DataFrame, doc: str, section: int, lines: list[Column]) -> DataFrame:
    arr = F.array(*[F.struct(F.lit(f"{i:04d}").alias("sub"), t.alias("line")) for i, t in enumerate(lines)])
    return projects.select("project_id", F.explode(arr).alias("x")).select(
        "project_id", F.lit(doc).alias("doc"), F.lit(section).alias("section"), "x.sub", "x.line")


def _or_note(present: DataFrame, projects: DataFrame, doc: str, section: int, note: str) -> DataFrame:
    """The template's {{else}} line for projects without rows in a section."""
    missing = projects.select("project_id").join(present.select("project_id").distinct(), "project_id", "left_anti")
    return _fixed(missing, doc, section, [note])


def cobol_report_rows(ctx: DataFrame, scores: DataFrame, inventory: DataFrame, dependencies: DataFrame, database: DataFrame,
                      top10: DataFrame) -> DataFrame:
    """The tables behind the COBOL as-is analysis document.  ``scores``: ``cobol_project_scores`` with
    details and types; ``dependencies``: (project_id, path, source, targets, n).  Every line that
    hangs on a project alone, with its type and risk lines, headers and notes, comes from one
    explode over the project rows; program, dependency and module lines are rows of their own tables, each read here once."""
    doc = "as-is-analysis"
    db_cols = ["tables", "views", "indexes", "stored_procedures", "triggers", "functions"]
    deps = dependencies.groupBy("project_id").agg(F.sum("n").cast("long").alias("total_deps"))
    p = ctx.join(scores, "project_id", "left").join(database.select("project_id", *db_cols), "project_id", "left").join(deps, "project_id", "left") \
        .fillna(0, ["files", "total_loc", "high", "total_deps", *db_cols])
    p = p.withColumn("risks", risk_list())
    line = lambda section, sub, text: F.struct(F.lit(section).alias("section"), sub.alias("sub"), text.alias("line"))
    texts = lambda section, items: F.array(*[line(section, F.lit(f"{i:04d}"), F.lit(t) if isinstance(t, str) else t) for i, t in enumerate(items)])
    either = lambda cond, section, some, none: F.when(cond, texts(section, some)).otherwise(texts(section, none) if none else F.array().cast("array<struct<section:int,sub:string,line:string>>"))
    percent = lambda n: F.floor(n.cast("double") / c("files") * 100 + 0.5).cast("long")
    lines = F.concat(
        texts(0, [F.concat(F.lit("# As-Is System Analysis - "), c("project_name"))]),
        texts(5, ["## Executive Summary", "### Key Findings"]),
        texts(10, [fmt("- **Total Source Files:** %d", c("files")),
                   fmt("- **Total Lines of Code:** %d", c("total_loc")),
                   F.concat(F.lit("- **Source Language:** "), c("source_language")),
                   F.concat(F.lit("- **Source Database:** "), c("source_database")),
                   F.concat(F.lit("- **Complexity Assessment:** "), F.coalesce(fmt("%s difficulty (score: %d/100) - %s", c("difficulty"), c("overall"), c("description")), F.lit("")))]),
        texts(15, ["## 1. Source Code Analysis", "#### File Inventory"]),
        either(c("files") > 0, 20, ["| File Name | Type | LOC | Complexity | Priority |", "|-----------|------|-----|------------|----------|"],
               ["*[No source files analyzed yet]*"]),
        texts(21, [fmt("**Total Files:** %d", c("files")), fmt("**Total LOC:** %d", c("total_loc"))]),
        either(F.size("types") > 0, 30, ["| File Type | Count | Percentage |", "|-----------|-------|------------|"], []),
        F.transform("types", lambda t: line(30, F.concat(F.lit("1|"), t["type"]), fmt("| %s | %d | %d%% |", t["type"], t["count"], percent(t["count"])))),
        texts(35, ["### 2.2 Program Dependencies", "#### Key Dependencies"]),
        either(c("total_deps") == 0, 40, ["*[No critical dependencies identified yet]*"], []),
        texts(45, ["## 3. Database Analysis", "### 3.1 Schema Overview"]),
        texts(50, ["| Metric | Count |", "|--------|-------|"]),
        texts(51, [fmt("| Total Tables | %d |", c("tables")), fmt("| Total Views | %d |", c("views")),
                   fmt("| Total Indexes | %d |", c("indexes")), fmt("| Stored Procedures | %d |", c("stored_procedures")),
                   fmt("| Triggers | %d |", c("triggers")), fmt("| Functions | %d |", c("functions"))]),
        texts(55, ["## 4. Complexity & Quality Assessment", "### 4.2 High Complexity Modules"]),
        either(c("high") > 0, 60, ["| Module | Complexity Score | Risk Level | Recommendation |", "|--------|------------------|------------|----------------|"],
               ["*[No high-complexity modules identified]*"]),
        texts(65, ["## 6. Risk Assessment", "### 6.1 Identified Risks"]),
        either(F.size("risks") > 0, 70, ["| Risk ID | Category | Description | Severity | Impact | Mitigation |", "|---------|----------|-------------|----------|--------|------------|"],
               ["*[Risk assessment to be completed]*"]),
        F.transform("risks", lambda r: line(70, F.concat(F.lit("1|"), r["id"]), fmt("| R-%s | %s | %s | %s | %s | %s |", *[r[x] for x in ("id", "category", "description", "severity", "impact", "mitigation")]))))
    parts = [
        p.select("project_id", F.explode(lines).alias("x")).select("project_id", F.lit(doc).alias("doc"), "x.section", "x.sub", "x.line"),
        _rows(inventory, doc, 20, F.concat(F.lit("1|"), c("path")),
              fmt("| %s | %s | %d | %d | %s |", c("name"), c("type"), c("loc"), c("complexity"), c("priority"))),
        _rows(dependencies, doc, 40, F.concat(F.lit("1|"), c("path")),
              fmt("- **%s** depends on: %s", c("source"), c("targets"))),
        _rows(top10, doc, 60, F.concat(F.lit("1|"), F.lpad(c("rank").cast("string"), 19, "0")),
              fmt("| %s | %d | %s | %s |", c("name"), c("score"), c("risk"), c("recommendation"))),
    ]
    return reduce(DataFrame.unionByName, parts)


# The labels of the six dimensions.
DIMENSION_LABELS = [("Schema & Data Type Complexity", "schema_score"),
                    ("SQL & Query Rewrite Complexity", "sql_score"),
                    ("Stored Procedures/Functions/Triggers", "proc_score"),
                    ("Data Volume & Migration Strategy", "volume_score"),
                    ("Application & ORM Dependency", "app_score"),
                    ("Operational & Runtime Risk", "ops_score")]


# Title, score, detail list, impact and mitigation of each dimension in the as-is document.
CHALLENGES = [
    ("4.2 Dimension 1: Schema & Data Type Complexity", "schema",
     "Complex PostgreSQL data types (JSONB, ARRAY, HSTORE) may require Entity annotation updates in Java code.",
     "Update DDL scripts with Oracle equivalents. Modify Entity class annotations ONLY if automatic type mapping fails."),
    ("4.3 Dimension 2: SQL & Query Rewrite Complexity", "sql",
     "Extensive SQL query rewrites in @Query annotations and MyBatis XML required.",
     "Rewrite SQL with Oracle syntax. **CRITICAL: Keep repository method signatures, parameters, and return types unchanged.**"),
    ("4.4 Dimension 3: Stored Procedures, Functions & Triggers", "proc",
     "PL/pgSQL to PL/SQL conversion requires careful review and testing.",
     "Convert PL/pgSQL to PL/SQL in database layer. If called from Java (@Procedure), update only procedure name/parameters in Repository interface."),
    ("4.5 Dimension 4: Data Volume & Migration Strategy", "volume",
     "Large data volumes require careful migration planning and potential downtime.",
     "Use Oracle Data Pump or AWS DMS. Recreate partitioning in Oracle DDL. Update Entity classes only if partition keys change."),
    ("4.6 Dimension 5: Application & ORM Dependency", "app",
     "Database layer Java code requires targeted updates.",
     "Update JDBC driver in config files. Rewrite SQL in @Query and MyBatis XML. **Do NOT refactor repository methods or service layer logic.**"),
    ("4.7 Dimension 6: Operational & Runtime Risk", "ops",
     "PostgreSQL extensions and operational differences may affect application behavior.",
     "Replace extensions in DDL with Oracle equivalents. Recreate GIN/GIST indexes. Update DB config files only."),
]


def _challenge_lines() -> Column:
    """All lines of the six dimensions of a project, in order."""
    parts = [F.concat(
        F.array(F.lit(f"### {title}"), fmt("**Score:** %d/100", c(f"{k}_score")), F.lit("**Key Challenges:**")),
        F.transform(f"{k}_details", lambda d: F.concat(F.lit("- "), d)),
        F.array(F.lit(f"**Impact:** {impact}"), F.lit(f"**Mitigation:** {mitigation}"))) for title, k, impact, mitigation in CHALLENGES]
    return F.concat(*parts)


def pg_report_rows(ctx: DataFrame, scores: DataFrame, orm: DataFrame, inventory: DataFrame,
                   changes: DataFrame, change_summary: DataFrame, database: DataFrame, types: DataFrame,
                   extensions: DataFrame, indexes: DataFrame, risks: DataFrame, recs: DataFrame) -> DataFrame:
    """The tables behind the PostgreSQL as-is analysis document.  Per-project
    facts come in as one row per project; file, type and index lines as rows."""
    doc = "pg-as-is-analysis"
    p = ctx.join(scores, "project_id", "left").join(orm, "project_id", "left") \
        .join(change_summary, "project_id", "left")
    p = p.withColumn("summary", fmt("%s difficulty (score: %d/100) - %s", c("difficulty"), c("overall"),
                                    c("description")))
    parts = [
        _per_project(p, doc, 10, [
            fmt("- **Total Java Files:** %d", c("total_files")), fmt("- **Total Lines of Code:** %d", c("total_loc")),
            F.concat(F.lit("- **ORM Framework:** "), F.coalesce(c("orm_framework"), F.lit("None"))),
            F.concat(F.lit("- **Source Database:** "), c("source_database")),
            F.concat(F.lit("- **Target Database:** "), c("target_database")),
            F.concat(F.lit("- **Complexity Assessment:** "), c("summary"))]),
        _per_project(p, doc, 20, [F.lit("| Dimension | Score | Level |"), F.lit("|-----------|-------|-------|")]
                     + [fmt(f"| {lbl} | %d/100 | %s |", c(col), c("difficulty")) for lbl, col in DIMENSION_LABELS]
                     + [fmt("| **Overall** | **%d/100** | **%s** |", c("overall"), c("difficulty"))]),
        _rows(inventory, doc, 30, F.concat(F.lit("1|"), c("path")),
              fmt("- **%s:** `%s` (%d LOC) - PostgreSQL Dependencies: %s", c("type"), c("name"), c("loc"),
                  F.when(c("has_pg_dependency"), "Yes").otherwise("No"))),
        _per_project(p, doc, 40, [fmt("**Files Requiring Change:** %d", F.coalesce(c("files_requiring_change"), F.lit(0))),
                                  fmt("**Files Requiring Review:** %d", F.coalesce(c("files_requiring_review"), F.lit(0)))]),
        _rows(changes.where(c("category") == "entity_mapping"), doc, 41, F.concat(F.lit("1|"), c("path")),
              F.concat(F.lit("- "), c("text"))),
        _rows(changes.where(c("category") == "repository_query"), doc, 42, F.concat(F.lit("1|"), c("path")),
              F.concat(F.lit("- "), c("text"))),
        _rows(changes.where(c("category") == "requires_review"), doc, 44, F.concat(F.lit("1|"), c("path")),
              F.concat(F.lit("- ⚠️ "), c("text"))),
        _or_note(changes.where(c("category") == "requires_review"), p, doc, 44,
                 "✓ No files requiring special review (good architecture - business logic separated from database layer)"),
    ]
    db = p.select("project_id").join(database, "project_id", "left").fillna(0)
    parts.append(_per_project(db, doc, 50, [
        F.lit("| Component | Count |"), F.lit("|-----------|-------|"),
        fmt("| Tables | %d |", c("tables")), fmt("| Views | %d |", c("views")),
        fmt("| Stored Procedures | %d |", c("stored_procedures")), fmt("| Functions | %d |", c("functions")),
        fmt("| Triggers | %d |", c("triggers")), fmt("| Indexes | %d |", c("indexes")),
        fmt("| Sequences | %d |", c("sequences")), fmt("| Partitioned Tables | %d |", c("partitioned_tables"))]))
    tkey = F.concat(F.lit("1|"), c("path"), F.lit("|"), c("seen.o1").cast("string"), F.lit("|"),
                    F.lpad(c("seen.o2").cast("string"), 19, "0"), F.lit("|"), F.lpad(c("seen.o3").cast("string"), 19, "0"))
    tl = types.select("project_id", tkey.alias("k"), F.explode(F.array(
        F.struct(F.lit("a").alias("s"), fmt("**%s** (%d occurrences)", c("type"), c("count")).alias("line")),
        F.struct(F.lit("b").alias("s"), F.concat(F.lit("- Tables: "), F.array_join("tables", ", ")).alias("line")),
        F.struct(F.lit("c").alias("s"), F.concat(F.lit("- Oracle Mapping Complexity: **"), c("complexity"),
                                                 F.lit("**")).alias("line")),
        F.struct(F.lit("d").alias("s"), F.concat(F.lit("- Suggested Oracle Type: `"), c("oracle_type"),
                                                 F.lit("`")).alias("line")))).alias("x"))
    parts.append(_rows(tl, doc, 60, F.concat(c("k"), F.lit("|"), c("x.s")), c("x.line")))
    parts.append(_rows(extensions, doc, 70, F.concat(F.lit("1|"), c("path"), F.lit("|"),
                                                    F.lpad(c("ord").cast("string"), 19, "0")),
                       F.concat(F.lit("- **"), c("extension"), F.lit("** - Requires Oracle equivalent or custom implementation"))))
    parts.append(_or_note(extensions, p, doc, 70, "No PostgreSQL extensions detected."))
    parts.append(_rows(indexes, doc, 80, F.concat(F.lit("1|"), c("path"), F.lit("|"),
                                                 F.lpad(c("first_ord").cast("string"), 19, "0")),
                       fmt("- **%s** (%d indexes) - Oracle Support: %s", c("type"), c("count"),
                           F.when(c("oracle_support"), "Yes").otherwise("No - Requires redesign"))))
    parts.append(_per_project(p, doc, 90, [fmt("**Total Native Queries:** %d", F.coalesce(c("native_queries"), F.lit(0)))]))
    ch = scores.select("project_id", F.posexplode(_challenge_lines()).alias("i", "line"))
    parts.append(_rows(ch, doc, 95, F.concat(F.lit("1|"), F.lpad(c("i").cast("string"), 19, "0")), c("line")))
    no = F.row_number().over(Window.partitionBy("project_id").orderBy("id")) - 1
    rl = risks.withColumn("no", no).select("project_id", "id", F.posexplode(F.array(
        fmt("### Risk %d: %s - %s", c("no"), c("id"), c("category")), F.concat(F.lit("**Severity:** "), c("severity")),
        F.concat(F.lit("**Description:** "), c("description")), F.concat(F.lit("**Impact:** "), c("impact")),
        F.concat(F.lit("**Mitigation Strategy:** "), c("mitigation")))).alias("i", "line"))
    parts.append(_rows(rl, doc, 100, F.concat(F.lit("1|"), c("id"), F.lit("|"), c("i").cast("string")), c("line")))
    parts.append(_rows(recs, doc, 110, F.concat(F.lit("1|"), F.lpad(c("rule_no").cast("string"), 19, "0")),
                       fmt("- **%s** (%s): %s - %s", c("dimension"), c("severity"), c("issue"), c("mitigation"))))
    return reduce(DataFrame.unionByName, parts)


# Advice by ORM framework, extension and index method (strategy
# and design documents).
ORM_ADVICE = {
    "Spring Data JPA": ["**Spring Data JPA Strategy:**", "- Update `@Query` annotations with Oracle SQL",
                        "- Test all custom queries", "- Verify JPA entity mappings work with Oracle",
                        "- No changes to repository method signatures"],
    "MyBatis": ["**MyBatis Strategy:**", "- Update all XML mapper files", "- Replace PostgreSQL-specific SQL syntax",
                "- Test all select/insert/update/delete statements", "- No changes to mapper interface methods"],
    "Hibernate": ["**Hibernate Strategy:**", "- Update Hibernate dialect configuration",
                  "- Test all HQL and Criteria queries", "- Verify entity mappings",
                  "- No changes to DAO/Repository classes"],
}
EXTENSION_ADVICE = {
    "uuid-ossp": ["- Use Oracle `SYS_GUID()` function", "- Or install Oracle UUID package"],
    "pg_trgm": ["- Use Oracle Text for full-text search", "- Configure CONTEXT indexes"],
    "PostGIS": ["- Use Oracle Spatial and Graph", "- Migrate geometry data to SDO_GEOMETRY"],
    "hstore": ["- Redesign as key-value table", "- Or use Oracle JSON_TABLE"],
}
EXTENSION_ADVICE_OTHER = ["- Custom research required for this extension"]


# Use case and replacement of the index methods without a direct counterpart, and the
# entity impact of a type by its complexity.
INDEX_ADVICE = {
    "GIN": ["**Use Case:** Full-text search or array indexing", "-- Option 1: Oracle Text Index",
            "CREATE INDEX idx_name ON table_name(column_name) INDEXTYPE IS CTXSYS.CONTEXT;", "-- Option 2: Function-based index",
            "CREATE INDEX idx_name ON table_name(UPPER(column_name));"],
    "GIST": ["**Use Case:** Geometric/spatial data", "-- Oracle Spatial Index",
             "CREATE INDEX idx_name ON table_name(geometry_column) INDEXTYPE IS MDSYS.SPATIAL_INDEX;"],
    "BRIN": ["**Use Case:** Very large tables with correlation between physical and logical order", "-- Use partitioning with local indexes",
             "ALTER TABLE table_name PARTITION BY RANGE (date_column)", "-- Create local index",
             "CREATE INDEX idx_name ON table_name(column_name) LOCAL;"],
}
ENTITY_IMPACT = ("⚠️ **Entity Annotation Update Required**", "✓ **No Entity Change Required** - Automatic type mapping works")


def pg_design_rows(spark, scores: DataFrame, orm: DataFrame, types: DataFrame, extensions: DataFrame,
                   indexes: DataFrame) -> DataFrame:
    """Type actions, index support, ORM- and extension-specific advice
    (broadcast joins to fixed advice tables) and the tool / rollout choice."""
    doc = "pg-migration-strategy"
    tkey = F.concat(F.lit("1|"), c("path"), F.lit("|"), F.lpad(c("seen.o2").cast("string"), 19, "0"), F.lit("|"),
                    c("seen.o1").cast("string"), F.lit("|"), F.lpad(c("seen.o3").cast("string"), 19, "0"))
    ty = types.select("project_id", tkey.alias("k"), F.explode(F.array(
        F.struct(F.lit("a").alias("s"), fmt("**%s** → **%s**", c("type"), c("oracle_type")).alias("line")),
        F.struct(F.lit("b").alias("s"), F.concat(F.lit("- Complexity: "), c("complexity")).alias("line")),
        F.struct(F.lit("c").alias("s"), F.concat(F.lit("- Affected Tables: "), F.array_join("tables", ", ")).alias("line")),
        F.struct(F.lit("d").alias("s"), F.concat(F.lit("- Required Actions: "),
                                                 F.when(c("complexity") == "Complex", "Custom conversion logic required")
                                                 .otherwise("Direct mapping")).alias("line")),
        F.struct(F.lit("e").alias("s"), F.when(c("complexity") == "Complex", ENTITY_IMPACT[0]).otherwise(ENTITY_IMPACT[1]).alias("line")))).alias("x"))
    ix_adv = spark.createDataFrame([(k, i, t) for k, ls in INDEX_ADVICE.items() for i, t in enumerate(ls)], "type string, i int, line string")
    ia = indexes.join(F.broadcast(ix_adv), "type")
    parts = [_rows(ia, doc, 21, F.concat(F.lit("1|"), c("path"), F.lit("|"), F.lpad(c("first_ord").cast("string"), 19, "0"), F.lit("|"), c("i").cast("string")), c("line")),
             _rows(ty, doc, 10, F.concat(c("k"), F.lit("|"), c("x.s")), c("x.line")),
             _rows(indexes, doc, 20, F.concat(F.lit("1|"), c("path"), F.lit("|"), F.lpad(c("first_ord").cast("string"), 19, "0")),
                   fmt("- **%s** (%d indexes) - Oracle Support: %s", c("type"), c("count"),
                       F.when(c("oracle_support"), "Native").otherwise("Alternative approach needed")))]
    orm_adv = spark.createDataFrame([(k, i, t) for k, ls in ORM_ADVICE.items() for i, t in enumerate(ls)],
                                    "orm_framework string, i int, line string")
    oa = orm.join(F.broadcast(orm_adv), "orm_framework")
    parts.append(_rows(oa, doc, 30, F.lpad(c("i").cast("string"), 19, "0"), c("line")))
    ext_adv = spark.createDataFrame([(k, i, t) for k, ls in EXTENSION_ADVICE.items() for i, t in enumerate(ls)],
                                    "extension string, i int, line string")
    ex = extensions.join(F.broadcast(ext_adv), "extension", "left")
    other = F.array(*[F.lit(t) for t in EXTENSION_ADVICE_OTHER])
    exl = ex.groupBy("project_id", "path", "ord", "extension").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda s: s["line"]).alias("adv"))
    exl = exl.withColumn("adv", F.when(F.size(F.filter("adv", lambda x: x.isNotNull())) > 0, c("adv")).otherwise(other))
    exr = exl.select("project_id", "path", "ord", F.posexplode(F.concat(
        F.array(F.concat(F.lit("### Extension: "), c("extension")), F.lit("**Oracle Equivalent:**")), c("adv"))).alias("j", "line"))
    parts.append(_rows(exr, doc, 40, F.concat(F.lit("1|"), c("path"), F.lit("|"), F.lpad(c("ord").cast("string"), 19, "0"),
                                              F.lit("|"), F.lpad(c("j").cast("string"), 19, "0")), c("line")))
    parts.append(_per_project(scores, doc, 50, [
        F.when(c("volume_score") > 60, "**Primary: AWS Database Migration Service (DMS)**")
        .otherwise("**Primary: Oracle SQL Developer + Ora2Pg**"),
        fmt("**Recommended:** Based on complexity score %d/100", c("overall")),
        F.when(c("overall") > 70, "**Recommended: Phased Migration**").otherwise("**Recommended: Big Bang Cutover**")]))
    return reduce(DataFrame.unionByName, parts)


def expected_objects(database: DataFrame) -> DataFrame:
    """Expected object counts of the schema tests."""
    return database.select(
        "project_id",
        fmt("%d tables created", c("tables")).alias("ddl_001"),
        fmt("%d sequences + new SERIAL sequences", c("sequences")).alias("ddl_007"),
        fmt("%d views work correctly", c("views")).alias("ddl_010"),
        c("functions").alias("functions_to_test"), c("stored_procedures").alias("procedures_to_test"))


# The migration types whose tiles are about a database.
DATABASE_FAMILIES = ["PostgreSQL-to-Oracle", "Oracle-to-PostgreSQL", "MySQL-to-Oracle"]


def dashboard_tiles(ctx: DataFrame, database: DataFrame, totals: DataFrame, scores: DataFrame,
                    corrected: bool = False) -> DataFrame:
    """The four dashboard tiles.  Database projects show tables first and procedures plus
    functions third, all others files first and tables third.  The third tile of a
    database project reads ``database.procedures``, a field never written, so it shows
    functions only (``corrected`` adds stored procedures)."""
    j = ctx.select("project_id", "migration_type").join(database, "project_id", "left") \
        .join(totals, "project_id", "left").join(scores.select("project_id", "difficulty"), "project_id", "left") \
        .fillna(0)
    is_db = c("migration_type").isin(DATABASE_FAMILIES)
    procs = (c("stored_procedures") + c("functions")) if corrected else c("functions")
    return j.select("project_id",
                    F.when(is_db, c("tables")).otherwise(c("total_files")).cast("long").alias("tile_files_or_tables"),
                    c("total_loc").cast("long").alias("tile_loc"),
                    F.when(is_db, procs).otherwise(c("tables")).cast("long").alias("tile_programs"),
                    F.coalesce(c("difficulty"), F.lit("Unknown")).alias("tile_difficulty"))


def write_reports(rows: DataFrame, path: str) -> None:
    """One folder per (project, document) with its lines in order over part files in order
    (a document of any length spreads over tasks), overwritten on regenerate (dynamic
    partition overwrite touches only the written documents)."""
    spark = rows.sparkSession
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    order = ["project_id", "doc", "section", "sub", "line"]
    (rows.repartitionByRange(*order).sortWithinPartitions(*order)
     .select("project_id", "doc", F.col("line").alias("value"))
     .write.mode("overwrite").partitionBy("project_id", "doc").text(path))


def write_metadata(metadata: DataFrame, path: str) -> None:
    """Nested metadata per project as parquet plus a JSON view."""
    metadata.write.mode("overwrite").parquet(path + "/parquet")
    metadata.select("project_id", F.to_json(F.struct(*[c(x) for x in metadata.columns if x != "project_id"]))
                    .alias("json")).write.mode("overwrite").json(path + "/json")


def document_list(rows: DataFrame) -> DataFrame:
    """The list of generated documents, with their lines and sections."""
    return rows.groupBy("project_id", "doc").agg(F.count(F.lit(1)).alias("lines"), F.countDistinct("section").alias("sections"))
