"""Project roll-ups of the COBOL assessment (inventory, distribution,
dependencies, top-k, database block, risks, summary)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

c = F.col


def totals(files: DataFrame) -> DataFrame:
    """M1: total files and LOC per project."""
    return files.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("total_files"), F.sum("loc").cast("long").alias("total_loc"))


def priority(complexity: Column, loc: Column) -> Column:
    return (F.when((complexity > 30) | (loc > 1000), "High")
            .when((complexity > 15) | (loc > 500), "Medium").otherwise("Low"))


def program_inventory(files: DataFrame) -> DataFrame:
    """M2: program rows with priority."""
    return files.select("project_id", "path", "name", "type", "loc", "complexity",
                        priority(c("complexity"), c("loc")).alias("priority"))


def type_distribution(files: DataFrame, type_col: str = "type") -> DataFrame:
    """M3: count and rounded percentage of the project's files per type.  The
    per-project total is a window over the already aggregated (project, type) rows."""
    g = files.groupBy("project_id", type_col).agg(F.count(F.lit(1)).alias("count"))
    tot = F.sum("count").over(Window.partitionBy("project_id"))
    return g.select("project_id", c(type_col).alias("type"), "count",
                    F.floor(c("count").cast("double") / tot * 100 + 0.5).cast("long").alias("percentage"))


def portfolio_rollup(files: DataFrame, type_col: str = "type") -> DataFrame:
    """M3 over the portfolio: files and LOC per (project, type), per project and in all, by one
    ROLLUP (one partially aggregated shuffle).  ``grouping`` is the grouping id: 0 a type of a project, 1 a
    project, 3 the portfolio; ``percentage`` is the part of the enclosing group's files, which stands in
    the result itself."""
    from migscope.session import materialize
    r = materialize(files.rollup("project_id", type_col).agg(
        F.count(F.lit(1)).alias("count"), F.sum("loc").cast("long").alias("loc"), F.grouping_id().cast("long").alias("grouping")))
    project = F.concat(F.lit("p"), F.coalesce("project_id", F.lit("")))
    own = r.select("project_id", c(type_col).alias("type"), "count", "loc", "grouping", F.when(c("grouping") == 0, project).when(c("grouping") == 1, "all").alias("within"))
    whole = r.where("grouping > 0").select(F.when(c("grouping") == 1, project).otherwise("all").alias("group"), c("count").alias("whole"))
    return own.join(whole, c("within") == c("group"), "left").select(
        "project_id", "type", "count", "loc", "grouping",
        F.floor(c("count").cast("double") / F.coalesce("whole", "count") * 100 + 0.5).cast("long").alias("percentage"))


def dependency_list(files: DataFrame, dep_lists: DataFrame) -> DataFrame:
    """M4: programs with dependencies and their targets joined with ', '."""
    return files.select("project_id", "path", "name").join(dep_lists, ["project_id", "path"]) \
        .where(F.size("dependencies") > 0) \
        .select("project_id", "path", c("name").alias("source"),
                F.array_join("dependencies", ", ").alias("targets"))


def high_complexity_top10(files: DataFrame, k: int = 10) -> DataFrame:
    """M5: complexity > 20, highest first (ties in path order), first k per project.
    ``row_number <= k`` is planned as a WindowGroupLimit, so each task keeps only
    its local top k before the exchange."""
    w = Window.partitionBy("project_id").orderBy(c("complexity").desc(), c("path"))
    top = files.where(c("complexity") > 20).withColumn("rank", F.row_number().over(w)).where(c("rank") <= k)
    hi = c("complexity") > 40
    return top.select(
        "project_id", c("rank").cast("long").alias("rank"), "path", "name",
        c("complexity").alias("score"),
        F.when(hi, "High").otherwise("Medium").alias("risk"),
        F.when(hi, "Consider breaking into smaller modules during migration")
        .otherwise("Review and simplify logic where possible").alias("recommendation"))


def database_block(projects: DataFrame, ddl_totals: DataFrame | None) -> DataFrame:
    """M6: database counts per project, zeros when the project has no DDL."""
    cols = ["tables", "views", "stored_procedures", "indexes", "triggers", "functions"]
    p = projects.select("project_id")
    if ddl_totals is None:
        return p.select("project_id", *[F.lit(0).cast("long").alias(x) for x in cols])
    j = p.join(ddl_totals, "project_id", "left")
    return j.select("project_id", *[F.coalesce(c(x), F.lit(0)).cast("long").alias(x) for x in cols])


# COBOL project risk rules (id, category, severity when not computed,
# impact, mitigation).
COBOL_RISKS = {
    "R-001": ("Migration Complexity", None,
              "May lead to longer migration timeline, higher defect rate, and increased resource requirements",
              "Allocate experienced developers, plan for refactoring, increase code review frequency, consider phased migration"),
    "R-002": ("Logic Complexity", "High",
              "Complex control flow increases risk of logic errors during migration",
              "Comprehensive unit testing, code refactoring to simplify logic, peer review of critical sections"),
    "R-003": ("Data Complexity", "High",
              "Complex data structures and database operations require careful mapping",
              "Create detailed data mapping documents, implement data validation tests, use ORM frameworks"),
    "R-004": ("COBOL-specific Risk", "Critical",
              "Legacy COBOL features may not have direct Java equivalents, requiring custom solutions",
              "Research migration patterns for specific features, develop custom libraries, plan for redesign where necessary"),
    "R-005": ("Scale", "Medium", "Extended timeline, higher resource requirements",
              "Use phased migration approach, consider automated conversion tools"),
    "R-006": ("Dependencies", "Medium", "Complex integration testing, potential circular dependencies",
              "Map dependencies early, identify and break circular references"),
}


def risk_list() -> Column:
    """M7: the risks R-001..R-006 of a project row (scores, details, total_loc, total_deps) as array of
    structs; a rule that does not hold is not in it."""
    fmt = F.format_string

    def risk(rid: str, cond: Column, desc: Column, sev: Column | None = None) -> Column:
        cat, s, impact, mitigation = COBOL_RISKS[rid]
        return F.when(cond, F.struct(
            F.lit(rid).alias("id"), F.lit(cat).alias("category"), desc.alias("description"),
            (sev if sev is not None else F.lit(s)).alias("severity"),
            F.lit(impact).alias("impact"), F.lit(mitigation).alias("mitigation")))

    cands = F.array(
        risk("R-001", c("overall") >= 60,
             fmt("Migration difficulty score is %d/100 (%s)", c("overall"), c("difficulty")),
             F.when(c("overall") >= 80, "Critical").otherwise("High")),
        risk("R-002", c("logic_score") >= 60,
             F.concat(fmt("Logic complexity score: %d/100. ", c("logic_score")),
                      F.array_join("logic_details", "; "))),
        risk("R-003", c("data_score") >= 60,
             F.concat(fmt("Data complexity score: %d/100. ", c("data_score")),
                      F.array_join("data_details", "; "))),
        risk("R-004", c("risk_score") >= 60,
             F.concat(fmt("COBOL-specific risk score: %d/100. ", c("risk_score")),
                      F.array_join("risk_details", "; "))),
        risk("R-005", c("total_loc") > 100000,
             F.concat(F.lit("Large codebase with "), F.format_number(c("total_loc"), 0), F.lit(" lines of code"))),
        risk("R-006", c("total_deps") > 50,
             fmt("High number of inter-module dependencies (%d)", c("total_deps"))),
    )
    return F.filter(cands, lambda x: x.isNotNull())


def cobol_risks(scores: DataFrame, dep_counts: DataFrame) -> DataFrame:
    """M7: risk rows per project (``scores`` carries total_loc); a projection and an explode, no rule join."""
    j = scores.join(dep_counts, "project_id", "left").fillna(0, ["total_loc", "total_deps"])
    return j.select("project_id", F.explode(risk_list()).alias("r")).select("project_id", "r.*")


def complexity_summary(scores: DataFrame) -> DataFrame:
    """M8."""
    return scores.select("project_id", F.format_string(
        "%s difficulty (score: %d/100) - %s", c("difficulty"), c("overall"), c("description")).alias("summary"))


def complexity_stats(files: DataFrame) -> DataFrame:
    """Mean and max cyclomatic complexity per project."""
    return files.groupBy("project_id").agg(
        F.avg("complexity").alias("avg_complexity"), F.max("complexity").alias("max_complexity"))


def dependency_graph(edges: DataFrame, files: DataFrame) -> DataFrame:
    """One row per program node with out-degree (distinct targets) and
    in-degree (distinct callers inside the project), plus unresolved targets.
    Both degree counts are hash aggregates joined on (project, name)."""
    nodes = files.select("project_id", "name")
    e = edges.join(files.select("project_id", "path", c("name").alias("source")), ["project_id", "path"]) \
        .select("project_id", "source", "target").distinct()
    outd = e.groupBy("project_id", c("source").alias("name")).agg(F.count(F.lit(1)).alias("out_degree"))
    ind = e.groupBy("project_id", c("target").alias("name")).agg(F.count(F.lit(1)).alias("in_degree"))
    return nodes.join(outd, ["project_id", "name"], "left").join(ind, ["project_id", "name"], "left") \
        .select("project_id", "name",
                F.coalesce(c("out_degree"), F.lit(0)).cast("long").alias("out_degree"),
                F.coalesce(c("in_degree"), F.lit(0)).cast("long").alias("in_degree"))


def unresolved_targets(edges: DataFrame, files: DataFrame) -> DataFrame:
    """Dependency targets that are not a program of the same project (anti join)."""
    t = edges.select("project_id", "target").distinct()
    return t.join(files.select("project_id", c("name").alias("target")), ["project_id", "target"], "left_anti")
