"""Migration-difficulty scores (COBOL: 3 dimensions; PostgreSQL->Oracle: 6).

All scores are integers 0-100: cap each term, sum left to right in the rule's
order, round half up, cap 100.  Column arithmetic only (no UDF)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from migscope.functions.text import js_round

c = F.col


def _cap(x: Column, hi: float) -> Column:
    return F.least(x, F.lit(hi))


def _per100(num: str, loc: str = "loc") -> Column:
    return c(num).cast("double") / F.greatest(c(loc), F.lit(1)).cast("double") * F.lit(100.0)


def difficulty(overall: Column) -> Column:
    """K6 labels."""
    return (F.when(overall < 30, "Low").when(overall < 60, "Medium")
            .when(overall < 80, "High").otherwise("Very High"))


# Difficulty descriptions of the COBOL scorer by band.
COBOL_DESCRIPTIONS = [
    "Low migration difficulty - straightforward conversion expected with minimal refactoring",
    "Medium migration difficulty - moderate refactoring required, standard migration patterns applicable",
    "High migration difficulty - significant redesign needed, complex legacy patterns present",
    "Very high migration difficulty - extensive redesign required, critical COBOL-specific features in use",
]


def banded(overall: Column, texts: list[str]) -> Column:
    """K7: description text by the <30 / <60 / <80 bands."""
    return (F.when(overall < 30, texts[0]).when(overall < 60, texts[1])
            .when(overall < 80, texts[2]).otherwise(texts[3]))


def _details(rules: list[tuple[Column, Column]]) -> Column:
    return F.filter(F.array(*[F.when(cond, txt) for cond, txt in rules]), lambda x: x.isNotNull())


def cobol_file_scores(files: DataFrame) -> DataFrame:
    """K1-K4, K6-K8 for every program of ``cobol_files``."""
    depth = c("max_if_depth")
    logic_raw = (_cap(_per100("complexity") * 2, 40)
                 + F.when(depth > 5, 20).when(depth > 3, 10).when(depth > 2, 5).otherwise(0)
                 + _cap(c("goto") * 10, 30)
                 + _cap(c("evaluate") * 2, 10))
    data_raw = (_cap(c("copybook") * 5, 25)
                + _cap(_per100("sql") * 5, 30)
                + _cap(c("fileops") * 2, 20)
                + _cap(c("occurs") * 3, 15)
                + _cap(c("redefines") * 3, 10))
    risk_raw = (_cap(c("comp3") * 5, 25)
                + _cap(c("asm") * 20, 40)
                + _cap(c("pic") * 3, 15)
                + _cap(c("sort_merge") * 3, 10)
                + F.when(c("report_writer"), 10).otherwise(0))
    scored = files.select(
        "*",
        F.least(js_round(logic_raw), F.lit(100)).alias("logic_score"),
        F.least(js_round(data_raw), F.lit(100)).alias("data_score"),
        F.least(js_round(risk_raw), F.lit(100)).alias("risk_score"),
    )
    overall = js_round(c("logic_score") * 0.35 + c("data_score") * 0.35 + c("risk_score") * 0.30)
    fmt = F.format_string
    return scored.withColumn("overall", overall).select(
        "*",
        difficulty(c("overall")).alias("difficulty"),
        banded(c("overall"), COBOL_DESCRIPTIONS).alias("description"),
        _details([
            (c("complexity") > 20, fmt("High cyclomatic complexity (%d)", c("complexity"))),
            (depth > 3, fmt("Deep nesting detected (%d levels)", depth)),
            (c("goto") > 0, fmt("GOTO statements present (%d) - requires refactoring", c("goto"))),
            (c("evaluate") > 5, fmt("Multiple EVALUATE statements (%d)", c("evaluate"))),
        ]).alias("logic_details"),
        _details([
            (c("copybook") > 3, fmt("High COPYBOOK usage (%d) - data structure mapping needed", c("copybook"))),
            (c("sql") > 10, fmt("Embedded SQL detected (%d statements)", c("sql"))),
            (c("fileops") > 10, fmt("Multiple file operations (%d)", c("fileops"))),
            (c("occurs") > 2, fmt("Arrays/tables present (%d OCCURS clauses)", c("occurs"))),
            (c("redefines") > 2, fmt("Union types detected (%d REDEFINES)", c("redefines"))),
        ]).alias("data_details"),
        _details([
            (c("comp3") > 0, fmt("COMP-3/Packed decimal fields (%d) - custom conversion required", c("comp3"))),
            (c("asm") > 0, fmt("Assembly language calls detected (%d) - critical risk", c("asm"))),
            (c("pic") > 5, fmt("Complex PIC clauses (%d)", c("pic"))),
            (c("sort_merge") > 0, fmt("SORT/MERGE operations (%d)", c("sort_merge"))),
            (c("report_writer"), F.lit("Report Writer in use - requires complete redesign")),
        ]).alias("risk_details"),
    )


DETAIL_COLS = ["logic_details", "data_details", "risk_details"]


def cobol_project_scores(projects: DataFrame, file_scores: DataFrame, with_details: bool = True, with_types: bool = False) -> DataFrame:
    """K5 (+K9, M1): per project the rounded mean of each file dimension, then the
    weighted overall; files, total LOC and the distinct details in first-seen
    order (files by path).  Projects without programs score 0 / 'No files
    analyzed'.

    One pass over the file scores: every file emits one score row and one row per
    detail string; a first hash aggregate on (project, kind, category, detail) --
    partially aggregated before the exchange -- keeps each detail's first
    position, a second one per project sums and orders.  No group grows with the
    number of files beyond the distinct detail strings.  ``with_types`` adds, in the same pass, the
    files of each type (``types``: array of type and count) and the programs of complexity
    over 20 (``high``)."""
    none_i = F.lit(None).cast("long")

    def fact(kind, cat, detail, pos, l, d, r, loc):
        return F.struct(F.lit(kind).alias("kind"), F.lit(cat).cast("string").alias("cat"),
                        detail.cast("string").alias("detail"),
                        F.struct(c("path").alias("path"), pos.cast("int").alias("i")).alias("at"),
                        l.cast("long").alias("l"), d.cast("long").alias("d"), r.cast("long").alias("r"),
                        loc.cast("long").alias("loc"))
    items = [F.array(fact("score", None, F.lit(None), F.lit(0), c("logic_score"), c("data_score"), c("risk_score"),
                          c("loc")))]
    if with_types:
        items.append(F.array(fact("type", None, c("type"), F.lit(0), (c("complexity") > 20).cast("long"), none_i, none_i, none_i)))
    if with_details:
        def detail_rows(col):
            return F.transform(col, lambda x, i: fact("detail", col, x, i, none_i, none_i, none_i, none_i))
        for col in DETAIL_COLS:
            items.append(detail_rows(col))
    ex = file_scores.select("project_id", F.explode_outer(F.concat(*items)).alias("f")).select("project_id", "f.*")
    g = ex.groupBy("project_id", "kind", "cat", "detail").agg(
        F.count(F.lit(1)).alias("n"), F.min("at").alias("at"),
        F.sum("l").alias("l"), F.sum("d").alias("d"), F.sum("r").alias("r"), F.sum("loc").alias("loc"))
    k = c("kind")
    score = k == "score"
    mean = lambda x: js_round(F.sum(F.when(score, c(x))).cast("double") / F.sum(F.when(score, c("n"))))
    aggs = [F.sum(F.when(score, c("n"))).alias("files"), F.sum(F.when(score, c("loc"))).alias("total_loc"),
            mean("l").alias("logic_score"), mean("d").alias("data_score"), mean("r").alias("risk_score")]
    if with_details:
        for col in DETAIL_COLS:
            aggs.append(F.transform(F.array_sort(F.collect_list(F.when(c("cat") == col, F.struct(
                c("at").alias("at"), c("detail").alias("v"))))), lambda s: s["v"]).alias(col))
    if with_types:
        aggs.append(F.array_sort(F.collect_list(F.when(k == "type", F.struct(c("detail").alias("type"), c("n").alias("count"))))).alias("types"))
        aggs.append(F.sum(F.when(k == "type", c("l"))).alias("high"))
    agg = g.groupBy("project_id").agg(*aggs)
    p = projects.select("project_id").join(agg, "project_id", "left")
    overall = js_round(c("logic_score") * 0.35 + c("data_score") * 0.35 + c("risk_score") * 0.30)
    has = c("files").isNotNull()
    out = p.select(
        "project_id",
        F.coalesce(c("files"), F.lit(0)).alias("files"),
        F.coalesce(c("total_loc"), F.lit(0)).alias("total_loc"),
        F.coalesce(c("logic_score"), F.lit(0)).alias("logic_score"),
        F.coalesce(c("data_score"), F.lit(0)).alias("data_score"),
        F.coalesce(c("risk_score"), F.lit(0)).alias("risk_score"),
        F.when(has, overall).otherwise(F.lit(0)).alias("overall"),
        *[F.coalesce(c(x), F.array().cast("array<string>")).alias(x) for x in DETAIL_COLS if with_details],
        *([F.coalesce(c("types"), F.array().cast("array<struct<type:string,count:bigint>>")).alias("types"), F.coalesce("high", F.lit(0)).alias("high")] if with_types else []),
    )
    return out.withColumn("difficulty", difficulty(c("overall"))).withColumn(
        "description", F.when(c("files") > 0, banded(c("overall"), COBOL_DESCRIPTIONS))
        .otherwise(F.lit("No files analyzed")))
