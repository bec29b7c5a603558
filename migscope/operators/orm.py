"""ORM configuration mining (MyBatis mappers, JPA orm.xml, Hibernate mappings;
YAML and anything else is Unknown).  Extraction is ``regexp_extract_all`` per
match: one generator step per file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from migscope.functions.text import basename, guarded_rlike, js_trim

c = F.col
KEYS = ["project_id", "path"]

# Tags and patterns of the configuration rules.
MYBATIS_TAGS = ["select", "insert", "update", "delete"]
RE_JPA_NAMED = (r"(?i)<named-query[^>]*name=[\"']([^\"']+)[\"'][^>]*>\s*<query>\s*<!\[CDATA\[([\s\S]*?)\]\]>\s*</query>"
                r"|<named-query[^>]*name=[\"']([^\"']+)[\"'][^>]*>\s*<query>([^<]+)</query>")
RE_HIBERNATE = (r"(?i)<sql-query[^>]*name=[\"']([^\"']+)[\"'][^>]*>\s*<!\[CDATA\[([\s\S]*?)\]\]>"
                r"|<query[^>]*name=[\"']([^\"']+)[\"'][^>]*>\s*<!\[CDATA\[([\s\S]*?)\]\]>")
RE_RESULT_MAP = r"(?i)<resultMap[^>]*>"
RE_DYNAMIC = r"(?i)<if\s|<choose\s|<when\s|<foreach\s|<where\s|<set\s"
RE_TYPE_HANDLER = r"(?i)typeHandler=[\"']([^\"']+)[\"']"

# SQL feature rules of the ORM scan.
SYNTAX_RULES = [("LIMIT", "LIMIT clause", r"(?i)\bLIMIT\s+\d+"), ("OFFSET", "OFFSET clause", r"(?i)\bOFFSET\s+\d+"),
                ("RETURNING", "RETURNING clause", r"(?i)\bRETURNING\b"),
                ("ON CONFLICT", "ON CONFLICT (upsert)", r"(?i)\bON\s+CONFLICT\b"),
                ("ILIKE", "ILIKE operator", r"(?i)\bILIKE\b"), ("DISTINCT ON", "DISTINCT ON", r"(?i)\bDISTINCT\s+ON\b")]
FUNCTION_NAMES = ["array_agg", "string_agg", "generate_series", "unnest", "jsonb_", "json_", "array_to_string",
                  "regexp_matches", "regexp_replace", "GREATEST", "LEAST"]
TYPE_NAMES = ["SERIAL", "BIGSERIAL", "SMALLSERIAL", "UUID", "JSONB", "JSON", "ARRAY", "BOOLEAN"]
OPERATOR_RULES = [("@>", "@> (contains) operator", r"@>"), ("<@", "<@ (contained by) operator", r"<@"),
                  ("->", "-> (JSON field) operator", r"->"), ("->>", "->> (JSON text) operator", r"->>")]
# XML entity cleanup in the order it is applied.
ENTITY_REPLACEMENTS = [("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("&quot;", '"'), ("&apos;", "'"),
                       ("<![CDATA[", ""), ("]]>", "")]


def orm_kind(content: Column, path: Column) -> Column:
    """O1"""
    xml = F.lower(F.regexp_extract(basename(path), r"(\.[^.]*)$", 1)) == ".xml"
    return (F.when(xml & (content.contains("<!DOCTYPE mapper") | content.contains("<mapper")), "MyBatis")
            .when(xml & (content.contains("<persistence") | content.contains("<entity-mappings")), "JPA")
            .when(xml & (content.contains("<!DOCTYPE hibernate-mapping") | content.contains("<hibernate-mapping")),
                  "Hibernate")
            .otherwise("Unknown"))


def clean_sql(x: Column) -> Column:
    """O8"""
    for a, b in ENTITY_REPLACEMENTS:
        x = F.replace(x, F.lit(a), F.lit(b))
    return js_trim(x)


def _nonnull(items: list[Column]) -> Column:
    return F.filter(F.array(*items), lambda v: v.isNotNull())


def sql_features(sql: Column, U: Column) -> dict[str, Column]:
    """Ordered features plus the function, type and syntax sub-lists (``U``: the text in upper
    case; an expression runs only where its literal is)."""
    syn = [(s, f, guarded_rlike(sql, U, p, [s.split()[-1] if s != "DISTINCT ON" else "DISTINCT"])) for s, f, p in SYNTAX_RULES]
    fun = [(n, f"{n}() function", guarded_rlike(sql, U, rf"(?i)\b{n}", [n])) for n in FUNCTION_NAMES]
    typ = [(t, f"{t} data type", guarded_rlike(sql, U, rf"(?i)\b{t}\b", [t])) for t in TYPE_NAMES]
    ops = [(s, f, sql.contains(p)) for s, f, p in OPERATOR_RULES]
    return dict(
        features=_nonnull([F.when(h, F.lit(f)) for _, f, h in syn + fun + typ + ops]),
        functions=_nonnull([F.when(h, F.lit(n)) for n, _, h in fun]),
        data_types=_nonnull([F.when(h, F.lit(n)) for n, _, h in typ]),
        syntax=_nonnull([F.when(h, F.lit(n)) for n, _, h in syn + ops]))


def _statements(content: Column, kind: Column) -> Column:
    """The statements of a file (MyBatis: tag order, then text order) as array of structs."""
    def found(pattern: str, tag: str, tag_ord: int, ids: list[int], raws: list[int]) -> Column:
        group = lambda m, gs: F.regexp_extract(m, pattern, gs[0]) if len(gs) == 1 else F.when(
            F.regexp_extract(m, pattern, gs[0]) != "", F.regexp_extract(m, pattern, gs[0])).otherwise(F.regexp_extract(m, pattern, gs[1]))
        return F.transform(F.regexp_extract_all(content, F.lit(pattern), 0), lambda m, i: F.struct(
            F.lit(tag_ord).alias("tag_ord"), i.cast("long").alias("ord"), group(m, ids).alias("id"), group(m, raws).alias("raw"), F.lit(tag).alias("type")))
    mybatis = [found(rf"(?i)<{tag}[^>]*id=[\"']([^\"']+)[\"'][^>]*>([\s\S]*?)</{tag}>", tag, i, [1], [2]) for i, tag in enumerate(MYBATIS_TAGS)]
    return F.when(kind == "MyBatis", F.concat(*mybatis)).when(kind == "JPA", found(RE_JPA_NAMED, "select", 0, [1, 3], [2, 4])) \
        .when(kind == "Hibernate", found(RE_HIBERNATE, "select", 0, [1, 3], [2, 4]))


def orm_queries(src_files: DataFrame) -> DataFrame:
    """One row per extracted statement (MyBatis: tag order, then text order)."""
    f = src_files.select(*KEYS, "content", orm_kind(c("content"), c("path")).alias("kind"))
    # an outer generator: for an inner one Catalyst tests the array's size, and so mines, below the spread of the keys
    q = f.select(*KEYS, "kind", F.explode_outer(_statements(c("content"), c("kind"))).alias("q")).where("q is not null").select(*KEYS, "kind", "q.*")
    q = q.select(*KEYS, "kind", "tag_ord", "ord", "id", "type", clean_sql(c("raw")).alias("sql"))
    feats = sql_features(c("sql"), c("U"))
    return q.withColumn("U", F.upper("sql")).select(*KEYS, "kind", "tag_ord", "ord", "id", "type", "sql",
                                                    *[v.alias(k) for k, v in feats.items()]) \
        .withColumn("has_pg_features", F.size("features") > 0)


def orm_files(src_files: DataFrame) -> DataFrame:
    """One row per configuration file."""
    f = src_files.select(*KEYS, "content", orm_kind(c("content"), c("path")).alias("kind"))
    my = c("kind") == "MyBatis"
    base = f.select(
        *KEYS, "content", basename("path").alias("file_name"), "kind",
        F.when(my, F.regexp_count("content", F.lit(RE_RESULT_MAP))).otherwise(0).cast("long").alias("result_maps"),
        F.when(my, F.regexp_count("content", F.lit(RE_DYNAMIC))).otherwise(0).cast("long").alias("dynamic_sql"),
        F.when(my, F.array_distinct(F.regexp_extract_all("content", F.lit(RE_TYPE_HANDLER), 1)))
        .otherwise(F.array().cast("array<string>")).alias("type_handlers"))
    # The distinct labels over the file's statements, first-seen order; a file is mined once, without a shuffle.
    texts = F.transform(_statements(c("content"), c("kind")), lambda s: clean_sql(s["raw"]))
    parts = ("functions", "data_types", "syntax")

    def labels(s: Column) -> Column:
        feats = sql_features(s["sql"], s["U"])
        return F.struct(*[feats[x].alias(x) for x in parts])
    out = base.select("*", texts.alias("texts"))
    out = out.select("*", F.coalesce(F.size("texts"), F.lit(0)).cast("long").alias("native_queries"),
                     F.transform(F.transform("texts", lambda x: F.struct(x.alias("sql"), F.upper(x).alias("U"))), labels).alias("labels"))
    empty = F.array().cast("array<string>")
    union = lambda x: F.coalesce(F.array_distinct(F.flatten(F.transform("labels", lambda s: s[x]))), empty).alias(x)
    return out.select(*[x for x in base.columns if x != "content"], "native_queries", *[union(x) for x in parts])
