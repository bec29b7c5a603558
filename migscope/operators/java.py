"""Java corpus scan: per-file facts (type, LOC, ORM framework, PostgreSQL
dependencies) and the native-query table.

Per-file facts are one projection over ``src_files(project_id, path, content)``.
LOC carries block-comment state across lines; it is evaluated inside the row
with the ``aggregate`` higher-order function over the file's lines (a fold with a
2-field struct state: no shuffle, no window, O(lines))."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from migscope.functions.text import JS_WS, basename, guarded_rlike, has_any, js_trim, literals_match, strip_suffix

c = F.col
KEYS = ["project_id", "path"]

# ORM framework detection in priority order (case-insensitive).
ORM_RULES = [
    ("Spring Data JPA", r"(?i)@Repository|@Entity|@Table|import org\.springframework\.data\.jpa"),
    ("MyBatis", r"(?i)@Mapper|import org\.apache\.ibatis|SqlSession"),
    ("Hibernate", r"(?i)SessionFactory|import org\.hibernate"),
    ("JDBC Template", r"(?i)JdbcTemplate|import org\.springframework\.jdbc\.core\.JdbcTemplate"),
    ("Plain JDBC", r"(?i)DriverManager\.getConnection|import java\.sql\.DriverManager"),
]
# Substrings every match of the rule above must contain (prefilter only).
# A search stops at each occurrence of its first character, so guards begin with a rare one.
ORM_LITERALS = [["@REPOSITORY", "@ENTITY", "@TABLE", "K.DATA.JPA"],
                ["@MAPPER", "BATIS", "QLSESSION"], ["FACTORY", "HIBERNATE"],
                ["JDBCTEMPLATE"], ["VERMANAGER"]]
# File type by annotation (first hit wins), then by name suffix.
TYPE_BY_ANNOTATION = [("Controller", r"(?i)@RestController|@Controller"), ("Service", r"(?i)@Service"),
                      ("Repository", r"(?i)@Repository"), ("Entity", r"(?i)@Entity"),
                      ("Mapper", r"(?i)@Mapper"), ("Config", r"(?i)@Configuration")]
TYPE_BY_SUFFIX = [("Controller", ["Controller"]), ("Service", ["Service"]), ("Repository", ["Repository"]),
                  ("Entity", ["Entity", "Model"]), ("Mapper", ["Mapper"]), ("Config", ["Config"])]
# Annotations and query patterns of the Java rules.
JPA_ANNOTATIONS = ["@Query", "@NamedQuery", "@NamedQueries", "@Modifying", "@Transactional", "@PersistenceContext"]
RE_ANNOTATION_QUERY = r'@Query\s*\(\s*value\s*=\s*"([^"]+)"|@Query\s*\(\s*"([^"]+)"'
RE_LITERAL_QUERY = r'(?i)"((?:SELECT|INSERT|UPDATE|DELETE|CREATE|ALTER|DROP)\s+[^"]{20,})"'
# Query features (label, pattern) in the order they are listed.
QUERY_FEATURES = [
    ("LIMIT/OFFSET", r"(?i)\bLIMIT\s+\d+|\bOFFSET\s+\d+"),
    ("RETURNING clause", r"(?i)\bRETURNING\b"),
    ("ON CONFLICT (upsert)", r"(?i)\bON\s+CONFLICT\b"),
    ("ILIKE", r"(?i)\bILIKE\b"),
    ("DISTINCT ON", r"(?i)\bDISTINCT\s+ON\b"),
    ("SELECT FOR UPDATE SKIP LOCKED", r"(?i)\bSELECT\s+FOR\s+UPDATE\s+SKIP\s+LOCKED\b"),
    ("BOOLEAN type", r"(?i)\bBOOLEAN\b|\b(?:WHERE|AND|OR)\s+\w+\s*=\s*(?:true|false)\b"),
    ("ARRAY syntax", r"(?i)\[|\]|ARRAY\["),
    ("JSON operators", r"->|->>"),
]
QUERY_FUNCTION_FAMILIES = ["array_agg", "string_agg", "generate_series", "unnest", "jsonb_", "json_"]
# PostgreSQL function patterns (pattern order, then text order).
PG_FUNCTION_PATTERNS = [r"\barray_agg\s*\(", r"\bstring_agg\s*\(", r"\bgenerate_series\s*\(", r"\bunnest\s*\(",
                        r"\bjsonb_\w+\s*\(", r"\bjson_\w+\s*\(", r"\barray_to_string\s*\(",
                        r"\bregexp_matches\s*\(", r"\bregexp_replace\s*\(", r"\bregexp_split_to_array\s*\(",
                        r"\bGREATEST\s*\(", r"\bLEAST\s*\("]
# What the names of one, two or three patterns in turn contain (prefilter only).
PG_FUNCTION_GROUPS = [("_AGG", 2), ("_SERIES", 1), ("UNNEST", 1), ("JSON", 2), ("_TO_STRING", 1), ("XP_", 3), ("GREATEST", 1), ("LEAST", 1)]
# PostgreSQL type words (MACCDDR as spelled by the rules).
PG_TYPE_WORDS = ["SERIAL", "BIGSERIAL", "SMALLSERIAL", "UUID", "JSONB", "JSON", "ARRAY", "HSTORE", "BOOLEAN",
                 "INET", "MACCDDR", "CITEXT", "TSQUERY", "TSVECTOR"]
PG_OPERATORS = [("@> (contains)", r"@>"), ("<@ (contained by)", r"<@"), ("-> (JSON field)", r"->"),
                ("->> (JSON text)", r"->>"), ("@@ (full-text search)", r"@@"), ("~ (regex match)", r"\s~\s"),
                ("~* (regex case-insensitive)", r"~\*"), ("|| (concatenation/array append)", r"\|\|")]
SCHEMA_CODE = [("pg_catalog references", r"(?i)pg_catalog"),
               ("information_schema references", r"(?i)information_schema"),
               ("pg_stat views", r"(?i)pg_stat"),
               ("PostgreSQL system tables", r"(?i)pg_class|pg_namespace|pg_attribute")]
EXTENSION_USAGE = [("PostGIS", r"(?i)PostGIS|ST_\w+|geography|geometry"),
                   ("pg_trgm", r"(?i)pg_trgm|similarity\s*\("),
                   ("uuid-ossp", r"(?i)uuid_generate|uuid-ossp"),
                   ("hstore", r"(?i)hstore"), ("ltree", r"(?i)ltree")]
RE_JDBC = r"DriverManager\.getConnection|Connection\s+conn"
RE_FUNCTION_FAMILY = "(?i)" + "|".join(QUERY_FUNCTION_FAMILIES)
# RE_ANNOTATION_QUERY with one group for the text of both forms.
RE_ANNOTATION_TEXT = r'@Query\s*\(\s*(?:value\s*=\s*)?"([^"]+)"'
# Substrings one of which every match of a feature contains (prefilter only).
FEATURE_LITERALS = [["LIMIT", "OFFSET"], ["RETURNING"], ["CONFLICT"], ["ILIKE"], ["DISTINCT"], ["LOCKED"], ["BOOLEAN", "TRUE", "FALSE"], ["[", "]"], ["->"]]
#: Features that a search decides: each match is one of the literals, in any case, or holds one that has none.
LITERAL_FEATURES = {"ARRAY syntax": ["[", "]"], "JSON operators": ["->"]}


#: A pattern of signs without meaning in an expression, or escaped.
SIGNS = re.compile(r"(?:[@<>~-]|\\[^\w\s])+")


def flags(text: Column, rules: list[tuple[str, str]], upper_text: Column | None = None,
          literals: list[list[str]] | None = None) -> Column:
    """Labels whose pattern matches, in rule order (regex guarded by literals; a pattern of signs alone that is its
    literal needs no regex)."""
    items = []
    for k, (lbl, p) in enumerate(rules):
        if literals is None:
            cond = text.rlike(p)
        elif SIGNS.fullmatch(p) and literals[k] == [re.sub(r"\\(.)", r"\1", p)]:
            cond = text.contains(literals[k][0])
        else:
            cond = guarded_rlike(text, upper_text, p, literals[k])
        items.append(F.when(cond, F.lit(lbl)))
    return F.filter(F.array(*items), lambda x: x.isNotNull())


# A line counts when, after JS whitespace, it has a character, does not start
# with // and contains no */ (the rule for files without any /*).  (?d): only \n
# ends a line, as in split('\n').
# Blanks and printable ASCII are tried before the long classes.
_WS_NO_NL = "".join(ch for ch in JS_WS if ch != "\n")
_WS_CLASS = "[" + "".join(f"\\u{ord(ch):04X}" for ch in _WS_NO_NL) + "]"
_WS_NEG = "[^\\n" + "".join(f"\\u{ord(ch):04X}" for ch in _WS_NO_NL) + "]"
_CODE = "[ \\t]*+(?!//)(?:[!-~]|" + _WS_CLASS + "*+(?!//)" + _WS_NEG + ")"
RE_CODE_LINE = "(?md)^(?![^\\n]*\\*/)" + _CODE
# The same for a text without any */.
RE_OPEN_LINE = "(?md)^" + _CODE


def java_loc(content: Column) -> Column:
    """J2.  Files without '/*' never enter a block comment: their LOC is one regex
    count.  Otherwise a left fold over the lines with state (in_block, count)."""
    return F.when(content.contains("/*"), _java_loc_fold(content)).when(
        content.contains("*/"), F.regexp_count(content, F.lit(RE_CODE_LINE))).otherwise(F.regexp_count(content, F.lit(RE_OPEN_LINE)))


def _java_loc_fold(content: Column) -> Column:
    """J2 as a left fold over the lines, trimmed once each and as far as the tests look: the state is twice the
    count, plus one inside a block comment."""
    def step(acc, t):
        inside = acc % 2
        return (F.when(t.contains("*/"), acc - inside).when(t.contains("/*"), acc - inside + 1)
                .when((inside == 1) | (t == "") | t.startswith("//"), acc).otherwise(acc + 2))
    lines = F.transform(F.split(content, "\n"), lambda x: F.ltrim(F.ltrim(x), F.lit(JS_WS)))
    return F.aggregate(lines, F.lit(0), step, lambda acc: F.shiftright(acc, 1))


def orm_framework(content: Column, U: Column | None = None) -> Column:
    U = F.upper(content) if U is None else U
    e = None
    for (lbl, p), lits in zip(ORM_RULES, ORM_LITERALS):
        cond = has_any(U, lits) & literals_match(content, U, p)
        e = F.when(cond, lbl) if e is None else e.when(cond, lbl)
    return e.otherwise("None")


def file_type(content: Column, name: Column, U: Column | None = None) -> Column:
    U = F.upper(content) if U is None else U
    e = None
    for lbl, p in TYPE_BY_ANNOTATION:
        lits = [x.strip("(?i)") for x in p.replace("(?i)", "").split("|")]
        cond = guarded_rlike(content, U, p, lits)
        e = F.when(cond, lbl) if e is None else e.when(cond, lbl)
    for lbl, sufs in TYPE_BY_SUFFIX:
        cond = None
        for s in sufs:
            cond = name.endswith(s) if cond is None else cond | name.endswith(s)
        e = e.when(cond, lbl)
    return e.otherwise("Other")


def _fn_literal(p: str) -> str:
    return p.replace("\\b", "").split("\\")[0].upper()


def at_word(word: str) -> str:
    """``word`` at a word's begin.  The same matches as of ``\\b`` before it, but the literal is tried first: a
    boundary costs several times as much at each position."""
    return rf"(?i){word}(?<=\b{word})"


def pg_functions_used(content: Column, U: Column | None = None) -> Column:
    """Distinct function names by exact spelling, pattern order then text order.
    Each pattern runs only on files containing its literal name, which is looked for where that of its group is."""
    U = F.upper(content) if U is None else U
    empty = F.array().cast("array<string>")

    def found(p: str) -> Column:
        word = _fn_literal(p)
        return F.when(U.contains(word), F.regexp_extract_all(content, F.lit(at_word(word) + p[2 + len(word):]), 0)).otherwise(empty)
    groups, at = [], 0
    for guard, n in PG_FUNCTION_GROUPS:
        own = [found(p) for p in PG_FUNCTION_PATTERNS[at:at + n]]
        groups.append(F.when(U.contains(guard), own[0] if n == 1 else F.flatten(F.array(*own))).otherwise(empty))
        at += n
    allm = F.flatten(F.array(*groups))
    return F.array_distinct(F.transform(allm, lambda m: js_trim(F.regexp_replace(m, r"\s*\(", ""))))


def _group(match: Column, pattern: str, groups: list[int]) -> Column:
    """The first group that is not empty, read from the match's own text (the patterns look at nothing outside it)."""
    text = F.regexp_extract(match, pattern, groups[-1])
    for g in reversed(groups[:-1]):
        text = F.coalesce(F.nullif(F.regexp_extract(match, pattern, g), F.lit("")), text)
    return text


def _any_feature(q: Column, u: Column) -> Column:
    """A query has PostgreSQL syntax: a feature's pattern matches, or a function family's.  What a search decides comes first;
    an expression runs on the queries alone that hold its literal."""
    cond = has_any(u, [x for lits in LITERAL_FEATURES.values() for x in lits])
    for (lbl, p), lits in zip(QUERY_FEATURES, FEATURE_LITERALS):
        if lbl not in LITERAL_FEATURES:
            cond = cond | guarded_rlike(q, u, p, lits)
    return cond | literals_match(q, u, RE_FUNCTION_FAMILY)


def _query_array(content: Column, U: Column) -> Column:
    """Native queries of a file (J7/J8 texts, in pattern order) with their per-query
    flags, computed once per file: array<struct<q, pg, lo, ret>>."""
    empty = F.array().cast("array<string>")
    ann = F.when(U.contains("@QUERY"), F.regexp_extract_all(content, F.lit(RE_ANNOTATION_TEXT), 1)).otherwise(empty)
    has_lit = has_any(U, ['"' + k for k in ["SELECT", "INSERT", "UPDATE", "DELETE", "CREATE", "ALTER", "DROP"]])
    lit = F.when(has_lit, F.regexp_extract_all(content, F.lit(RE_LITERAL_QUERY), 1)).otherwise(empty)
    texts = lambda found, is_ann: F.transform(found, lambda q: F.struct(F.lit(is_ann).alias("ann"), q.alias("q"), F.upper(q).alias("u")))
    return F.transform(F.concat(texts(ann, True), texts(lit, False)), lambda x: F.struct(
        x["ann"].alias("ann"), _any_feature(x["q"], x["u"]).alias("pg"),
        literals_match(x["q"], x["u"], "(?i)LIMIT|OFFSET").alias("lo"), literals_match(x["q"], x["u"], "(?i)RETURNING").alias("ret")))


def _query_facts(qa: Column) -> list[Column]:
    """Per-file counts over the native queries: annotation queries always count,
    string literals only when PostgreSQL-specific."""
    kept = F.filter(qa, lambda x: x["ann"] | x["pg"])
    return [
        F.size(kept).cast("long").alias("native_queries"),
        F.size(F.filter(kept, lambda x: x["pg"])).cast("long").alias("pg_native_queries"),
        F.size(F.filter(kept, lambda x: x["lo"])).cast("long").alias("limit_offset_queries"),
        F.size(F.filter(kept, lambda x: x["ret"])).cast("long").alias("returning_queries"),
    ]


def java_files(src_files: DataFrame) -> DataFrame:
    """One row per Java file (one scan, one projection)."""
    content = c("content")
    U = c("U")
    name = strip_suffix(basename("path"), ".java")
    f = src_files.select(
        *KEYS, name.alias("name"), "content", F.upper("content").alias("U")).select(
        *KEYS, "name",
        file_type(content, c("name"), U).alias("type"),
        java_loc(content).cast("long").alias("loc"),
        orm_framework(content, U).alias("orm_framework"),
        F.regexp_count(content, F.lit("@Repository")).cast("long").alias("repository_annotations"),
        F.regexp_count(content, F.lit("@Entity|@Table")).cast("long").alias("entity_annotations"),
        F.regexp_count(content, F.lit("@Mapper")).cast("long").alias("mapper_annotations"),
        F.filter(F.array(*[F.when(content.contains(a), F.lit(a)) for a in JPA_ANNOTATIONS]),
                 lambda x: x.isNotNull()).alias("jpa_annotations"),
        pg_functions_used(content, U).alias("pg_functions"),
        flags(content, [(w, at_word(w) + r"\b") for w in PG_TYPE_WORDS], U, [[w] for w in PG_TYPE_WORDS])
        .alias("pg_data_types"),
        # one of the types by itself, for the scores
        guarded_rlike(content, U, at_word("BOOLEAN") + r"\b", ["BOOLEAN"]).alias("uses_boolean"),
        flags(content, PG_OPERATORS, U, [["@>"], ["<@"], ["->"], ["->>"], ["@@"], ["~"], ["~*"], ["||"]])
        .alias("pg_operators"),
        # both alternatives hold "Connection" or "getConnection"; a text without the word has no match
        F.when(~content.contains("Connection"), F.lit(0)).otherwise(F.regexp_count(content, F.lit(RE_JDBC))).cast("long").alias("jdbc_calls"),
        F.regexp_count(content, F.lit("PreparedStatement")).cast("long").alias("prepared_statements"),
        # all but one of the names begin with PG_: two searches keep the rules off most texts
        F.when(~has_any(U, ["PG_", "_SCHEMA"]), F.array().cast("array<string>")).otherwise(
            flags(content, SCHEMA_CODE, U, [["PG_CATALOG"], ["INFORMATION_SCHEMA"], ["PG_STAT"],
                                            ["PG_CLASS", "PG_NAMESPACE", "PG_ATTRIBUTE"]])).alias("schema_code"),
        flags(content, EXTENSION_USAGE, U, [["POSTGIS", "ST_", "GEOGRAPHY", "GEOMETRY"], ["PG_TRGM", "SIMILARITY"],
                                            ["UUID_GENERATE", "UUID-OSSP"], ["HSTORE"], ["LTREE"]])
        .alias("extension_usage"),
        _query_array(content, U).alias("qa"),
    )
    # second projection: the query array is evaluated once and read four times
    # (Catalyst does not collapse projections that would duplicate it)
    f = f.select(*[x for x in f.columns if x != "qa"], *_query_facts(c("qa")))
    return f.withColumn("has_pg_dependency", (c("native_queries") > 0) | (F.size("pg_functions") > 0)
                        | (F.size("pg_data_types") > 0))


def query_features(q: Column, U: Column) -> Column:
    """Ordered feature list of one query text (``U``: in upper case)."""
    items = [F.when(guarded_rlike(q, U, p, lits), F.lit(lbl)) for (lbl, p), lits in zip(QUERY_FEATURES, FEATURE_LITERALS)]
    items += [F.when(U.contains(f.upper()), F.lit(f"{f}() function")) for f in QUERY_FUNCTION_FAMILIES]
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def _newlines(x: Column) -> Column:
    return F.length(x) - F.length(F.regexp_replace(x, "\n", ""))


def _matches(pattern: str, groups: list[int], kind: str, literals: list[str]) -> Column:
    """Every match of ``pattern`` in ``content`` as (kind, i, newlines of the text before it since
    the match before, newlines inside it, its first group that is not empty).  A content without one
    of the ``literals`` that every match contains is skipped before any regex runs.  ``split`` by
    the pattern gives the text between matches (one piece more than there are matches)."""
    def row(x: Column, i: Column) -> Column:
        return F.struct(F.lit(kind).alias("type"), i.alias("i"), _newlines(x["p"]).alias("p"), _newlines(x["m"]).alias("m"), _group(x["m"], pattern, groups).alias("query"))
    z = F.arrays_zip(F.split("content", pattern, -1).alias("p"), F.regexp_extract_all("content", F.lit(pattern), 0).alias("m"))
    return F.when(has_any(c("U"), literals), F.transform(F.filter(z, lambda x: x["m"].isNotNull()), row)).otherwise(
        F.expr("cast(array() as array<struct<type:string,i:int,p:int,m:int,query:string>>)"))


def java_queries(src_files: DataFrame) -> DataFrame:
    """Annotation queries (all) and string-literal queries (PostgreSQL-specific
    only), with 1-based line, feature list and flag.

    Both patterns are found in one projection over the content and exploded once; a match's line is
    the running sum of the newlines before it, in one window per file."""
    # An outer generator: for an inner one Catalyst tests the array's size, and so mines, below the spread of the keys.
    found = src_files.select(*KEYS, "content", F.upper("content").alias("U")).select(*KEYS, F.explode_outer(F.concat(
        _matches(RE_ANNOTATION_QUERY, [1, 2], "annotation", ["@QUERY"]),
        _matches(RE_LITERAL_QUERY, [1], "string_literal", ['"' + k for k in ["SELECT", "INSERT", "UPDATE", "DELETE", "CREATE", "ALTER", "DROP"]]))).alias("q"))
    w = Window.partitionBy(*KEYS, "type").orderBy("i")
    before = F.sum("p").over(w) + F.coalesce(F.sum("m").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    q = found.where("q is not null").select(*KEYS, "q.*").select(
        *KEYS, c("i").cast("long").alias("ord"), (before + 1).cast("long").alias("line"), "query", "type")
    q = q.withColumn("U", F.upper("query")).withColumn("features", query_features(c("query"), c("U"))).drop("U")
    q = q.withColumn("has_pg_syntax", F.size("features") > 0)
    return q.where((c("type") == "annotation") | c("has_pg_syntax"))


def java_inventory(files: DataFrame) -> DataFrame:
    """File rows with the has-PostgreSQL-dependency flag."""
    return files.select(*KEYS, "name", "type", "loc", "orm_framework", "native_queries", "has_pg_dependency")
