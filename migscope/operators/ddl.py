"""DDL catalogue mining: bulk regular-expression extraction over a statement
table (not a SQL parser).  Every step is a per-row projection or explode, so the
work is spread over files and statements; only totals aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from migscope.functions.text import col_, js_trim

c = F.col
KEYS = ["project_id", "path"]

# Statement routing prefixes (upper-cased, trimmed statement).
ROUTES = [
    ("TABLE", ["CREATE TABLE"]),
    ("VIEW", ["CREATE VIEW"]),
    ("SEQUENCE", ["CREATE SEQUENCE"]),
    ("PROCEDURE", ["CREATE PROCEDURE", "CREATE OR REPLACE PROCEDURE"]),
    ("TRIGGER", ["CREATE TRIGGER"]),
    ("FUNCTION", ["CREATE FUNCTION", "CREATE OR REPLACE FUNCTION"]),
]
# Name patterns per object kind.
NAME_PATTERNS = {
    "TABLE": r"(?i)CREATE\s+TABLE\s+([^\s(]+)",
    "VIEW": r"(?i)CREATE\s+(?:OR\s+REPLACE\s+)?VIEW\s+([^\s(]+)",
    "SEQUENCE": r"(?i)CREATE\s+SEQUENCE\s+([^\s;]+)",
    "PROCEDURE": r"(?i)CREATE\s+(?:OR\s+REPLACE\s+)?PROCEDURE\s+([^\s(]+)",
    "TRIGGER": r"(?i)CREATE\s+TRIGGER\s+(\S+)",
    "FUNCTION": r"(?i)CREATE\s+(?:OR\s+REPLACE\s+)?FUNCTION\s+([^\s(]+)",
}
RE_PK = r"(?i)PRIMARY\s+KEY\s*\(([^)]+)\)"
RE_FK = r"(?i)CONSTRAINT\s+(\S+)\s+FOREIGN\s+KEY\s*\(([^)]+)\)\s+REFERENCES\s+([^\s(]+)\s*\(([^)]+)\)"
RE_TYPE = r"(?i)^([A-Z0-9_]+)(?:\((\d+)(?:,(\d+))?\))?"
RE_DEFAULT = r"(?i)DEFAULT\s+([^\s,]+)"


def unquote(x: Column) -> Column:
    return F.translate(x, '"`', "")


def name_list(x: Column) -> Column:
    """'a, "b"' -> [a, b]"""
    return F.transform(F.split(x, ","), lambda e: unquote(js_trim(e)))


def body(stmt: Column | str) -> Column:
    """The text from the first '(' to the last ')', '' if there is none (``\\(([\\s\\S]+)\\)`` by searches
    alone: that expression cost four fifths of the mining of a file's tables)."""
    stmt = col_(stmt)
    first = F.instr(stmt, "(")
    last = F.length(stmt) - F.length(F.substring_index(stmt, ")", -1))
    return F.when(first > 0, F.substring(stmt, first + 1, last - 1 - first)).otherwise("")


def _head(stmt: Column) -> Column:
    """The first characters of a statement in upper case (that never shortens a text, so they hold its prefix)."""
    return F.upper(F.substring(stmt, 1, max(len(p) for _, prefixes in ROUTES for p in prefixes)))


def _kind(U: Column) -> Column:
    """The route of a statement by the prefix in its ``_head``."""
    kind = None
    for k, prefixes in ROUTES:
        cond = None
        for p in prefixes:
            cond = U.startswith(p) if cond is None else cond | U.startswith(p)
        kind = F.when(cond, k) if kind is None else kind.when(cond, k)
    return kind


def _pieces(content: Column | str) -> Column:
    """The text without comments, split on ';' (a text without the sign of a comment is left alone)."""
    content = col_(content)
    plain = F.when(content.contains("--"), F.regexp_replace(content, r"--[^\n]*", "")).otherwise(content)
    return F.split(F.when(content.contains("/*"), F.regexp_replace(plain, r"/\*[\s\S]*?\*/", "")).otherwise(plain), ";")


def ddl_statements(src_files: DataFrame) -> DataFrame:
    """Strip comments, split on ';', trim, drop empty; route by prefix."""
    # outer generators: for an inner one Catalyst tests the array's size, and so splits, below the spread of the keys
    st = src_files.select(*KEYS, F.posexplode_outer(_pieces("content")).alias("stmt_no", "raw")) \
        .select(*KEYS, "stmt_no", js_trim("raw").alias("stmt")).where(F.length("stmt") > 0)
    return st.select(*KEYS, c("stmt_no").cast("long").alias("stmt_no"), _kind(_head(c("stmt"))).alias("kind"), "stmt")


def statement_list(content: Column) -> Column:
    """The statements of a file as array of structs (stmt_no, kind, stmt), as ``ddl_statements`` has them."""
    trimmed = F.transform(_pieces(content), lambda x, i: F.struct(i.cast("long").alias("stmt_no"), js_trim(x).alias("stmt")))
    # step by step: in a lambda every use of an expression makes it once more
    headed = F.transform(F.filter(trimmed, lambda s: s["stmt"] != ""), lambda s: F.struct(s["stmt_no"].alias("stmt_no"), s["stmt"].alias("stmt"), _head(s["stmt"]).alias("head")))
    return F.transform(headed, lambda s: F.struct(s["stmt_no"].alias("stmt_no"), _kind(s["head"]).alias("kind"), s["stmt"].alias("stmt")))


def ddl_objects(statements: DataFrame) -> DataFrame:
    """D9-D13 (and table names): (kind, name) per routed statement with a name."""
    name = None
    for k, pat in NAME_PATTERNS.items():
        e = F.regexp_extract("stmt", pat, 1)
        name = F.when(c("kind") == k, e) if name is None else name.when(c("kind") == k, e)
    return statements.where(c("kind").isNotNull()) \
        .select(*KEYS, "stmt_no", "kind", unquote(name).alias("name")).where(c("name") != "")


def _tables(statements: DataFrame) -> DataFrame:
    t = statements.where(c("kind") == "TABLE").select(
        *KEYS, "stmt_no",
        unquote(F.regexp_extract("stmt", NAME_PATTERNS["TABLE"], 1)).alias("table_name"),
        body("stmt").alias("body"))
    return t.where((c("table_name") != "") & (c("body") != ""))


def table_items(statements: DataFrame) -> DataFrame:
    """The comma-split items of every table body, with a role per item."""
    t = _tables(statements)
    it = t.select(*KEYS, "stmt_no", "table_name", F.posexplode_outer(F.split("body", ",")).alias("pos", "raw")) \
        .select(*KEYS, "stmt_no", "table_name", "pos", js_trim("raw").alias("item"))
    U = F.upper("item")
    role = (F.when(U.startswith("CONSTRAINT") & U.contains("PRIMARY KEY"), "pk")
            .when(U.startswith("CONSTRAINT") & U.contains("FOREIGN KEY"), "fk")
            .when(U.startswith("PRIMARY KEY"), "pk")
            .when(~U.startswith("CONSTRAINT"), "column"))
    return it.withColumn("role", role)


def ddl_columns(items: DataFrame) -> DataFrame:
    """Column facts (name, upper type, length/precision/scale, nullable, default)."""
    parts = F.split("item", r"\s+")
    cols = items.where(c("role") == "column").select(
        *KEYS, "stmt_no", "table_name", "pos", "item", parts.alias("parts"))
    tm = lambda g: F.regexp_extract(c("parts")[1], RE_TYPE, g)
    typed = cols.where(F.size("parts") >= 2).select(
        *KEYS, "stmt_no", "table_name", "pos", "item",
        unquote(c("parts")[0]).alias("column_name"),
        tm(1).alias("t1"), tm(2).alias("t2"), tm(3).alias("t3")).where(c("t1") != "")
    return typed.select(
        *KEYS, "stmt_no", "table_name", c("pos").cast("long").alias("col_no"), "column_name",
        F.upper("t1").alias("data_type"),
        F.when(c("t2") != "", c("t2").cast("int")).alias("length"),
        F.when(c("t3") != "", c("t2").cast("int")).alias("precision"),
        F.when(c("t3") != "", c("t3").cast("int")).alias("scale"),
        (~F.upper("item").contains("NOT NULL")).alias("nullable"),
        F.nullif(F.regexp_extract("item", RE_DEFAULT, 1), F.lit("")).alias("default_value"))


def ddl_primary_keys(items: DataFrame) -> DataFrame:
    """The primary key of a table = the last item that yields a column list."""
    pk = items.where(c("role") == "pk").select(
        *KEYS, "stmt_no", "table_name", "pos", F.regexp_extract("item", RE_PK, 1).alias("pk")) \
        .where(c("pk") != "")
    return pk.groupBy(*KEYS, "stmt_no", "table_name").agg(F.max_by("pk", "pos").alias("pk")) \
        .select(*KEYS, "stmt_no", "table_name", name_list(c("pk")).alias("primary_key"))


def ddl_foreign_keys(items: DataFrame) -> DataFrame:
    """Named foreign keys written inside one comma item."""
    g = lambda i: F.regexp_extract("item", RE_FK, i)
    fk = items.where(c("role") == "fk").select(
        *KEYS, "stmt_no", "table_name", "pos", g(1).alias("n"), g(2).alias("cols"),
        g(3).alias("ref"), g(4).alias("refcols")).where(c("n") != "")
    return fk.select(*KEYS, "stmt_no", "table_name", c("pos").cast("long").alias("pos"),
                     unquote("n").alias("fk_name"), name_list(c("cols")).alias("columns"),
                     unquote("ref").alias("referenced_table"), name_list(c("refcols")).alias("referenced_columns"))


def item_words(item: Column) -> Column:
    """What the test and the facts of a column read: the item's first characters in upper case, its first
    word and the type's name after it."""
    return F.struct(F.upper(F.substring(item, 1, len("PRIMARY KEY"))).alias("head"), F.split(item, r"\s+", 3).alias("words"))


def type_name(words: Column) -> Column:
    """The name that begins the second word, '' if there is none (group 1 of ``RE_TYPE``)."""
    return F.regexp_extract(F.coalesce(F.get(words, F.lit(1)), F.lit("")), r"^([A-Za-z0-9_]+)", 1)


def is_constraint(head: Column) -> Column:
    return head.startswith("CONSTRAINT") | head.startswith("PRIMARY KEY")


def _is_column(item: Column) -> Column:
    """An item that ``ddl_columns`` reads as a column: no constraint, and a type after the name."""
    w = item_words(item)
    return ~is_constraint(w["head"]) & (type_name(w["words"]) != "")


def ddl_tables(statements: DataFrame) -> DataFrame:
    """D3-D6 per table: column count, primary key, FK count, indexes (always 0).  Every table has
    an item, so one aggregate over the items gives all of them."""
    pk = F.regexp_extract("item", RE_PK, 1)
    items = table_items(statements).select(
        *KEYS, "stmt_no", "table_name", _is_column(c("item")).alias("is_column"),
        ((c("role") == "fk") & (F.regexp_extract("item", RE_FK, 1) != "")).alias("is_fk"),
        F.when((c("role") == "pk") & (pk != ""), F.struct("pos", pk.alias("pk"))).alias("key"))
    g = items.groupBy(*KEYS, "stmt_no", "table_name").agg(
        F.count_if("is_column").alias("n_columns"), F.count_if("is_fk").alias("n_foreign_keys"), F.max("key").alias("key"))
    return g.select(*KEYS, "stmt_no", "table_name", "n_columns", F.when(c("key").isNotNull(), name_list(c("key.pk"))).alias("primary_key"),
                    "n_foreign_keys", F.lit(0).cast("long").alias("n_indexes"))


def ddl_file_totals(statements: DataFrame) -> DataFrame:
    """D14 per file: tables, columns, indexes (0) and the object counts of M6, all counted
    inside the statement's row and summed once.  A routed TABLE statement without body is
    not a table."""
    name = F.lit(None).cast("string")
    for k, pat in NAME_PATTERNS.items():
        name = F.when(c("kind") == k, unquote(F.regexp_extract("stmt", pat, 1))).otherwise(name)
    rows = statements.select(*KEYS, "kind", (F.coalesce(name, F.lit("")) != "").alias("named"), F.when(c("kind") == "TABLE", body("stmt")).otherwise("").alias("body"))
    table = (c("kind") == "TABLE") & c("named") & (c("body") != "")
    columns = F.size(F.filter(F.transform(F.split("body", ","), js_trim), _is_column))
    count = {"tables": F.count_if(table), "columns": F.sum(F.when(table, columns).otherwise(0))}
    for out, kind in (("views", "VIEW"), ("sequences", "SEQUENCE"), ("stored_procedures", "PROCEDURE"), ("triggers", "TRIGGER"), ("functions", "FUNCTION")):
        count[out] = F.count_if((c("kind") == kind) & c("named"))
    g = rows.groupBy(*KEYS).agg(*[e.cast("long").alias(x) for x, e in count.items()])
    return g.select(*KEYS, *[F.coalesce(c(x), F.lit(0)).alias(x) for x in count], F.lit(0).cast("long").alias("indexes"))


def pick_ddl(per_file: DataFrame, mode: str = "union", files: DataFrame | None = None) -> DataFrame:
    """Several DDL files in a project.  ``union`` keeps every file; ``last`` reproduces the
    rule that the last file (directory order = path order) replaces earlier results.  ``files``
    is the listing: a last file without a statement (comments only) replaces them too."""
    if mode == "union":
        return per_file
    last = (per_file if files is None else files).groupBy("project_id").agg(F.max("path").alias("path"))
    return last.join(per_file, ["project_id", "path"], "left")


def ddl_totals(per_file: DataFrame, mode: str = "union", files: DataFrame | None = None) -> DataFrame:
    """D14 per project after D15 selection."""
    p = pick_ddl(per_file, mode, files)
    cols = ["tables", "columns", "indexes", "views", "sequences", "stored_procedures", "triggers", "functions"]
    return p.groupBy("project_id").agg(*[F.sum(F.coalesce(c(x), F.lit(0))).cast("long").alias(x) for x in cols])
