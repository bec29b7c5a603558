"""PostgreSQL feature inventory of DDL files (raw text, comments included).

``pg_file_features`` is the record of a file (G17): every feature as an array of structs,
mined in one projection without a shuffle.  Multi-match extraction uses ``regexp_extract_all``
per capture group (the arrays stay aligned because a non-participating group yields '') and
higher-order functions; no UDF.  The ``pg_*`` tables are the arrays of the record as
rows: a plan that reads one of them mines only that one (the others are pruned), a plan that reads
several materialises the record and mines every file once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from migscope.functions.text import guarded_rlike, has_any, js_trim
from migscope.operators import ddl as D

c = F.col
KEYS = ["project_id", "path"]

# PostgreSQL type -> (suggested Oracle type, mapping complexity).
PG_TYPE_MAP = [
    ("SERIAL", "NUMBER + SEQUENCE + TRIGGER", "Simple"),
    ("BIGSERIAL", "NUMBER + SEQUENCE + TRIGGER", "Simple"),
    ("SMALLSERIAL", "NUMBER + SEQUENCE + TRIGGER", "Simple"),
    ("BOOLEAN", "NUMBER(1) or CHAR(1)", "Simple"),
    ("UUID", "RAW(16) or VARCHAR2(36)", "Moderate"),
    ("JSONB", "JSON (12c+) or CLOB", "Complex"),
    ("JSON", "JSON (12c+) or CLOB", "Moderate"),
    ("ARRAY", "VARRAY or Nested Table", "Complex"),
    ("HSTORE", "JSON or Separate Table", "Complex"),
    ("INET", "VARCHAR2(45)", "Simple"),
    ("MACADDR", "VARCHAR2(17)", "Simple"),
    ("CITEXT", "VARCHAR2 + Function-based Index", "Moderate"),
    ("TSQUERY", "Oracle Text Index", "Complex"),
    ("TSVECTOR", "Oracle Text Index", "Complex"),
    ("BYTEA", "BLOB", "Simple"),
    ("TEXT", "CLOB", "Simple"),
]
# Index methods with a direct Oracle counterpart.
INDEX_SUPPORT = [("BTREE", True), ("HASH", True), ("GIN", False), ("GIST", False), ("BRIN", False),
                 ("SPGIST", False)]

# Feature patterns (case-insensitive, as in the rules).
RE_SERIAL = r"(?i)(SMALL|BIG)?SERIAL"
RE_SERIAL_AHEAD = r"(?i)(?=[SB])(SMALL|BIG)?SERIAL"       # the same matches; one look at a character rules most places out
RE_INDEX = r"(?i)CREATE\s+(?:UNIQUE\s+)?INDEX\s+\w+\s+ON\s+\w+\s+(?:USING\s+(\w+)\s+)?\("
RE_PARTIAL = r"(?i)CREATE\s+(?:UNIQUE\s+)?INDEX\s+\w+\s+ON\s+\w+\s*.*\s+WHERE\s+"
RE_EXPR_INDEX = r"(?i)CREATE\s+(?:UNIQUE\s+)?INDEX\s+\w+\s+ON\s+\w+\s*\([^)]*(?:lower|upper|substring|to_char|\+|\-|\*|\/)[^)]*\)"
RE_FUNCTION = (r"(?i)CREATE\s+(?:OR\s+REPLACE\s+)?FUNCTION\s+(\w+)\s*\([^)]*\)\s+RETURNS?\s+(\S+)\s+"
               r"(?:AS|LANGUAGE)\s+(['\"]?\$\$['\"]?|')?([\s\S]*?)(?:\$\$|')\s*LANGUAGE\s+plpgsql")
RE_TRIGGER = (r"(?i)CREATE\s+TRIGGER\s+(\w+)\s+(BEFORE|AFTER|INSTEAD\s+OF)\s+(INSERT|UPDATE|DELETE)"
              r"(?:\s+OR\s+(?:INSERT|UPDATE|DELETE))*\s+ON\s+\w+\s+FOR\s+EACH\s+(ROW|STATEMENT)")
RE_SEQUENCE = r"(?i)CREATE\s+SEQUENCE\s+(\w+)\s+(?:AS\s+(\w+)\s+)?(?:INCREMENT\s+(?:BY\s+)?(\d+))?"
RE_EXTENSION = r"(?i)CREATE\s+EXTENSION\s+(?:IF\s+NOT\s+EXISTS\s+)?[\"']?(\w+)[\"']?"
RE_PARTITIONED = r"(?i)CREATE\s+TABLE\s+(\w+)\s+\([^)]+\)\s+PARTITION\s+BY\s+(RANGE|LIST|HASH)\s*\("
RE_PARTITION_OF = r"(?i)CREATE\s+TABLE\s+\w+\s+PARTITION\s+OF\s+(\w+)"
RE_INHERITS = r"(?i)CREATE\s+TABLE\s+(\w+)\s+\([^)]*\)\s+INHERITS\s*\(\s*(\w+)\s*\)"
RE_RLS = r"(?i)CREATE\s+POLICY|ENABLE\s+ROW\s+LEVEL\s+SECURITY"
RE_CHECK = r"(?i)CONSTRAINT\s+\w+\s+CHECK\s*\(|CHECK\s*\("
RE_EXCLUDE = r"(?i)CONSTRAINT\s+\w+\s+EXCLUDE|EXCLUDE\s+USING"
# extension usage: (name, pattern) in the order they are appended
EXTENSION_USAGE = [("postgis", r"(?i)ST_\w+|geography|geometry"),
                   ("uuid-ossp", r"(?i)uuid_generate"),
                   ("pg_trgm", r"(?i)similarity\s*\(")]
# words one of which every match above holds, in any case (prefilter only)
EXTENSION_WORDS = {"postgis": ["ST_", "GEOGRAPHY", "GEOMETRY"], "uuid-ossp": ["UUID_GENERATE"], "pg_trgm": ["SIMILARITY"]}


def type_map(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PG_TYPE_MAP, "type string, oracle_type string, complexity string")


def lookup(pairs: list[tuple[str, object]], key: Column) -> Column:
    """The value of ``key`` in a fixed table, null if it has none."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in pairs for x in pair]), key)


def oracle_type(t: Column) -> Column:
    return lookup([(name, oracle) for name, oracle, _ in PG_TYPE_MAP], t)


def complexity(t: Column) -> Column:
    return lookup([(name, level) for name, _, level in PG_TYPE_MAP], t)


def oracle_support(method: Column) -> Column:
    return F.coalesce(lookup(INDEX_SUPPORT, method), F.lit(False))


# ---------------------------------------------------------------- the record
def _found(word: str, pattern: str, group: int) -> Column:
    """A group of all matches of ``pattern``; a text without the ``word`` that each match holds, in any case, is left alone."""
    return F.when(c("U").contains(word), F.regexp_extract_all("content", F.lit(pattern), group)).otherwise(F.array().cast("array<string>"))


def _matches(word: str, pattern: str, **groups: int) -> Column:
    """All matches of ``pattern`` as array of structs of its groups; of a text with ``word`` alone (see ``_found``)."""
    rows = F.arrays_zip(*[F.regexp_extract_all("content", F.lit(pattern), g).alias(n) for n, g in groups.items()])
    return F.when(c("U").contains(word), rows).otherwise(F.expr(f"cast(array() as array<struct<{','.join(n + ':string' for n in groups)}>>)"))


def _number(words: list[str], pattern: str) -> Column:
    """The number of matches of ``pattern``, each of which holds one of the ``words``."""
    return F.when(has_any(c("U"), words), F.regexp_count("content", F.lit(pattern))).otherwise(0)


def _tables(statements: str) -> Column:
    """D3: the tables of the statement array, with their bodies."""
    found = F.transform(F.filter(statements, lambda s: s["kind"] == "TABLE"), lambda s: F.struct(
        s["stmt_no"].alias("stmt_no"), D.unquote(F.regexp_extract(s["stmt"], D.NAME_PATTERNS["TABLE"], 1)).alias("table_name"),
        D.body(s["stmt"]).alias("body")))
    return F.filter(found, lambda t: (t["table_name"] != "") & (t["body"] != ""))


def _columns(bodies: str) -> Column:
    """The columns of the tables, in order.  Step by step: in a lambda every use of an expression makes it once more."""
    def of_table(t: Column) -> Column:
        items = F.transform(F.split(t["body"], ","), lambda x, i: F.struct(i.cast("long").alias("col_no"), D.item_words(js_trim(x)).alias("w")))
        typed = F.transform(F.filter(items, lambda x: ~D.is_constraint(x["w"]["head"])), lambda x: F.struct(
            x["col_no"].alias("col_no"), x["w"]["words"][0].alias("name"), D.type_name(x["w"]["words"]).alias("type")))
        return F.transform(F.filter(typed, lambda x: x["type"] != ""), lambda x: F.struct(
            t["stmt_no"].alias("stmt_no"), x["col_no"].alias("col_no"), t["table_name"].alias("table_name"),
            D.unquote(x["name"]).alias("column_name"), F.upper(x["type"]).alias("data_type")))
    return F.flatten(F.transform(bodies, of_table))


def _met(columns: str) -> Column:
    """The mapped types of a file as met: its columns, then the SERIAL literals of the raw text."""
    place = lambda a, b, d: F.struct(F.lit(a).alias("o1"), b.cast("long").alias("o2"), d.cast("long").alias("o3"))
    mapped = F.filter(columns, lambda x: x["data_type"].isin([t for t, _, _ in PG_TYPE_MAP]))
    return F.concat(
        F.transform(mapped, lambda x: F.struct(x["data_type"].alias("type"), x["table_name"].alias("table_name"), place(0, x["stmt_no"], x["col_no"]).alias("at"))),
        F.transform(_found("SERIAL", RE_SERIAL_AHEAD, 0),
                    lambda m, i: F.struct(F.upper(m).alias("type"), F.lit(None).cast("string").alias("table_name"), place(1, i, F.lit(0)).alias("at"))))


def _types(met: str) -> Column:
    """Per mapped type the column count (+1 per SERIAL literal in the raw text), the tables in
    first-seen order and the Oracle mapping.  ``seen`` orders the types as first met: column
    types by position, then SERIAL-pass-only types by match position."""
    def of_type(g: Column) -> Column:
        t, own = g["type"], g["own"]
        tables = F.array_distinct(F.filter(F.transform(own, lambda x: x["table_name"]), lambda x: x.isNotNull()))
        return F.struct(t.alias("type"), F.size(own).cast("long").alias("count"), tables.alias("tables"), complexity(t).alias("complexity"),
                        oracle_type(t).alias("oracle_type"), F.array_min(F.transform(own, lambda x: x["at"])).alias("seen"))
    names = F.array_distinct(F.transform(met, lambda x: x["type"]))
    return F.transform(F.transform(names, lambda t: F.struct(t.alias("type"), F.filter(met, lambda x: x["type"] == t).alias("own"))), of_type)


def _indexes(methods: str) -> Column:
    """CREATE INDEX methods (default BTREE) with count and Oracle support."""
    return F.transform(F.array_distinct(methods), lambda t: F.struct(
        t.alias("type"), F.size(F.filter(methods, lambda x: x == t)).cast("long").alias("count"), oracle_support(t).alias("oracle_support"),
        (F.array_position(methods, t) - 1).cast("long").alias("first_ord")))


def _functions() -> Column:
    """PL/pgSQL functions with non-blank body lines and feature flags."""
    def fact(f: Column, i: Column) -> Column:
        nonblank = F.size(F.filter(F.split(f["body"], "\n"), lambda l: F.length(js_trim(l)) > 0))
        return F.struct(
            i.cast("long").alias("ord"), f["name"].alias("name"), nonblank.cast("long").alias("complexity"),
            f["body"].rlike(r"(?i)EXECUTE\s+").alias("uses_dynamic_sql"),
            f["body"].rlike(r"(?i)ARRAY\[|array_").alias("uses_arrays"),
            f["body"].rlike(r"(?i)jsonb_|json_|->|->>").alias("uses_json"),
            (f["returns"].rlike(r"(?i)RETURNS\s+TABLE") | f["returns"].rlike(r"(?i)RETURNS\s+SETOF")).alias("returns_table"))
    return F.transform(_matches("FUNCTION", RE_FUNCTION, name=1, returns=2, body=4), fact)


def _triggers() -> Column:
    """Trigger name, timing, first event, row/statement."""
    return F.transform(_matches("TRIGGER", RE_TRIGGER, name=1, timing=2, event=3, for_each=4), lambda t, i: F.struct(
        i.cast("long").alias("ord"), t["name"].alias("name"), t["timing"].alias("timing"), t["event"].alias("event"), t["for_each"].alias("for_each"),
        F.lit(False).alias("has_returning_clause")))


def _sequences(columns: str) -> Column:
    """Explicit sequences, then one implicit sequence per SERIAL column."""
    explicit = F.transform(_matches("SEQUENCE", RE_SEQUENCE, name=1, dt=2, inc=3), lambda s: F.struct(
        s["name"].alias("name"), F.when(s["dt"] == "", "BIGINT").otherwise(s["dt"]).alias("data_type"),
        F.when(s["inc"] == "", F.lit(1).cast("long")).otherwise(s["inc"].cast("long")).alias("increment"), F.lit(False).alias("is_serial")))
    implicit = F.transform(F.filter(columns, lambda x: x["data_type"].endswith("SERIAL")), lambda x: F.struct(
        F.concat_ws("_", x["table_name"], x["column_name"], F.lit("seq")).alias("name"),
        F.when(x["data_type"].contains("BIG"), "BIGINT").otherwise("INTEGER").alias("data_type"),
        F.lit(1).cast("long").alias("increment"), F.lit(True).alias("is_serial")))
    return F.transform(F.concat(explicit, implicit), lambda s, i: F.struct(i.cast("long").alias("ord"), *[s[n].alias(n) for n in ("name", "data_type", "increment", "is_serial")]))


def _extensions() -> Column:
    """Explicit extensions in order (duplicates kept), then the usage-detected
    ones that are not yet listed."""
    explicit = _found("EXTENSION", RE_EXTENSION, 1)
    used = F.filter(F.array(*[F.when(guarded_rlike(c("content"), c("U"), p, EXTENSION_WORDS[n]), F.lit(n)) for n, p in EXTENSION_USAGE]), lambda x: x.isNotNull())
    return F.concat(explicit, F.array_except(used, explicit))


def _partitions(children: str) -> Column:
    """Declaratively partitioned tables and the number of ``PARTITION OF`` children
    whose parent reference starts with the table name (the rule matches unanchored and
    case-insensitively)."""
    return F.transform(_matches("PARTITION", RE_PARTITIONED, name=1, strategy=2), lambda p, i: F.struct(
        i.cast("long").alias("ord"), p["name"].alias("name"), F.upper(p["strategy"]).alias("strategy"),
        F.size(F.filter(children, lambda ref: F.startswith(ref, F.lower(p["name"])))).cast("long").alias("partition_count")))


def _estimates(bodies: str) -> Column:
    """Size class by index count; indexes are never collected, so every
    table is Small / 10,000 rows."""
    n = F.lit(0)
    rows = F.when(n >= 5, 10000000).when(n >= 3, 1000000).when(n >= 1, 100000).otherwise(10000).cast("long")
    size = F.when(n >= 5, "Very Large").when(n >= 3, "Large").when(n >= 1, "Medium").otherwise("Small")
    return F.transform(bodies, lambda t: F.struct(t["stmt_no"].alias("stmt_no"), t["table_name"].alias("table_name"), rows.alias("estimated_rows"), size.alias("size_category")))


def _objects(statements: str) -> Column:
    """(statement, kind, name) of the routed statements with a name."""
    def named(s: Column) -> Column:
        name = F.lit(None).cast("string")
        for kind, pattern in D.NAME_PATTERNS.items():
            name = F.when(s["kind"] == kind, D.unquote(F.regexp_extract(s["stmt"], pattern, 1))).otherwise(name)
        return F.struct(s["stmt_no"].alias("stmt_no"), s["kind"].alias("kind"), name.alias("name"))
    return F.filter(F.transform(F.filter(statements, lambda s: s["kind"].isNotNull()), named), lambda s: s["name"] != "")


#: The parts of a record that are lists.
LISTS = ["types", "indexes", "functions", "triggers", "sequences", "extensions", "partitions", "inheritance", "estimates", "objects"]
COUNTERS = {"partial_indexes": RE_PARTIAL, "expression_indexes": RE_EXPR_INDEX, "rls_policies": RE_RLS, "check_constraints": RE_CHECK,
            "exclusion_constraints": RE_EXCLUDE}
#: Words one of which every match of a counter holds, in any case (prefilter only).
COUNTER_WORDS = {"partial_indexes": ["WHERE"], "expression_indexes": ["INDEX"], "rls_policies": ["POLICY", "SECURITY"], "check_constraints": ["CHECK"],
                 "exclusion_constraints": ["EXCLUDE"]}


def pg_file_features(files: DataFrame) -> DataFrame:
    """One row a file with all its features (``LISTS``), the counters of G5, G6, G13, G15 and G16, and
    its numbers of tables, columns and statements.  Four projections, so that what several parts
    read (statements, table bodies, columns, met types) is made once; no shuffle."""
    statements = files.select(*KEYS, "content", F.upper("content").alias("U"), D.statement_list(c("content")).alias("statements"))
    methods = F.transform(_found("INDEX", RE_INDEX, 1), lambda m: F.when(m == "", "BTREE").otherwise(F.upper(m)))
    parts = statements.select(*KEYS, "content", "U", "statements", _tables("statements").alias("bodies"), methods.alias("methods"),
                              F.transform(_found("PARTITION", RE_PARTITION_OF, 1), F.lower).alias("children"))
    parts = parts.select("*", _columns("bodies").alias("cols"))
    parts = parts.select("*", _met("cols").alias("met"))
    names = _found("INHERITS", RE_INHERITS, 1)
    return parts.select(
        *KEYS, _types("met").alias("types"), _indexes("methods").alias("indexes"), _functions().alias("functions"), _triggers().alias("triggers"),
        _sequences("cols").alias("sequences"), _extensions().alias("extensions"), _partitions("children").alias("partitions"),
        F.transform(names, lambda n, i: F.struct(i.cast("long").alias("ord"), n.alias("name"))).alias("inheritance"),
        _estimates("bodies").alias("estimates"), _objects("statements").alias("objects"),
        *[_number(COUNTER_WORDS[n], p).cast("long").alias(n) for n, p in COUNTERS.items()],
        F.size("bodies").cast("long").alias("n_tables"), F.size("cols").cast("long").alias("n_columns"), F.size("statements").cast("long").alias("n_statements"))


# ---------------------------------------------------------------- its lists as rows
def _record(files: DataFrame) -> DataFrame:
    """Records, or files, whose records are made."""
    return pg_file_features(files) if "content" in files.columns else files


def _items(files: DataFrame, part: str) -> DataFrame:
    """A list of the records as rows (ord, item).  The generator is an outer one and its empty row goes
    afterwards: for an inner one Catalyst infers that the list is not empty and pushes that
    test, with the mining in it, below the spread of the keys -- the record is then
    mined once more, in as many tasks as the scan has."""
    return _record(files).select(*KEYS, F.posexplode_outer(part).alias("ord", "item")).where(c("ord").isNotNull())


def _rows(files: DataFrame, part: str) -> DataFrame:
    return _items(files, part).select(*KEYS, "item.*")


def pg_type_usage(files: DataFrame) -> DataFrame:
    return _rows(files, "types")


def pg_index_types(files: DataFrame) -> DataFrame:
    return _rows(files, "indexes")


def pg_functions(files: DataFrame) -> DataFrame:
    return _rows(files, "functions")


def pg_triggers(files: DataFrame) -> DataFrame:
    return _rows(files, "triggers")


def pg_sequences(files: DataFrame) -> DataFrame:
    return _rows(files, "sequences")


def pg_extensions(files: DataFrame) -> DataFrame:
    return _items(files, "extensions").select(*KEYS, c("ord").cast("long").alias("ord"), c("item").alias("extension"))


def pg_partitions(files: DataFrame) -> DataFrame:
    return _rows(files, "partitions")


def pg_inheritance(files: DataFrame) -> DataFrame:
    return _rows(files, "inheritance")


def pg_row_estimates(files: DataFrame) -> DataFrame:
    return _rows(files, "estimates").drop("stmt_no")


def pg_counters(files: DataFrame) -> DataFrame:
    """G5, G6, G13, G15, G16 and the per-file counts of G4, G7, G8, G11 and G12."""
    size = lambda x: F.size(x).cast("long")
    return _record(files).select(
        *KEYS, *COUNTERS, F.coalesce(F.aggregate("indexes", F.lit(0).cast("long"), lambda a, x: a + x["count"]), F.lit(0)).alias("indexes"),
        size("functions").alias("plpgsql_functions"), size("triggers").alias("triggers"), size("partitions").alias("partitioned_tables"),
        size("inheritance").alias("inheritance_tables"))


def _is_kind(kind: str):
    return lambda o: o["kind"] == kind


def object_totals(files: DataFrame) -> DataFrame:
    """D14 per project from the records: tables, columns, indexes (0) and the object counts of M6, with
    the number of partitioned tables."""
    kinds = {"views": "VIEW", "sequences": "SEQUENCE", "stored_procedures": "PROCEDURE", "triggers": "TRIGGER", "functions": "FUNCTION"}
    counts = {"tables": c("n_tables"), "columns": c("n_columns"), "indexes": F.lit(0)}
    counts |= {name: F.size(F.filter("objects", _is_kind(kind))) for name, kind in kinds.items()}
    counts["partitioned_tables"] = F.size("partitions")
    rows = _record(files).where("n_statements > 0").select("project_id", *[e.alias(n) for n, e in counts.items()])
    return rows.groupBy("project_id").agg(*[F.sum(n).cast("long").alias(n) for n in counts])
