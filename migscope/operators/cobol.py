"""COBOL line and file metrics (one row per program).

Input is ``src_lines(project_id, path, line_no, line)``.  All per-line facts are
computed in one projection (``upper`` / JS trim once), then summed in one
aggregate.  The only sequential rule -- the nested-IF depth with its clamp at 0 --
is evaluated as a *blocked parallel scan*: a file is cut into blocks of
``block_lines`` consecutive lines, each block is scanned with a window of bounded
size, and block summaries are combined per file with a second, tiny window.  A
single huge file therefore spreads over many tasks instead of one window
partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from migscope.functions.text import basename, flag, guarded_rlike, js_trim, strip_suffix

BLOCK_LINES = 1 << 16
FILE_KEYS = ["project_id", "path"]

# Regular expressions of the COBOL rules (applied to the upper-cased
# line).  Java syntax; equivalent in RE2 for the oracle.
RE_GOTO = r"\bGO\s+TO\b|\bGOTO\b"
RE_FILEOP = r"\b(OPEN|READ|WRITE|CLOSE|REWRITE|DELETE)\b"
RE_COMP3 = r"\bCOMP-3\b|\bPACKED-DECIMAL\b"
RE_PIC = r"PIC\s+[^.\s]*[SVP9X]{5,}"
RE_SORT = r"\b(SORT|MERGE|RELEASE|RETURN)\b"
RE_DIVISION = r"(?i)(IDENTIFICATION|ENVIRONMENT|DATA|PROCEDURE)\s+DIVISION"
RE_PARAGRAPH = r"^([A-Z][A-Z0-9\-]+)\.\s*\z"
RE_CALL = r"CALL\s+['\"]([^'\"]+)['\"]"
RE_COPY = r"COPY\s+([A-Z0-9\-]+)"

METRICS = ["loc", "if_lines", "goto", "evaluate", "perform", "perform_until", "when_lines",
           "copybook", "sql", "fileops", "occurs", "redefines", "comp3", "asm", "pic", "sort_merge"]


FLAG_BITS = METRICS + ["report"]          # bit k of ``mask`` = flag k


def _keys(key: str | None) -> tuple[list[str], list[str]]:
    """(partition keys, carried columns): a numeric file id partitions and sorts
    cheaper than the (project_id, path) strings, which are then carried along."""
    return ([key], FILE_KEYS) if key else (FILE_KEYS, [])


def _hits(order: list[str] | None) -> Column:
    """The CALL and COPY targets of a line (``U``: in upper case) with their position: 2*line_no for CALL, 2*line_no+1 for COPY on
    the same line; with ``order`` the struct (order..., 0|1), and no line numbers are needed."""
    U = F.col("U")
    if order and order != ["line_no"]:
        pos = lambda k: F.struct(*[F.col(o) for o in order], F.lit(k).alias("k"))
    else:
        pos = lambda k: (F.col("line_no") * 2 + k).cast("long")
    return F.array(*[F.struct(pos(k).alias("pos"), F.when(U.contains(kind), F.regexp_extract(U, p, 1)).otherwise("").alias("target"), F.lit(kind).alias("kind"))
                     for k, (p, kind) in enumerate([(RE_CALL, "CALL"), (RE_COPY, "COPY")])])


def line_facts(src_lines: DataFrame, block_lines: int = BLOCK_LINES, order: list[str] | None = None,
               key: str | None = None, hits: bool = False) -> DataFrame:
    """One projection with every per-line flag (ints) plus the scan block id, and with ``hits`` the
    line's dependency targets.

    ``src_lines`` either has ``line_no`` (blocks are line ranges of
    ``block_lines``) or already carries a ``block`` column and the ``order``
    columns that order lines inside a block (any split of a file into
    consecutive ranges works)."""
    order = order or ["line_no"]
    block = F.col("block") if "block" in src_lines.columns and order != ["line_no"] else \
        F.floor((F.col("line_no") - 1) / F.lit(block_lines)).cast("long")
    U, T = F.col("U"), F.col("T")
    # ``T`` is trimmed as far as these two tests look: a printable character after the blanks is the trimmed line's first
    code = ~T.startswith("*")
    c = lambda cond: flag(code & cond)  # noqa: E731  metric flags skip comment lines
    # A search stops at each occurrence of its first character: a part of the word that begins with a rare one rules most lines out.
    word = lambda part, whole: U.contains(part) & U.contains(whole)
    is_if = c(U.contains("F ") & (U.startswith("IF ") | U.contains(" IF ")))
    end_if = c(word("-IF", "END-IF"))
    perform = word("FORM", "PERFORM")
    # A regex runs on the lines alone that contain one of its literals (most do not).
    has = lambda pattern, *literals: guarded_rlike(U, U, pattern, list(literals))
    return src_lines.select("*", F.upper("line").alias("U"), F.trim("line").alias("S")).select(
        "*", F.when(F.ascii("S").between(0x21, 0x7E), F.col("S")).otherwise(js_trim("S")).alias("T")).select(
        *FILE_KEYS, *([key] if key else []), *order,
        block.alias("block"),
        flag((T != "") & code).alias("loc"),
        is_if.alias("if_lines"),
        (is_if - end_if).alias("delta"),
        c(has(RE_GOTO, "GO")).alias("goto"),
        c(word("VALUATE", "EVALUATE")).alias("evaluate"),
        c(perform).alias("perform"),
        c(perform & U.contains("UNTIL")).alias("perform_until"),
        c(U.contains("WHEN")).alias("when_lines"),
        c(word("PY ", "COPY ")).alias("copybook"),
        c(U.contains("XEC") & (U.contains("EXEC SQL") | U.contains("EXEC-SQL"))).alias("sql"),
        c(has(RE_FILEOP, "PEN", "READ", "WRITE", "CLOSE", "DELETE")).alias("fileops"),
        c(word("CURS", "OCCURS")).alias("occurs"),
        c(word("FINES", "REDEFINES")).alias("redefines"),
        c(has(RE_COMP3, "MP-3", "KED-")).alias("comp3"),
        c(U.contains("CALL") & (U.contains("ILBOA") | U.contains("ASMX"))).alias("asm"),
        c(has(RE_PIC, "PIC")).alias("pic"),
        c(has(RE_SORT, "SORT", "MERGE", "RELEASE", "RETURN")).alias("sort_merge"),
        (code & word("PORT", "REPORT") & U.contains("SECTION")).alias("report"),
        # only a line with one of the words has targets; the others make no list
        *([F.when(U.contains("CALL") | U.contains("COPY"), F.filter(_hits(order), lambda h: h["target"] != "")).alias("hits")] if hits else []),
    )


def packed_line_facts(src_lines: DataFrame, block_lines: int = BLOCK_LINES,
                      order: list[str] | None = None, key: str | None = None, hits: bool = False) -> DataFrame:
    """The per-line flags packed into one int bitmask: the block window shuffles
    (keys, line_no, block, delta, mask) -- three ints per line -- instead of
    seventeen flag columns."""
    order = order or ["line_no"]
    f = line_facts(src_lines, block_lines, order, key, hits)
    mask = None
    for k, name in enumerate(FLAG_BITS):
        bit = (F.col(name).cast("int") if name == "report" else F.col(name)) * F.lit(1 << k)
        mask = bit if mask is None else mask + bit
    return f.select(*FILE_KEYS, *([key] if key else []), *order, "block", F.col("delta").cast("int").alias("delta"),
                    mask.cast("int").alias("mask"), *(["hits"] if hits else []))


def program_name(path) -> Column:
    """The file name without suffix, in upper case."""
    return F.upper(strip_suffix(basename(path), ".cbl"))


def _bit(name: str) -> Column:
    return F.shiftright(F.col("mask"), FLAG_BITS.index(name)).bitwiseAND(F.lit(1))


def _block_summaries(facts: DataFrame, order: list[str] | None = None, key: str | None = None) -> DataFrame:
    """Per (file, block): metric sums and the depth-scan summary.

    With local prefix sums s (s=0 at block start) and m = min(0, s_1..s_j):
      tot  = sum of deltas           lmin = min(0, all s)
      a    = max over IF lines of s_before       b = max over IF lines of s_before - m_before
    """
    pk, carry = _keys(key)
    w = Window.partitionBy(*pk, "block").orderBy(*(order or ["line_no"]))
    s = F.sum("delta").over(w.rowsBetween(Window.unboundedPreceding, 0))
    m_before = F.least(F.lit(0), F.coalesce(
        F.min("s").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    scanned = facts.withColumn("s", s).withColumn("s_before", F.col("s") - F.col("delta")) \
        .withColumn("m_before", m_before)
    is_if = _bit("if_lines") == 1
    return scanned.groupBy(*pk, "block").agg(
        *[F.first(x).alias(x) for x in carry],
        *[F.sum(_bit(m)).alias(m) for m in METRICS],
        F.bool_or(_bit("report") == 1).alias("report"),
        F.sum("delta").alias("tot"),
        F.least(F.lit(0), F.min("s")).alias("lmin"),
        F.max(F.when(is_if, F.col("s_before"))).alias("a"),
        F.max(F.when(is_if, F.col("s_before") - F.col("m_before"))).alias("b"),
        *([F.flatten(F.collect_list(F.when(F.size("hits") > 0, F.col("hits")))).alias("hits")] if "hits" in facts.columns else []),
    )


def _file_metrics(blocks: DataFrame, key: str | None = None) -> DataFrame:
    """Combine block summaries in line order: offset O and prior minimum P per block
    give the global depth before each IF line as max(O - P + s, s - m)."""
    pk, carry = _keys(key)
    wb = Window.partitionBy(*pk).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    off = F.coalesce(F.sum("tot").over(wb), F.lit(0))
    with_off = blocks.withColumn("off", off)
    prior_min = F.least(F.lit(0), F.coalesce(F.min(F.col("off") + F.col("lmin")).over(wb), F.lit(0)))
    peaks = with_off.withColumn("pmin", prior_min).withColumn(
        "peak", F.greatest(F.col("off") - F.col("pmin") + F.col("a"), F.col("b")) + F.lit(1))
    return peaks.groupBy(*pk).agg(
        *[F.first(x).alias(x) for x in carry],
        *[F.sum(m).cast("long").alias(m) for m in METRICS],
        F.coalesce(F.bool_or("report"), F.lit(False)).alias("report_writer"),
        F.coalesce(F.max("peak"), F.lit(0)).cast("long").alias("max_if_depth"),
    )


def cobol_files(src_lines: DataFrame, block_lines: int = BLOCK_LINES, order: list[str] | None = None,
                key: str | None = None) -> DataFrame:
    """One row per program with LOC, cyclomatic complexity and the 15
    migration metrics.  With ``order`` (and a ``block`` column) the lines need no
    dense numbering: blocks and the order inside them come with the input.
    ``key``: optional numeric file id (one per (project_id, path)) to partition by."""
    return scanned_files(_block_summaries(packed_line_facts(src_lines, block_lines, order, key), order, key), key)


def cobol_scan(src_lines: DataFrame, block_lines: int = BLOCK_LINES, order: list[str] | None = None, key: str | None = None) -> DataFrame:
    """One pass over the lines for programs and dependencies: a row per (file, block) with the sums of the
    metric scan and the block's dependency targets (at most two a line).  ``scanned_files`` and
    ``scanned_edges`` read it; written down, the lines are read once for both."""
    return _block_summaries(packed_line_facts(src_lines, block_lines, order, key, hits=True), order, key)


def scanned_edges(blocks: DataFrame) -> DataFrame:
    """The rows of ``cobol_edges`` from a scan."""
    return _first_hits(blocks.select(*FILE_KEYS, F.inline("hits")))


def scanned_files(blocks: DataFrame, key: str | None = None) -> DataFrame:
    """The rows of ``cobol_files`` from a scan."""
    f = _file_metrics(blocks, key)
    cc = (F.lit(1) + F.col("if_lines") + F.col("evaluate") + F.col("perform_until")
          + F.col("when_lines") + F.col("goto"))
    return f.select(
        *FILE_KEYS,
        program_name("path").alias("name"),
        F.lit("COBOL Program").alias("type"),
        "loc",
        cc.cast("long").alias("complexity"),
        "max_if_depth", "goto", "evaluate", "perform", "copybook", "sql", "fileops", "occurs",
        "redefines", "comp3", "asm", "pic", "sort_merge", "report_writer",
    )


def cobol_divisions(src_lines: DataFrame) -> DataFrame:
    """Division headers in file order (comment lines included, duplicates kept).
    Long form: one row per hit keyed by line_no."""
    d = F.regexp_extract("line", RE_DIVISION, 1)
    return src_lines.select(*FILE_KEYS, "line_no", d.alias("d")).where(F.col("d") != "") \
        .select(*FILE_KEYS, "line_no", F.concat(F.upper("d"), F.lit(" DIVISION")).alias("division"))


def cobol_paragraphs(src_lines: DataFrame) -> DataFrame:
    """C4: paragraph names (case-sensitive all-caps word + period on a trimmed line)."""
    p = F.regexp_extract(js_trim("line"), RE_PARAGRAPH, 1)
    return src_lines.select(*FILE_KEYS, "line_no", p.alias("paragraph")) \
        .where((F.col("paragraph") != "") & (F.col("paragraph") != "DIVISION"))


def cobol_edges(src_lines: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Distinct CALL / COPY targets per program with their first-seen position (see ``_hits``).
    Partial aggregation keeps the hash aggregate map-side combined."""
    return _first_hits(src_lines.withColumn("U", F.upper("line")).select(*FILE_KEYS, F.explode(_hits(order)).alias("h")).select(*FILE_KEYS, "h.*").where(F.col("target") != ""))


def _first_hits(hits: DataFrame) -> DataFrame:
    return hits.groupBy(*FILE_KEYS, "target").agg(
        F.min("pos").alias("first_pos"),
        F.min_by("kind", "pos").alias("kind"))


def dependency_lists(edges: DataFrame) -> DataFrame:
    """Per program the distinct targets in first-seen order (array).  The group is
    bounded by the number of distinct targets of a file, not by its lines."""
    return edges.groupBy(*FILE_KEYS).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("first_pos", "target"))),
                    lambda s: s["target"]).alias("dependencies"))
