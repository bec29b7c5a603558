"""Column helpers that reproduce the JavaScript string and number semantics the
assessment rules are defined with.  Everything here returns a Column built from
built-in functions, so it stays inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters String.prototype.trim removes (WhiteSpace and
# LineTerminator of ECMAScript), in code-point order.
JS_WS_CODEPOINTS = [
    0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0xA0, 0x1680,
    0x2000, 0x2001, 0x2002, 0x2003, 0x2004, 0x2005, 0x2006, 0x2007, 0x2008, 0x2009, 0x200A,
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF,
]
JS_WS = "".join(chr(c) for c in JS_WS_CODEPOINTS)
# Character class equivalent of JS \s for Java regular expressions.
JS_SPACE_CLASS = "[\\t\\n\\x0B\\f\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF]"


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def js_trim(c) -> Column:
    """String.prototype.trim: strips tabs, CR, NBSP, BOM ... not only spaces.  Spaces go first, by the
    trim that compares bytes; the other searches its list for each character."""
    return F.btrim(F.trim(col_(c)), F.lit(JS_WS))


def js_round(c) -> Column:
    """Math.round for the non-negative values the scores produce (half up)."""
    return F.floor(col_(c) + F.lit(0.5)).cast("long")


def flag(c: Column) -> Column:
    """Boolean -> 0/1 int, NULL -> 0."""
    return F.when(c, F.lit(1)).otherwise(F.lit(0))


def basename(c) -> Column:
    return F.regexp_extract(col_(c), r"([^/]+)$", 1)


def strip_suffix(c, suffix: str) -> Column:
    """path.basename(p, suffix): removes the suffix only when it is a proper suffix."""
    c = col_(c)
    n = len(suffix)
    return F.when(
        c.endswith(suffix) & (F.length(c) > F.lit(n)),
        c.substr(F.lit(1), F.length(c) - F.lit(n)),
    ).otherwise(c)


def ordered_distinct(list_col: Column, order_field: str, value_field: str) -> Column:
    """array of struct(order..., value) collected in any order -> distinct values in
    first-seen order (the JS `[...new Set(arr)]` idiom)."""
    return F.array_distinct(F.transform(F.array_sort(list_col), lambda s: s[value_field]))


def quote_sql(s: str) -> str:
    """SQL string literal (both Spark SQL and DuckDB accept doubled quotes)."""
    return "'" + s.replace("'", "''") + "'"


def js_to_fixed1_per_million(v) -> Column:
    """``(v / 1e6).toFixed(1)`` for a non-negative integer count ``v``.

    toFixed rounds the *binary* double to the nearer tenth (exact ties upward).
    Away from decimal ties the integer remainder decides; at a decimal tie
    (v % 100000 == 50000) the sign of double(v/1e6)*1e6 - v decides, computed
    without rounding error by a Veltkamp split (1e6 has 14 significant bits, so
    every partial product below is exact)."""
    v = col_(v).cast("long")
    k = F.floor(v / F.lit(100000)).cast("long")
    rem = v - k * F.lit(100000)
    x = v.cast("double") / F.lit(1e6)
    cc = x * F.lit(134217729.0)
    hi = cc - (cc - x)
    lo = x - hi
    p = x * F.lit(1e6)
    err = (hi * F.lit(1e6) - p) + lo * F.lit(1e6)
    above = F.when(p != v.cast("double"), p > v.cast("double")).otherwise(err >= F.lit(0.0))
    tenths = (F.when(rem > 50000, k + 1).when(rem < 50000, k)
              .otherwise(F.when(above, k + 1).otherwise(k)))
    return F.concat((tenths / 10).cast("long").cast("string"), F.lit("."), (tenths % 10).cast("string"))


def has_any(upper_text: Column, literals: list[str]) -> Column:
    """Cheap necessary condition for a regular expression: the upper-cased text
    contains one of the literals every match must include.  ``contains`` is a
    plain substring search, while a case-insensitive Java regex starting with
    ``\\b`` scans every position; guarding with this keeps regexes off most rows."""
    cond = None
    for lit in literals:
        e = upper_text.contains(lit.upper())
        cond = e if cond is None else (cond | e)
    return cond


def guarded_rlike(text: Column, upper_text: Column, pattern: str, literals: list[str] | None) -> Column:
    if not literals:
        return text.rlike(pattern)
    return has_any(upper_text, literals) & text.rlike(pattern)


def is_ascii(text) -> Column:
    """No character of more than one byte."""
    return F.octet_length(col_(text)) == F.length(col_(text))


def literals_match(text: Column, upper_text: Column, pattern: str) -> Column:
    """``text.rlike(pattern)`` for a pattern ``(?i)a|b|...`` of literals alone: a text without characters
    beyond ASCII matches iff its upper case contains one of them; only the others need the expression (their
    upper case may hold letters that ``(?i)`` does not match)."""
    literals = [x.replace("\\.", ".").upper() for x in pattern.removeprefix("(?i)").split("|")]
    return has_any(upper_text, literals) & (is_ascii(text) | text.rlike(pattern))
