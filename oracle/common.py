"""Shared pieces of the DuckDB oracle SQL (independent of the Spark library code;
only the corpus-generating templates are shared so both sides see the same input)."""

from migscope.functions.text import JS_WS_CODEPOINTS
from migscope.sources.generated import for_duckdb

# DuckDB expression for the JS trim character set.
JS_WS_SQL = " || ".join(f"chr({cp})" for cp in JS_WS_CODEPOINTS)


def js_trim(x: str) -> str:
    return f"trim({x}, {JS_WS_SQL})"


def b(cond: str) -> str:
    """boolean -> 0/1"""
    return f"(CASE WHEN {cond} THEN 1 ELSE 0 END)"


def rnd(x: str) -> str:
    return f"CAST(floor({x} + 0.5) AS BIGINT)"


def load_units_ctes() -> str:
    """load_units (project_id, node, unit, unit_size, level, deferred) after ``nodes`` (project_id, node) and ``every``
    (project_id, a, b): mutual reachability, then the longest path over the condensed graph."""
    return """,
edge AS (SELECT DISTINCT project_id, a, b FROM every WHERE a <> b),
mutual(project_id, a, b) AS (SELECT project_id, a, b FROM edge UNION SELECT r.project_id, r.a, e.b FROM mutual r JOIN edge e ON e.project_id = r.project_id AND e.a = r.b),
circle AS (SELECT x.project_id, x.a, min(x.b) AS least FROM mutual x JOIN mutual y ON y.project_id = x.project_id AND y.a = x.b AND y.b = x.a GROUP BY ALL),
unit_of AS (SELECT n.project_id, n.node, coalesce(least(c.least, n.node), n.node) AS unit FROM nodes n LEFT JOIN circle c ON c.project_id = n.project_id AND c.a = n.node),
ends AS (SELECT e.project_id, e.a, e.b, x.unit AS ua, y.unit AS ub FROM every e JOIN unit_of x ON x.project_id = e.project_id AND x.node = e.a
         JOIN unit_of y ON y.project_id = e.project_id AND y.node = e.b),
climb(project_id, unit, depth) AS (
  SELECT DISTINCT project_id, unit, 0 FROM unit_of
  UNION
  SELECT e.project_id, e.ua, c.depth + 1 FROM climb c JOIN ends e ON e.project_id = c.project_id AND e.ub = c.unit AND e.ua <> e.ub),
load_units AS (
  SELECT u.project_id, u.node, u.unit, count(*) OVER (PARTITION BY u.project_id, u.unit) AS unit_size,
    (SELECT CAST(max(depth) AS INTEGER) FROM climb c WHERE c.project_id = u.project_id AND c.unit = u.unit) AS level,
    coalesce((SELECT string_agg(DISTINCT b, ',' ORDER BY b) FROM ends e WHERE e.project_id = u.project_id AND e.a = u.node AND e.ua = e.ub), '') AS deferred
  FROM unit_of u)"""


__all__ = ["load_units_ctes", "JS_WS_SQL", "js_trim", "b", "rnd", "for_duckdb"]
