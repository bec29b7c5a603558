"""Line dedup: winnowing over line hashes, with DataFrame functions alone.

Lines without a word are kept and skipped in the counting.  Of every ``run`` consecutive
lines the one with the least hash (the last of equals) is the fingerprint, so any repeated
run of that many lines shares one.  A line of ``LONG`` words or more is a run of its own, and so is a
text with fewer counted lines than a run.  Positions are joined on shared fingerprints; a match is
extended to the left and right over the windows that chose this fingerprint, each of
which must agree with the first occurrence in all its lines.  Neighbouring windows of a document
that also start earlier (smaller id, or the same document above) make up its repeated runs,
whose lines are deleted.  Runs are judged on the input, and may overlap.

Cases: a null text has no lines, an empty one a single empty line; a null id sorts last; rows
that agree in id and text are one document and get the same result; a very long text makes as many
rows as it has lines, and its kept lines are put together in its own row; extra columns are not read;
an empty table gives no rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from migscope.llm.text import id_back, keyed, stored

RUN = 3
#: Words from which a line is a run of its own.
LONG = 50


def windows(rows: DataFrame, run: int, long: int = LONG) -> DataFrame:
    """(id, h, at, fp, mark, a, b, lines): a row a window; ``at`` is its first counted line, ``fp``
    the fingerprint at line ``mark``, ``a, b`` its content as 128 bits, ``lines`` the line
    numbers of its lines."""
    # So many words take 2 * long - 1 bytes at least, and one space less than that unless a line has other white space.
    # The pattern is anchored, never goes back and ends at the last of the words.
    words = rf"^[\x20\x09-\x0D]*+(?:[^\x20\x09-\x0D]++[\x20\x09-\x0D]++){{{long - 1}}}[^\x20\x09-\x0D]"
    spaces = lambda x: F.octet_length(x) - F.octet_length(F.replace(x, F.lit(" "), F.lit("")))
    odd = lambda x: x.contains("  ") | x.contains("\t") | x.contains("\r") | x.contains("\x0b") | x.contains("\x0c")
    wide = lambda x: (F.octet_length(x) >= 2 * long - 1) & F.when(odd(x), x.rlike(words)).otherwise(spaces(F.trim(x)) >= long - 1)
    numbered = F.transform(F.split("text", "\n", -1), lambda x, i: F.when(x.rlike(r"[^\x20\x09-\x0D]"), F.struct(
        i.alias("i"), F.xxhash64(x).alias("x"), F.xxhash64(F.lit("#"), x).alias("y"), wide(x).alias("wide"))))
    lines = rows.select("id", "h", F.filter(numbered, lambda s: s.isNotNull()).alias("l")).where(F.size("l") > 0)
    span = lambda at, n: F.struct(at.cast("int").alias("at"), F.slice("l", at.cast("int") + 1, n).alias("w"))
    runs = F.transform(F.when(F.size("l") >= run, F.sequence(F.lit(0), F.size("l") - run)).otherwise(F.array(F.lit(0))), lambda k: span(k, F.lit(run)))
    single = F.filter(F.transform("l", lambda s, k: F.when(s["wide"], span(k, F.lit(1)))), lambda s: s.isNotNull())
    w = lines.select("id", "h", F.explode(F.concat(runs, single)).alias("w")).select("id", "h", F.col("w.at").alias("at"), F.col("w.w").alias("w"))
    least = F.array_min("w.x")
    mark = F.col("at") + F.size("w") - F.array_position(F.reverse(F.col("w.x")), least)
    return w.select("id", "h", "at", least.alias("fp"), mark.alias("mark"), *[F.xxhash64(F.col(f"w.{c}")).alias(n) for c, n in (("x", "a"), ("y", "b"))], F.col("w.i").alias("lines"))


def repeated(rows: DataFrame, run: int) -> DataFrame:
    """(id, h, lines): the windows that also start earlier."""
    w = stored(windows(rows, run), "winnow-windows")
    place, mark = F.struct("id", "h", "at"), F.struct("id", "h", "mark")
    shared = w.groupBy("fp").agg(F.min(mark).alias("p"), F.max(mark).alias("q")).where("p < q").select(F.col("fp").alias("f"))
    met = w.join(shared, w.fp == shared.f).drop("f")
    first = met.groupBy("fp", "a", "b").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first < last") \
        .select(F.col("fp").alias("f"), F.col("a").alias("c"), F.col("b").alias("d"), "first")
    return met.join(first, (met.fp == first.f) & (met.a == first.c) & (met.b == first.d)).where(F.col("first") < place).select("id", "h", "lines")


def dedup(docs: DataFrame, run: int = RUN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_lines, removed_lines, kept_text) of every row; removed_lines are line numbers from 0."""
    rows = keyed(docs, id_col, text_col)
    gone = repeated(rows, run).groupBy("id", "h").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("lines")))).alias("gone"))
    out = rows.join(gone, ["id", "h"], "left").select("id", "text", F.coalesce("gone", F.expr("cast(array() as array<int>)")).alias("gone"))
    lines = F.coalesce(F.split("text", "\n", -1), F.expr("cast(array() as array<string>)"))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone")), lambda i: F.element_at(lines, i + 1))
    return out.select(id_back("id", id_col), F.size(lines).cast("long").alias("n_lines"), F.col("gone").alias("removed_lines"), F.array_join(F.when(F.size("gone") == 0, lines).otherwise(kept), "\n").alias("kept_text"))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return found.select(id_col, "n_lines", F.size("removed_lines").cast("long").alias("n_removed"), F.sha2("kept_text", 256).alias("kept_sha256"))


SQL = r"""
WITH l AS (
  SELECT doc_id, i - 1 AS i, string_split(text, chr(10))[i] AS line
  FROM (SELECT doc_id, text, unnest(range(1, CAST(len(string_split(text, chr(10))) AS BIGINT) + 1)) AS i FROM documents WHERE text IS NOT NULL)),
n AS (
  SELECT doc_id, i, line, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS pos
  FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
w AS (
  SELECT doc_id, pos, i AS x, lead(i, 1) OVER o AS y, lead(i, 2) OVER o AS z, line || chr(10) || lead(line, 1) OVER o || chr(10) || lead(line, 2) OVER o AS content
  FROM n WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
v AS (
  SELECT doc_id, pos, [x, y, z] AS lines, content FROM w WHERE content IS NOT NULL
  UNION ALL SELECT doc_id, 1, list(i ORDER BY pos), string_agg(line, chr(10) ORDER BY pos) FROM n GROUP BY doc_id HAVING count(*) < 3
  UNION ALL SELECT doc_id, pos, [i], line FROM n WHERE len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) >= 50),
r AS (SELECT *, dense_rank() OVER (PARTITION BY content ORDER BY doc_id, pos) AS k FROM v),
g AS (SELECT DISTINCT doc_id, unnest(lines) AS i FROM r WHERE k > 1),
k AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.i) FILTER (WHERE g.i IS NULL) AS kept, count(*) AS n_lines, count(g.i) AS n_removed
  FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.i = g.i GROUP BY l.doc_id)
SELECT d.doc_id, CAST(coalesce(k.n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM documents d LEFT JOIN k ON d.doc_id = k.doc_id
"""
