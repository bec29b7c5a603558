"""Mixing sources to target weights: Pareto order sampling.

Size is counted in words.  Targets: the sources in code-point order (null last) weigh 5, 2, 1,
repeating, and share ``share`` of all words; no target exceeds ``most`` times its source's
words, and what is above is shared again by weight (the level at which the rest fills the sum is
found by one ordered pass over the sources).  A source with target/size = c gives every document
floor(c) certain copies.  The rest of the target is drawn without replacement: documents are
ranked by the Pareto key, random odds u/(1-u) over inclusion odds p/(1-p) with p the
fraction of c, and taken in that order while that brings the words nearer to the target,
so a source misses its target by half a document at most.

The random number is a hash of the id, so reruns agree.  A source is never sorted whole:
all its documents have one p, so the key grows with u; words are summed in ``BINS`` equal
bins of u, and only the bin in which the draw ends is ranked.  What results is one cut
per source, which every document is held against where it is read.

Cases: null and empty texts have size 0 and take 0; a null source is a source; a null id is the
empty string to the hash; repeated rows are drawn together; an empty table gives no rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from migscope.llm.text import WORD, stored

SHARE, MOST, WEIGHTS = 1.5, 2, (5, 2, 1)
BINS = 65536
#: Sources (one row of numbers each) up to which their table is broadcast; beyond it the join shuffles.
BROADCAST_SOURCES = 200_000
SEED = "mix"


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str):
    """The columns of the draw: source, size, id, h, u and bin."""
    name = F.concat(F.lit(SEED), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    u = (F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("long") + 0.5) / F.lit(float(1 << 52))
    return {"_source": F.col(source_col).cast("string"), "_size": F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long"),
            "_id": F.col(id_col).cast("long"), "_h": F.xxhash64(F.col(text_col)), "_u": u, "_bin": F.floor(u * BINS).cast("int")}


def targets(sources: DataFrame, share: float = SHARE, most: int = MOST, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, n) -> (source, n, target); a row a source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    all_rows = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = sources.select("source", "n", weight.alias("w"), (F.lit(share) * F.sum("n").over(all_rows)).alias("total"), (F.lit(float(most)) * F.col("n")).alias("cap"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    s = s.select("*", F.coalesce(F.sum("cap").over(before), F.lit(0.0)).alias("before"), F.sum("w").over(rest).alias("rest"))
    s = s.select("*", ((F.col("total") - F.col("before")) * F.col("w") >= F.col("cap") * F.col("rest")).alias("full"))
    level = (F.col("total") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(all_rows)) / F.sum(F.when(~F.col("full"), F.col("w"))).over(all_rows)
    return s.select("source", "n", F.when(F.col("full"), F.col("cap")).otherwise(F.col("w") * level).alias("target"))


def cuts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """What the draw needs to know, a row a source: n, target, copies, edge (the bin in which
    the draw ends) and last (the last document taken in it)."""
    own = sized(docs, id_col, text_col, source_col)
    rows = docs.select(*[c.alias(n) for n, c in own.items()])
    bins = rows.groupBy("_source", "_bin").agg(F.sum("_size").alias("n")).select(F.col("_source").alias("source"), F.col("_bin").alias("bin"), "n")
    goal = targets(bins.groupBy("source").agg(F.sum("n").alias("n"))) \
        .select("source", "n", "target", F.when(F.col("n") > 0, F.floor(F.col("target") / F.col("n"))).otherwise(0).cast("int").alias("copies"))
    goal = goal.select("*", (F.col("target") - F.col("copies") * F.col("n")).alias("left"))
    goal = goal.select("*", F.when(F.col("n") > 0, F.col("left") / F.col("n")).otherwise(0.0).alias("p"))
    running = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    b = bins.withColumn("upto", F.sum("n").over(running))
    g, edges = goal.select(F.col("source").alias("s"), "left"), b
    edges = edges.join(g, edges.source.eqNullSafe(g.s)).where(F.col("upto") > F.col("left")) \
        .groupBy("source").agg(F.min(F.struct("bin", (F.col("upto") - F.col("n")).alias("before"))).alias("e")) \
        .select(F.col("source").alias("s"), F.col("e.bin").alias("edge"), F.col("e.before").alias("before"))
    goal = goal.join(edges, goal.source.eqNullSafe(edges.s), "left").drop("s")

    inside = near(rows, goal.where("p > 0").select(F.col("source").alias("s"), "edge", "before", "left", "p"), F.col("_source").eqNullSafe(F.col("s")) & (F.col("_bin") == F.col("edge")))
    key = (F.col("_u") / (1 - F.col("_u"))) / (F.col("p") / (1 - F.col("p")))
    each = inside.groupBy("_source", "before", "left", key.alias("key"), "_id", "_h").agg(F.sum("_size").alias("n"))
    ranked = Window.partitionBy("_source").orderBy("key", "_id", "_h").rowsBetween(Window.unboundedPreceding, -1)
    last = each.withColumn("ahead", F.col("before") + F.coalesce(F.sum("n").over(ranked), F.lit(0))) \
        .where(F.col("ahead") + F.col("n") / 2 <= F.col("left")) \
        .groupBy("_source").agg(F.max(F.struct("key", "_id", "_h")).alias("last")).select(F.col("_source").alias("s"), "last")
    return goal.join(last, goal.source.eqNullSafe(last.s), "left").drop("s")


def near(rows: DataFrame, sources: DataFrame, on, how: str = "inner") -> DataFrame:
    """Join with the table of sources, which is broadcast if it is small."""
    small = sources.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    return rows.join(F.broadcast(sources) if small else sources, on, how)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(row: all columns of ``docs``, size, source_size, target, copies: 0, 1 or 2)."""
    plan = stored(cuts(docs, id_col, text_col, source_col), "mix-cuts").select(
        F.col("source").alias("_s"), F.col("n").alias("source_size"), "target", F.col("copies").alias("whole"), "p", "edge", "last")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), *[c.alias(n) for n, c in sized(docs, id_col, text_col, source_col).items()])
    rows = near(rows, plan, F.col("_source").eqNullSafe(F.col("_s")))
    key = (F.col("_u") / (1 - F.col("_u"))) / (F.col("p") / (1 - F.col("p")))
    drawn = (F.col("p") > 0) & ((F.col("_bin") < F.col("edge")) | F.col("edge").isNull()
                                | ((F.col("_bin") == F.col("edge")) & F.coalesce(F.struct(key.alias("key"), "_id", "_h") <= F.col("last"), F.lit(False))))
    return rows.select("row", F.col("_size").alias("size"), "source_size", "target", (F.col("whole") + F.when(drawn, 1).otherwise(0)).alias("copies"))


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken; all columns."""
    mixed = mix(docs, id_col, text_col, source_col).where("copies > 0")
    return mixed.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def digest(docs: DataFrame) -> DataFrame:
    return mix(docs.select("doc_id", "text", "source")).select(
        "row.doc_id", "row.source", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), F.col("copies").cast("int").alias("copies"))


SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         (CAST('0x' || substr(md5('mix' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS DOUBLE) AS n, CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS w
  FROM d GROUP BY source),
r AS (
  SELECT source, n, w, 2.0::DOUBLE * n AS cap, 1.5::DOUBLE * sum(n) OVER () AS total,
         coalesce(sum(2.0::DOUBLE * n) OVER (ORDER BY 2.0::DOUBLE * n / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         sum(w) OVER (ORDER BY 2.0::DOUBLE * n / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
  FROM s),
f AS (SELECT *, (total - before) * w >= cap * rest AS filled FROM r),
t AS (
  SELECT source, n, CASE WHEN filled THEN cap ELSE w * ((total - sum(CASE WHEN filled THEN cap ELSE 0 END) OVER ()) / sum(CASE WHEN NOT filled THEN w END) OVER ()) END AS target
  FROM f),
c AS (SELECT source, n, target, CASE WHEN n > 0 THEN floor(target / n) ELSE 0 END AS whole FROM t),
p AS (SELECT *, target - whole * n AS rest, CASE WHEN n > 0 THEN (target - whole * n) / n ELSE 0 END AS p FROM c),
k AS (
  SELECT d.doc_id, d.source, d.size, p.n, p.target, p.whole, p.rest, p.p,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY CASE WHEN p.p > 0 THEN (d.u / (1 - d.u)) / (p.p / (1 - p.p)) ELSE 0 END, d.doc_id
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, source, size, CAST(n AS BIGINT) AS source_size, target,
       CAST(size * (whole + CASE WHEN p > 0 AND ahead + size / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken,
       CAST(whole + CASE WHEN p > 0 AND ahead + size / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END AS INTEGER) AS copies
FROM k
"""
