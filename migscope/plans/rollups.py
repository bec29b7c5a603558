"""Kept roll-ups of a portfolio (S14): project totals that follow arriving files.

Two versioned tables.  ``files`` holds the last metrics of every program, bucketed by path; ``totals``
holds sums per (project, type).  A refresh compares two versions of ``files``: the buckets whose
folder differs between their manifests are read from both, their old facts are taken off the totals
and their new ones added.  Buckets that did not change are not read, so the work follows the changed
files.  The version that the totals stand for is published with them, in one rename; after a crash
the next refresh starts from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from migscope.functions.text import js_round
from migscope.plans import score as K
from migscope.sources.versioned import VersionedTable

c = F.col
FILE_KEYS = ["project_id", "path"]
GROUP = ["project_id", "type"]
SUMS = ["files", "total_loc", "logic", "data", "risk"]


def file_facts(metrics: DataFrame) -> DataFrame:
    """What the roll-ups need of a program (row of ``cobol_files``, with ``seq`` its place in time)."""
    s = K.cobol_file_scores(metrics)
    return s.select(*FILE_KEYS, "type", c("loc").cast("long").alias("loc"), c("logic_score").cast("long").alias("logic"), c("data_score").cast("long").alias("data"),
                    c("risk_score").cast("long").alias("risk"), c("seq").cast("long").alias("seq"))


def create(spark: SparkSession, facts: DataFrame, files_path: str, totals_path: str, buckets: int | None = None) -> None:
    """Both tables from the facts of all programs (none at first: an empty frame)."""
    latest = facts.groupBy(*FILE_KEYS).agg(F.max(F.struct("seq", *[x for x in facts.columns if x not in [*FILE_KEYS, "seq"]])).alias("r"))
    VersionedTable(spark, files_path).create(latest.select(*FILE_KEYS, "r.*").select(*facts.columns), FILE_KEYS, buckets)
    VersionedTable(spark, totals_path).create(_sums(facts.limit(0)), GROUP, 1)
    refresh(spark, files_path, totals_path)


def upsert(table: VersionedTable, facts: DataFrame, writer: str, batch_id: int) -> None:
    """The facts of one batch of programs, as one version; of a program the greatest ``seq`` counts, in the
    batch and against the table, so uploads may arrive in any order.  A batch applied before is skipped."""
    from migscope.sources.versioned import bucket_of
    m = table.manifest()
    if table.applied(m, writer, batch_id):
        return
    hit = sorted(r.bucket for r in facts.select(bucket_of(m["keys"], m["buckets"]).alias("bucket")).distinct().collect())
    if not hit:
        return
    rest = [x for x in facts.columns if x not in FILE_KEYS]
    both = table.read(m["version"], hit).select(*facts.columns).unionByName(facts)
    latest = both.groupBy(*FILE_KEYS).agg(F.max(F.struct("seq", *[x for x in rest if x != "seq"])).alias("r"))
    table.replace(m, latest.select(*FILE_KEYS, "r.*").select(*facts.columns), hit, writer, batch_id)


def _sums(facts: DataFrame, sign: int = 1) -> DataFrame:
    one = F.lit(sign).cast("long")
    return facts.groupBy(*GROUP).agg(F.sum(one).alias("files"), F.sum(c("loc") * one).alias("total_loc"),
                                     *[F.sum(c(x) * one).alias(x) for x in ("logic", "data", "risk")])


def refresh(spark: SparkSession, files_path: str, totals_path: str) -> int:
    """Bring the totals to the last version of the files; the number of buckets read.  If the version
    they stand for is no longer kept, they are made anew from all files."""
    files, totals = VersionedTable(spark, files_path), VersionedTable(spark, totals_path)
    m, now = totals.manifest(), files.manifest()
    at = m["batches"].get("files", 0)
    if at == now["version"]:
        return 0
    old = files.manifest(at) if at in files.versions() else None
    changed = [int(b) for b in {*now["where"], *(old or now)["where"]} if not old or old["where"].get(b) != now["where"].get(b)]
    delta = _sums(files.read(now["version"], changed))
    if old:
        before = [int(b) for b in old["where"] if int(b) in set(changed)]
        delta = delta.unionByName(totals.read(m["version"])).unionByName(_sums(files.read(at, before), -1))
    new = delta.groupBy(*GROUP).agg(*[F.sum(x).alias(x) for x in SUMS]).where("files > 0")
    totals.replace(m, new, [0], "files", now["version"])
    return len(changed)


def totals(spark: SparkSession, totals_path: str) -> DataFrame:
    """M1: files and LOC per project."""
    t = VersionedTable(spark, totals_path).read()
    return t.groupBy("project_id").agg(F.sum("files").cast("long").alias("total_files"), F.sum("total_loc").cast("long").alias("total_loc"))


def type_distribution(spark: SparkSession, totals_path: str) -> DataFrame:
    """M3 from the totals."""
    from pyspark.sql import Window
    t = VersionedTable(spark, totals_path).read()
    whole = F.sum("files").over(Window.partitionBy("project_id"))
    return t.select("project_id", "type", c("files").alias("count"), F.floor(c("files").cast("double") / whole * 100 + 0.5).cast("long").alias("percentage"))


def project_scores(spark: SparkSession, totals_path: str) -> DataFrame:
    """K5 from the totals: the rounded means of the file scores and the weighted overall."""
    t = VersionedTable(spark, totals_path).read().groupBy("project_id").agg(*[F.sum(x).alias(x) for x in SUMS])
    mean = lambda x: js_round(c(x).cast("double") / c("files"))
    s = t.select("project_id", "files", "total_loc", mean("logic").alias("logic_score"), mean("data").alias("data_score"), mean("risk").alias("risk_score"))
    overall = js_round(c("logic_score") * 0.35 + c("data_score") * 0.35 + c("risk_score") * 0.30)
    return s.withColumn("overall", overall).withColumn("difficulty", K.difficulty(c("overall")))
