"""Corpus scan, extension selection, admission, last-upload-wins and line explode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from migscope.functions.text import basename
from migscope.plans.rules import admission_rules

c = F.col


def read_corpus(spark: SparkSession, root: str, glob: str | None = None, with_content: bool = True) -> DataFrame:
    """Every file under ``root/<project_id>/...`` as a row.  ``binaryFile``
    lists and reads in parallel; a listing-only query (``with_content=False``)
    never touches the bytes (column pruning of the binary source).  ``glob`` is
    the case-sensitive pathGlobFilter (S2 at scan time).  Invalid UTF-8 becomes
    U+FFFD instead of failing the portfolio."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        r = r.option("pathGlobFilter", glob)
    df = r.load(root)
    rel = relative_path(c("path"), root)
    name = basename(rel)
    cols = [project_of(rel).alias("project_id"), rel.alias("path"), name.alias("file_name"),
            F.regexp_replace(name, r"\.[^.]*$", "").alias("base_name"),
            F.regexp_extract(name, r"(\.[^.]*)$", 1).alias("ext"),
            c("length").alias("size"), c("modificationTime").alias("modified")]
    if with_content:
        cols.append(F.make_valid_utf8(c("content").cast("string")).alias("content"))
    return df.select(*cols)


#: Splits up to which their table (a row of numbers each) is broadcast.
BROADCAST_SPLITS = 1_000_000


def read_lines(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """S1 and S8 for files of any size: (project_id, path, line_no, line), the lines that ``to_lines`` has for
    ``read_corpus``, without a row that holds a file.  The text source reads splits, so one file is read by
    many tasks, whatever its size.  A line's number is its place in its split, plus the lines
    of the file's splits before it: lines are written once with their split's start
    (``_metadata.file_block_start``) and a running id; one small row a split holds its first id and its
    number of lines, and one window per file sums these.  No line is shuffled."""
    from migscope.session import materialize
    read = spark.read.option("recursiveFileLookup", "true")
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        read, listing = read.option("pathGlobFilter", glob), listing.option("pathGlobFilter", glob)
    # The metadata column holds a URL; a plus sign in it is a plus sign.
    path = F.url_decode(F.replace(c("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    raw = read.option("lineSep", "\n").text(root).select(
        relative_path(path, root).alias("path"), c("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), "value")
    raw = materialize(raw)
    # The ids of a split's lines follow one another; files differ in their paths.
    splits = raw.groupBy("path", "block").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"), F.sum(F.octet_length("value").cast("long") + 1).alias("bytes"))
    splits = materialize(splits)
    size = listing.load(root).select(relative_path(c("path"), root).alias("path"), "length")
    files = size.join(splits.groupBy("path").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes")), "path", "left").fillna(0, ["n", "bytes"])
    # The source drops a byte order mark at the start, and gives no last line after a final line feed:
    # both follow from the bytes that are there and those that came.
    more = c("length") - c("bytes")
    files = materialize(files.select("path", "n", ((more >= 2) & (more <= 3)).alias("bom"), ((more == 0) | (more == 3) | (c("n") == 0)).alias("ends")))
    upto = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("path", "block", "first", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before")).join(files.select("path", "bom"), "path")
    small = splits.limit(BROADCAST_SPLITS + 1).count() <= BROADCAST_SPLITS
    rows = raw.join(F.broadcast(splits) if small else splits, ["path", "block"])
    rows = rows.select("path", (c("id") - c("first") + c("before") + 1).alias("line_no"), "bom", "value")
    last = files.where("ends").select("path", (c("n") + 1).alias("line_no"), "bom", F.lit("").alias("value"))
    mark = F.when(c("bom") & (c("line_no") == 1), "\ufeff").otherwise("")
    return rows.union(last).select(project_of(c("path")).alias("project_id"), "path", "line_no", F.make_valid_utf8(F.concat(mark, "value")).alias("line"))


def relative_path(path: Column, root: str) -> Column:
    """``path`` below ``root`` (batch and stream share it)."""
    root_re = root.rstrip("/").replace("\\", "/").split("://")[-1]
    return F.regexp_replace(path, r"^.*?" + _re_escape(root_re) + "/", "")


def project_of(rel: Column) -> Column:
    """The first folder of a relative path."""
    return F.regexp_extract(rel, r"^([^/]+)/", 1)


def _re_escape(s: str) -> str:
    import re
    return re.escape(s)


def select_kind(files: DataFrame, suffixes: list[str]) -> DataFrame:
    """Case-sensitive ``endsWith`` selection at analysis time."""
    cond = None
    for s in suffixes:
        e = c("path").endswith(s)
        cond = e if cond is None else cond | e
    return files.where(cond)


def admit(files: DataFrame, projects: DataFrame) -> DataFrame:
    """S3: admission flag per file: the lower-cased name ends with one of the
    extensions of the project's migration type; an unknown type admits all.
    The 4-row rule table is broadcast."""
    rules = F.broadcast(admission_rules(files.sparkSession))
    j = files.join(projects.select("project_id", "migration_type"), "project_id", "left") \
        .join(rules, "migration_type", "left")
    ok = F.exists("exts", lambda e: F.lower(c("file_name")).endswith(e))
    return j.withColumn("admitted", F.coalesce(ok, F.lit(True))).drop("exts")


def admission_report(admitted: DataFrame, k: int = 10) -> DataFrame:
    """Valid and skipped counts per project and the first k skipped names in
    name order (a per-project top-k, never the whole list)."""
    counts = admitted.groupBy("project_id").agg(
        F.count_if("admitted").alias("valid_files"), F.count_if(~c("admitted")).alias("skipped_files"))
    w = Window.partitionBy("project_id").orderBy("file_name", "path")
    first = admitted.where(~c("admitted")).withColumn("rk", F.row_number().over(w)).where(c("rk") <= k) \
        .groupBy("project_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rk", "file_name"))),
                                                            lambda s: s["file_name"]), ", ").alias("first_skipped"))
    return counts.join(first, "project_id", "left").select(
        "project_id", c("valid_files").cast("long"), c("skipped_files").cast("long"),
        F.coalesce(c("first_skipped"), F.lit("")).alias("first_skipped"))


def latest_files(uploads: DataFrame, ts: str = "upload_ts") -> DataFrame:
    """A file stored under its name overwrites earlier uploads of the same
    name in the project (folders are not kept).  The latest upload per
    (project, file_name) is a ``max_by`` hash aggregate -- partial aggregation
    makes a name uploaded a billion times cheap."""
    cols = [x for x in uploads.columns if x not in ("project_id", "file_name")]
    g = uploads.groupBy("project_id", "file_name").agg(
        F.max_by(F.struct(*[c(x) for x in cols]), F.struct(c(ts), c("path"))).alias("r"))
    return g.select("project_id", "file_name", "r.*")


def to_lines(files: DataFrame) -> DataFrame:
    """One row per line (``split`` on \\n; a trailing newline gives a last
    empty line, as in the rules).  Line numbers are 1-based."""
    return files.select("project_id", "path", F.posexplode(F.split("content", "\n", -1)).alias("i", "line")) \
        .select("project_id", "path", (c("i") + 1).cast("int").alias("line_no"), "line")
