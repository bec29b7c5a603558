"""Structured Streaming twins of the batch operators.

- ``stream_corpus``   S14: files landing in a folder are mined as they arrive
  (``text`` source, ``wholetext``), per-file metrics written by ``foreachBatch``.
- ``stream_delta``    V17: change records arriving as files are applied to the
  base table batch by batch with the rules of the batch job (``apply_delta``).
- ``stream_alerts``   V20: watermarked tumbling-window alerting over an event
  stream; the batch twin is ``operators.validate.alerts`` itself.

All queries take a checkpoint location (exactly-once bookkeeping and restart
after executor or driver loss) and work with ``trigger(availableNow=True)`` for
incremental batch runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from migscope.operators import cobol as C
from migscope.operators import validate as V
from migscope.plans import rollups as RU
from migscope.sources.corpus import project_of, relative_path, to_lines
from migscope.sources.versioned import VersionedTable, bucket_of


def read_landing(spark: SparkSession, root: str, glob: str = "*", max_files: int | None = None, with_time: bool = False) -> DataFrame:
    """Stream of whole files under ``root/<project_id>/...``: (project_id, path, content), with ``seq`` the
    file's modification time in microseconds if asked for."""
    r = spark.readStream.format("text").option("wholetext", "true").option("recursiveFileLookup", "true") \
        .option("pathGlobFilter", glob)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    # The metadata column holds a URL; a plus sign in it is a plus sign.
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    time = [F.unix_micros("_metadata.file_modification_time").alias("seq")] if with_time else []
    df = r.load(root).select(relative_path(path, root).alias("path"), F.col("value").alias("content"), *time)
    return df.select(project_of(F.col("path")).alias("project_id"), "path", "content", *["seq" for _ in time])


def stream_corpus(spark: SparkSession, root: str, sink: str, checkpoint: str, available_now: bool = True):
    """COBOL programs landing under ``root`` -> per-program metrics in the parquet table
    ``sink``, one partition a micro-batch, which a retried batch overwrites.  Read it with
    ``read_metrics``: a program that was uploaded again counts once, as it is now."""
    def process(batch: DataFrame, batch_id: int) -> None:
        C.cobol_files(to_lines(batch)).write.mode("overwrite").parquet(f"{sink.rstrip('/')}/batch_id={batch_id}")
    q = read_landing(spark, root, "*.cbl").writeStream.foreachBatch(process) \
        .option("checkpointLocation", checkpoint)
    q = q.trigger(availableNow=True) if available_now else q.trigger(processingTime="1 minute")
    return q.start()


def stream_portfolio(spark: SparkSession, root: str, files_path: str, totals_path: str, checkpoint: str, available_now: bool = True, max_files: int | None = None):
    """S14 with kept roll-ups: programs landing under ``root/<upload>/<project_id>/...`` -> the ``files`` and ``totals``
    tables of ``plans.rollups`` (made by ``rollups.create``).  Each upload has a folder of its own, as a file source
    reads a path once.  A program's place in time is its file's modification time.  Every batch rewrites the
    buckets of its programs, so there is nothing to compact; a batch that runs again changes nothing."""
    table = VersionedTable(spark, files_path)
    below = F.regexp_replace("path", r"^[^/]+/", "")

    def process(batch: DataFrame, batch_id: int) -> None:
        batch = batch.select(project_of(below).alias("project_id"), below.alias("path"), "seq", "content")
        last = batch.groupBy("project_id", "path").agg(F.max(F.struct("seq", "content")).alias("r")).select("project_id", "path", "r.seq", "r.content")
        metrics = C.cobol_files(to_lines(last)).join(last.select("project_id", "path", "seq"), ["project_id", "path"])
        RU.upsert(table, RU.file_facts(metrics), checkpoint, batch_id)
        RU.refresh(spark, files_path, totals_path)

    q = read_landing(spark, root, "*.cbl", max_files, with_time=True).writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
    q = q.trigger(availableNow=True) if available_now else q.trigger(processingTime="1 minute")
    return q.start()


def read_metrics(spark: SparkSession, sink: str) -> DataFrame:
    """The last metrics of every program in a ``stream_corpus`` sink."""
    rows = spark.read.parquet(sink)
    cols = [x for x in rows.columns if x not in ("project_id", "path", "batch_id")]
    last = rows.groupBy("project_id", "path").agg(F.max_by(F.struct(*cols), "batch_id").alias("r"))
    return last.select("project_id", "path", "r.*")


def write_bucketed(df: DataFrame, keys: list[str], path: str, buckets: int | None = None) -> int:
    """Base table for delta sync: a ``VersionedTable`` bucketed by the hash of its keys, so a change
    batch rewrites only the buckets its keys fall in.  Two columns carry the state of ``apply_delta_state``."""
    state = df.withColumn("_seq", F.lit(None).cast("long")).withColumn("_deleted", F.lit(False))
    return VersionedTable(df.sparkSession, path).create(state, keys, buckets)


def read_bucketed(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows of one version of the base table (the last, unless given), without the state."""
    return VersionedTable(spark, path).read(version).where("not _deleted").drop("_seq", "_deleted")


def apply_delta_batch(table: VersionedTable, changes: DataFrame, writer: str, batch_id: int) -> None:
    """One batch of changes as one version of ``table``.  A batch that ran before, wholly or in
    part, leaves what one run leaves: published batches are noted in the manifest, and what an
    unpublished one wrote is not part of any version."""
    m = table.manifest()
    if table.applied(m, writer, batch_id):
        return
    hit = sorted(r.bucket for r in changes.select(bucket_of(m["keys"], m["buckets"]).alias("bucket")).distinct().collect())
    if hit:
        table.replace(m, V.apply_delta_state(table.read(m["version"], hit), changes, m["keys"]), hit, writer, batch_id)


def stream_delta(spark: SparkSession, changes_dir: str, schema: StructType, base_path: str, keys: list[str],
                 checkpoint: str, available_now: bool = True):
    """Each micro-batch of change files is merged into the versioned base table (see
    ``write_bucketed``) with ``apply_delta_state``: the table keeps the last applied
    sequence of every key and a mark for deleted ones, so a change that arrives after a
    newer one is not applied.  Only the affected buckets are read and written anew; the batch becomes
    visible by one rename, and a reader sees one version.  The driver sees the numbers of the
    affected buckets and the manifest (a path a bucket)."""
    table = VersionedTable(spark, base_path)
    if (have := table.manifest()["keys"]) != keys:
        raise ValueError(f"the table is bucketed by {have}, not {keys}")
    q = spark.readStream.schema(schema).parquet(changes_dir).writeStream \
        .foreachBatch(lambda batch, batch_id: apply_delta_batch(table, batch, checkpoint, batch_id)) \
        .option("checkpointLocation", checkpoint)
    q = q.trigger(availableNow=True) if available_now else q.trigger(processingTime="1 minute")
    return q.start()


def stream_alerts(spark: SparkSession, events_dir: str, schema: StructType, sink: str, checkpoint: str,
                  watermark: str = "5 minutes", available_now: bool = True):
    """One-minute tumbling windows with a watermark; a window is emitted once
    the watermark passes its end (append mode), late rows beyond it are dropped."""
    ev = spark.readStream.schema(schema).parquet(events_dir)
    a = V.alerts(ev, watermark=watermark)
    q = a.writeStream.outputMode("append").format("parquet").option("path", sink) \
        .option("checkpointLocation", checkpoint)
    q = q.trigger(availableNow=True) if available_now else q.trigger(processingTime="1 minute")
    return q.start()


def _episode_processor(silence_ms: int, levels: list[str]):
    """The state of one (series, metric): the open episode, if any, and a timer that closes it.  Defined in here, so
    tasks get its code with the query."""
    from collections.abc import Iterator

    from pyspark.sql import Row
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    class Episodes(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.open = handle.getValueState("open", "raised long, seen long, windows long, rank int")

        def _row(self, key, e, closed: int, reason: str) -> Row:
            import datetime as dt
            at = lambda ms: dt.datetime.fromtimestamp(ms / 1000)
            return Row(series=key[0], metric=key[1], raised_at=at(e[0]), last_seen=at(e[1]), windows=e[2], level=levels[e[3]], closed_at=at(closed), reason=reason)

        def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
            e = tuple(self.open.get()) if self.open.exists() else None
            before = e
            for start, end, rank in sorted((r.start_ms, r.end_ms, r.rank) for r in rows):
                if e and start >= e[1] + silence_ms:  # the timer of a window that came in this batch
                    yield self._row(key, e, e[1] + silence_ms, "no data")
                    e = None
                if e and not rank:
                    yield self._row(key, e, start, "cleared")
                    e = None
                elif rank:
                    e = (e[0], end, e[2] + 1, max(e[3], rank)) if e else (start, end, 1, rank)
            if before and (not e or e[1] != before[1]):
                self.handle.deleteTimer(before[1] + silence_ms)
            if e:
                self.open.update(e)
                if not before or e[1] != before[1]:
                    self.handle.registerTimer(e[1] + silence_ms)
            elif before:
                self.open.clear()

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
            if self.open.exists():
                e = tuple(self.open.get())
                if e[1] + silence_ms <= expiredTimerInfo.getExpiryTimeInMs():
                    self.open.clear()
                    yield self._row(key, e, e[1] + silence_ms, "no data")

        def close(self) -> None:
            pass

    return Episodes()


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_alert_episodes(spark: SparkSession, events_dir: str, schema: StructType, series, sink: str, checkpoint: str, silence_seconds: int,
                          window: str = "1 minute", watermark: str = "5 minutes", limits: dict | None = None, available_now: bool = True):
    """V20 life cycle: an episode is written when it is over (cleared by a window that is OK, or closed by an event-time
    timer when no window came for ``silence_seconds``, a multiple of the window).  State is one small row for each
    open episode.  Windows reach the second operator when the watermark passes their end, hence in
    time order; rows later than the watermark are dropped by the first."""
    rows = V.alert_windows(spark.readStream.schema(schema).parquet(events_dir), series, window=window, watermark=watermark, limits=limits)
    # Times go through the state as milliseconds, so no session's time zone touches them.
    rows = rows.select("series", "metric", F.unix_millis("window_start").alias("start_ms"), (F.unix_millis("window_end") + 1).alias("end_ms"), "rank", "window_end")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)  # timers need it; a query keeps what it starts with
    try:
        out = rows.groupBy("series", "metric").transformWithState(_episode_processor(silence_seconds * 1000, V.LEVELS), V.EPISODE, "Append", "EventTime")
        q = out.writeStream.outputMode("append").format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
        q = q.trigger(availableNow=True) if available_now else q.trigger(processingTime="1 minute")
        return q.start()
    finally:
        if before is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
