"""Session helpers.

The library never creates machine-local scratch space on a cluster: when lineage
has to be cut it uses ``spark.checkpoint.dir`` from the running session, and
fails if a cluster names none.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, partitions: int = 8, app: str = "migscope") -> SparkSession:
    """Session for tests and the bench; on a cluster use the existing session."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        b = b.master(master).config("spark.driver.memory", "16g")
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder named by the cluster (``spark.checkpoint.dir``).  Only a
    session whose executors share the driver's disk (``local``) may do without one."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        d = tempfile.mkdtemp(prefix="migscope-ckpt-")
        spark.sparkContext.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}/{uuid.uuid4().hex}"


def materialize(df):
    """Cut lineage: write ``df`` as a parquet table under the shared checkpoint
    folder and read it back, so a result that several branches read is computed
    once and survives the loss of executors (never a local checkpoint).
    Parquet keeps it columnar; later reads prune columns and push filters.
    ``forget_materialized`` deletes what a session has written."""
    spark = df.sparkSession
    path = scratch_path(spark, "materialized")
    df.write.mode("overwrite").parquet(path)
    WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


WRITTEN: list[str] = []


def forget_materialized(spark: SparkSession) -> None:
    """Delete the tables that ``materialize`` wrote in this session (their results are used up)."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while WRITTEN:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(WRITTEN.pop())
        path.getFileSystem(conf).delete(path, True)
