"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import os
import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the SQL side: runs of anything but the six ASCII white-space bytes.
WORD = r"[^\x20\x09-\x0D]+"
#: A null id sorts after every other id.
LAST = (1 << 63) - 1


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; a folder under the
    temporary directory only where the session names none (local tests)."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        d = tempfile.mkdtemp(prefix="migscope-llm-")
        spark.sparkContext.setCheckpointDir(d)
    return d.rstrip("/")


#: Paths under the shared folder that this session made.
WRITTEN: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    WRITTEN.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return WRITTEN[-1]


def forget_stored(spark: SparkSession) -> None:
    """Delete what ``stored`` and the token files of this session wrote, once their results are used up."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while WRITTEN:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(WRITTEN.pop())
        path.getFileSystem(conf).delete(path, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: lineage ends there, and
    the loss of an executor costs no earlier work."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, h, text) alone, so extra columns of any name do no harm.  ``h`` tells rows of one
    id with different texts apart; a null id becomes the last one."""
    return df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).cast("string").alias("text"))


def without(docs: DataFrame, gone: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` without the rows named by (id, h) in ``gone``; all columns."""
    g = gone.select(F.col("id").alias("_gone_id"), F.col("h").alias("_gone_h"))
    key = F.coalesce(docs[id_col].cast("long"), F.lit(LAST))
    return docs.join(g, (key == g["_gone_id"]) & (F.xxhash64(docs[text_col]) == g["_gone_h"]), "left_anti")


def id_back(col: str, name: str):
    return F.when(F.col(col) != LAST, F.col(col)).alias(name)


def raw(column) -> list[bytes]:
    """The rows of an Arrow string column as UTF-8 bytes, null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with about ``limit`` bytes of text each, at least one row: what a
    task holds at once follows the longest text and not the number of rows in a batch."""
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, min(2048, batch.num_rows - at))
            texts = raw(part.column(part.schema.get_field_index(column)))
            n, size = 0, 0
            while n < len(texts) and (n == 0 or size + len(texts[n]) <= limit):
                size += len(texts[n])
                n += 1
            yield part.slice(0, n), texts[:n]
            at += n


def column(batch: pa.RecordBatch, name: str):
    return batch.column(batch.schema.get_field_index(name))


def _kept() -> dict:
    return vars(sys.modules.setdefault("_migscope_llm_kept", types.ModuleType("_migscope_llm_kept")))


def kept_by_worker(key: str, make: Callable):
    """What ``make`` gives, made once in a Python worker and kept for its next tasks, until a task
    asks for something else: a worker holds one such thing at a time."""
    store = _kept()
    if key not in store:
        let_go()
        store[key] = make()
    return store[key]


def let_go() -> None:
    """Free what earlier tasks left in this worker; for tasks that keep nothing but hold much themselves."""
    store = _kept()
    for name in [n for n in store if not n.startswith("__")]:
        del store[name]


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def tokenizer_path(name: str) -> str:
    """A file of the installed public tokenizers; callers may pass any other path."""
    if os.sep in name:
        return name
    import public_tokenizers
    return public_tokenizers.path(name)


def bounds(lengths) -> np.ndarray:
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out
