"""Windows of texts that occur again, by anchors.  Shared by the two repeat finders.

An operator cuts its texts into anchors: (k, c, id, h, span) stands for neighbouring windows of a
text; ``k`` is the name of what all windows with this anchor share, ``c`` the name of all
their content.  Equal windows have equal ``k`` and the same place in it, which the operator
guarantees.  So

* occurrences with one (k, c) repeat each other in all their windows, without a look at any;
* only where one ``k`` has several ``c`` smaller pieces are compared: blocks of windows with a
  larger common part, then single windows, of one occurrence a (k, c).

The anchors of all texts cross the network once, by ``k``, and are told apart by sorted
windows, which spill.  Names that a very common passage gives to a great part of the rows are
found in a sample beforehand; their rows are summed up before they are shuffled, and join the sums
in skew-split joins.  What follows has as many rows as there are borders of repeats."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from migscope.llm.text import column, partitions, stored

ANCHOR = "k long, c long, id long, h long, span long"
BLOCK = ANCHOR + ", m int"
#: One of so many texts is looked at for very common names.
SAMPLE = 64


def pack(at: np.ndarray, n: np.ndarray, place: np.ndarray) -> np.ndarray:
    """``n`` windows from ``at`` on, whose anchor is ``place - at`` further, as one number."""
    return (at.astype(np.int64) << 30) | (n.astype(np.int64) << 15) | (place - at).astype(np.int64)


def unpack(span: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(at, n, place)."""
    at = span >> 30
    return at, (span >> 15) & 0x7FFF, at + (span & 0x7FFF)


def repeated_windows(rows: DataFrame, anchors: DataFrame, blocks: Callable, steps: tuple[int, ...], earlier: bool) -> DataFrame:
    """(id, h, spans): windows of each text that start in a text with a smaller id (``earlier``)
    or at any other place.  ``blocks(width)`` maps batches of (id, h, text, asked: span, m) to
    blocks of ``width`` windows; the last of ``steps`` is 1, single windows."""
    known = placed(stored(anchors.withColumn("m", F.lit(1)), "anchors"), earlier)
    spans = known.where("whole").select("id", "h", "span")
    for width in steps:
        asked = known.where("ask").groupBy("id", "h").agg(F.collect_list(F.struct("span", "m")).alias("asked"))
        parts = stored(rows.join(asked, ["id", "h"]).select("id", "h", "text", "asked").mapInArrow(blocks(width), BLOCK), "blocks")
        if width > 1:
            known = placed(parts, earlier)
            found = known.where("whole")
        else:
            sums = parts.groupBy("k", "c").agg(F.min("id").alias("low"), F.sum("m").alias("total"))
            found = parts.join(sums, ["k", "c"]).where("id > low" if earlier else "total > 1")
        spans = spans.union(found.select("id", "h", "span"))
    return spans.groupBy("id", "h").agg(F.collect_list("span").alias("spans"))


def hot_names(anchors: DataFrame) -> DataFrame:
    """(k): names that have more than a quarter of a partition's rows in a sample of the texts; at
    most four times as many as there are partitions."""
    seen = stored(anchors.where(F.pmod(F.xxhash64("id", "h"), F.lit(SAMPLE)) == 0).groupBy("k").agg(F.count(F.lit(1)).alias("n")), "hot")
    total = seen.agg(F.sum("n").alias("n")).collect()[0]["n"] or 0
    return seen.where(F.col("n") >= max(8, total // (4 * partitions(anchors.sparkSession)))).select("k")


def placed(anchors: DataFrame, earlier: bool) -> DataFrame:
    """The anchors whose name occurs again: ``whole`` if all their windows repeat, ``ask`` if parts of
    them must be compared (``m``: 2 if their content occurs again)."""
    hot = F.broadcast(hot_names(anchors))
    few = anchors.join(hot, "k", "left_anti").repartition(partitions(anchors.sparkSession), "k").sortWithinPartitions("k", "c", "id", "h", "span")
    name, content = Window.partitionBy("k"), Window.partitionBy("k", "c")
    again = F.min("id").over(name) < F.max("id").over(name) if earlier else F.sum("m").over(name) > 1
    few = few.withColumn("again", again).withColumn("several", F.min("c").over(name) < F.max("c").over(name)).where("again")
    first = F.lit(True) if earlier else F.row_number().over(content.orderBy("id", "h", "span")) == 1
    few = few.withColumn("first", first).withColumn("low", F.min("id").over(content)).withColumn("total", F.sum("m").over(content))

    many = anchors.join(hot, "k")
    names = many.groupBy("k").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.min("c").alias("c1"), F.max("c").alias("c2"), F.sum("m").alias("all"))
    names = names.where("low < high" if earlier else "`all` > 1").select("k", F.expr("c1 < c2").alias("several"))
    place = F.struct("id", "h", "span")
    sums = many.groupBy("k", "c").agg(F.min("id").alias("low"), F.sum("m").alias("total"), *([] if earlier else [F.min(place).alias("at")]))
    # Stored, so that both sides of the join are plain exchanges, of which a skewed one is split.
    many = many.join(F.broadcast(names), "k").join(stored(sums, "hot-sums"), ["k", "c"]).withColumn("first", F.lit(True) if earlier else F.col("at") == place)

    columns = ["id", "h", "span", "several", "first", "low", "total"]
    both = few.select(columns).union(many.select(columns))
    whole = F.col("id") > F.col("low") if earlier else F.col("total") > 1
    ask = F.col("several") & (F.col("id") == F.col("low") if earlier else F.col("first"))
    both = both.select("id", "h", "span", F.least("total", F.lit(2)).cast("int").alias("m"), whole.alias("whole"), ask.alias("ask"))
    return stored(both.where("whole or ask"), "repeats")


def asked(batch: pa.RecordBatch, begin: np.ndarray, width: int, size: int) -> tuple[np.ndarray, ...]:
    """(first window, number of windows, begin of their common part, its end, place of the anchor, m,
    row) of the blocks that a batch's rows are asked for.  Blocks lie ``width`` apart from
    the anchor on, so equal windows are in blocks with the same common part."""
    lists = column(batch, "asked")
    doc = np.repeat(np.arange(batch.num_rows), np.asarray(lists.value_lengths()))
    span, m = (f.to_numpy() for f in lists.flatten().flatten())
    at, n, place = unpack(span)
    at, place = at + begin[doc], place + begin[doc]
    near, far = (place - at - n + 1) // width, (place - at) // width  # numbers of the blocks, from the anchor to the left
    many = far - near + 1
    number = np.repeat(far, many) - (np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many))
    doc, m, place, at, last = (np.repeat(x, many) for x in (doc, m, place, at, at + n - 1))
    right, left = place - number * width, place - number * width - width + 1
    first = np.maximum(at, left)
    return first, np.minimum(last, right) - first + 1, right, left + size, place, m, doc


def cover(spans, size: int, length: int) -> np.ndarray:
    """Which of ``length`` places the windows of the spans cover."""
    edge = np.zeros(length + 1, np.int64)
    if spans is not None:
        at, n, _ = unpack(spans.to_numpy())
        np.add.at(edge, at, 1)
        np.add.at(edge, np.minimum(at + n - 1 + size, length), -1)
    return np.cumsum(edge[:-1]) > 0


def batch_of(batch: pa.RecordBatch, doc: np.ndarray, begin: np.ndarray, name: np.ndarray, content: np.ndarray, at: np.ndarray, n: np.ndarray, place: np.ndarray, m=None) -> pa.RecordBatch:
    take = lambda c: pa.array(column(batch, c).to_numpy(zero_copy_only=False)[doc])
    out = [pa.array(name.view(np.int64)), pa.array(content.view(np.int64)), take("id"), take("h"), pa.array(pack(at - begin[doc], n, place - begin[doc]))]
    return pa.RecordBatch.from_arrays([*out, *([] if m is None else [pa.array(m.astype(np.int32))])], ["k", "c", "id", "h", "span", *([] if m is None else ["m"])])
