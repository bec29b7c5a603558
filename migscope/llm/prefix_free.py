"""Suffix-array dedup by prefix-free parsing: repeated byte strings of a whole corpus.

Triggers of a rolling hash over ``GRAM`` bytes cut the texts into phrases: a place is one if its
hash is the least (leftmost of equals) of the ``reach + 1`` places from some start, so every window
of ``size`` bytes has a trigger among its first ``reach + 1`` places, and equal windows have
it at the same one.  The dictionary is the set of distinct phrases with what follows them up
to ``size`` bytes; the parse is their occurrences.  In the suffix order of the corpus two
places have ``size`` common bytes exactly if their windows are equal, and only that is asked
here, so equal names stand for equal ranks: occurrences of one dictionary entry repeat each
other in all their windows; entries that agree in the ``size - reach`` bytes after the trigger are
compared by blocks of windows, then window by window, once an entry (``repeats``).  Highly repetitive text therefore
costs its dictionary, not its length.

Cases: null and empty texts have no bytes; texts shorter than ``size`` lose none; null ids and
repeated rows are texts like others (a repeated row repeats the first); an empty table
gives no rows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from migscope.llm.recompress import Rolling, block_batch
from migscope.llm.repeats import ANCHOR, batch_of, cover, repeated_windows
from migscope.llm.text import bounds, column, id_back, keyed, mix, pieces

SIZE, GRAM, REACH = 400, 8, 192
#: Bits for a place in a call's texts, which an Arrow string keeps under 2**31; the others are the hash's.
PLACE_BITS = 32
#: Widths of the blocks in which windows are compared where names meet different content.
STEPS = (16, 1)
SYMBOLS = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def gram_hashes(data: bytes) -> np.ndarray:
    """A hash of the ``GRAM`` bytes from every place."""
    grams = np.ndarray(len(data), "<u8", data + bytes(GRAM), strides=(1,))
    h = grams * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h


def parse(data: bytes, begin: np.ndarray, size: int, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(trigger, first window, number of windows) of the anchors of texts ``data[begin[k]:begin[k + 1]]``."""
    valid = np.zeros(len(data) + 1, np.int8)
    some = np.flatnonzero(np.diff(begin) >= size)
    np.add.at(valid, begin[some], 1)
    np.add.at(valid, begin[some + 1] - size + 1, -1)
    starts = np.flatnonzero(np.cumsum(valid[:-1], dtype=np.int8) > 0)
    if not len(starts):
        return starts, starts, starts
    bits = np.uint64(PLACE_BITS)  # the same for every call: what ties in one text ties in all
    least = (gram_hashes(data) >> bits << bits) | np.arange(len(data), dtype=np.uint64)
    width = 1
    while width <= reach:  # the least of ever wider stretches, up to reach + 1 places
        step = min(width, reach + 1 - width)
        least = np.minimum(least[:len(least) - step], least[step:])
        width += step
    t = (least[starts] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    new = np.ones(len(t), bool)
    new[1:] = (t[1:] != t[:-1]) | (starts[1:] != starts[:-1] + 1)
    lead = np.flatnonzero(new)
    return t[lead], starts[lead], np.diff(np.append(lead, len(starts)))


def text_bounds(texts: list[bytes]) -> tuple[bytes, np.ndarray]:
    return b"".join(texts), bounds([len(t) for t in texts])


def rolled(data: bytes) -> Rolling:
    return Rolling(SYMBOLS[np.frombuffer(data, np.uint8)])


def anchors_of(size: int, reach: int):
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, "text", 1 << 18):
            data, begin = text_bounds(texts)
            t, first, count = parse(data, begin, size, reach)
            rolling = rolled(data)
            content = mix(rolling.names(first, first + count - 1 + size) + (t - first).astype(np.uint64) * np.uint64(65537) + count.astype(np.uint64))
            doc = np.searchsorted(begin, first, "right") - 1
            yield batch_of(batch, doc, begin, rolling.names(t, t + size - reach), content, first, count, t)

    return made


def blocks_of(size: int):
    def of(width: int):
        def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, texts in pieces(batches, "text", 1 << 18):
                data, begin = text_bounds(texts)
                yield block_batch(batch, begin, rolled(data), width, size)

        return made

    return of


def dedup(docs: DataFrame, size: int = SIZE, reach: int = REACH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, removed, kept) of every row: removed byte ranges (first, end), and the
    remaining bytes, which need not be whole characters."""
    rows = keyed(docs, id_col, text_col)
    kind = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, "text"):
            spans = column(batch, "spans")
            gone, removed, out = [], [], []
            for k, t in enumerate(texts):
                if not spans[k].is_valid:
                    gone.append(0)
                    removed.append([])
                    out.append(t)
                    continue
                dead = np.concatenate([[False], cover(spans[k].values, size, len(t)), [False]])
                first, end = np.flatnonzero(dead[1:] & ~dead[:-1]), np.flatnonzero(~dead[1:] & dead[:-1])
                gone.append(int((end - first).sum()))
                removed.append([{"first": a, "end": b} for a, b in zip(first.tolist(), end.tolist(), strict=True)])
                out.append(np.frombuffer(t, np.uint8)[~dead[1:-1]].tobytes())
            yield pa.RecordBatch.from_arrays([column(batch, "id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(gone, pa.int64()), pa.array(removed, kind),
                                              pa.array(out, pa.binary()), pa.array([hashlib.sha256(x).hexdigest() for x in out])], ["id", "n_bytes", "n_removed", "removed", "kept", "kept_sha256"])

    spans = repeated_windows(rows, rows.mapInArrow(anchors_of(size, reach), ANCHOR), blocks_of(size), STEPS, earlier=False)
    out = rows.join(spans, ["id", "h"], "left").select("id", "text", "spans") \
        .mapInArrow(kept, "id long, n_bytes long, n_removed long, removed array<struct<first:long,end:long>>, kept binary, kept_sha256 string")
    return out.select(id_back("id", id_col), "n_bytes", "n_removed", "removed", "kept", "kept_sha256")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return found.select(id_col, "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), "kept_sha256")
