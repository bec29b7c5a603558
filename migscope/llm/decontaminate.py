"""Benchmark decontamination: prefix-filtered set join of item windows with documents.

A window is ``size`` consecutive words of an item (a shorter item is one window).  Words are
ordered by rarity in the corpus; as a window must be contained whole, its necessary prefix is its
rarest word alone.  Documents meet the windows at their prefix words only; the word's place
in the window gives the one place where the window can begin (positional bound), it must
lie inside the document (length bound), and its words are then compared one by one.

The benchmark comes to the tasks in blocks of bounded size (``BLOCK`` bytes of text): the block's
words, and its windows indexed on the driver, as flat arrays of 32-bit numbers (a worker holds about 30
bytes a byte of the block).  One block is the usual case, more are passes over the documents
whose hits are united.

Cases: null and empty texts have no words; an item without words or without an id has no
window; repeated items count once; a null document id and repeated rows are kept as they
are; an empty benchmark hits nothing."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from migscope.llm.text import LAST, bounds, column, id_back, keyed, pieces, without
from migscope.llm.toxicity import TABLE

SIZE = 10
BLOCK = 4 << 20
#: Rows that one step of the verification looks at.
STEP = 1 << 20


class Windows:
    """Distinct windows of the items of a block, and the items of each, as flat arrays of 32-bit numbers."""

    def __init__(self, items: list[tuple[str, bytes]], size: int):
        self.items = sorted({i for i, _ in items})
        number = {i: k for k, i in enumerate(self.items)}
        split = [(number[i], text.translate(TABLE).split()) for i, text in items]
        self.vocabulary = {w: k for k, w in enumerate(sorted({w for _, words in split for w in words}))}
        rows, owner = [np.zeros((0, size), np.int32)], [np.zeros(0, np.int64)]
        for i, words in split:
            ids = np.array([self.vocabulary[w] for w in words], np.int32)
            if len(ids):
                short = np.full((1, size), -2, np.int32)
                short[0, :len(ids)] = ids[:size]
                rows.append(np.lib.stride_tricks.sliding_window_view(ids, size) if len(ids) >= size else short)
                owner.append(np.full(len(rows[-1]), i, np.int64))
        every, owner = np.concatenate(rows), np.concatenate(owner)
        key = np.ascontiguousarray(every).view(np.dtype((np.void, 4 * size))).ravel()
        _, at, window = np.unique(key, return_index=True, return_inverse=True)
        self.words = every[at]
        self.length = (self.words != -2).sum(axis=1).astype(np.int32)
        pair = np.unique(window * max(1, len(self.items)) + owner)
        self.of_items = (pair % max(1, len(self.items))).astype(np.int32)
        self.of_first = bounds(np.bincount(pair // max(1, len(self.items)), minlength=len(at))).astype(np.int32)

    @classmethod
    def again(cls, state: dict) -> Windows:
        """From ``vars`` of another one, which is plain data that a broadcast can carry."""
        out = cls.__new__(cls)
        out.__dict__.update(state)
        return out

    def order(self, frequency: np.ndarray) -> None:
        """Index every window by its rarest word."""
        rank = np.empty(len(frequency) + 2, np.int64)
        rank[np.lexsort((np.arange(len(frequency)), frequency))] = np.arange(len(frequency))
        rank[-2:] = LAST  # the filling of short windows
        self.offset = np.zeros(len(self.words), np.int32)
        for lo in range(0, len(self.words), 1 << 16):
            self.offset[lo:lo + (1 << 16)] = rank[self.words[lo:lo + (1 << 16)]].argmin(axis=1)
        prefix = self.words[np.arange(len(self.words)), self.offset]
        self.by_prefix = np.argsort(prefix, kind="stable").astype(np.int32)
        count = np.bincount(prefix, minlength=len(frequency) + 1)
        self.count, self.first = count.astype(np.int32), (np.cumsum(count) - count).astype(np.int32)

    def ids(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(word ids of the texts one after another, -1 for unknown words and after each text; words of each text)."""
        get, flat, counts = self.vocabulary.get, [], []
        for t in texts:
            w = t.translate(TABLE).split()
            counts.append(len(w))
            flat += [get(x, -1) for x in w]
            flat.append(-1)
        return np.array(flat, np.int32), np.array(counts, np.int64)

    def occurrences(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, window) of every window that occurs."""
        known = np.flatnonzero(ids >= 0)
        at = known[self.count[ids[known]] > 0]
        each = self.count[ids[at]]
        cut = np.searchsorted(np.cumsum(each, dtype=np.int64), np.arange(STEP, int(each.sum()) + STEP, STEP))
        starts, windows = [], []
        for lo, hi in zip([0, *(cut + 1)], [*(cut + 1), len(at)], strict=True):
            here, n = at[lo:hi], each[lo:hi]
            if not len(here):
                continue
            window = self.by_prefix[np.repeat(self.first[ids[here]] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            start = np.repeat(here, n) - self.offset[window]
            fits = (start >= 0) & (start + self.length[window] <= len(ids))
            start, window = start[fits], window[fits]
            for k in range(self.words.shape[1]):
                short = k >= self.length[window]
                same = short | (ids[np.minimum(start + k, len(ids) - 1)] == self.words[window, k])
                start, window = start[same], window[same]
            starts.append(start)
            windows.append(window)
        join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        return join(starts), join(windows)


def blocks(benchmark: DataFrame, item_col: str, text_col: str, block: int) -> Iterator[list[tuple[str, bytes]]]:
    """The items, so many at a time that their texts have about ``block`` bytes."""
    items = benchmark.where(F.col(item_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text"))
    n = max(1, math.ceil((items.agg(F.sum(F.octet_length("text")).alias("n")).collect()[0]["n"] or 0) / block))
    for k in range(n):
        yield [(r["item"], r["text"].encode()) for r in items.where(F.pmod(F.xxhash64("item"), F.lit(n)) == k).collect()]


def frequencies(docs: DataFrame, vocabulary, size: int) -> np.ndarray:
    """Occurrences in all documents of the words that windows have."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Windows.again({"vocabulary": vocabulary.value})
        total = np.zeros(size, np.int64)
        for _, texts in pieces(batches, "text"):
            ids = own.ids(texts)[0]
            total += np.bincount(ids[ids >= 0], minlength=size)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["word", "n"])

    out = np.zeros(size, np.int64)
    for r in docs.select("text").mapInArrow(counted, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect():  # a row a word of the block
        out[r["word"]] = r["n"]
    return out


def hits_of(rows: DataFrame, benchmark: DataFrame, size: int = SIZE, block: int = BLOCK, item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, h, n_words, n_hit, spans, items) of every row of (id, h, text)."""
    spark = rows.sparkSession
    span = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))
    kind = "id long, h long, n_words long, n_hit long, spans array<struct<first:int,end:int>>, items array<string>"

    def one(items: list[tuple[str, bytes]]) -> DataFrame:
        own = Windows(items, size)
        vocabulary = spark.sparkContext.broadcast(own.vocabulary)
        own.order(frequencies(rows, vocabulary, len(own.vocabulary)))
        arrays = spark.sparkContext.broadcast({k: v for k, v in vars(own).items() if k != "vocabulary"})

        def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            w = Windows.again(arrays.value | {"vocabulary": vocabulary.value})
            for batch, texts in pieces(batches, "text"):
                ids, n = w.ids(texts)
                begin = np.cumsum(n + 1) - (n + 1)
                start, window = w.occurrences(ids)
                cover = np.zeros(len(ids) + 1, np.int64)
                np.add.at(cover, start, 1)
                np.add.at(cover, start + w.length[window], -1)
                hit = np.concatenate([[False], np.cumsum(cover[:-1]) > 0, [False]])
                first, end = np.flatnonzero(hit[1:] & ~hit[:-1]), np.flatnonzero(~hit[1:] & hit[:-1])
                doc = np.searchsorted(begin, first, "right") - 1
                spans: list[list[dict]] = [[] for _ in texts]
                total = [0] * len(texts)
                for d, a, b in zip(doc.tolist(), (first - begin[doc]).tolist(), (end - begin[doc]).tolist(), strict=True):
                    spans[d].append({"first": a, "end": b})
                    total[d] += b - a
                names: list[set[str]] = [set() for _ in texts]
                pairs = np.unique((np.searchsorted(begin, start, "right") - 1) * len(w.words) + window) if len(start) else []
                for p in pairs:
                    k = p % len(w.words)
                    names[p // len(w.words)].update(w.items[i] for i in w.of_items[w.of_first[k]:w.of_first[k + 1]])
                yield pa.RecordBatch.from_arrays([column(batch, "id"), column(batch, "h"), pa.array(n), pa.array(total, pa.int64()), pa.array(spans, span),
                                                  pa.array([sorted(x) for x in names], pa.list_(pa.string()))], ["id", "h", "n_words", "n_hit", "spans", "items"])

        return rows.mapInArrow(hits, kind)

    parts = [one(items) for items in blocks(benchmark, item_col, item_text_col, block)]
    out = parts[0]
    if len(parts) > 1:
        out = united([out, *[p.where("n_hit > 0") for p in parts[1:]]])
    return out


def find(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, n_words, n_hit, spans, items) of every row of ``docs``: hit word ranges, and the items
    with occurring windows (as strings, sorted)."""
    out = hits_of(keyed(docs, id_col, text_col), benchmark, size, block, item_col, item_text_col)
    return out.select(id_back("id", id_col), "n_words", "n_hit", "spans", "items")


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that hold a window of the benchmark; all columns."""
    found = hits_of(keyed(docs, id_col, text_col), benchmark)
    return without(docs, found.where("n_hit > 0"), id_col, text_col)


def united(parts: list[DataFrame]) -> DataFrame:
    """Hits of several passes over the same rows, by row: the first part has every row, the
    others, one row a distinct (id, h), their hits."""
    first, rest = parts[0], parts[1]
    for p in parts[2:]:
        rest = rest.unionByName(p)
    more = rest.groupBy("id", "h").agg(F.flatten(F.collect_set("spans")).alias("more"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("also"))
    both = F.array_sort(F.concat("spans", F.coalesce("more", F.expr("cast(array() as array<struct<first:int,end:int>>)"))))
    joined = first.join(more, ["id", "h"], "left")
    merged = F.aggregate(both, F.expr("cast(array() as array<struct<first:int,end:int>>)"), lambda got, x: F.when(
        (F.size(got) > 0) & (x["first"] <= F.try_element_at(got, F.lit(-1))["end"]),
        F.concat(F.slice(got, 1, F.size(got) - 1), F.array(F.struct(F.try_element_at(got, F.lit(-1))["first"].alias("first"), F.greatest(F.try_element_at(got, F.lit(-1))["end"], x["end"]).alias("end")))),
    ).otherwise(F.concat(got, F.array(F.struct(x["first"].alias("first"), x["end"].alias("end"))))))
    items = F.array_sort(F.array_distinct(F.concat("items", F.coalesce("also", F.expr("cast(array() as array<string>)")))))
    return joined.select("id", "h", "n_words", merged.alias("spans"), items.alias("items")) \
        .select("id", "h", "n_words", F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["first"]).alias("n_hit"), "spans", "items")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return found.select(id_col, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, CAST(greatest(len(w) - 9, 1) + 1 AS BIGINT))) AS i FROM b WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, CAST(greatest(len(w) - n + 2, 1) AS BIGINT))) AS i FROM d, (SELECT DISTINCT n FROM bw))),
m AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.s = bw.s AND dw.n = bw.n),
h AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
"""

__all__ = ["Windows", "clean", "digest", "find"]
