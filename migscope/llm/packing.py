"""Best-fit packing: sum of squares.

Documents are encoded, closed with the end id and cut into pieces of at most ``LIMIT`` ids (only
longer ones are cut).  The pieces, longest first, are placed one by one: among the open
sequences with room, a piece goes where the sum over all residual gaps of the squared number
of open sequences with that gap becomes smallest (ties: to the fullest sequence).  A new
sequence is opened where none has room.  Open sequences of one gap are alike, so the state is
a count and a stack a gap, and a placement is one comparison of two slices of counts.

Pieces are dealt evenly to tasks of about ``GROUP``, whatever their document or source; each
packs its own.  A group leaves few sequences part filled, as its shortest pieces come last.

Cases: a null or empty text is the end id alone; null ids, repeated rows and repeated ids are
packed as any other row; a very long text is held once by its task (its ids take about as many
bytes as its text) and gives full pieces; extra columns are not read; an empty table gives no rows."""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from migscope.llm.repair import Pieces
from migscope.llm.text import bounds, column, kept_by_worker, pieces, stored, tokenizer_path
from migscope.llm.whole_token import Counter

LIMIT = 2048
END_ID = 0
#: Pieces that one task packs.
GROUP = 1 << 14
#: Words whose ids a worker remembers beside the runs.
WORDS = 100_000


class Words(Counter):
    """Ids of whole texts.  No pre-token of the vocabulary holds white space, so the ids of a text are those
    of its runs of other characters; a batch's runs are looked up at once in a table of the
    runs seen before (``Pieces``), and the words of new ones are merged by the library's model.
    Texts that ``Counter`` gives to the library whole go to it here too."""

    def __init__(self, path: str):
        super().__init__(path, [])
        self.dtype = np.dtype("<u4")
        self.known = Pieces(self.dtype)
        self.parts: dict[str, bytes] = {}
        self.white = np.zeros(256, bool)
        self.white[[9, 10, 11, 12, 13, 32]] = True
        # Fixed value: the byte alphabet of byte-level vocabularies.
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        self.alphabet = {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in set(printable))}

    def _word(self, word: str) -> bytes:
        """Ids of one pre-token; remembered, as a run with a stop after it has the same word."""
        if (ids := self.parts.get(word)) is None:
            mapped = word if word.isascii() else word.encode().decode("latin-1").translate(self.alphabet)
            if len(self.parts) >= WORDS:
                self.parts.clear()
            ids = self.parts[word] = array("I", [t.id for t in self.tok.model.tokenize(mapped)]).tobytes()
        return ids

    def _run(self, run: str) -> bytes:
        if run.isascii():
            if run.isalpha():
                return self._word(run)
            if run[:-1].isalpha() and run[-1] in ".,":
                return self._word(run[:-1]) + self._word(run[-1])
        return b"".join(map(self._word, self.find(run) if "'" in run else self.simple(run)))

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        odd, plain = {}, []
        for k, t in enumerate(map(bytes.decode, texts)):
            if self.beyond(t) or any(s in t for s in self.special):
                odd[k], t = np.array(self.tok.encode(t, add_special_tokens=False).ids, self.dtype), ""
            plain.append(t.lower().encode())
        if self.known.n > Pieces.FULL:
            self.known.clear()
        begin = bounds([len(t) + 1 for t in plain])
        data = b" ".join([*plain, bytes(32)])
        total = int(begin[-1])
        solid = ~self.white[np.frombuffer(data, np.uint8)[:total]]
        edge = np.flatnonzero(np.diff(solid, prepend=False, append=False))
        starts, size = edge[::2], edge[1::2] - edge[::2]
        words = keys(data, starts, size)
        entry = self.known.find(words, size)
        local: dict[bytes, int] = {}
        missing = np.flatnonzero(entry < 0)
        found, ids = [], []
        for s, n in zip(starts[missing].tolist(), size[missing].tolist(), strict=True):
            run = data[s:s + n]
            e = local.setdefault(run, len(ids))
            if e == len(ids):
                ids.append(self._run(run.decode()))
            found.append(e)
        entry[missing] = np.array(found, np.int64) + self.known.add(ids)
        new = missing[np.unique(np.array(found, np.int64), return_index=True)[1]]
        new = new[size[new] <= 24]
        self.known.insert(words[:, new], size[new].astype(np.uint8), entry[new].astype(np.int32))
        count = self.known.count[entry].astype(np.int64)
        upto = bounds(count)
        ids = self.known.ids[np.repeat(self.known.first[entry] - upto[:-1], count) + np.arange(upto[-1])]
        cut_at = upto[np.searchsorted(starts, begin)]
        return [odd[k] if k in odd else ids[cut_at[k]:cut_at[k + 1]] for k in range(len(texts))]


def keys(data: bytes, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The first 24 bytes of each run as three 64-bit words, zero beyond its end; ``data`` has 32 bytes to spare."""
    view = np.ndarray(len(data) - 8, "<u8", data, strides=(1,))
    words = np.empty((3, len(starts)), np.uint64)
    for k in range(3):
        bits = (np.clip(size - 8 * k, 0, 8) * 8).astype(np.uint64)
        keep = np.where(bits == 64, ~np.uint64(0), (np.uint64(1) << np.minimum(bits, np.uint64(63))) - np.uint64(1))
        words[k] = view[np.minimum(starts + 8 * k, len(data) - 9)] & keep
    return words


def cut(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", limit: int = LIMIT, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text",
        with_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32) of every piece, and its ids (unsigned 32-bit, little-endian) if asked for."""
    path, end = tokenizer_path(tokenizer), np.array([end_id], "<u4").tobytes()

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = kept_by_worker(f"words {path}", lambda: Words(path))
        for batch, texts in pieces(batches, "text", 1 << 20):
            rows: list[list] = [[], [], [], [], [], []]
            for i, own in zip(column(batch, "id").to_pylist(), words.encode(texts), strict=True):
                ids = own.tobytes() + end
                for k, at in enumerate(range(0, len(ids), 4 * limit)):
                    part = ids[at:at + 4 * limit]
                    for to, value in zip(rows, (i, k, at // 4, len(part) // 4, zlib.crc32(part), part), strict=True):
                        to.append(value)
            arrays = [pa.array(x, t) for x, t in zip(rows, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)]
            names = ["id", "piece", "start", "length", "ids_crc32", "ids"]
            yield pa.RecordBatch.from_arrays(arrays[:len(arrays) - (not with_ids)], names[:len(arrays) - (not with_ids)])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(encoded, "id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else ""))


class SumOfSquares:
    """Open sequences of one task, by residual gap."""

    def __init__(self, limit: int):
        self.limit, self.opened = limit, 0
        self.twice = np.zeros(limit + 1, np.int64)  # twice the open sequences of each gap
        self.twice[0] = -1  # a full sequence counts no longer: it takes 2 N(gap) - 1 from the sum
        self.stacks: list[list[int]] = [[] for _ in range(limit + 1)]

    def place(self, size: int) -> tuple[int, int]:
        """(sequence, offset) of a piece.  From gap g to g - size the sum changes by 2 (N(g - size) - N(g) + 1)."""
        have = self.twice[size:self.limit]
        change = np.where(have > 0, self.twice[:self.limit - size] - have, np.iinfo(np.int64).max)
        left = int(change.argmin()) if len(change) else 0
        if len(change) and have[left] > 0:
            gap = left + size
            sequence = self.stacks[gap].pop()
            self.twice[gap] -= 2
        else:
            gap, left, sequence = self.limit, self.limit - size, self.opened
            self.opened += 1
        if left:
            self.stacks[left].append(sequence)
            self.twice[left] += 2
        return sequence, self.limit - gap


def pack(cuts: DataFrame, limit: int = LIMIT, group: int = GROUP) -> DataFrame:
    """``cuts`` (any columns, ``length`` from 1 to ``limit``) with sequence_id and offset."""
    rows = stored(cuts, "packing-pieces")
    n = max(1, -(-rows.count() // group))
    names, schema = rows.columns, StructType([*rows.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, base = SumOfSquares(limit), TaskContext.get().partitionId() << 40
        for batch in batches:
            places = [state.place(s) for s in column(batch, "length").to_pylist()]
            own = [column(batch, c) for c in names]
            yield pa.RecordBatch.from_arrays([*own, pa.array([base + s for s, _ in places], pa.int64()), pa.array([o for _, o in places], pa.int64())],
                                             [*names, "sequence_id", "offset"])

    # The number of a stored row deals evenly and is the same when a task runs again.
    dealt = rows.withColumn("_row", F.monotonically_increasing_id()).repartition(n, F.xxhash64("_row"))
    return dealt.sortWithinPartitions(F.col("length").desc(), "_row").select(*names).mapInArrow(packed, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids) from packed pieces that carry their ids: what a training job reads."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))  # at most ``limit`` pieces
    joined = F.aggregate(parts, F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p["ids"]))
    return packed.groupBy("sequence_id").agg(joined.alias("ids"))


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return pack(cut(docs, id_col=id_col, text_col=text_col)).select(
        F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
