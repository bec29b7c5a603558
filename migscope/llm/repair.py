"""Token-ID / binary output: Re-Pair grammar compression per shard.

Documents are dealt to files by ranges of their id and encoded in that order.  A shard
holds whole documents (about ``SHARD_IDS`` ids).  Inside a shard, rounds replace the
frequent pairs of adjacent symbols by new nonterminals until no pair is frequent any
more; the shard stores its rules, the expansion length of every rule and the remaining
symbols, so a range of ids is decoded without expanding what precedes it.  The end id
of a document is never part of a rule, so documents begin at symbols.

One row of the written table is one shard: ``part`` (file in id order), ``shard``,
``base`` (ids of the part before it), ``n_ids``, ``docs`` and ``payload``.

Payload: ``RPR1``, number of rules and of symbols, first nonterminal and bytes a symbol
(four unsigned 32-bit integers), then left[], right[], symbols[] in that width and
expansion lengths[] as unsigned 32-bit integers; all little-endian.

Cases: a null or empty text is the end id alone; a null id sorts last; repeated rows and
repeated ids are all written (ties ordered by text); an empty table writes no shard."""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from migscope.llm.text import LAST, column, id_back, kept_by_worker, keyed, mix, new_path, partitions, pieces, tokenizer_path

END_ID = 2
SHARD_IDS = 1 << 20
#: A pair becomes a rule if a shard has it this often.
MIN_COUNT = 32
#: Pre-tokens whose ids a task remembers.
PARTS = 300_000
TABLE = "part int, shard int, base long, n_ids long, docs array<struct<id:long,start:long,n:long>>, payload binary"


# ---- encoding -------------------------------------------------------------------

class Pieces:
    """Ids of the pieces seen so far: an open-addressing table over numpy arrays.  A piece of up
    to 24 bytes is its own key (three 64-bit words and the length), so equal keys are equal
    pieces; whole batches are looked up at once.  The table starts anew when it is full."""

    BITS, FULL = 21, 1_200_000

    def __init__(self, dtype: np.dtype):
        self.dtype = dtype
        self.clear()

    def clear(self) -> None:
        n = 1 << self.BITS
        self.words, self.size = np.zeros((3, n), np.uint64), np.zeros(n, np.uint8)
        self.entry = np.full(n, -1, np.int32)
        self.ids, self.used = np.zeros(1 << 20, self.dtype), 0
        self.first, self.count, self.n = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32), 0

    def add(self, ids: list[bytes]) -> int:
        """Append the ids of new pieces; the number of the first of them."""
        flat = np.frombuffer(b"".join(ids), self.dtype)
        count = np.array([len(x) for x in ids], np.int64) // self.dtype.itemsize
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.n + len(ids) > len(self.first):
            self.first, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.count))
        self.ids[self.used:self.used + len(flat)] = flat
        self.first[self.n:self.n + len(ids)] = self.used + np.cumsum(count) - count
        self.count[self.n:self.n + len(ids)] = count
        self.used += len(flat)
        self.n += len(ids)
        return self.n - len(ids)

    @staticmethod
    def slots(words: np.ndarray, size: np.ndarray) -> np.ndarray:
        h = mix(words[0] * np.uint64(0x9E3779B97F4A7C15) + mix(words[1] * np.uint64(0xC2B2AE3D27D4EB4F) + words[2] + size.astype(np.uint64)))
        return (h >> np.uint64(64 - Pieces.BITS)).astype(np.int64)

    def find(self, words: np.ndarray, size: np.ndarray) -> np.ndarray:
        out = np.full(len(size), -1, np.int64)
        todo, slot = np.flatnonzero(size <= 24), self.slots(words, size)
        slot = slot[todo]
        while len(todo):
            entry = self.entry[slot]
            same = (self.words[0, slot] == words[0, todo]) & (self.words[1, slot] == words[1, todo]) & (self.words[2, slot] == words[2, todo]) & (self.size[slot] == size[todo])
            hit = same & (entry >= 0)
            out[todo[hit]] = entry[hit]
            on = ~same & (entry >= 0)
            todo, slot = todo[on], (slot[on] + 1) & ((1 << self.BITS) - 1)
        return out

    def insert(self, words: np.ndarray, size: np.ndarray, entry: np.ndarray) -> None:
        todo, slot = np.arange(len(size)), self.slots(words, size)
        while len(todo):
            free = self.entry[slot] < 0
            self.entry[slot[free]] = entry[todo[free]]
            placed = self.entry[slot] == entry[todo]
            here, there = todo[placed], slot[placed]
            self.words[:, there], self.size[there] = words[:, here], size[here]
            todo, slot = todo[~placed], (slot[~placed] + 1) & ((1 << self.BITS) - 1)


class Encoder:
    """Ids of whole texts as the library gives them.

    A text is cut before each single space.  Of a byte-level vocabulary only a pre-token of white
    space reaches over such a cut: the space then stands between white space, or between it and
    the end.  Without one the ids of a text are those of its pieces in turn.  Pieces met before are
    looked up, the others are cut into pre-tokens, and the library's model encodes those that
    are new.  A text with two spaces in a row, a space inside other white space or a special
    string, and a piece with characters beyond Latin (whose classes depend on a library's Unicode
    version), goes to the library whole."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tok.get_added_tokens_decoder().values()]
        self.code = "H" if self.tok.get_vocab_size() < 1 << 16 else "I"
        self.dtype = np.dtype(f"<{'u2' if self.code == 'H' else 'u4'}")
        # The pre-token pattern and the byte alphabet of byte-level vocabularies.
        self.pretokens = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+").findall
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        others = [b for b in range(256) if b not in set(printable)]
        self.alphabet = {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}
        self.beyond = re.compile("[^\x00-\u024f]").search
        # White space but the space, a space, and white space again or the end.
        self.spanned = re.compile(r"[^\S ] (?:\s|\Z)").search
        self.white_end = np.zeros(1 << 16, bool)  # of two bytes: they end in white space but the space
        for b in (c.encode() for c in map(chr, range(0x3001)) if c.isspace() and c != " "):
            self.white_end[b[-1]::256] |= len(b) == 1
            self.white_end[b[-2:][0] << 8 | b[-1]] |= len(b) > 1
        self.parts: dict[str, bytes] = {}
        self.known = Pieces(self.dtype)

    def whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def _part(self, p: str) -> bytes:
        """Ids of one pre-token."""
        if (ids := self.parts.get(p)) is None:
            mapped = "\u0120" + p[1:] if p[0] == " " and p.isascii() and p[1:].isalnum() else p.encode().decode("latin-1").translate(self.alphabet)
            ids = array(self.code, [t.id for t in self.tok.model.tokenize(mapped)]).tobytes()
            if len(self.parts) >= PARTS:
                self.parts = {}
            self.parts[p] = ids
        return ids

    def piece(self, piece: str) -> bytes:
        if not piece.isascii() and self.beyond(piece):
            return self.whole(piece)
        body = piece[1:] if piece[0] == " " else piece
        if body.isalpha():  # one word, which is one pre-token
            return self._part(piece)
        if body[:-1].isalpha() and body[-1] in ".,":
            return self._part(piece[:-1]) + self._part(piece[-1])
        return b"".join([self._part(p) for p in self.pretokens(piece)])

    def spanned_cuts(self, texts: list[bytes]) -> set[int]:
        """Numbers of the texts with a single space inside other white space, or after it at the end.
        The two bytes before each space leave few texts to the pattern."""
        data = np.frombuffer(b"  ".join([b"", *texts]), np.uint8)
        at = np.flatnonzero(data[2:] == 32) + 2
        at = at[self.white_end[data[at - 2].astype(np.int64) << 8 | data[at - 1]]]
        begin = np.cumsum([2] + [len(t) + 2 for t in texts])
        return {k for k in set((np.searchsorted(begin, at, "right") - 1).tolist()) if self.spanned(texts[k].decode())}

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        spanned = self.spanned_cuts(texts)
        odd = {k: np.frombuffer(self.whole(t.decode()), self.dtype) for k, t in enumerate(texts) if k in spanned or b"  " in t or any(s in t for s in self.special)}
        plain = [b"" if k in odd else t for k, t in enumerate(texts)]
        if self.known.n > Pieces.FULL:
            self.known.clear()
        size = np.array([len(t) for t in plain], np.int64)
        begin = np.concatenate([[0], np.cumsum(size)])
        total = int(begin[-1])
        data = b"".join(plain) + bytes(32)
        mark = np.frombuffer(data, np.uint8)[:total] == 32
        mark[begin[:-1][size > 0]] = True
        starts = np.flatnonzero(mark)
        size = np.diff(np.append(starts, total))
        view = np.ndarray(len(data) - 8, "<u8", data, strides=(1,))
        words = np.empty((3, len(starts)), np.uint64)
        for k in range(3):
            bits = (np.clip(size - 8 * k, 0, 8) * 8).astype(np.uint64)
            keep = np.where(bits == 64, ~np.uint64(0), (np.uint64(1) << np.minimum(bits, np.uint64(63))) - np.uint64(1))
            words[k] = view[np.minimum(starts + 8 * k, total + 16)] & keep
        entry = self.known.find(words, size)
        local: dict[bytes, int] = {}
        missing = np.flatnonzero(entry < 0)
        found, ids = [], []
        for s, n in zip(starts[missing].tolist(), size[missing].tolist(), strict=True):
            p = data[s:s + n]
            e = local.setdefault(p, len(ids))
            if e == len(ids):
                ids.append(self.piece(p.decode()))
            found.append(e)
        entry[missing] = np.array(found, np.int64) + self.known.add(ids)
        new = missing[np.unique(np.array(found, np.int64), return_index=True)[1]] if len(found) else missing
        new = new[size[new] <= 24]
        self.known.insert(words[:, new], size[new].astype(np.uint8), entry[new].astype(np.int32))
        count = self.known.count[entry].astype(np.int64)
        upto = np.concatenate([[0], np.cumsum(count)])
        ids = self.known.ids[np.repeat(self.known.first[entry] - upto[:-1], count) + np.arange(upto[-1])]
        cut = upto[np.searchsorted(starts, begin)]
        return [odd[k] if k in odd else ids[cut[k]:cut[k + 1]] for k in range(len(texts))]


# ---- grammar --------------------------------------------------------------------

def compress(ids: np.ndarray, first: int, end_id: int = END_ID, min_count: int = MIN_COUNT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, left, right): rule ``first + k`` stands for ``left[k] right[k]``.  Every round
    counts all adjacent pairs, turns the frequent ones into rules and replaces their occurrences
    from left to right.  Frequent begins at a 512th of the first round's most frequent pair and
    falls by eight from round to round to ``min_count``; rounds end when no pair has that many.
    Pairs are keyed by 32 bits while symbols have 16, by 64 beyond."""
    seq = ids.astype(np.uint32)
    left: list[np.ndarray] = []
    right: list[np.ndarray] = []
    n_rules, limit = 0, (1 << 31) - first
    bits = 18
    least = None
    while len(seq) > 1 and n_rules < limit:
        a, b = seq[:-1], seq[1:]
        key = (a << np.uint32(16)) ^ b if first + n_rules <= 1 << 16 else (a.astype(np.uint64) << np.uint64(32)) ^ b
        slot = (key * key.dtype.type(0x9E3779B1) >> key.dtype.type(14)).astype(np.int64) & ((1 << bits) - 1)
        counts = np.bincount(slot, minlength=1 << bits)
        if least is None:
            least = max(min_count, int(counts.max()) // 512)
        end = seq == end_id
        at = np.flatnonzero((counts >= least)[slot] & ~(end[:-1] | end[1:]))
        here, pair = slot[at], key[at]
        holder = np.zeros(1 << bits, key.dtype)  # one pair stands for each slot in a round
        holder[here] = pair
        same = holder[here] == pair
        at, here = at[same], here[same]
        counts = np.bincount(here, minlength=1 << bits)
        chosen = np.flatnonzero(counts >= least)
        chosen = chosen[np.argsort(-counts[chosen], kind="stable")][: limit - n_rules]
        if not len(chosen):
            if least == min_count:
                break
            least = min_count
            continue
        rule = np.zeros(1 << bits, np.uint32)
        rule[chosen] = first + n_rules + np.arange(len(chosen), dtype=np.uint32)
        found = rule[here]
        hit, found = at[found > 0], found[found > 0]
        # In a run of overlapping occurrences every second one is taken.
        new_run = np.ones(len(hit), bool)
        new_run[1:] = hit[1:] != hit[:-1] + 1
        start = np.maximum.accumulate(np.where(new_run, hit, 0))
        take = (hit - start) % 2 == 0
        hit, found = hit[take], found[take]
        wide = key.dtype.itemsize * 4
        left.append((holder[chosen] >> key.dtype.type(wide)).astype(np.uint32))
        right.append((holder[chosen] & key.dtype.type((1 << wide) - 1)).astype(np.uint32))
        n_rules += len(chosen)
        seq = seq.copy()
        seq[hit] = found
        keep = np.ones(len(seq), bool)
        keep[hit + 1] = False
        seq = seq[keep]
        least = max(min_count, least // 8)
    join = lambda x: np.concatenate(x) if x else np.zeros(0, np.uint32)
    return seq, join(left), join(right)


def lengths_of(left: np.ndarray, right: np.ndarray, first: int) -> np.ndarray:
    out = [1] * 0
    for x, y in zip(left.tolist(), right.tolist(), strict=True):
        out.append((out[x - first] if x >= first else 1) + (out[y - first] if y >= first else 1))
    return np.array(out, dtype=np.uint32)


def pack(seq: np.ndarray, left: np.ndarray, right: np.ndarray, first: int) -> bytes:
    wide = "<u2" if first + len(left) <= 1 << 16 else "<u4"
    head = b"RPR1" + struct.pack("<4I", len(left), len(seq), first, int(wide[2]))
    return head + b"".join(x.astype(wide).tobytes() for x in (left, right, seq)) + lengths_of(left, right, first).astype("<u4").tobytes()


class Shard:
    """A payload read back; ``ids(lo, hi)`` decodes that range alone."""

    def __init__(self, payload: bytes):
        if payload[:4] != b"RPR1":
            raise ValueError("not a shard")
        n_rules, n_symbols, self.first, width = struct.unpack("<4I", payload[4:20])
        kind, at = f"<u{width}", 20
        take = lambda n, k: np.frombuffer(payload, k, n, at)
        self.left = take(n_rules, kind)
        at += n_rules * width
        self.right = take(n_rules, kind)
        at += n_rules * width
        self.seq = take(n_symbols, kind)
        at += n_symbols * width
        self.lengths = take(n_rules, "<u4").astype(np.int64)
        size = np.where(self.seq >= self.first, self.lengths[np.maximum(self.seq.astype(np.int64) - self.first, 0)] if n_rules else 1, 1)
        self.ends = np.cumsum(size)

    def _expand(self, seq: np.ndarray) -> np.ndarray:
        seq = seq.astype(np.uint32)
        left, right = self.left.astype(np.uint32), self.right.astype(np.uint32)
        while True:
            rule = seq >= self.first
            if not rule.any():
                return seq
            at = np.cumsum(1 + rule) - 1 - rule
            out = np.empty(len(seq) + int(rule.sum()), np.uint32)
            k = seq[rule] - np.uint32(self.first)
            out[at[~rule]] = seq[~rule]
            out[at[rule]] = left[k]
            out[at[rule] + 1] = right[k]
            seq = out

    def all(self) -> np.ndarray:
        """Every id: the rules are expanded once, then copied to their places."""
        n = len(self.left)
        if not n:
            return self.seq.astype(np.uint32)
        used = np.zeros(n, bool)
        nonterminal = self.seq >= self.first
        used[self.seq[nonterminal] - self.first] = True
        names = np.flatnonzero(used)
        flat = np.concatenate([np.arange(self.first, dtype=np.uint32), self._expand(names + self.first)])
        size = np.ones(self.first + n, np.int64)
        size[self.first + names] = self.lengths[names]
        at = np.arange(self.first + n, dtype=np.int64)
        at[self.first + names] = self.first + np.cumsum(self.lengths[names]) - self.lengths[names]
        size, at = size[self.seq], at[self.seq]
        shift = np.repeat(at - (np.cumsum(size) - size), size)
        return flat[np.arange(len(shift)) + shift]

    def ids(self, lo: int, hi: int) -> np.ndarray:
        if lo >= hi:
            return np.zeros(0, np.uint32)
        i, j = np.searchsorted(self.ends, lo, "right"), np.searchsorted(self.ends, hi, "left") + 1
        before = int(self.ends[i - 1]) if i else 0
        return self._expand(self.seq[i:j])[lo - before:hi - before]


# ---- Spark ----------------------------------------------------------------------

def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode ``docs`` in ascending id order and write the shards to ``path``."""
    spark = docs.sparkSession
    arrow = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("base", pa.int64()), ("n_ids", pa.int64()),
                       ("docs", pa.list_(pa.struct([("id", pa.int64()), ("start", pa.int64()), ("n", pa.int64())]))), ("payload", pa.binary())])

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept_by_worker(f"encoder {tokenizer}", lambda: Encoder(tokenizer))
        part, first = TaskContext.get().partitionId(), encoder.tok.get_vocab_size()
        end = np.array([end_id], encoder.dtype)
        shard, base, held, rows, size = 0, 0, [], [], 0

        def out() -> pa.RecordBatch:
            payload = pack(*compress(np.concatenate(held), first, end_id), first)
            return pa.RecordBatch.from_pylist([{"part": part, "shard": shard, "base": base, "n_ids": size, "docs": rows, "payload": payload}], schema=arrow)

        for batch, texts in pieces(batches, "text"):
            for i, ids in zip(column(batch, "id").to_pylist(), encoder.encode(texts), strict=True):
                n = len(ids) + 1
                if size and size + n > SHARD_IDS:
                    yield out()
                    shard, base, held, rows, size = shard + 1, base + size, [], [], 0
                rows.append({"id": i, "start": size, "n": n})
                held += (ids, end)
                size += n
        if size:
            yield out()

    rows = keyed(docs, id_col, text_col)
    rows.repartitionByRange(partitions(spark), "id", "h").sortWithinPartitions("id", "h").select("id", "text") \
        .mapInArrow(shards, TABLE).write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document, from the written shards.  ``start``
    counts the ids of all documents before it: totals of the parts are summed (one row a
    part), the rest stands in the shards."""
    table = spark.read.schema(TABLE).parquet(path)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: column(batch, c)[i].as_py() for c in ("part", "base", "docs", "payload")}
                ids = Shard(row["payload"]).all().astype("<u4")
                yield pa.RecordBatch.from_arrays([
                    pa.array([row["part"]] * len(row["docs"]), pa.int32()), pa.array([d["id"] for d in row["docs"]], pa.int64()),
                    pa.array([row["base"] + d["start"] for d in row["docs"]], pa.int64()), pa.array([d["n"] for d in row["docs"]], pa.int64()),
                    pa.array([zlib.crc32(ids[d["start"]:d["start"] + d["n"]]) for d in row["docs"]], pa.int64())],
                    ["part", "id", "at", "n_tokens", "ids_crc32"])

    totals = table.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = totals.select(F.col("part").alias("p"), F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    docs = table.select("part", "base", "docs", "payload").mapInArrow(decode, "part int, id long, at long, n_tokens long, ids_crc32 long")
    return docs.join(before, docs.part == before.p).select("id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def fetch(spark: SparkSession, path: str, doc_id: int) -> list[int]:
    """The ids of one document, by random access into its shard."""
    hit = spark.read.schema(TABLE).parquet(path).select(F.explode("docs").alias("d"), "payload").where(F.col("d.id") == doc_id).limit(1).collect()
    return [] if not hit else Shard(bytes(hit[0]["payload"])).ids(hit[0]["d"]["start"], hit[0]["d"]["start"] + hit[0]["d"]["n"]).tolist()


def digest(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the token files of ``docs`` to the shared folder, read them back and describe
    every document: doc_id, start, n_tokens, ids_crc32."""
    path = new_path(docs.sparkSession, "token-ids")
    write(docs, path, tokenizer_path(tokenizer), END_ID, id_col, text_col)
    return read(docs.sparkSession, path).select(id_back("id", "doc_id"), "start", "n_tokens", "ids_crc32")


__all__ = ["LAST", "Encoder", "Shard", "compress", "digest", "fetch", "pack", "read", "write"]
