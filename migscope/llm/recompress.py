"""Substring dedup by recompression.

Words are symbols.  Rounds replace runs of one symbol by a name of (symbol, length), and
pairs by a name of both: a global hash of symbol and round splits the alphabet in two halves, and
each pair that goes from the left to the right half is replaced.  Names are hashes of what
they stand for, hence the same in every task and text.

The symbol at a place depends on the words around it only so far: its context, which is carried
along (a pair knows its parts; a symbol left alone also the neighbour that could have
joined it; at the end of a text the context goes beyond it).  Two texts with the same words over
a context have the same symbol in it.  So every ``window``-word window has a symbol that depends on
nothing but the window: of the highest level with symbols whose context lies inside its first
``reach`` words, the one with the least hash (words themselves are the lowest level, so there
is always one).  Equal windows choose the same symbol at the same place.  Symbols that agree in
the ``window - reach`` words after that place reveal repeats, and the windows around them
verify them (``repeats``), by 128 bits of their content.

Cases: null and empty texts have no words; texts shorter than a window lose none; a null id
sorts last; rows that agree in id and text share a result, and neither is earlier; an empty
table gives no rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from migscope.llm.repeats import ANCHOR, asked, batch_of, cover, repeated_windows
from migscope.llm.text import bounds, column, id_back, keyed, mix, pieces, word_hashes

WINDOW = 50
REACH = 24
ROUNDS, RUNS_AT = 2, (0,)
#: Widths of the blocks in which windows are compared where names meet different content.
STEPS = (1,)
END = np.uint64(0)
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def flat_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes of all texts, each followed by ``END``; first position of each text)."""
    split = [t.split() for t in texts]
    n = np.array([len(w) for w in split], np.int64)
    begin = bounds(n + 1)
    flat = np.zeros(int(begin[-1]), np.uint64)
    inside = np.ones(len(flat), bool)
    inside[begin[1:] - 1] = False
    flat[inside] = word_hashes([w for words in split for w in words]) | np.uint64(1)
    return flat, begin


class Level:
    """Symbols of one round: name, and the words [low, high) that decide them; all ascending."""

    def __init__(self, name, low, high):
        self.name, self.low, self.high = name, low, high

    def runs(self) -> Level:
        name = self.name
        same = (name[1:] == name[:-1]) & (name[1:] != END)
        first = np.flatnonzero(np.concatenate([[True], ~same]))
        length = np.diff(np.append(first, len(name)))
        last = first + length - 1
        left, right = np.maximum(first - 1, 0), np.minimum(last + 1, len(name) - 1)
        new = np.where(length > 1, mix(name[first] * np.uint64(0xA24BAED4963EE407) + length.astype(np.uint64)) | np.uint64(1), name[first])
        # Before the first and after the last symbol there is no neighbour: the context goes beyond.
        return Level(new, np.where(first > 0, self.low[left], -1), np.where(last < len(name) - 1, self.high[right], self.high[-1] + 1))

    def pairs(self, number: int) -> Level:
        name = self.name
        real = name != END
        half = (mix(name + np.uint64((number + 1) * 0x9FB21C651E98DF25 % (1 << 64))) >> np.uint64(63)).astype(bool)
        joined = np.flatnonzero(real[:-1] & real[1:] & ~half[:-1] & half[1:])
        new, low, high = name.copy(), self.low.copy(), self.high.copy()
        alone_left = ~half & real  # waits for a right neighbour
        high[:-1] = np.where(alone_left[:-1], self.high[1:], high[:-1])
        high[-1] += alone_left[-1]
        alone_right = half & real
        low[1:] = np.where(alone_right[1:], self.low[:-1], low[1:])
        low[0] -= alone_right[0]
        new[joined] = mix(name[joined] * np.uint64(0xD6E8FEB86659FD93) + mix(name[joined + 1]) + np.uint64(number)) | np.uint64(1)
        low[joined], high[joined] = self.low[joined], self.high[joined + 1]
        keep = np.ones(len(name), bool)
        keep[joined + 1] = False
        return Level(new[keep], low[keep], high[keep])


def levels(flat: np.ndarray, rounds: int = ROUNDS) -> list[Level]:
    at = np.arange(len(flat), dtype=np.int64)
    out = [Level(flat, at, at + 1)]
    for k in range(rounds):
        now = out[-1]
        if k in RUNS_AT:
            now = now.runs()
        out.append(now.pairs(k))
    return out


def least_in(names: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The place of the least of ``names[first:end]`` (the leftmost of equals) for many ranges, none empty."""
    bits = max(int(len(names)).bit_length(), 1)
    value = (names >> np.uint64(bits) << np.uint64(bits)) | np.arange(len(names), dtype=np.uint64)
    step = np.frexp(end - first)[1] - 1  # 2**step is the largest power of two within the range
    out = np.empty(len(first), np.uint64)
    for k in range(int(step.max(initial=0)) + 1):
        if k:
            value = np.minimum(value[:-(1 << (k - 1))], value[1 << (k - 1):])
        here = np.flatnonzero(step == k)
        out[here] = np.minimum(value[first[here]], value[end[here] - (1 << k)])
    return (out & np.uint64((1 << bits) - 1)).astype(np.int64)


def choose(flat: np.ndarray, begin: np.ndarray, size: int, reach: int = REACH, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin of the symbol's context, first window, number of windows) of the anchors, in order."""
    n = len(flat)
    ends = np.repeat(begin[1:] - 1, np.diff(begin))
    todo = np.flatnonzero(np.arange(n) + size <= ends)
    owner = np.zeros(n, np.int64)  # chosen symbol of each window, as place and level
    place = np.zeros(n, np.int64)
    for number, level in reversed(list(enumerate(levels(flat, rounds)))):
        if not len(todo):
            break
        # The symbols whose context lies inside the first ``reach`` words of a window are neighbours.
        before = np.cumsum(np.bincount(np.maximum(level.low, -1) + 1, minlength=n + 2))
        upto = np.cumsum(np.bincount(np.minimum(level.high, n + 1), minlength=n + 2))
        first, end = before[todo], upto[todo + reach]
        good = first < end
        at = todo[good]
        k = least_in(mix(level.name), first[good], end[good])
        owner[at] = k * 64 + number + 1
        place[at] = level.low[k]
        todo = todo[~good]
    mine = np.flatnonzero(owner)
    new = np.ones(len(mine), bool)
    new[1:] = (owner[mine[1:]] != owner[mine[:-1]]) | (mine[1:] != mine[:-1] + 1)
    first = mine[new]
    return place[first], first, np.diff(np.append(np.flatnonzero(new), len(mine)))


def powers(base: int, n: int) -> np.ndarray:
    """1, base, base**2, ... modulo 2**64, at least ``n`` of them (kept by the task)."""
    have = POWERS.get(base)
    if have is None or len(have) < n:
        n = max(n, 1 << 16)
        have = np.full(n, np.uint64(base))
        have[0] = 1
        have = POWERS[base] = np.cumprod(have)
    return have


POWERS: dict[int, np.ndarray] = {}


class Rolling:
    """Names of any stretch of a sequence: polynomial sums modulo 2**64, of two bases."""

    def __init__(self, symbols: np.ndarray):
        self.symbols, self.sums = symbols, {}

    def names(self, first: np.ndarray, end: np.ndarray, k: int = 0) -> np.ndarray:
        n = len(self.symbols)
        if k not in self.sums:
            values = self.symbols if k == 0 else mix(self.symbols + np.uint64(k))
            sums = self.sums[k] = np.zeros(n + 1, np.uint64)
            np.cumsum(values * powers(BASES[k], n)[:n], out=sums[1:])
        back = powers(pow(BASES[k], -1, 1 << 64), n + 1)
        return mix((self.sums[k][end] - self.sums[k][first]) * back[first])


def anchors_of(size: int, reach: int, rounds: int):
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, "text", 1 << 19):
            flat, begin = flat_words(texts)
            place, first, count = choose(flat, begin, size, reach, rounds)
            rolling = Rolling(flat)
            content = mix(rolling.names(first, first + count - 1 + size) + (place - first).astype(np.uint64) * np.uint64(65537) + count.astype(np.uint64))
            doc = np.searchsorted(begin, first, "right") - 1
            yield batch_of(batch, doc, begin, rolling.names(place, place + size - reach), content, first, count, place)

    return made


def blocks_of(size: int):
    def of(width: int):
        def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, texts in pieces(batches, "text", 1 << 19):
                flat, begin = flat_words(texts)
                yield block_batch(batch, begin, Rolling(flat), width, size)

        return made

    return of


def block_batch(batch: pa.RecordBatch, begin: np.ndarray, rolling: Rolling, width: int, size: int) -> pa.RecordBatch:
    """Blocks of ``width`` windows: name of the common part, name of all content."""
    first, n, core, core_end, place, m, doc = asked(batch, begin, width, size)
    content = rolling.names(first, first + n - 1 + size, 1) + n.astype(np.uint64) + (core - first).astype(np.uint64) * np.uint64(65537)
    return batch_of(batch, doc, begin, rolling.names(core, core_end), mix(content), first, n, place, m)


def dedup(docs: DataFrame, window: int = WINDOW, reach: int = REACH, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_removed, kept_text) of every row: the words that no earlier-starting window
    covers, joined by one space."""
    rows = keyed(docs, id_col, text_col)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, "text"):
            spans = column(batch, "spans")
            n, gone, out = [], [], []
            for k, t in enumerate(texts):
                words = t.split()
                n.append(len(words))
                if spans[k].is_valid:
                    dead = cover(spans[k].values, window, len(words))
                    gone.append(int(dead.sum()))
                    words = [w for w, d in zip(words, dead.tolist(), strict=True) if not d]
                else:
                    gone.append(0)
                out.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([column(batch, "id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(out, pa.binary()).cast(pa.string())], ["id", "n_words", "n_removed", "kept_text"])

    reach = min(reach, window)
    anchors = rows.mapInArrow(anchors_of(window, reach, rounds), ANCHOR)
    spans = repeated_windows(rows, anchors, blocks_of(window), STEPS, earlier=True)
    out = rows.join(spans, ["id", "h"], "left").select("id", "text", "spans").mapInArrow(kept, "id long, n_words long, n_removed long, kept_text string")
    return out.select(id_back("id", id_col), "n_words", "n_removed", "kept_text")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return found.select(id_col, "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, w, unnest(range(1, CAST(greatest(len(w) - 48, 1) AS BIGINT))) AS i FROM d),
h AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM x),
f AS (SELECT h, min(doc_id) AS low FROM h GROUP BY h),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM (SELECT h.doc_id, h.i FROM h JOIN f ON h.h = f.h WHERE f.low < h.doc_id)),
p AS (SELECT doc_id, unnest(w) AS v, generate_subscripts(w, 1) AS i FROM d),
k AS (SELECT p.doc_id, string_agg(p.v, ' ' ORDER BY p.i) FILTER (WHERE g.i IS NULL) AS kept, count(g.i) AS n_removed
      FROM p LEFT JOIN g ON p.doc_id = g.doc_id AND p.i = g.i GROUP BY p.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""

__all__ = ["Rolling", "block_batch", "choose", "dedup", "digest", "flat_words", "levels"]
