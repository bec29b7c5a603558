"""Fill-in-middle transformation on lines, cut by SWAR words.

A batch of texts is one array of 64-bit words, each text from a word border on.  Bytes that end
a line are marked arithmetically (the high bit of each lane that is zero after the exclusive
or with eight line feeds, without carries between lanes), ``bitwise_count`` gives the marks of
each word and a running sum over the words is the rank directory.  The end of a text's k-th
line: a search in the sums finds the word, clearing the lowest marks k times finds the lane
inside it.  Code points are counted by the same means (lanes that do not continue a character).

Units are lines (``[^\\n]*\\n|[^\\n]+``).  The two cuts, and the form, come from the sha256 of
``seed:id``, so reruns agree.  A text that is empty or holds a mark stays as it is (plain).

Cases: a null text is empty; a null id is an empty string to the hash; repeated rows give equal rows;
a text without a line feed is one unit; a very long text is held a few times over by its
task, nothing else grows with it; extra columns are not read; an empty table gives no rows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from migscope.llm.text import bounds, column, pieces

SEED = 7
#: Hundredths of the texts that are transformed, and of these the ones in the order suffix, prefix, middle.
RATE, SPM = 100, 50
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

LOW7, HIGH = np.uint64(0x7F7F7F7F7F7F7F7F), np.uint64(0x8080808080808080)
FEEDS = np.uint64(0x0A0A0A0A0A0A0A0A)
ONE = np.uint64(1)


class Lines:
    """Ranks and selects over the line ends of a batch of texts."""

    def __init__(self, texts: list[bytes]):
        size = np.array([len(t) for t in texts], np.int64)
        self.first = bounds((size + 7) // 8)  # first word of each text
        self.words = np.frombuffer(b"".join(t + bytes(-len(t) % 8) for t in texts), "<u8")
        x = self.words ^ FEEDS
        self.marks = ~(((x & LOW7) + LOW7) | x | LOW7)  # the high bit of each lane that was zero
        self.rank = bounds(np.bitwise_count(self.marks).astype(np.int64))
        inner = (self.words & HIGH) & ~(self.words << ONE)  # bytes 10xxxxxx continue a character
        self.inner, self.inner_rank = inner, bounds(np.bitwise_count(inner).astype(np.int64))
        self.size = size
        self.feeds = self.rank[self.first[1:]] - self.rank[self.first[:-1]]
        open_end = np.array([len(t) > 0 and t[-1] != 10 for t in texts], bool)
        self.n = self.feeds + open_end

    def end(self, k: np.ndarray) -> np.ndarray:
        """Bytes of the first ``k[i]`` lines of text i (0 to n)."""
        out = np.where(k > self.feeds, self.size, 0)
        at = np.flatnonzero((k > 0) & (k <= self.feeds))
        wanted = self.rank[self.first[at]] + k[at]
        word = np.searchsorted(self.rank, wanted, "left") - 1
        more, left = wanted - self.rank[word] - 1, self.marks[word]
        for j in range(7):  # a word has eight lanes
            left = np.where(more > j, left & (left - ONE), left)
        lowest = left & (~left + ONE)
        lane = np.bitwise_count(lowest - ONE).astype(np.int64) >> 3
        out[at] = (word - self.first[at]) * 8 + lane + 1
        return out

    def points(self, end: np.ndarray) -> np.ndarray:
        """Code points in the first ``end[i]`` bytes of text i."""
        word = self.first[:-1] + (end >> 3)
        rest = (end & 7).astype(np.uint64)
        last = np.append(self.inner, np.uint64(0))[word] & ((ONE << (rest * np.uint64(8))) - ONE)
        return end - (self.inner_rank[word] - self.inner_rank[self.first[:-1]] + np.bitwise_count(last).astype(np.int64))


def draws(ids: list, seed: int = SEED) -> np.ndarray:
    """The first four 32-bit numbers of each id's hash."""
    hashed = b"".join(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).digest()[:16] for i in ids)
    return np.frombuffer(hashed, ">u4").reshape(len(ids), 4).astype(np.int64)


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, rate: int = RATE, spm: int = SPM,
              marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output) of every row; no shuffle."""
    p, s, m = (x.encode() for x in marks)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, "text", 1 << 20):
            lines, h = Lines(texts), draws(column(batch, "id").to_pylist(), seed)
            one, two = h[:, 0] % (lines.n + 1), h[:, 1] % (lines.n + 1)
            a, b = lines.end(np.minimum(one, two)), lines.end(np.maximum(one, two))
            plain = np.array([not t or p in t or s in t or m in t for t in texts], bool) | (h[:, 2] % 100 >= rate)
            back = h[:, 3] % 100 < spm
            out = [t if stay else s + t[j:] + p + t[:i] + m + t[i:j] if turned else p + t[:i] + s + t[j:] + m + t[i:j]
                   for t, i, j, stay, turned in zip(texts, a.tolist(), b.tolist(), plain.tolist(), back.tolist(), strict=True)]
            form = np.where(plain, "plain", np.where(back, "spm", "psm"))
            before, upto = lines.points(a), lines.points(b)
            yield pa.RecordBatch.from_arrays([column(batch, "id"), pa.array(lines.n, pa.int64()), pa.array(form.tolist(), pa.string()), pa.array(before, pa.int64(), mask=plain),
                                              pa.array(upto - before, pa.int64(), mask=plain), pa.array(out, pa.binary())],
                                             ["id", "n", "form", "prefix_chars", "middle_chars", "output"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(cut, "id long, n long, form string, prefix_chars long, middle_chars long, output binary") \
        .select(F.col("id").alias(id_col), "n", "form", "prefix_chars", "middle_chars", F.col("output").cast("string").alias("output"))


def restored(output: Column, form: Column, marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> Column:
    """The text, from output and form alone."""
    parts = F.split(output, "|".join(f"\\Q{x}\\E" for x in marks), -1)
    return F.when(form == "psm", F.concat(parts[1], parts[3], parts[2])).when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output)


def digest(docs: DataFrame) -> DataFrame:
    return transform(docs).select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                                  F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u
  FROM documents),
k AS (
  SELECT doc_id, text, u, CAST(len(u) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(u) + 1) AS one, CAST('0x' || h[9:16] AS BIGINT) % (len(u) + 1) AS two,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 100 THEN 'plain'
              WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM d),
c AS (
  SELECT doc_id, text, n, form, array_to_string(u[1:least(one, two)], '') AS p, array_to_string(u[least(one, two) + 1:greatest(one, two)], '') AS m,
         array_to_string(u[greatest(one, two) + 1:], '') AS s
  FROM k)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM c
"""
