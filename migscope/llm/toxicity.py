"""Toxicity: maximum-scoring segments of token log-odds.

Training (labelled rows of the training fold only): every word gives its first four, five
and six characters (insults of inflecting languages share a stem), itself as a whole and the
six characters at each later place (parts of compounds, told as first six are) as tokens.  A
character of three bytes or more (scripts without blanks, signs) is a word, with the one, two
and three characters from it as tokens.  Tokens are counted by class in ``2**BITS`` hash buckets, so the model has one size whatever the corpus.  A bucket's weight
is the log-odds ratio with an informative Dirichlet prior (the buckets' overall
frequencies).  A word's score is the largest weight of its tokens less ``DRIFT``.

Scoring: per text, the Ruzzo-Tompa scan finds all maximal scoring segments in linear time.
Karlin-Altschul statistics make them comparable: lambda solves E[exp(lambda s)] = 1 over the
words of untoxic training texts, K is fitted to their best segments (Gumbel), and a segment of
score S in n words has E = K n exp(-lambda S).  The segments of a text are aggregated by the
sum statistic of its r best (the r with the smallest probability), and a logistic curve
over that evidence, fitted on the training fold, gives the score.

Cases: a null or empty text has no segment and gets the score of no evidence; null ids and
repeated rows are scored as any other row; several labels of one id count as their maximum,
null labels as none; ties between segments of one score keep the earlier one; extra columns are
not read; an empty table gives no rows; without labels of both classes every score is 0."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from migscope.llm.text import column, let_go, mix, pieces, stored

BITS = 20
PREFIXES = (4, 5, 6)
#: Characters that a wide character (three bytes or more) is read with, itself counted.
WIDE = 3
#: Odd base of the hash of byte ranges, and its inverse modulo 2**64.
BASE = 0xD6E8FEB86659FD93
INVERSE = pow(BASE, -1, 1 << 64)
#: Weight of the prior in pseudo-counts of a class, and what a word of no evidence costs.
PRIOR = 2000.0
DRIFT = 1.0
#: Bytes of text that a task reads at once.  Reading takes about 60 bytes a byte, so about 60 MB; a longer
#: text is read alone and takes as much for each of its bytes.
SLICE = 1 << 20
#: Word scores are cut to this range for the calibration histogram.
LOW, HIGH, STEP = -8.0, 12.0, 0.05
#: The range of evidence in which the curve rises.
EVIDENCE = (-10.0, 30.0)
#: A passage is reported if fewer than this many are expected by chance in its text.
SIGNIFICANT = 0.01
THRESHOLD = 0.7

#: Separators to blanks, A-Z to lower case; every other byte stays.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def tokens(texts: list[bytes]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
    """(words of each text, bucket of each token of each word in turn, inner grams of each word, their buckets)."""
    data = np.frombuffer(b" " + b" ".join(texts).translate(TABLE) + b" ", np.uint8)
    lead = (data & 0xC0) != 0x80
    lead[1:] |= data[:-1] == 32  # whatever follows a blank
    pos = np.flatnonzero(lead)
    solid, wide = data[pos] != 32, data[pos] >= 0xE0
    start = solid.copy()
    start[1:] &= ~solid[:-1] | wide[1:] | wide[:-1]
    w = np.flatnonzero(start)
    border, blank = np.flatnonzero(start | ~solid), np.flatnonzero(~solid)
    single = wide[w]
    end = np.where(single, np.minimum(w + WIDE, blank[np.searchsorted(blank, w)]), border[np.searchsorted(border, w, "right")])
    counts = np.diff(np.searchsorted(pos[w], np.cumsum([1] + [len(t) + 1 for t in texts])))
    # Sums of byte times power: the hash of any range of bytes is a difference of two.
    power, back = (np.cumprod(np.where(np.arange(len(data) + 1) > 0, np.uint64(x), np.uint64(1))) for x in (BASE, INVERSE))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:-1])])

    def bucket(i: np.ndarray, j: np.ndarray, kind: int) -> np.ndarray:
        x = (sums[pos[j]] - sums[pos[i]]) * back[pos[i]]
        return (mix(x * np.uint64(0x9E3779B97F4A7C15) + np.uint64(kind)) >> np.uint64(64 - BITS)).astype(np.int64)

    out = [bucket(w, np.minimum(w + np.where(single, k - PREFIXES[0] + 1, k), end), k) for k in PREFIXES]
    out.append(bucket(w, end, 0))
    gram = PREFIXES[-1]
    n = np.where(single, 0, np.maximum(end - w - gram, 0))
    owner = np.repeat(w + 1 - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    return counts, out, n, bucket(owner, owner + gram, gram)


def words(texts: list[bytes]) -> tuple[np.ndarray, list[np.ndarray]]:
    """(words of each text, bucket of each token of each word in turn), without the inner grams."""
    return tokens(texts)[:2]


def token_counts(train: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Occurrences of each bucket in untoxic and toxic training texts."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        total = np.zeros((2, 1 << BITS), np.int64)
        for batch, texts in pieces(batches, "text", SLICE):
            n, buckets, grams, inner = tokens(texts)
            label = np.repeat(column(batch, "label").to_numpy(zero_copy_only=False), n)
            of = np.concatenate([*[label] * len(buckets), np.repeat(label, grams)]).astype(np.int64)
            total += np.bincount((of << BITS) + np.concatenate([*buckets, inner]), minlength=2 << BITS).reshape(2, -1)
        some = np.flatnonzero(total.any(axis=0))
        for lo in range(0, len(some), 65536):
            s = some[lo:lo + 65536]
            yield pa.RecordBatch.from_arrays([pa.array(s.astype(np.int32)), pa.array(total[0, s]), pa.array(total[1, s])], ["bucket", "n0", "n1"])

    sums = train.select("text", "label").mapInArrow(counted, "bucket int, n0 long, n1 long").groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    # Rarer ones are noise: a weaker prior on them loses toxic texts or flags clean ones (README).
    got = sums.where("n0 + n1 >= 3").toArrow()  # at most 2**BITS rows
    out = np.zeros((2, 1 << BITS))
    at = got.column("bucket").to_numpy()
    out[0, at], out[1, at] = got.column("n0").to_numpy(), got.column("n1").to_numpy()
    return out[0], out[1]


def log_odds(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Dirichlet-prior log-odds ratio of each bucket, toxic against untoxic."""
    total = n0 + n1
    prior = PRIOR * (total + 0.01) / (total + 0.01).sum()
    odds = lambda n: np.log((n + prior) / (n.sum() + PRIOR - n - prior))
    return np.where(total > 0, odds(n1) - odds(n0), 0.0).astype(np.float32)


def word_scores(texts: list[bytes], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n, buckets, grams, inner = tokens(texts)
    best = weights[buckets[0]]
    for b in buckets[1:]:
        best = np.maximum(best, weights[b])
    some = np.flatnonzero(grams)
    if len(some):
        best[some] = np.maximum(best[some], np.maximum.reduceat(weights[inner], (np.cumsum(grams) - grams)[some]))
    return n, np.clip(best.astype(np.float64) - DRIFT, LOW, HIGH)


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first word, end, score), in linear time (Ruzzo and Tompa)."""
    positive = np.flatnonzero(scores > 0)
    if not len(positive):
        return []
    total = np.concatenate([[0.0], np.cumsum(scores)])
    lows, highs, at = total[positive].tolist(), total[positive + 1].tolist(), positive.tolist()
    found: list[list] = []  # low sum, high sum, first, end, nearest earlier candidate with a smaller low sum
    for low, high, first in zip(lows, highs, at, strict=True):
        end = first + 1
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][0] >= low:
                j = found[j][4]
            if j < 0 or found[j][1] >= high:
                break
            low, first = found[j][0], found[j][2]
            del found[j:]
        found.append([low, high, first, end, j])
    return [(first, end, high - low) for low, high, first, end, _ in found]


def evidence(scores: list[float], n: int, lam: float, log_k: float) -> float:
    """Minus the logarithm of the sum statistic's probability, for the best r."""
    if not scores:
        return 0.0
    base, total, best = log_k + math.log(max(n, 1)), 0.0, -math.inf
    for r, s in enumerate(sorted(scores, reverse=True), start=1):
        total += lam * s - base
        if r > 1 and lam * s <= base:
            break
        best = max(best, total - (r - 1) * math.log(max(total, 1.0)) + math.lgamma(r + 1) + math.lgamma(r))
    return best


def histogram(train: DataFrame, weights) -> np.ndarray:
    """Histogram of the word scores of untoxic training texts."""
    size = round((HIGH - LOW) / STEP) + 1

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for _, texts in pieces(batches, "text", SLICE):
            total += np.bincount(np.rint((word_scores(texts, weights.value)[1] - LOW) / STEP).astype(np.int64), minlength=size)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], ["bin", "n"])

    rows = train.where("label = 0").select("text").mapInArrow(counted, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(size)
    for r in rows:
        out[r["bin"]] = r["n"]
    return out


def solve_lambda(hist: np.ndarray) -> float:
    """The positive root of E[exp(lambda s)] = 1 (the mean of s is negative by the drift)."""
    p, s = hist / max(hist.sum(), 1), LOW + STEP * np.arange(len(hist))
    low, high = 1e-3, 20.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if float((p * np.exp(np.minimum(mid * s, 500))).sum()) < 1 else (low, mid)
    return (low + high) / 2


def logistic(x: np.ndarray, n0: np.ndarray, n1: np.ndarray) -> tuple[float, float]:
    """Slope and offset of P(toxic | evidence), by damped Newton steps with a small ridge.  ``x``: values
    of the evidence, ``n0`` and ``n1``: untoxic and toxic training texts of each."""
    weight = n0 + n1
    mean = float((weight * x).sum() / weight.sum())
    scale = max(float(np.sqrt((weight * (x - mean) ** 2).sum() / weight.sum())), 1e-6)
    z = np.stack([(x - mean) / scale, np.ones(len(x))], 1)

    def likelihood(w: np.ndarray) -> float:
        y = z @ w
        return float(-(n1 * np.logaddexp(0, -y) + n0 * np.logaddexp(0, y)).sum() - 0.005 * (w @ w))

    w, now = np.zeros(2), likelihood(np.zeros(2))
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z.T * (weight * p * (1 - p))) @ z + 0.01 * np.eye(2), z.T @ (n1 * (1 - p) - n0 * p) - 0.01 * w)
        size = 1.0
        while size > 1e-4 and likelihood(w + size * step) < now:
            size /= 2
        after = likelihood(w + size * step)
        if after - now < 1e-9:
            break
        w, now = w + size * step, after
    slope = max(float(w[0]), 0.0) / scale
    return slope, float(w[1]) - slope * mean


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, fold) -> DataFrame:
    own = labels.where(F.col(label_col).isNotNull() & fold(F.col(id_col))).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    texts = docs.where(fold(F.col(id_col))).select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text"))
    # A merge join at every size: labels grow with the documents.
    return texts.join(own.hint("merge"), texts.doc == own.id).select("text", "label")


def train_fold(id_column):
    """Rows to learn from: crc32 of the id as text, mod 3, is not 1."""
    return F.crc32(id_column.cast("string").cast("binary")) % 3 != 1


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fold=train_fold):
    """(weights, lambda, log K, slope, offset), or None without labels of both classes."""
    spark = docs.sparkSession
    train = stored(training_rows(docs, labels, id_col, text_col, label_col, fold), "toxicity-train")
    seen = {r["label"] for r in train.groupBy("label").count().collect()}
    if not {0, 1} <= seen:
        return None
    weights = log_odds(*token_counts(train))
    shared = spark.sparkContext.broadcast(weights)
    lam = solve_lambda(histogram(train, shared))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in pieces(batches, "text", SLICE):
            n, s = word_scores(texts, shared.value)
            ends = np.cumsum(n)
            top = [max((x for _, _, x in segments(s[e - k:e])), default=0.0) for k, e in zip(n.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(n.astype(np.int64)), pa.array(top, pa.float64())], ["n", "top"])

    untoxic = train.where("label = 0").select("text").mapInArrow(best, "n long, top double").where("n > 0 and top > 0")
    mean = untoxic.agg(F.avg(F.lit(lam) * F.col("top") - F.log("n")).alias("m")).collect()[0]["m"]
    log_k = (mean if mean is not None else 0.0) - 0.5772156649  # the mean of a standard Gumbel

    scored = train.mapInArrow(scorer(shared, lam, log_k, None, ["label"]), "label int, n_words long, evidence double, score double, passages array<struct<first:int,end:int,score:double>>")
    bins = scored.groupBy(F.round(F.least(F.greatest("evidence", F.lit(EVIDENCE[0])), F.lit(EVIDENCE[1])) * 4).alias("x"), "label").count().collect()
    x = sorted({r["x"] for r in bins})
    n = np.zeros((2, len(x)))
    for r in bins:
        if r["label"] in (0, 1):
            n[r["label"], x.index(r["x"])] += r["count"]
    slope, offset = logistic(np.array(x) / 4, n[0], n[1])
    return shared, lam, log_k, slope, offset


def scorer(weights, lam: float, log_k: float, curve: tuple[float, float] | None, keep: list[str]):
    kind = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch, texts in pieces(batches, "text", SLICE):
            n, s = word_scores(texts, weights.value)
            facts, passages = [], []
            for k, e in zip(n.tolist(), np.cumsum(n).tolist(), strict=True):
                found = segments(s[e - k:e])
                facts.append(evidence([x for _, _, x in found], k, lam, log_k))
                bound = (log_k + math.log(max(k, 1)) - math.log(SIGNIFICANT)) / lam
                passages.append([{"first": a, "end": b, "score": x} for a, b, x in found if x >= bound])
            facts = np.array(facts)
            score = 1 / (1 + np.exp(-np.clip(curve[0] * np.clip(facts, *EVIDENCE) + curve[1], -30, 30))) if curve else np.zeros(len(facts))
            yield pa.RecordBatch.from_arrays([*[column(batch, c) for c in keep], pa.array(n.astype(np.int64)), pa.array(facts, pa.float64()), pa.array(score, pa.float64()),
                                              pa.array(passages, kind)], [*keep, "n_words", "evidence", "score", "passages"])

    return scored


def score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fold=train_fold) -> DataFrame:
    """(id, held_out, score, predicted, n_words, evidence, passages) of every row; the passages
    are word ranges with their scores."""
    model = fit(docs, labels, id_col, text_col, label_col, fold)
    return apply(docs, model, threshold, id_col, text_col, fold)


def apply(docs: DataFrame, model, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", fold=train_fold) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(~fold(F.col(id_col)), F.lit(False)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    if model is None:
        spark = docs.sparkSession
        model = spark.sparkContext.broadcast(np.zeros(1 << BITS, np.float32)), 1.0, 0.0, 0.0, -30.0
    weights, lam, log_k, slope, offset = model
    kind = dict(rows.dtypes)["id"]
    out = rows.mapInArrow(scorer(weights, lam, log_k, (slope, offset), ["id", "held_out"]),
                          f"id {kind}, held_out boolean, n_words long, evidence double, score double, passages array<struct<first:int,end:int,score:double>>")
    return out.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_words", "evidence", "passages")


def reject(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fold=train_fold) -> DataFrame:
    """``docs`` without the rows that are predicted toxic; all columns, no shuffle of the rows."""
    model = fit(docs, labels, id_col, text_col, label_col, fold)
    if model is None:
        return docs
    weights, lam, log_k, slope, offset = model
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[text_col].cast("string").alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    scored = rows.mapInArrow(scorer(weights, lam, log_k, (slope, offset), ["row"]), f"row {kind}, n_words long, evidence double, score double, passages array<struct<first:int,end:int,score:double>>")
    return scored.where(F.col("score") < threshold).select("row.*")


def digest(scored: DataFrame) -> DataFrame:
    return scored.select("doc_id", "held_out", "score", "predicted", "n_words", "evidence", F.size("passages").cast("long").alias("n_passages"))
