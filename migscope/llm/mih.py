"""Approximate nearest neighbours: multi-index hashing over learned rotated binary codes.

Fit (bounded: about ``FIT`` vectors, chosen by a hash of their id): principal axes, then the rotation
that brings the vectors closest to a cube's corners (iterative quantisation); the signs are the
code.  The search radius is the Hamming distance that holds ``AIM`` of the true neighbours within the
sample; the whole table is denser, so its neighbours are nearer.

Index: every row's code is cut into 8-bit substrings, each with its own table (rows sorted by
the substring's value).  A code within radius r = m a + b of a query differs by at most a in one of the first
b + 1 substrings or by at most a - 1 in another one (pigeonhole), so those buckets hold every code
of the ball; their rows are united, held against the radius, and reranked by the exact
inner product in double precision.  A query with too few rows in the ball doubles back with a larger one.

Rows are dealt to shards by a hash of the id and queries to blocks; a task holds one shard's index
and one block of queries, and yields each query's best ``k`` of the shard, which one
aggregation merges.  Nothing else grows with the table.

Cases: vectors that are null, zero, hold null or non-finite components, or differ from the most
frequent length take no part, null ids neither; repeated rows (id and vector) count once; ties go
to the smaller id; an empty table gives no rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from migscope.llm.minhash import groups
from migscope.llm.text import partitions, stored

K, EVERY = 20, 20
FIT, PROBE, AIM = 8192, 256, 0.97
SHARD, QUERIES = 16384, 2048
COUNT = np.array([bin(v).count("1") for v in range(256)], np.uint8)


def learn(sample: np.ndarray, bits: int, k: int = K) -> tuple[np.ndarray, np.ndarray, int]:
    """(mean, projection to the rotated axes, radius)."""
    mean = sample.mean(axis=0)
    z = sample - mean
    axes = np.linalg.eigh(z.T @ z)[1][:, ::-1][:, :bits]
    v = z @ axes
    rotation = np.linalg.qr(np.random.default_rng(7).normal(size=(bits, bits)))[0]
    for _ in range(30):
        u, _, w = np.linalg.svd(v.T @ np.where(v @ rotation > 0, 1.0, -1.0))
        rotation = u @ w
    projection = axes @ rotation
    code = encode(sample, mean, projection)
    probe = np.arange(0, len(sample), max(1, len(sample) // PROBE))
    products = sample[probe] @ sample.T
    products[np.arange(len(probe)), probe] = -np.inf
    best = np.argsort(-products, axis=1)[:, :min(k, len(sample) - 1)]
    distance = COUNT[code[probe][:, None, :] ^ code[best]].sum(axis=2)
    radius = int(np.quantile(distance, AIM)) + 1 if distance.size else bits
    return mean, projection, min(radius, bits)


def encode(vectors: np.ndarray, mean: np.ndarray, projection: np.ndarray) -> np.ndarray:
    return np.packbits((vectors - mean) @ projection > 0, axis=1)


class Index:
    """One table a substring over the codes of a shard."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.rows = [np.argsort(c, kind="stable") for c in codes.T]
        self.first = [np.concatenate([[0], np.cumsum(np.bincount(c, minlength=256))]) for c in codes.T]
        self.values = np.arange(256, dtype=np.uint8)

    def ball(self, query: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose code is within ``radius`` of the query's, in ascending order."""
        m = len(query)
        a, b = divmod(radius, m)
        seen = np.zeros(len(self.codes), bool)
        for j in range(m):
            reach = a if j <= b else a - 1
            if reach < 0:
                continue
            for v in np.flatnonzero(COUNT[self.values ^ query[j]] <= reach).tolist():
                seen[self.rows[j][self.first[j][v]:self.first[j][v + 1]]] = True
        met = np.flatnonzero(seen)
        return met[COUNT[self.codes[met] ^ query].sum(axis=1) <= radius]


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v): distinct rows that take part."""
    v = F.col("v")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & v.isNotNull()).where(fine)
    return rows.dropDuplicates(["id", "v"])


def search(vectors: DataFrame, k: int = K, every: int = EVERY, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): the ``k`` rows nearest to each row whose id is divisible by ``every``."""
    rows = stored(usable(vectors, id_col, vec_col), "mih-vectors")
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    empty = f"query_id long, rank int, {id_col} long, score double"
    if not lengths:
        return rows.sparkSession.createDataFrame([], empty)
    dim, total = lengths[0]["d"], lengths[0]["count"]
    rows = rows.where(F.size("v") == dim)
    sample = rows.where(F.pmod(F.xxhash64(F.lit("fit"), "id"), F.lit(max(1, -(-total // FIT)))) == 0).select("v").limit(2 * FIT).toArrow()
    sample = sample.column("v").combine_chunks().flatten().to_numpy().reshape(-1, dim)
    bits = min(dim, 64) // 8 * 8
    if len(sample) < 2 or not bits:  # too little to learn from: every row is in the ball
        bits = 8
        mean, projection, radius = np.zeros(dim), np.zeros((dim, 8)), 8
    else:
        mean, projection, radius = learn(sample, bits, k)

    n_shards, n_blocks = max(1, -(-total // SHARD)), max(1, -(-total // (every * QUERIES)))
    shard = F.pmod(F.xxhash64("id"), F.lit(n_shards)).cast("int")
    block = F.pmod(F.xxhash64(F.lit("query"), "id"), F.lit(n_blocks)).cast("int")
    span = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    data = rows.select(shard.alias("shard"), span(n_blocks).alias("block"), F.lit(1).alias("side"), "id", "v")
    asks = rows.where(F.col("id") % every == 0).select(span(n_shards).alias("shard"), block.alias("block"), F.lit(0).alias("side"), "id", "v")

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, ["shard", "block"]):
            side, ids = group["side"].to_numpy(), group["id"].to_numpy()
            x = group["v"].combine_chunks().flatten().to_numpy().reshape(-1, dim)
            codes = encode(x, mean, projection)
            at = np.flatnonzero(side == 1)
            index, x_data, id_data = Index(codes[at]), x[at], ids[at]
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for q in np.flatnonzero(side == 0):
                r, others = radius, len(at) - int((id_data == ids[q]).sum())
                while True:
                    near = index.ball(codes[q], r)
                    near = near[id_data[near] != ids[q]]
                    if len(near) >= min(k, others) or r >= bits:
                        break
                    r = min(bits, r + 2)
                score = (x_data[near] * x[q]).sum(axis=1)  # each row by itself, so equal vectors have equal scores
                if len(near) > k:
                    cut = np.partition(score, len(score) - k)[len(score) - k]
                    keep = score >= cut
                    near, score = near[keep], score[keep]
                best = np.lexsort((id_data[near], -score))[:k]
                out.append((np.full(len(best), ids[q]), id_data[near[best]], score[best]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["query_id", "id", "score"])

    dealt = data.union(asks).repartition(max(partitions(rows.sparkSession), n_shards * n_blocks), "shard", "block").sortWithinPartitions("shard", "block")
    found = dealt.mapInArrow(nearest, "query_id long, id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")  # at most k rows a shard and query
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")


__all__ = ["Index", "encode", "learn", "search"]
