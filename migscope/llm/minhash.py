"""MinHash near-dedup: universal hash minima, banding, verification, connected components.

1. A text's set is its distinct ``SHINGLE``-word shingles (64-bit hashes).  Texts with one
   set are one class, represented by its least id; copies cost nothing from here on.
2. Bands of ``ROWS`` minima of universal hashes a x + b; the bands' keys make buckets.  Two sets
   of similarity s share none with probability (1 - s^ROWS)^bands; there are as many bands as
   keep that under half of ``MISS`` at the threshold (46 at 0.85, 71 at 0.80).
3. Star pairs: the members of a bucket against its least one.  A pair is verified by its
   signatures and then on the full sets; components of these links follow.
4. What is left are pairs of one bucket in different components.  Such buckets are cut in blocks
   of ``BLOCK`` rows, blocks are compared by signature (a pair only in its first common
   band) and then by bottom sketches; a spanning forest of the links of each pair of blocks, and the pairs that
   sketches cannot decide, are verified on the full sets, and components follow again.

Buckets, stars and blocks of any size are split over tasks; no group is held in one.  A text
goes only to the tasks that verify it, next to the centre of its star.

Cases: null or empty texts have the empty set and link with nothing; a null id sorts last;
rows that agree in id and text share a result; an empty table gives no rows."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from migscope.llm.components import components
from migscope.llm.text import bounds, column, id_back, keyed, mix, partitions, pieces, raw, stored, without, word_hashes

SHINGLE, PERCENT = 5, 85
#: Minima of a band, and of a whole signature (at least; those beyond the bands are in it only).
ROWS, MINIMA = 6, 384
#: Chance that a pair at the threshold is lost: by sharing no band at most the first half, by fewer equal
#: minima than a likely pair has (exact binomial) at most the other half.
MISS = 1e-9
BLOCK, STAR = 1024, 256
#: Least shingle hashes by which blocks compare two sets (the whole set, if it has no more).
SKETCH = 512
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
NODE = "struct<id:long,h:long>"


def bands_for(percent: int, per_band: int) -> int:
    """The least number of bands by which a pair at the threshold is missed with at most half of ``MISS``."""
    return max(1, math.ceil(math.log(MISS / 2) / math.log(max(1 - (percent / 100) ** per_band, MISS / 2))))


def agree_for(percent: int, minima: int, chance: float = 1 / 256) -> int:
    """Equal minima (eight bits of each, unlike ones equal by ``chance``) that a pair at the threshold has, but for half of ``MISS``."""
    p = percent / 100 + (1 - percent / 100) * chance
    least, below = 0, 0.0
    while least < minima:
        log = math.lgamma(minima + 1) - math.lgamma(least + 1) - math.lgamma(minima - least + 1) + least * math.log(p) + (minima - least) * math.log1p(-p) if p < 1 else -math.inf
        below += math.exp(log)
        if below > MISS / 2:
            break
        least += 1
    return least


def factors(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (odd) and offsets of the universal hashes, from their number."""
    x = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (x[:n] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (x[n:] >> np.uint64(32)).astype(np.uint32)


def shingle_sets(texts: list[bytes], k: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    split = [t.translate(LOWER).split() for t in texts]
    hashes = word_hashes([w for words in split for w in words])
    out, at = [], 0
    for words in split:
        n = len(words)
        h = hashes[at:at + n]
        at += n
        if not n:
            out.append(np.zeros(0, np.uint64))
            continue
        m = min(n, k)
        x = h[:n - m + 1].copy()
        for j in range(1, m):
            x = x * np.uint64(0x9E3779B97F4A7C15) + h[j:n - m + 1 + j]
        out.append(np.unique(mix(x + np.uint64(m))))
    return out


def signatures(sets: list[np.ndarray], n: int) -> np.ndarray:
    """Minima of ``n`` universal hashes of each set (no set is empty)."""
    a, b = factors(n)
    x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    starts = bounds([len(s) for s in sets])[:-1]
    out = np.empty((len(sets), n), np.uint32)
    y = np.empty_like(x)
    for k in range(n):
        np.multiply(x, a[k], out=y)
        np.add(y, b[k], out=y)
        out[:, k] = np.minimum.reduceat(y, starts)
    return out


def profile(rows: DataFrame, shingle: int, bands: int, per_band: int, extra: int) -> DataFrame:
    """(id, h, n, k1, k2, sig, bands): set size, its 128-bit name, eight bits of each minimum, band keys."""
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, "text", 1 << 20):
            sets = shingle_sets(texts, shingle)
            some = [k for k, s in enumerate(sets) if len(s)]
            sig: list = [None] * len(sets)
            keys: list = [None] * len(sets)
            if some:
                minima = signatures([sets[k] for k in some], bands * per_band + extra)
                band = np.zeros((len(some), bands), np.uint64)
                for r in range(per_band):
                    band = mix(band + minima[:, r:bands * per_band:per_band].astype(np.uint64) + np.uint64(r + 1))
                for row, k in enumerate(some):
                    sig[k], keys[k] = (minima[row] & np.uint32(255)).astype(np.uint8).tobytes(), band[row].astype(np.int64)
            names = [xxhash.xxh3_128_intdigest(s.tobytes()) for s in sets]
            half = lambda v: np.array(v, np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([column(batch, "id"), column(batch, "h"), pa.array([len(s) for s in sets], pa.int64()),
                                              pa.array(half([x >> 64 for x in names])), pa.array(half([x & (1 << 64) - 1 for x in names])),
                                              pa.array(sig, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["id", "h", "n", "k1", "k2", "sig", "bands"])

    return rows.mapInArrow(made, "id long, h long, n long, k1 long, k2 long, sig binary, bands array<long>")


def likely(x: bytes, y: bytes) -> int:
    return int((np.frombuffer(x, np.uint8) == np.frombuffer(y, np.uint8)).sum())


def verified(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int, agree: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold.  ``a`` is the centre of a star: its
    text stands before those of up to ``STAR`` partners (on average) in a sorted partition,
    which is read once; a larger star has as many copies of the centre as it needs."""
    stars = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / STAR).cast("int").alias("n"))
    centres = stars.select("a", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("part"), F.col("a").alias("node"), F.lit(0).alias("side"))
    s = stars.withColumnRenamed("a", "c")
    members = pairs.join(s, pairs.a == s.c).select("a", F.pmod(F.xxhash64("b"), F.col("n")).cast("int").alias("part"), F.col("b").alias("node"), F.lit(1).alias("side"))
    rows = centres.union(members).join(texts, "node").select("a", "part", "side", "node", "sig", "text")

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, own, sig = None, None, b""
        for batch, bodies in pieces(batches, "text"):
            a, side, node = (column(batch, c).to_pylist() for c in ("a", "side", "node"))
            sigs, links = raw(column(batch, "sig")), []
            for k, text in enumerate(bodies):
                if side[k] == 0:
                    centre, own, sig = a[k], None, sigs[k]
                    body = text
                elif likely(sig, sigs[k]) >= agree:
                    if own is None:
                        own = shingle_sets([body], shingle)[0]
                    other = shingle_sets([text], shingle)[0]
                    both = np.concatenate([own, other])
                    both.sort()
                    common = int((both[1:] == both[:-1]).sum())
                    if 100 * common >= percent * (len(both) - common):
                        links.append((centre, node[k]))
            kind = pa.struct([("id", pa.int64()), ("h", pa.int64())])
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], kind), pa.array([y for _, y in links], kind)], ["a", "b"])

    dealt = rows.repartition(partitions(pairs.sparkSession), "a", "part").sortWithinPartitions("a", "part", "side")
    return dealt.mapInArrow(checked, f"a {NODE}, b {NODE}")


def sketches(texts: DataFrame, shingle: int) -> DataFrame:
    """(node, sketch) of (node, text): the ``SKETCH`` least shingle hashes, 32 bits of each, ascending."""
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, bodies in pieces(batches, "text", 1 << 20):
            own = [(x[:SKETCH] >> np.uint64(32)).astype("<u4").tobytes() for x in shingle_sets(bodies, shingle)]
            yield pa.RecordBatch.from_arrays([column(batch, "node"), pa.array(own, pa.binary())], ["node", "sketch"])

    return texts.select("node", "text").mapInArrow(made, f"node {NODE}, sketch binary")


def compare(x: np.ndarray, y: np.ndarray, nx: int, ny: int, percent: int, least: int, most: int) -> int:
    """What two sketches say of their sets of ``nx`` and ``ny``: 0 no link, 1 perhaps, 2 a link.  Whole sets are compared
    where the sketches hold them (one equal hash may be by chance).  Otherwise the share of the union's least hashes
    that both have estimates the similarity: no link below ``least``, a link from ``most`` on."""
    both = np.concatenate([x, y])
    both.sort()
    if nx <= SKETCH and ny <= SKETCH:
        common = int((both[1:] == both[:-1]).sum())
        sure = 100 * (common - 1) >= percent * (nx + ny - common + 1)
        return 2 if sure else int(100 * common >= percent * (nx + ny - common))
    first = np.ones(len(both), bool)
    first[1:] = both[1:] != both[:-1]
    end = int(np.searchsorted(np.cumsum(first), SKETCH + 1))
    common = end - int(first[:end].sum())
    return 0 if common < least else 2 if common >= most else 1


def likely_pairs(rows: DataFrame, facts: DataFrame, agree: int, percent: int) -> DataFrame:
    """(a, b) of one bucket but different components that link or may link.  ``rows``: band, key, node, comp;
    ``facts``: node, n, sig, bands, sketch.  A bucket of many rows is dealt in blocks, each pair of blocks
    is a group of about 2 ``BLOCK`` rows.  Pairs whose signatures agree are compared by sketch; of the
    links a group finds it gives a spanning forest (so no more rows than it has), and beside it what only the full
    sets can decide."""
    sizes = rows.groupBy("band", "key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("m"))
    r = rows.join(sizes, ["band", "key"]).withColumn("own", F.pmod(F.xxhash64("node"), F.col("m")).cast("int"))
    r = r.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    r = r.select("band", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).alias("second"), "node", "comp")
    r = r.join(facts.select("node", "n", "sig", "bands", "sketch"), "node")
    least, most = agree_for(percent, SKETCH, 0), SKETCH + 1 - agree_for(100 - percent, SKETCH, 0)

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("id", pa.int64()), ("h", pa.int64())])
        for group in groups(batches, ["band", "key", "i", "j"]):
            if group.num_rows < 2:
                continue
            band = group["band"][0].as_py()
            node = group["node"].combine_chunks()
            ids = np.stack([node.field(0).to_numpy(), node.field(1).to_numpy()], 1)
            comp = group["comp"].combine_chunks()
            comp = np.unique(np.stack([comp.field(0).to_numpy(), comp.field(1).to_numpy()], 1), axis=0, return_inverse=True)[1].reshape(-1)
            n = group["n"].to_numpy()
            sig = np.frombuffer(b"".join(group["sig"].to_pylist()), np.uint8).reshape(len(n), -1)
            keys = group["bands"].combine_chunks().values.to_numpy().reshape(len(n), -1)
            sketch = [np.frombuffer(x, "<u4") for x in group["sketch"].to_pylist()]
            second = group["second"].to_numpy()
            cross = group["i"][0].as_py() != group["j"][0].as_py()
            x: list[int] = []
            y: list[int] = []
            for k in range(len(n)):
                rest = np.arange(len(n)) if cross else np.arange(k + 1, len(n))
                if cross and second[k]:
                    continue
                rest = rest[(comp[rest] != comp[k]) & (100 * np.minimum(n[rest], n[k]) >= percent * np.maximum(n[rest], n[k])) & (second[rest] if cross else True)]
                rest = rest[(sig[rest] == sig[k]).sum(1) >= agree]
                rest = rest[~(keys[rest, :band] == keys[k, :band]).any(1)]
                for j in rest.tolist():
                    if comp[j] == comp[k]:  # linked by now
                        continue
                    found = compare(sketch[k], sketch[j], int(n[k]), int(n[j]), percent, least, most)
                    if found:
                        x.append(k)
                        y.append(j)
                    if found == 2:
                        comp[comp == comp[j]] = comp[k]
            if x:
                a, b = ids[x], ids[y]
                swap = (a[:, 0] > b[:, 0]) | ((a[:, 0] == b[:, 0]) & (a[:, 1] > b[:, 1]))
                a[swap], b[swap] = b[swap].copy(), a[swap].copy()
                made = lambda v: pa.StructArray.from_arrays([pa.array(v[:, 0]), pa.array(v[:, 1])], fields=list(kind))
                yield pa.RecordBatch.from_arrays([made(a), made(b)], ["a", "b"])

    dealt = r.repartition(partitions(rows.sparkSession), "band", "key", "i", "j").sortWithinPartitions("band", "key", "i", "j")
    return dealt.mapInArrow(compared, f"a {NODE}, b {NODE}")


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys, over the borders of batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = [column(batch, k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for v in values:
            change[1:] |= v[1:] != v[:-1]
        first = tuple(v[0] for v in values)
        if last is not None and first != last:
            change[0] = True
        cuts = np.flatnonzero(change)
        at = 0
        for c in cuts.tolist():
            if c > at:
                held.append(batch.slice(at, c - at))
            if held:
                yield pa.Table.from_batches(held)
            held, at = [], c
        held.append(batch.slice(at))
        last = tuple(v[-1] for v in values)
    if held:
        yield pa.Table.from_batches(held)


def linked(rows: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, bands: int | None = None, per_band: int = ROWS, agree: int | None = None, extra: int | None = None) -> DataFrame:
    """(id, h, n, comp) of every row of (id, h, text).  What is not given follows from ``percent``."""
    bands = bands_for(percent, per_band) if bands is None else bands
    extra = max(0, MINIMA - bands * per_band) if extra is None else extra
    agree = agree_for(percent, bands * per_band + extra) if agree is None else agree
    all_rows = stored(profile(rows, shingle, bands, per_band, extra), "minhash-rows")
    node = F.struct("id", "h")
    full = all_rows.where("n > 0")
    reps = stored(full.groupBy("k1", "k2").agg(F.min(F.struct("id", "h", "n", "sig", "bands")).alias("r"))
                  .select("k1", "k2", F.struct("r.id", "r.h").alias("node"), "r.n", "r.sig", "r.bands"), "minhash-classes")

    flat = reps.select("node", F.posexplode("bands").alias("band", "key"))
    shared = flat.groupBy("band", "key").agg(F.min("node").alias("hub"), F.max("node").alias("top")).where(F.col("hub") < F.col("top"))
    buckets = stored(flat.join(shared.select("band", "key", "hub"), ["band", "key"]), "minhash-buckets")
    texts = rows.select(node.alias("node"), "text").join(buckets.select("node").distinct(), "node").dropDuplicates(["node"])
    texts = stored(texts.join(reps.select("node", "sig"), "node"), "minhash-texts")

    stars = buckets.where(F.col("node") != F.col("hub")).select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    first = components(verified(stars, texts, shingle, percent, agree))

    root = first.select(F.col("a").alias("node"), F.col("b").alias("root"))
    placed = buckets.select("band", "key", "node").join(root, "node", "left").select("band", "key", "node", F.coalesce("root", "node").alias("comp"))
    mixed = placed.groupBy("band", "key").agg(F.min("comp").alias("p"), F.max("comp").alias("q")).where(F.col("p") < F.col("q")).select("band", "key")
    rest = stored(placed.join(mixed, ["band", "key"]), "minhash-rest")
    own = rest.select("node").distinct()
    facts = reps.select("node", "n", "sig", "bands").join(sketches(texts.join(own, "node", "left_semi"), shingle), "node")
    more = verified(stored(likely_pairs(rest, facts, agree, percent), "minhash-pairs"), texts, shingle, percent, agree)
    links = components(first.unionByName(more))

    classes = reps.select("k1", "k2", "node").join(links.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left") \
        .select("k1", "k2", F.coalesce("root", "node")["id"].alias("comp"))
    return full.join(classes, ["k1", "k2"]).select("id", "h", "n", "comp").union(all_rows.where("n = 0").select("id", "h", "n", F.col("id").alias("comp")))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", bands: int | None = None, per_band: int = ROWS, agree: int | None = None, extra: int | None = None) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row."""
    out = linked(keyed(docs, id_col, text_col), shingle, percent, bands, per_band, agree, extra)
    return out.select(id_back("id", id_col), F.col("n").alias("n_shingles"), id_back("comp", "component_id"), (F.col("id") == F.col("comp")).alias("kept"))


def representatives(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group, the one with the least id; all columns."""
    found = linked(keyed(docs, id_col, text_col), shingle, percent)
    return without(docs, found.where("id <> comp"), id_col, text_col)


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 4], ' ')) AS x
  FROM (SELECT doc_id, w, unnest(range(1, CAST(greatest(len(w) - 4, 1) + 1 AS BIGINT))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON r.doc_id = e.a),
k AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, k.component_id, d.doc_id = k.component_id AS kept
FROM d JOIN k ON d.doc_id = k.doc_id LEFT JOIN n ON d.doc_id = n.doc_id
"""
