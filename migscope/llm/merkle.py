"""Merkle dataset manifest: leaf coordinates by bitmap ranks, levels by slot arrays.

A leaf is the hash of a row's fields.  Its place among the leaves of its source (ascending by
id) comes from bitmaps, not from a sort: each scan task makes compressed bitmaps of its ids, one
per source and 2**16 ids (an array of 16-bit numbers while that is shorter), these are
merged by key, and a directory of counts over the bitmaps (three levels of 16 bits, so no window
holds more than 65,536 rows) gives what comes before each.  Popcounts inside the bitmap give
the rest.  A row that shares its id with others is placed among them by its leaf.

Levels: nodes are keyed by (source, index >> 12); a task puts the 4,096 nodes of a key into slot
arrays of 16 and reduces them by three levels, so n leaves take log(n) / 12 bits shuffles.  The
subroots, in order of the sources, are reduced by the same passes to the root.  Proofs come down the same way:
a block gets the path above it once, and its nodes add their siblings inside the block.

Cases: a null id sorts last in its source, a null source first; a null or missing field is
``-``; rows of one id are ordered by leaf (equal rows have equal leaves, each its own place
and proof); a null id is not tampered with; a very long text is hashed where it is read and
goes no further; extra columns are not read; an empty table gives no rows."""

from __future__ import annotations

import hashlib
import string
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from migscope.llm.text import LAST, column, partitions, stored

FAN = 16
#: Levels that one shuffle reduces, and the bits of a node's index inside its block.
LEVELS, BITS = 3, 12
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows of one bitmap (only repeated ids give more than 2**16) from which they are dealt to several tasks.
HOT = 1 << 20
LOWS = 1 << 16


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# ---- leaves ---------------------------------------------------------------------

def leaf(fields: list[Column]) -> Column:
    """Hash of the fields: ``-`` for null, else UTF-8 bytes, a colon and the value."""
    return F.sha2(F.concat(*[F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string"))) for c in fields]), 256)


def leaves(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(source key, id, row, leaf, other): ``other`` is the leaf of a row that was tampered with (its text
    in lower case), null for the others; ``row`` numbers the rows."""
    have = [docs[c] if c in docs.columns else F.lit(None).cast("string") for c in fields]
    lower = F.translate(docs[text_col].cast("string"), string.ascii_uppercase, string.ascii_lowercase)
    changed = [lower if c == text_col else x for c, x in zip(fields, have, strict=True)]
    hit = F.crc32(docs[id_col].cast("string").cast("binary")) % 5 == 0
    # Null first, then the sources bytewise.
    key = F.coalesce(F.concat(F.lit("s"), docs[source_col].cast("string")), F.lit(""))
    return docs.select(key.alias("key"), docs[id_col].cast("long").alias("id"), F.monotonically_increasing_id().alias("row"), leaf(have).alias("leaf"), F.when(hit, leaf(changed)).alias("other"))


# ---- bitmaps --------------------------------------------------------------------

def packed(low: np.ndarray) -> bytes:
    """Distinct ascending 16-bit numbers: as they are, or as a bitmap where that is shorter."""
    if len(low) <= LOWS // 16:
        return low.astype("<u2").tobytes()
    bits = np.zeros(LOWS, np.uint8)
    bits[low] = 1
    return b"B" + np.packbits(bits, bitorder="little").tobytes()


def unpacked(payload: bytes) -> np.ndarray:
    if len(payload) % 2 == 0:
        return np.frombuffer(payload, "<u2").astype(np.int64)
    return np.flatnonzero(np.unpackbits(np.frombuffer(payload, np.uint8, offset=1), bitorder="little"))


def ranks(payload: bytes, low: np.ndarray) -> np.ndarray:
    """Members below each of ``low``: the popcount directory up to its word, then inside the word."""
    if len(payload) % 2 == 0:
        return np.searchsorted(np.frombuffer(payload, "<u2"), low)
    words = np.frombuffer(payload, "<u8", offset=1)
    before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
    inside = words[low >> 6] & ((np.uint64(1) << (low & 63).astype(np.uint64)) - np.uint64(1))
    return before[low >> 6] + np.bitwise_count(inside)


def more_of(low: np.ndarray, n: np.ndarray) -> tuple[bytes, bytes]:
    """Ids that occur more than once, and how many more."""
    again = n > 1
    return low[again].astype("<u2").tobytes(), (n[again] - 1).astype("<i8").tobytes()


CONTAINER = "key string, high long, n long, payload binary, again binary, more binary"


def container(key: str, high: int, low: np.ndarray, n: np.ndarray) -> dict:
    again, more = more_of(low, n)
    return {"key": key, "high": high, "n": int(n.sum()), "payload": packed(low), "again": again, "more": more}


def containers(rows: DataFrame) -> DataFrame:
    """One bitmap per source key and 2**16 ids."""
    arrow = pa.schema([("key", pa.string()), ("high", pa.int64()), ("n", pa.int64()), ("payload", pa.binary()), ("again", pa.binary()), ("more", pa.binary())])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = column(batch, "key").dictionary_encode()
            code, ids = keys.indices.to_numpy(), column(batch, "id").to_numpy()
            order = np.lexsort((ids, code))
            code, ids = code[order], ids[order]
            first = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (code[1:] != code[:-1])]))
            n = np.diff(np.append(first, len(ids)))
            code, ids = code[first], ids[first]
            group = np.flatnonzero(np.concatenate([[True], (ids[1:] >> 16 != ids[:-1] >> 16) | (code[1:] != code[:-1])]))
            names = keys.dictionary.to_pylist()
            out = [container(names[code[a]], int(ids[a] >> 16), ids[a:b] & 0xFFFF, n[a:b]) for a, b in zip(group, np.append(group[1:], len(ids)), strict=True)]
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(parts: Iterator[dict]) -> dict:
            head = next(parts)
            second = next(parts, None)
            if second is None:
                return head
            total = np.zeros(LOWS, np.int64)
            for p in (head, second):
                add(total, p)
            for p in parts:
                add(total, p)
            low = np.flatnonzero(total)
            return container(head["key"], head["high"], low, total[low])

        def add(total: np.ndarray, p: dict) -> None:
            total[unpacked(p["payload"])] += 1
            total[np.frombuffer(p["again"], "<u2")] += np.frombuffer(p["more"], "<i8")

        out = []
        for _, parts in runs(batches, ("key", "high")):
            out.append(one(parts))
            if len(out) == 64:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    made = rows.select("key", F.coalesce("id", F.lit(LAST)).alias("id")).mapInArrow(partial, CONTAINER)
    return made.repartition("key", "high").sortWithinPartitions("key", "high").mapInArrow(merged, CONTAINER)


def runs(batches: Iterator[pa.RecordBatch], by: tuple[str, ...]) -> Iterator[tuple[tuple, Iterator[dict]]]:
    """(values of ``by``, its rows one by one) of each run of rows that agree in ``by``; the rows must be read before the next run."""
    import itertools
    rows = (r for batch in batches for k in range(0, batch.num_rows, 256) for r in batch.slice(k, 256).to_pylist())
    return itertools.groupby(rows, key=lambda r: tuple(r[c] for c in by))


def offsets(bitmaps: DataFrame) -> DataFrame:
    """(key, high, before, total): rows of the source before each bitmap, and in all.  The directory's
    levels cut 16 bits each from ``high``, so a window holds 65,536 rows at most."""
    def before(*by: str) -> Column:
        return F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy("high").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    up = lambda df: df.groupBy("key", F.shiftright("high", 16).alias("high")).agg(F.sum("n").alias("n"))
    low = bitmaps.select("key", "high", "n")
    mid = stored(up(low), "merkle-directory")
    top = up(mid)
    total = top.groupBy("key").agg(F.sum("n").alias("total"))
    at = top.select("key", F.col("high").alias("up"), before("key").alias("b")).join(total, "key")
    for level in (mid, low):
        own = level.select("key", "high", F.shiftright("high", 16).alias("up"), "n").select("key", "high", "up", before("key", "up").alias("own"))
        at = own.join(at, ["key", "up"]).select("key", F.col("high").alias("up"), (F.col("own") + F.col("b")).alias("b"), "total")
    return at.select("key", F.col("up").alias("high"), F.col("b").alias("before"), "total")


# ---- coordinates ----------------------------------------------------------------

def positions(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """``rows`` with ``at``: the place of each row in its group, from 0.  A group may span any number of tasks."""
    spark, names = rows.sparkSession, rows.columns

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, n = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            at = []
            for key in zip(*[column(batch, c).to_pylist() for c in group], strict=True):
                n = n + 1 if key == last else 0
                last = key
                at.append(n)
            yield pa.RecordBatch.from_arrays([*[column(batch, c) for c in names], pa.array([part] * len(at), pa.int32()), pa.array(at, pa.int64())], [*names, "part", "at"])

    dealt = rows.repartitionByRange(partitions(spark), *group, *order).sortWithinPartitions(*group, *order)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    placed = stored(dealt.mapInArrow(numbered, kinds + ", part int, at long"), "merkle-positions")
    sizes = placed.groupBy(*group, "part").agg(F.count(F.lit(1)).alias("n"))  # a row a group and task
    before = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*group, "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return placed.join(sizes, [*group, "part"]).select(*names, (F.col("before") + F.col("at")).alias("at"))


def coordinates(rows: DataFrame) -> DataFrame:
    """(key, n: leaves of the source, idx: place among them, id, leaf, other) of every stored leaf."""
    bitmaps = stored(containers(rows), "merkle-bitmaps")
    around = bitmaps.join(offsets(bitmaps), ["key", "high"])
    asks = rows.select("key", F.shiftright(F.coalesce("id", F.lit(LAST)), 16).alias("high"), "id", "row", "leaf", "other").withColumn("salt", F.lit(0))
    around = around.withColumn("salt", F.lit(0))
    hot = stored(bitmaps.where(F.col("n") > HOT).select("key", "high", F.ceil(F.col("n") / HOT).cast("int").alias("salts")), "merkle-hot")
    n_hot = hot.count()
    if n_hot:
        small = F.broadcast(hot) if n_hot <= 10_000 else hot
        asks = asks.join(small, ["key", "high"], "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("row"), "salts").cast("int"), F.lit(0))).drop("salts")
        around = around.join(small, ["key", "high"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            keys = list(zip(column(batch, "key").to_pylist(), column(batch, "high").to_pylist(), column(batch, "salt").to_pylist(), column(batch, "tag").to_pylist(), strict=True))
            cuts = [k for k in range(len(keys)) if k == 0 or keys[k] != keys[k - 1]] + [len(keys)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                part = batch.slice(a, b - a)
                if keys[a][3] == 0:
                    now, r = keys[a][:3], part.to_pylist()[0]
                    state = r["payload"], np.frombuffer(r["again"], "<u2"), np.frombuffer(r["more"], "<i8"), r["before"], r["total"]
                    continue
                if keys[a][:3] != now:
                    raise ValueError("a leaf without its bitmap")
                payload, again, more, before, total = state
                low = column(part, "id").fill_null(LAST).to_numpy() & 0xFFFF
                idx = before + ranks(payload, low)
                ties = np.ones(len(low), np.int64)
                if len(again):
                    sums, at = np.concatenate([[0], np.cumsum(more)]), np.searchsorted(again, low)
                    idx = idx + sums[at]
                    here = at < len(again)
                    here[here] = again[at[here]] == low[here]
                    ties[here] += more[at[here]]
                yield pa.RecordBatch.from_arrays([column(part, "key"), pa.array([total] * len(low), pa.int64()), pa.array(idx.astype(np.int64)), pa.array(ties), *[column(part, c) for c in ("id", "row", "leaf", "other")]],
                                                 ["key", "n", "idx", "ties", "id", "row", "leaf", "other"])

    both = around.withColumn("tag", F.lit(0)).unionByName(asks.withColumn("tag", F.lit(1)), allowMissingColumns=True)
    both = both.select("key", "high", "salt", "tag", "payload", "again", "more", "before", "total", "id", "row", "leaf", "other")
    placed = both.repartition("key", "high", "salt").sortWithinPartitions("key", "high", "salt", "tag").mapInArrow(found, "key string, n long, idx long, ties long, id long, row long, leaf string, other string")
    placed = stored(placed, "merkle-ranked")
    columns = ["key", "n", "idx", "id", "leaf", "other"]
    tied = placed.where("ties > 1")
    if tied.isEmpty():
        return placed.select(*columns)
    tied = positions(tied, ["key", "idx"], ["leaf", "row"]).withColumn("idx", F.col("idx") + F.col("at"))
    return stored(placed.where("ties = 1").select(*columns).union(tied.select(*columns)), "merkle-placed")


# ---- levels ---------------------------------------------------------------------

def ladder(n: int, nodes: list[str]) -> list[list[str]]:
    """The levels inside a block of a tree with n nodes at this height, from its nodes up."""
    out = [nodes]
    for _ in range(LEVELS):
        if n <= 1:
            break
        below = out[-1]
        out.append([sha("".join(below[k:k + FAN])) for k in range(0, len(below), FAN)])
        n = -(-n // FAN)
    return out


def after(n: int) -> int:
    for _ in range(LEVELS):
        n = -(-n // FAN)
    return n


def reduced(nodes: DataFrame) -> list[DataFrame]:
    """``nodes`` (key, n, idx, digest) and, pass by pass, the nodes ``LEVELS`` above; the last holds one node a key."""
    arrow = pa.schema([("key", pa.string()), ("n", pa.int64()), ("idx", pa.int64()), ("digest", pa.string())])

    def up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for (key, block), rows in runs(batches, ("key", "block")):
            own = list(rows)  # at most 4,096
            out.append({"key": key, "n": after(own[0]["n"]), "idx": block, "digest": ladder(own[0]["n"], [r["digest"] for r in own])[-1][0]})
            if len(out) == 4096:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    levels = [nodes]
    while True:
        blocks = levels[-1].select("key", F.shiftright("idx", BITS).alias("block"), "idx", "n", "digest")
        levels.append(stored(blocks.repartition("key", "block").sortWithinPartitions("key", "idx").mapInArrow(up, "key string, n long, idx long, digest string"), "merkle-nodes"))
        if (levels[-1].agg(F.max("n")).collect()[0][0] or 1) <= 1:
            return levels


#: A path from a node to its root: per level the siblings on its left, a comma, those on its right; a bar between levels.
def siblings(levels: list[list[str]], at: int) -> list[str]:
    out = []
    for level in levels[:-1]:
        first = at - at % FAN
        out.append("".join(level[first:at]) + "," + "".join(level[at + 1:first + FAN]))
        at //= FAN
    return out


def joined(path: list[str], above: str) -> str:
    """Every level of a path has its comma, so no path at all is the empty string."""
    return "|".join([*path, above] if above else path)


def fold(digest: str, path: str) -> str:
    for level in path.split("|") if path else ():
        left, right = level.split(",")
        digest = sha(left + digest + right)
    return digest


def proof(path: str) -> str:
    return sha(path.translate({44: None, 124: None}))


def descended(nodes: DataFrame, parents: DataFrame, carried: list[str], schema: str, arrow: pa.Schema, make: Callable[[dict, str, dict], dict]) -> DataFrame:
    """``make(node, path, block)`` of every node; ``parents``: (key, idx, path, ...) of the nodes ``LEVELS`` above.
    A block's row comes before its nodes, so its path is shuffled and held once."""
    extra = [c for c in parents.columns if c not in ("key", "idx", "path")]

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in runs(batches, ("key", "block")):
            block = next(rows)
            if block["tag"]:
                raise ValueError("nodes without their path")
            own = list(rows)  # at most 4,096
            if not own:
                continue
            levels = ladder(own[0]["n"], [r["digest"] for r in own])
            for lo in range(0, len(own), 512):
                yield pa.RecordBatch.from_pylist([make(r, joined(siblings(levels, k), block["path"]), block) for k, r in enumerate(own[lo:lo + 512], start=lo)], schema=arrow)

    above = parents.select("key", F.col("idx").alias("block"), F.lit(0).alias("tag"), "path", *extra)
    below = nodes.select("key", F.shiftright("idx", BITS).alias("block"), F.lit(1).alias("tag"), "idx", "n", "digest", *carried)
    both = above.unionByName(below, allowMissingColumns=True)
    return both.repartition("key", "block").sortWithinPartitions("key", "block", "tag", "idx").mapInArrow(down, schema)


def paths(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """(key, idx, path, subroot, root) of the nodes of ``levels[1]``; ``tops`` has them of the last level."""
    arrow = pa.schema([("key", pa.string()), ("idx", pa.int64()), ("path", pa.string()), ("subroot", pa.string()), ("root", pa.string())])
    for nodes in levels[-2:0:-1]:
        tops = stored(descended(nodes, tops, [], "key string, idx long, path string, subroot string, root string", arrow,
                                lambda r, path, block: {"key": r["key"], "idx": r["idx"], "path": path, "subroot": block["subroot"], "root": block["root"]}), "merkle-paths")
    return tops


@dataclass
class Manifest:
    """``leaves`` (key, n, idx, id, leaf, other), ``levels`` (nodes of the sources' trees, ``LEVELS`` apart, the
    last are the subroots), ``tops`` (key, idx, path, subroot, root: a row a source)."""

    leaves: DataFrame
    levels: list[DataFrame]
    tops: DataFrame


def build(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", fields: tuple[str, ...] = FIELDS) -> Manifest:
    rows = stored(leaves(docs, id_col, source_col, text_col, fields), "merkle-leaves")
    placed = coordinates(rows)
    levels = reduced(placed.select("key", "n", "idx", F.col("leaf").alias("digest"), "id", "other"))
    subroots = levels[-1].select("key", "digest")
    count = subroots.count()
    ordered = positions(subroots.withColumn("all", F.lit(0)), ["all"], ["key"])
    # The tree over the subroots has one key; the source is kept beside its place.
    ordered = stored(ordered.select(F.lit("").alias("key"), F.lit(count).cast("long").alias("n"), F.col("at").alias("idx"), "digest", F.col("key").alias("of")), "merkle-subroots")
    upper = reduced(ordered)
    top = upper[-1].select("key", "idx", F.lit("").alias("path"), F.lit("").alias("subroot"), F.col("digest").alias("root"))
    arrow = pa.schema([("key", pa.string()), ("idx", pa.int64()), ("path", pa.string()), ("subroot", pa.string()), ("root", pa.string())])
    tops = descended(ordered, paths(upper, top), ["of"], "key string, idx long, path string, subroot string, root string", arrow,
                     lambda r, path, block: {"key": r["of"], "idx": 0, "path": path, "subroot": r["digest"], "root": block["root"]})
    return Manifest(placed, levels, stored(tops, "merkle-tops"))


def proofs(manifest: Manifest) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row."""
    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    arrow = pa.schema([("doc_id", pa.int64()), *[(c, pa.string()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")], ("verified", pa.bool_())])

    def made(r: dict, path: str, block: dict) -> dict:
        folded = fold(r["other"] or r["digest"], path)
        return {"doc_id": r["id"], "leaf": r["digest"], "subroot": block["subroot"], "root": block["root"], "proof_sha256": proof(path), "folded_root": folded, "verified": folded == block["root"]}

    return descended(manifest.levels[0], paths(manifest.levels, manifest.tops), ["id", "other"], schema, arrow, made)


def digest(docs: DataFrame) -> DataFrame:
    return proofs(build(docs))


def _sql(levels: int = 8) -> str:
    """DuckDB SQL with one block of expressions a level: trees of up to 16**levels leaves."""
    f = ", ".join(f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')" for c in FIELDS)
    lower = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    g = f.replace("text", lower)
    sql = [f"""WITH crc AS (
  SELECT b, list_reduce(list_concat([b], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM (SELECT unnest(range(256)) AS b)),
tab AS (SELECT list(v ORDER BY b) AS t FROM crc),
d AS (
  SELECT *, row_number() OVER () AS row, sha256(concat({f})) AS leaf,
         CASE WHEN xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
                       lambda c, b: xor(c >> 8, t[1 + CAST(xor(c, b) & 255 AS BIGINT)])), 4294967295) % 5 = 0 THEN sha256(concat({g})) END AS other
  FROM documents, tab),
l0 AS (SELECT row, doc_id, source, leaf, other, leaf AS h, coalesce(other, leaf) AS x, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS LAST, leaf, row) - 1 AS i,
              count(*) OVER (PARTITION BY source) AS n, '' AS p FROM d)"""]

    def climb(name: str, below: str, by: str) -> None:
        # Each leaf carries its node (h), the tampered node (x) and the proof so far (p).
        sql.append(f"""n{name} AS (SELECT {by} AS k, i, any_value(h) AS h FROM {below} WHERE n > 1 GROUP BY ALL),
r{name} AS (SELECT k, i // 16 AS q, list(h ORDER BY i) AS hs FROM n{name} GROUP BY ALL),
{name} AS (
  SELECT b.* EXCLUDE (h, x, i, n, p), CASE WHEN n > 1 THEN sha256(array_to_string(hs, '')) ELSE h END AS h,
         CASE WHEN n > 1 THEN sha256(array_to_string(hs[:i % 16], '') || x || array_to_string(hs[i % 16 + 2:], '')) ELSE x END AS x,
         CASE WHEN n > 1 THEN i // 16 ELSE i END AS i, CASE WHEN n > 1 THEN (n + 15) // 16 ELSE n END AS n,
         CASE WHEN n > 1 THEN p || array_to_string(hs[:i % 16], '') || array_to_string(hs[i % 16 + 2:], '') ELSE p END AS p
  FROM {below} b LEFT JOIN r{name} r ON {by} IS NOT DISTINCT FROM r.k AND i // 16 = r.q)""")

    for k in range(levels):
        climb(f"l{k + 1}", f"l{k}", "source")
    sql.append(f"""s AS (SELECT source, any_value(h) AS h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM l{levels} GROUP BY source),
u0 AS (SELECT l.* EXCLUDE (i, n), l.h AS subroot, s.i, s.n FROM l{levels} l JOIN s ON l.source IS NOT DISTINCT FROM s.source)""")
    for k in range(levels):
        climb(f"u{k + 1}", f"u{k}", "0")
    sql.append(f"""done AS (SELECT doc_id, leaf, subroot, h AS root, sha256(p) AS proof_sha256, x AS folded_root, x = h AS verified FROM u{levels})""")
    return ",\n".join(sql) + "\nSELECT * FROM done"


SQL = _sql(4)
