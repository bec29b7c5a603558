"""Migration data checks: the reconciliation, integrity and conversion checks the
migration documents prescribe, as DataFrame operators over a source and a
target table.

Scale notes
- Counts and per-bucket checksums are hash aggregates with map-side partial
  aggregation; only (bucket, count, xor) rows cross the network.
- Row diff and orphan checks are key joins (sort-merge / shuffled hash chosen by
  Catalyst, skewed keys split by AQE); nothing is collected to the driver.
- The ordered-MD5 form of the checksum (one string over all keys) would put a
  whole table in one task; ``reconcile_checksum`` is order-insensitive by buckets, and
  ``ordered_checksum`` keeps the order by an associative hash over key ranges.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

c = F.col


# ----------------------------------------------------------------- V1
def reconcile_counts(pairs: list[tuple[str, DataFrame | None, DataFrame | None]]) -> DataFrame:
    """Row counts per table on both sides with PASS/FAIL.  A table missing on one
    side still appears (full outer join), with a NULL count and FAIL."""
    def counts(side: int, alias: str):
        parts = [df.agg(F.count(F.lit(1)).alias(alias)).select(F.lit(name).alias("table_name"), alias)
                 for name, *dfs in pairs for df in [dfs[side]] if df is not None]
        return reduce(DataFrame.unionByName, parts)
    j = counts(0, "source_rows").join(counts(1, "target_rows"), "table_name", "full")
    ok = c("source_rows").isNotNull() & c("target_rows").isNotNull() & (c("source_rows") == c("target_rows"))
    return j.select("table_name", c("source_rows").cast("long"), c("target_rows").cast("long"),
                    (F.coalesce(c("target_rows"), F.lit(0)) - F.coalesce(c("source_rows"), F.lit(0)))
                    .cast("long").alias("difference"),
                    F.when(ok, "PASS").otherwise("FAIL").alias("status"))


# ----------------------------------------------------------------- V2
def canonical_text(df: DataFrame, cols: list[str]) -> Column:
    """Engine-independent text of a row, every field as ``length:text;`` (so no value can
    look like two) and NULL as ``N;``.  Fractional numbers are written as whole part
    and 2**-53rds, timestamps to the microsecond."""
    parts = []
    types = dict(df.dtypes)
    for col in cols:
        t = types[col]
        if t in ("double", "float"):
            x = c(col).cast("double")
            whole = F.floor(x)
            e = F.concat(whole.cast("string"), F.lit("+"), F.floor((x - whole.cast("double")) * F.lit(2.0 ** 53)).cast("string"))
            e = F.when(F.isnan(x) | (F.abs(x) >= 2.0 ** 62), x.cast("string")).otherwise(e)
        elif t.startswith("timestamp"):
            e = F.date_format(c(col), "yyyy-MM-dd HH:mm:ss.SSSSSS")
        else:
            e = c(col).cast("string")
        parts.append(F.when(c(col).isNull(), "N;").otherwise(F.concat(F.length(e).cast("string"), F.lit(":"), e, F.lit(";"))))
    return F.concat(*parts)


def row_digest(df: DataFrame, cols: list[str], method: str = "xxhash64") -> Column:
    """64-bit row digest; ``xxhash64`` (fast, Spark native; it skips NULLs, so each column
    is preceded by its NULL flag) or ``md5`` (portable: first 15 hex digits of md5 of the
    canonical text)."""
    if method == "md5":
        return F.conv(F.substring(F.md5(canonical_text(df, cols)), 1, 15), 16, 10).cast("long")
    return F.xxhash64(*[e for x in cols for e in (c(x).isNull(), c(x))])


def bucket_of(keys: list[str], buckets: int, method: str = "hash") -> Column:
    if method == "key":     # integer single key: pmod(key, n)
        return F.pmod(c(keys[0]), F.lit(buckets)).cast("long")
    return F.pmod(F.xxhash64(*[c(k) for k in keys]), F.lit(buckets)).cast("long")


def reconcile_checksum(src: DataFrame, tgt: DataFrame, keys: list[str], cols: list[str] | None = None,
                       buckets: int = 1024, digest: str = "xxhash64", bucket_by: str = "hash") -> DataFrame:
    """Order-insensitive checksum per key bucket: count, bit_xor and sum of the row digests
    on each side (equal pairs of rows cancel in the xor, not in the sum); mismatching
    buckets localise the differences."""
    cols = cols or src.columns

    def side(df, p):
        return df.select(bucket_of(keys, buckets, bucket_by).alias("bucket"), row_digest(df, cols, digest).alias("d")) \
            .groupBy("bucket").agg(F.count(F.lit(1)).alias(f"{p}_rows"), F.bit_xor("d").alias(f"{p}_checksum"),
                                   F.sum(c("d").cast("decimal(38,0)")).cast("string").alias(f"{p}_sum"))
    j = side(src, "source").join(side(tgt, "target"), "bucket", "full")
    same = (F.coalesce(c("source_rows"), F.lit(0)) == F.coalesce(c("target_rows"), F.lit(0))) & \
        c("source_checksum").eqNullSafe(c("target_checksum")) & c("source_sum").eqNullSafe(c("target_sum"))
    return j.select("bucket", F.coalesce(c("source_rows"), F.lit(0)).cast("long").alias("source_rows"),
                    F.coalesce(c("target_rows"), F.lit(0)).cast("long").alias("target_rows"),
                    "source_checksum", "target_checksum", "source_sum", "target_sum",
                    F.when(same, "MATCH").otherwise("MISMATCH").alias("status"))


#: Two primes and bases of the ordered checksum (a prime less than 2**31: products stay inside 64 bits).
ORDERED = ((2147483647, 1000003), (2147483629, 998244353))


def _combined(nodes: Column) -> list[Column]:
    """An array of structs (.., h0, s0, h1, s1) combined in order: h(xy) = h(x) * s(y) + h(y), s(xy) = s(x) * s(y),
    modulo each prime.  That is associative, so any grouping of neighbours gives the same."""
    def folded(k: int, prime: int) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("h"), F.lit(1).cast("long").alias("s"))

        def step(state: Column, x: Column) -> Column:
            return F.struct(((state["h"] * x[f"s{k}"] + x[f"h{k}"]) % prime).alias("h"), ((state["s"] * x[f"s{k}"]) % prime).alias("s"))
        return F.aggregate(nodes, start, step)
    return [e.alias(f"{n}{k}") for k, (prime, _) in enumerate(ORDERED) for f in [folded(k, prime)] for n, e in (("h", f["h"]), ("s", f["s"]))]


_STATE = [f"{n}{k}" for k in range(len(ORDERED)) for n in ("h", "s")]


def _range(key: str, width_bits: int) -> Column:
    """The number of a key's range; a NULL key is in the first of all."""
    return F.shiftright(F.coalesce(c(key).cast("long"), F.lit(-(1 << 63))), width_bits)


def ordered_checksum(df: DataFrame, key: str, cols: list[str] | None = None, width_bits: int = 10, fan_bits: int = 4) -> DataFrame:
    """V2, ordered: a hash tree over ranges of an integer key.  Leaf ``node`` covers 2**``width_bits`` keys, a
    node above it 2**``fan_bits`` nodes; one node is left at the top.  (level, node, rows, h0, s0, h1, s1): the
    rows of a range combined in key order (NULL keys first, equal keys by digest), so the top is the
    fold over the whole table in key order, whatever its partitions.  A leaf's group holds
    2**``width_bits`` rows of a unique key.  One shuffle of digests; every level above is smaller by 2**``fan_bits``."""
    from migscope.session import materialize
    digest = row_digest(df, cols or df.columns, "md5")
    rows = df.select(_range(key, width_bits).alias("node"), c(key).alias("k"), digest.alias("d"))
    each = [e for i, (prime, base) in enumerate(ORDERED) for e in ((F.pmod(c("d"), F.lit(prime)) + 1).alias(f"h{i}"), F.lit(base).cast("long").alias(f"s{i}"))]
    rows = rows.select("node", F.struct("k", "d", *each).alias("x"))
    level = rows.groupBy("node").agg(F.count(F.lit(1)).alias("rows"), F.array_sort(F.collect_list("x")).alias("xs")).select("node", "rows", *_combined(c("xs")))
    out = [materialize(level.withColumn("level", F.lit(0)))]
    while True:
        n, low, high = out[-1].agg(F.count(F.lit(1)), F.min("node"), F.max("node")).collect()[0]
        if n <= 1:
            return reduce(DataFrame.unionByName, out)
        # Keys below and from zero meet at the top.
        above = F.lit(0).cast("long") if low >= -1 and high <= 0 else F.shiftright("node", fan_bits)
        up = out[-1].select(above.alias("up"), F.struct("node", *_STATE).alias("x"), "rows")
        level = up.groupBy("up").agg(F.sum("rows").alias("rows"), F.array_sort(F.collect_list("x")).alias("xs")).select(c("up").alias("node"), "rows", *_combined(c("xs")))
        out.append(materialize(level.withColumn("level", F.lit(len(out)))))


def ordered_diff(source: DataFrame, target: DataFrame, fan_bits: int = 4) -> DataFrame:
    """The nodes in which two trees of ``ordered_checksum`` (same widths) differ, from the top down: (level, node,
    source_rows, target_rows, source_hash, target_hash).  Equal nodes are not followed, so below the top
    only what lies under differing nodes is compared; level 0 names the key ranges to read.
    The trees may differ in height: what one of them lacks counts as different."""
    from migscope.session import materialize
    name = lambda side: F.concat_ws(":", *[c(f"{side}.{x}") for x in ("h0", "h1")])
    top = max(t.agg(F.max("level")).collect()[0][0] or 0 for t in (source, target))
    found: list[DataFrame] = []
    for level in range(top, -1, -1):
        s, t = (side.where(c("level") == level) for side in (source, target))
        if found and found[-1].isEmpty():
            break
        if len(found) > 1:  # all nodes of the second level are under the top one
            under = found[-1].select(c("node").alias("up"))
            s, t = (side.join(under, F.shiftright(side["node"], fan_bits) == under["up"], "left_semi") for side in (s, t))
        j = s.alias("s").join(t.alias("t"), c("s.node") == c("t.node"), "full")
        same = (c("s.rows") == c("t.rows")) & (c("s.h0") == c("t.h0")) & (c("s.h1") == c("t.h1"))
        found.append(materialize(j.where(~F.coalesce(same, F.lit(False))).select(
            F.lit(level).alias("level"), F.coalesce("s.node", "t.node").alias("node"), F.coalesce("s.rows", F.lit(0)).cast("long").alias("source_rows"),
            F.coalesce("t.rows", F.lit(0)).cast("long").alias("target_rows"), F.nullif(name("s"), F.lit("")).alias("source_hash"), F.nullif(name("t"), F.lit("")).alias("target_hash"))))
    return reduce(DataFrame.unionByName, found)


def differing_rows(df: DataFrame, diff: DataFrame, key: str, width_bits: int = 10) -> DataFrame:
    """The rows of ``df`` in the ranges that ``ordered_diff`` named: a semi join on the range number.  The least and
    greatest of them go to the scan as a filter, which skips files and row groups."""
    ranges = diff.where("level = 0").select(c("node").alias("_range"))
    low, high = ranges.agg(F.min("_range"), F.max("_range")).collect()[0]
    if low is None:
        return df.limit(0)
    inside = (c(key) >= low << width_bits) & (c(key) <= ((high + 1) << width_bits) - 1)
    near = df.where(inside | c(key).isNull() if low == -(1 << 63) >> width_bits else inside)
    return near.join(ranges, _range(key, width_bits) == c("_range"), "left_semi")


# ----------------------------------------------------------------- V3
def orphans(child: DataFrame, parent: DataFrame, fk: list[str], pk: list[str]) -> DataFrame:
    """Child rows whose foreign key has no parent (NOT EXISTS as a left anti join).
    Rows with a NULL foreign key are not orphans.  The key columns are renamed, so a
    table may reference itself."""
    p = parent.select(*[c(b).alias(f"_pk{i}") for i, b in enumerate(pk)])
    cond = [child[a] == p[f"_pk{i}"] for i, a in enumerate(fk)]
    notnull = reduce(lambda x, y: x & y, [c(a).isNotNull() for a in fk])
    return child.where(notnull).join(p, cond, "left_anti")


# ----------------------------------------------------------------- V4
def diff_rows(src: DataFrame, tgt: DataFrame, keys: list[str], cols: list[str] | None = None,
              keep_same: bool = False) -> DataFrame:
    """Keyed row diff of two tables as multisets; NULL keys and repeated keys are keys like
    others.  status = missing (only source), extra (only target), changed.

    Equal rows cancel in one aggregate over both sides (NULL-safe, partially aggregated);
    only what is left is numbered within its key and paired."""
    cols = cols or [x for x in src.columns if x not in keys]
    side = lambda df, s, t: df.select(*keys, *cols, F.lit(s).alias("_s"), F.lit(t).alias("_t"))
    g = side(src, 1, 0).union(side(tgt, 0, 1)).groupBy(*keys, *cols).agg(F.sum("_s").alias("_s"), F.sum("_t").alias("_t"))
    n = Window.partitionBy(*keys).orderBy(*cols, "_copy")

    def left(p: str, more: str, fewer: str) -> DataFrame:
        rows = g.where(c(more) > c(fewer)).withColumn("_copy", F.explode(F.sequence(F.lit(1), (c(more) - c(fewer)).cast("int"))))
        return rows.select(*[c(k).alias(f"{p}k_{k}") for k in keys], *[c(x).alias(f"{p}_{x}") for x in cols],
                           F.row_number().over(n).alias(f"{p}_no"), F.lit(True).alias(f"_{p}"))

    s, t = left("s", "_s", "_t"), left("t", "_t", "_s")
    on = reduce(lambda x, y: x & y, [c(f"sk_{k}").eqNullSafe(c(f"tk_{k}")) for k in keys]) & (c("s_no") == c("t_no"))
    changed = F.filter(F.array(*[F.when(~c(f"s_{x}").eqNullSafe(c(f"t_{x}")), F.lit(x)) for x in cols]), lambda v: v.isNotNull())
    st = F.when(c("_t").isNull(), "missing").when(c("_s").isNull(), "extra").otherwise("changed")
    out = s.join(t, on, "full").select(
        *[F.when(c("_s"), c(f"sk_{k}")).otherwise(c(f"tk_{k}")).alias(k) for k in keys], st.alias("status"),
        F.when(c("_s") & c("_t"), F.array_join(changed, ",")).otherwise(F.lit("")).alias("changed_columns"))
    if not keep_same:
        return out
    same = g.where((c("_s") > 0) & (c("_t") > 0)).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.least("_s", "_t").cast("int"))))
    return out.unionByName(same.select(*keys, F.lit("same").alias("status"), F.lit("").alias("changed_columns")))


def diff_rows_set(src: DataFrame, tgt: DataFrame) -> DataFrame:
    """Unkeyed form: rows only in source / only in target as multisets."""
    return src.exceptAll(tgt).withColumn("side", F.lit("source_only")).unionByName(
        tgt.exceptAll(src).withColumn("side", F.lit("target_only")))


# ----------------------------------------------------------------- V5
def null_profile(df: DataFrame, name: str) -> DataFrame:
    """NULL count of every column in one pass, unpivoted to (table, column, nulls)."""
    agg = df.agg(*[F.count_if(c(x).isNull()).alias(x) for x in df.columns])
    return agg.select(F.lit(name).alias("table_name"), F.explode(F.array(*[
        F.struct(F.lit(x).alias("column_name"), c(x).cast("long").alias("nulls")) for x in df.columns])).alias("p")) \
        .select("table_name", "p.*")


def compare_nulls(src: DataFrame, tgt: DataFrame, name: str) -> DataFrame:
    s = null_profile(src, name).withColumnRenamed("nulls", "source_nulls")
    t = null_profile(tgt, name).withColumnRenamed("nulls", "target_nulls")
    j = s.join(t, ["table_name", "column_name"], "full")
    return j.withColumn("status", F.when(c("source_nulls").eqNullSafe(c("target_nulls")), "PASS").otherwise("FAIL"))


# ----------------------------------------------------------------- V6
def conversion_loss(df: DataFrame, rules: list[tuple[str, str]], name: str = "") -> DataFrame:
    """Values that do not survive source -> target type -> source type.  One pass:
    one ``count_if`` per rule, unpivoted."""
    types = dict(df.dtypes)
    aggs = []
    import re
    for i, (col, target) in enumerate(rules):
        m = re.fullmatch(r"(?i)(var)?char\((\d+)\)", target.strip())
        if m:   # a length-limited string target keeps values up to n characters
            lost = c(col).isNotNull() & (F.length(c(col).cast("string")) > int(m.group(2)))
        else:
            there = c(col).try_cast(target)
            back = there.try_cast(types[col])
            lost = c(col).isNotNull() & (there.isNull() | ~back.eqNullSafe(c(col)))
        aggs.append(F.count_if(lost).alias(f"r{i}"))
    a = df.agg(F.count(F.lit(1)).alias("rows"), *aggs)
    return a.select(F.lit(name).alias("table_name"), F.explode(F.array(*[
        F.struct(F.lit(col).alias("column_name"), F.lit(t).alias("target_type"), c("rows").alias("rows"),
                 c(f"r{i}").cast("long").alias("lost")) for i, (col, t) in enumerate(rules)])).alias("p")) \
        .select("table_name", "p.*")


# ----------------------------------------------------------------- V7
def charset_check(src: DataFrame, tgt: DataFrame, key: str, col: str) -> DataFrame:
    """Special characters preserved: per keyed row pair, character and byte
    lengths, non-ASCII presence and equality, and the rows that one side lacks;
    summarised in one aggregate."""
    s = src.select(c(key).alias("sk"), c(col).alias("s"), F.lit(1).alias("ins"))
    t = tgt.select(c(key).alias("tk"), c(col).alias("t"), F.lit(1).alias("int"))
    j = s.join(t, c("sk").eqNullSafe(c("tk")), "full")
    both = c("ins").isNotNull() & c("int").isNotNull()
    non_ascii = r"[^\x00-\x7F]"
    return j.agg(
        F.count_if(both).alias("rows"),
        F.count_if(c("int").isNull()).alias("missing_rows"),
        F.count_if(c("ins").isNull()).alias("extra_rows"),
        F.count_if(c("s").rlike(non_ascii)).alias("non_ascii_rows"),
        F.count_if(~F.is_valid_utf8("t")).alias("invalid_utf8_rows"),
        F.count_if(F.length("s") != F.length("t")).alias("char_length_mismatches"),
        F.count_if(F.octet_length("s") != F.octet_length("t")).alias("byte_length_mismatches"),
        F.count_if(both & ~c("s").eqNullSafe(c("t"))).alias("value_mismatches"),
        F.sum(F.octet_length("s") - F.length("s")).alias("multibyte_extra_bytes"))


# ----------------------------------------------------------------- V8
def json_check(df: DataFrame, key: str, col: str, field: str = "$.k") -> DataFrame:
    """JSON intact: parses, canonical (minified) text, and a field read."""
    v = F.try_parse_json(c(col))
    return df.select(key, v.isNotNull().alias("valid"), F.to_json(v).alias("canonical"),
                     F.get_json_object(c(col), field).alias("k"))


def json_compare(src: DataFrame, tgt: DataFrame, key: str, col: str) -> DataFrame:
    """Per key the JSON of both sides: ``same`` if the canonical texts agree (white space does
    not matter), ``changed``, ``invalid`` (the target does not parse), ``missing``, ``extra``."""
    canon = lambda: F.to_json(F.try_parse_json(c(col)))
    s = src.select(c(key).alias("sk"), canon().alias("s"), F.lit(1).alias("ins"))
    t = tgt.select(c(key).alias("tk"), canon().alias("t"), c(col).isNull().alias("none"), F.lit(1).alias("int"))
    st = (F.when(c("int").isNull(), "missing").when(c("ins").isNull(), "extra")
          .when(c("t").isNull() & ~c("none"), "invalid").when(c("s").eqNullSafe(c("t")), "same").otherwise("changed"))
    return s.join(t, c("sk").eqNullSafe(c("tk")), "full").select(F.coalesce("sk", "tk").alias(key), st.alias("status"))


# ----------------------------------------------------------------- V9 / V10
def array_to_csv(df: DataFrame, col: str, sep: str = ",") -> DataFrame:
    return df.withColumn(col, F.array_join(F.transform(col, lambda x: x.cast("string")), sep))


def array_to_child(df: DataFrame, key: str, col: str) -> DataFrame:
    """Array column -> child table (key, pos, value); order kept in ``pos``."""
    return df.select(key, F.posexplode(col).alias("pos", "value")).select(
        key, c("pos").cast("long").alias("pos"), "value")


def bool_to_number(col: Column, keep_null: bool = False) -> Column:
    """Boolean -> 1/0.  As written in the design, NULL becomes 0; ``keep_null``
    keeps NULL so that the NULL-preservation check passes."""
    e = F.when(col, F.lit(1)).when(~col, F.lit(0))
    return (e if keep_null else e.otherwise(F.lit(0))).cast("int")


# ----------------------------------------------------------------- V11
def sample_rows(df: DataFrame, key: str, fraction: float, seed: int = 42, method: str = "hash") -> DataFrame:
    """Deterministic key-hash sample (same rows on every run and on both sides of a
    migration).  ``md5`` is the engine-portable variant."""
    per10k = int(round(fraction * 10000))
    if method == "md5":
        h = F.conv(F.substring(F.md5(F.concat(c(key).cast("string"), F.lit(f"#{seed}"))), 1, 8), 16, 10).cast("long")
    else:
        h = F.xxhash64(c(key), F.lit(seed))
    return df.where(F.pmod(h, F.lit(10000)) < per10k)


def sample_n(df: DataFrame, key: str, n: int, seed: int = 42, method: str = "xxhash64") -> DataFrame:
    """n rows with the smallest key hash (a top-k: each task keeps n before the merge); ``md5`` is the
    portable hash."""
    h = F.md5(F.concat(c(key).cast("string"), F.lit(f"#{seed}"))) if method == "md5" else F.xxhash64(c(key), F.lit(seed))
    return df.orderBy(h, c(key)).limit(n)


# ----------------------------------------------------------------- V12
def check_rules(df: DataFrame, rules: list[tuple[str, str]], name: str = "") -> DataFrame:
    """Business rules as SQL predicates, all evaluated in one pass; a row violates
    a rule when the predicate is not TRUE."""
    a = df.agg(F.count(F.lit(1)).alias("rows"),
               *[F.count_if(~F.coalesce(F.expr(e), F.lit(False))).alias(f"r{i}") for i, (_, e) in enumerate(rules)])
    return a.select(F.explode(F.array(*[
        F.struct(F.lit(name).alias("table_name"), F.lit(r).alias("rule"), c("rows").alias("rows"),
                 c(f"r{i}").cast("long").alias("violations")) for i, (r, _) in enumerate(rules)])).alias("p")) \
        .select("p.*").withColumn("status", F.when(c("violations") == 0, "PASS").otherwise("FAIL"))


# ----------------------------------------------------------------- V13 / V14
def schema_diff(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Two catalogues (table, column, data_type, nullable, default_value) compared by
    a full outer join on the key columns.  For a migrated schema ``a`` is the expected
    catalogue: the source's after ``map_types``."""
    attrs = ["data_type", "nullable", "default_value"]
    s = a.select(*keys, *[c(x).alias(f"a_{x}") for x in attrs], F.lit(True).alias("_a"))
    t = b.select(*keys, *[c(x).alias(f"b_{x}") for x in attrs], F.lit(True).alias("_b"))
    j = s.join(t, keys, "full")
    diffs = F.filter(F.array(*[F.when(~c(f"a_{x}").eqNullSafe(c(f"b_{x}")), F.lit(x)) for x in attrs]),
                     lambda v: v.isNotNull())
    st = (F.when(c("_b").isNull(), "missing_in_target").when(c("_a").isNull(), "extra_in_target")
          .when(F.size(diffs) > 0, "different").otherwise("same"))
    return j.select(*keys, st.alias("status"),
                    F.when(c("_a") & c("_b"), F.array_join(diffs, ",")).otherwise("").alias("differences"),
                    "a_data_type", "b_data_type").where(c("status") != "same")


def object_diff(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Catalogue objects (keys, kind, name, definition) of any kind (table, primary key, foreign
    key, unique, check, index, sequence, view) compared: per object missing, extra or
    different.  The same object listed twice counts once."""
    k = [*keys, "kind", "name"]
    side = lambda df, p: df.groupBy(*k).agg(F.min("definition").alias(f"{p}_definition"), F.lit(True).alias(f"_{p}"))
    j = side(a, "a").join(side(b, "b"), k, "full")
    st = (F.when(c("_b").isNull(), "missing_in_target").when(c("_a").isNull(), "extra_in_target")
          .when(~c("a_definition").eqNullSafe(c("b_definition")), "different").otherwise("same"))
    return j.select(*k, st.alias("status"), "a_definition", "b_definition").where(c("status") != "same")


def map_types(columns: DataFrame, type_map: DataFrame, src_col: str = "data_type") -> DataFrame:
    """Type map applied by a broadcast left join (the map has a fixed size);
    unmapped types are flagged and keep their name."""
    m = F.broadcast(type_map.select(c("type").alias(src_col), c("target_type")))
    return columns.join(m, src_col, "left").withColumn("mapped", c("target_type").isNotNull()) \
        .withColumn("target_type", F.coalesce(c("target_type"), c(src_col)))


# Oracle to PostgreSQL types of the design document (pattern, target, risk); $1 are the arguments.
ORACLE_TO_PG = [
    (r"^NUMBER\(10,0\)$", "INTEGER", "Low"),
    (r"^NUMBER(\([0-9, ]+\))?$", "NUMERIC$1", "Low"),
    (r"^VARCHAR2(\([0-9]+\))$", "VARCHAR$1", "Low"),
    (r"^DATE$", "TIMESTAMP", "Medium"),
    (r"^CLOB$", "TEXT", "Low"),
    (r"^BLOB$", "BYTEA", "Low"),
    (r"^RAW\([0-9]+\)$", "BYTEA", "Low"),
]


def oracle_to_postgres(columns: DataFrame, type_col: str = "data_type") -> DataFrame:
    """V14, the other way: target type and risk of every Oracle column type; a type without a
    rule keeps its name and is flagged."""
    t = F.upper(F.trim(c(type_col)))
    target, risk = F.lit(None).cast("string"), F.lit(None).cast("string")
    for pattern, to, level in reversed(ORACLE_TO_PG):
        hit = t.rlike(pattern)
        target = F.when(hit, F.regexp_replace(t, pattern, to)).otherwise(target)
        risk = F.when(hit, F.lit(level)).otherwise(risk)
    return columns.withColumn("mapped", target.isNotNull()).withColumn("risk", risk) \
        .withColumn("target_type", F.coalesce(target, c(type_col)))


# ----------------------------------------------------------------- V15
def load_order(nodes: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """Level of every table in foreign-key order (parents first): level 0 has no
    parent among the known tables; level n = 1 + max(parent levels), by ``graph.levels``.
    Tables in a cycle, or below one, have no order: status ``cycle``, level NULL
    (``graph.load_units`` orders these too).

    nodes: keys + table;  edges: keys + table (child) + parent."""
    from migscope.operators.graph import levels
    from migscope.session import materialize
    known = materialize(nodes.select(*keys, c("table").alias("node")).distinct())
    e = edges.where(c("table") != c("parent")).select(*keys, c("table").alias("a"), c("parent").alias("b")).distinct()
    e = e.join(known.withColumnRenamed("node", "b"), [*keys, "b"], "left_semi").join(known.withColumnRenamed("node", "a"), [*keys, "a"], "left_semi").select(*keys, "a", "b")
    got = levels(known, e, keys, cycles=True)
    return known.join(got, [*keys, "node"], "left").select(
        *keys, c("node").alias("table"), "level", F.when(c("level").isNull(), "cycle").otherwise("ordered").alias("status"))


# ----------------------------------------------------------------- V16
def migrate_table(src: DataFrame, conversions: dict[str, Column], keys: list[str], sink: str | None = None,
                  mode: str = "overwrite") -> tuple[DataFrame, DataFrame]:
    """Initial load: convert, write (parquet, if ``sink`` is given), and reconcile the table as
    it is read back with the converted source: row counts and the keyed diff of all
    columns, the converted ones included.  Returns (loaded table, differing rows)."""
    out = src.select(*[conversions.get(x, c(x)).alias(x) for x in src.columns])
    loaded = out
    if sink:
        out.write.mode(mode).parquet(sink)
        loaded = src.sparkSession.read.parquet(sink)
    return loaded, diff_rows(out, loaded, keys)


# ----------------------------------------------------------------- V17
def apply_delta(base: DataFrame, changes: DataFrame, keys: list[str], op_col: str = "op",
                seq_col: str = "seq") -> DataFrame:
    """Delta sync: the latest change per key (greatest sequence, ties by operation and
    values) is applied to the base: I/U upsert the row, D deletes it; a change with any other
    operation, or none, is no change.  Latest-per-key is a partial aggregate, the merge a
    full outer join on the keys."""
    cols = [x for x in base.columns if x not in keys]
    latest = latest_changes(changes, keys, cols, op_col, seq_col)
    j = base.join(latest, keys, "full")
    kept = j.where(c("_c").isNull() | (c("_c._op") != "D"))
    return kept.select(*keys, *[F.when(c("_c").isNotNull(), c(f"_c.{x}")).otherwise(c(x)).alias(x) for x in cols])


def latest_changes(changes: DataFrame, keys: list[str], cols: list[str], op_col: str, seq_col: str) -> DataFrame:
    """keys + _c: the last valid change of each key, as struct (_seq, _op, cols)."""
    return changes.where(c(op_col).isin("I", "U", "D")).groupBy(*keys).agg(
        F.max(F.struct(c(seq_col).cast("long").alias("_seq"), c(op_col).alias("_op"), *[c(x) for x in cols])).alias("_c"))


def apply_delta_state(state: DataFrame, changes: DataFrame, keys: list[str], op_col: str = "op",
                      seq_col: str = "seq") -> DataFrame:
    """``apply_delta`` on a table that keeps, per key, the last applied sequence (``_seq``) and a
    mark of deletion (``_deleted``): an older change that comes late changes nothing, and neither
    does the same change a second time."""
    cols = [x for x in state.columns if x not in [*keys, "_seq", "_deleted"]]
    j = state.withColumn("_old", F.lit(True)).join(latest_changes(changes, keys, cols, op_col, seq_col), keys, "full")
    newer = c("_c").isNotNull() & (c("_old").isNull() | c("_seq").isNull() | (c("_c._seq") > c("_seq")))
    return j.select(*keys, *[F.when(newer & (c("_c._op") != "D"), c(f"_c.{x}")).otherwise(c(x)).alias(x) for x in cols],
                    F.when(newer, c("_c._seq")).otherwise(c("_seq")).alias("_seq"),
                    F.when(newer, c("_c._op") == "D").otherwise(F.coalesce("_deleted", F.lit(False))).alias("_deleted"))


# ----------------------------------------------------------------- V18 / V19
def compare_baseline(actual: DataFrame, baseline: DataFrame) -> DataFrame:
    """Join measured metrics to the baseline/target table; PASS when the actual
    value is within the target."""
    j = baseline.join(actual, "metric", "left")
    return j.withColumn("status", F.when(c("actual").isNull(), "NO DATA")
                        .when(c("actual") <= c("target"), "PASS").otherwise("FAIL"))


#: Bins between a group's least and greatest value that ``exact_percentile`` counts.
PERCENTILE_BINS = 4096


def exact_percentile(df: DataFrame, group: list[str], value: str, q: float, out: str) -> DataFrame:
    """The exact (interpolated) q-quantile of ``value`` per group, in bounded state: values are counted in
    equal bins between the group's extremes, and only the bins that hold the two wanted ranks
    are ranked row by row.  NULL values do not count; a group without values has NULL."""
    g = [f"g{i}" for i in range(len(group))]
    named = lambda p: [c(x).alias(f"{p}{i}") for i, x in enumerate(group)]
    on = lambda a, b: reduce(lambda x, y: x & y, [c(f"{a}{i}").eqNullSafe(c(f"{b}{i}")) for i in range(len(group))], F.lit(True))
    values = df.where(c(value).isNotNull())
    ends = values.groupBy(*named("e")).agg(F.count(F.lit(1)).alias("n"), F.min(c(value).cast("double")).alias("lo"), F.max(c(value).cast("double")).alias("hi"))
    ends = ends.withColumn("pos", (c("n") - 1) * F.lit(q)).withColumn("first", F.floor("pos")).withColumn("last", F.ceil("pos"))
    ends = F.broadcast(ends) if ends.limit(100_001).count() <= 100_000 else ends
    width = (c("hi") - c("lo")) / PERCENTILE_BINS
    bin_ = F.when(width > 0, F.least(F.floor((c("v") - c("lo")) / width), F.lit(PERCENTILE_BINS - 1))).otherwise(0).cast("int")
    binned = values.select(*named("g"), c(value).cast("double").alias("v")).join(ends, on("g", "e")).select(*g, "v", bin_.alias("bin"), "pos", "first", "last")
    counts = binned.groupBy(*[c(x).alias(f"w{i}") for i, x in enumerate(g)], c("bin").alias("b"), c("first").alias("wf"), c("last").alias("wl")).agg(F.count(F.lit(1)).alias("m"))
    by_group = Window.partitionBy(*[f"w{i}" for i in range(len(group))]) if group else Window.partitionBy(F.lit(1))
    before = F.coalesce(F.sum("m").over(by_group.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    want = counts.withColumn("before", before).where((c("before") <= c("wl")) & (c("before") + c("m") > c("wf"))).drop("wf", "wl", "m")
    rank = c("before") + F.row_number().over(Window.partitionBy(*g, "bin").orderBy("v")) - 1
    ranked = binned.join(want, on("g", "w") & (c("bin") == c("b"))).withColumn("rank", rank)
    hit = ranked.groupBy(*[c(x).alias(f"h{i}") for i, x in enumerate(g)], "pos").agg(
        F.max(F.when(c("rank") == c("first"), c("v"))).alias("x"), F.max(F.when(c("rank") == c("last"), c("v"))).alias("y"))
    part = c("pos") - F.floor("pos")
    found = hit.select(*[f"h{i}" for i in range(len(group))], ((1 - part) * c("x") + part * c("y")).alias(out))
    groups = df.select(*named("d")).distinct()
    return groups.join(found, on("d", "h"), "left").select(*[c(f"d{i}").alias(x) for i, x in enumerate(group)], out)


def latency_slo(df: DataFrame, group: list[Column], latency: str, is_error: Column,
                mean_limit: float, p95_limit: float) -> DataFrame:
    """Mean and exact 95th percentile of latency and error count per group;
    PASS when mean < limit, p95 < limit and there are no errors."""
    rows = df.select(*group, c(latency).alias("_latency"), is_error.alias("_error"))
    names = rows.columns[:len(group)]
    g = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("requests"), F.avg("_latency").alias("mean_latency"), F.count_if("_error").alias("errors"))
    p = exact_percentile(rows, names, "_latency", 0.95, "p95_latency").select(*[c(x).alias(f"_p{i}") for i, x in enumerate(names)], "p95_latency")
    on = reduce(lambda x, y: x & y, [c(x).eqNullSafe(c(f"_p{i}")) for i, x in enumerate(names)])
    g = g.join(p, on).select(*names, "requests", "mean_latency", "p95_latency", "errors")
    ok = (c("mean_latency") < mean_limit) & (c("p95_latency") < p95_limit) & (c("errors") == 0)
    return g.withColumn("status", F.when(ok, "PASS").otherwise("FAIL"))


#: Size of a latency sketch: the rank error is about 1.3 % at 200 and falls as 1 / k.
SKETCH_K = 2048


def latency_sketches(df: DataFrame, group: list[Column], latency: str, k: int = SKETCH_K) -> DataFrame:
    """V19 as stored state: per group a mergeable quantile sketch of the latencies with their number, sum and
    errors left out of it.  A group's state is a few KB whatever its rows; partial sketches are merged
    before the shuffle."""
    rows = df.select(*group, c(latency).cast("double").alias("_v")).where(c("_v").isNotNull())
    return rows.groupBy(*rows.columns[:len(group)]).agg(F.count(F.lit(1)).alias("n"), F.sum("_v").alias("total"), F.kll_sketch_agg_double("_v", F.lit(k)).alias("sketch"))


def merged_latency(sketches: DataFrame, group: list[Column], quantiles: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Count, mean and quantiles of coarser groups from stored sketches alone; the events are not read."""
    rows = sketches.select(*group, "n", "total", "sketch")
    names = rows.columns[:len(group)]
    g = rows.groupBy(*names).agg(F.sum("n").cast("long").alias("n"), F.sum("total").alias("total"), F.kll_merge_agg_double("sketch").alias("sketch"))
    at = [F.kll_sketch_get_quantile_double("sketch", F.lit(q)).alias(f"p{round(100 * q)}") for q in quantiles]
    return g.select(*names, "n", (c("total") / c("n")).alias("mean_latency"), *at)


# ----------------------------------------------------------------- V20
# Alert thresholds of the monitoring design.
ERROR_RATE_WARNING = 0.001
ERROR_RATE_CRITICAL = 0.01
RESPONSE_WARNING_MS = 500.0
RESPONSE_CRITICAL_MS = 2000.0


def alerts(events: DataFrame, ts: str = "ts", latency: str = "value", is_error: Column | None = None,
           window: str = "1 minute", watermark: str | None = None,
           error_warning: float = ERROR_RATE_WARNING, error_critical: float = ERROR_RATE_CRITICAL,
           response_warning: float = RESPONSE_WARNING_MS, response_critical: float = RESPONSE_CRITICAL_MS) -> DataFrame:
    """Tumbling-window alerting; the same function serves the batch twin and the
    stream (with ``watermark`` set, late rows beyond it are dropped)."""
    is_error = (c("event_type") == "error") if is_error is None else is_error
    df = events.withWatermark(ts, watermark) if watermark else events
    g = df.groupBy(F.window(ts, window).alias("w")).agg(
        F.count(F.lit(1)).alias("events"), F.count_if(is_error).alias("errors"),
        F.avg(latency).alias("avg_response"))
    rate = c("errors") / c("events")
    lvl = lambda x, warn, crit: F.when(x > crit, "CRITICAL").when(x > warn, "WARNING").otherwise("OK")
    return g.select(c("w.start").alias("window_start"), c("w.end").alias("window_end"), "events", "errors",
                    rate.alias("error_rate"), "avg_response",
                    lvl(rate, error_warning, error_critical).alias("error_level"),
                    lvl(c("avg_response"), response_warning, response_critical).alias("response_level"))


#: Levels of an alert, by rank.
LEVELS = ["OK", "WARNING", "CRITICAL"]
#: Columns of an episode.
EPISODE = ("series string, metric string, raised_at timestamp, last_seen timestamp, windows long, level string, "
           "closed_at timestamp, reason string")


def alert_windows(events: DataFrame, series: Column, ts: str = "ts", latency: str = "value", is_error: Column | None = None, window: str = "1 minute",
                  watermark: str | None = None, limits: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Per series, window and metric the level as a rank in ``LEVELS``: (series, metric, window_start,
    window_end, rank).  ``limits``: warning and critical threshold of error_rate and response."""
    limits = limits or {"error_rate": (ERROR_RATE_WARNING, ERROR_RATE_CRITICAL), "response": (RESPONSE_WARNING_MS, RESPONSE_CRITICAL_MS)}
    is_error = (c("event_type") == "error") if is_error is None else is_error
    df = events.withWatermark(ts, watermark) if watermark else events
    g = df.groupBy(series.cast("string").alias("series"), F.window(ts, window).alias("w")).agg(
        (F.count_if(is_error) / F.count(F.lit(1))).alias("error_rate"), F.avg(latency).alias("response"))
    rank = lambda m: F.when(c(m) > limits[m][1], 2).when(c(m) > limits[m][0], 1).otherwise(0)
    rows = g.select("series", "w", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), rank(m).alias("rank")) for m in ("error_rate", "response")])).alias("m"))
    if watermark:  # the window itself carries the watermark to what follows
        return rows.select("series", "m.metric", c("w.start").alias("window_start"), F.window_time("w").alias("window_end"), "m.rank")
    return rows.select("series", "m.metric", c("w.start").alias("window_start"), c("w.end").alias("window_end"), "m.rank")


def alert_episodes(windows: DataFrame, silence_seconds: int) -> DataFrame:
    """V20 life cycle, batch twin of ``streaming.stream_alert_episodes``: one row an episode of a (series, metric).
    A window above its threshold raises it, further ones within ``silence_seconds`` of the last one's end
    repeat it (``windows``, worst ``level``), a window that is OK again clears it; without any window for that
    long it is closed for want of data.  What the table's last window leaves undecided is ``open``.
    Gaps and islands: one running window over the windows of a series."""
    by = Window.partitionBy("series", "metric").orderBy("window_start")
    after = c("window_end") + F.make_dt_interval(secs=F.lit(silence_seconds))
    bad = c("rank") > 0
    follows = F.lag(bad, 1, False).over(by) & (F.lag(after).over(by) > c("window_start"))
    rows = windows.select("*", bad.alias("bad"), after.alias("limit"), F.coalesce(bad & ~F.coalesce(follows, F.lit(False)), F.lit(False)).cast("int").alias("raised"), F.lead("window_start").over(by).alias("next"))
    rows = rows.withColumn("episode", F.sum("raised").over(by.rowsBetween(Window.unboundedPreceding, 0))).where("bad")
    g = rows.groupBy("series", "metric", "episode").agg(
        F.min("window_start").alias("raised_at"), F.max("window_end").alias("last_seen"), F.count(F.lit(1)).alias("windows"), F.max("rank").alias("rank"),
        F.max(F.struct("window_start", "limit", "next")).alias("last"))
    horizon = windows.agg(F.max("window_end")).collect()[0][0]
    cleared = c("last.next") < c("last.limit")
    silent = c("last.next").isNotNull() | (F.lit(horizon) >= c("last.limit"))
    return g.select("series", "metric", "raised_at", "last_seen", "windows", F.element_at(F.array(*[F.lit(x) for x in LEVELS]), c("rank") + 1).alias("level"),
                    F.when(cleared, c("last.next")).when(silent, c("last.limit")).alias("closed_at"),
                    F.when(cleared, "cleared").when(silent, "no data").otherwise("open").alias("reason"))


# ----------------------------------------------------------------- V21
# Document quality checks (name, pattern, must match).
DOC_CHECKS = [
    ("has_title", r"(?m)^# ", True),
    ("has_sections", r"(?m)^## ", True),
    ("no_placeholders", r"\[[A-Za-z ]*placeholder[A-Za-z ]*\]", False),
    ("no_todo_markers", r"\b(TODO|FIXME|XXX)\b", False),
]


def check_documents(df: DataFrame, key: list[str], text: str) -> DataFrame:
    """One row per (document, check) with passed = the named condition holds."""
    return df.select(*key, F.explode(F.array(*[
        F.struct(F.lit(n).alias("check"), (c(text).rlike(p) if must else ~c(text).rlike(p)).alias("passed"))
        for n, p, must in DOC_CHECKS])).alias("r")).select(*key, "r.*")


# ----------------------------------------------------------------- V24
def table_summary(tables: DataFrame) -> DataFrame:
    """Per table: columns, foreign keys, indexes and the primary key."""
    return tables.select("project_id", "path", "table_name", "n_columns", "n_foreign_keys", "n_indexes",
                         F.array_join(F.coalesce(c("primary_key"), F.array()), ", ").alias("primary_key"))
