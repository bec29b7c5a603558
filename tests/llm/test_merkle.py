"""Merkle manifest against a direct computation, at several heights."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from migscope.llm import merkle

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, idx long, n long, path string, digest string"


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def leaf_of(row):
    return sha("".join("-" if row[f] is None else f"{len(str(row[f]).encode())}:{row[f]}" for f in FIELDS))


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][k:k + 16])) for k in range(0, len(levels[-1]), 16)])
    return levels


def climb(levels, at, other):
    """(proof text, root from ``other``)."""
    out = ""
    for level in levels[:-1]:
        run = level[at - at % 16:at - at % 16 + 16]
        out += "".join(run[:at % 16] + run[at % 16 + 1:])
        run[at % 16] = other
        other, at = sha("".join(run)), at // 16
    return out, other


def brute(rows):
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        by[s].sort(key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, leaf_of(r)))
        trees[s] = tree([leaf_of(r) for r in by[s]])
    upper = tree([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for at, r in enumerate(by[s]):
            other = r
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and r["text"] is not None:
                other = r | {"text": "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"])}
            low, sub = climb(trees[s], at, leaf_of(other))
            high, root = climb(upper, k, sub)
            out.append((r["doc_id"], leaf_of(r), trees[s][-1][0], upper[-1][0], sha(low + high), root, root == upper[-1][0]))
    return sorted(out, key=str)


def table(spark, rows):
    made = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"], None, None, None, None, None) for r in rows]
    return spark.createDataFrame(made, SCHEMA)


def some_rows(n, sources, seed=1):
    rng = random.Random(seed)
    ids = rng.sample(range(-200_000, 400_000), n)
    return [{"doc_id": i, "text": rng.choice(["Some Text", "é中 text", "", None, "lower"]), "lang": rng.choice(["en", None]), "n_chars": rng.choice([None, 7]),
             "source": rng.choice(sources)} for i in ids]


@pytest.mark.parametrize(("levels", "n", "sources"), [(3, 700, ["a", "b", None, "é", "A", ""]), (1, 700, ["a", "a", "a", "b", "c"]), (1, 90, [f"s{k}" for k in range(70)]), (3, 1, ["x"]), (3, 40, [None])])
def test_manifest(spark, monkeypatch, levels, n, sources):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "BITS", 4 * levels)
    rows = some_rows(n, sources)
    got = merkle.digest(table(spark, rows).repartition(3)).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)
    assert {r["verified"] for r in got} == ({True, False} if n > 50 else {r["verified"] for r in got})


def test_ties(spark, monkeypatch):
    """Repeated rows, repeated ids and null ids, more of them than one task takes."""
    monkeypatch.setattr(merkle, "HOT", 20)
    rows = some_rows(60, ["a", "b"])
    rows += [dict(rows[0]) for _ in range(40)] + [dict(r, text=f"other {k}") for k, r in enumerate(rows[:10])]
    rows += [{"doc_id": None, "text": f"null {k % 30}", "lang": None, "source": "a", "n_chars": None} for k in range(50)]
    rows += [dict.fromkeys(FIELDS)] * 3
    random.Random(5).shuffle(rows)
    assert sorted(map(tuple, merkle.digest(table(spark, rows).repartition(4)).collect()), key=str) == brute(rows)


def test_odd_rows(odd_docs, no_docs):
    rows = [r.asDict() | {"lang": None, "n_chars": None} for r in odd_docs.collect()]
    assert sorted(map(tuple, merkle.digest(odd_docs).collect()), key=str) == brute(rows)
    assert merkle.digest(no_docs).collect() == []


@pytest.mark.parametrize("n", [1, 100, 4096, 4097, 30_000, 65_536])
def test_ranks(n):
    low = np.sort(np.random.default_rng(n).choice(65_536, n, replace=False))
    payload = merkle.packed(low)
    assert len(payload) == min(2 * n, 8193) and merkle.unpacked(payload).tolist() == low.tolist()
    assert merkle.ranks(payload, low).tolist() == list(range(n))


def test_very_long_text(spark):
    rows = [{"doc_id": k, "text": "LONG text " * 300_000, "lang": "en", "source": "s", "n_chars": 1} for k in range(3)]
    assert sorted(map(tuple, merkle.digest(table(spark, rows)).collect()), key=str) == brute(rows)
