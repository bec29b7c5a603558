"""Held-out accuracy, the linear-time scan against all segments, and odd rows."""

import math
import random

import numpy as np

from migscope.llm import toxicity


def all_maximal_segments(s):
    """Ruzzo and Tompa's definition, recursively: the best segment (shortest of equals), then left and right of it."""
    def of(lo, hi):
        best = max(((sum(s[i:j]), i - j, -i, i, j) for i in range(lo, hi) for j in range(i + 1, hi + 1)), default=(0,) * 5)
        if best[0] <= 0:
            return []
        return [*of(lo, best[3]), (best[3], best[4], best[0]), *of(best[4], hi)]

    return of(0, len(s))


def test_segments():
    rng = random.Random(1)
    for _ in range(300):
        s = [rng.choice([-3.0, -1.0, -0.5, 0.75, 2.0, 5.0]) + rng.random() / 97 for _ in range(rng.randint(0, 12))]
        got, want = toxicity.segments(np.array(s)), all_maximal_segments(s)
        assert [x[:2] for x in got] == [x[:2] for x in want]
        assert all(math.isclose(x[2], y[2]) for x, y in zip(got, want, strict=True))


def test_words():
    counts, buckets = toxicity.words([b"Ab, cd!e", b"", b"--", "É1 x".encode(), b"abcdefgh abcdefzz"])
    assert counts.tolist() == [3, 0, 0, 2, 2]
    assert buckets[2][-1] == buckets[2][-2] and len(buckets[0]) == 7


def test_words_are_read_whole():
    counts, buckets, grams, inner = toxicity.tokens(["abcdefgh abcdefzz xyabcdef абвгдежз абвгдеёз".encode(), "他是坏人。ab".encode(), "\xa0x é’s".encode()])
    assert counts.tolist() == [5, 6, 4] and grams.tolist() == [2, 2, 2, 2, 2] + [0] * 10 and len(inner) == 10
    whole, six = buckets[3], buckets[2]
    assert len(set(whole[:5].tolist())) == 5 and six[0] == six[1] and six[3] == six[4]
    assert inner[5] == six[0]  # a stem inside a compound
    again = toxicity.tokens(["坏人。x".encode()])[1]
    assert buckets[2][7] == again[2][0] and buckets[1][7] == again[1][0] != buckets[1][5]


def test_toxic_passage_without_separators(spark):
    rng = random.Random(4)
    rows = []
    for i in range(600):
        t = "".join(chr(rng.randint(0x4E00, 0x4E7F)) for _ in range(rng.randint(60, 200)))
        for _ in range(rng.randint(3, 6) if i % 6 == 0 else 0):
            at = rng.randint(10, len(t))
            t = t[:at] + "坏蛋白痴" + t[at:]
        rows.append((i, t))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    held = toxicity.score(docs, docs.selectExpr("doc_id", "cast(doc_id % 6 = 0 as int) as toxic")).where("held_out").collect()
    assert sum(r["predicted"] == (r["doc_id"] % 6 == 0) for r in held) >= 0.97 * len(held) > 100


def corpus(spark, n, seed, insults=("scumbag", "vile", "lowlife")):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        w = [rng.choice("abcdefgh") * rng.randint(1, 3) + str(rng.randint(0, 60)) for _ in range(rng.randint(20, 200))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(rng.randint(4, 9)):
                w[rng.randrange(len(w))] = rng.choice(insults) + rng.choice(["", "s", "ity"])
        rows.append((i, " ".join(w), None, None))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, score double, label int"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = corpus(spark, 1500, 3)
    got = {r["doc_id"]: r for r in toxicity.score(docs, labels).collect()}
    held = [r for r in got.values() if r["held_out"]]
    assert len(got) == 1500 and 400 < len(held) < 600
    assert sum(r["predicted"] == (r["doc_id"] % 6 == 0) for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got.values())
    hit = next(r for r in held if r["predicted"] == 1)
    words = docs.where(f"doc_id = {hit['doc_id']}").collect()[0]["text"].split()
    assert any(w.startswith(("scum", "vile", "lowl")) for p in hit["passages"] for w in words[p["first"]:p["end"]])
    kept = toxicity.reject(docs, labels)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["predicted"] == 0}


def test_labels_of_the_held_out_fold_are_not_used(spark):
    docs, labels = corpus(spark, 300, 4)
    flipped = labels.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 3 = 1 then 1 - toxic else toxic end as toxic")
    a = {r["doc_id"]: r["score"] for r in toxicity.score(docs, labels).collect()}
    assert a == {r["doc_id"]: r["score"] for r in toxicity.score(docs, flipped).collect()}


def test_odd_rows(spark, odd_docs, no_docs):
    docs, labels = corpus(spark, 300, 5)
    odd = docs.select("doc_id", "text").union(odd_docs.select("doc_id", "text"))
    more = labels.union(spark.createDataFrame([(0, None), (0, 1), (0, 1), (None, 1)], "doc_id long, toxic int"))
    got = toxicity.score(odd, more).collect()
    assert len(got) == 308 and {r["held_out"] for r in got if r["doc_id"] is None} == {False}
    empty = [r["score"] for r in got if not r["n_words"]]
    assert len(empty) == 3 and len(set(empty)) == 1 and empty[0] < 0.7
    assert toxicity.score(no_docs, labels).collect() == []
    none = labels.where("toxic = 0")
    assert {r["score"] for r in toxicity.score(docs, none).collect()} <= {1 / (1 + math.exp(30))}
    assert toxicity.reject(docs, labels.limit(0)).count() == 300
