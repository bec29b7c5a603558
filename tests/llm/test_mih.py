"""Multi-index hashing: the ball against all codes, recall and scores against all products."""

import numpy as np
import pytest

from migscope.llm import mih


def test_ball_is_complete():
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 256, (3000, 3), dtype=np.uint8)
    index = mih.Index(codes)
    for q in rng.integers(0, 256, (20, 3), dtype=np.uint8):
        distance = mih.COUNT[codes ^ q].sum(axis=1)
        for radius in range(25):
            assert index.ball(q, radius).tolist() == np.flatnonzero(distance <= radius).tolist()


def vectors(n, dim, seed=2):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    x = centres[rng.integers(0, 6, n)] + rng.normal(size=(n, dim)) * 0.7
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32).astype(float)


@pytest.mark.parametrize(("n", "dim", "shard", "queries"), [(1500, 32, 16384, 2048), (1500, 64, 300, 20), (400, 5, 100, 7)])
def test_search(spark, monkeypatch, n, dim, shard, queries):
    monkeypatch.setattr(mih, "SHARD", shard)
    monkeypatch.setattr(mih, "QUERIES", queries)
    x = vectors(n, dim)
    x[100:160] = x[40]  # copies: ties to the smaller id
    df = spark.createDataFrame([(i * 2, v.tolist(), i, 0.0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, side int, score double")
    got = {}
    for r in mih.search(df).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    hits = total = 0
    assert sorted(got) == [i * 2 for i in range(n) if i * 2 % 20 == 0]
    for q, found in got.items():
        scores = np.array([(v * x[q // 2]).sum() for v in x])
        order = [i for i in np.lexsort((np.arange(n), -scores)) if i != q // 2][:20]
        assert sorted(found) == list(range(1, 21))
        ranked = [found[k] for k in range(1, 21)]
        assert ranked == sorted(ranked, key=lambda r: (-r[1], r[0])) and all(abs(s - scores[v // 2]) < 1e-12 for v, s in ranked)
        hits += len({v // 2 for v, _ in ranked} & set(order))
        total += 20
    assert hits >= 0.95 * total
    assert [got[80][k][0] for k in range(1, 21)] == [200 + 2 * k for k in range(20)]


def test_odd_vectors(spark):
    x = [[1.0, 2.0], [2.0, 1.0], None, [0.0, 0.0], [float("nan"), 1.0], [None, 1.0], [float("inf"), 1.0], [1.0], [1.0, 2.0]]
    rows = [(i, v) for i, v in enumerate(x)] + [(None, [1.0, 1.0]), (1, [2.0, 1.0]), (20, [3.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in mih.search(df).collect())
    assert got == [(0, 1, 20, 9.0), (0, 2, 8, 5.0), (0, 3, 1, 4.0), (20, 1, 0, 9.0), (20, 2, 1, 9.0), (20, 3, 8, 9.0)]
    assert mih.search(df.limit(0)).collect() == []
    assert mih.search(df.where("vec_id = 0")).collect() == []
