"""Registered queries on the driver's tables: SQL oracles, recall, and the pipeline against its operators."""

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from migscope.llm import decontaminate, mixing, registry, toxicity
from migscope.llm.repair import Encoder
from migscope.llm.text import tokenizer_path
from tests.conftest import SF
from tests.llm import brute


def tables():
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_sql(spark, name):
    con = tables()
    want = con.execute(registry.SQL[name])
    columns = [c[0] for c in want.description]
    got = registry.QUERIES[name](spark, SF)
    assert sorted(columns) == sorted(got.columns)
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=str) == sorted(map(tuple, want.fetchall()), key=str)


def test_names():
    assert [q.split("_")[0] for q in registry.QUERIES] == [f"op{k}" for k in range(1, 14)]


def test_recall(spark):
    rows = tables().execute("SELECT vec_id, embedding FROM embeddings ORDER BY vec_id").fetchall()
    x = np.array([v for _, v in rows])
    hits = total = 0
    got = {}
    for r in registry.op5_multi_index_hashing(spark, SF).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    for q, found in got.items():
        s = x @ x[q]
        s[q] = -9
        hits += len(found & set(np.argsort(-s)[:20].tolist()))
        total += 20
    assert len(got) == -(-len(x) // 20) and hits >= 0.9 * total


def test_pipeline(spark):
    """Each stage alone against its operator's own result on the stage's input."""
    assert [s for s, _ in corpus_pipeline.STAGES] == ["toxicity", "near duplicates", "decontamination", "mixing", "token ids"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    stage = dict(corpus_pipeline.STAGES)
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())

    now = stage["toxicity"](spark, docs, SF)
    scored = toxicity.score(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert now.columns == columns and ids(now) == ids(scored.where("predicted = 0"))
    now = now.cache()
    after = stage["near duplicates"](spark, now, SF).cache()
    texts = [(r["doc_id"], r["text"]) for r in now.select("doc_id", "text").collect()]
    assert after.columns == columns and ids(after) == sorted(i for i, (_, _, kept) in brute.components(texts, percent=80).items() if kept)
    now, after = after, stage["decontamination"](spark, after, SF).cache()
    found = decontaminate.digest(decontaminate.find(now, spark.read.parquet(f"{SF}/benchmark.parquet")))
    assert after.columns == columns and ids(after) == ids(found.where("not contaminated"))
    now, after = after, stage["mixing"](spark, after, SF).cache()
    assert after.columns == columns
    assert ids(after) == sorted(r["doc_id"] for r in mixing.digest(now).collect() for _ in range(r["copies"]))
    out = stage["token ids"](spark, after, SF).collect()
    encoder = Encoder(tokenizer_path("byte_bpe_50k.json"))
    want = {r["doc_id"]: len(encoder.tok.encode(r["text"]).ids) + 1 for r in now.select("doc_id", "text").collect()}
    assert sorted(r["doc_id"] for r in out) == ids(after) and all(r["n_tokens"] == want[r["doc_id"]] for r in out)
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, out))


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Null ids, texts and sources, repeated rows, empty texts, a very long text, and tables without rows."""
    long = " ".join(f"w{k}" for k in range(60_000))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(None, None, None, None, None), (None, "a b c", None, "x", 5), (None, "a b c", None, "x", 5), (1, "", "en", "x", 0), (2, None, "en", None, None),
            (3, long, "en", "x", len(long)), (4, long + " end", "en", "y", None), (5, "some words of a text", "en", "y", 20), (5, "some words of a text", "en", "y", 20)]
    for name, made in (("odd", rows), ("none", [])):
        d = tmp_path / name
        spark.createDataFrame(made, schema).write.parquet(str(d / "documents.parquet"))
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(d / "labels.parquet"))
        spark.createDataFrame([("b1", None), (None, ""), ("b2", "words nobody wrote")], "item_id string, text string").write.parquet(str(d / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path / "odd")).collect()
    # Without labels nothing is toxic; documents 3 and 4 are near copies, the first stays.
    assert {3} <= {r["doc_id"] for r in out} <= {None, 1, 2, 3, 5} and sorted(r["start"] for r in out)[0] == 0
    assert all(r["n_tokens"] == 1 for r in out if r["doc_id"] in (1, 2)) and all(r["n_tokens"] > 60_000 for r in out if r["doc_id"] == 3)
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).collect() == []
