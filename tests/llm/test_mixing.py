"""The mix against its definition, and the decontamination against brute force."""

import random

import pytest

from migscope.llm import decontaminate, mixing
from tests.llm import brute
from tests.llm.conftest import by_id


def level(sizes, share=1.5, most=2, weights=(5, 2, 1)):
    """Targets by sharing the excess again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, full = share * sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        open_weight = sum(weight[s] for s in names if s not in full)
        target = {s: most * sizes[s] if s in full else rest * weight[s] / open_weight for s in names}
        above = {s for s in names if s not in full and target[s] > most * sizes[s]}
        if not above:
            return target
        full |= above


def sources(seed, n=600):
    rng = random.Random(seed)
    names = ["src0", "src10", "src2", "Ä", "z", None]
    return [(i, " ".join(["w"] * int(rng.paretovariate(1.2))), rng.choices(names, weights=[30, 8, 5, 3, 2, 2])[0]) for i in range(n)]


@pytest.mark.parametrize("bins", [65536, 4])
def test_mix(spark, monkeypatch, bins):
    monkeypatch.setattr(mixing, "BINS", bins)
    rows = sources(1)
    got = mixing.digest(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len(t.split())
    want = level(size)
    assert len(got) == len(rows)
    assert {(r["source"], r["source_size"]) for r in got} == set(size.items())
    taken = {}
    for r in got:
        assert r["taken"] in (0, r["size"], 2 * r["size"]) and r["target"] == pytest.approx(want[r["source"]])
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    for s, n in taken.items():
        assert abs(n - want[s]) <= max(len(t.split()) for _, t, x in rows if x == s) / 2 + 1e-6
    again = mixing.digest(spark.createDataFrame(rows[::-1], "doc_id long, text string, source string").repartition(5)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again)) if None not in size else {tuple(r) for r in got} == {tuple(r) for r in again}


def test_inclusion_follows_the_odds(spark):
    """A source of equal documents: the share of drawn ones is the target's, over many sources."""
    rows = [(i, "a b c", f"s{i % 40:02d}") for i in range(8000)]
    got = mixing.digest(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for s in {r["source"] for r in got}:
        own = [r for r in got if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 1.5


def test_copies_and_odd_rows(spark, docs, odd_docs, no_docs):
    mixed = mixing.copies(docs)
    assert mixed.columns == docs.columns
    want = {r["doc_id"]: r["copies"] for r in mixing.digest(docs).collect() if r["copies"]}
    assert {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == want
    got = mixing.digest(odd_docs).collect()
    assert len(got) == 8 and sum(r["size"] for r in got) == 120 * 4 + 2 and all(r["taken"] <= 2 * r["size"] for r in got)
    assert mixing.digest(no_docs).collect() == [] and mixing.copies(no_docs).collect() == []
    empty = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert [tuple(r)[2:6] for r in mixing.digest(empty).collect()] == [(0, 0, 0.0, 0)] * 2


def items_of(docs_rows):
    text = dict(docs_rows)
    words = max((t or "" for t in text.values()), key=len).split()
    return [(1, " ".join(words[50:75])), (2, " ".join(words[60:64])), (3, None), (4, " ,; "), (None, " ".join(words[:20])), (1, "run run run run run run run run run run run"),
            (10, "A, B a-b A b a b a b a b a b"), (2, " ".join(words[60:64])), (11, " ".join(words[100:109]) + " nowhere " + " ".join(words[110:119])), (12, "ONE")]


@pytest.mark.parametrize(("size", "step", "block"), [(10, 1 << 20, 1 << 20), (10, 3, 60), (4, 7, 1 << 20), (1, 1 << 20, 40)])
def test_decontamination(spark, docs, docs_rows, monkeypatch, size, step, block):
    """One block of items and several, and short steps of verification."""
    monkeypatch.setattr(decontaminate, "STEP", step)
    items = items_of(docs_rows)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.digest(decontaminate.find(docs, benchmark, size, block))
    want = brute.benchmark_hits(docs_rows, [x for x in items if x[0] is not None], size)
    assert by_id(got, ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]) == want


def test_decontamination_of_odd_rows(spark, docs, docs_rows, odd_docs, no_docs):
    benchmark = spark.createDataFrame(items_of(docs_rows), "item_id long, text string")
    clean = decontaminate.clean(docs, benchmark)
    hit = {r["doc_id"] for r in decontaminate.digest(decontaminate.find(docs, benchmark)).where("contaminated").collect()}
    assert clean.columns == docs.columns and {r["doc_id"] for r in clean.collect()} == {i for i, _ in docs_rows} - hit and hit
    assert decontaminate.find(odd_docs, benchmark).count() == 8
    assert decontaminate.find(no_docs, benchmark).collect() == []
    nothing = decontaminate.digest(decontaminate.find(odd_docs, benchmark.limit(0))).collect()
    assert len(nothing) == 8 and not any(r["contaminated"] for r in nothing)


def test_stored_tables_are_deleted(spark, monkeypatch):
    """Only what was written since: other tests still read theirs."""
    import os

    from migscope.llm import text
    monkeypatch.setattr(text, "WRITTEN", [])
    t = text.stored(spark.range(5), "some")
    (path,) = text.WRITTEN
    assert t.count() == 5 and os.path.isdir(path)
    text.forget_stored(spark)
    assert not os.path.exists(path) and text.WRITTEN == []
