"""Sum-of-squares packing: pieces against the library, places gapless, the rule against its definition."""

import random
import zlib

import numpy as np
import pytest

from migscope.llm import packing
from migscope.llm.text import tokenizer_path
from tests.llm.test_tokens import mixed_texts

PATH = tokenizer_path("word_bpe_49k.json")


def library_pieces(tok, text, limit):
    ids = [*tok.encode(text or "", add_special_tokens=False).ids, 0]
    return [(k // limit, k, len(ids[k:k + limit]), zlib.crc32(np.array(ids[k:k + limit], "<u4").tobytes())) for k in range(0, len(ids), limit)]


def check_places(rows, limit):
    """Each sequence is filled from 0 without a gap, up to ``limit``; the number of sequences."""
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= limit
    return len(by)


def test_words_are_the_librarys(monkeypatch):
    monkeypatch.setattr(packing.Pieces, "FULL", 300)
    words = packing.Words(PATH)
    texts = mixed_texts(4000, seed=9) + ["", " ", "\n", "a", "é", "x" * 23, "x" * 24, "x" * 25, "It's  an\to\x0bdd\r\nLINE' 'S 's"]
    for lo in range(0, len(texts), 90):
        some = texts[lo:lo + 90]
        for t, ids in zip(some, words.encode([t.encode() for t in some]), strict=True):
            assert ids.tolist() == words.tok.encode(t, add_special_tokens=False).ids, t


@pytest.mark.parametrize("limit", [4, 13, 64])
def test_every_placement_is_the_least_sum(limit):
    """Against the sums of squares written out, over all open sequences with room."""
    rng = random.Random(limit)
    state, gaps = packing.SumOfSquares(limit), []
    for size in [rng.randint(1, limit) for _ in range(400)] + [limit, 1]:
        def total(k, size=size):
            new = [g - size if j == k else g for j, g in enumerate(gaps)]
            return sum(new.count(g) ** 2 for g in set(new) if g > 0)
        room = [k for k, g in enumerate(gaps) if g >= size]
        best = min(map(total, room), default=None)
        sequence, offset = state.place(size)
        if best is None:
            assert sequence == len(gaps) and offset == 0
            gaps.append(limit - size)
        else:
            assert gaps[sequence] >= size and total(sequence) == best and offset == limit - gaps[sequence]
            assert gaps[sequence] == min(gaps[k] for k in room if total(k) == best)
            gaps[sequence] -= size


@pytest.mark.parametrize(("limit", "group"), [(2048, packing.GROUP), (50, 40)])
def test_pieces(spark, docs, docs_rows, limit, group):
    rows = packing.pack(packing.cut(docs, limit=limit, with_ids=True), limit, group).cache()
    got = {}
    for r in rows.collect():
        got.setdefault(r["id"], []).append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    tok = packing.Words(PATH).tok
    assert {i: sorted(p) for i, p in got.items()} == {i: library_pieces(tok, t, limit) for i, t in docs_rows}
    used = check_places(rows.collect(), limit)
    total = sum(n for p in got.values() for _, _, n, _ in p)
    groups = -(-sum(map(len, got.values())) // group)
    assert -(-total // limit) <= used <= -(-total // limit) * 1.1 + groups
    filled = {r["sequence_id"]: np.frombuffer(r["ids"], "<u4") for r in packing.sequences(rows).collect()}
    assert len(filled) == used
    for r in rows.collect():
        assert zlib.crc32(filled[r["sequence_id"]][r["offset"]:r["offset"] + r["length"]].tobytes()) == r["ids_crc32"]


def test_odd_rows(odd_docs, no_docs):
    rows = packing.digest(odd_docs).collect()
    assert sorted(r["length"] for r in rows if r["doc_id"] == 7) == [1, 1]  # an empty and a null text: the end id
    assert sum(r["doc_id"] is None for r in rows) == 3 and sum(r["doc_id"] == 5 for r in rows) == 3
    assert check_places(rows, packing.LIMIT) == 1
    assert packing.digest(no_docs).collect() == [] and packing.sequences(packing.pack(packing.cut(no_docs, with_ids=True))).collect() == []


def test_a_very_long_text(spark):
    text = "word and another " * 60_000
    rows = packing.digest(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == library_pieces(packing.Words(PATH).tok, text, 2048)
    assert check_places(rows, 2048) == len(rows)


def test_full_groups_leave_little_room():
    """Lengths like those of prose: no more than half a percent above the least number of sequences."""
    sizes = np.clip(np.random.default_rng(4).lognormal(6.3, 0.8, packing.GROUP).astype(int), 1, 2048)
    state = packing.SumOfSquares(2048)
    for s in np.sort(sizes)[::-1].tolist():
        state.place(s)
    assert state.opened <= sizes.sum() / 2048 * 1.005
