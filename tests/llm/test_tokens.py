"""Token files and token counts: exact round trips against the library."""

import random
import zlib

import numpy as np
import pytest

from migscope.llm import repair, whole_token
from migscope.llm.text import tokenizer_path

BYTES, WORDS = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("word_bpe_49k.json")
ATOMS = ["a", "B", " ", "  ", "\n", "\t", ".", ",", "'s", "don't", "'", "é", "ß", "É", "中", "x\0", "\0", "1", "23", "<|endoftext|>", "<|startoftext|>", " the",
         "supercalifragilisticexpialidocious", "\xa0", "ſ", "\x1c", "²", "µ", "🙂", "!?", "é"]


def mixed_texts(n, seed=5):
    rng = random.Random(seed)
    return ["".join(rng.choices(ATOMS, k=rng.randint(0, 14))) for _ in range(n)]


def test_encoder_is_the_library():
    encoder = repair.Encoder(BYTES)
    texts = mixed_texts(3000)
    for lo in range(0, len(texts), 100):
        some = texts[lo:lo + 100]
        for t, ids in zip(some, encoder.encode([t.encode() for t in some]), strict=True):
            assert ids.tolist() == encoder.tok.encode(t, add_special_tokens=False).ids, t


def test_white_space_runs_are_the_librarys():
    """A single space inside other white space, which is one pre-token with it."""
    encoder = repair.Encoder(BYTES)
    rng = random.Random(8)
    runs = ["a \xa0 \xa0 b", "a" + " \xa0" * 4 + " b", "a\n \n b", "a\xa0 ", "\xa0 ", " \xa0 \xa0", "é à \xa0 \xa0 x", "中\u3000 \u3000 中", "a\u2003 \u2003 b", "", " "]
    white = [" ", " ", "\xa0", "\xa0", "\n", "\t", "\r", "\x1c", "\x85", "\u2003", "\u2028", "\u202f", "\u3000"]
    runs += ["x".join("".join(rng.choices(white, k=rng.randint(1, 9))) for _ in range(rng.randint(1, 4))) for _ in range(3000)]
    for t, ids in zip(runs, encoder.encode([t.encode() for t in runs]), strict=True):
        assert ids.tolist() == encoder.tok.encode(t, add_special_tokens=False).ids, repr(t)
    assert encoder.spanned_cuts([t.encode() for t in runs[:11]]) == {0, 1, 2, 3, 4, 5, 6, 7, 8}


def test_full_piece_table_starts_anew(monkeypatch):
    monkeypatch.setattr(repair.Pieces, "FULL", 50)
    monkeypatch.setattr(repair, "PARTS", 20)
    encoder = repair.Encoder(BYTES)
    for k in range(40):
        t = " ".join(f"word{j}" for j in range(k * 5, k * 5 + 9))
        assert encoder.encode([t.encode()])[0].tolist() == encoder.tok.encode(t).ids


@pytest.mark.parametrize("min_count", [2, 5, 32])
def test_grammar_round_trip(min_count):
    rng = np.random.default_rng(2)
    for ids in (rng.integers(0, 6, 4000), np.full(999, 9), np.zeros(0, int), np.array([7]), np.tile([4, 5, 6, 2], 500), rng.zipf(1.3, 5000) % 50257):
        shard = repair.Shard(repair.pack(*repair.compress(ids.astype(np.uint16), 50257, min_count=min_count), 50257))
        assert shard.all().tolist() == ids.tolist()
        for _ in range(20):
            lo, hi = sorted(rng.integers(0, len(ids) + 1, 2))
            assert shard.ids(int(lo), int(hi)).tolist() == ids[lo:hi].tolist()
        if len(ids) == 2000:
            assert len(shard.seq) == 1000 and shard.lengths.max() == 3  # the end id is in no rule


def test_wide_vocabulary():
    ids = np.tile(np.array([200000, 3, 5, 9], np.uint32), 400)
    shard = repair.Shard(repair.pack(*repair.compress(ids, 250000), 250000))
    assert shard.all().tolist() == ids.tolist() and len(shard.left)


def test_rules_go_on(monkeypatch):
    """No frequent pair is left, and symbols pass 16 bits: 40 first symbols below the border."""
    rng = np.random.default_rng(6)
    words = [rng.integers(0, 3000, 6) for _ in range(400)]
    ids = np.concatenate([words[k] for k in rng.integers(0, 400, 9000)])
    for first in ((1 << 16) - 40, 1 << 16, 5000):
        seq, left, right = repair.compress(ids, first, end_id=-1, min_count=4)
        assert len(left) > 400 and (first < 1 << 15 or first + len(left) > 1 << 16)
        shard = repair.Shard(repair.pack(seq, left, right, first))
        assert shard.all().tolist() == ids.tolist() and shard.ids(1000, 1100).tolist() == ids[1000:1100].tolist()
        pairs, n = np.unique(np.stack([seq[:-1], seq[1:]]), axis=1, return_counts=True)
        assert (n < 8).all()  # an overlapping run counts twice what it can give


def test_token_files(spark, docs, docs_rows, tmp_path, monkeypatch):
    monkeypatch.setattr(repair, "SHARD_IDS", 500)
    path = str(tmp_path / "ids")
    repair.write(docs, path, BYTES)
    encoder = repair.Encoder(BYTES)
    at, want = 0, {}
    for i, t in sorted(docs_rows):
        ids = np.array([*encoder.tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want[i] = (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert {r["id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in repair.read(spark, path).collect()} == want
    i, t = max(docs_rows, key=lambda r: len(r[1] or ""))
    assert repair.fetch(spark, path, i) == [*encoder.tok.encode(t).ids, 2] and repair.fetch(spark, path, -5) == []


def test_token_files_of_odd_rows(odd_docs, no_docs):
    rows = repair.digest(odd_docs).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == [5, 5, 5, 7, 7, None, None, None]
    assert [b["start"] - a["start"] for a, b in zip(rows, rows[1:], strict=False)] == [r["n_tokens"] for r in rows[:-1]]
    assert sorted(r["n_tokens"] for r in rows if r["doc_id"] == 7) == [1, 1]
    assert repair.digest(no_docs).collect() == []


def test_counts_are_the_librarys():
    whole = whole_token.proven(WORDS)
    counter = whole_token.Counter(WORDS, whole)
    assert "the" in whole and len(whole) > 20000
    for t in mixed_texts(4000, seed=6):
        assert counter.count(t) == len(counter.tok.encode(t, add_special_tokens=False).ids), t


def test_counts(docs, docs_rows, odd_docs, no_docs):
    tok = whole_token.load(WORDS)
    want = {i: (len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False).ids)) for i, t in docs_rows}
    got = whole_token.count_tokens(docs, limit=500).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in got} == want
    assert {r["doc_id"] for r in got if r["over_limit"]} == {i for i, (_, n) in want.items() if n > 500} != set()
    assert whole_token.count_tokens(odd_docs).where("doc_id is null").count() == 3
    assert whole_token.count_tokens(no_docs).collect() == []
