"""Substring, byte-string, line and near-duplicate operators against brute force."""

import math

import numpy as np
import pytest

from migscope.llm import components, minhash, prefix_free, recompress, repeats, winnow
from tests.llm import brute
from tests.llm.conftest import by_id


@pytest.mark.parametrize(("window", "reach", "rounds", "steps"), [(50, 24, 2, (1,)), (50, 50, 6, (7, 1)), (8, 3, 2, (2, 1)), (2, 24, 1, (1,))])
def test_recompression(docs, docs_rows, window, reach, rounds, steps, monkeypatch):
    monkeypatch.setattr(recompress, "STEPS", steps)
    got = recompress.digest(recompress.dedup(docs, window, reach, rounds))
    assert by_id(got, ["n_words", "n_removed", "kept_sha256"]) == brute.earlier_windows(docs_rows, window)


def test_common_names_take_the_other_way(docs, docs_rows, monkeypatch):
    """Every name counts as hot, for both finders."""
    monkeypatch.setattr(repeats, "hot_names", lambda anchors: anchors.select("k").distinct())
    got = recompress.digest(recompress.dedup(docs, 8, 4))
    assert by_id(got, ["n_words", "n_removed", "kept_sha256"]) == brute.earlier_windows(docs_rows, 8)
    got = prefix_free.digest(prefix_free.dedup(docs, 60, 20))
    assert by_id(got, ["n_bytes", "n_removed", "n_spans", "kept_sha256"]) == brute.repeated_bytes(docs_rows, 60)


def test_hot_names(spark):
    rows = [(7 if k % 3 else k + 100, 0, k, 0, 0, 1) for k in range(3000)]
    hot = repeats.hot_names(spark.createDataFrame(rows, repeats.BLOCK))
    assert [r.k for r in hot.collect()] == [7] and repeats.hot_names(spark.createDataFrame([], repeats.BLOCK)).collect() == []


def test_equal_windows_choose_the_same_symbol():
    rng = np.random.default_rng(3)
    for _ in range(30):
        inner = b" ".join(b"w%d" % k for k in rng.integers(0, 4, 50))
        texts = [b" ".join([b"x%d" % k for k in rng.integers(0, 9, n)] + [inner] + [b"y%d" % k for k in rng.integers(0, 9, m)]) for n, m in rng.integers(0, 20, (4, 2))]
        flat, begin = recompress.flat_words(texts)
        place, first, count = recompress.choose(flat, begin, 50)
        seen = set()
        for k, t in enumerate(texts):
            at = begin[k] + len(t[:t.index(inner)].split())
            j = np.searchsorted(first, at, "right") - 1
            assert first[j] <= at < first[j] + count[j]
            seen.add(int(place[j] - at))
        assert len(seen) == 1


@pytest.mark.parametrize(("size", "reach", "steps"), [(400, 192, (16, 1)), (60, 20, (1,)), (60, 50, (9, 4, 1)), (24, 4, (16, 1))])
def test_prefix_free(docs, docs_rows, size, reach, steps, monkeypatch):
    monkeypatch.setattr(prefix_free, "STEPS", steps)
    got = prefix_free.digest(prefix_free.dedup(docs, size, reach))
    assert by_id(got, ["n_bytes", "n_removed", "n_spans", "kept_sha256"]) == brute.repeated_bytes(docs_rows, size)


def test_every_window_has_one_anchor():
    data = b"a" * 700 + bytes(np.random.default_rng(1).integers(97, 100, 3000, dtype=np.uint8))
    begin = np.array([0, 300, 700, 700, 2000, len(data)])
    t, first, count = prefix_free.parse(data, begin, 400, 160)
    assert ((t >= first + count - 1) & (t - first <= 160)).all()
    starts = np.sort(np.concatenate([np.arange(a, a + n) for a, n in zip(first, count, strict=True)]))
    wanted = np.concatenate([np.arange(a, max(a, b - 399)) for a, b in zip(begin[:-1], begin[1:], strict=True)])
    assert (starts == wanted).all()


def test_a_trigger_does_not_follow_the_length_of_its_text(spark):
    """Two grams whose hashes part at bit 19 and are the least of a passage of 400 bytes; one of its texts has over 2**19 bytes."""
    rng = np.random.default_rng(7)
    inner = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 400))
    inner = inner[:50] + "qsjjnwrs" + inner[58:120] + "brxgsbxh" + inner[128:]
    long = "1" + inner + "".join(rng.choice(list("0123456789"), 600_000))
    got = prefix_free.digest(prefix_free.dedup(spark.createDataFrame([(1, "0" + inner), (2, long)], "doc_id long, text string")))
    assert sorted(map(tuple, got.select("doc_id", "n_removed", "n_spans").collect())) == [(1, 400, 1), (2, 400, 1)]


@pytest.mark.parametrize("run", [3, 1, 2])
def test_winnowing(docs, docs_rows, run):
    got = winnow.digest(winnow.dedup(docs, run))
    assert by_id(got, ["n_lines", "n_removed", "kept_sha256"]) == brute.later_lines(docs_rows, run)


def test_minhash(docs, docs_rows):
    assert by_id(minhash.near_duplicates(docs), ["n_shingles", "component_id", "kept"]) == brute.components(docs_rows)


def test_minhash_splits_stars_and_blocks(docs, docs_rows, monkeypatch):
    """Stars and blocks of two rows, and a threshold at which chains arise."""
    monkeypatch.setattr(minhash, "STAR", 2)
    monkeypatch.setattr(minhash, "BLOCK", 2)
    monkeypatch.setattr(minhash, "SKETCH", 30)
    got = minhash.near_duplicates(docs, percent=60, bands=64, per_band=2, agree=40, extra=0)
    assert by_id(got, ["n_shingles", "component_id", "kept"]) == brute.components(docs_rows, percent=60)


def test_minhash_filters_follow_the_threshold(spark):
    """Similarity 0.80 to 0.846, and some just below, at a threshold of 0.8."""
    rows = []
    for k in range(120):
        a = [f"p{k}w{j}" for j in range(184)]  # 180 shingles, of which the changed end takes m
        m = (20, 20, 20, 18, 15, 21)[k % 6]
        rows += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(a[:-m] + [f"x{w}" for w in a[-m:]]))]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=80)
    assert by_id(got, ["n_shingles", "component_id", "kept"]) == brute.components(rows, percent=80)
    assert got.where("kept").count() == 140
    assert [minhash.bands_for(p, 6) for p in (85, 80)] == [46, 71]


@pytest.mark.parametrize("percent", [85, 80])
def test_no_link_at_the_threshold_is_lost(percent):
    """The chance of a miss is under 1e-9: exact binomial for the filter, and 4,000 pairs right at the threshold."""
    bands = minhash.bands_for(percent, 6)
    n = max(384, bands * 6)
    agree = minhash.agree_for(percent, n)
    p = percent / 100 + (1 - percent / 100) / 256
    assert sum(math.comb(n, k) * p ** k * (1 - p) ** (n - k) for k in range(agree)) <= 5e-10
    assert (1 - (percent / 100) ** 6) ** bands <= 5e-10
    rng = np.random.default_rng(percent)
    sets = []
    for k in range(4000):
        size = 20 * (1 + k % 5)  # the union
        x = rng.integers(0, 1 << 63, size, dtype=np.uint64)
        alone = size * (100 - percent) // 100
        sets += [x[alone // 2:], np.concatenate([x[:alone // 2], x[alone:]])]
    sig = minhash.signatures(sets, n)
    equal = ((sig[::2] & 255) == (sig[1::2] & 255)).sum(1)
    assert equal.min() >= agree
    share = (sig[::2] == sig[1::2])[:, :bands * 6].reshape(4000, 6, bands).all(1).any(1)  # a band is every bands-th minimum
    assert share.all()


@pytest.mark.parametrize("sketch", [512, 40])
def test_sketches_decide_by_the_sets(sketch, monkeypatch):
    """Whole sets: always right.  Longer ones: no link is called none, and no other pair a link."""
    monkeypatch.setattr(minhash, "SKETCH", sketch)
    rng = np.random.default_rng(sketch)
    least, most = minhash.agree_for(85, sketch, 0), sketch + 1 - minhash.agree_for(15, sketch, 0)
    for k in range(3000):
        size = int(rng.integers(3, 300))
        x = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2))
        cut = int(rng.integers(0, max(1, len(x) // 3)))
        x = rng.permutation(x)  # what differs lies anywhere in the order of the hashes
        a, b = np.sort(x[: len(x) - cut // 2]), np.unique(np.concatenate([x[cut:], x[:cut // 3]]))
        common = len(np.intersect1d(a, b))
        link = 100 * common >= 85 * (len(a) + len(b) - common)
        found = minhash.compare(*[(s[:sketch] >> np.uint64(32)).astype("<u4") for s in (a, b)], len(a), len(b), 85, least, most)
        assert found > 0 if link else found < 2
        if max(len(a), len(b)) <= sketch:
            assert (found > 0) == link


def test_components(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, 50), (101, 100), (60, 60), (7, 3)]
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {k: 1 for k in range(2, 41)} | {100: 50, 101: 50}


def test_odd_rows(odd_docs, no_docs):
    r = sorted(map(tuple, recompress.dedup(odd_docs).select("doc_id", "n_words", "n_removed").collect()), key=str)
    assert r == sorted([(None, 0, 0), (None, 120, 120), (None, 120, 120), (5, 120, 0), (5, 120, 0), (5, 2, 0), (7, 0, 0), (7, 0, 0)], key=str)
    r = sorted(map(tuple, prefix_free.dedup(odd_docs, 100, 40).select("doc_id", "n_removed").collect()), key=str)
    n = len(" ".join(f"w{k}" for k in range(120)))
    assert r == sorted([(None, 0), (None, n), (None, n), (5, n), (5, n), (5, 0), (7, 0), (7, 0)], key=str)
    r = sorted(map(tuple, winnow.dedup(odd_docs, 1).select("doc_id", "n_lines", "kept_text").collect()), key=str)
    assert [x[:2] for x in r] == sorted([(None, 0), (None, 1), (None, 1), (5, 1), (5, 1), (5, 1), (7, 1), (7, 0)], key=str)
    assert [x[2] for x in r if x[0] is None] == ["", "", ""]
    r = sorted(map(tuple, minhash.near_duplicates(odd_docs).collect()), key=str)
    assert r == sorted([(None, 0, None, True), (None, 116, 5, False), (None, 116, 5, False), (5, 116, 5, True), (5, 116, 5, True), (5, 1, 5, True), (7, 0, 7, True), (7, 0, 7, True)], key=str)
    assert minhash.representatives(odd_docs).count() == 6
    for found in (recompress.dedup(no_docs), prefix_free.dedup(no_docs), winnow.dedup(no_docs), minhash.near_duplicates(no_docs), minhash.representatives(no_docs)):
        assert found.collect() == []
