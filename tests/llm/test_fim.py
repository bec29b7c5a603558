"""Fill-in-middle: cuts against a pattern over code points, exact round trips."""

import hashlib
import random
import re

import numpy as np

from migscope.llm import fim
from tests.llm.conftest import by_id

UNIT = re.compile(r"[^\n]*\n|[^\n]+")


def brute(i, text, rate=100, spm=50, seed=7):
    text = text or ""
    units = UNIT.findall(text)
    hexes = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h = [int(hexes[k:k + 8], 16) for k in range(0, 32, 8)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    if h[3] % 100 < spm:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


ATOMS = ["a", "é", "中", "🙂", "\n", "\n", "\n\n", "<P", ">", "<", "S>", "<M>", "long line of words ", "\r\n", "\x8a", "ਊ", "\x0b", "\0"]


def odd_texts(n, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choices(ATOMS, k=rng.randint(0, 40))) for _ in range(n)]


def test_selects_and_points():
    texts = odd_texts(500) + ["", "\n", "x", "x\n", "\n" * 100, "no feed at all"]
    raw = [t.encode() for t in texts]
    lines = fim.Lines(raw)
    units = [UNIT.findall(t) for t in texts]
    assert lines.n.tolist() == [len(u) for u in units]
    for step in range(int(lines.n.max()) + 1):
        k = np.minimum(step, lines.n)
        ends = lines.end(k)
        assert ends.tolist() == [len("".join(u[:j]).encode()) for u, j in zip(units, k.tolist(), strict=True)]
        assert lines.points(ends).tolist() == [len("".join(u[:j])) for u, j in zip(units, k.tolist(), strict=True)]


def test_transform(spark, docs, docs_rows):
    rows = docs_rows + [(5000 + k, t) for k, t in enumerate(odd_texts(300))]
    more = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string")
    want = {i: brute(i, t) for i, t in rows}
    assert by_id(fim.transform(more), ["n", "form", "prefix_chars", "middle_chars", "output"]) == want
    assert {f for _, f, *_ in want.values()} == {"plain", "spm", "psm"}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert by_id(fim.digest(more), ["output_sha256", "restored_sha256"]) == {i: (sha(want[i][4]), sha(t or "")) for i, t in rows}
    got = by_id(fim.transform(docs, rate=40, spm=90, seed=11), ["n", "form", "prefix_chars", "middle_chars", "output"])
    assert got == {i: brute(i, t, 40, 90, 11) for i, t in docs_rows}


def test_odd_rows(odd_docs, no_docs):
    rows = [tuple(r) for r in odd_docs.select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in fim.transform(odd_docs).collect()), key=str)
    assert got == sorted(((i, *brute(i, t)) for i, t in rows), key=str)
    assert fim.digest(no_docs).collect() == []


def test_a_very_long_text(spark):
    text = ("a line of some words\n" * 200_000) + "end"
    got = fim.digest(spark.createDataFrame([(2, text)], "doc_id long, text string")).collect()[0]
    n, form, p, m, output = brute(2, text)
    assert tuple(got) == (2, n, form, p, m, hashlib.sha256(output.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
