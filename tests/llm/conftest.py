import random

import pytest

#: Columns beside the needed ones whose names the operators use inside.
EXTRA = "id long, h long, score double, n long, row string, size long, copies int"


def prose(rng: random.Random, n: int, words: int = 400) -> list[str]:
    return [rng.choice(["ba", "du", "ki", "ro", "é", "zu"]) * rng.randint(1, 2) + str(rng.randint(0, words)) for _ in range(n)]


def corpus(seed: int = 1) -> list[tuple[int, str | None]]:
    """Texts with exact and near copies, shared passages, runs, periodic and long texts, null and empty ones."""
    rng = random.Random(seed)
    base = [prose(rng, rng.randint(1, 160)) for _ in range(25)]
    passage = prose(rng, 70)
    out: list[list[str]] = list(base)
    for k in range(12):  # near copies: a few words changed
        w = list(base[k])
        for _ in range(rng.randint(1, 4)):
            w[rng.randrange(len(w))] = "edit"
        out.append(w)
    out += [list(base[3]), list(base[3]), list(base[4])]  # exact copies
    for k in range(6):  # a passage inside different texts
        out.append(base[k][:20] + passage + base[k + 1][:15])
    out += [["run"] * 90, ["x"] + ["run"] * 70, ["a", "b"] * 60, ["q", "a", "b"] + ["a", "b"] * 40, prose(rng, 3000)]
    docs = [(k * 3 + 1, " ".join(w)) for k, w in enumerate(out)]
    docs += [(1000, None), (1001, ""), (1002, " \t\n "), (1003, "one"), (1004, "One"), (1005, "one")]
    lines = ["alpha beta", "gamma", "", "delta one", "eps", "zeta 9"]
    docs += [(2000, "\n".join(lines)), (2001, "head\n" + "\n".join(lines)), (2002, "\n".join(lines[:3])), (2003, "gamma\ngamma\ngamma\ngamma\ngamma")]
    rng.shuffle(docs)
    return docs


@pytest.fixture(scope="session")
def docs_rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, docs_rows):
    """documents with clashing extra columns, all null."""
    rows = [(i, t, "en", f"s{i % 3}", None, None, None, None, None, None, None) for i, t in docs_rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + EXTRA).repartition(3).cache()


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, and repeated rows."""
    long = " ".join(f"w{k}" for k in range(120))
    rows = [(None, None, None), (None, long, "a"), (None, long, "a"), (5, long, None), (5, long, None), (5, "other text", "b"), (7, "", ""), (7, None, "b")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string")


def by_id(df, columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}
