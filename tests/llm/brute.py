"""Plain definitions of the operators' results, by brute force over small tables."""

import hashlib
import re
from collections import Counter, defaultdict

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ITEM_WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(x) -> str:
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def earlier_windows(docs, size):
    first, words = {}, {}
    for i, t in sorted(docs):
        words[i] = w = WORD.findall(t or "")
        for k in range(len(w) - size + 1):
            first.setdefault(tuple(w[k:k + size]), i)
    out = {}
    for i, w in words.items():
        dead = [False] * len(w)
        for k in range(len(w) - size + 1):
            if first[tuple(w[k:k + size])] < i:
                dead[k:k + size] = [True] * size
        out[i] = (len(w), sum(dead), sha(" ".join(x for x, d in zip(w, dead, strict=True) if not d)))
    return out


def repeated_bytes(docs, size):
    texts = [(i, (t or "").encode()) for i, t in docs]
    seen = Counter(x[k:k + size] for _, x in texts for k in range(len(x) - size + 1))
    out = {}
    for i, x in texts:
        dead = [False] * len(x)
        for k in range(len(x) - size + 1):
            if seen[x[k:k + size]] > 1:
                dead[k:k + size] = [True] * size
        spans = sum(d and (k == 0 or not dead[k - 1]) for k, d in enumerate(dead))
        out[i] = (len(x), sum(dead), spans, sha(bytes(y for y, d in zip(x, dead, strict=True) if not d)))
    return out


def components(docs, k=5, percent=85):
    sets = {}
    for i, t in docs:
        w = WORD.findall((t or "").translate(LOWER))
        sets[i] = {tuple(w[j:j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def benchmark_hits(docs, items, size):
    windows = defaultdict(set)
    for i, t in items:
        w = ITEM_WORD.findall((t or "").translate(LOWER))
        for k in range(max(1, len(w) - size + 1) if w else 0):
            windows[tuple(w[k:k + size])].add(i)
    out = {}
    for i, t in docs:
        w = ITEM_WORD.findall((t or "").translate(LOWER))
        hit, found = [False] * len(w), set()
        for x, of in windows.items():
            for k in range(len(w) - len(x) + 1):
                if tuple(w[k:k + len(x)]) == x:
                    hit[k:k + len(x)] = [True] * len(x)
                    found |= of
        names = sorted(map(str, found))
        out[i] = (len(w), sum(hit), len(names), sha(",".join(names)), any(hit))
    return out


def later_lines(docs, run, long=50):
    """Runs of ``run`` counted lines, long lines and whole texts of fewer lines."""
    first = {}
    lines = {i: (t.split("\n") if t is not None else []) for i, t in docs}
    spans = {}
    for i in sorted(lines):
        at = [k for k, x in enumerate(lines[i]) if WORD.search(x)]
        spans[i] = [(k, at[k:k + run]) for k in range(len(at) - run + 1)] or ([(0, at)] if at else [])
        spans[i] += [(k, [j]) for k, j in enumerate(at) if len(WORD.findall(lines[i][j])) >= long]
        for k, js in spans[i]:
            content = tuple(lines[i][j] for j in js)
            first[content] = min(first.get(content, (i, k)), (i, k))
    out = {}
    for i, ls in lines.items():
        gone = {j for k, js in spans[i] if first[tuple(ls[j] for j in js)] < (i, k) for j in js}
        out[i] = (len(ls), len(gone), sha("\n".join(x for k, x in enumerate(ls) if k not in gone)))
    return out
