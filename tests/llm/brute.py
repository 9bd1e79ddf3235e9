"""Plain Python versions of the contracts, for small inputs."""

import hashlib
import re
from collections import Counter

import xxhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def contamination(docs, items, window=13):
    """docs: [(doc_id, text)], items: [(item_id, text)] -> {doc_id: (n_words, n_hit, n_items, sha, contaminated)}"""
    wins = {}
    for item, text in items:
        ws = ALNUM.findall((text or "").translate(LOWER))
        k = min(window, len(ws))
        for i in range(len(ws) - k + 1 if k else 0):
            wins.setdefault(tuple(ws[i:i + k]), set()).add(str(item) if item is not None else "null")
    sizes = {len(w) for w in wins}
    out = []
    for doc, text in docs:
        ws = ALNUM.findall((text or "").translate(LOWER))
        hit, its = set(), set()
        for k in sizes:
            for i in range(len(ws) - k + 1):
                if (t := tuple(ws[i:i + k])) in wins:
                    hit |= set(range(i, i + k))
                    its |= wins[t]
        out.append((doc, len(ws), len(hit), len(its), hashlib.sha256(",".join(sorted(its)).encode()).hexdigest(),
                    len(hit) > 0 and 20 * len(hit) >= len(ws)))
    return out


def simhash(text, k=3):
    ws = WORD.findall((text or "").translate(LOWER))
    sh = [" ".join(ws[i:i + k]) for i in range(len(ws) - k + 1)] or ([" ".join(ws)] if ws else [])
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def groups(nodes, linked):
    """node -> smallest node reachable"""
    nodes = sorted(nodes)
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[i + 1:]:
            if linked(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {n: find(n) for n in nodes}


def quality_base(text):
    text = text or ""
    ws = WORD.findall(text)
    wins = Counter(tuple(ws[i:i + 3]) for i in range(len(ws) - 2))
    rep = {j for i in range(len(ws) - 2) if wins[tuple(ws[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(ws)
    return (n, sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(rep),
            n < 50 or 100 * len(rep) > 50 * n)
