"""Plain versions of the operators, by brute force."""

import hashlib
import re
from collections import Counter

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def folded(text):
    return re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def contamination(docs, items, window=10):
    windows = {}
    for item, text in items:
        w = folded(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1) if n else ():
            windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    sizes, out = {len(k) for k in windows}, []
    for doc, text in docs:
        w, hit, found = folded(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if items_here := windows.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    found |= {str(x) for x in items_here if x is not None}
        out.append((doc, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return out


def repeats(docs, length=13):
    split = [(i, (t or "").encode().split()) for i, t in docs]
    first = {}
    for i, w in sorted(split, key=lambda x: x[0]):
        for k in range(len(w) - length + 1):
            first.setdefault(tuple(w[k : k + length]), i)
    out = []
    for i, w in split:
        gone = [False] * len(w)
        for k in range(len(w) - length + 1):
            if first[tuple(w[k : k + length])] < i:
                gone[k : k + length] = [True] * length
        out.append((i, len(w), sum(gone), sha(b" ".join(x for x, g in zip(w, gone) if not g))))
    return out


def shingles(text, n=5):
    w = folded(text)
    if len(w) < n:
        return Counter([tuple(w)]) if w else Counter()
    return Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))


def classes(docs, threshold=0.8):
    sets = {i: shingles(t) for i, t in docs}
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    holders = {}
    for i in sorted(sets):
        seen = Counter()
        for k, n in sets[i].items():
            for j in holders.get(k, ()):
                seen[j] += min(n, sets[j][k])
            holders.setdefault(k, []).append(i)
        for j, both in seen.items():
            if both / (sum(sets[i].values()) + sum(sets[j].values()) - both) >= threshold:
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    return {i: top(i) for i in sets}


def given(spark, folder, name, *columns):
    return [tuple(r) for r in spark.read.parquet(f"{folder}/{name}.parquet").select(*columns).collect()]
