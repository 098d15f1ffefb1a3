"""Plain versions of the operators for small inputs."""

import hashlib
import re
from collections import defaultdict

import xxhash

SPACE = r"[\x20\x09-\x0D]"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def exact(rows):
    groups = defaultdict(list)
    for doc, text in rows:
        groups[re.sub(SPACE, "", text or "")].append((-len(text or ""), doc))
    out = set()
    for text, members in groups.items():
        keep = min(members)[1]
        out |= {(doc, keep, len(members), doc == keep, sha(text)) for _, doc in members}
    return out


def lines(rows):
    def key(line):
        return re.sub(rf"^{SPACE}+|{SPACE}+$", "", line).translate({c: c + 32 for c in range(65, 91)})

    first = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            k = key(line)
            if len(k) >= 10:
                first[k] = min(doc, first.get(k, doc))
    out = {}
    for doc, text in rows:
        own = (text or "").split("\n")
        kept = [x for x in own if first.get(key(x), doc) == doc]
        out[doc] = (len(own), len(own) - len(kept), "\n".join(kept))
    return out


def substrings(rows, span=20):
    seen, out = set(), {}
    for doc, text in sorted(rows, key=lambda r: r[0]):
        ws = words(text)
        gone = [False] * len(ws)
        for i in range(len(ws) - span + 1):
            w = tuple(ws[i:i + span])
            if w in seen:
                gone[i:i + span] = [True] * span
            seen.add(w)
        out[doc] = (len(ws), sum(gone), " ".join(w for w, g in zip(ws, gone) if not g))
    return out


def simhash(text):
    ws = [w.translate({c: c + 32 for c in range(65, 91)}) for w in words(text)]
    if not ws:
        return 0
    grams = [" ".join(ws[i:i + 4]) for i in range(len(ws) - 3)] or [" ".join(ws)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near(rows, prints=None):
    prints = prints or {doc: simhash(text) for doc, text in rows}
    root = {d: d for d in prints}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    ids = sorted(prints)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (prints[d], find(d)) for d in ids}
