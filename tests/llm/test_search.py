"""Presence-mask search and the prefix trie against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import mask_search, prefix_trie

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def ranked(docs, bench):
    have = [(doc, Counter(terms(t))) for doc, t in docs]
    have = [(doc, c, c.total()) for doc, c in have if c]
    N, L = len(have), sum(n for _, _, n in have)
    df = Counter(t for _, c, _ in have for t in c)
    asked = defaultdict(set)
    for item, text in bench:
        asked[item] |= set(terms(text))
    out = set()
    for item, own in asked.items():
        rows = []
        for doc, c, n in have:
            m = 100 - 90 + (90 * n * N) // L
            score = sum(math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in own if t in c)
            if score > 0:
                rows.append((-score, doc is None, doc or 0))
        out |= {(item, k + 1, None if null else doc, -s) for k, (s, null, doc) in enumerate(sorted(rows)[:10])}
    return out


def made_texts(rng, n, words=400):
    word = [f"{a}{b}" for a in "abé9" for b in range(words // 4)]
    weight = [1 / (k + 1) for k in range(words)]
    rng.shuffle(word)
    return [" ,._\n".join(rng.choices(word, weight, k=rng.choice([0, 1, 3, 30, 200]))) for _ in range(n)]


def asked_of(spark, docs, bench, **kw):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"score": F.lit(1), "terms": F.lit("x"), "item_id": F.lit(0)})
    b = spark.createDataFrame(bench, "item_id long, text string").withColumns({"doc_id": F.lit(1), "rank": F.lit(2)})
    return {tuple(r) for r in mask_search.search(d.repartition(3), b, **kw).collect()}


def test_search_equals_plain(spark):
    rng = random.Random(5)
    texts = made_texts(rng, 500)
    docs = list(enumerate(texts)) + [(7, texts[7]), (None, texts[11]), (900, None), (901, ""), (902, "--- ?"), (903, texts[20].upper())]
    bench = [(k, t) for k, t in enumerate(made_texts(rng, 40))] + [(3, "b1 b2"), (None, texts[11]), (50, None), (51, "!")]
    want = ranked(docs, bench)
    assert asked_of(spark, docs, bench) == want
    assert asked_of(spark, docs, bench, pass_terms=60) == want  # several passes


def test_search_of_empty_tables(spark):
    assert asked_of(spark, [], [(1, "a")]) == set()
    assert asked_of(spark, [(1, "a b")], []) == set()
    assert asked_of(spark, [(1, None)], [(1, "a")]) == set()


def test_search_of_long_text_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(mask_search, "PIECE", 64)
    text = " ".join(made_texts(random.Random(1), 30)) + "q" * 300 + " Z"
    assert [t.decode() for p in mask_search.terms(text.encode()) for t in p] == terms(text)


def test_five_megabytes_of_terms(spark):
    docs = [(1, "a b " * 1_300_000), (2, "a c"), (3, "c")]
    assert asked_of(spark, docs, [(1, "a c"), (2, "b")]) == ranked(docs, [(1, "a c"), (2, "b")])


def blocks_of(rng, docs, V, T):
    items = mask_search.Items([0], [np.arange(T)], {str(t).encode(): t for t in range(V)}, np.array([rng.randrange(1, 9000) for _ in range(V)], np.int64))
    n = np.array([rng.randrange(50, 90) for _ in range(docs)], np.int64)
    own = [np.flatnonzero(np.array([rng.random() < 3 / (t + 3) for t in range(V)])) for _ in range(docs)]
    own = [o if len(o) else np.array([0]) for o in own]
    return items, n, np.array([len(o) for o in own]), np.concatenate(own), np.array([rng.randrange(1, 5) for o in own for _ in o], np.int64)


def test_masks_are_left_unopened_and_the_best_found():
    rng = random.Random(2)
    items, n, sizes, term, count = blocks_of(rng, 3000, 80, 70)  # masks of more than 64 bits
    one = mask_search.Search(items, 3000, int(n.sum()))
    cuts, ends = [0, 1000, 1003, 3000], np.cumsum(sizes)
    for a, z in zip(cuts, cuts[1:]):
        lo, hi = (ends[a - 1] if a else 0), ends[z - 1]
        one.block(np.arange(a, z), n[a:z], sizes[a:z], term[lo:hi], count[lo:hi])
    m = np.repeat(one.lengths(n), sizes)
    value = np.where(term < 70, items.weights[term] * (10**9 * count // (1000 * count + 8 * m)), 0)
    want = np.bincount(np.repeat(np.arange(3000), sizes), value).astype(np.int64)
    order = np.lexsort((np.arange(3000), -want))[:10]
    assert one.best[0][1].tolist() == order.tolist() and one.best[0][0].tolist() == want[order].tolist()
    assert one.groups > 500 and one.opened < one.groups / 4


def plain_trie(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]
            turns[conv].append(((turn is not None, turn or 0, role, digest), (role, text)))
    own = {c: [x for _, x in sorted(t)] for c, t in turns.items()}
    paths = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        paths[c] = tuple(own.get(c - int(math.fmod(c, 5)), [])[:h] + mine[h:])
    members = defaultdict(list)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = sum(saved[k] for k in kids[p]) + ((len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0)
    ends = defaultdict(list)
    for c, p in paths.items():
        ends[p].append(c)
    sha = {p: hashlib.sha256(",".join(map(str, sorted(e))).encode()).hexdigest() for p, e in ends.items()}
    return sorted(((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p], sha.get(p, prefix_trie.NO_IDS))
                   for p, m in members.items()), key=str)


def made_conversations(rng, convs, said=3):
    out = []
    for c in range(-6, convs):
        if rng.random() < 0.1:
            continue
        for turn in range(rng.choice([1, 2, 2, 5, 12])):
            out.append((c, turn, rng.choice(["user", "user", None]), rng.choice([None, "", *("tä" * k for k in range(1, said))])))
    return out + [(3, None, "user", "first"), (3, 0, "user", "tie"), (3, 0, "user", "tie"), (None, 1, "user", "of nobody")]


@pytest.mark.parametrize("range_turns, range_ids", [(50_000, 65_536), (40, 7), (1, 1)])
def test_trie_equals_plain(spark, range_turns, range_ids):
    rows = made_conversations(random.Random(3), 120)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"depth": F.lit(1), "path": F.lit("x"), "part": F.lit(0), "key": F.lit(0)})
    got = prefix_trie.trie(df, range_turns, range_ids)
    assert sorted((tuple(r) for r in got.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=str) == plain_trie(rows)


def test_trie_of_one_common_conversation(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(300) for t in range(6)] + [(1000, t, "user", f"turn {t}") for t in range(3000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert sorted((tuple(r) for r in prefix_trie.trie(df, 500, 16).collect()), key=str) == plain_trie(rows)


def test_trie_of_nothing_and_of_long_texts(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie.trie(df).collect() == []
    rows = [(0, 0, "user", "x" * 5_000_000), (1, 0, "user", "x" * 5_000_000), (2, 0, "user", "x" * 4_999_999 + "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert sorted((tuple(r) for r in prefix_trie.trie(df).collect()), key=str) == plain_trie(rows)


def test_range_minimum():
    values = np.random.default_rng(1).integers(0, 9, 133)
    table = prefix_trie.Minima(values)
    lo = np.arange(133).repeat(133)
    hi = np.tile(np.arange(133), 133)
    lo, hi = lo[lo <= hi], hi[lo <= hi]
    assert table.least(lo, hi).tolist() == [values[a:b + 1].min() for a, b in zip(lo, hi)]
    assert table.reach(np.array([5]), np.array([10]), 1).tolist() == [0]
    assert table.reach(np.array([5]), np.array([-1]), -1).tolist() == [6]
