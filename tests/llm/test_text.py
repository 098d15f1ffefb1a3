import base64
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import bpe, lang_id, main_text, packing, phrases, pretokens, toxicity
from tidemark.llm.entries import QUERIES, STATEMENTS
from tidemark.llm.queries_text import vocabulary

P = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (3, " \n\t  x"), (4, "don't we'll 'tis it''s 12ab<|endoftext|>"), (5, "a" * 3000), (6, "日本語🙂 ſté  "), (7, " "), (8, "\x1c\x85　 a")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


def made(spark, rows):
    return spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, score long, ids string")


def library():
    import tiktoken

    with open(vocabulary(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


# ---- BPE

def test_bpe_round_trip_equals_the_library(spark, rows):
    lib, rows = library(), ODD + [(1000 + d, t) for d, t in rows]
    got = {r["doc_id"]: tuple(r)[1:] for r in bpe.round_trip(made(spark, rows), vocabulary()).collect()}
    for doc, text in rows:
        ids = lib.encode_ordinary(text or "")
        assert got[doc] == (len(ids), sha(" ".join(map(str, ids))), sha(text or ""))
    ids = {r["doc_id"]: r["ids"] for r in bpe.encode(made(spark, ODD), vocabulary()).collect()}
    assert ids == {d: lib.encode_ordinary(t or "") for d, t in ODD}
    assert bpe.round_trip(made(spark, []), vocabulary()).collect() == []


def test_queue_alone_and_together_equal_the_library():
    lib, own, rng = library(), bpe.Bpe.load(vocabulary()), random.Random(1)
    words = ["".join(rng.choice("abcdenthion") for _ in range(rng.randrange(1, 90))).encode() for _ in range(300)]
    words += [b"a" * k for k in range(1, 60)] + [bytes(rng.randrange(256) for _ in range(20)) for _ in range(50)]
    want = [lib._core_bpe.encode_single_piece(w) for w in words]
    assert own.encode_batch(words) == want
    assert [own.encode_long(w) for w in words] == want
    long = b"thionbcd" * 4000
    assert own.encode_long(long) == lib._core_bpe.encode_single_piece(long)


def test_rank_queue_finds_the_lowest():
    q, rng, held = bpe.RankQueue(50_000), random.Random(2), set()
    for _ in range(3000):
        r = rng.randrange(50_000)
        q.push(r, 0)
        held.add(r)
        if rng.random() < 0.4:
            low = q.first()
            assert low == min(held)
            held.remove(low)
            q.clear(low)
            q.buckets.pop(low)
    assert bpe.RankQueue(5).first() == -1


def test_pretokens_equal_the_pattern(monkeypatch):
    import regex

    rng = random.Random(3)
    letters = list("ab'sté \n\t  \x1c\x85　.,19xyz日🙂'revmd'll") + [" "] * 6
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(4000)]
    want = [regex.findall(P.PATTERN.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"), t) for t in texts]

    def read(part):
        cuts = np.cumsum(part.counts)
        return [[part.distinct[i] for i in x] for x in np.split(part.index, cuts[:-1])]

    assert read(pretokens.split(texts)) == want
    whole = np.unique
    monkeypatch.setattr(np, "unique", lambda x, **kw: whole(x & np.uint64(3) if x.dtype == np.uint64 else x, **kw))
    assert read(pretokens.split(texts)) == want  # all names collide


# ---- packing

def test_packing_covers_every_id_once(spark, rows):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    lib.encode_special_tokens = True
    rows = ODD + [(100 + d, t) for d, t in rows] + [(9000 + i, "same words here") for i in range(500)]
    got = packing.pack(made(spark, rows), vocabulary()).collect()
    ids = {d: lib.encode(t or "", add_special_tokens=False).ids + [1] for d, t in rows}
    own = defaultdict(list)
    sequences = defaultdict(list)
    for r in got:
        part = ids[r["doc_id"]][r["start"]:r["start"] + r["length"]]
        assert len(part) == r["length"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"]
        own[r["doc_id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for d, parts in own.items():
        at = 0
        for start, n in sorted(parts):
            assert start == at
            at += n
        assert at == len(ids[d])
    assert len(own) == len(rows)
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert 0 < at <= 2048
    assert sorted(sequences) == list(range(len(sequences)))
    used = sum(map(len, ids.values()))
    assert len(sequences) <= 1.02 * used / 2048 + 2
    assert packing.pack(made(spark, []), vocabulary()).collect() == []


def test_packing_query_equals_the_library_as_it_comes(spark, tmp_path):
    from tokenizers import Tokenizer

    lib, end = Tokenizer.from_file(P.path("byte_bpe_50k.json")), "<|endoftext|>"
    rows = ODD + [(20, f"a {end} b"), (21, end), (22, end + end), (23, f"{end} x  {end}  "), (24, f"<|endoftext{end}|>"), (25, f"word {end}" * 900), (26, "plain text")]
    made(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op8_packing"](spark, str(tmp_path)).collect()
    ids = {d: lib.encode(t or "", add_special_tokens=False).ids + [1] for d, t in rows}
    assert ids[20] == [64, 220, 50256, 275, 1]
    assert {(r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got} == {
        (d, a, len(x[a:a + 2048]), zlib.crc32(np.array(x[a:a + 2048], "<u4").tobytes()), len(x)) for d, x in ids.items() for a in range(0, len(x), 2048)}


@pytest.mark.parametrize("histogram", [{500: 1000}, {2048: 3, 1: 5}, {1500: 10, 600: 10}, {i: i % 7 for i in range(1, 2049) if i % 7}, {}])
def test_shortest_pack_first_places_all(histogram):
    patterns = packing.shortest_pack_first(histogram)
    held = Counter()
    for n, pack in patterns:
        assert n > 0 and sum(pack) <= 2048
        for x in pack:
            held[x] += n
    assert held == Counter(histogram)


# ---- fingerprints

def test_phrases_of_equal_substrings_agree():
    rng = random.Random(4)
    text = "".join(rng.choice("abcdefgh ") for _ in range(4000))
    top, bins = phrases.sketches([text, "xyz" + text, text + "tail", text[:2000], "other " * 300, "", "", "a", text])
    near = phrases.likeness(bins[:1].repeat(len(bins), 0), bins)
    assert near[1] > 0.9 and near[2] > 0.9 and 0.3 < near[3] < 0.7 and near[4] < 0.1 and near[8] == 1
    assert top[0] == top[8] and len(set(top.tolist())) == len(top) - 2
    assert phrases.likeness(bins[5:6], bins[6:7])[0] == 1
    assert (phrases.read(phrases.written(top, bins)) == bins).all()


def test_labels_depend_on_few_neighbours_and_differ():
    rng = np.random.default_rng(5)
    names = rng.integers(0, 2**63, 5000).astype(np.uint64)
    a = phrases.labels(names, np.array([0]))
    b = phrases.labels(names[1000:], np.array([0]))
    assert a.max() < 6 and (a[1:] != a[:-1]).all() and (a[1010:] == b[10:]).all()
    out, starts = phrases.phrases(names, np.array([0, 17]))
    assert len(out) < 0.6 * len(names) and starts[0] == 0


def test_phrases_of_a_text_do_not_depend_on_its_company(rows):
    texts = [t for _, t in rows] + ["", "a", "aa", "a" * 5000, "ab" * 900]
    top, bins = phrases.sketches(texts)
    for i in (0, 7, len(texts) - 5, len(texts) - 4, len(texts) - 3, len(texts) - 2, len(texts) - 1):
        one, own = phrases.sketches([texts[i]])
        assert one[0] == top[i] and (own[0] == bins[i]).all()


@pytest.mark.parametrize("range_rows", [5, 10_000])
def test_next_documents(spark, rows, range_rows):
    rows = sorted(ODD + [(100 + 7 * d, t) for d, t in rows] + [(None, "first of all")], key=lambda r: (r[0] is not None, r[0] or 0))
    got = {r["doc_id"]: r for r in phrases.with_next(made(spark, rows), range_rows).collect()}
    texts = [t or "" for _, t in rows]
    top, bins = phrases.sketches(texts)
    prints = phrases.written(top, bins)
    for i, (doc, _) in enumerate(rows):
        text, after = texts[i], texts[(i + 1) % len(texts)]
        k = len(text) // 4
        changed = text[:len(text) - k] + after[:k]
        r = got[doc]
        assert (r["n_chars"], r["edited_sha256"], r["fingerprint"]) == (len(text), sha(changed), prints[i])
        t, b = phrases.sketches([changed])
        assert r["edited_fingerprint"] == phrases.written(t, b)[0]
        assert r["near_edited"] == phrases.likeness(bins[i:i + 1], b)[0]
        j = (i + 1) % len(texts)
        assert r["near_next"] == phrases.likeness(bins[i:i + 1], bins[j:j + 1])[0]
    assert len(got) == len(rows)


def test_next_of_few_rows(spark):
    assert phrases.with_next(made(spark, [])).collect() == []
    one = phrases.with_next(made(spark, [(3, "abcdefgh")])).collect()
    assert len(one) == 1 and one[0]["edited_sha256"] == sha("abcdefab") and one[0]["near_next"] == 1
    assert len(phrases.with_next(made(spark, [(3, "x"), (3, "x"), (3, "y"), (None, "x"), (None, None)])).collect()) == 5


def test_fingerprints_alone(spark):
    got = {r["doc_id"]: r["fingerprint"] for r in phrases.fingerprints(made(spark, ODD)).collect()}
    assert got[1] == got[2] and len(set(got.values())) == len(ODD) - 1


# ---- language

def test_language_of_held_out_documents(spark):
    out = QUERIES["op7_language_id"](spark, "/root/testdata/sf0.01").join(
        spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id")
    got = out.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("a"), F.min("score").alias("s")).first()
    assert got["a"] > 0.98 and 0 <= got["s"] <= 1
    assert out.count() == 1000


def test_language_of_odd_texts(spark, docs):
    model = lang_id.fit(docs.select("text", "lang"))
    df = spark.createDataFrame([(1, None, "k"), (2, "", "k"), (3, "12 -- 3", "k"), (4, "q", "k"), (5, "the of", None), (6, "ξψφ ωδλ " * 60, "k")], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in lang_id.identify(df, model).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and all(got[i]["rejected"] and got[i]["score"] == 0 for i in (1, 2, 3))
    assert got[4]["lang_pred"] in model.langs and got[5]["lang_pred"] == "en" and not got[5]["rejected"] and got[6]["rejected"]
    assert lang_id.identify(df.limit(0), model).collect() == []
    none = lang_id.fit(docs.select("text", "lang").limit(0))
    assert {r["lang_pred"] for r in lang_id.identify(df, none).collect()} == {"und"}


def test_kneser_ney_equals_the_formula_and_sums_to_one():
    rng = random.Random(6)
    texts = ["".join(rng.choice("aab c") for _ in range(60)) for _ in range(6)]
    order = 3
    grams = Counter()
    for t in texts:
        s = " " + " ".join(t.split()) + " " if t.strip() else " "
        grams.update(s[i:i + order] for i in range(len(s) - order + 1))
    model = lang_id.smoothed(["x"], [dict(grams)], order)

    def p(gram):
        hashes = lang_id.gram_hashes(np.array([0 if c == " " else ord(c) for c in gram], np.uint32), len(gram))
        at, seen = model.find(len(gram), hashes)
        if seen[0]:
            return float(np.exp(model.logs[len(gram) - 1][at[0], 0]))
        sym = np.array([0 if c == " " else ord(c) for c in gram], np.uint32)
        return float(np.exp(model.log_probs(sym, np.array([order - 1]))[0, 0])) if len(gram) == order else 0

    for context in {g[:-1] for g in grams}:
        assert abs(sum(p(context + c) for c in "abc ") - 1) < 0.01  # the rest is for unseen symbols
    tables = [dict(grams)]
    for _ in range(order - 1):
        lower = Counter()
        for g in tables[-1]:
            lower[g[1:]] += 1
        tables.append(dict(lower))

    def formula(gram):
        table = tables[order - len(gram)]
        ones, twos = (sum(1 for c in table.values() if c == k) for k in (1, 2))
        cut = min(0.9, max(0.1, ones / (ones + 2 * twos))) if ones else 0.5
        less = formula(gram[1:]) if len(gram) > 1 else 1 / lang_id.SYMBOLS
        after = [c for g, c in table.items() if g[:-1] == gram[:-1]]
        return (max(table.get(gram, 0) - cut, 0) + cut * len(after) * less) / sum(after) if after else less

    for gram in list(grams) + ["aba", "ccc", "bcb"]:
        assert abs(p(gram) - formula(gram)) < 1e-6


def test_grams_beyond_the_arrays_count_as_those_in_them(spark, docs):
    train = docs.select("text", "lang").union(docs.filter("lang = 'es'").limit(1).selectExpr("text", "'rare' AS lang")).filter("lang <> 'es'")
    whole, tables = lang_id.fit(train), lang_id.fit(train, most=100)
    assert tables.tables and not whole.tables and tables.langs == whole.langs and "rare" in tables.langs
    assert np.allclose(whole.floor, tables.floor) and np.allclose(whole.usual, tables.usual, rtol=1e-4) and whole.sharp == tables.sharp
    assert [t.count() for t in tables.tables] == [len(k) for k in whole.keys]
    asked = docs.select("doc_id", "text").union(spark.createDataFrame([(-1, None), (-2, ""), (-3, "12 -- 3"), (-4, "q"), (-5, "the of"), (-6, "ξψφ ωδλ " * 60), (-7, "ñ 日 x")], "doc_id long, text string"))
    a, b = ({r["doc_id"]: r for r in lang_id.identify(asked, m).collect()} for m in (whole, tables))
    assert a.keys() == b.keys()
    for d, r in a.items():
        assert (r["lang_pred"], r["rejected"]) == (b[d]["lang_pred"], b[d]["rejected"]) and abs(r["score"] - b[d]["score"]) < 1e-4


# ---- toxicity

def test_nearest_equals_all_cosines():
    rng = np.random.default_rng(7)
    vectors = []
    for _ in range(400):
        g = np.sort(rng.choice(60, rng.integers(0, 9), replace=False))
        w = rng.random(len(g)) + 0.01
        vectors.append((g, w / np.sqrt((w * w).sum()) if len(g) else w))
    index = toxicity.Index.of(vectors, 60, 16)
    dense = np.zeros((400, 60))
    for i, (g, w) in enumerate(vectors):
        dense[i, g] = w
    for g, w in vectors[:150]:
        docs, cos = index.nearest(g, w, 10)
        q = np.zeros(60)
        q[g] = w
        all_ = np.round(dense @ q, 12)
        want = sorted((i for i in range(400) if all_[i] > 0), key=lambda i: (-all_[i], i))[:10]
        assert np.allclose(cos, all_[want]) and len(cos) == len(want)
        assert sorted(np.round(cos, 9)) == sorted(np.round(all_[docs], 9))


def test_toxicity_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    out = QUERIES["op3_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out")
    r = out.agg(F.avg((F.col("toxic") == F.col("predicted")).cast("int")).alias("accuracy"), F.sum(F.col("predicted") * F.col("toxic")).alias("hits"),
                F.sum("predicted").alias("called"), F.sum("toxic").alias("all"), F.min("score").alias("low"), F.max("score").alias("high")).first()
    assert r["accuracy"] > 0.95 and r["hits"] / r["called"] > 0.8 and r["hits"] / r["all"] > 0.8 and 0 <= r["low"] <= r["high"] <= 1


def test_toxicity_of_odd_texts(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("aeiourst") for _ in range(5)) for _ in range(50)]
    rows = [(i, " ".join(rng.choices(words, k=20)) + (" nastyword filthy" if i % 5 == 0 else "")) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i, _ in rows] + [(3, 0), (None, 1), (4, None), (777, 1)], "doc_id long, toxic int")
    model = toxicity.fit(made(spark, rows), labels)
    got = {r["doc_id"]: r for r in toxicity.score(made(spark, [(1, None), (2, ""), (3, "12"), (4, "so nastyword filthy it is"), (5, words[0])]), model).collect()}
    assert got[4]["score"] > 0.7 and got[4]["evidence"] and all(e["toxic"] == 1 for e in got[4]["evidence"])
    assert all(got[i]["score"] < 0.3 and got[i]["evidence"] == [] for i in (1, 2, 3))
    assert toxicity.fit(made(spark, rows), labels.filter("toxic = 0")) is None
    assert [r["score"] for r in toxicity.score(made(spark, [(1, "x")]), None).collect()] == [0.0]


def test_toxicity_knows_every_gram_of_the_examples(spark):
    rng = random.Random(9)

    def words(alphabet, n):
        return " ".join("".join(rng.choice(alphabet) for _ in range(6)) for _ in range(n))

    rows = [(i, words("aeiourst", 20) + (" nastyword filthy" if i % 5 == 0 else "")) for i in range(300)]
    rows += [(300, words("bdgklmnp", 30)), (301, words("cfhjvwxz", 30))]  # words no other example has
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i, _ in rows], "doc_id long, toxic int")
    model = toxicity.fit(made(spark, rows), labels)
    every = {h for _, t in rows for h in toxicity.occurrences([t])[1].tolist()}
    assert set(model.grams.tolist()) == every and (model.weights > 0).all()
    near = [(1, rows[300][1][:-14] + " aeiou"), (2, rows[301][1][14:])]
    got = {r["doc_id"]: r["evidence"][0] for r in toxicity.score(made(spark, near), model).collect()}
    assert [(got[i]["doc_id"], got[i]["toxic"]) for i in (1, 2)] == [(300, 1), (301, 0)] and got[1]["cosine"] > 0.8 and got[2]["cosine"] > 0.8


def test_nearest_of_rare_and_common_grams():
    rng = np.random.default_rng(11)
    vectors = []
    for _ in range(500):
        g = np.unique(np.r_[rng.choice(20, 6, replace=False), 20 + rng.choice(2000, 15, replace=False)])
        w = rng.random(len(g)) + 0.01
        vectors.append((g, w / np.sqrt((w * w).sum())))
    index = toxicity.Index.of(vectors, 2020, 32)
    dense = np.zeros((500, 2020))
    for i, (g, w) in enumerate(vectors):
        dense[i, g] = w
    for i in range(100):
        docs, cos = index.nearest(*vectors[i], 10)
        all_ = np.round(dense @ dense[i], 12)
        assert docs.tolist() == sorted(range(500), key=lambda j: (-all_[j], j))[:10] and np.allclose(cos, all_[docs])


def test_blocks_are_skipped_and_the_nearest_found(spark, monkeypatch):
    """Over the given documents: nearest examples equal all cosines, in either space, for the whole and for a half; most blocks stay closed."""
    monkeypatch.setattr(toxicity, "TOLD_BLOCK", 8)
    monkeypatch.setattr(toxicity, "EVERY_BLOCK", 8)
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    texts = [r["text"] or "" for r in docs.select("text").collect()]
    examples = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    own = [examples[i] for i in model.ids]
    every, told = model.every, model.telling[2]

    def dense(space, of):
        out = np.zeros((len(of), len(model.grams)))
        for row, (g, w) in zip(out, space.vectors(model.weights, of)):
            row[g] = w
        return out

    for space, of in ((told, texts), (every, texts[:120])):
        cosines = np.round(dense(space, of) @ dense(space, own).T, 12)
        for allowed in (None, model.half == 0):
            for (g, w), c in zip(space.vectors(model.weights, of), cosines):
                docs_, cos = space.index.nearest(g, w, 10, allowed)
                c = c if allowed is None else np.where(allowed, c, 0)
                want = np.sort(c[c > 1e-12])[::-1][:10]
                assert np.allclose(cos, want, atol=1e-11) and np.allclose(c[docs_], cos, atol=1e-11)

    rng = np.random.default_rng(3)  # examples of 30 subjects, placed by subject
    vectors = []
    for i in range(1500):
        g = np.sort(np.r_[i // 50 * 20 + rng.choice(20, 6, replace=False), 600 + rng.choice(100, 5, replace=False)])
        w = np.where(g < 600, 1.0, 0.2) * (rng.random(len(g)) + 0.5)
        vectors.append((g, w / np.sqrt((w * w).sum())))
    index = toxicity.Index.of(vectors, 700, 25)
    for g, w in vectors[::10]:
        index.nearest(g, w, 10)
    assert index.seen > 150 * 50 and index.opened < index.seen / 5


def test_isotonic_rises():
    steps, levels = toxicity.isotonic(np.array([0.1, 0.2, 0.3, 0.4, 0.5]), np.array([0, 1, 0, 1, 1.0]), 0.5)
    assert (np.diff(levels) > 0).all() and (np.diff(steps) > 0).all()


# ---- main text

def test_main_text_of_the_given_pages(spark):
    import html
    import re

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r for r in main_text.extract(pages).collect()}
    right = 0
    for r in pages.collect():
        body = re.search(r"<article>(.*?)(</article>|$)", r["html"], re.S)[1]
        want = [" ".join(html.unescape(re.sub(r"</?b>|<br>", "", x)).split()) for x in re.split(r"</?(?:h1|p)>", body)]
        right += got[r["page_id"]]["text"] == "\n".join(x for x in want if x)
        assert got[r["page_id"]]["n_chars"] == len(got[r["page_id"]]["text"])
    assert right >= 0.97 * len(got) and len(got) == pages.count()


def test_main_text_of_held_out_layouts():
    chain, hits, called, real = main_text.trained(), 0, 0, 0
    for page in main_text.labelled_pages(150, seed=12345):
        labels, truth = chain.labels(page), [b.marked for b in page]
        hits += sum(a and b for a, b in zip(labels, truth))
        called += sum(labels)
        real += sum(truth)
    assert hits / called > 0.95 and hits / real > 0.95


def test_viterbi_equals_all_paths():
    import itertools

    chain = main_text.trained()
    for page in main_text.labelled_pages(60, seed=5):
        page = page[:9]
        gain = [sum(chain.weights.get(f, 0) for f in own) for own in main_text.features(page)]

        def value(labels):
            return sum(g for g, y in zip(gain, labels) if y) + sum(chain.step[int(a), int(b)] for a, b in zip(labels, labels[1:]))

        best = max(value(p) for p in itertools.product((False, True), repeat=len(page)))
        assert abs(value(chain.labels(page)) - best) < 1e-9


def test_broken_markup(spark):
    df = spark.createDataFrame([(1, None, None, "x"), (2, "u", "", "x"), (3, None, "<p>a &amp; b&nbsp;c<p>d<script>var x='</p>'", "x"), (None, "v", "<<<>&lt; <a <b", "x"),
                                (5, "w", "<ul><li>one<li>two</ul><table><tr><td>x<td>y</table>" + "<div>" * 3000 + "deep", "x")],
                               "page_id long, url string, html string, text string")
    got = {r["page_id"]: r for r in main_text.extract(df).collect()}
    assert got[1]["text"] == got[2]["text"] == "" and len(got) == 5
    assert [b.text for b in main_text.blocks("<p>a &amp; b&nbsp;c<p>d<script>var x='</p>'")] == ["a & b c", "d"]
    assert [b.text for b in main_text.blocks("<ul><li>one<li>two</ul><table><tr><td>x<td>y</table>z")] == ["one", "two", "x", "y", "z"]
    assert [(b.text, b.path) for b in main_text.blocks("<article><h1>T</h1><p><b>x<br><p>y</article>z")] == [("T", ("article", "h1")), ("x", ("article", "p")), ("y", ("article", "p")), ("z", ())]


@pytest.mark.parametrize("piece", ["<a ", "<a", "<a\"", "<div>x", "<x>", '<a x="1" ', "<a '\"", "</script", "<button><select>", "<b><div></i>", "<p>z</x>", "<td>q<th>", "<!-", "<svg><g>"])
def test_time_grows_with_the_page(piece):
    """Unclosed tags, quotes and elements, to any depth: ten times the page takes about ten times as long."""
    import time

    chain, took = main_text.trained(), []
    for size in (60_000, 600_000):
        page = ("<script>" if piece == "</script" else "") + piece * (size // len(piece)) + ('"' if "1" in piece else "")
        start = time.process_time()
        main_text.main_text(page, chain)
        took.append(time.process_time() - start)
    assert took[1] < 25 * max(took[0], 0.02), took


def test_five_megabytes_of_open_elements():
    chain = main_text.trained()
    assert main_text.main_text("<a " * 1_600_000, chain) == ""
    found = main_text.blocks("<article><p>" + "<div class=deep>" * 300_000 + "text", *chain.known)
    assert [b.text for b in found] == ["text"] and len(found[0].path) == 300_001 and found[0].named


def test_ends_of_tags_equal_the_pattern():
    import random

    rng = random.Random(2)
    plain = main_text.re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", main_text.re.S)
    for _ in range(20_000):
        page = "".join(rng.choices(["<a ", "<b>", "</p", ">", '"', "'", "x", "<", "<!--", "-->", "/", " y=", "<?z"], k=rng.randrange(16)))
        want = [(m.start(), m.end(), m[1] or "", m[2] or "", m[3] or "") for m in plain.finditer(page)]
        got, at, reader = [], 0, main_text.Reader(page)
        while (found := reader.next(at)) is not None:
            got.append(found)
            at = found[1]
        assert got == want, page


def test_an_open_or_empty_element_does_not_end_the_page():
    chain = main_text.trained()
    body = "".join(f"<p>{' '.join(['Solen marit dovan kelu besan'] * 6)} {i}.</p>" for i in range(4))

    def read(before="", within=""):
        page = f"<html><body><nav><a href=/>Home</a> <a href=/x>Contact</a></nav>{before}<article><h1>Kelu marit</h1>{within}{body}</article><footer>&copy; 2024 Dovan</footer></body></html>"
        return main_text.main_text(page, chain)

    want = read()
    assert want.startswith("Kelu marit") and want.endswith(" 3.")
    for odd in ("<button>Go", "<select><option>One<option>Two", "<svg viewBox='0 0 1 1'/>", "<svg><path d='M0'>", "<math/>", "<video src=a>", "<audio>", "<canvas>", "<object data=x>",
                "<noscript>", "<template>", "<button>Go</button>", "<svg><title>Logo</title><path d='M0'/></svg>", "<button>A<button>B</button>"):
        for got in (read(before=odd), read(within=odd)):
            assert all(line in got.split("\n") for line in want.split("\n")), odd
    assert main_text.blocks("<p>a <svg/>b <math><mi>x</mi><mo/></math> c</p>")[0].text == "a b x c"
    assert [(b.text, b.path) for b in main_text.blocks("<p>a<button class=k>b</button>c<select><option>d<option>e</select>f</p><style>x")] == [
        ("a", ("p",)), ("b", ("p", "button")), ("c", ("p",)), ("d", ("p", "select", "option")), ("e", ("p", "select", "option")), ("f", ("p",))]


# ---- registration

def test_registered_names():
    assert [n for n in QUERIES if n.startswith("op")] and sorted(int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op")) == list(range(1, 11))
    assert "pipeline" in QUERIES and set(STATEMENTS) <= set(QUERIES)
