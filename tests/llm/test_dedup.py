import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tidemark.llm import exact_dedup, line_dedup, simhash, substring_dedup
from tidemark.llm.common import components, cut_points, range_of, stored

SCHEMA = "doc_id long, text string"
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def made(spark, rows):
    """With extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", kept string, fingerprint long")


ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "a b c"), (5, "A b  c"), (6, "a b c"), (7, "a b c"), (9, "\x1c"), (-4, "é" * 3)]


def test_exact_equals_brute_force(spark, docs):
    for rows in (ODD, rows_of(docs) + [(10_000 + i, "hot  copy") for i in range(300)]):
        got = {tuple(r)[:5] for r in exact_dedup.dedup(made(spark, rows)).collect()}
        assert got == brute.exact(rows)


def test_exact_survives_colliding_fingerprints_and_pieces(spark):
    rng = random.Random(1)
    rows = ODD + [(100 + i, " ".join(rng.choice("ab") for _ in range(rng.randrange(12)))) for i in range(200)]
    for kw in ({"prime": 7}, {"chunk": 2, "huge": 5}, {"prime": 5, "chunk": 3, "huge": 4}):
        got = {tuple(r)[:5] for r in exact_dedup.dedup(made(spark, rows), **kw).collect()}
        assert got == brute.exact(rows)


def test_fingerprints_join():
    data = bytes(range(256)) * 40
    whole = exact_dedup.fingerprint(data, chunk=7)
    a, b = data[:1234], data[1234:]
    assert whole == int.from_bytes(data, "big") % exact_dedup.PRIME
    assert whole == exact_dedup.join(exact_dedup.fingerprint(a), exact_dedup.fingerprint(b), len(b))


def test_exact_nulls_and_repeats(spark):
    got = exact_dedup.dedup(made(spark, [(5, "a"), (5, "a"), (None, "a"), (None, "b")])).collect()
    assert sum(r["kept"] for r in got) == 2 and len(got) == 4
    assert {r["keep_id"] for r in got if r["group_size"] == 3} == {5}
    assert exact_dedup.dedup(made(spark, [])).collect() == []


def test_lines_equal_brute_force(spark, docs):
    odd = ODD + [(20, "Hello World line\nx"), (21, " hello world LINE\t\nkeep me please"), (22, "hello world line\nhello world line\n")]
    for rows in (odd, rows_of(docs)):
        got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["text"]) for r in line_dedup.dedup(made(spark, rows)).collect()}
        assert got == brute.lines(rows)


def test_lines_keep_other_columns_null_ids_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a long line here", "src"), (None, "a long line here", "s2"), (2, "a long line here", None)],
                               "doc_id long, text string, source string")
    got = {(r["doc_id"], r["text"], r["source"]) for r in line_dedup.dedup(df).collect()}
    assert got == {(1, "a long line here", "src"), (None, "a long line here", "s2"), (2, "", None)}
    assert line_dedup.dedup(df.limit(0)).collect() == []
    twice = made(spark, [(1, "a long line here"), (2, "x\na long line here"), (2, "a long line here\ny\nA LONG line here"), (2, "x\na long line here")])
    assert sorted(r["text"] for r in line_dedup.dedup(twice).collect() if r["doc_id"] == 2) == ["x", "x", "y"]


def test_lines_are_reversible(spark, docs, monkeypatch):
    def gone(state):
        return {(r["doc_id"], p) for r in line_dedup.drops(state).collect() for p in r["places"]}

    a, b = docs.filter("doc_id % 2 = 0"), docs.filter("doc_id % 2 = 1")
    whole, half = line_dedup.build(docs), line_dedup.build(a)
    both = line_dedup.insert(half, b)
    assert gone(both) == gone(whole)
    assert gone(line_dedup.insert(both, b)) == gone(whole)
    back = line_dedup.delete(both, b)
    assert gone(back) == gone(half)
    assert {tuple(r) for r in back.counts.collect()} == {tuple(r) for r in half.counts.select(*back.counts.columns).collect()}
    monkeypatch.setattr(line_dedup, "FILTER_BYTES", 0)
    assert gone(whole) == gone(both)


def test_cuckoo_filter_holds_and_deletes():
    rng = np.random.default_rng(3)
    keys = [rng.bytes(16) for _ in range(3000)]
    f = line_dedup.CuckooFilter.of(keys)

    def holds(some):
        raw = np.frombuffer(b"".join(some), np.uint8).reshape(-1, 16)
        places = np.zeros((len(raw), 8), np.uint8)
        places[:, :6] = raw[:, 6:12]
        return f.holds(raw[:, 4:6].copy().view("<u2").ravel(), places.view("<u8").ravel())

    assert holds(keys).all()
    assert holds([rng.bytes(16) for _ in range(20000)]).mean() < 0.01
    assert all(f.delete(k) for k in keys[:1500]) and holds(keys[1500:]).all() and holds(keys[:1500]).mean() < 0.01


@pytest.mark.parametrize("kw", [{}, {"range_rows": 7, "shard_bytes": 1000}])
def test_substrings_equal_brute_force(spark, docs, kw):
    rows = rows_of(docs) + [(5000, " ".join(["same"] * 70)), (5001, None), (5002, ""), (5003, "a " * 19), (5004, " ".join(["same"] * 20))]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in substring_dedup.dedup(made(spark, rows), **kw).collect()}
    assert got == brute.substrings(rows)


def test_substrings_short_span_and_spans(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice("abcd") for _ in range(rng.randrange(30)))) for i in range(60)]
    out = substring_dedup.dedup(made(spark, rows), span=3, range_rows=4).collect()
    want = brute.substrings(rows, 3)
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in out} == want
    assert all(sum(s["stop"] - s["start"] for s in r["spans"]) == r["n_removed"] for r in out)
    assert substring_dedup.dedup(made(spark, [])).collect() == []
    got = substring_dedup.dedup(made(spark, [(None, "a b c"), (1, "a b c"), (1, "a b c")]), span=3).collect()
    assert sorted(r["n_removed"] for r in got) == [0, 3, 3]


def test_simhash_equals_brute_force(spark, docs):
    rows = ODD + [(30 + i, t) for i, t in enumerate(["one", "one two three four", "ONE two three four", "one two three four five"])]
    rows += [(1000 + d, t) for d, t in rows_of(docs)]
    got = {r["doc_id"]: (r["fingerprint"] % 2**64, r["component_id"]) for r in simhash.near_duplicates(made(spark, rows)).collect()}
    assert got == brute.near(rows)


def test_links_join_all_within_four_bits(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(15)]
    prints = list(dict.fromkeys(base + [x ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 9))) for x in base * 30]))
    nodes = dict(enumerate(prints))
    df = spark.createDataFrame([(i, p - 2**64 if p >> 63 else p) for i, p in nodes.items()], "node long, fingerprint long")
    got = {r["node"]: r["root"] for r in components(simhash.links(df)).collect()}
    want = brute.near(None, nodes)
    assert {i: got.get(i, i) for i in nodes} == {i: c for i, (_, c) in want.items()}


def test_simhash_nulls_and_empty(spark):
    got = [(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(made(spark, [(None, "a"), (3, "a"), (2, "a"), (2, "a"), (None, "q")])).collect()]
    assert sorted(got, key=str) == sorted([(None, 2), (3, 2), (2, 2), (2, 2), (None, None)], key=str)
    assert simhash.near_duplicates(made(spark, [])).collect() == []


def test_components_of_a_long_path(spark):
    n = 300
    ids = list(range(n))
    random.Random(4).shuffle(ids)
    edges = spark.createDataFrame([(a, b) for a, b in zip(ids, ids[1:])] + [(1000, 1001)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert got == {**{i: 0 for i in ids}, 1000: 1000, 1001: 1000}


def test_ranges_follow_the_cut_points(spark):
    df = stored(spark.createDataFrame([(i * i,) for i in range(-5, 1000)] + [(None,)], "v long"))
    cuts = cut_points(df, "v", 10)
    got = df.select("v", range_of("v", cuts).alias("r")).collect()
    assert all(r["r"] == (None if r["v"] is None else sum(c <= r["v"] for c in cuts)) for r in got)
    assert df.select(F.count_distinct(range_of("v", [])).alias("n")).first()["n"] == 1
