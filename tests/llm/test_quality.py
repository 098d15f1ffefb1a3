"""Quality rules: counts against a plain version, verdicts on labelled rows held out."""

import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import quality

SF = "/root/testdata/sf0.1"


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    at = defaultdict(list)
    for i in range(len(words) - 2):
        at[tuple(words[i:i + 3])].append(i)
    covered = {i + k for own in at.values() if len(own) > 1 for i in own for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


TEXTS = [None, "", " \n\t", "a", "a a a a", "a b c a b c", "a b c\na b c\n\n \nx", "ü\x0b#é\x0c*\r|", "x y x y", "\n".join(["p q r s"] * 5),
         "one two three four one two three", "a b a b a b a", "$%&" * 9, "a\nb\n\na", "end \x1c \x85   sep", "x " * 49 + "y", "long " * 3]


def test_counts_equal_plain():
    rng = np.random.default_rng(4)
    texts = TEXTS + ["".join(rng.choice(list("ab# \né"), rng.integers(1, 300))) for _ in range(200)]
    for t in texts:
        assert quality.counted(t or "") == plain(t), t


def test_features_do_not_depend_on_company_or_pieces(monkeypatch):
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list("abcé \n"), 700)) for _ in range(6)] + ["", "ab", "x"]
    model = quality.Model(rng.normal(size=2 * quality.BUCKETS), 0.1)
    alone = np.array([model.margins([t])[0] for t in texts])
    assert (model.margins(texts) == alone).all() and model.margins(texts[::-1]).tolist() == alone[::-1].tolist()
    monkeypatch.setattr(quality, "PIECE", 50)
    assert np.allclose(model.margins(texts), alone, rtol=1e-12, atol=0)


def test_equal_words_share_a_bucket():
    def words(texts):
        text, bucket = next(quality.buckets([(i, t, len(t)) for i, t in enumerate(texts)]))
        return text.tolist(), bucket.tolist()

    text, bucket = words(["one two one", "", "two  one\tthree"])
    assert text == [0, 0, 0, 2, 2, 2] and bucket[0] == bucket[2] == bucket[4] and bucket[1] == bucket[3] and len(set(bucket)) == 3


def test_held_out_verdicts(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    apart = F.crc32(F.col("doc_id").cast("string")) % 4 == 0
    model = quality.fit(docs, labels.filter(~apart))
    got = quality.judge(docs.join(labels.filter(apart).select("doc_id", "quality"), "doc_id").select("doc_id", "text", F.lit(1).alias("kept")), model)
    rows = got.join(labels.select("doc_id", "quality"), "doc_id").filter("not base_failed").collect()
    good, bad = ([r["kept"] for r in rows if r["quality"] == q] for q in (1, 0))
    assert len(good) > 500 and len(bad) > 30
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.1 * len(bad)
    p, y = np.array([r["probability"] for r in rows]), np.array([r["quality"] for r in rows])
    assert abs(p.mean() - y.mean()) < 0.05 and ((p - y) ** 2).mean() < 0.03


def test_defined_results(spark):
    words = " ".join(f"w{i}" for i in range(60))
    rows = [(1, None), (2, ""), (3, words), (3, words), (None, words), (4, "a b c d " * 15), (5, "x " * 2_600_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"quality": F.lit(1), "kept": F.lit("x"), "n_words": F.lit(0)})
    got = quality.judge(df, None).collect()
    want = [(d, *plain(t)) for d, t in rows[:-1]] + [(5, 2_600_000, 2_600_000, 0, 0, 2_600_000)]
    assert sorted((tuple(r)[:6] for r in got), key=str) == sorted(want, key=str)
    assert sorted((r["doc_id"] or 0, r["base_failed"], r["kept"], r["probability"]) for r in got) == [
        (0, False, True, None), (1, True, False, None), (2, True, False, None), (3, False, True, None), (3, False, True, None), (4, True, False, None), (5, True, False, None)]
    assert quality.judge(df.limit(0), None).collect() == []


def test_labels_of_one_kind_give_no_model(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, None), (2, 7), (None, 0), (9, 0)], "doc_id long, quality int")
    assert quality.fit(docs, labels) is None


@pytest.mark.parametrize("n", [1, 4])
def test_few_labels_train_all(spark, n):
    docs = spark.createDataFrame([(k, "good words here" if k % 2 else "### ***") for k in range(2 * n)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(2 * n)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    assert model.probability(["good words here"])[0] > 0.5 > model.probability(["### ***"])[0]
