import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from tests.llm import brute
from tidemark.llm import packing
from tidemark.llm.common import stored
from tidemark.llm.queries_text import vocabulary

SF = "/root/testdata/sf0.001"


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(9001, None, "en", "s", 0), (9002, "12 -- 34", "en", "s", 8), (9003, "ξψφ ωδλ " * 80, None, "s", 640),
                                   (9004, "short", None, None, None)], docs.schema)
    out = [stored(docs.union(extra))]
    for _, stage in cp.STAGES:
        out.append(stored(stage(spark, out[-1], SF)))
    return out


def test_stages_return_documents(steps):
    names = [n for n, _ in cp.STAGES]
    assert names == ["language ID", "line dedup", "SimHash near-dedup", "substring dedup", "packing"]
    for df in steps[1:-1]:
        assert df.dtypes == steps[0].dtypes
    for df in steps[2:-1]:
        assert df.filter("n_chars <> char_length(text)").count() == 0


def test_language_keeps_clean_documents(steps):
    before, after = texts(steps[0]), texts(steps[1])
    assert set(before) - set(after) == {9001, 9002, 9003}
    assert all(before[d] == after[d] for d in after)


def test_lines_equal_brute_force(steps):
    assert texts(steps[2]) == {d: x[2] for d, x in brute.lines(list(texts(steps[1]).items())).items()}


def test_near_copies_equal_brute_force(steps):
    before = texts(steps[2])
    kept = {d for d, (_, c) in brute.near(list(before.items())).items() if d == c}
    assert texts(steps[3]) == {d: before[d] for d in kept}


def test_passages_equal_brute_force(steps):
    before = texts(steps[3])
    want = {d: before[d] if not gone else kept for d, (_, gone, kept) in brute.substrings(list(before.items())).items()}
    assert texts(steps[4]) == want


def test_packing_has_every_document(spark, steps):
    got = steps[5].groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m")).collect()
    assert {r["doc_id"] for r in got} == set(texts(steps[4])) and all(r["n"] == r["m"] for r in got)
    again = packing.pack(steps[4], vocabulary())
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in steps[5].collect()}


def test_run_on_an_empty_table_and_repeated_rows(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, df in (("none", docs.limit(0)), ("twice", docs.limit(20).union(docs.limit(20)).union(docs.limit(2).withColumn("doc_id", F.lit(None).cast("long"))))):
        df.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        out = cp.run(spark, f"{tmp_path}/{name}")
        assert (out.count() == 0) == (name == "none")
        assert out.groupBy("doc_id", "start").count().filter("doc_id is not null and count > 1").isEmpty()
