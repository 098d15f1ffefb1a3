"""A corpus made ready for training: language, lines, near copies, passages, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import lang_id, line_dedup, packing, simhash, substring_dedup
from tidemark.llm.common import ready, stored
from tidemark.llm.queries_text import added, vocabulary
from tidemark.llm.registry import query

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found; those without letters or unlike every language go."""
    ready(spark)
    model = lang_id.fit(docs.select("text", "lang"))
    return lang_id.identify(docs, model).filter("not rejected").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go."""
    ready(spark)
    out = line_dedup.dedup(docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest doc_id; of rows that
    share a doc_id, the first by text. Rows without doc_id stay."""
    ready(spark)
    found = stored(simhash.near_duplicates(docs.select("doc_id", "text")).select("doc_id", "component_id"), "near")
    gone = found.filter("component_id <> doc_id").select("doc_id").distinct()
    kept = docs.select(*COLUMNS).join(gone, "doc_id", "left_anti")
    if found.groupBy("doc_id").count().filter("doc_id is not null and count > 1").isEmpty():
        return kept.select(*COLUMNS)
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))
    return kept.withColumn("place", place).filter("place = 1 or doc_id is null").select(*COLUMNS)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of repeated 20-word windows go; a document that loses none keeps its text as it is, white
    space and all."""
    ready(spark)
    docs = docs.select(*COLUMNS)
    out = substring_dedup.dedup(docs, whole=True)
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 tokens."""
    ready(spark)
    return packing.pack(docs.select("doc_id", "text"), vocabulary(), added=added())


STAGES = [("language ID", language), ("line dedup", lines), ("SimHash near-dedup", near_copies), ("substring dedup", passages), ("packing", packed)]

#: Not expressible in SQL: language models, merges of a tokenizer, windows of whole texts. Tested against plain versions.
ORACLE_SQL = None


@query("pipeline")
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = ready(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, "stage")
    return docs
