"""Registered queries of the fingerprint, tokenizer, language and packing operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.llm import bpe, lang_id, main_text, packing, phrases, toxicity
from tidemark.llm.common import documents, table
from tidemark.llm.registry import query


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def added() -> dict[str, int]:
    import public_tokenizers

    return packing.added_tokens(public_tokenizers.path("byte_bpe_50k.json"))


@query("op1_document_fingerprints")
def op1(spark, sf_dir):
    return phrases.with_next(documents(spark, sf_dir))


@query("op6_bpe_round_trip")
def op6(spark, sf_dir):
    return bpe.round_trip(documents(spark, sf_dir), vocabulary())


@query("op7_language_id")
def op7(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = lang_id.fit(docs.filter(~held_out).select("text", "lang"))
    out = lang_id.identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query("op8_packing")
def op8(spark, sf_dir):
    return packing.pack(documents(spark, sf_dir), vocabulary(), added=added())


@query("op3_toxicity")
def op3(spark, sf_dir):
    docs, labels = documents(spark, sf_dir), table(spark, sf_dir, "labels")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    model = toxicity.fit(docs, labels.filter(~held_out))
    out = toxicity.score(docs, model).drop("evidence")
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query("op5_main_text")
def op5(spark, sf_dir):
    return main_text.extract(table(spark, sf_dir, "pages"))
