"""Exact dedup by composable polynomial fingerprints.

A normalised text is the number whose base-256 digits are its bytes; its fingerprint is that number
modulo a prime. Fingerprints of neighbouring chunks join by shifting: f(AB) = f(A) * 256^|B| + f(B),
so the pieces of a huge document are hashed in parallel tasks and joined afterwards. Texts with equal
fingerprints and lengths are then compared chunk by chunk; a group that fails is parted by SHA-256.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SPACES, attach, stored

PRIME = 2**127 - 1
CHUNK = 1 << 16
#: Texts longer than this many bytes are hashed in pieces of as many characters.
HUGE = 1 << 24
DROP = SPACES.encode()


def fingerprint(data: bytes, prime: int = PRIME, chunk: int = CHUNK) -> int:
    """Joined left to right from the fingerprints of the chunks."""
    view, total = memoryview(data), 0
    for at in range(0, len(data), chunk):
        part = view[at:at + chunk]
        total = join(total, int.from_bytes(part, "big") % prime, len(part), prime)
    return total


def join(left: int, right: int, right_len: int, prime: int = PRIME) -> int:
    return (left * pow(256, right_len, prime) + right) % prime


def dedup(docs: DataFrame, prime: int = PRIME, chunk: int = CHUNK, huge: int = HUGE) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256, fingerprint.

    Texts are equal when identical without the characters [\\x20\\x09-\\x0D]; null counts as empty.
    The row with the most code points stays, then the smallest doc_id, a null doc_id last; of rows
    alike in both one stays. An empty table gives an empty result. Other columns are ignored.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("row", F.monotonically_increasing_id())
    rows = stored(_short(docs.filter(F.octet_length("text") <= huge), prime, chunk)
                  .union(_long(docs.filter(F.octet_length("text") > huge), prime, chunk, huge)), "prints")
    total = rows.count()
    groups = _groups(rows)
    members = attach(rows.select("doc_id", "fingerprint", "n_bytes"), groups.select("fingerprint", "n_bytes", "group_size"),
                     ["fingerprint", "n_bytes"], "group_size", total, "doc_id")
    bad = _unequal(docs, members.filter("group_size > 1").select("doc_id").distinct(), prime, chunk)
    if not bad.isEmpty():
        marked = rows.join(bad.withColumn("bad", F.lit(True)), ["fingerprint", "n_bytes"], "left")
        rows = stored(marked.withColumn("fingerprint", F.when(F.col("bad"), F.concat("fingerprint", F.lit("-"), "text_sha256"))
                                        .otherwise(F.col("fingerprint"))).select(*rows.columns), "prints")
        groups = _groups(rows)
    out = attach(rows, groups, ["fingerprint", "n_bytes"], "group_size", total, "row")
    return out.select("doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("keep.row")).alias("kept"),
                      "text_sha256", "fingerprint")


def _groups(rows: DataFrame) -> DataFrame:
    best = F.struct("n_chars", -F.col("doc_id"), -F.col("row"))
    return stored(rows.groupBy("fingerprint", "n_bytes").agg(
        F.count(F.lit(1)).alias("group_size"), F.max_by(F.struct("doc_id", "row"), best).alias("keep")), "groups")


ROWS = "row long, doc_id long, n_chars long, n_bytes long, fingerprint string, text_sha256 string"


def _short(docs: DataFrame, prime: int, chunk: int) -> DataFrame:
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for raw in b.column("raw").to_pylist():
                data = raw.translate(None, DROP)
                out.append((len(data), f"{fingerprint(data, prime, chunk):032x}", hashlib.sha256(data).hexdigest()))
            sizes, prints, shas = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"), b.column("n_chars"), pa.array(sizes, pa.int64()),
                                              pa.array(prints, pa.string()), pa.array(shas, pa.string())],
                                             ["row", "doc_id", "n_chars", "n_bytes", "fingerprint", "text_sha256"])

    return docs.select("row", F.col("doc_id").cast("long"), F.char_length("text").cast("long").alias("n_chars"),
                       F.col("text").cast("binary").alias("raw")).mapInArrow(hashed, ROWS)


def _long(docs: DataFrame, prime: int, chunk: int, piece: int) -> DataFrame:
    """Pieces of huge documents, hashed wherever the shuffle puts them and joined by length."""
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = [x.translate(None, DROP) for x in b.column("raw").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("no"), pa.array([len(x) for x in data], pa.int64()),
                                              pa.array([f"{fingerprint(x, prime, chunk):x}" for x in data], pa.string())], ["row", "no", "size", "part"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = []
            for parts in b.column("parts").to_pylist():
                total = 0
                for p in parts:
                    total = join(total, int(p["part"], 16), p["size"], prime)
                prints.append(f"{total:032x}")
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("n_bytes"), pa.array(prints, pa.string())], ["row", "n_bytes", "fingerprint"])

    pieces = docs.select("row", "text", F.explode(F.sequence(F.lit(0), F.floor((F.char_length("text") - 1) / piece).cast("int"))).alias("no"))
    pieces = pieces.select("row", "no", F.expr(f"substring(text, no * {piece} + 1, {piece})").cast("binary").alias("raw")).repartition("row", "no")
    parts = pieces.mapInArrow(hashed, "row long, no int, size long, part string")
    prints = (parts.groupBy("row").agg(F.sum("size").alias("n_bytes"), F.sort_array(F.collect_list(F.struct("no", "part", "size"))).alias("parts"))
              .mapInArrow(joined, "row long, n_bytes long, fingerprint string"))
    about = docs.select("row", F.col("doc_id").cast("long"), F.char_length("text").cast("long").alias("n_chars"),
                        F.sha2(F.regexp_replace("text", "[\\x20\\x09-\\x0D]+", "").cast("binary"), 256).alias("text_sha256"))
    return about.join(prints, "row").select("row", "doc_id", "n_chars", "n_bytes", "fingerprint", "text_sha256")


def _unequal(docs: DataFrame, ids: DataFrame, prime: int, chunk: int) -> DataFrame:
    """Fingerprints whose texts differ in some chunk. Equal chunks collapse before the shuffle, so
    a group of copies of any size costs one row per chunk and task."""
    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b.column("raw").to_pylist():
                data = raw.translate(None, DROP)
                parts = [data[i:i + chunk] for i in range(0, len(data), chunk)]
                yield pa.RecordBatch.from_arrays([
                    pa.array([f"{fingerprint(data, prime, chunk):032x}"] * len(parts), pa.string()), pa.array([len(data)] * len(parts), pa.int64()),
                    pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], ["fingerprint", "n_bytes", "no", "chunk"])

    ids = ids.withColumnRenamed("doc_id", "_id")
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("raw")).join(ids, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    seen = texts.select("raw").mapInArrow(chunks, "fingerprint string, n_bytes long, no int, chunk binary")
    seen = seen.groupBy("fingerprint", "n_bytes", "no", "chunk").agg(F.count(F.lit(1)).alias("n"))
    return stored(seen.groupBy("fingerprint", "n_bytes", "no").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
                  .select("fingerprint", "n_bytes").distinct(), "unequal")
