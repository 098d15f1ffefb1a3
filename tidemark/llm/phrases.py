"""Document fingerprints by locally consistent parsing.

A text is parsed into phrases level by level. On each level runs of one symbol collapse; deterministic coin
tossing then gives every symbol a label below six that depends on a few symbols to its left: the
label is 2 * i + b, i being the lowest bit in which a symbol differs from the one before and b that bit, and
four rounds of this suffice for 64-bit names. Phrases start where labels peak, and a phrase's name is a
hash of the names in it. Equal substrings therefore get equal names except near their ends, at whatever
offset they stand. The name that remains at the top stands for the whole text; the names from the second level
up (some nine characters and more) are its signatures, kept as the smallest hash in each of 128 bins.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut_points, range_of

LEVEL = 2
BINS_BITS = 7
RANGE_ROWS = 256
RUN_CHARS = 1 << 20
ONE = np.uint64(1)
EMPTY = np.uint64(2**64 - 1)
MIX, POWER = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0x9E3779B97F4A7C15)


def _toss_table() -> np.ndarray:
    """Label of a symbol below 128 from it and the one before."""
    a, b = np.arange(128)[:, None], np.arange(128)[None, :]
    low = np.where(a == b, 1, (a ^ b) & -(a ^ b))
    at = np.log2(low).astype(int)
    return (2 * at + (a >> at & 1)).astype(np.uint8).ravel()


TOSS = _toss_table()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * MIX
    return x ^ (x >> np.uint64(29))


def collapsed(names: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of one name within a text become one name."""
    head = np.ones(len(names), bool)
    head[1:] = names[1:] != names[:-1]
    head[starts] = True
    at = np.flatnonzero(head)
    if len(at) == len(names):
        return names, starts
    size = np.diff(np.r_[at, len(names)])
    out = names[at]
    runs = np.flatnonzero(size > 1)
    out[runs] = mixed(out[runs] + size[runs].astype(np.uint64) * POWER)
    return out, np.searchsorted(at, starts)


def labels(names: np.ndarray, starts: np.ndarray) -> np.ndarray:
    before = np.empty_like(names)
    before[1:] = names[:-1]
    before[starts] = ~names[starts]
    low = names ^ before
    low &= -low
    at = np.minimum(np.bitwise_count(low - ONE), 63).astype(np.uint64)
    out = ((at << ONE) | ((names >> at) & ONE)).astype(np.uint8)
    for _ in range(3):
        prev = np.empty_like(out)
        prev[1:] = out[:-1]
        prev[starts] = out[starts] ^ 1
        out = TOSS[out.astype(np.uint16) << 7 | prev]
    return out


def phrases(names: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level up: names of the phrases, and where each text starts among them."""
    names, starts = collapsed(names, starts)
    label = labels(names, starts)
    head = np.zeros(len(names), bool)
    head[1:-1] = (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:])
    head[(starts - 1)[starts > 0]] = False  # a peak needs both neighbours in its text
    head[starts] = True
    at = np.flatnonzero(head)
    size = np.diff(np.r_[at, len(names)])
    inside = np.arange(len(names)) - np.repeat(at, size)
    power = np.multiply.accumulate(np.r_[ONE, np.full(int(size.max()) - 1, POWER)])
    total = np.add.reduceat(names * power[inside], at)
    return mixed(total + size.astype(np.uint64)), np.searchsorted(at, starts)


def sketches(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Top name of each text and its row of smallest hashes by bin, a byte each; 0 is an empty bin. An
    empty text has the name 0 and no signatures."""
    top = np.zeros(len(texts), np.uint64)
    least = np.full(len(texts) << BINS_BITS, EMPTY)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    doc = np.flatnonzero(sizes)
    names = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
    starts = (np.cumsum(sizes) - sizes)[doc]
    level = 0

    def sign(own: np.ndarray, names: np.ndarray) -> None:
        h = mixed(names * POWER)
        np.minimum.at(least, (own << BINS_BITS) + (h >> np.uint64(64 - BINS_BITS)).astype(np.int64), h & np.uint64((1 << 64 - BINS_BITS) - 1))

    while len(doc):
        names, starts = phrases(names, starts)
        level += 1
        count = np.diff(np.r_[starts, len(names)])
        if level >= LEVEL:
            sign(np.repeat(doc, count), names)
        done = count == 1
        if done.any():
            top[doc[done]] = names[starts[done]]
            if level < LEVEL:
                sign(doc[done], names[starts[done]])
            names, doc, count = names[np.repeat(~done, count)], doc[~done], count[~done]
            starts = np.cumsum(count) - count
    least = least.reshape(-1, 1 << BINS_BITS)
    return top, np.where(least == EMPTY, 0, (least >> np.uint64(20)) % np.uint64(255) + ONE).astype(np.uint8)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of common signatures, estimated from rows of bins; 1 for two empty ones."""
    either = ((a != 0) | (b != 0)).sum(axis=1)
    return np.where(either > 0, ((a == b) & (a != 0)).sum(axis=1) / np.maximum(either, 1), 1.0)


def written(top: np.ndarray, bins: np.ndarray) -> list[str]:
    return [f"{t:016x}{b.tobytes().hex()}" for t, b in zip(top.tolist(), bins)]


def read(prints: list[str]) -> np.ndarray:
    """Bins of written fingerprints."""
    return np.frombuffer(bytes.fromhex("".join(p[16:] for p in prints)), np.uint8).reshape(len(prints), -1)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint of every row of `docs` (doc_id, text); null text counts as empty. Equal texts have
    equal fingerprints, and `likeness` compares those of different texts."""
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = written(*sketches([t or "" for t in b.column("text").to_pylist()]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(prints, pa.string())], ["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(made, "doc_id long, fingerprint string")


def edited(text: str, following: str) -> str:
    """`text` with its last quarter replaced by as much of the start of `following`."""
    part = len(text) // 4
    return text[:len(text) - part] + following[:part]


def with_next(docs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Fingerprints of every row of `docs` (doc_id, text) and of its text edited by the next document's start:
    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. The next document
    is the one with the next greater doc_id, after the last the first; rows that share a doc_id follow each
    other by text, those without one come first. Null text counts as empty. A single row is its own next.
    An empty table gives an empty result; other columns are ignored.

    Texts are shuffled once, by ranges of doc_id; the first row of each range also goes to the range
    before. The driver holds one id per range."""
    low = F.lit(-(2**63))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), low).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("part", range_of("id", cut_points(rows, "id", range_rows)))
    heads = sorted((r["part"], r["id"]) for r in rows.groupBy("part").agg(F.min("id").alias("id")).collect())
    if heads:
        tails = [(i, heads[k - 1][0]) for k, (_, i) in enumerate(heads)]
        sent = docs.sparkSession.createDataFrame(tails, "id long, tail long")
        rows = rows.join(F.broadcast(sent), "id", "left")
    else:
        rows = rows.withColumn("tail", F.lit(None).cast("long"))
    places = F.array(F.struct("part", F.lit(False).alias("extra")), F.struct(F.col("tail").alias("part"), F.lit(True).alias("extra")))
    rows = rows.select("id", "text", F.explode(F.filter(places, lambda p: p["part"].isNotNull())).alias("at"))
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.select("id", "text", "at.part", "at.extra").repartition(parts, "part").sortWithinPartitions("part", "extra", "id", "text")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("id", "text", "extra"))):
                held.append(row)
                size += len(row[1])
                if size >= RUN_CHARS:
                    yield _compared(held)
                    held, size = held[-1:], 0
        if len(held) > 1:
            yield _compared(held)

    return rows.mapInArrow(compared, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
                                     "near_edited double, near_next double")


def _compared(rows: list[tuple]) -> pa.RecordBatch:
    """Every row but the last, which is only a neighbour, and those that stand for another range's first."""
    texts = [r[1] for r in rows]
    own = [i for i in range(len(rows) - 1) if not rows[i][2]]
    changed = [edited(texts[i], texts[i + 1]) for i in own]
    top, bins = sketches(texts + changed)
    at = np.array(own, np.int64)
    mine, other = bins[at], bins[len(texts):]
    ids = [None if rows[i][0] == -(2**63) else rows[i][0] for i in own]
    cols = [pa.array(ids, pa.int64()), pa.array([len(texts[i]) for i in own], pa.int64()),
            pa.array([hashlib.sha256(c.encode()).hexdigest() for c in changed], pa.string()),
            pa.array(written(top[at], mine), pa.string()), pa.array(written(top[len(texts):], other), pa.string()),
            pa.array(likeness(mine, other)), pa.array(likeness(mine, bins[at + 1]))]
    return pa.RecordBatch.from_arrays(cols, ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
