"""Quality rules and a trained verdict.

A logistic regression over hashed features: every word, and every run of three characters, of the whole text, each as a
share of the text's words or runs. It is trained by `pyspark.ml` on a bounded sample of labelled rows; a quarter of the
sample is kept apart to turn margins into probabilities. Texts are scored in Arrow batches: margins are sums of weights, so no
vector is built. Fixed thresholds decide: too few words or too many repeated ones fail a text at once, else the
probability of good quality does.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored

#: Labelled rows that are looked at, at most: those whose hash of doc_id is lowest.
EXAMPLES = 16_384
#: One in so many examples calibrates.
APART = 4
CHARS = 3
#: Buckets of words, and as many of character runs.
BUCKETS = 1 << 16
ITERATIONS, RIDGE = 60, 1e-6
#: Partitions of the examples; with so few, gradients are summed without a shuffle.
FEW = 5
# Fixed thresholds
LEAST_WORDS = 50
MOST_REPEATED = 50  # per cent of the words
KEEP_AT = 0.5
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
#: A long text is hashed in pieces of this many characters; about as many are hashed at once.
PIECE = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
UNBASE = np.uint64(pow(int(BASE), -1, 1 << 64))
MIX = np.uint64(0xD6E8FEB86659FD93)
COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of three that the text has twice or more."""
    if len(words) < 6 and len(set(words)) == len(words):
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    if len(ids) < 4 or len(known) == len(ids):
        return 0
    pair = np.unique(ids[:-1] * len(known) + ids[1:], return_inverse=True)[1]
    _, which, n = np.unique(pair[:-1] * len(known) + ids[2:], return_inverse=True, return_counts=True)
    twice = np.flatnonzero(n[which] > 1)
    covered = np.zeros(len(ids), bool)
    for k in range(3):
        covered[twice + k] = True
    return int(covered.sum())


def counted(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    raw = text.encode()
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()] if b"\n" in raw else []
    return (len(words), len(text) - sum(raw.count(c) for c in SPACES), sum(raw.count(c) for c in SYMBOLS), len(lines) - len(set(lines)), repeated_words(words))


def segments(texts: list[str]) -> Iterator[tuple[int, str, int]]:
    """(text, piece, length): words and runs that begin in the first `length` characters belong to the piece. Pieces end at white space."""
    for i, t in enumerate(texts):
        at = 0
        while len(t) - at > PIECE:
            end = next((k for k in range(at + PIECE, len(t)) if t[k] in " \t\n\x0b\x0c\r"), len(t))
            yield i, t[at:end + CHARS - 1], end - at
            at = end
        yield i, t[at:], len(t) - at


_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64."""
    if not _POWERS or len(_POWERS[0]) < n:
        _POWERS[:] = [np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, b))]) for b in (BASE, UNBASE)]
    return _POWERS[0][:n], _POWERS[1][:n]


def buckets(pieces: list[tuple[int, str, int]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, bucket) of the words, then of the character runs; runs have the buckets from BUCKETS on."""
    points = np.frombuffer("\n".join(p for _, p, _ in pieces).encode("utf-32-le", "surrogatepass") or b"\0\0\0\0", np.uint32)
    sizes = np.array([len(p) for _, p, _ in pieces])
    starts = np.cumsum(sizes + 1) - sizes - 1
    text, own = np.array([i for i, _, _ in pieces]), np.array([n for _, _, n in pieces])
    space = (points == 32) | ((points >= 9) & (points <= 13))
    up, down = powers(len(points) + 1)
    running = np.concatenate([np.zeros(1, np.uint64), np.cumsum((points + np.uint32(1)).astype(np.uint64) * up[:len(points)])])
    edge = np.diff(np.concatenate([[1], space.view(np.int8), [1]]))
    first, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    piece = np.searchsorted(starts, first, side="right") - 1
    use = first - starts[piece] < own[piece]
    first, end, piece = first[use], end[use], piece[use]
    yield text[piece], (((running[end] - running[first]) * down[first] * MIX) >> np.uint64(48)).astype(np.int64) % BUCKETS
    wide = points.astype(np.uint64)
    run = ((wide[:-2] * BASE + wide[1:-1]) * BASE + wide[2:]) * MIX if len(points) >= CHARS else wide[:0]
    at = np.concatenate([np.arange(s, s + max(0, min(n, size - CHARS + 1))) for s, n, size in zip(starts, own, sizes)] or [np.zeros(0, np.int64)])
    piece = np.searchsorted(starts, at, side="right") - 1
    yield text[piece], BUCKETS + ((run[at] ^ (run[at] >> np.uint64(29))) * BASE >> np.uint64(48)).astype(np.int64) % BUCKETS


def held_together(texts: list[str]) -> Iterator[list[tuple[int, str, int]]]:
    """Pieces in runs of about PIECE characters."""
    held, size = [], 0
    for p in segments(texts):
        held.append(p)
        size += len(p[1]) + 1
        if size >= PIECE:
            yield held
            held, size = [], 0
    if held:
        yield held


@dataclass
class Model:
    weights: np.ndarray  # by bucket
    bias: float
    slope: float = 1.0   # of the margin, in the probability
    shift: float = 0.0

    def margins(self, texts: list[str]) -> np.ndarray:
        sums, n = np.zeros((2, len(texts))), np.zeros((2, len(texts)))
        for pieces in held_together(texts):
            for kind, (text, bucket) in enumerate(buckets(pieces)):
                sums[kind] += np.bincount(text, self.weights[bucket], len(texts))
                n[kind] += np.bincount(text, minlength=len(texts))
        return self.bias + (sums / np.maximum(n, 1)).sum(axis=0)

    def probability(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(texts) + self.shift, -500, 500)))


def vectors(sample: DataFrame) -> DataFrame:
    """label, apart and the hashed features of each example, packed."""
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            for i, t in enumerate(texts):
                found = [b for pieces in held_together([t]) for _, b in buckets(pieces)]
                at, n = np.unique(np.concatenate(found), return_counts=True)
                row = b.slice(i, 1)
                packed = (zlib.compress(np.diff(at, prepend=0).astype(np.int32).tobytes(), 1), zlib.compress(n.astype(np.int32).tobytes(), 1))
                yield pa.RecordBatch.from_arrays([row.column("label"), row.column("apart"), *(pa.array([x], pa.binary()) for x in packed)], ["label", "apart", "at", "n"])

    return sample.select("label", "apart", "text").mapInArrow(hashed, "label double, apart boolean, at binary, n binary")


def unpacked(at: bytes, n: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of an example and their shares, of its words and of its runs."""
    at, n = np.cumsum(np.frombuffer(zlib.decompress(at), np.int32)), np.frombuffer(zlib.decompress(n), np.int32)
    runs = at >= BUCKETS
    return at, n / np.where(runs, max(1, n[runs].sum()), max(1, n[~runs].sum()))


def fit(docs: DataFrame, labels: DataFrame, most: int = EXAMPLES) -> Model | None:
    """A model from `labels` (doc_id, quality 0 or 1) of `docs` (doc_id, text). Other labels and null ones are left out; a document
    with several labels is bad if one says so, and documents that share a doc_id are examples each. Null text is empty. None if
    either label is missing. At most `most` labelled ids are used, those with the lowest hash."""
    labels = labels.filter("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").cast("double").alias("label"))
    picked = labels.withColumn("order", F.xxhash64("doc_id")).orderBy("order", "doc_id").limit(most)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")
    apart = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(APART)) == 0
    rows = stored(vectors(rows.withColumn("apart", apart)), "vectors")
    kinds = {(r["label"], r["apart"]) for r in rows.select("label", "apart").distinct().collect()}
    if len({label for label, _ in kinds}) < 2:
        return None
    if not {(0.0, False), (1.0, False)} <= kinds:  # few rows: all of them train
        rows, kinds = rows.withColumn("apart", F.lit(False)), set()
    sparse = F.udf(lambda at, n: Vectors.sparse(2 * BUCKETS, *unpacked(at, n)), VectorUDT())
    ready = rows.withColumn("features", sparse("at", "n")).coalesce(FEW)
    plain = LogisticRegression(maxIter=ITERATIONS, regParam=RIDGE, standardization=False, tol=1e-5)
    found = plain.fit(ready.filter("not apart").select("label", "features"))
    model = Model(found.coefficients.toArray(), float(found.intercept))
    if {(0.0, True), (1.0, True)} <= kinds:
        model.slope, model.shift = _calibrated(ready.filter("apart"), model)
    return model


def _calibrated(rows: DataFrame, model: Model) -> tuple[float, float]:
    """Slope and shift of the margins, by a logistic regression of the labels on them."""
    sent = rows.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def margin(at: bytes, n: bytes):
        bucket, share = unpacked(at, n)
        return Vectors.dense(float(sent.value[0][bucket] @ share + sent.value[1]))

    found = LogisticRegression(maxIter=50, regParam=1e-3).fit(rows.select("label", F.udf(margin, VectorUDT())("at", "n").alias("features")))
    return max(0.0, float(found.coefficients[0])), float(found.intercept)


def judge(docs: DataFrame, model: Model | None, keep_at: float = KEEP_AT) -> DataFrame:
    """doc_id, the counts of `COLUMNS`, base_failed, probability of good quality, and kept, of every row of `docs` (doc_id, text).

    Null text is empty, has no words and fails. Rows that share a doc_id are judged each for itself, and equal texts alike. A
    probability of exactly `keep_at` keeps. Without a model the probability is null and the base rules alone decide. An
    empty table gives no rows. Long texts are hashed in pieces; their words are held at once for the repeated ones. Other columns are
    ignored, whatever their names."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            base = np.array([counted(t) for t in texts], np.int64).reshape(-1, 5)
            failed = (base[:, 0] < LEAST_WORDS) | (100 * base[:, 4] > MOST_REPEATED * base[:, 0])
            p = m.probability(texts) if m else np.full(len(texts), np.nan)
            kept = ~failed & ((p >= keep_at) | (m is None))
            yield pa.RecordBatch.from_arrays([
                b.column("doc_id"), *(pa.array(base[:, k]) for k in range(5)), pa.array(failed), pa.array(p, mask=np.isnan(p)), pa.array(kept)],
                ["doc_id", *(c.split()[0] for c in COLUMNS.split(", ")), "base_failed", "probability", "kept"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(judged, f"doc_id long, {COLUMNS}, base_failed boolean, probability double, kept boolean")
