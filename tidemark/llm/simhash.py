"""SimHash near-dedup over popcount vectors.

The 64 bits of a fingerprint fall into 32 segments of two bits; the vector of their bit counts is the
fingerprint's place. Changing one bit moves the place by one step, so the Manhattan distance of two
places is at most the Hamming distance. Two places within four steps are, in one half of the segments,
within two, and then some place is within one step of both in that half. Each fingerprint therefore
enters the grid cells within one step of its place, half by half (about fifty), and fingerprints that meet
in a cell are compared bit by bit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import attach, components, stored

WORDS, SEED, BITS = 4, 42, 4
LOW = np.uint64(0x5555555555555555)
#: Runs of a cell up to this length are compared by offsets, longer ones by a search.
SHORT_RUN = 24
#: Rows of whole cells taken together.
MEET_ROWS = 1 << 17


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """Bits set in over half the shingles' XXH64; zero if the text has no word."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(b" ".join(parts), SEED)
    line = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    starts = [0, *ends[:-words].tolist()]
    stops = (ends[words - 1:] - 1).tolist()
    one, seed = xxhash.xxh64_digest, SEED
    raw = np.frombuffer(b"".join([one(line[a:b], seed) for a, b in zip(starts, stops)]), np.uint8).reshape(-1, 8)
    votes = np.zeros(64, np.int64)
    for at in range(0, len(raw), 1 << 14):
        votes += np.unpackbits(raw[at:at + (1 << 14)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(raw)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id and fingerprint (64 bits as a long) of every row; null text counts as empty."""
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = np.array([fingerprint(t, words) for t in b.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(prints.view(np.int64))], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(made, "doc_id long, fingerprint long")


def place(prints: np.ndarray) -> np.ndarray:
    """Bit counts of the 32 two-bit segments, each in its own two bits."""
    return prints - ((prints >> np.uint64(1)) & LOW)


def cells_of(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the fingerprint, cell): the cells within one step of its place in either half."""
    own, cells = [], []
    index, at = np.arange(len(prints)), place(prints)
    for half in range(2):
        part = (at >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)
        tag = np.uint64(half << 32)
        own.append(index)
        cells.append(part | tag)
        for s in range(16):
            unit = np.uint64(1 << (2 * s))
            n = (part >> np.uint64(2 * s)) & np.uint64(3)
            for mask, moved in ((n < 2, part + unit), (n > 0, part - unit)):
                own.append(index[mask])
                cells.append(moved[mask] | tag)
    return np.concatenate(own), np.concatenate(cells)


def linked(prints: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (i, j) that join what is within `bits` of each other, directly or through others, in one
    cell: each found element leaves the pool, so a dense group of n costs about n links, not n squared."""
    left, right = [], []
    pool = np.arange(len(prints))
    while len(pool):
        queue, pool = [pool[0]], pool[1:]
        while queue and len(pool):
            at = queue.pop()
            near = np.bitwise_count(prints[pool] ^ prints[at]) <= bits
            found = pool[near]
            if len(found):
                pool = pool[~near]
                queue += found.tolist()
                left.append(np.full(len(found), at))
                right.append(found)
    empty = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (empty, empty)


def links(prints: DataFrame, bits: int = BITS) -> DataFrame:
    """Links (a, b) among rows (node, fingerprint) of different fingerprints, enough to join all that
    are within `bits` (at most 4) of each other."""
    if bits > 4:
        raise ValueError("the halves of the grid cover at most four bits")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, cells = cells_of(b.column("fingerprint").to_numpy().view(np.uint64))
            for i in range(0, len(own), 1 << 16):
                part = pa.array(own[i:i + (1 << 16)])
                yield pa.RecordBatch.from_arrays([pa.array(cells[i:i + (1 << 16)].view(np.int64)), b.column("node").take(part),
                                                  b.column("fingerprint").take(part)], ["cell", "node", "fingerprint"])

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, held = [[np.zeros(0, np.int64)] for _ in range(3)], 0
        for b in batches:
            for i in range(3):
                rest[i].append(b.column(i).to_numpy())
            held += b.num_rows
            if held >= MEET_ROWS:
                cols = [np.concatenate(r) for r in rest]
                done = np.searchsorted(cols[0], cols[0][-1])  # the last cell may go on
                yield from _pairs(*(c[:done] for c in cols), bits)
                rest, held = [[c[done:]] for c in cols], 0
        yield from _pairs(*map(np.concatenate, rest), bits)

    cells = prints.select("node", "fingerprint").mapInArrow(spread, "cell long, node long, fingerprint long")
    parts = max(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return cells.repartition(parts, "cell").sortWithinPartitions("cell").mapInArrow(met, "a long, b long").distinct()


def _pairs(cells: np.ndarray, nodes: np.ndarray, prints: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    if len(cells) < 2:
        return
    prints = prints.view(np.uint64)
    starts = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]])
    sizes = np.diff(np.r_[starts, len(cells)])
    out = []
    short = np.repeat(sizes <= SHORT_RUN, sizes)
    left = np.repeat(starts + sizes, sizes) - np.arange(len(cells))  # elements from here to the run's end
    for step in range(1, SHORT_RUN):
        at = np.flatnonzero(short & (left > step))
        if not len(at):
            break
        at = at[np.bitwise_count(prints[at] ^ prints[at + step]) <= bits]
        out.append((at, at + step))
    for start, size in zip(starts[sizes > SHORT_RUN].tolist(), sizes[sizes > SHORT_RUN].tolist()):
        a, b = linked(prints[start:start + size], bits)
        out.append((start + a, start + b))
    a, b = (nodes[np.concatenate(x)] for x in zip(*out)) if out else (nodes[:0], nodes[:0])
    if len(a):
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])


def near_duplicates(docs: DataFrame, words: int = WORDS, bits: int = BITS) -> DataFrame:
    """doc_id, fingerprint (long), component_id of every row of `docs` (doc_id, text). Rows with equal
    fingerprints are linked, and so are fingerprints that differ in at most `bits` bits; component_id is
    the smallest doc_id reachable. A text without words (null, empty) has fingerprint zero and is linked
    like any other. A row with a null doc_id gets a fingerprint and the component of its fingerprint's
    other rows, if any, else null. Repeated rows stay repeated; other columns are ignored."""
    rows = stored(fingerprints(docs, words), "prints")
    groups = stored(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("size")), "groups")
    roots = components(links(groups.filter("node is not null"), bits))
    groups = stored(groups.join(roots, "node", "left")
                    .select("fingerprint", "size", F.coalesce("root", "node").alias("component_id")), "groups")
    return attach(rows, groups, ["fingerprint"], "size", rows.count(), "doc_id").drop("size")
