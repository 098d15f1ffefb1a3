"""Packing documents into sequences of at most `room` tokens.

A document is cut into full sequences and one remainder. The histogram of remainder lengths, which has
`room` bars at any size of the corpus, is packed by shortest-pack-first on the driver: lengths are placed
longest first, each into the emptiest packs that can take it, and packs of one composition are kept as a
pattern with a count. Pieces are ranked within their length and find their pattern, sequence and offset by
that rank. Ranks come from counts per (length, bucket), so a length that a third of all documents share is
ranked in many tasks.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import stored
from tidemark.llm.pretokens import BUFFER_CHARS, gathered, laid_out, split

ROOM, END = 2048, 1
BUCKET_ROWS = 4096


def encoder(path: str):
    """Pre-tokens -> their ids in one array, and how many each has. `path` holds byte-level BPE ranks."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    one = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    def encode(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [(r,) if (r := ranks.get(raw)) is not None else one(raw) for raw in map(str.encode, words)]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter((x for i in ids for x in i), np.uint32, int(sizes.sum())), sizes

    return encode


_LOADED: dict = {}


def added_tokens(path: str) -> dict[str, int]:
    """Added tokens of a `tokenizers` file, which that library takes out of a text before all else. Those that
    need more than their string found are an error."""
    with open(path, encoding="utf-8") as f:
        held = json.load(f)
    for t in held["added_tokens"]:
        if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] and held["normalizer"]:
            raise ValueError(f"added token {t['content']!r} is not matched as it stands")
    return {t["content"]: t["id"] for t in held["added_tokens"]}


def segments(texts: list[str], added: dict[str, int]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The texts cut at added tokens (of those that start at one place, the longest): their segments, the id
    that follows each (-1: none), and how many segments each text has."""
    if not added or not any(a in t for t in texts for a in added):
        return texts, np.full(len(texts), -1), np.ones(len(texts), np.int64)
    pattern = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")")
    cut = [pattern.split(t) for t in texts]  # segment, token, segment, ...
    follows = [added[c[k]] if k < len(c) else -1 for c in cut for k in range(1, len(c) + 1, 2)]
    return [x for c in cut for x in c[::2]], np.array(follows, np.int64), np.array([len(c[::2]) for c in cut], np.int64)


def cut_documents(docs: DataFrame, path: str, room: int = ROOM, end: int = END, added: dict[str, int] | None = None) -> DataFrame:
    """The pieces of every document: doc_id, start, length, ids_crc32, doc_tokens."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _LOADED[path] = _LOADED.get(path) or encoder(path)
        last = end.to_bytes(4, "little")
        for own, texts in gathered(batches, BUFFER_CHARS):
            texts, follows, each = segments(texts, added or {})
            part = split(texts)
            ids, sizes = laid_out(*encode(part.distinct), part.index)
            stops = np.r_[0, np.cumsum(sizes)][np.cumsum(part.counts)]
            put = follows >= 0
            ids = np.insert(ids, stops[put], follows[put])
            data = memoryview(ids.astype("<u4").tobytes())
            stops = (4 * (stops + np.cumsum(put))[np.cumsum(each) - 1]).tolist()
            rows, at = [], 0
            for doc, stop in zip(own, stops):
                mine, n, at = data[at:stop], (stop - at) // 4 + 1, stop
                for a in range(0, n, room):
                    crc = zlib.crc32(mine[4 * a:4 * (a + room)])
                    rows.append((doc, a, min(room, n - a), zlib.crc32(last, crc) if a + room >= n else crc, n))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def shortest_pack_first(histogram: dict[int, int], room: int = ROOM) -> list[tuple[int, tuple[int, ...]]]:
    """Patterns (count, lengths) that hold every length of the histogram (length -> count) as often as
    it occurs. Where no pack has room, as many new packs open as hold the rest of that length."""
    open_: dict[int, list[tuple[int, tuple[int, ...]]]] = defaultdict(list)  # by space left
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            space = max((s for s, packs in open_.items() if packs and s >= length), default=None)
            if space is None:
                each = room // length
                for n, copies in ((left // each, each), (1, left % each)):
                    if n and copies:
                        open_[room - copies * length].append((n, (length,) * copies))
                break
            n, pack = open_[space].pop()
            used = min(n, left)
            if n > used:
                open_[space].append((n - used, pack))
            open_[space - length].append((used, (*pack, length)))
            left -= used
    return [p for packs in open_.values() for p in packs]


def slots_of(patterns: list[tuple[int, tuple[int, ...]]]) -> dict[int, tuple[np.ndarray, ...]]:
    """By length: first rank, first sequence, copies in a sequence and offset of the first copy of each
    run of ranks that one pattern takes."""
    rank: dict[int, int] = defaultdict(int)
    out: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    sequence = 0
    for count, pack in patterns:
        offset = 0
        for length in dict.fromkeys(pack):
            copies = pack.count(length)
            out[length].append((rank[length], sequence, copies, offset))
            rank[length] += count * copies
            offset += copies * length
        sequence += count
    return {length: tuple(np.array(c, np.int64) for c in zip(*rows)) for length, rows in out.items()}


def ranked(parts: DataFrame) -> DataFrame:
    """`parts` with rank, 0 to n - 1 among the pieces of one length."""
    n = parts.count()
    bucket = F.pmod(F.xxhash64("doc_id", "start"), F.lit(1 + n // BUCKET_ROWS))
    parts = parts.withColumn("bucket", bucket)
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = parts.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n")).select(
        "length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    own = Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    return (parts.withColumn("own", F.row_number().over(own) - 1).join(sums, ["length", "bucket"])
            .withColumn("rank", (F.col("before") + F.col("own")).cast("long")).drop("bucket", "before", "own"))


def pack(docs: DataFrame, path: str, room: int = ROOM, end: int = END, added: dict[str, int] | None = None) -> DataFrame:
    """One row per piece of every row of `docs` (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset. The strings of `added` get their ids wherever they stand in a text; without it
    they are ordinary text. Null text counts as empty, so every document has at least the closing id. Rows
    that share a doc_id are packed each for itself; ties in rank are broken by all columns. An empty
    table gives an empty result; other columns are ignored."""
    parts = stored(cut_documents(docs, path, room, end, added), "pieces")
    histogram = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `room` rows
    slots = slots_of(shortest_pack_first(histogram, room))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for x in np.unique(length).tolist():
                at = np.flatnonzero(length == x)
                first, seq, copies, off = slots[x]
                run = np.searchsorted(first, rank[at], side="right") - 1
                more = rank[at] - first[run]
                sequence[at] = seq[run] + more // copies[run]
                offset[at] = off[run] + more % copies[run] * x
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(sequence), pa.array(offset)], [*b.schema.names[:-1], "sequence_id", "offset"])

    return ranked(parts).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank").mapInArrow(
        placed, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
