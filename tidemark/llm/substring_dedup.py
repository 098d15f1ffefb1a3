"""Removal of repeated word windows.

Documents are grouped into ranges of doc_id. A range hashes every window of `span` words by Rabin-Karp
rolling sums over 64-bit word hashes, twice with independent hashes. Windows are counted in two rounds
of shuffles, both from range to shard and back:

1. each range sends each distinct short hash (32 bits within its shard) once; the shard answers which
   of them other ranges sent too. Few windows that do not repeat pass.
2. windows left over, or repeated within their range, go with all 128 bits; the shard answers which of
   them an earlier range holds.

Hashes travel packed per (range, shard), so a window costs four bytes in the first round, and a window
that a third of all documents share costs one entry per range. Every window is counted; the number of
shards grows with the text. A range then removes the words of windows that start earlier too.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut_points, range_of

SPAN = 20
RANGE_ROWS = 256
#: Bytes of text to a shard of the first round; about a million windows.
SHARD_BYTES = 8 << 20
SHARDS_MOST = 1 << 16
BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def rolling(hashes: np.ndarray, span: int, base: np.uint64) -> np.ndarray:
    """Hash of each run of `span` items modulo 2**64, by doubling."""
    out, width = np.zeros(len(hashes) + 1, np.uint64), 0
    for bit in bin(span)[2:]:
        if width:
            out = out[:len(out) - width] * np.uint64(pow(int(base), width, 1 << 64)) + out[width:]
            width *= 2
        if bit == "1":
            n = min(len(out), len(hashes) - width)
            out = out[:n] * base + hashes[width:width + n] if n > 0 else np.zeros(0, np.uint64)
            width += 1
    return out


class Windows:
    """The windows of a range's documents, in order of (doc_id, text) and start."""

    def __init__(self, docs: pa.Table, span: int):
        ids, texts = docs.column("doc_id").to_pylist(), docs.column("text").to_pylist()
        self.order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0, texts[i] or ""))
        self.words = [(texts[i] or "").encode().split() for i in self.order]
        flat = [w for ws in self.words for w in ws]
        raw = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, flat)), np.uint64).reshape(-1, 2)
        self.sizes = np.array([len(ws) for ws in self.words], np.int64)
        ends = np.repeat(np.cumsum(self.sizes), self.sizes)
        self.total = len(flat)
        self.starts = np.flatnonzero(np.arange(self.total) + span <= ends)
        if self.total >= span:
            self.a, self.b = (rolling(raw[:, i].copy(), span, BASES[i])[self.starts] for i in (0, 1))
        else:
            self.a = self.b = np.zeros(0, np.uint64)


def short_keys(w: Windows, bits: int) -> np.ndarray:
    """The shard in the high half, 32 more bits in the low half."""
    shard = w.a >> np.uint64(64 - bits) if bits else np.zeros(len(w.a), np.uint64)
    return shard << np.uint64(32) | w.a & np.uint64(0xFFFFFFFF)


def answered(replies: pa.Table, shards: np.ndarray) -> np.ndarray:
    """The shards' bits laid out along the keys sent, which are sorted by shard."""
    out = np.zeros(len(shards), bool)
    starts = np.flatnonzero(np.r_[True, shards[1:] != shards[:-1]]) if len(shards) else []
    at = dict(zip(shards[starts].tolist(), starts))
    for shard, n, bits in zip(*(replies.column(c).to_pylist() for c in ("shard", "n", "bits"))):
        out[at[shard]:at[shard] + n] = np.unpackbits(np.frombuffer(bits, np.uint8), count=n)
    return out


def packed(part: int, shards: np.ndarray, keys: np.ndarray) -> pa.Table:
    """One row per shard with its slice of `keys`, which are sorted by shard."""
    starts = np.flatnonzero(np.r_[True, shards[1:] != shards[:-1]]) if len(shards) else np.zeros(0, int)
    stops = np.r_[starts[1:], len(shards)] if len(shards) else starts
    return pa.table({"part": pa.array([part] * len(starts), pa.int64()), "shard": pa.array(shards[starts].astype(np.int64)),
                     "keys": pa.array([keys[a:b].tobytes() for a, b in zip(starts.tolist(), stops.tolist())], pa.binary())})


SENT = "part long, shard long, keys binary"
REPLY = "part long, shard long, n long, bits binary"


def _reply(sent: pa.Table, flags: list[np.ndarray]) -> pa.Table:
    return pa.table({"part": sent.column("part"), "shard": sent.column("shard"), "n": pa.array([len(f) for f in flags], pa.int64()),
                     "bits": pa.array([np.packbits(f).tobytes() for f in flags], pa.binary())})


def _elsewhere(sent: pa.Table) -> pa.Table:
    """Round 1, in a shard: which short hashes more than one range sent."""
    own = [np.frombuffer(k, np.uint32) for k in sent.column("keys").to_pylist()]
    keys = np.concatenate(own)
    held = np.sort(keys)
    twice = np.unique(held[1:][held[1:] == held[:-1]])
    flags = twice[np.minimum(np.searchsorted(twice, keys), len(twice) - 1)] == keys if len(twice) else np.zeros(len(keys), bool)
    return _reply(sent, np.split(flags, np.cumsum([len(k) for k in own])[:-1]))


def _earlier(sent: pa.Table) -> pa.Table:
    """Round 2, in a shard: which hashes an earlier range sent."""
    raw = [np.frombuffer(k, np.uint64).reshape(-1, 2) for k in sent.column("keys").to_pylist()]
    sizes = [len(r) for r in raw]
    keys, part = np.concatenate(raw), np.repeat(sent.column("part").to_numpy(), sizes)
    order = np.lexsort((part, keys[:, 1], keys[:, 0]))
    same = np.r_[False, (keys[order[1:]] == keys[order[:-1]]).all(axis=1)]
    flags = np.zeros(len(keys), bool)
    flags[order] = same
    return _reply(sent, np.split(flags, np.cumsum(sizes)[:-1]))


def _long_keys(w: Windows, bits: int, replies: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows that round 1 leaves over: their indices; distinct 128-bit keys; for each window its key; each key's first window."""
    keys, back, n = np.unique(short_keys(w, bits), return_inverse=True, return_counts=True)
    open_ = (answered(replies, keys >> np.uint64(32)) | (n > 1))[back]
    at = np.flatnonzero(open_)
    both = np.stack([w.a[at], w.b[at]], axis=1)
    order = np.lexsort((at, both[:, 1], both[:, 0]))
    new = np.r_[True, (both[order[1:]] != both[order[:-1]]).any(axis=1)] if len(at) else np.zeros(0, bool)
    back = np.empty(len(at), np.int64)
    back[order] = np.cumsum(new) - 1
    return at, both[order[new]], back, order[new]


def dedup(docs: DataFrame, span: int = SPAN, range_rows: int = RANGE_ROWS, shard_bytes: int = SHARD_BYTES, whole: bool = False) -> DataFrame:
    """doc_id, kept (the words left, joined by one space), n_words, n_removed of every row of `docs`
    (doc_id, text), and `spans`, the maximal removed intervals of word positions. A word goes if some
    window of `span` words that covers it has the same words as one that starts earlier: in a smaller
    doc_id, or earlier in the same document. Null text has no words. Rows with a null doc_id come before
    all others, rows that share a doc_id in order of their text; identical rows lose all but one. An
    empty table gives an empty result; other columns are ignored.

    With `whole`, the rows of `docs` themselves with all their columns, whose text is replaced by what is
    kept where words go."""
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    docs = docs if whole else docs.select(F.col("doc_id").cast("long"), "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(SHARDS_MOST, max(16, size // shard_bytes)).bit_length()
    cuts = cut_points(docs, "doc_id", range_rows)
    parts = docs.withColumn("_part", F.coalesce(range_of("doc_id", cuts), F.lit(-1)))

    def first(group: pa.Table) -> pa.Table:
        keys = np.unique(short_keys(Windows(group, span), bits))
        return packed(group.column("_part")[0].as_py(), keys >> np.uint64(32), keys.astype(np.uint32))

    def second(group: pa.Table, replies: pa.Table) -> pa.Table:
        _, keys, _, _ = _long_keys(Windows(group, span), bits, replies)
        return packed(group.column("_part")[0].as_py(), keys[:, 0] >> np.uint64(64 - bits), keys)

    def third(group: pa.Table, first_replies: pa.Table, replies: pa.Table) -> pa.Table:
        w = Windows(group, span)
        at, keys, back, lead = _long_keys(w, bits, first_replies)
        gone = answered(replies, keys[:, 0] >> np.uint64(64 - bits))[back]
        is_lead = np.zeros(len(at), bool)
        is_lead[lead] = True
        starts = w.starts[at[gone | ~is_lead]]
        turns = np.bincount(starts, minlength=w.total + 1) - np.bincount(starts + span, minlength=w.total + 1)
        removed = np.cumsum(turns)[:w.total] > 0
        kept, spans, n_removed, base = [], [], [], 0
        for words in w.words:
            own = removed[base:base + len(words)]
            base += len(words)
            n_removed.append(int(own.sum()))
            kept.append(b" ".join(x for x, r in zip(words, own.tolist()) if not r).decode() if n_removed[-1] else b" ".join(words).decode())
            turns = np.flatnonzero(np.diff(np.r_[0, own.astype(np.int8), 0]))
            spans.append([{"start": a, "stop": b} for a, b in turns.reshape(-1, 2).tolist()])
        if whole:
            order = pa.array(w.order, pa.int64())
            group = group.drop_columns(["_part"]).take(order)
            texts = [k if n else t for k, n, t in zip(kept, n_removed, group.column("text").to_pylist())]
            return group.set_column(group.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))
        return pa.table({"doc_id": group.column("doc_id").take(pa.array(w.order, pa.int64())).combine_chunks(), "kept": pa.array(kept, pa.string()),
                         "n_words": pa.array(w.sizes), "n_removed": pa.array(n_removed, pa.int64()),
                         "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))})

    def last(group: pa.Table, replies: pa.Table) -> pa.Table:
        turn = replies.column("turn").to_numpy()
        return third(group, replies.filter(pa.array(turn == 1)), replies.filter(pa.array(turn == 2)))

    by_part = parts.groupBy("_part")
    one = by_part.applyInArrow(first, SENT).groupBy("shard").applyInArrow(_elsewhere, REPLY)
    two = by_part.cogroup(one.groupBy("part")).applyInArrow(second, SENT).groupBy("shard").applyInArrow(_earlier, REPLY)
    both = one.withColumn("turn", F.lit(1)).union(two.withColumn("turn", F.lit(2)))
    return by_part.cogroup(both.groupBy("part")).applyInArrow(
        last, ddl if whole else "doc_id long, kept string, n_words long, n_removed long, spans array<struct<start: long, stop: long>>")
