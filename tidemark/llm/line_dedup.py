"""Reversible line dedup.

The truth is two tables: holders (key, doc_id, ...), one row per line key and text, and counts (key,
n_docs, first_doc), exact reference counts. Keys that at least two documents hold also stand in
cuckoo filters, one per shard of the key space; a filter supports deletion, so taking documents out
undoes what they brought in. Lines are first tried against the filters, and only those that a filter
may hold are looked up in the exact table. A key is the 128-bit BLAKE2 digest of the stripped,
ASCII-lower-cased line.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SPACES, attach, stored

STRIP = SPACES.encode()
MIN_CHARS = 10
SHARD_KEYS = 1 << 15
SHARDS_MOST = 1 << 15
#: Filters go to the tasks only up to this size together; beyond it every line is looked up exactly.
FILTER_BYTES = 48 << 20


class CuckooFilter:
    """16-bit marks, four to a bucket. A mark has two buckets; either is found from the other."""

    SLOTS, KICKS = 4, 500

    def __init__(self, room: int, table: np.ndarray | None = None):
        size = 1 << max(1, int(np.ceil(room / self.SLOTS / 0.85)) - 1).bit_length()
        self.table = np.zeros((size, self.SLOTS), np.uint16) if table is None else table
        self.mask = len(self.table) - 1

    @classmethod
    def of(cls, keys: list[bytes]) -> CuckooFilter:
        room = max(8, len(keys))
        while True:
            made = cls(room)
            if all(made.insert(k) for k in keys):
                return made
            room *= 2

    @staticmethod
    def from_bytes(data: bytes) -> CuckooFilter:
        return CuckooFilter(0, np.frombuffer(data, np.uint16).reshape(-1, CuckooFilter.SLOTS).copy())

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    def _place(self, key: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(key[4:6], "little") or 1
        first = int.from_bytes(key[6:12], "little") & self.mask
        return mark, first, self._other(first, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * 0x5BD1E995)) & self.mask

    def insert(self, key: bytes) -> bool:
        """False if the filter is full; it must then be built anew with more room."""
        mark, a, b = self._place(key)
        for at in (a, b):
            free = np.flatnonzero(self.table[at] == 0)
            if len(free):
                self.table[at, free[0]] = mark
                return True
        for kick in range(self.KICKS):
            slot = (mark + kick) % self.SLOTS
            mark, self.table[a, slot] = int(self.table[a, slot]), mark
            a = self._other(a, mark)
            free = np.flatnonzero(self.table[a] == 0)
            if len(free):
                self.table[a, free[0]] = mark
                return True
        return False

    def delete(self, key: bytes) -> bool:
        mark, a, b = self._place(key)
        for at in (a, b):
            held = np.flatnonzero(self.table[at] == mark)
            if len(held):
                self.table[at, held[0]] = 0
                return True
        return False

    def holds(self, marks: np.ndarray, places: np.ndarray) -> np.ndarray:
        """For many keys at once: `marks` of 16 bits and `places` of 48."""
        marks = np.where(marks == 0, 1, marks).astype(np.uint16)
        a = (places & np.uint64(self.mask)).astype(np.int64)
        b = (a ^ (marks.astype(np.int64) * 0x5BD1E995)) & self.mask
        return ((self.table[a] == marks[:, None]) | (self.table[b] == marks[:, None])).any(axis=1)


@dataclass(frozen=True)
class State:
    holders: DataFrame  # key binary, doc_id long, text_hash long, places array<int>: the lines of a text with that key
    counts: DataFrame   # key binary, n_docs long, first_doc long
    filters: DataFrame  # shard int, cells binary
    shards: int


def key_of(line: bytes, least: int = MIN_CHARS) -> bytes | None:
    """Key of a line; None if it has fewer than `least` code points."""
    line = line.strip(STRIP).lower()
    if len(line) < least or len(line) < 4 * least and len(line.decode("utf-8", "replace")) < least:
        return None
    return hashlib.blake2b(line, digest_size=16).digest()


HOLDERS = "key binary, doc_id long, text_hash long, places array<int>"


def holders_of(docs: DataFrame, least: int = MIN_CHARS) -> DataFrame:
    """The keys of each text and the places, from 0, of the lines that have them."""
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, text_hash, raw in zip(*(c.to_pylist() for c in b.columns)):
                own: dict[bytes, list[int]] = {}
                for i, line in enumerate(raw.split(b"\n")):
                    if k := key_of(line, least):
                        own.setdefault(k, []).append(i)
                rows += [(k, doc, text_hash, places) for k, places in own.items()]
            cols = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int32())))],
                                             ["key", "doc_id", "text_hash", "places"])

    texts = docs.filter("doc_id is not null and text is not null")
    return texts.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary")).mapInArrow(keys, HOLDERS)


def count(holders: DataFrame, repeats: bool = False) -> DataFrame:
    """Reference counts; with `repeats`, texts that share a doc_id count once."""
    holders = holders.select("key", "doc_id").distinct() if repeats else holders
    return holders.groupBy("key").agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("first_doc"))


def shard_of(key: str, shards: int):
    return F.pmod(F.conv(F.hex(F.substring(key, 1, 4)), 16, 10).cast("long"), F.lit(shards)).cast("int")


def build(docs: DataFrame, least: int = MIN_CHARS) -> State:
    """State of `docs`; rows that repeat a doc_id are one document."""
    holders = stored(holders_of(docs, least), "holders")
    counts = stored(count(holders, _repeats(docs)), "counts")
    shards = min(SHARDS_MOST, 1 + counts.filter("n_docs > 1").count() // SHARD_KEYS)
    return State(holders, counts, stored(_filters(counts.filter("n_docs > 1").select("key"), shards), "filters"), shards)


def _repeats(docs: DataFrame) -> bool:
    return not docs.groupBy("doc_id").count().filter("count > 1").isEmpty()


def _filters(keys: DataFrame, shards: int) -> DataFrame:
    def made(group: pa.Table) -> pa.Table:
        cells = CuckooFilter.of(group.column("key").to_pylist()).to_bytes()
        return pa.table({"shard": group.column("shard")[:1], "cells": pa.array([cells], pa.binary())})

    return keys.withColumn("shard", shard_of("key", shards)).groupBy("shard").applyInArrow(made, "shard int, cells binary")


def insert(state: State, docs: DataFrame, least: int = MIN_CHARS) -> State:
    """The state with more documents; documents it already has add nothing."""
    known = state.holders.select("doc_id").distinct()
    new = stored(holders_of(docs, least).join(known, "doc_id", "left_anti").select(*state.holders.columns), "holders")
    more = count(new, True).select("key", F.col("n_docs").alias("more"), F.col("first_doc").alias("lower"))
    counts = stored(state.counts.join(more, "key", "full").select(
        "key", (F.coalesce("n_docs", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("n_docs"),
        F.least("first_doc", "lower").alias("first_doc"), F.coalesce("n_docs", F.lit(0)).alias("was")), "counts")
    edits = counts.filter("n_docs > 1 and was < 2").select("key", F.lit(True).alias("add"))
    return State(state.holders.union(new), counts.drop("was"), _edited(state, edits, counts), state.shards)


def delete(state: State, ids: DataFrame) -> State:
    """The state without the documents of `ids` (doc_id), as if they had never been inserted."""
    ids = ids.select("doc_id").distinct()
    gone = state.holders.join(ids, "doc_id", "left_semi").select("key").distinct()
    left = stored(state.holders.join(ids, "doc_id", "left_anti").select(*state.holders.columns), "holders")
    anew = count(left.join(gone, "key", "left_semi"), True)
    old = state.counts.join(gone, "key", "left_semi").select("key", F.col("n_docs").alias("was"))
    changed = stored(old.join(anew, "key", "left"), "counts")
    counts = stored(state.counts.join(gone, "key", "left_anti").union(changed.filter("n_docs is not null").select("key", "n_docs", "first_doc")), "counts")
    edits = changed.filter("was > 1 and coalesce(n_docs, 0) < 2").select("key", F.lit(False).alias("add"))
    return State(left, counts, _edited(state, edits, counts), state.shards)


def _edited(state: State, edits: DataFrame, counts: DataFrame) -> DataFrame:
    """Filters after insertions and deletions. A shard that overflows is built anew from the exact counts."""
    def made(filters: pa.Table, changes: pa.Table) -> pa.Table:
        shard = (filters if filters.num_rows else changes).column("shard")[0].as_py()
        own = CuckooFilter.from_bytes(filters.column("cells")[0].as_py()) if filters.num_rows else CuckooFilter(SHARD_KEYS // 4)
        full = False
        for key, add in zip(changes.column("key").to_pylist(), changes.column("add").to_pylist()):
            full |= not own.insert(key) if add else not own.delete(key)
        return pa.table({"shard": pa.array([shard], pa.int32()), "cells": pa.array([None if full else own.to_bytes()], pa.binary())})

    edits = edits.withColumn("shard", shard_of("key", state.shards))
    done = stored(state.filters.groupBy("shard").cogroup(edits.groupBy("shard")).applyInArrow(made, "shard int, cells binary"), "filters")
    full = done.filter("cells is null").select("shard")
    if full.isEmpty():
        return done
    keys = counts.filter("n_docs > 1").select("key", shard_of("key", state.shards).alias("shard")).join(full, "shard", "left_semi")
    return stored(done.filter("cells is not null").union(_filters(keys.select("key"), state.shards)), "filters")


def candidates(state: State) -> DataFrame:
    """Holders whose key a filter may hold. With filters too large to send, all holders."""
    size = state.filters.agg(F.sum(F.octet_length("cells"))).first()[0] or 0
    if size > FILTER_BYTES:
        return state.holders
    spark, shards = state.holders.sparkSession, state.shards
    sent = spark.sparkContext.broadcast({r["shard"]: bytes(r["cells"]) for r in state.filters.collect()})

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = {s: CuckooFilter.from_bytes(c) for s, c in sent.value.items()}
        for b in batches:
            if not b.num_rows:
                continue
            raw = np.frombuffer(b"".join(b.column("key").to_pylist()), np.uint8).reshape(-1, 16)
            shard = raw[:, :4].copy().view(">u4").ravel() % shards
            marks = raw[:, 4:6].copy().view("<u2").ravel()
            places = np.zeros((len(raw), 8), np.uint8)
            places[:, :6] = raw[:, 6:12]
            places = places.view("<u8").ravel()
            maybe = np.zeros(len(raw), bool)
            for s in np.unique(shard).tolist():
                if s in filters:
                    own = np.flatnonzero(shard == s)
                    maybe[own] = filters[s].holds(marks[own], places[own])
            yield b.filter(pa.array(maybe))

    return state.holders.mapInArrow(probed, HOLDERS)


def drops(state: State) -> DataFrame:
    """(doc_id, text_hash, places): the lines a text loses, a document with a smaller id holding their keys."""
    counts = stored(state.counts.filter("n_docs > 1"), "repeated")
    total = state.holders.count()
    found = attach(candidates(state), counts, ["key"], "n_docs", total, "doc_id")
    return found.filter("first_doc < doc_id").groupBy("doc_id", "text_hash").agg(F.flatten(F.collect_list("places")).alias("places"))


def apply(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """`docs` with `text` rid of the lines of `gone`, and n_lines, n_dropped. A null text becomes empty."""
    gone = gone.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.col("places").alias("_places"))
    out = docs.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("_own", F.xxhash64("text"))
    out = out.join(gone, (F.col("doc_id") == F.col("_id")) & (F.col("_own") == F.col("_hash")), "left")
    lines = F.split("text", "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_places"))  # by hash, so long texts are no worse
    rest = F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")
    text = F.when(F.col("_places").isNull(), F.col("text")).otherwise(rest)
    return out.select(*[text.alias("text") if c == "text" else F.col(c) for c in docs.columns], F.size(lines).cast("long").alias("n_lines"),
                      F.coalesce(F.size("_places"), F.lit(0)).cast("long").alias("n_dropped"))


def dedup(docs: DataFrame, least: int = MIN_CHARS) -> DataFrame:
    """`docs` (doc_id, text and any other columns, none named n_lines or n_dropped) with its repeated
    lines gone: a key of `least` code points or more that several documents hold stays only in the
    smallest doc_id, with all its lines there. Null or empty text is one empty line. Rows with a null
    doc_id neither lose lines nor take any away; rows that share a doc_id are one document. Ties don't
    arise; an empty table gives an empty one."""
    state = build(docs.select("doc_id", "text"), least)
    return apply(docs, drops(state))
