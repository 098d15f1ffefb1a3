"""Byte-level BPE by a rank queue.

Pairs of neighbouring symbols wait in buckets, one per merge rank; a hierarchy of 64-bit words says which
buckets are not empty, so the lowest rank is found by three find-first-set steps. A pre-token is a linked
list of symbols and the buckets hold positions in it; an entry whose pair is gone is stale and is skipped. A merge
takes constant time besides the queue, which suits pre-tokens of any length.

Pre-tokens of usual size are queued together: their lists lie in flat arrays, and a bucket gives up the
leftmost entry of every pre-token at once. Pre-tokens don't touch, so each one sees its own merges in the
order it would see alone.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.pretokens import BUFFER_CHARS, Split, buffers, gathered, laid_out, split

#: Longer pre-tokens are queued alone.
LONG_BYTES = 512
#: Pre-tokens kept from one run of texts to the next.
CACHE_TOKENS = 400_000
#: Characters whose new pre-tokens are queued together.
RUN_CHARS = 1 << 25


class RankQueue:
    """Buckets by rank. first() is the lowest rank with entries, or -1."""

    def __init__(self, ranks: int):
        self.buckets: dict[int, list] = defaultdict(list)
        self.levels = []
        while True:
            ranks = (ranks + 63) >> 6
            self.levels.append([0] * ranks)
            if ranks == 1:
                break

    def push(self, rank: int, entry) -> None:
        self.buckets[rank].append(entry)
        self.mark(rank)

    def mark(self, rank: int) -> None:
        for words in self.levels:
            at, bit = rank >> 6, 1 << (rank & 63)
            if words[at] & bit:
                return
            words[at] |= bit
            rank = at

    def first(self) -> int:
        at = 0
        for words in reversed(self.levels):
            word = words[at]
            if not word:
                return -1
            at = at << 6 | (word & -word).bit_length() - 1
        return at

    def clear(self, rank: int) -> None:
        for words in self.levels:
            at = rank >> 6
            words[at] &= ~(1 << (rank & 63))
            if words[at]:
                return
            rank = at


class Bpe:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.size = ranks, max(ranks.values()) + 1
        self.tokens = {r: t for t, r in ranks.items()}
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.pairs = {ranks[t[:i]] << 32 | ranks[t[i:]]: r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        keys = np.fromiter(self.pairs, np.int64, len(self.pairs))
        order = np.argsort(keys)
        self.keys, self.values = keys[order], np.fromiter(self.pairs.values(), np.int64, len(keys))[order]
        self.cache: dict[str, list[int]] = {}

    @classmethod
    def load(cls, path: str) -> Bpe:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge ranks of pairs, -1 where there is none."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], -1)

    def encode_long(self, data: bytes) -> list[int]:
        """One pre-token, entry by entry."""
        n = len(data)
        sym = self.of_byte[np.frombuffer(data, np.uint8)].tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue, get = RankQueue(self.size), self.pairs.get

        def add(i: int) -> None:
            rank = get(sym[i] << 32 | sym[after[i]]) if after[i] < n else None
            if rank is not None:
                heapq.heappush(queue.buckets[rank], i)
                queue.mark(rank)

        for i in range(n - 1):
            add(i)
        while (rank := queue.first()) >= 0:
            bucket = queue.buckets[rank]
            i = heapq.heappop(bucket)  # the leftmost
            if not bucket:
                queue.clear(rank)
            j = after[i]
            if sym[i] < 0 or j >= n or get(sym[i] << 32 | sym[j]) != rank:
                continue
            sym[i], sym[j] = rank, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                add(i)
            if before[i] >= 0:
                add(before[i])
        return [s for s in sym if s >= 0]

    def encode_batch(self, words: list[bytes]) -> list[list[int]]:
        """Pre-tokens queued together, entries of one bucket taken for all of them at once."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        n = int(sizes.sum())
        if not n:
            return [[] for _ in words]
        sym = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), sizes)
        ends = np.cumsum(sizes)[sizes > 0] - 1
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends] = -1
        before[(ends + 1)[:-1]] = -1
        now = np.full(n, -1)  # rank of the pair that begins here
        left = np.flatnonzero(after >= 0)
        now[left] = self.rank_of(sym[left], sym[left + 1])
        queue = RankQueue(self.size)

        def add(at: np.ndarray) -> None:
            rank = now[at]
            at, rank = at[rank >= 0], rank[rank >= 0]
            if len(at) == 1:
                queue.push(int(rank[0]), at)
            elif len(at):
                order = np.argsort(rank, kind="stable")
                at, rank = at[order], rank[order]
                cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
                for r, part in zip(rank[np.r_[0, cuts]].tolist(), np.split(at, cuts)):
                    queue.push(r, part)

        add(left)
        while (rank := queue.first()) >= 0:
            bucket = queue.buckets.pop(rank)
            queue.clear(rank)
            at = bucket[0] if len(bucket) == 1 else np.unique(np.concatenate(bucket))
            at = np.sort(at[now[at] == rank])  # the others are stale
            if not len(at):
                continue
            own = word[at]
            lead = np.r_[True, own[1:] != own[:-1]]
            if not lead.all():
                queue.push(rank, at[~lead])
                at = at[lead]
            right = after[at]
            far = after[right]
            sym[at], now[right], sym[right], after[at] = rank, -1, -1, far
            here, prev = at[far >= 0], before[at]
            prev = prev[prev >= 0]
            before[far[far >= 0]] = here
            now[at] = -1
            now[here] = self.rank_of(sym[here], sym[after[here]])
            now[prev] = self.rank_of(sym[prev], sym[after[prev]])
            add(np.concatenate([here, prev]))
        alive = sym >= 0
        ids = sym[alive].tolist()
        cuts = np.r_[0, np.cumsum(np.bincount(word[alive], minlength=len(words)))].tolist()
        return [ids[a:b] for a, b in zip(cuts, cuts[1:])]

    def learn(self, words: list[str]) -> None:
        """Afterwards the cache has every one of `words`."""
        if len(self.cache) > CACHE_TOKENS:
            self.cache.clear()
        new = list({w for w in words if w not in self.cache})
        raw = [w.encode() for w in new]
        short = [i for i, r in enumerate(raw) if len(r) <= LONG_BYTES]
        self.cache.update(zip((new[i] for i in short), self.encode_batch([raw[i] for i in short])))
        self.cache.update((w, self.encode_long(r)) for w, r in zip(new, raw) if len(r) > LONG_BYTES)

    def encode(self, texts: list[str]) -> Iterator[list[np.ndarray]]:
        """Ids of each text, a list for each run of texts."""
        parts: list[Split] = [split(texts[lo:hi]) for lo, hi in buffers(texts, BUFFER_CHARS)]
        self.learn([w for p in parts for w in p.distinct])
        for p in parts:
            known = [self.cache[w] for w in p.distinct]
            sizes = np.fromiter(map(len, known), np.int64, len(known))
            ids, own = laid_out(np.fromiter((x for k in known for x in k), np.int64, int(sizes.sum())), sizes, p.index)
            ends = np.r_[0, np.cumsum(own)][np.cumsum(p.counts)]
            yield np.split(ids, ends[:-1])

    def decode(self, ids: list[int]) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in ids])


_LOADED: dict[str, Bpe] = {}


def loaded(path: str) -> Bpe:
    """One encoder, and one cache of pre-tokens, to a worker."""
    if path not in _LOADED:
        _LOADED[path] = Bpe.load(path)
    return _LOADED[path]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids of every row of `docs` (doc_id, text); null text counts as empty and has no ids."""
    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for docs_, texts in gathered(batches, RUN_CHARS):
            for ids in bpe.encode(texts):
                own, docs_ = docs_[:len(ids)], docs_[len(ids):]
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array([i.tolist() for i in ids], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(coded, "doc_id long, ids array<int>")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids joined by one space) and decoded_sha256 (of the bytes
    decoded from the ids) of every row of `docs` (doc_id, text). Null text counts as empty and has no
    ids. Repeated rows stay repeated; an empty table gives an empty result; other columns are ignored."""
    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        decimal = list(map(str, range(bpe.size)))
        for docs_, texts in gathered(batches, RUN_CHARS):
            for runs in bpe.encode(texts):
                own, docs_ = docs_[:len(runs)], docs_[len(runs):]
                rows = []
                for ids in map(np.ndarray.tolist, runs):
                    rows.append((len(ids), hashlib.sha256(" ".join([decimal[i] for i in ids]).encode()).hexdigest(),
                                 hashlib.sha256(bpe.decode(ids)).hexdigest()))
                counts, shas, backs = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(counts, pa.int64()), pa.array(shas), pa.array(backs)],
                                                 ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        coded, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
