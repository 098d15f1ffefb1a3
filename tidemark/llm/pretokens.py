"""The split of byte-level BPE in whole arrays of code points, and texts as indices of distinct pre-tokens.

The pattern is `'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+`. Read as rules
on classes of code points: a run of one class is a pre-token; a space glues to the run after it; the last
character of a white-space run before text parts from the run; an apostrophe that stands alone and unglued
takes one of the endings from the letters after it.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import regex

OTHER, LETTER, NUMBER, WHITE = range(4)
#: White space of the pattern's \s.
SPACE_CHARS = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
BUFFER_CHARS = 1 << 22


@cache
def classes() -> np.ndarray:
    """Class of each code point."""
    out = np.zeros(sys.maxunicode + 1, np.uint8)
    points = "".join(map(chr, [c for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for m in regex.finditer(pattern, points):
            out[[ord(m[0][0]), ord(m[0][-1])]] = kind
            out[ord(m[0][0]):ord(m[0][-1]) + 1] = kind
    out[SPACE_CHARS] = WHITE
    return out


def starts_of(points: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Where pre-tokens start in code points of texts that start at `docs` (ascending)."""
    n = len(points)
    kind = classes()[points]
    cut = np.zeros(n + 1, bool)  # runs of one class
    cut[1:n] = kind[1:] != kind[:-1]
    cut[docs] = True
    cut[n] = True
    edge = np.zeros(n + 1, bool)
    edge[docs] = True
    edge[n] = True
    start = cut[:n].copy()
    white_end = np.flatnonzero((kind == WHITE) & cut[1:] & ~edge[1:])  # last white space before text
    start[white_end] = True
    glued = white_end[points[white_end] == 32]
    start[glued + 1] = False
    tick = np.flatnonzero((points == 39) & start)
    tick = tick[tick + 1 < n]
    tick = tick[(kind[tick + 1] == LETTER) & ~edge[tick + 1]]
    if len(tick):
        one = points[tick + 1]
        two = np.where((tick + 2 < n) & ~edge[np.minimum(tick + 2, n)], points[np.minimum(tick + 2, n - 1)], 0)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long_ = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        for hit, size in ((short, 2), (long_, 3)):
            at = tick[hit]
            start[at + 1] = False
            after = at + size
            start[after[after < n]] = True
    return np.flatnonzero(start)


@dataclass
class Split:
    """Pre-tokens of some texts: the distinct ones, the index of each in order, and how many a text has."""

    distinct: list[str]
    index: np.ndarray
    counts: np.ndarray


def split(texts: list[str]) -> Split:
    big = "".join(texts)
    if not big:
        return Split([], np.zeros(0, np.int32), np.zeros(len(texts), np.int64))
    points = np.frombuffer(big.encode("utf-32-le"), np.uint32)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes)
    begins = ends - sizes
    starts = starts_of(points, begins[sizes > 0])
    counts = np.searchsorted(starts, ends) - np.searchsorted(starts, begins)
    lengths = np.diff(np.r_[starts, len(points)])
    inside = np.arange(len(points)) - np.repeat(starts, lengths)
    power = np.multiply.accumulate(np.r_[np.uint64(1), np.full(int(lengths.max()) - 1, 0x9E3779B97F4A7C15, np.uint64)])
    names = np.add.reduceat(points * power[inside], starts) * np.uint64(0xFF51AFD7ED558CCD) + lengths.astype(np.uint64)
    _, lead, index = np.unique(names, return_index=True, return_inverse=True)
    same = starts[lead][index]  # where the pre-token of that name first stands
    if (lengths[lead][index] == lengths).all() and (points[np.repeat(same, lengths) + inside] == points).all():
        a, b = starts[lead], starts[lead] + lengths[lead]
        return Split([big[i:j] for i, j in zip(a.tolist(), b.tolist())], index.astype(np.int32), counts)
    known: dict[str, int] = {}  # two pre-tokens share a name
    index = np.array([known.setdefault(big[i:i + n], len(known)) for i, n in zip(starts.tolist(), lengths.tolist())], np.int32)
    return Split(list(known), index, counts)


def laid_out(values: np.ndarray, sizes: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of `values` (run i has sizes[i]) in the order `index` names them; the size of each."""
    first, own = np.cumsum(sizes) - sizes, sizes[index]
    at = np.repeat(first[index] - (np.cumsum(own) - own), own) + np.arange(int(own.sum()))
    return values[at], own


def buffers(texts: list[str], size: int) -> Iterator[tuple[int, int]]:
    """Runs (from, to) of `texts` of about `size` characters."""
    at = held = 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= size:
            yield at, i + 1
            at, held = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def gathered(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[list, list[str]]]:
    """doc_id and text (null: empty) of the rows, in runs of about `size` characters over the edges of batches."""
    ids, texts, held = [], [], 0
    for b in batches:
        ids += b.column(0).to_pylist()
        new = [t or "" for t in b.column(1).to_pylist()]
        texts += new
        held += sum(map(len, new))
        if held >= size:
            for lo, hi in buffers(texts, size):
                yield ids[lo:hi], texts[lo:hi]
            ids, texts, held = [], [], 0
    for lo, hi in buffers(texts, size):
        yield ids[lo:hi], texts[lo:hi]
