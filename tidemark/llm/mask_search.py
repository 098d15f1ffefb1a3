"""Ranked lexical search by presence masks.

Every document is ranked for each item of a stated query set. One pass over the texts keeps, of each document, its number
of terms and how often it has the items' terms; that table is written once. Counts of documents and terms come from
it. A task then takes its documents in blocks. In a block every term has a bitmap of the documents that hold it and
the highest value it reaches there; an item's bitmaps, read across, give each document the mask of the terms it
matches. Documents with equal masks form one group, whose score can't pass the sum of its terms' highest values. Groups
are evaluated exactly in falling order of that sum until it is below the tenth score found so far, in this block or an
earlier one. A task hands on ten documents per item at most, so no document is shuffled.

Items meet the documents in passes of about `PASS_TERMS` terms, which bounds what a task is sent; each pass reads all
documents.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import runs, stored

TOP = 10
#: Terms of the items that one pass over the documents looks for, about; it bounds what a task is sent.
PASS_TERMS = 32_768
#: A block ends with this many documents or postings.
BLOCK_DOCS = 4096
BLOCK_POSTINGS = 1 << 20
#: A long text is read in pieces of this many bytes, cut between terms.
PIECE = 1 << 22
#: Parts that an item's candidates are first ranked in.
MERGE = 64
#: Bytes that end a term become blanks, A-Z become small letters; bytes of other code points stay.
FOLD = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)).lower()
LAST = np.iinfo(np.int64).max


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, piece by piece."""
    folded, at = text.translate(FOLD), 0
    while len(folded) - at > PIECE:
        end = folded.find(b" ", at + PIECE)
        if end < 0:
            break
        yield folded[at:end].split()
        at = end
    yield folded[at:].split()


@dataclass
class Items:
    """The items of a pass: `terms[i]` are the places of item i's terms in the vocabulary, `weights` theirs."""

    ids: list
    terms: list[np.ndarray]
    vocabulary: dict[bytes, int]
    weights: np.ndarray | None = None


def postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n (terms with repeats), terms (places in the vocabulary) and counts of every row of `docs` that has a term."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for b in batches:
            ns, own, counts, ends = [], [], [], [0]
            for text in b.column("text").to_pylist():
                n, have = 0, Counter()
                for piece in terms(text or b""):
                    n += len(piece)
                    have.update(piece)
                own += (hits := [t for t in have if t in known])
                counts += [have[t] for t in hits]
                ns.append(n)
                ends.append(len(own))
            place = pa.array(np.array([known[t] for t in own], np.int32))
            out = pa.RecordBatch.from_arrays([
                b.column("doc_id"), pa.array(ns, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), place),
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(counts, pa.int64()))], ["doc_id", "n", "terms", "counts"])
            yield out.filter(pa.array(np.array(ns) > 0))

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    return rows.mapInArrow(found, "doc_id long, n long, terms array<int>, counts array<long>")


def weigh(found: DataFrame, items: Items) -> tuple[int, int]:
    """Documents and terms of the corpus; sets the weights of the items' terms. What is collected is bounded by the vocabulary."""
    row = found.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    share = found.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect()
    df = dict.fromkeys(range(len(items.vocabulary)), 0) | {r["term"]: r["df"] for r in share}
    items.weights = np.array([math.floor(1000 * math.log((2 * row["docs"] + 2) / (2 * df[t] + 1))) for t in range(len(df))], np.int64)
    return row["docs"], row["terms"]


@dataclass
class Search:
    """The best documents of each item among the blocks it has been shown."""

    items: Items
    docs: int
    total: int
    best: list = field(default_factory=list)   # of each item: (scores, ids), best first, TOP at most
    groups: int = 0                            # masks seen
    opened: int = 0                            # masks whose documents were scored

    def __post_init__(self):
        none = np.zeros(0, np.int64)
        self.best = [(none, none)] * len(self.items.ids)

    def lengths(self, n: np.ndarray) -> np.ndarray:
        if 90 * int(n.max(initial=0)) * self.docs <= LAST:
            return 10 + 90 * n * self.docs // self.total
        return np.array([10 + 90 * x * self.docs // self.total for x in n.tolist()], np.int64)

    def block(self, ids: np.ndarray, n: np.ndarray, sizes: np.ndarray, term: np.ndarray, count: np.ndarray) -> None:
        """Documents `ids` with `n` terms; document i has the next sizes[i] of the postings (term, count)."""
        m = np.repeat(self.lengths(n), sizes)
        value = self.items.weights[term] * (1_000_000_000 * count // (1000 * count + 8 * m))
        owner = np.repeat(np.arange(len(ids)), sizes)
        use = value > 0
        owner, term, value = owner[use], term[use], value[use]
        first = np.searchsorted(owner, np.arange(len(ids) + 1))
        present, local = np.unique(term, return_inverse=True)
        highest = np.zeros(len(present), np.int64)
        np.maximum.at(highest, local, value)
        held = np.zeros((len(present), len(ids)), bool)
        held[local, owner] = True
        bitmaps = np.packbits(held, axis=1)
        del held
        place = np.full(len(self.items.vocabulary), -1, np.int64)
        place[present] = np.arange(len(present))
        own = np.zeros(len(present), bool)
        for i, mine in enumerate(self.items.terms):
            rows = place[mine]
            rows = rows[rows >= 0]
            if not len(rows):
                continue
            some = np.flatnonzero(np.unpackbits(np.bitwise_or.reduce(bitmaps[rows], axis=0), count=len(ids)))
            masks = np.packbits(np.unpackbits(bitmaps[rows], axis=1, count=len(ids))[:, some], axis=0)
            distinct, group = _distinct(masks)
            ceiling = np.unpackbits(distinct, axis=0, count=len(rows)).T.astype(np.int64) @ highest[rows]
            own[rows] = True
            self.best[i] = self.walk(self.best[i], some, group, ceiling, ids, lambda d: _scores(d, first, local, value, own))
            own[rows] = False

    def walk(self, best, some, group, ceiling, ids, score):
        """Groups in falling order of what they can reach, until that is below the last of TOP held."""
        scores, docs = best
        by_group = np.argsort(group, kind="stable")
        starts = np.searchsorted(group[by_group], np.arange(len(ceiling) + 1))
        order = np.argsort(-ceiling, kind="stable")
        ceiling = ceiling[order]
        at, step = 0, 1
        self.groups += len(order)
        while at < len(order):
            least = int(scores[-1]) if len(scores) == TOP else 1
            upto = min(at + step, int(np.searchsorted(-ceiling, -least, side="right")))
            if upto <= at:
                break
            taken = order[at:upto]
            rows = some[by_group[runs(starts[taken], starts[taken + 1] - starts[taken])]]
            scores, docs = np.concatenate([scores, score(rows)]), np.concatenate([docs, ids[rows]])
            keep = np.lexsort((docs, -scores))[:TOP]
            scores, docs = scores[keep], docs[keep]
            self.opened += upto - at
            at, step = upto, step * 2
        return scores, docs


def _distinct(masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct columns of packed masks, and which of them each column is."""
    words = -(-len(masks) // 8)
    wide = np.zeros((masks.shape[1], 8 * words), np.uint8)
    wide[:, :len(masks)] = masks.T
    keys = wide.view(np.uint64)
    if words == 1:
        _, lead, group = np.unique(keys[:, 0], return_index=True, return_inverse=True)
    else:
        _, lead, group = np.unique(keys, axis=0, return_index=True, return_inverse=True)
    return masks[:, lead], group.reshape(-1)


def _scores(rows: np.ndarray, first: np.ndarray, term: np.ndarray, value: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Sums of the item's terms in these documents; each has a posting."""
    sizes = first[rows + 1] - first[rows]
    at = runs(first[rows], sizes)
    return np.add.reduceat(np.where(own[term[at]], value[at], 0), np.cumsum(sizes) - sizes)


def ranked(found: DataFrame, items: Items, docs: int, total: int) -> DataFrame:
    """item_id, doc_id, score: of each task, the best documents of every item."""
    sent = found.sparkSession.sparkContext.broadcast(items)

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(sent.value, docs, total)
        held, rows, entries = [], 0, 0
        for b in batches:
            for at in range(0, b.num_rows, BLOCK_DOCS):
                part = b.slice(at, BLOCK_DOCS)
                held.append(part)
                rows, entries = rows + part.num_rows, entries + len(part.column("terms").flatten())
                if rows >= BLOCK_DOCS or entries >= BLOCK_POSTINGS:
                    _show(search, held)
                    held, rows, entries = [], 0, 0
        if held:
            _show(search, held)
        for item, (scores, ids) in zip(search.items.ids, search.best):
            yield pa.RecordBatch.from_arrays([
                pa.array([item] * len(ids), pa.int64()), pa.array(ids, mask=ids == LAST), pa.array(scores)], ["item_id", "doc_id", "score"])

    return found.filter(F.size("terms") > 0).mapInArrow(searched, "item_id long, doc_id long, score long")


def _show(search: Search, held: list[pa.RecordBatch]) -> None:
    t = pa.Table.from_batches(held).combine_chunks()
    lists, counts = t.column("terms").combine_chunks(), t.column("counts").combine_chunks()
    search.block(t.column("doc_id").fill_null(LAST).to_numpy(), t.column("n").to_numpy(), np.diff(lists.offsets.to_numpy()).astype(np.int64),
                 lists.flatten().to_numpy(), counts.flatten().to_numpy())


def best_of(rows: DataFrame, top: int = TOP) -> DataFrame:
    """rank of the `top` best rows of each item; first in parts, so an item's candidates are never ranked in one place."""
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    part = F.pmod(F.xxhash64("doc_id"), F.lit(MERGE))
    near = rows.withColumn("_part", part).withColumn("_at", F.row_number().over(Window.partitionBy("item_id", "_part").orderBy(*order)))
    last = near.filter(F.col("_at") <= top).withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order)))
    return last.filter(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, bench: DataFrame, pass_terms: int = PASS_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: the ten documents of `docs` (doc_id, text) with the highest scores above 0 for each
    item of `bench` (item_id, text), equal scores by ascending doc_id.

    Null text has no term, so it counts for nothing and is never found; an item without terms has no rows. Rows that
    share an item_id (null is one too) are one item with the terms of all. Rows that share a doc_id are ranked each for
    itself; a null doc_id comes last among equal scores. An empty table on either side gives no rows. Texts are read in
    pieces, so a very long one is held once, with its terms of one piece. Other columns are ignored, whatever their names."""
    spark = docs.sparkSession

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for item, text in zip(b.column("item_id").to_pylist(), b.column("text").to_pylist()):
                for piece in terms(text or b""):
                    own = list(set(piece))
                    yield pa.RecordBatch.from_arrays([pa.array([item] * len(own), pa.int64()), pa.array(own, pa.binary())], ["item_id", "term"])

    asked = bench.select(F.col("item_id").cast("long"), F.col("text").cast("binary")).mapInArrow(split, "item_id long, term binary")
    asked = stored(asked.distinct(), "asked")
    passes = max(1, math.ceil(2 * asked.count() / pass_terms))
    out = spark.createDataFrame([], "item_id long, doc_id long, score long")
    for p in range(passes):
        rows = asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == p).groupBy("item_id").agg(F.collect_list("term").alias("terms")).collect()
        if not rows:
            continue
        vocabulary: dict[bytes, int] = {}
        own = [np.array([vocabulary.setdefault(bytes(t), len(vocabulary)) for t in r["terms"]], np.int64) for r in rows]
        items = Items([r["item_id"] for r in rows], own, vocabulary)
        found = stored(postings(docs, vocabulary), "postings")
        n, total = weigh(found, items)
        if n:
            out = out.unionByName(ranked(found, items, n, total))
    return best_of(out)
