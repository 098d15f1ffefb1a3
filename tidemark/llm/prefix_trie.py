"""The prefix trie of conversations, from their sorted order.

A turn becomes a 16-byte digest of role and text, a conversation the string of its turns' digests. Equal conversations
collapse (their ids are hashed in order as they do); the distinct ones are sorted by ranges. In a range the number
of turns that neighbours share stands in an array with a sparse table of range minima over it. Each prefix of each
conversation is a candidate; how far left and how far right its members reach is found by binary search on the
table, each for itself. A candidate that reaches no further left is the node, and its counts are differences of running
sums, its smallest member a range minimum. Nodes that reach over the end of a range are partial: their parts add up.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import attach, cut_points, range_of, stored

DIGEST = 16
#: Every conversation takes its first turns from the one whose id ends its run of so many.
FAMILY = 5
#: Turns of a sorted range, about.
RANGE_TURNS = 50_000
#: Rows of a range of ids, about, in which the ids of equal conversations are joined.
RANGE_IDS = 65_536
NO_IDS = hashlib.sha256(b"").hexdigest()
NODE = ("key binary, parent_key binary, conv_id long, parent_conv_id long, depth long, n_convs long, n_children long, "
        "n_leaves long, saved_tokens long, ends_sha256 string")


def rebuilt(turns: DataFrame) -> DataFrame:
    """conv_id, path (digests of its turns, in order) and sizes (UTF-8 bytes of their texts) of every conversation of
    `turns`, each with the first turns of its family's first conversation in place of its own."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 2 * DIGEST)
    rows = turns.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").isNotNull().alias("has"), F.col("turn").cast("long").alias("turn"), role.alias("role"),
                                                                 digest.alias("digest"), F.octet_length(text).cast("long").alias("size")).alias("turn"))
    rows = rows.withColumn("first", F.col("conv_id") - F.col("conv_id") % FAMILY).repartition("first")
    convs = rows.groupBy("first", "conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    heads = convs.filter("conv_id = first").select("first", F.slice("turns", 1, 8).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).cast("int")
    own = F.slice(F.col("turns"), h + 1, F.greatest(F.size("turns") - h, F.lit(0)))
    both = convs.join(heads, "first", "left").withColumn("all", F.when(F.col("head").isNull(), own).otherwise(F.concat(F.slice(F.col("head"), F.lit(1), h), own)))
    return both.select("conv_id", F.unhex(F.array_join(F.transform("all", lambda t: t["digest"]), "")).alias("path"), F.transform("all", lambda t: t["size"]).alias("sizes"))


def distinct(convs: DataFrame, range_ids: int = RANGE_IDS) -> DataFrame:
    """path, sizes, n_convs, conv_id (the smallest) and ends (hash of all ids in ascending order) of equal conversations. Ids
    are joined by ranges first; the hash then reads one string per range, in a stream."""
    part = F.coalesce(range_of("conv_id", cut_points(convs, "conv_id", range_ids)), F.lit(0))
    ids = F.array_sort(F.collect_list("conv_id"))
    chunks = convs.select(F.sha2("path", 256).alias("key"), part.alias("part"), "conv_id", "path", "sizes").groupBy("key", "part").agg(
        F.first("path").alias("path"), F.first("sizes").alias("sizes"), ids.alias("ids"))
    chunks = chunks.select("key", "part", "path", "sizes", F.size("ids").cast("long").alias("n"), F.col("ids")[0].alias("least"),
                           F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = None
        for b in batches:
            rows, out = b.to_pylist(), []
            for r in rows:
                if r["key"] != key:
                    if key is not None:
                        out.append({**lead, "ends": digest.hexdigest()})
                    key, digest = r["key"], hashlib.sha256(r["ids"].encode())
                    lead = {"path": r["path"], "sizes": r["sizes"], "n_convs": r["n"], "conv_id": r["least"]}
                else:
                    digest.update(b"," + r["ids"].encode())
                    lead["n_convs"] += r["n"]
            yield pa.RecordBatch.from_pylist(out, kind)
        if key is not None:
            yield pa.RecordBatch.from_pylist([{**lead, "ends": digest.hexdigest()}], kind)

    kind = pa.schema([("path", pa.binary()), ("sizes", pa.list_(pa.int64())), ("n_convs", pa.int64()), ("conv_id", pa.int64()), ("ends", pa.string())])
    return chunks.repartition("key").sortWithinPartitions("key", "part").mapInArrow(
        hashed, "path binary, sizes array<long>, n_convs long, conv_id long, ends string")


def shared(a: bytes | None, b: bytes | None) -> int:
    """Turns that two paths begin with alike; -1 without a path."""
    if a is None or b is None:
        return -1
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // DIGEST
    x, y = np.frombuffer(a, np.uint8, n), np.frombuffer(b, np.uint8, n)
    return int(np.argmax(x != y)) // DIGEST


class Minima:
    """Sparse table: the least of `values` over any run, from two runs of a power of two."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while (half := 1 << (len(self.levels) - 1)) * 2 <= len(values):
            last = self.levels[-1]
            self.levels.append(np.minimum(last[:-half], last[half:]))

    def least(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Least of lo..hi, both included."""
        level = np.frexp(hi - lo + 1)[1] - 1
        out = np.empty(len(lo), np.int64)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            table = self.levels[k]
            out[at] = np.minimum(table[lo[at]], table[hi[at] + 1 - (1 << int(k))])
        return out

    def reach(self, start: np.ndarray, bound: np.ndarray, step: int) -> np.ndarray:
        """How many values from `start` on (step 1: to the right, -1: to the left) are all `bound` or more."""
        n, got = len(self.levels[0]), np.zeros(len(start), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            size, table = 1 << k, self.levels[k]
            lo = start + got if step > 0 else start - got - size + 1
            inside = (lo >= 0) & (lo + size <= n)
            got += np.where(inside & (table[np.where(inside, lo, 0)] >= bound), size, 0)
        return got


def prefixes(path: bytes, depth: int) -> list[bytes]:
    """Names of the prefixes of 0 to `depth` turns."""
    running, out = hashlib.blake2b(digest_size=16), []
    for d in range(depth + 1):
        out.append(running.digest())
        running.update(path[d * DIGEST:(d + 1) * DIGEST])
    return out


def nodes(paths: list[bytes], sizes: list, n: np.ndarray, conv: np.ndarray, ends: list[str], before: bytes | None, after: bytes | None) -> dict:
    """Nodes of sorted distinct conversations; `before` and `after` are the paths next to them in other ranges. A node that has members
    there too is partial, and has a key; so has the parent of a node if it is partial."""
    rows = len(paths)
    turns = np.array([len(p) // DIGEST for p in paths], np.int64)
    lcp = np.array([shared(before, paths[0])] + [shared(a, b) for a, b in zip(paths, paths[1:])], np.int64)
    beyond = shared(paths[-1], after)
    # candidates: every prefix of every conversation; prefix d of conversation i is at offset[i] + d
    offset = np.concatenate([[0], np.cumsum(turns + 1)])
    row = np.repeat(np.arange(rows), turns + 1)
    depth = np.arange(offset[-1]) - offset[row]
    flat = np.concatenate([np.asarray(s, np.int64) for s in sizes]) if turns.sum() else np.zeros(0, np.int64)
    upto = np.concatenate([[0], np.cumsum(flat)])
    first = np.cumsum(turns) - turns
    prefix = upto[first[row] + depth] - upto[first[row]]  # bytes of the first d turns
    total = upto[first + turns] - upto[first]
    if rows > 1:
        table = Minima(lcp[1:])
        right = row + table.reach(row, depth, 1)
        left = row - table.reach(row - 1, depth, -1)
    else:
        left = right = row
    at = np.flatnonzero(left == row)
    i, d, r = row[at], depth[at], right[at]

    def running(x: np.ndarray) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(x)])

    following = np.concatenate([lcp[1:], [beyond]])
    own = total - prefix[offset[:-1] + np.maximum(lcp, 0)]  # bytes of the nodes that a conversation is the first of
    convs, all_bytes, new_bytes, leaves = running(n), running(n * total), running(own), running((following < turns).astype(np.int64))
    n_convs = convs[r + 1] - convs[i]
    above = prefix[at - (d > 0)]  # bytes above the node's own text
    since = prefix[offset[i] + np.maximum(np.maximum(lcp[i], d - 1), 0)]
    saved = all_bytes[r + 1] - all_bytes[i] - n_convs * above - (new_bytes[r + 1] - new_bytes[i + 1] + total[i] - since)
    places = np.sort((lcp + 1) * (rows + 1) + np.arange(rows))
    children = np.searchsorted(places, (d + 1) * (rows + 1) + r, side="right") - np.searchsorted(places, (d + 1) * (rows + 1) + i, side="right")
    children += (turns[i] > d) & (lcp[i] <= d)

    to_left, to_right = (left == 0) & (lcp[0] >= depth), (right == rows - 1) & (beyond >= depth)
    names = prefixes(paths[0], int(lcp[0])) if lcp[0] >= 0 else [], prefixes(paths[-1], beyond) if beyond >= 0 else []

    def keys(where: np.ndarray) -> list:
        return [names[0][depth[w]] if to_left[w] else names[1][depth[w]] if to_right[w] else None for w in where.tolist()]

    up = at - (d > 0)
    key, parent_key = keys(at), [k if has else None for k, has in zip(keys(up), (d > 0).tolist())]
    inside = (d > 0) & np.array([k is None for k in parent_key], bool)
    least = Minima(np.asarray(conv, np.int64))
    ends_here = (turns[i] == d).tolist()
    return {
        "key": pa.array(key, pa.binary()), "parent_key": pa.array(parent_key, pa.binary()), "conv_id": least.least(i, r),
        "parent_conv_id": pa.array(least.least(left[up], right[up]), mask=~inside), "depth": d, "n_convs": n_convs, "n_children": children,
        "n_leaves": leaves[r + 1] - leaves[i], "saved_tokens": saved, "ends_sha256": pa.array([ends[j] if e else None for j, e in zip(i.tolist(), ends_here)], pa.string())}


def trie(conversations: DataFrame, range_turns: int = RANGE_TURNS, range_ids: int = RANGE_IDS) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of each node of the trie of the
    rebuilt conversations of `conversations` (conv_id, turn, role, text).

    Turns come in order of `turn`, null first; turns of one number by role, then by the digest of role and text, and repeated
    rows are turns each. Null role or text is empty. Rows without conv_id belong to no conversation. A family's first id is
    c - c % 5 with the remainder that keeps the sign of c. An empty table has no nodes, not even a root. Texts are only hashed
    and measured where they are read, however long; a conversation then takes 24 bytes a turn and is held as a whole. Other
    columns are ignored, whatever their names."""
    conversations = conversations.select("conv_id", "turn", "role", "text")
    spark = conversations.sparkSession
    groups = stored(distinct(stored(rebuilt(conversations), "convs"), range_ids), "paths")
    turns = groups.agg(F.coalesce(F.sum(F.size("sizes") + 1), F.lit(0))).first()[0]
    part = F.spark_partition_id().alias("part")
    ranges = stored(groups.repartitionByRange(max(1, math.ceil(turns / range_turns)), "path").select("*", part), "ranges")
    edges = ranges.groupBy("part").agg(F.min("path").alias("least"), F.max("path").alias("most"))
    order = sorted(r["part"] for r in edges.select("part").collect())  # a number per range
    steps = spark.createDataFrame(list(zip(order, order[1:])), "here int, there int")
    near = edges.join(F.broadcast(steps), F.col("part") == F.col("here")).select(F.col("there").alias("part"), F.col("most").alias("path"), F.lit("before").alias("side"))
    near = near.unionByName(edges.join(F.broadcast(steps), F.col("part") == F.col("there")).select(
        F.col("here").alias("part"), F.col("least").alias("path"), F.lit("after").alias("side")))

    def solved(t: pa.Table) -> pa.Table:
        side = dict(zip(t.column("side").to_pylist(), t.column("path").to_pylist()))
        t = t.filter(pa.compute.is_null(t.column("side"))).to_pylist()
        t.sort(key=lambda r: r["path"])
        got = nodes([r["path"] for r in t], [r["sizes"] for r in t], np.array([r["n_convs"] for r in t], np.int64), np.array([r["conv_id"] for r in t], np.int64),
                    [r["ends"] for r in t], side.get("before"), side.get("after"))
        return pa.table(got)

    both = ranges.withColumn("side", F.lit(None).cast("string")).unionByName(near, allowMissingColumns=True)
    found = stored(both.groupBy("part").applyInArrow(solved, NODE), "nodes")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    partial = stored(found.filter("key is not null").groupBy("key").agg(
        F.max("parent_key").alias("parent_key"), F.min("conv_id").alias("conv_id"), F.max("parent_conv_id").alias("parent_conv_id"), F.max("depth").alias("depth"), *sums,
        F.max("ends_sha256").alias("ends_sha256")), "partial")
    rows = found.filter("key is null").unionByName(partial).drop("key")
    parents = partial.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("above"), F.col("n_children").alias("size"))
    out = attach(rows, parents, ["parent_key"], "size", rows.count(), "conv_id")
    return out.select("conv_id", "depth", F.coalesce("parent_conv_id", "above").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
                      F.coalesce("ends_sha256", F.lit(NO_IDS)).alias("ends_sha256"))
