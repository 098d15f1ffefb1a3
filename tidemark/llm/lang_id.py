"""Language identification by interpolated Kneser-Ney models of characters.

Texts become lower-case letters with one blank between words. Spark counts every 4-gram of every training
text per language; a model keeps them, and all shorter grams they imply, in sorted arrays of 64-bit hashes,
with the log probability that each language gives. A document goes to the language of the lowest cross-entropy per
letter. Where the grams are more than fit into a task, Spark computes the same models as tables, and the grams of
the documents are joined with those. How far above a language's usual cross-entropy a text may lie before it is rejected, and how sure a
lead is, is calibrated on a bounded sample of the training rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored
from tidemark.llm.pretokens import LETTER, buffers, classes

ORDER = 4
#: Bounds, together with the number of languages, what is sent to the tasks. With more grams the models stay tables.
GRAMS_MOST = 1 << 20
#: Training rows the thresholds are calibrated on, at most.
CALIBRATION_ROWS = 8192
#: Standard deviations above the usual cross-entropy from which a text is rejected.
REJECT_AT = 25.0
BUFFER_CHARS = 1 << 22
MIX = np.uint64(0x9E3779B97F4A7C15)
UNKNOWN = "und"
#: Symbols a text may have; the shortest models share out what is left evenly among them.
SYMBOLS = 1 << 16


@cache
def letters() -> np.ndarray:
    """Code point -> lower-case code point of a letter, else 0."""
    kinds = classes()
    out = np.zeros(len(kinds), np.uint32)
    own = np.flatnonzero(kinds == LETTER)
    out[own] = [ord(low) if len(low := chr(c).lower()) == 1 else c for c in own.tolist()]
    return out


def prepared(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts, each with a blank (0) before and after it, and where each text starts."""
    points = np.frombuffer("".join(f"\x00{t}\x00" for t in texts).encode("utf-32-le"), np.uint32)
    sym = letters()[points]
    sizes = np.fromiter((len(t) + 2 for t in texts), np.int64, len(texts))
    starts = np.cumsum(sizes) - sizes
    keep = np.ones(len(sym), bool)
    keep[1:] = (sym[1:] != 0) | (sym[:-1] != 0)
    keep[starts] = True
    return sym[keep], (np.cumsum(keep) - keep)[starts]


def gram_hashes(sym: np.ndarray, order: int) -> np.ndarray:
    """Hash of the `order` symbols that end at each position from order - 1 on."""
    out = np.zeros(max(0, len(sym) - order + 1), np.uint64)
    for i in range(order):
        out = (out + sym[i:i + len(out)] + np.uint64(1)) * MIX
    return out


def ends_of(sym: np.ndarray, starts: np.ndarray, order: int) -> np.ndarray:
    """Positions at which a gram ends that lies within one text: from its order-th symbol on."""
    text = np.zeros(len(sym), np.int64)
    text[starts[starts < len(sym)]] = 1
    text = np.cumsum(text) - 1
    at = np.arange(order - 1, len(sym))
    return at[text[at] == text[at - order + 1]]


def counts(train: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, gram, n): how often the texts of each language have each gram. Rows without text or lang are left out."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                held.setdefault(lang, [0, []])
                held[lang][1].append(text)
                held[lang][0] += len(text)
                if held[lang][0] >= BUFFER_CHARS:
                    yield _counted(lang, held.pop(lang)[1], order)
        for lang, (_, texts) in held.items():
            yield _counted(lang, texts, order)

    rows = train.filter("text is not null and lang is not null").select("lang", "text")
    return rows.mapInArrow(counted, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _counted(lang: str, texts: list[str], order: int) -> pa.RecordBatch:
    sym, starts = prepared(texts)
    ends = ends_of(sym, starts, order)
    _, lead, n = np.unique(gram_hashes(sym, order)[ends - order + 1], return_index=True, return_counts=True)
    at = ends[lead]
    chars = np.stack([sym[at - order + 1 + i] for i in range(order)], axis=1).astype("<u4") if len(at) else np.zeros((0, order), "<u4")
    grams = np.where(chars == 0, 32, chars).astype("<u4").tobytes().decode("utf-32-le")
    grams = [grams[i:i + order] for i in range(0, len(grams), order)]
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams, pa.string()), pa.array(n, pa.int64())], ["lang", "gram", "n"])


@dataclass
class Model:
    langs: list[str]
    order: int
    keys: list[np.ndarray] = field(default_factory=list)     # by length of gram - 1, sorted hashes
    logs: list[np.ndarray] = field(default_factory=list)     # (grams, languages) log probabilities
    weights: list[np.ndarray] = field(default_factory=list)  # log weight of the shorter model after that gram
    floor: np.ndarray | None = None                          # log probability of an unseen symbol
    usual: np.ndarray | None = None                          # (mean, variance between texts, variance per letter) by language
    sharp: float = 1.0
    tables: list[DataFrame] = field(default_factory=list)    # instead of the arrays, by length of gram - 1: gram, logs, after

    def find(self, size: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = self.keys[size - 1]
        if not len(keys):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        return at, keys[at] == hashes

    def log_probs(self, sym: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """(positions, languages): of the symbol at each position after the order - 1 before it."""
        at, seen = self.find(self.order, gram_hashes(sym, self.order)[ends - self.order + 1])
        out = self.logs[-1][at] if len(self.logs[-1]) else np.zeros((len(ends), len(self.langs)), np.float32)
        todo = np.flatnonzero(~seen)
        out[todo] = 0
        for size in range(self.order - 1, 0, -1):
            if not len(todo):
                return out
            before, known = self.find(size, gram_hashes(sym, size)[ends[todo] - size])
            out[todo[known]] += self.weights[size - 1][before[known]]
            at, seen = self.find(size, gram_hashes(sym, size)[ends[todo] - size + 1])
            out[todo[seen]] += self.logs[size - 1][at[seen]]
            todo = todo[~seen]
        out[todo] += self.floor
        return out

    def cross_entropy(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(texts, languages) nats per position, and the number of letters of each text."""
        sym, starts = prepared(texts)
        ends = ends_of(sym, starts, self.order)
        logs = self.log_probs(sym, ends)
        stops = np.r_[starts[1:], len(sym)]
        lo, hi = np.searchsorted(ends, starts), np.searchsorted(ends, stops)
        n = hi - lo
        total = np.zeros((len(texts), len(self.langs)))
        full = n > 0
        if full.any():
            total[full] = np.add.reduceat(logs.astype(np.float64), lo[full], axis=0)
        n_letters = np.add.reduceat((sym != 0).astype(np.int64), starts)
        short = ~full & (n_letters > 0)  # fewer symbols than a gram: judged by their letters alone
        for i in np.flatnonzero(short):
            own = sym[starts[i]:stops[i]]
            own = own[own != 0]
            at, seen = self.find(1, gram_hashes(own, 1))
            total[i] = np.where(seen[:, None], self.logs[0][at] if len(self.logs[0]) else 0, self.floor).sum(axis=0)
            n[i] = len(own)
        return -total / np.maximum(n, 1)[:, None], n_letters

    def judge(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, confidence and whether the text is rejected."""
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        return self.decide(*self.cross_entropy(texts))

    def decide(self, entropy: np.ndarray, n: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        best = entropy.argmin(axis=1)
        low = entropy[np.arange(len(best)), best]
        sure = 1 / np.exp(-self.sharp * np.minimum(n, 200)[:, None] * (entropy - low[:, None])).sum(axis=1)
        mean, between, within = self.usual[best].T
        odd = low > mean + REJECT_AT * np.sqrt(between + within / np.maximum(n, 1))
        langs = [self.langs[b] if letters else UNKNOWN for b, letters in zip(best.tolist(), n.tolist())]
        return langs, np.where(n > 0, sure, 0.0), odd | (n == 0)


def smoothed(langs: list[str], tables: list[dict[str, float]], order: int) -> Model:
    """Interpolated Kneser-Ney of the highest-order counts, one table per language."""
    grams: list[list[str]] = []  # by length - 1, those of any language
    own: list[list[dict[str, float]]] = [[] for _ in langs]  # counts by language and length - 1
    for i, table in enumerate(tables):
        level, levels = table, [table]
        for size in range(order - 1, 0, -1):  # a shorter gram counts the symbols it follows, not its occurrences
            lower: dict[str, float] = {}
            for g in level:
                lower[g[1:]] = lower.get(g[1:], 0) + 1
            level = lower
            levels.append(level)
        own[i] = levels[::-1]
    model = Model(langs, order)
    for size in range(1, order + 1):
        grams.append(sorted(set().union(*(own[i][size - 1] for i in range(len(langs))))))
    probs: list[list[dict[str, float]]] = [[] for _ in langs]
    back: list[list[dict[str, float]]] = [[] for _ in langs]  # by length of the context
    for i in range(len(langs)):
        for size in range(1, order + 1):
            table = own[i][size - 1]
            ones = sum(1 for c in table.values() if c == 1)
            twos = sum(1 for c in table.values() if c == 2)
            cut = min(0.9, max(0.1, ones / (ones + 2 * twos))) if ones else 0.5
            total: dict[str, float] = {}
            kinds: dict[str, int] = {}
            for g, c in table.items():
                total[g[:-1]] = total.get(g[:-1], 0) + c
                kinds[g[:-1]] = kinds.get(g[:-1], 0) + 1
            weight = {h: cut * kinds[h] / total[h] for h in total}
            lower = probs[i][-1] if size > 1 else {}
            out = {}
            for g in grams[size - 1]:
                h = g[:-1]
                less = lower[g[1:]] if size > 1 else 1 / SYMBOLS
                out[g] = max(table.get(g, 0) - cut, 0) / total[h] + weight[h] * less if h in total else less
            probs[i].append(out)
            back[i].append(weight)
    model.floor = np.array([math.log(back[i][0].get("", 1.0) / SYMBOLS) for i in range(len(langs))], np.float32)
    for size in range(1, order + 1):
        points = np.frombuffer("".join(grams[size - 1]).encode("utf-32-le"), np.uint32).reshape(-1, size)
        points = np.where(points == 32, 0, points).astype(np.uint32)
        hashes = np.zeros(len(points), np.uint64)
        for k in range(size):
            hashes = (hashes + points[:, k] + np.uint64(1)) * MIX
        sort = np.argsort(hashes)
        logs = np.array([[math.log(probs[i][size - 1][g]) for i in range(len(langs))] for g in grams[size - 1]], np.float32).reshape(-1, len(langs))
        after = np.zeros((len(grams[size - 1]), len(langs)), np.float32)
        if size < order:
            after = np.array([[math.log(back[i][size].get(g, 1.0)) for i in range(len(langs))] for g in grams[size - 1]], np.float32).reshape(-1, len(langs))
        model.keys.append(hashes[sort])
        model.logs.append(logs[sort])
        model.weights.append(after[sort])
    return model


def smoothed_tables(langs: list[str], table: DataFrame, order: int) -> Model:
    """`smoothed` of the table (lang, gram, n) of the highest order, by joins; nothing is collected but one row
    per language."""
    every = range(len(langs))

    def by_language(df: DataFrame, key: str, value: Column, name: str) -> DataFrame:
        """An array over the languages, 0 where one has none."""
        sums = df.groupBy(key).agg(*(F.sum(F.when(F.col("lang") == x, value)).alias(f"_{i}") for i, x in enumerate(langs)))
        return sums.select(key, F.array(*(F.coalesce(F.col(f"_{i}"), F.lit(0)).cast("double") for i in every)).alias(name))

    own = {order: table}
    for size in range(order - 1, 0, -1):  # a shorter gram counts the symbols it follows, not its occurrences
        own[size] = stored(own[size + 1].groupBy("lang", F.expr("substring(gram, 2)").alias("gram")).agg(F.count(F.lit(1)).alias("n")), "grams")
    heads, probs, model = {}, {}, Model(langs, order)
    for size in range(1, order + 1):
        seen = {r["lang"]: r for r in own[size].groupBy("lang").agg(F.count_if(F.expr("n = 1")).alias("ones"), F.count_if(F.expr("n = 2")).alias("twos")).collect()}
        ones_twos = [(seen[x]["ones"], seen[x]["twos"]) for x in langs]
        cut = [min(0.9, max(0.1, a / (a + 2 * b))) if a else 0.5 for a, b in ones_twos]
        rows = own[size].withColumn("head", F.expr(f"substring(gram, 1, {size - 1})"))
        total = by_language(rows, "head", F.col("n"), "total").join(by_language(rows, "head", F.lit(1), "kinds"), "head")
        weight = F.array(*(F.when(F.col("total")[i] > 0, cut[i] * F.col("kinds")[i] / F.col("total")[i]).otherwise(1.0) for i in every))
        heads[size] = stored(total.select("head", "total", weight.alias("weight")), "heads")
        grams = by_language(own[size], "gram", F.col("n"), "n").withColumns({
            "head": F.expr(f"substring(gram, 1, {size - 1})"), "tail": F.expr("substring(gram, 2)")}).join(heads[size], "head")
        if size > 1:
            grams = grams.join(probs[size - 1].select(F.col("gram").alias("tail"), F.col("p").alias("less")), "tail")
        else:
            grams = grams.withColumn("less", F.array(*(F.lit(1 / SYMBOLS) for _ in every)))
        n, total_, less = (lambda i: F.col("n")[i]), (lambda i: F.col("total")[i]), (lambda i: F.col("less")[i])
        p = F.array(*(F.when(total_(i) > 0, F.greatest(n(i) - cut[i], F.lit(0.0)) / total_(i) + F.col("weight")[i] * less(i)).otherwise(less(i)) for i in every))
        probs[size] = stored(grams.select("gram", p.alias("p")), "probs")
    first = heads[1].first()["weight"]
    model.floor = np.array([math.log(w / SYMBOLS) for w in first], np.float32)
    for size in range(1, order + 1):
        logs = F.transform("p", lambda v: F.log(v).cast("float"))
        after = F.lit(None).cast("array<float>")
        level = probs[size]
        if size < order:
            level = level.join(heads[size + 1].select(F.col("head").alias("gram"), "weight"), "gram", "left")
            after = F.transform("weight", lambda v: F.log(v).cast("float"))
        model.tables.append(stored(level.select("gram", logs.alias("logs"), after.alias("after")), "models"))
    return model


def _plus(a: Column, b: Column) -> Column:
    """Sum of two arrays; a null one counts nothing."""
    return F.when(a.isNull(), b).otherwise(F.zip_with(a, b, lambda x, y: x + y))


def _resolved(grams: DataFrame, model: Model) -> DataFrame:
    """(gram, logs) of distinct grams of the highest order, and of single letters from texts shorter than that."""
    floor = F.array(*(F.lit(float(x)).cast("float") for x in model.floor))
    full, order = grams.filter(F.char_length("gram") == model.order), model.order
    for size in range(1, order + 1):
        level = model.tables[size - 1]
        full = full.join(level.select(F.col("gram").alias("_key"), F.col("logs").alias(f"_l{size}")), F.expr(f"substring(gram, {order - size + 1}, {size})") == F.col("_key"), "left").drop("_key")
        if size < order:
            full = full.join(level.select(F.col("gram").alias("_key"), F.col("after").alias(f"_a{size}")), F.expr(f"substring(gram, {order - size}, {size})") == F.col("_key"), "left").drop("_key")
    logs = F.coalesce("_l1", floor)
    for size in range(2, order + 1):
        logs = F.coalesce(f"_l{size}", _plus(F.col(f"_a{size - 1}"), logs))
    if order == 1:
        return full.select("gram", logs.alias("logs"))
    short = grams.filter(F.char_length("gram") < order).join(model.tables[0], "gram", "left")
    return full.select("gram", logs.alias("logs")).union(short.select("gram", F.coalesce("logs", floor)))


def _parts(order: int):
    """Rows (_row, text) -> (_row, letters, gram, n): the grams of each text that has letters."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, texts = b.column("_row").to_numpy(), [t or "" for t in b.column("text").to_pylist()]
            for lo, hi in buffers(texts, BUFFER_CHARS):
                sym, starts = prepared(texts[lo:hi])
                ends = ends_of(sym, starts, order)
                letters_in = np.add.reduceat((sym != 0).astype(np.int64), starts)
                text = np.searchsorted(starts, ends, side="right") - 1
                for size, at in ((order, ends), (1, np.flatnonzero(sym != 0))):
                    own = text if size == order else np.searchsorted(starts, at, side="right") - 1
                    if size < order or order == 1:
                        brief = ~np.isin(own, text) if order > 1 else np.zeros(len(own), bool)
                        own, at = own[brief], at[brief]
                    if not len(at):
                        continue
                    chars = np.stack([sym[at - size + 1 + i] for i in range(size)], axis=1)
                    _, lead, n = np.unique(np.c_[own.astype(np.uint32), chars], axis=0, return_index=True, return_counts=True)
                    chars = np.where(chars[lead] == 0, 32, chars[lead]).astype("<u4").tobytes().decode("utf-32-le")
                    yield pa.RecordBatch.from_arrays([
                        pa.array(rows[lo:hi][own[lead]]), pa.array(letters_in[own[lead]]), pa.array([chars[i:i + size] for i in range(0, len(chars), size)], pa.string()),
                        pa.array(n, pa.int64())], ["_row", "letters", "gram", "n"])

    return read


def entropies(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` with n (letters) and entropy (by language) from the model's tables."""
    rows = stored(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    parts = stored(rows.select("_row", "text").mapInArrow(_parts(model.order), "_row long, letters long, gram string, n long"), "parts")
    every = range(len(model.langs))
    known = parts.join(_resolved(parts.select("gram").distinct(), model), "gram")
    sums = known.groupBy("_row").agg(F.max("letters").alias("_letters"), F.sum("n").alias("_n"), *(F.sum(F.col("n") * F.col("logs")[i].cast("double")).alias(f"_{i}") for i in every))
    entropy = F.array(*(F.coalesce(-F.col(f"_{i}") / F.col("_n"), F.lit(0.0)) for i in every))
    return rows.join(sums, "_row", "left").select(*docs.columns, F.coalesce("_letters", F.lit(0)).cast("long").alias("_letters"), entropy.alias("_entropy"))


def fit(train: DataFrame, order: int = ORDER, most: int = GRAMS_MOST, rows: int = CALIBRATION_ROWS) -> Model:
    """A model of the (text, lang) rows of `train`. All text is counted and every gram kept, in tables if they are more than `most`."""
    table = stored(counts(train, order), "grams")
    if table.count() > most:
        langs = sorted(r["lang"] for r in table.select("lang").distinct().collect())
        return calibrated(smoothed_tables(langs, table, order), train, rows)
    by_lang: dict[str, dict[str, float]] = {}
    for r in table.toLocalIterator():
        by_lang.setdefault(r["lang"], {})[r["gram"]] = r["n"]
    langs = sorted(by_lang)
    if not langs:
        return Model([], order)
    return calibrated(smoothed(langs, [by_lang[x] for x in langs], order), train, rows)


def calibrated(model: Model, train: DataFrame, rows: int) -> Model:
    """Usual cross-entropies and sharpness from at most `rows` training rows, picked by the hash of the text."""
    train = train.filter("text is not null and lang is not null").select("text", "lang")
    n = max(1, train.count())
    share = min(1.0, 0.8 * rows / n)
    sample = train.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).limit(rows)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            for lo, hi in buffers(texts, BUFFER_CHARS):
                entropy, n = model.cross_entropy(texts[lo:hi])
                yield pa.RecordBatch.from_arrays([b.column("lang").slice(lo, hi - lo), pa.array(n, pa.int64()),
                                                  pa.array(entropy.tolist(), pa.list_(pa.float64()))], ["lang", "n", "entropy"])

    if model.tables:
        sample = entropies(sample, model).select("lang", F.col("_letters").alias("n"), F.col("_entropy").alias("entropy"))
    else:
        sample = sample.mapInArrow(measured, "lang string, n long, entropy array<double>")
    got = [(r["lang"], r["n"], r["entropy"]) for r in sample.collect() if r["n"]]
    usual = np.tile(np.array([10.0, 0.01, 1.0]), (len(model.langs), 1))
    for i, lang in enumerate(model.langs):
        own = np.array([(n, e[i]) for x, n, e in got if x == lang and e[i] == min(e)]).reshape(-1, 2)
        if len(own) < 8:
            continue
        mean = np.average(own[:, 1], weights=own[:, 0])
        long_ = own[:, 0] >= np.median(own[:, 0])
        between = max(1e-4, np.average((own[long_, 1] - mean) ** 2))
        within = max(0.5, np.average((own[~long_, 1] - mean) ** 2 * own[~long_, 0]) if (~long_).any() else 0.5)
        usual[i] = mean, between, within
    model.usual = usual
    at = {x: i for i, x in enumerate(model.langs)}
    best = -math.inf
    gaps = [(np.minimum(n, 200) * (np.array(e) - min(e)), at[x]) for x, n, e in got if x in at]
    for sharp in (0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.5, 1.0):
        fit_ = sum(-sharp * g[i] - math.log(np.exp(-sharp * g).sum()) for g, i in gaps)
        if fit_ > best:
            best, model.sharp = fit_, sharp
    return model


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` (text and any columns, none named lang_pred, score or rejected) with lang_pred, score (0 to 1) and
    rejected. A text that is null or has no letter gets `und`, score 0, and is rejected, as is one that no
    language's model finds likely. Ties go to the first language by name. Without any training rows all is `und`."""
    sent = docs.sparkSession.sparkContext.broadcast(replace(model, tables=[]))

    def decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                entropy = b.column("_entropy").flatten().to_numpy().reshape(b.num_rows, -1)
                langs, sure, odd = sent.value.decide(entropy, b.column("_letters").to_numpy())
                yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(langs, pa.string()), pa.array(sure, pa.float64()), pa.array(odd)],
                                                 [*b.schema.names[:-2], "lang_pred", "score", "rejected"])

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            for lo, hi in buffers(texts, BUFFER_CHARS):
                langs, sure, odd = sent.value.judge(texts[lo:hi])
                own = b.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(langs, pa.string()), pa.array(sure, pa.float64()), pa.array(odd)],
                                                 [*own.schema.names, "lang_pred", "score", "rejected"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    if model.tables:
        return entropies(docs, model).mapInArrow(decided, f"{ddl}, lang_pred string, score double, rejected boolean")
    return docs.mapInArrow(judged, f"{ddl}, lang_pred string, score double, rejected boolean")
