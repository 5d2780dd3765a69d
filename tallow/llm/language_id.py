"""Language identification by prediction by partial matching.

Each language has a variable-order byte context tree (orders 0 to ``order``) with method-C escape
probabilities: in a context seen n times with d distinct successors, a successor seen c times costs
-log2(c / (n + d)) bits and the escape to the next shorter context costs -log2(d / (n + d)); contexts
never seen are skipped free of charge; below order 0 every byte costs 8 bits. Statistics are frozen
after fitting, so the exact code length of a byte in a context is a constant, and the trees of all
languages are flattened into one hash table per order whose values are vectors of code lengths, one
entry a language. The language with the shortest code for the whole text wins.

Fitting: a bounded sample of labelled rows (``docs_per_language`` rows and ``bytes_per_language`` bytes
a language, whole texts, chosen by a hash of id, language and text, one at least a language). Everything else covers every row
and byte.

Cases: null text, empty text or text without a letter: ``und`` with score 0. Ties: the language first in
code-point order. Repeated rows get equal results. No labelled row at all: every text is ``und``. Ids that are null or shared by
many rows do not narrow the sample. Other columns are kept, whatever their names but that of the result.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import release, ship
from .common import discard, stored

UNDETERMINED = "und"
#: A multiplier for hashing 64-bit keys (2**64 divided by the golden ratio, odd).
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_LETTERLIKE = re.compile(r"[^\W\d_]")
#: Bytes scored at once, so that the working arrays stay in the CPU's cache.
_BLOCK = 1 << 18


class KeyTable:
    """Open addressing from 40-bit keys to row numbers, built and probed with whole-array steps."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(4 * max(1, len(keys)) - 1).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.rows = np.zeros(1 << self.bits, np.int32)
        slot, todo = self._slots(keys), np.arange(len(keys))
        while len(todo):
            free = todo[self.keys[slot[todo]] == -1]
            _, first = np.unique(slot[free], return_index=True)
            won = free[first]
            self.keys[slot[won]] = keys[won]
            self.rows[slot[won]] = won
            todo = todo[self.keys[slot[todo]] != keys[todo]]
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * _MULTIPLIER) >> np.uint64(64 - self.bits)).view(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row number of each key, -1 where it is absent."""
        slot = self._slots(keys)
        held = self.keys[slot]
        rows = np.where(held == keys, self.rows[slot], np.int32(-1))
        todo = np.flatnonzero((held != keys) & (held != -1))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
            held = self.keys[slot[todo]]
            hit = held == keys[todo]
            rows[todo[hit]] = self.rows[slot[todo[hit]]]
            todo = todo[~hit & (held != -1)]
        return rows


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes in a row, and for each its place in its own text."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.repeat(np.cumsum(sizes) - sizes, sizes)
    return data, np.arange(len(data)) - starts


def _grams(data: np.ndarray, order: int) -> list[np.ndarray]:
    """For each order k, the k bytes before and the byte itself at every place, as one number."""
    out = [data.astype(np.int64)]
    for k in range(1, order + 1):
        g = out[-1].copy()
        g[k:] += data[:-k].astype(np.int64) << (8 * k)
        out.append(g)
    return out


class ContextTrees:
    """Frozen statistics of all languages: per order the code lengths of grams and of escapes."""

    def __init__(self, samples: dict[str, list[bytes]], order: int = 4):
        self.order, self.languages = order, sorted(samples)
        n = len(self.languages)
        self.grams: list[KeyTable] = []
        self.lengths: list[np.ndarray] = []
        self.contexts: list[KeyTable] = []
        self.escapes: list[np.ndarray] = []
        seen = []
        for language in self.languages:
            data, place = _joined(samples[language])
            seen.append([np.unique(g[place >= k], return_counts=True) for k, g in enumerate(_grams(data, order))])
        below_keys, below = np.arange(256, dtype=np.int64), np.full((256, n), 8.0)
        for k in range(order + 1):
            stats = []
            for by_order in seen:
                keys, counts = by_order[k]
                contexts, first, distinct = np.unique(keys >> 8, return_index=True, return_counts=True)
                total = np.add.reduceat(counts, first) if len(first) else np.zeros(0, np.int64)
                stats.append((keys, counts, contexts, distinct, total))
            keys = np.unique(np.concatenate([s[0] for s in stats])) if stats else np.zeros(0, np.int64)
            contexts = np.unique(np.concatenate([s[2] for s in stats])) if stats else np.zeros(0, np.int64)
            escape, length = np.zeros((len(contexts), n)), np.zeros((len(keys), n))
            for i, (own, counts, ctx, distinct, total) in enumerate(stats):
                whole = (total + distinct).astype(float)
                escape[np.searchsorted(contexts, ctx), i] = -np.log2(distinct / whole)
                at = np.searchsorted(ctx, own >> 8)
                length[:, i] = np.nan
                length[np.searchsorted(keys, own), i] = -np.log2(counts / whole[at])
            shorter = keys & ((1 << (8 * k)) - 1) if k else keys
            fallback = escape[np.searchsorted(contexts, keys >> 8)] + below[np.searchsorted(below_keys, shorter)]
            length = np.where(np.isnan(length), fallback, length)
            self.grams.append(KeyTable(keys))
            self.lengths.append(length.astype(np.float32))
            self.contexts.append(KeyTable(contexts))
            self.escapes.append(escape.astype(np.float32))
            below_keys, below = keys, length

    def bits(self, data: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Code length of each byte in each language. place: bytes of the same text before it."""
        grams = _grams(data, self.order)
        out = np.zeros((len(data), len(self.languages)), np.float32)
        todo = None
        for k in range(self.order, -1, -1):
            if todo is None:
                keys, rest = grams[k], np.arange(len(data)) if place.min(initial=k) < k else None
                if rest is not None:
                    rest = rest[place >= k]
                    keys = keys[rest]
                rows = self.grams[k].find(keys)
                hit = rows >= 0
                if rest is None:
                    if hit.all():
                        return self.lengths[k][rows]
                    rest = np.arange(len(data))
                out[rest[hit]] = self.lengths[k][rows[hit]]
                early = np.flatnonzero(place < k)
            else:
                now = todo[place[todo] >= k]
                early = todo[place[todo] < k]
                rows = self.grams[k].find(grams[k][now])
                hit, rest = rows >= 0, now
                out[rest[hit]] += self.lengths[k][rows[hit]]
            missed = rest[~hit]
            if len(missed):
                ctx = self.contexts[k].find(grams[k][missed] >> 8)
                known = ctx >= 0
                out[missed[known]] += self.escapes[k][ctx[known]]
            todo = np.concatenate([missed, early])
            if not len(todo):
                return out
        out[todo] += 8.0
        return out

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each whole text in each language; long texts go block by block, contexts carried over."""
        total = np.zeros((len(texts), len(self.languages)))
        group: list[int] = []
        size = 0
        for i, t in enumerate(texts):
            if len(t) > _BLOCK:
                data = np.frombuffer(t, np.uint8)
                for at in range(0, len(data), _BLOCK):
                    lead = min(at, self.order)
                    part = data[at - lead : at + _BLOCK]
                    total[i] += self.bits(part, np.arange(at - lead, at - lead + len(part)))[lead:].sum(axis=0, dtype=float)
                continue
            if size + len(t) > _BLOCK:
                self._add(texts, group, total)
                group, size = [], 0
            if t:
                group.append(i)
                size += len(t)
        self._add(texts, group, total)
        return total

    def _add(self, texts: list[bytes], group: list[int], total: np.ndarray) -> None:
        if group:
            own = [texts[i] for i in group]
            data, place = _joined(own)
            starts = np.cumsum([0] + [len(t) for t in own[:-1]])
            total[group] = np.add.reduceat(self.bits(data, place), starts, axis=0, dtype=float)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
        """Language, its posterior under equal priors, and bits a byte of the best code."""
        named, score, rate = [UNDETERMINED] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
        at = [i for i, t in enumerate(texts) if t and has_letter(t)] if self.languages else []
        coded = [texts[i].encode("utf-8", "replace") for i in at]
        if at:
            bits = self.code_lengths(coded)
            best = bits.argmin(axis=1)
            gap = np.minimum(bits - bits.min(axis=1, keepdims=True), 1000.0)
            sure = 1.0 / np.exp2(-gap).sum(axis=1)
            for j, i in enumerate(at):
                named[i], score[i], rate[i] = self.languages[best[j]], float(sure[j]), float(bits[j, best[j]] / len(coded[j]))
        return named, score, rate


def has_letter(text: str) -> bool:
    return any(m.group().isalpha() for m in _LETTERLIKE.finditer(text))


def training_rows(
    docs: DataFrame, text: str, lang: str, key: str, where: Column | None, docs_per_language: int, most_languages: int = 256, bytes_per_language: int = 1_500_000
) -> DataFrame:
    """lang, text, h of at most docs_per_language labelled rows of each of the most_languages languages with the most rows, until they
    fill bytes_per_language; one at least of each language that has a text. Rows come by a hash h of id, language and text; copies
    of a row share it, so they stay in order of their texts and are cut like others.

    A row's level is the magnitude of its hash: each level has half the rows of the next. Rows are counted by level, the lowest
    levels that hold enough rows pass, and of these the least by hash are taken; each task passes on that many at most.
    """
    t, language = F.col(text).alias("text"), F.col(lang).alias("lang")
    h = F.shiftrightunsigned(F.xxhash64(F.col(key).cast("string"), lang, text), 1).alias("h")
    rows = docs.select(t, language, h, (where if where is not None else F.lit(True)).alias("ok")).filter("ok and lang is not null and length(text) > 0")
    rows = rows.select("text", "lang", "h", F.floor(F.log2(F.col("h").cast("double") + 1)).cast("int").alias("level"))
    counts = rows.groupBy("lang", "level").agg(F.count("*").alias("n"))
    counts = stored(counts, "levels")
    most = counts.groupBy("lang").agg(F.sum("n").alias("rows")).orderBy(F.col("rows").desc(), "lang").limit(most_languages)
    upto = counts.join(F.broadcast(most), "lang").withColumn("before", F.sum("n").over(Window.partitionBy("lang").orderBy("level").rowsBetween(Window.unboundedPreceding, -1)))
    highest = upto.filter(F.coalesce(F.col("before"), F.lit(0)) < docs_per_language).groupBy("lang").agg(F.max("level").alias("highest"))
    kept = rows.join(F.broadcast(highest), "lang").filter("level <= highest")
    by_hash = Window.partitionBy("lang").orderBy("h", "text")
    least = kept.withColumn("place", F.row_number().over(by_hash)).filter(F.col("place") <= docs_per_language)
    size = F.sum(F.octet_length("text")).over(by_hash.rowsBetween(Window.unboundedPreceding, -1))
    chosen = stored(least.withColumn("size", size).filter(F.coalesce(F.col("size"), F.lit(0)) < bytes_per_language).select("lang", "text", "h"), "sample")
    discard(counts)
    return chosen


def fit(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    key: str = "doc_id",
    where: Column | None = None,
    order: int = 4,
    docs_per_language: int = 400,
    bytes_per_language: int = 1_500_000,
    most_languages: int = 256,
) -> ContextTrees:
    """Trees from a bounded sample of the labelled rows for which `where` holds (see training_rows)."""
    sample = training_rows(docs, text, lang, key, where, docs_per_language, most_languages, bytes_per_language)
    samples: dict[str, list[bytes]] = {}
    for row in sample.orderBy("lang", "h", "text").toLocalIterator():
        samples.setdefault(row.lang, []).append(row.text.encode("utf-8", "replace"))
    discard(sample)
    return ContextTrees(samples, order)


def predictor(trees: ContextTrees, sc) -> Callable[[Column], Column]:
    """A column function: struct of language, score and bits a byte. The trees are bounded by the sample's bytes."""
    shared = sc.broadcast(trees)

    @F.arrow_udf("struct<lang_pred:string,score:double,bits_per_byte:double>")
    def ppm(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = shared.value
        for batch in batches:
            named, score, rate = own.predict(batch.to_pylist())
            yield pa.StructArray.from_arrays(
                [pa.array(named, pa.string()), pa.array(score, pa.float64()), pa.array(rate, pa.float64())],
                ["lang_pred", "score", "bits_per_byte"],
            )
        release()

    return ppm.asNondeterministic()  # else a filter on the result would score every text twice


def identify(docs: DataFrame, trees: ContextTrees, text: str = "text", out: str = "language") -> DataFrame:
    """docs and a struct column `out` (replacing one of that name): lang_pred, score, bits_per_byte."""
    ship(docs.sparkSession)
    return docs.withColumn(out, predictor(trees, docs.sparkSession.sparkContext)(F.col(text)))
