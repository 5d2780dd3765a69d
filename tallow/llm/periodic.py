"""Periodic runs of words, by an all-lag scan of word numbers.

A run is a stretch of consecutive words with smallest period q of at least max(6, 4 q) words that neither neighbour
extends. The array of a text's word numbers is compared with itself shifted by every lag up to a quarter of its length; true
stretches of max(6, 4 q) - q comparisons or more are runs of period q, unless a divisor of q is a period as well.

Many texts are scanned at once, end to end, longest first, so that a lag looks at the texts long enough for it only. Lags up to
EVERY are compared at every word. A longer lag is first compared at its own multiples: a stretch of 3 q comparisons holds three
multiples of q in a row, so where no three in a row agree there is no run, and elsewhere the stretch around them is measured
word by word. What a known run covers is not measured again at multiples of its period. So all lags of n words take about
n log n comparisons, and none is left out.

Distribution: texts up to most_bytes are scanned where they lie. A longer one is taken once for all its copies, and its lags
are dealt out in ranges over several tasks, whose runs (the same for any dealing) are united.

Cases: null text has no words; an empty or blank text has no run; equal texts have equal runs; an empty table gives an empty
result; other columns are kept, whatever their names but that of the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import release, ship
from .common import fresh
from .mixing import WORD

LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Lags compared at every word at once.
EVERY = 32
_BLOCK_WORDS = 1 << 18
_RUN = "struct<start:bigint,length:bigint,period:bigint>"
_FOUND = f"struct<n_words:bigint,runs:array<{_RUN}>,best:{_RUN},collapsed:string>"
_RUN_KIND = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_FOUND_KIND = pa.struct([("n_words", pa.int64()), ("runs", pa.list_(_RUN_KIND)), ("best", _RUN_KIND), ("collapsed", pa.string())])


def _edge(w: np.ndarray, at: int, q: int, last: int, step: int) -> int:
    """From place `at`, where word and word + q agree: the last place in this direction (step 1 or -1) up to which all do."""
    width = 64
    while True:
        stop = min(last, at + width) if step > 0 else max(last, at - width)
        if stop == at:
            return at
        low, high = (at + 1, stop + 1) if step > 0 else (stop, at)
        off = np.flatnonzero(w[low:high] != w[low + q : high + q])
        if len(off):
            return low + int(off[0]) - 1 if step > 0 else low + int(off[-1]) + 1
        at, width = stop, width * 2


def _smallest(w: np.ndarray, start: int, length: int, q: int) -> int:
    """The smallest period of a run of at least two periods q: it divides q."""
    rest, f, p = q, 2, q
    while rest > 1:
        f = f if f * f <= rest else rest
        if rest % f:
            f += 1
            continue
        while rest % f == 0:
            rest //= f
        while p % f == 0 and np.array_equal(w[start : start + length - p // f], w[start + p // f : start + length]):
            p //= f
    return p


def scan(w: np.ndarray, ends: list[tuple[int, int]], low: int = 1, high: int | None = None) -> np.ndarray:
    """Runs (first place in w, length, period) found at lags low..high (all where high is None), a row each.

    w: texts end to end with a number of its own behind each; ends: (words, place of the end in w) of each, longest first.
    """
    out: list[tuple[int, int, int]] = []
    # runs that may cover what a longer lag meets
    starts, stops, periods = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    longest = ends[0][0] // LEAST_PERIODS if ends and ends[0][0] >= LEAST_WORDS else 0
    high = longest if high is None else min(high, longest)
    texts = len(ends)
    for q in range(low, high + 1):
        need = max(LEAST_WORDS, LEAST_PERIODS * q)
        while ends[texts - 1][0] < need:
            texts -= 1
        n = ends[texts - 1][1]
        found = []
        if q <= EVERY:
            same = np.zeros(n - q + 2, np.int8)
            same[1:-1] = w[: n - q] == w[q:n]
            edge = np.diff(same)
            first, after = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            long = after - first >= need - q
            found = [(int(a), int(b)) for a, b in zip(first[long], after[long])]
        else:
            own = w[:n:q]
            agree = own[:-1] == own[1:]
            three = agree[:-2] & agree[1:-1] & agree[2:]
            if three.any():
                places = np.flatnonzero(three) * q
                for part in (q // 2, q + q // 2, q // 4, q + q // 4, 3 * q // 4, q + 3 * q // 4):
                    places = places[w[places + part] == w[places + part + q]]
                done = -1
                for at in places.tolist():
                    if at <= done:
                        continue
                    if len(starts):
                        covers = (starts <= at) & (stops > at + q) & (q % periods == 0) & (stops - starts >= LEAST_PERIODS * q)
                        if covers.any():
                            done = int(stops[covers].max()) - q - 1  # the same run
                            continue
                    end = _edge(w, at, q, n - q - 1, 1) + 1
                    begin = _edge(w, at, q, 0, -1)
                    done = end
                    if end - begin >= need - q:
                        found.append((begin, end))
        if not found:
            continue
        new = []
        for begin, end in found:
            length = end - begin + q
            if q <= EVERY or low > 1:
                p = _smallest(w, begin, length, q)
                if p < q and p >= low:
                    continue  # found at lag p
                new.append((begin, length, p))
            else:
                new.append((begin, length, q))
        out += new
        if new:
            more = np.array(new, np.int64)
            starts, stops, periods = np.append(starts, more[:, 0]), np.append(stops, more[:, 0] + more[:, 1]), np.append(periods, more[:, 2])
        if len(starts):
            use = stops - starts >= LEAST_PERIODS * (q + 1)
            if not use.all():
                starts, stops, periods = starts[use], stops[use], periods[use]
    return np.unique(np.array(out, np.int64).reshape(-1, 3), axis=0)


def _joined(texts: list[list[bytes]]) -> tuple[np.ndarray, list[tuple[int, int]], np.ndarray]:
    """Word numbers of the texts, longest first, each closed by a number of its own; (words, end) of each; their order."""
    sizes = np.array([len(t) for t in texts], np.int64)
    order = np.argsort(-sizes, kind="stable")
    words = pa.array([x for i in order for x in texts[i]], pa.binary())
    numbers = words.dictionary_encode().indices.to_numpy().astype(np.int32) if len(words) else np.zeros(0, np.int32)
    sizes = sizes[order]
    ends = np.cumsum(sizes + 1) - 1
    w = np.empty(int(sizes.sum()) + len(texts), np.int32)
    closing = np.zeros(len(w), bool)
    closing[ends] = True
    w[ends], w[~closing] = -1 - np.arange(len(texts)), numbers
    return w, list(zip(sizes.tolist(), ends.tolist())), order


def runs_of(texts: list[list[bytes]], low: int = 1, high: int | None = None) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each text (its words), by start, then period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not texts:
        return out
    w, ends, order = _joined(texts)
    found = scan(w, ends, low, high)
    stops = np.array([e for _, e in ends])
    which = np.searchsorted(stops, found[:, 0])
    for i, (start, length, period) in zip(which.tolist(), found.tolist()):
        out[order[i]].append((start - ends[i][1] + ends[i][0], length, period))
    return [sorted(r, key=lambda x: (x[0], x[2])) for r in out]


def _told(words: list[bytes], runs: list[tuple[int, int, int]]) -> dict:
    best = None
    for r in runs:  # exact comparison of length / period; an earlier one (by start, then period) wins a tie
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    if runs:
        gone = np.zeros(len(words), bool)
        for start, length, period in runs:
            gone[start + period : start + length] = True
        words = [words[i] for i in np.flatnonzero(~gone)]
    name = lambda r: dict(zip(("start", "length", "period"), r))
    return {"runs": [name(r) for r in runs], "best": name(best) if best else None, "collapsed": b" ".join(words).decode("utf-8", "replace")}


def _blocks(batch: pa.Array) -> Iterator[list[list[bytes]]]:
    held, size = [], 0
    for t in batch:
        words = (t.as_py() or b"").split()  # at the six ASCII white space bytes
        held.append(words)
        size += len(words)
        if size >= _BLOCK_WORDS:
            yield held
            held, size = [], 0
    if held:
        yield held


def with_runs(docs: DataFrame, text: str = "text", out: str = "periodic", most_bytes: int = 1 << 16, most_ranges: int = 16) -> DataFrame:
    """docs and a struct `out` (in the place of one of that name): n_words, runs (start, length, period; by start, then period), best
    (the run of most periods, then of the smallest start and period), collapsed (the words without those that repeat the
    first period of a run, joined by single spaces). Lags of texts over most_bytes are dealt out in at most most_ranges ranges."""
    ship(docs.sparkSession)

    @F.arrow_udf(_FOUND)
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = []
            for texts in _blocks(batch):
                rows += [{"n_words": len(t), **_told(t, r)} for t, r in zip(texts, runs_of(texts))]
            yield pa.array(rows, _FOUND_KIND)
        release()

    @F.arrow_udf(_FOUND)
    def given(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, runs in batches:
            rows = []
            for t, of in zip(texts, runs):
                words = t.as_py().split()
                have = sorted(((r["start"], r["length"], r["period"]) for r in of.as_py() or ()), key=lambda x: (x[0], x[2]))
                rows.append({"n_words": len(words), **_told(words, have)})
            yield pa.array(rows, _FOUND_KIND)
        release()

    key_schema = pa.schema([("digest", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                words = row["text"].split()
                lags = len(words) // LEAST_PERIODS
                low, high = lags * row["number"] // row["ranges"] + 1, lags * (row["number"] + 1) // row["ranges"]
                (runs,) = runs_of([words], low, high) if high >= low else ([],)
                if runs:
                    yield pa.RecordBatch.from_pylist([{"digest": row["digest"], "start": s, "length": n, "period": p} for s, n, p in runs], key_schema)
        release()

    own = [c for c in docs.columns if c != out]
    scratch = fresh(docs, "digest")
    data = F.col(text).cast("binary")
    long = F.coalesce(F.octet_length(data) > most_bytes, F.lit(False))
    short = docs.filter(~long).select(*own, found.asNondeterministic()(data).alias(out))
    texts = docs.filter(long).select(F.sha2(data, 256).alias("digest"), data.alias("text")).groupBy("digest").agg(F.first("text").alias("text"))
    ranges = F.least(F.lit(most_ranges), F.ceil(F.octet_length("text") / most_bytes)).cast("int")
    dealt = texts.withColumn("ranges", ranges).withColumn("number", F.explode(F.sequence(F.lit(0), F.col("ranges") - 1))).repartition("digest", "number")
    # a text has fewer runs than words
    united = dealt.mapInArrow(ranged, "digest string, start bigint, length bigint, period bigint").groupBy("digest").agg(F.collect_set(F.struct("start", "length", "period")).alias("runs"))
    keyed = docs.filter(long).withColumn(scratch, F.sha2(data, 256))
    met = keyed.join(united.select(F.col("digest").alias(f"{scratch}_of"), F.col("runs").alias(f"{scratch}_runs")), F.col(scratch) == F.col(f"{scratch}_of"), "left")
    far = met.select(*own, given.asNondeterministic()(data, F.col(f"{scratch}_runs")).alias(out))
    return short.unionByName(far)


def tiled(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and text, with periodic tails planted in a tenth of the texts: with h = crc32 of the id and g = h div 10, where h % 10
    is 0 and there are words, word i >= a becomes word a + (i - a) % p, where a = g % n, p = 1 + (n - a) div (3 + g % 8)."""
    h = F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")))
    g = F.floor(h / 10)

    def planted(words: Column) -> Column:
        n = F.size(words)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        tail = F.flatten(F.array_repeat(F.slice(words, a + 1, F.least(p, n - a)), F.ceil((n - a) / p).cast("int")))
        return F.array_join(F.concat(F.slice(words, F.lit(1), a), F.slice(tail, F.lit(1), n - a)), " ")

    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    # an array of one, so that the words are taken once
    new = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, planted(w)))[0]
    return docs.select(F.col(key).alias("doc_id"), F.when(h % 10 == 0, F.coalesce(new, F.col(text))).otherwise(F.col(text)).alias("text"))


def report(docs: DataFrame, **bounds: int) -> DataFrame:
    """doc_id, n_runs, the best run and its exponent, and digests of the runs and of the collapsed text."""
    found = with_runs(docs.select("doc_id", "text"), **bounds)
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    best: Column = F.col("periodic.best")
    return found.select(
        "doc_id",
        F.size("periodic.runs").cast("bigint").alias("n_runs"),
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        F.expr("periodic.best.length * 1000 div periodic.best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("periodic.runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("periodic.collapsed", 256).alias("collapsed_sha256"),
    )
