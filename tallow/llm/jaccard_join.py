"""N-gram Jaccard join by token-combination prefixes, exact.

A document's tokens are its distinct word 4-gram shingles. Sets whose Jaccard similarity reaches the
threshold t miss at most n - ceil(t * n) of a set's n tokens in the other, so that a long enough prefix
of the tokens, in one global order (rare ones first), must meet. Rare tokens are indexed alone. Frequent
tokens are dealt into classes by hash, and each pair of a class is indexed: a class with e tokens in the
prefix survives e - 1 missing ones, so that the prefix is extended until rare tokens plus e - 1 for each
class exceed what may be missing. Index keys hold the level of the size (powers of two), which the partners
share because sizes differ by a factor t at most. With every key goes a place in the set's order: where
the key is the first that two sets share, no more common tokens can stand in a set than from there on, and
these must reach t / (1 + t) of both sizes. The place of a pair of frequent tokens allows for the single
tokens that the other classes may share before it.

1. One pass over the texts: sizes, digests of whole sets, bitmaps, and counters of tokens in 2**b hash
   buckets (b from the corpus' size; at most 2**26 buckets). A counting task's counters stop at 255 a bucket,
   which only makes the order of very frequent tokens coarser. Equal sets become one representative with
   a number of its own; ids play no part in what is linked.
2. A second pass: the index keys of each representative.
3. Star rounds: the members of an index key are verified against one of them only, the text with the most
   copies at first, in further rounds (star_rounds) the one with the most links. Components follow; an index key whose members all
   lie in one component has nothing more to add.
4. Rest round: in the keys that are left, all pairs across components that no round has tried and that
   the size and bitmap bounds allow are verified. Components again. A key of many members is dealt by size and block into
   cells, a pair of blocks each.

Verification compares whole sets. Pairs within a component are never made, so that a group of near
copies around a common original costs about as many pairs as it has members.

Cases: null text, no words: empty set, linked with nothing, a component of its own; rows with equal sets
are one class, whatever their ids; an id that several texts share, and rows without an id, are linked by
their texts like any other; the id of a component is its smallest one that is not null, null where there is none; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import release, ship
from . import wordhash
from .common import discard, holding, small, stored
from .components import components
from .wordhash import WHITE, mixed

_A, _B, _NONE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x27D4EB2F165667C5)
_CELL = 1 << 16
#: Bytes that a broadcast row of numbers and a digest takes, at most.
_ROW = 64
#: Sets of texts: (tokens of all texts, sorted and distinct within each, as 64-bit numbers; bounds).
Sets = Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]
#: Added to places in the index, which can be below zero.
_PLACE = 1 << 20
#: Sets smaller than this index every token alone; above, a level has its size / 128 classes of frequent tokens, one at least.
_LEAST_COMBINED = 64


def shingles(texts: list[bytes], k: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, concatenated, and bounds: those of text i at bounds[i]:bounds[i + 1].
    Fewer than k words are one shingle; no words none."""
    hashes, bounds = wordhash.words(texts, WHITE)
    counts = np.diff(bounds)
    owner = np.repeat(np.arange(len(texts)), counts)
    place = np.arange(len(hashes)) - np.repeat(bounds[:-1], counts)
    left = np.repeat(counts, counts) - place
    at = np.flatnonzero((left >= k) | (place == 0))
    value = np.zeros(len(at), np.uint64)
    for j in range(k):
        nxt = np.where(left[at] > j, hashes[np.minimum(at + j, len(hashes) - 1)], _NONE) if len(at) else value
        value = mixed(value * _B + nxt)
    return wordhash.per_text(value, owner[at], len(texts))


def most_missing(n: int, percent: int) -> int:
    """Tokens of a set of n that a partner may lack."""
    return n - (percent * n + 99) // 100


def digests(keys: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """The MD5 of each text's whole set."""
    raw, at = keys.tobytes(), (bounds * 8).tolist()
    return [hashlib.md5(raw[s:e]).digest() for s, e in zip(at, at[1:])]


def _level(n: int) -> int:
    return n.bit_length() - 1


def index_keys(tokens: np.ndarray, frequent: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Index keys of a set, its tokens given in the global order (rare first) with flags of the frequent ones; and for
    each key the least place from which on common tokens can stand, if it is the first that two sets share."""
    n = len(tokens)
    need = most_missing(n, percent) + 1
    keys, places = [], []
    for level in {_level(n), _level((percent * n + 99) // 100)}:
        if (1 << level) < _LEAST_COMBINED or not frequent[:need].any():
            keys.append(mixed(tokens[:need] * _A + np.uint64(level)))
            places.append(np.arange(need))
            continue
        n_classes = max(1, (1 << level) // 128)
        at = np.flatnonzero(frequent)
        classes = (mixed(tokens[at]) % np.uint64(n_classes)).astype(np.int64)
        gain = np.ones(n, np.int64)
        gain[at[np.unique(classes, return_index=True)[1]]] = 0  # the first of each class is not worth anything yet
        length = min(n, int(np.searchsorted(np.cumsum(gain), need)) + 1)
        single = np.flatnonzero(~frequent[:length])
        keys.append(mixed(tokens[single] * _A + np.uint64(level)))
        places.append(single)
        at = at[at < length]
        order = np.argsort(classes[: len(at)], kind="stable")
        at, classes = at[order], classes[: len(at)][order]
        often = mixed(tokens[at] * _A + np.uint64(level))
        starts = np.concatenate([[0], np.flatnonzero(np.diff(classes)) + 1, [len(classes)]])
        for s, e in zip(starts[:-1], starts[1:]):
            i, j = np.triu_indices(e - s, 1)
            # before the first common pair of its class stand no common tokens but one of each other class at most
            place = np.maximum(at[s:e][i] - (n_classes - 1), at[s:e][j] - n_classes)
            i, j, place = i[place < need], j[place < need], place[place < need]
            keys.append(mixed(often[s:e][i] * _B + often[s:e][j]))
            places.append(place)
    return np.concatenate(keys), np.concatenate(places)


_PROFILE = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("bits", pa.binary()), ("cell", pa.int64()), ("counts", pa.binary())])


def _profiler(sets: Sets, bucket_bits: int):
    """Rows of documents (n, digest and bitmap of the set), then rows of the partition's counters, a cell each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(1 << bucket_bits, np.uint32)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), [t or b"" for t in batch.column(1).to_pylist()]
            for begin, block in wordhash.blocks(texts):
                keys, bounds = sets(block)
                np.add.at(counters, (keys >> np.uint64(64 - bucket_bits)).astype(np.int64), np.uint32(1))
                sizes = np.diff(bounds)
                bitmaps = []
                for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                    bit = np.zeros(max(256, 4 << (e - s).bit_length() - 1) if e > s else 8, bool)
                    bit[(keys[s:e] & np.uint64(len(bit) - 1)).astype(np.int64)] = True
                    bitmaps.append(np.packbits(bit).tobytes())
                m = len(block)
                none = pa.nulls(m)
                yield pa.RecordBatch.from_arrays([pa.array(ids[begin : begin + m], pa.int64()), pa.array(sizes, pa.int64()), pa.array(digests(keys, bounds), pa.binary()), pa.array(bitmaps, pa.binary()), none.cast(pa.int64()), none.cast(pa.binary())], schema=_PROFILE)
        small = np.minimum(counters, 0xFF).astype(np.uint8)
        for cell in range(0, len(small), _CELL):
            part = small[cell : cell + _CELL]
            if part.any():
                yield pa.RecordBatch.from_pylist([{"doc_id": None, "n": None, "digest": None, "bits": None, "cell": cell // _CELL, "counts": part.tobytes()}], _PROFILE)
        release()

    return run


def _summed(table: pa.Table) -> pa.Table:
    total = np.zeros(_CELL, np.int64)
    for raw in table.column("counts").to_pylist():
        part = np.frombuffer(raw, np.uint8)
        total[: len(part)] += part
    # logarithmic: eighths of a power of two
    scaled = np.minimum(255, np.round(8 * np.log2(1 + total))).astype(np.uint8)
    return pa.table({"cell": table.column("cell")[:1], "counts": pa.array([scaled.tobytes()], pa.binary())})


def _indexer(sets: Sets, keys_of: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], shared, bucket_bits: int, frequent_from: int):
    """Rows (doc_id, digest, n, keys, places) of the sets that are not empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), [t or b"" for t in batch.column(1).to_pylist()]
            for begin, block in wordhash.blocks(texts):
                keys, bounds = sets(block)
                whole = digests(keys, bounds)
                often = counts[(keys >> np.uint64(64 - bucket_bits)).astype(np.int64)]
                owner = np.repeat(np.arange(len(block)), np.diff(bounds))
                order = np.lexsort((keys, often, owner))
                keys, frequent = keys[order], often[order] >= frequent_from
                rows, sizes, found, where = [], [], [], []
                for i, (s, e) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
                    if e > s:
                        rows.append(i)
                        sizes.append(e - s)
                        k_, p_ = keys_of(keys[s:e], frequent[s:e])
                        found.append(k_)
                        where.append(p_)
                flat = np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64)
                places = np.concatenate(where).astype(np.int32) if where else np.zeros(0, np.int32)
                offsets = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (flat, places)]
                yield pa.RecordBatch.from_arrays([pa.array([ids[begin + i] for i in rows], pa.int64()), pa.array([whole[i] for i in rows], pa.binary()), pa.array(sizes, pa.int64()), *lists], ["doc_id", "digest", "n", "keys", "places"])
        release()

    return run


def _set_of(sets: Sets):
    @F.arrow_udf("binary")
    def whole_set(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = []
            for _, block in wordhash.blocks([t or b"" for t in batch.to_pylist()]):
                keys, bounds = sets(block)
                raw, at = keys.tobytes(), (bounds * 8).tolist()
                out += [raw[s:e] for s, e in zip(at, at[1:])]
            yield pa.array(out, pa.binary())
        release()

    return whole_set.asNondeterministic()


def _differing_bits():
    """Bits in which two bitmaps differ: never more than tokens in one set only. Bitmaps have 4 to 8 bits a
    token and a power of two of them; the longer one is folded."""

    @F.arrow_udf("bigint")
    def differing(a: pa.Array, b: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(a.to_pylist(), b.to_pylist()):
            x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
            n = min(len(x), len(y))
            out.append(int(np.bitwise_count(np.bitwise_or.reduce(x.reshape(-1, n)) ^ np.bitwise_or.reduce(y.reshape(-1, n))).sum(dtype=np.int64)))
        return pa.array(out, pa.int64())

    return differing.asNondeterministic()


def _common():
    @F.arrow_udf("bigint")
    def common(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True)) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.int64())

    return common.asNondeterministic()


class Join:
    """The join over one table of documents; classes() gives its result, joining_links() the links that hold it together."""

    def __init__(self, docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 4, percent: int = 85, tokens_a_bucket: int = 32, most_bucket_bits: int = 26, star_rounds: int = 1, block: int = 512):
        ship(docs.sparkSession)
        self.docs = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("binary").alias("text"))
        self.percent, self.star_rounds, self.block = percent, star_rounds, block
        self.sets, self.keys_of = self._methods(k, percent)
        total = docs.agg(F.sum(F.octet_length(text).cast("bigint"))).first()[0] or 0
        self.bucket_bits = min(most_bucket_bits, max(16, int(total // (6 * tokens_a_bucket)).bit_length()))
        # a counting task takes text of many times its counters' size, so that these stay a small part of what is moved
        emitters = max(8, -(-total // (8 << self.bucket_bits)))
        self.profile = stored(self.docs.coalesce(emitters).mapInArrow(_profiler(self.sets, self.bucket_bits), "doc_id bigint, n bigint, digest binary, bits binary, cell bigint, counts binary"), "profile")
        self.reps = stored(self._representatives(), "representatives")
        discard(self.repeated)

    def close(self) -> None:
        """Removes the tables of the join. What members() or classes() gave reads them: write that first."""
        discard(self.profile, self.reps)

    @staticmethod
    def _methods(k: int, percent: int):
        """The sets of texts, and the index keys of a set in the global order with flags of its frequent tokens."""
        return (lambda texts: shingles(texts, k)), (lambda tokens, frequent: index_keys(tokens, frequent, percent))

    def digest_of(self, text: str) -> Column:
        """The digest of a text's whole set; null for the empty set."""
        own = _set_of(self.sets)(F.col(text).cast("binary"))
        return F.unhex(F.md5(F.nullif(own, F.lit(b""))))

    def sizes(self) -> DataFrame:
        return self.profile.filter("cell is null").select("doc_id", "n", "digest")

    def _representatives(self) -> DataFrame:
        """rep, digest, head, n, bits, copies, odd of every distinct set that is not empty: a number, the smallest id, and
        whether other rows than one have that id and set (or none has an id)."""
        rows = self.profile.filter("cell is null and n > 0")
        self.repeated = repeated = stored(rows.filter("doc_id is not null").groupBy("doc_id", "digest").count().filter("count > 1").select(F.col("doc_id").alias("head"), "digest", F.lit(True).alias("again")), "repeated")
        sets = rows.groupBy("digest").agg(F.min("doc_id").alias("head"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.count("*").alias("copies"))
        sets = sets.join(small(repeated, repeated.count(), _ROW), ["head", "digest"], "left")
        # the number is fixed once the table is written
        return sets.select(F.monotonically_increasing_id().alias("rep"), "digest", "head", "n", "bits", "copies", (F.col("head").isNull() | F.coalesce("again", F.lit(False))).alias("odd"))

    def _counters(self) -> tuple[bytes, int]:
        """All buckets' scaled counts (2**bucket_bits bytes), and the scaled count from which a token is frequent."""
        cells = self.profile.filter("cell is not null").select("cell", "counts").groupBy("cell").applyInArrow(_summed, "cell bigint, counts binary")
        out = np.zeros((1 << self.bucket_bits,), np.uint8)
        for row in cells.toLocalIterator():
            part = np.frombuffer(bytes(row["counts"]), np.uint8)
            at = row["cell"] * _CELL
            out[at : at + _CELL] = part[: len(out) - at]
        usual = float(np.exp2(out / 8.0).mean()) if len(out) else 0.0
        return out.tobytes(), int(np.ceil(8 * np.log2(1 + max(64.0, 3 * usual))))

    def _texts_of(self, odd: DataFrame) -> DataFrame:
        """Rows that can hold the sets of odd representatives: those of their ids, and those without an id."""
        heads = odd.filter("head is not null").select(F.col("head").alias("doc_id")).distinct()
        return self.docs.join(small(heads, heads.count(), _ROW), "doc_id", "left_semi").unionByName(self.docs.filter("doc_id is null"))

    def _index(self) -> DataFrame:
        """rep, n, weight, keys, places of every representative."""
        counts, frequent_from = self._counters()
        shared = self.docs.sparkSession.sparkContext.broadcast(counts)
        indexer, schema = _indexer(self.sets, self.keys_of, shared, self.bucket_bits, frequent_from), "doc_id bigint, digest binary, n bigint, keys array<bigint>, places array<int>"
        weighed = self.reps.select("rep", "digest", F.col("head").alias("doc_id"), F.floor(F.log2("copies")).alias("weight"), "odd")
        out = self.docs.filter("doc_id is not null").mapInArrow(indexer, schema).join(weighed.filter("not odd"), ["doc_id", "digest"])
        odd = weighed.filter("odd")
        if not odd.isEmpty():
            held = self._texts_of(odd.withColumnRenamed("doc_id", "head")).mapInArrow(indexer, schema).drop("doc_id").join(odd.drop("doc_id"), "digest")
            out = out.select("rep", "n", "weight", "keys", "places").unionByName(held.select("rep", "n", "weight", "keys", "places").dropDuplicates(["rep"]))
        return out.select("rep", "n", "weight", "keys", "places")

    def joining_links(self) -> tuple[DataFrame, DataFrame]:
        """(links between representatives that join components: a, b; components of the linked representatives). Both by
        the numbers in `reps`, which holds their smallest ids and digests.

        Not every pair that is alike: pairs inside a component joined already are not verified.
        """
        each = self._index().select("rep", "n", "weight", F.explode(F.arrays_zip("keys", "places")).alias("x"))
        # one number for size, place and weight: the index is by far the longest table that is moved
        packed = F.shiftleft("n", 32) + (F.col("x.places") + _PLACE) * 64 + F.col("weight")
        index = stored(each.select(F.col("x.keys").alias("key"), "rep", packed.alias("packed")), "index")
        # what a join follows is stored first, here and below: right after an aggregation by its key a join can't be split
        met = stored(index.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1").select("key"), "shared")
        held = stored(index.join(met, "key"), "postings")
        discard(index, met)
        low = F.col("packed").bitwiseAND(F.lit((1 << 32) - 1))
        postings = held.select("key", "rep", F.shiftright("packed", 32).alias("n"), (F.shiftright(low, 6) - _PLACE).alias("place"), low.bitwiseAND(F.lit(63)).alias("weight"))
        weights = None
        links = tried = found = None
        stars = self.star_rounds
        while True:
            open_rows = self._open(postings, found)
            last = stars == 0
            heads = None if last else self._heads(open_rows, weights)
            pairs, crowded = self._across(open_rows) if last else (self._stars(open_rows, heads), None)
            pairs = pairs.distinct()
            if tried is not None:
                pairs = pairs.join(tried.select("a", "b"), ["a", "b"], "left_anti")
            new = self._possible(pairs)
            discard(heads, open_rows, crowded)
            true = self._verified(new)
            tried = new if tried is None else holding(tried.unionByName(new), tried, new)
            stars = 0 if true.isEmpty() else max(0, stars - 1)  # a star round that gains nothing is the last one
            links = true if links is None else holding(links.unionByName(true), links, true)
            was, found = found, components(links)
            discard(was)
            if last:
                discard(held, tried)
                return links, found
            ends = links.select(F.col("a").alias("rep")).unionByName(links.select(F.col("b").alias("rep")))
            weights = ends.groupBy("rep").agg(F.count("*").alias("weight"))

    @staticmethod
    def _open(postings: DataFrame, found: DataFrame | None) -> DataFrame:
        """Rows (key, rep, n, place, component) of the keys whose members lie in several components."""
        if found is None:
            return postings.select("*", F.col("rep").alias("component"))
        named = postings.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", "n", "place", "weight", F.coalesce("component", "rep").alias("component"))
        named = stored(named, "named")
        several = stored(named.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("key"), "several")
        out = stored(named.join(several, "key"), "open")
        discard(named, several)
        return out

    @staticmethod
    def _pair(x: str, y: str) -> list[Column]:
        """Columns a, b, na, nb of two struct columns (rep, n), the smaller number first."""
        low, high = F.least(x, y), F.greatest(x, y)
        return [low["rep"].alias("a"), high["rep"].alias("b"), low["n"].alias("na"), high["n"].alias("nb")]

    @staticmethod
    def _heads(rows: DataFrame, weights: DataFrame | None) -> DataFrame:
        """Each key's heaviest member."""
        weighed = rows if weights is None else rows.drop("weight").join(weights, "rep", "left").withColumn("weight", F.coalesce("weight", F.lit(0)))
        head = F.struct("weight", (-F.col("n")).alias("m"), (-F.col("rep")).alias("i"), F.col("component").alias("c"), "place")
        return stored(weighed.groupBy("key").agg(F.max(head).alias("h")), "heads")

    def _stars(self, rows: DataFrame, heads: DataFrame) -> DataFrame:
        """Pairs of each key's heaviest member with the members of other components."""
        heads = heads.select("key", F.struct((-F.col("h.i")).alias("rep"), (-F.col("h.m")).alias("n"), F.col("h.place").alias("place")).alias("x"), F.col("h.c").alias("c"))
        met = rows.join(heads, "key").filter(F.col("component") != F.col("c")).withColumn("y", F.struct("rep", "n", "place"))
        return met.filter(self._fits("x", "y")).select(*self._pair("x", "y"))

    def _across(self, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Pairs of one key's members in different components, and a stored table that they read; sizes and places leave few partners for most members.

        Members of a crowded key are dealt into bands of size, of which partners share one or lie in two beside each other, and
        bands into blocks; two blocks meet in a cell of their own, so that a key is the work of many tasks.
        """
        band = F.floor(F.log("n") / math.log(101 / self.percent))  # a little wider than partners can lie apart
        rows = rows.withColumn("band", band)
        many = F.ceil(F.col("members") / self.block).cast("int")
        sizes = rows.groupBy("key", "band").agg(F.count("*").alias("members")).groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("band", many))).alias("blocks"), F.max(many).alias("most"))
        crowded = stored(sizes.filter("most > 1").select("key", "blocks"), "crowded")
        n = crowded.count()
        plain = rows if n == 0 else rows.join(small(crowded.select("key"), n, _ROW), "key", "left_anti")
        l, r = (plain.select("key", F.struct("rep", "n", "place").alias(x), F.col("component").alias(f"{x}c")) for x in "xy")
        pairs = l.join(r, "key").filter((F.col("x.rep") < F.col("y.rep")) & (F.col("xc") != F.col("yc")) & self._fits("x", "y")).select(*self._pair("x", "y"))
        return (pairs if n == 0 else pairs.unionByName(self._by_cells(rows.join(small(crowded, n, 4 * _ROW), "key")))), crowded

    def _by_cells(self, rows: DataFrame) -> DataFrame:
        """Pairs of crowded keys: rows have the number of blocks of each band of their key."""
        own, below, above = (F.col("blocks")[F.col("band") + d] for d in (0, -1, 1))
        rows = rows.withColumn("at", F.pmod(F.xxhash64("rep"), own).cast("int"))
        at = F.col("at")

        def cells(band: Column, apart: int, first: Column, last: Column, cell: Callable[[Column], tuple[Column, Column]]) -> Column:
            ks = F.when(last.isNotNull(), F.sequence(first, last)).otherwise(F.array().cast("array<int>"))  # no such band: no cells
            return F.transform(ks, lambda k: F.struct(band.alias("band"), F.lit(apart).alias("apart"), *(c.alias(o) for c, o in zip(cell(k), "ij"))))

        zero = F.lit(0)
        left = F.concat(cells(F.col("band"), 0, at, own - 1, lambda j: (at, j)), cells(F.col("band"), 1, zero, above - 1, lambda j: (at, j)))
        right = F.concat(cells(F.col("band"), 0, zero, at, lambda i: (i, at)), cells(F.col("band") - 1, 1, zero, below - 1, lambda i: (i, at)))
        l, r = (rows.select("key", F.struct("rep", "n", "place").alias(x), F.col("component").alias(f"{x}c"), F.explode(dealt).alias("cell")) for x, dealt in (("x", left), ("y", right)))
        met = l.join(r, ["key", "cell"])
        once = (F.col("x.rep") < F.col("y.rep")) | (F.col("cell.apart") > 0) | (F.col("cell.i") < F.col("cell.j"))
        return met.filter(once & (F.col("xc") != F.col("yc")) & self._fits("x", "y")).select(*self._pair("x", "y"))

    def _fits(self, x: str, y: str) -> Column:
        """Whether sizes and places (structs rep, n, place) leave room for enough common tokens."""
        enough = (F.col(f"{x}.n") + F.col(f"{y}.n")) * self.percent
        return ((F.col(f"{x}.n") - F.col(f"{x}.place")) * (100 + self.percent) >= enough) & ((F.col(f"{y}.n") - F.col(f"{y}.place")) * (100 + self.percent) >= enough) & (F.least(f"{x}.n", f"{y}.n") * (100 + self.percent) >= enough)

    def _possible(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b, na, nb) that the bitmaps allow: sets alike enough differ in few tokens, so in few bits. Stored."""
        bits, met = self.reps.select("rep", "bits"), stored(pairs, "met")
        n = met.count()
        longest = self.reps.agg(F.max(F.octet_length("bits"))).first()[0] or 0
        half = small(met, n, _ROW).join(bits.toDF("a", "bits_a"), "a")
        both = small(half, n, _ROW + longest).join(bits.toDF("b", "bits_b"), "b")
        bound = (F.col("na") + F.col("nb")) * (100 - self.percent) / (100 + self.percent)
        out = stored(both.withColumn("apart", _differing_bits()("bits_a", "bits_b")).filter(F.col("apart") <= bound + 1e-6).select("a", "b", "na", "nb"), "pairs")
        discard(met)
        return out

    def _verified(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) whose whole sets are alike enough. Sets are made anew from the texts of documents in pairs only."""
        ends = pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct()
        wanted = stored(self.reps.select("rep", "digest", "head", "odd").join(ends, "rep", "left_semi"), "wanted")
        plain, odd = wanted.filter("not odd").select("rep", "digest", F.col("head").alias("doc_id")), wanted.filter("odd")
        texts = self.docs.join(small(plain, plain.count(), _ROW), "doc_id").select("rep", "digest", _set_of(self.sets)("text").alias("s"))
        same = F.col("digest") == F.unhex(F.md5("s"))
        sets = texts.filter(same).select("rep", "s")
        if not odd.isEmpty():
            made = self._texts_of(odd).select(_set_of(self.sets)("text").alias("s")).withColumn("digest", F.unhex(F.md5("s")))
            sets = sets.unionByName(made.join(odd.select("rep", "digest"), "digest").select("rep", "s").dropDuplicates(["rep"]))
        sets = stored(sets, "sets")
        discard(wanted)
        both = pairs.join(sets.toDF("b", "sb"), "b").join(sets.toDF("a", "sa"), "a")
        common = both.select("a", "b", "na", "nb", _common()("sa", "sb").alias("c"))
        out = stored(common.filter(F.col("c") * 100 >= (F.col("na") + F.col("nb") - F.col("c")) * self.percent).select("a", "b"), "links")
        discard(sets)
        return out

    def members(self) -> DataFrame:
        """doc_id, n, digest, leader of every row; leader (doc_id, digest) is the first of the component by id (nulls
        last) and digest, null for an empty set."""
        links, found = self.joining_links()
        first = F.struct(F.col("head").isNull().alias("none"), F.col("head").alias("doc_id"), "digest")
        named = self.reps.select("digest", "rep", first.alias("first")).join(found.withColumnRenamed("node", "rep"), "rep", "left")
        named = stored(named.select("digest", F.coalesce("component", "rep").alias("component"), "first"), "named")
        leaders = stored(named.groupBy("component").agg(F.min("first").alias("leader")), "leaders")
        by_digest = stored(named.join(leaders, "component").select("digest", F.struct("leader.doc_id", "leader.digest").alias("leader")), "heads")
        discard(named, leaders, links, found)
        rows = self.sizes().withColumn("d", F.when(F.col("n") > 0, F.col("digest")))  # empty sets meet nothing
        return rows.join(by_digest.withColumnRenamed("digest", "d"), "d", "left").select("doc_id", "n", "digest", "leader")

    def classes(self) -> DataFrame:
        """doc_id, n_shingles, component_id of every row."""
        return self.members().select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("leader.doc_id", "doc_id").alias("component_id"))
