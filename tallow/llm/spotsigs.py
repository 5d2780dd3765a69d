"""Document fingerprints by spot signatures.

Common words (articles, prepositions, auxiliaries of several languages) are anchors. A signature is an
anchor with the chain of the next content words after it, by default two, other common words skipped;
its 32-bit hash stands for it. A text's fingerprint is the sorted set of its signatures, so that
likeness is the Jaccard similarity of sets, read from fingerprints alone. Boilerplate, which has few
common words, gives few signatures.

Near duplicates: sets are partitioned by length into ranges so narrow that only neighbouring ranges can
reach the threshold; within a range, a set is compared with sets that share one of its first rare
signatures (prefix) and whose length bound allows the threshold.

Cases: a text without anchors takes every word as an anchor; a text without words has the empty
fingerprint; two empty fingerprints have likeness 1, an empty and another 0; null text counts as empty;
repeated rows have equal fingerprints; null ids sort first, rows of one id by the SHA-1 of their texts; an empty table
gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import release, ship
from . import jaccard_join, wordhash
from .common import discard, small, stored
from .ranges import Parts, even_parts, id_key
from .wordhash import NOT_ALNUM, mixed

#: Common words of English, French, German, Spanish, Italian and Portuguese.
ANCHORS = (
    "a an the of to in on at by for from with as is are was were be been it its this that these those he she they we you i and or but not "
    "have has had do does did will would can could there their his her our your which who what when than then so if into about over "
    "le la les un une des du de et en est dans pour par sur qui que au aux avec ne pas ce cette il elle "
    "der die das den dem des ein eine einer und ist von mit zu im auf für nicht sich als auch es an dass "
    "el los las una y del al por con para se su lo como más pero sus o "
    "il lo gli uno di che non per sono da della del nel os as um uma e em não do dos na no mais"
).split()
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def _anchor_hashes() -> np.ndarray:
    return np.unique(np.array([wordhash.words([w.encode()], NOT_ALNUM)[0][0] for w in set(ANCHORS)], np.uint64))


_ANCHORS = _anchor_hashes()


def _is_anchor(hashes: np.ndarray) -> np.ndarray:
    at = np.searchsorted(_ANCHORS, hashes)
    return _ANCHORS[np.minimum(at, len(_ANCHORS) - 1)] == hashes


def signatures(texts: list[bytes], chain: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct signatures of every text, concatenated, and bounds: those of text i at bounds[i]:bounds[i + 1]."""
    keys, sizes = [], []
    for _, block in wordhash.blocks(texts):
        k, b = _signatures(block, chain)
        keys.append(k)
        sizes.append(np.diff(b))
    sizes = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
    return np.concatenate(keys) if keys else np.zeros(0, np.uint32), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def _signatures(texts: list[bytes], chain: int) -> tuple[np.ndarray, np.ndarray]:
    hashes, bounds = wordhash.words(texts, NOT_ALNUM)
    owner = np.repeat(np.arange(len(texts)), np.diff(bounds))
    anchor = _is_anchor(hashes)
    content = np.flatnonzero(~anchor)
    spots = np.flatnonzero(anchor)
    first = np.searchsorted(content, spots)
    usable = first < len(content)
    usable[usable] = owner[content[first[usable]]] == owner[spots[usable]]
    spots, first = spots[usable], first[usable]
    # texts with words but no usable anchor: every word is one, whatever follows makes the chain
    bare = np.ones(len(texts), bool)
    bare[owner[spots]] = False
    lone = np.flatnonzero(bare[owner])
    value = [_chained(hashes, owner, spots, content, first, chain), _chained(hashes, owner, lone, np.arange(len(hashes)), lone + 1, chain)]
    sig = (np.concatenate(value) >> np.uint64(32)).astype(np.uint32)
    return wordhash.per_text(sig, np.concatenate([owner[spots], owner[lone]]), len(texts))


def _chained(hashes: np.ndarray, owner: np.ndarray, spots: np.ndarray, follow: np.ndarray, first: np.ndarray, chain: int) -> np.ndarray:
    value = hashes[spots] * _A
    for j in range(chain):
        at = first + j
        there = at < len(follow)
        nxt = follow[np.where(there, at, 0)] if len(follow) else np.zeros(len(at), np.int64)
        there &= owner[nxt] == owner[spots] if len(owner) else there
        value = mixed(value * _B + np.where(there, hashes[nxt] if len(hashes) else np.uint64(0), _C))
    return value


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Jaccard similarity of text i's set in a and in b, for every i."""
    na, nb = np.diff(a[1]), np.diff(b[1])
    tag = lambda x, n: np.repeat(np.arange(len(n), dtype=np.uint64), n) << np.uint64(32) | x[0]
    common = np.intersect1d(tag(a, na), tag(b, nb), assume_unique=True)
    both = np.bincount((common >> np.uint64(32)).astype(np.int64), minlength=len(na))
    union = na + nb - both
    return np.where(union == 0, 1.0, both / np.maximum(union, 1))


def shown(s: tuple[np.ndarray, np.ndarray]) -> list[str]:
    """Fingerprints as text: base64 of the sorted big-endian 32-bit signatures."""
    raw, at = s[0].astype(">u4").tobytes(), s[1] * 4
    return [base64.b64encode(raw[i:j]).decode() for i, j in zip(at[:-1].tolist(), at[1:].tolist())]


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """docs and a string column with the text's fingerprint."""

    @F.arrow_udf("string")
    def spotted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(shown(signatures([b or b"" for b in batch.to_pylist()])), pa.string())

    ship(docs.sparkSession)
    return docs.withColumn(out, spotted.asNondeterministic()(F.col(text).cast("binary")))


#: Bytes of a row beside its text, about.
_ROW = 64
_SENT = "doc_id {kind}, part bigint, guest boolean, key string, copies bigint, size bigint, text binary"


def _dealer(parts, codec: str = "zstd"):
    """Rows to their parts, texts compressed; the first row of a part goes to the part before it too, as its guest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p: Parts = parts.value
        pack = pa.Codec(codec, compression_level=1)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows, keys = [], batch.column("key").slice(at, 256).to_pylist()
                own = p.of(keys).tolist()
                for i, (key, place) in enumerate(zip(keys, own)):
                    if p.pieces and key in p.pieces:
                        continue
                    part = int(p.number[place])
                    rows.append((i, part, False, key))
                    if p.first[place] == key.encode():
                        rows.append((i, p.before(part), True, key))
                if not rows:
                    continue
                picked, number, guest, key = zip(*rows)
                texts = [t or b"" for t in batch.column("text").slice(at, 256).to_pylist()]
                packed = {i: pack.compress(texts[i], asbytes=True) for i in set(picked)}
                ids = batch.column("doc_id").slice(at, 256).take(pa.array(picked))
                yield pa.RecordBatch.from_arrays([ids, pa.array(number, pa.int64()), pa.array(guest), pa.array(key), pa.array([1] * len(rows), pa.int64()), pa.array([len(texts[i]) for i in picked], pa.int64()), pa.array([packed[i] for i in picked], pa.binary())], ["doc_id", "part", "guest", "key", "copies", "size", "text"])

    return run


def in_order(docs: DataFrame, key: str = "doc_id", text: str = "text", part_bytes: int = 24 << 20) -> DataFrame:
    """doc_id, part, guest, key, copies, size, text (compressed): rows dealt out by even ranges of id and text, a task a
    range, sorted, each part closed by a guest, the first row of the next one (of the first part, after the last). Of
    rows that fill several parts with their copies each part has one, with the number of copies."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("text"))
    rows = rows.withColumn("key", F.concat(id_key("doc_id"), F.sha1("text")))
    weighed = rows.groupBy("key").agg(F.max(F.octet_length("text").cast("bigint") + _ROW).alias("weight"), F.count("*").alias("copies"))
    parts = even_parts(weighed, part_bytes)
    kind = docs.schema[key].dataType.simpleString()
    sent = rows.mapInArrow(_dealer(docs.sparkSession.sparkContext.broadcast(parts)), _SENT.format(kind=kind))
    if parts.pieces:
        listed = []
        for k, pieces in parts.pieces.items():
            listed += [(k, part, False, copies) for part, _, copies in pieces]
            listed += [(k, part, True, 1) for part, _, _ in pieces[:-1]]  # the next copy follows in the next part
            if parts.begins(k) == pieces[0][0]:
                listed.append((k, parts.before(pieces[0][0]), True, 1))
        table = docs.sparkSession.createDataFrame(listed, "key string, part bigint, guest boolean, copies bigint")
        packed = _packed()
        # of even_parts' most_parts keys at most, a row each
        once = rows.join(F.broadcast(table.select("key").distinct()), "key").groupBy("key").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"))
        once = once.select("doc_id", "key", F.octet_length("text").cast("bigint").alias("size"), packed("text").alias("text")).join(F.broadcast(table), "key")
        sent = sent.unionByName(once.select(*sent.columns))
    return sent.repartitionById(parts.n, F.col("part").cast("int")).sortWithinPartitions("part", "guest", "key")


def _packed():
    @F.arrow_udf("binary")
    def packed(texts: pa.Array) -> pa.Array:
        pack = pa.Codec("zstd", compression_level=1)
        return pa.array([pack.compress(t, asbytes=True) for t in texts.to_pylist()], pa.binary())

    return packed.asNondeterministic()


def edited(text: str, following: str) -> str:
    """The last half of the code points (rounded down) replaced by the first as many of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_COMPARED = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _compared(ids: list, texts: list[str]) -> pa.RecordBatch:
    """Rows for all texts but the last, which only follows."""
    own = signatures([t.encode() for t in texts])
    changed = [edited(a, b).encode() for a, b in zip(texts, texts[1:])]
    after = signatures(changed)
    here = own[0][: own[1][-2]], own[1][:-1]
    behind = own[0][own[1][1] :], own[1][1:] - own[1][1]
    columns = [ids[:-1], [len(t) for t in texts[:-1]], [hashlib.sha256(c).hexdigest() for c in changed], shown(here), shown(after), likeness(here, after), likeness(here, behind)]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _COMPARED)], schema=_COMPARED)


def with_edits(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next: each text against a
    text whose second half is the next document's, and against the next document, by ascending id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = pa.Codec("zstd")
        ids, texts, size, part, closed = [], [], 0, None, False
        for batch in batches:
            columns = [batch.column(c) for c in ("doc_id", "part", "guest", "copies", "size", "text")]
            for i in range(batch.num_rows):
                doc_id, p, guest, copies, n, packed = (c[i].as_py() for c in columns)
                if p != part:
                    ids, texts, size, part, closed = [], [], 0, p, False
                if closed:
                    continue  # equal rows: one of them closes the part
                t = unpack.decompress(packed, n, asbytes=True).decode("utf-8", "replace") if n else ""
                if copies > 1:  # all but the last are followed by themselves
                    ids, texts = [*ids, doc_id, doc_id], [*texts, t, t]
                    block = _compared(ids, texts)
                    yield block.slice(0, block.num_rows - 1)
                    once = max(1, wordhash.BLOCK // (n + _ROW))
                    for done in range(0, copies - 1, once):
                        yield block.take(pa.array([block.num_rows - 1] * min(once, copies - 1 - done)))
                    ids, texts, size = [doc_id], [t], len(t)
                    continue
                ids.append(doc_id)
                texts.append(t)
                size += len(t)
                closed = guest
                if closed or size > 2 * wordhash.BLOCK:
                    if len(texts) > 1:
                        yield _compared(ids, texts)
                    ids, texts, size = ids[-1:], texts[-1:], len(t)
        release()

    kind = docs.schema[key].dataType.simpleString()
    return in_order(docs, key, text).mapInArrow(run, f"doc_id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _tokens(sets: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sets kept as bytes (little-endian 32-bit signatures, sorted and distinct) as 64-bit tokens, sorted and distinct."""
    sigs = np.frombuffer(b"".join(sets), "<u4")
    return wordhash.per_text(mixed(sigs.astype(np.uint64) + _C), np.repeat(np.arange(len(sets)), [len(s) // 4 for s in sets]), len(sets))


def kept_signatures(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and signatures (bytes) of every text, stored: texts are read and cut once, whatever is done with their sets."""

    @F.arrow_udf("binary")
    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            sigs, bounds = signatures([b or b"" for b in batch.to_pylist()])
            raw, at = sigs.astype("<u4").tobytes(), (bounds * 4).tolist()
            yield pa.array([raw[s:e] for s, e in zip(at, at[1:])], pa.binary())
        release()

    ship(docs.sparkSession)
    return stored(docs.select(F.col(key).alias("doc_id"), cut.asNondeterministic()(F.col(text).cast("binary")).alias("signatures")), "signatures")


def length_range(n: int, percent: int) -> int:
    """Number of the range of lengths that n lies in; ranges grow by 100 / percent, so that partners are in the same or
    neighbouring ones."""
    return int(np.floor(np.log(n) / np.log(100 / percent) + 1e-9))


def range_keys(tokens: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Index keys of a set, its tokens given rare first, with their places: the tokens of the prefix that a partner must
    share one of, in the set's own range and in that of its shortest partner."""
    n = len(tokens)
    need = jaccard_join.most_missing(n, percent) + 1
    ranges = {length_range(n, percent), length_range((percent * n + 99) // 100, percent)}
    keys = [mixed(tokens[:need] * _A + np.uint64(r)) for r in sorted(ranges)]
    return np.concatenate(keys), np.tile(np.arange(need), len(ranges))


class Matches(jaccard_join.Join):
    """Near duplicates among fingerprints (doc_id, signatures): sets are partitioned by length ranges and indexed by their rarest signatures;
    bounds by lengths, places in the index and bitmaps leave out most pairs, whole sets decide on the rest."""

    @staticmethod
    def _methods(k: int, percent: int):
        return _tokens, (lambda tokens, frequent: range_keys(tokens, percent))

    def linked(self) -> DataFrame:
        """doc_id, class_id of documents whose class has a smaller id than theirs; of an id with several texts the smallest."""
        rows = self.members().filter("leader is not null and doc_id is not null and leader.doc_id < doc_id")
        return stored(rows.groupBy("doc_id").agg(F.min("leader.doc_id").alias("class_id")), "linked")


def with_classes(prints: DataFrame, docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 80) -> DataFrame:
    """prints (with doc_id) and class_id: the smallest id of the documents that are joined by fingerprints alike in percent
    of their signatures; its own id for a document without such, and for one without words."""
    kept = kept_signatures(docs, key, text)
    matches = Matches(kept, "doc_id", "signatures", percent=percent)
    own = matches.linked()
    matches.close()
    discard(kept)
    return prints.join(small(own, own.count(), 32), "doc_id", "left").withColumn("class_id", F.coalesce("class_id", "doc_id"))
