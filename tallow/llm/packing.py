"""Best-fit packing of tokenised documents into sequences, certified by lower bounds.

Documents are tokenised whole; only those longer than a sequence are cut. Every partition packs its
pieces by best-fit decreasing and computes a lower bound on its number of bins from dual feasible
functions. Where the two agree the partition is certified optimal by itself, and where the sum of bins meets the bound
over all pieces, everything is. While that gap is open, partitions exchange documents: the emptiest bins of all of them,
at first a few times the gap, are given up, dealt out anew, a bin whole, and packed again by best-fit decreasing; a
round is followed by one of four times as many bins, until the bound is met or several different deals of all bins
with room have gained nothing. Only what is given up is moved, and no round can lose bins.

Cases: null or empty text is one piece (the separator alone). Repeated rows are packed once each. An
empty table gives an empty result. Columns other than id and text are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import release, ship
from .common import discard, holding, stored

#: A byte-level vocabulary writes bytes as these code points: printable Latin-1 as itself, the rest from 256 up.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: Beyond these code points (and around special tokens) libraries' letter classes may differ.
_UNUSUAL = re.compile("[^\x00-ɏ]|<\\|")
_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_loaded: dict[str, tuple] = {}


def _merges_agree(model: dict, ranks: dict[bytes, int], slow) -> bool:
    """Whether merging by the vocabulary's ids (as the faster encoder does) is merging by the file's list of merges.

    So it is where the merged tokens' ids rise along the list and every token is what its own bytes encode to: which
    merges happen within a span depends on the span alone, so no pair can meet that only one of the encoders joins.
    """
    ids = [model["vocab"][a + b] for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"])]
    if any(a >= b for a, b in zip(ids, ids[1:])) or len(ids) + 256 != len(ranks):
        return False
    names = {i: token for token, i in model["vocab"].items()}
    return all(slow.model.tokenize(names[i])[0].id == i for i in ids)


def tokenizer(path: str) -> tuple:
    """The vocabulary as its own library reads it, and the same vocabulary and merges for the faster encoder (None where
    the file is not of the kind that it can stand for)."""
    if path not in _loaded:
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        slow, fast, vocabulary = Tokenizer.from_file(path), None, spec["model"]["vocab"]
        others = (b for b in range(256) if b not in set(_PRINTABLE))
        as_byte = {chr(b): b for b in _PRINTABLE} | {chr(256 + i): b for i, b in enumerate(others)}
        ranks = {bytes(as_byte[c] for c in token): i for token, i in vocabulary.items() if all(c in as_byte for c in token) and not token.startswith("<|")}
        plain = spec.get("normalizer") is None and (spec.get("pre_tokenizer") or {}) == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        if plain and _merges_agree(spec["model"], ranks, slow):
            fast = tiktoken.Encoding("byte_bpe", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
        _loaded[path] = slow, fast
    return _loaded[path]


def encode(text: str, path: str) -> np.ndarray:
    """Ids of the whole text as the tokenizers library gives them. Ordinary Latin text takes the faster
    encoder, which gives the same ids there; anything unusual takes the library itself."""
    slow, fast = tokenizer(path)
    if fast is None or _UNUSUAL.search(text):
        return np.array(slow.encode(text, add_special_tokens=False).ids, "<u4")
    return np.array(fast.encode_ordinary(text), "<u4")


def cut(ids: np.ndarray, length: int, separator: int) -> list[tuple[int, int, int]]:
    """Pieces (start, length, crc32 of the ids) of a document and its separator; all but the first are full."""
    ids = np.append(ids, np.array([separator], "<u4"))
    first = (len(ids) - 1) % length + 1
    ends = range(first, len(ids) + 1, length)
    return [(s, e - s, zlib.crc32(ids[s:e].tobytes())) for s, e in zip([0, *ends], ends)]


def pieces(docs: DataFrame, path: str, length: int = 2048, separator: int = 0, key: str = "doc_id", text: str = "text", numbered: bool = False) -> DataFrame:
    """key, piece, start, length, ids_crc32 of every piece of every document; if numbered, also document, a number of its row, so that
    document and piece tell pieces apart where several rows share an id."""

    @F.arrow_udf("array<struct<start:bigint,length:bigint,ids_crc32:bigint>>")
    def tokenised(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]))
        for batch in batches:
            rows = []
            for t in batch.to_pylist():
                rows.append([{"start": s, "length": n, "ids_crc32": c} for s, n, c in cut(encode(t or "", path), length, separator)])
            yield pa.array(rows, kind)
        release()

    ship(docs.sparkSession)
    whole = docs.select(F.col(key).alias("doc_id"), tokenised.asNondeterministic()(F.col(text)).alias("p"))
    number = [F.monotonically_increasing_id().alias("document")] if numbered else []
    cut_up = whole.select("doc_id", *number, "p").select("doc_id", *(["document"] if numbered else []), F.posexplode("p").alias("piece", "p"))
    return cut_up.select("doc_id", "piece", "p.start", "p.length", "p.ids_crc32", *(["document"] if numbered else []))


def lower_bound(counts: np.ndarray, most_k: int = 40) -> int:
    """Least number of bins for counts[s] items of each size s (capacity: len(counts) - 1), by dual feasible functions.

    Two families: items above capacity - t become full and items below t vanish; and the rounding
    functions u_k, which map x to floor((k + 1) x) / k unless (k + 1) x is whole.
    """
    capacity = len(counts) - 1
    size = np.arange(capacity + 1)
    best = -(-int((counts * size).sum()) // capacity)
    above = np.cumsum(counts[::-1])[::-1]
    mass = np.concatenate([[0], np.cumsum(counts * size)])
    for t in range(1, capacity // 2 + 1):
        full = int(above[capacity - t + 1])
        between = int(mass[capacity - t + 1] - mass[t])
        best = max(best, full + -(-between // capacity))
    for k in range(1, most_k + 1):
        scaled = (k + 1) * size
        exact = scaled % capacity == 0
        # in units of 1 / (k * capacity), so that sums stay whole numbers
        unit = np.where(exact, size * k, (scaled // capacity) * capacity)
        best = max(best, -(-int((unit * counts).sum()) // (k * capacity)))
    return best


def best_fit(sizes: Iterable[int], capacity: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Best-fit decreasing. Per item: bin and offset in it; per bin: what is left of it."""
    sizes = np.asarray(sizes, np.int64)
    where, offset, left = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), []
    by_room: dict[int, list[int]] = {}
    rooms = 0  # bit r: some open bin has room r
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        fits = rooms >> s
        if fits:
            room = (fits & -fits).bit_length() - 1 + s
            stack = by_room[room]
            b = stack.pop()
            if not stack:
                rooms ^= 1 << room
        else:
            room, b = capacity, len(left)
            left.append(capacity)
        where[i], offset[i], left[b] = b, capacity - room, room - s
        if room > s:
            by_room.setdefault(room - s, []).append(b)
            rooms |= 1 << (room - s)
    return where, offset, left


_PIECE = ["doc_id", "piece", "start", "length", "ids_crc32"]
_PLACE = "sequence_id bigint, offset bigint, room int"


#: Numbers that a task may give to its bins.
_WIDTH = 1 << 27


def _packer(capacity: int, base: int | None):
    """The packing of one partition, with the room left in each bin. Its new bins are numbered from base + task * _WIDTH on; base None: from
    task * _WIDTH, and nothing is packed yet. A re-packing that needs as many bins as it was given
    keeps what it was given, and so does a partition whose bins meet its bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        table = pa.Table.from_batches(got).combine_chunks()
        table = table.take(pa.compute.sort_indices(table, sort_keys=[("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")]))
        sizes = table["length"].to_numpy()
        keep = False
        if base is not None:
            given, index = np.unique(table["sequence_id"].to_numpy(), return_inverse=True)
            keep = len(given) == lower_bound(np.bincount(sizes, minlength=capacity + 1))
        if not keep:
            where, offset, left = best_fit(sizes, capacity)
            if len(left) > _WIDTH:
                raise ValueError(f"more than {_WIDTH} sequences in one task: lower rows_a_partition")
            number = (base or 0) + TaskContext.get().partitionId() * _WIDTH + where
            keep = base is not None and len(given) <= len(left)
        if keep:
            number, where, offset = given[index], index, table["offset"].to_numpy()
            left = (capacity - np.bincount(index, weights=sizes)).astype(int).tolist()
        table = table.drop_columns([c for c in ("sequence_id", "offset") if c in table.column_names])
        for name, values in (("sequence_id", number), ("offset", offset), ("room", np.array(left, np.int32)[where])):
            table = table.append_column(name, pa.array(values))
        yield from table.to_batches(max_chunksize=50_000)

    return run


def _rooms(packed: DataFrame, capacity: int) -> tuple[np.ndarray, int]:
    """How many bins have each room (of a bin, the row at offset 0 counts), and a number above those of all bins. At most
    capacity + 1 rows reach the driver."""
    out, above = np.zeros(capacity + 1, np.int64), 0
    for r in packed.filter("offset = 0").groupBy("room").agg(F.count("*").alias("n"), F.max("sequence_id").alias("last")).collect():
        out[r["room"]], above = r["n"], max(above, r["last"] + 1)
    return out, above


def pack(cut_pieces: DataFrame, capacity: int = 2048, rows_a_partition: int = 65_536, deals: int = 3) -> DataFrame:
    """The pieces, whatever columns they have, with sequence_id and offset, and, the same in every row, bins (sequences in all) and bound (no packing
    has fewer). rows_a_partition bounds what one task holds; bins stop moving after `deals` different deals of all bins with room in a
    row have gained nothing."""
    ship(cut_pieces.sparkSession)
    held = stored(cut_pieces, "pieces")
    carried = [*_PIECE, *(c for c in held.columns if c not in _PIECE)]
    held = holding(held.select(*carried), held)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema.fields), _PLACE])
    counts = np.zeros(capacity + 1, np.int64)
    for r in held.groupBy("length").count().collect():  # at most capacity rows
        counts[r["length"]] = r["count"]
    total, bound = int(counts.sum()), lower_bound(counts)
    first = stored(held.repartition(max(1, -(-total // rows_a_partition))).mapInArrow(_packer(capacity, None), schema), "packed")
    discard(held)
    # still: rows of `first` with less room than `least`; moved: the last round's result, with all rows that it took from there
    still, base = _rooms(first, capacity)
    least, moved = capacity + 1, None
    rooms = np.zeros(capacity + 1, np.int64)
    wanted = idle = round_no = 0
    while (gap := int(still.sum() + rooms.sum()) - bound) > 0 and idle < deals:
        wanted = max(64, 8 * gap, 4 * wanted)
        # the least room of bins to give up, so that they are about as many as wanted; full bins stay
        enough = np.flatnonzero(np.cumsum((still + rooms)[::-1])[::-1][1:] >= wanted)
        now = min(least, int(enough[-1]) + 1 if len(enough) else 1)
        pool = first.filter((F.col("room") >= now) & (F.col("room") < least))
        if moved is not None:
            pool = pool.unionByName(moved)
        taken = int(still[now:].sum() + rooms.sum())
        still[now:] = 0
        n, round_no = pool.count(), round_no + 1
        parts = max(1, -(-n // rows_a_partition))
        was, moved = moved, stored(pool.drop("room").repartition(parts, "sequence_id", F.lit(round_no)).mapInArrow(_packer(capacity, base), schema), "packed")
        discard(was)
        (rooms, above), least = _rooms(moved, capacity), now
        base = max(base, above)
        idle = idle + 1 if now == 1 and int(rooms.sum()) == taken else 0
        if parts == 1 and idle:
            break  # one task had all bins with room: another deal is the same
    out = first.filter(F.col("room") < least)
    if moved is not None:
        out = out.unionByName(moved)
    return out.drop("room").withColumn("bins", F.lit(int(still.sum() + rooms.sum())).cast("bigint")).withColumn("bound", F.lit(bound).cast("bigint"))


def certificate(packed: DataFrame, capacity: int = 2048) -> dict[str, int]:
    """Bins used and the lower bound over all pieces, from the at most `capacity` distinct lengths."""
    counts = np.zeros(capacity + 1, np.int64)
    for row in packed.groupBy("length").count().collect():
        counts[row["length"]] = row["count"]
    return {"bins": packed.select("sequence_id").distinct().count(), "bound": lower_bound(counts)}
