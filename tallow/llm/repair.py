"""Conversation structure repair: the cheapest edits that make roles alternate, by a rank-compressed dynamic program.

A repaired conversation is empty, or an optional system turn and then pairs of user and assistant. Every turn is kept (K),
gets the role that its place asks for (R, 1) or is deleted (D, 2); empty turns may be inserted anywhere (I, 5); a truncated
turn that stays costs 5 more; a blank or repeated one has to go. Of the cheapest edits those whose initials (the audit) are
least in ASCII order win.

A run of insertions and the edit of the turn behind it are one macro edit; the macros' codes ("IK", "D") are free of prefixes,
and so are the audits of all states after the same turns. Two audits therefore compare by the ranks of the audits they extend
and, where those are the same, by their codes: a layer holds a cost, a rank and a parent pointer for each of four states
instead of strings, and the audit is read back along the pointers.

Distribution: equal rows are counted, rows are range-sorted by conversation and turn, so that a long conversation lies in
several tasks, and each task cuts its rows into segments of bounded size. Most conversations are one segment and done at
once. A segment of a longer one is described by costs and ranks from each entry to each exit state; these compose, by
task and then by conversation (a row a task), the path taken comes back down, and each segment writes its own edits.

Order: by turn, nulls first, then role and text; equal rows are adjacent. Cases: null roles and texts count as one space;
a null conversation is one like others; a role counts by its first character (case counts, others than s, u and a can't be
kept); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import release, ship
from .common import discard, holding, stored

_FAR = 1 << 60
#: States by the last role so far: nothing, system, user, assistant. Inserting and changing roles follow the same arrows.
_NEXT = (2, 2, 3, 2)
_KEEP = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}, "": {}}
_FINAL = (0, 3)
_ROLE = {2: "user", 3: "assistant"}
_COST = {"K": 0, "R": 1, "D": 2, "I": 5}
_TRUNCATED = 5
#: Two insertions reach every state there is, so no cheapest edit has more in a row.
CODES = sorted("I" * k + edit for k in range(3) for edit in "DKR")
_LEGAL = {"su", "ua", "au"}
_WHITE = "\t\n\x0b\x0c\r "
#: Faults, in the order in which they count.
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)


def _after(state: int, code: str, initial: str) -> int | None:
    for edit in code:
        state = state if edit == "D" else _KEEP[initial].get(state) if edit == "K" else _NEXT[state]
        if state is None:
            return None
    return state


def _moves(initial: str, fault: int) -> list[list[tuple[int, int, int]]]:
    """Per state reached: (state before, cost, number of the code), the best of each pair of states."""
    best: dict[tuple[int, int], tuple[int, int]] = {}
    for number, code in enumerate(CODES):
        if fault in (BLANK, DUPLICATE) and code[-1] != "D":
            continue
        cost = sum(_COST[e] for e in code) + (_TRUNCATED if fault == TRUNCATED and code[-1] != "D" else 0)
        for s in range(4):
            t = _after(s, code, initial)
            if t is not None:
                best[s, t] = min(best.get((s, t), (_FAR, 0)), (cost, number))
    return [[(s, *best[s, t]) for s in range(4) if (s, t) in best] for t in range(4)]


_MOVES = {(i, f): _moves(i, f) for i in _KEEP for f in (SOUND, BLANK, DUPLICATE, TRUNCATED)}


def _initial(role: str) -> str:
    return role[:1] if role[:1] in _KEEP else ""


def layers(kinds: list[tuple[str, int]], again: list[int], entry: int) -> tuple[list, list, list]:
    """Costs and ranks of the four states after all turns from one entry state, and per turn the parent pointers (state, code).
    kinds: initial and fault of a turn; again: how many copies of it follow, which all go."""
    cost, rank = [_FAR] * 4, [-1] * 4
    cost[entry], rank[entry] = 0, 0
    pointers = []
    for kind, copies in zip(kinds, again):
        found, parents = [], [None] * 4
        for t, ways in enumerate(_MOVES[kind]):
            least = None
            for s, c, code in ways:
                if cost[s] < _FAR and (least is None or (cost[s] + c, rank[s], code) < least[:3]):
                    least = cost[s] + c, rank[s], code, s
            if least is not None:
                found.append((least[1], least[2], t, least[0]))
                parents[t] = (least[3], least[2])
        cost, rank = [_FAR] * 4, [-1] * 4
        for place, (_, _, t, c) in enumerate(sorted(found)):
            cost[t], rank[t] = c + _COST["D"] * copies, place
        pointers.append(parents)
    return cost, rank, pointers


def last_macro(cost: list[int], rank: list[int]) -> tuple[int, int, int]:
    """State before the end, insertions at the end, and total cost: an end may need up to two insertions."""
    ways = []
    for s in range(4):
        t = s
        for k in range(3):
            if cost[s] < _FAR and t in _FINAL:
                ways.append((cost[s] + _COST["I"] * k, rank[s], k, s))
            t = _NEXT[t]
    total, _, k, s = min(ways)
    return s, k, total


def edits(pointers: list, again: list[int], state: int) -> list[str]:
    """The macro edit of every turn, read back from the last state; copies of a turn add their D."""
    out = []
    for parents, copies in zip(reversed(pointers), reversed(again)):
        state, code = parents[state]
        out.append(CODES[code] + "D" * copies)
    return out[::-1]


def applied(roles: list[str], texts: list[str], macros: list[str], state: int, tail: int) -> list[dict]:
    """The turns that the macro edits leave, from the entry state on."""
    out = []
    for role, text, macro in zip(roles, texts, [*macros]):
        for edit in macro:
            if edit == "D":
                continue
            state = _KEEP[_initial(role)][state] if edit == "K" else _NEXT[state]
            out.append({"role": role if edit == "K" else _ROLE[state], "text": "" if edit == "I" else text})
    for _ in range(tail):
        state = _NEXT[state]
        out.append({"role": _ROLE[state], "text": ""})
    return out


class Summary:
    """What is known of a stretch of a conversation's turns: counts, its edges, and costs and ranks from entry to exit."""

    FIELDS = (
        "blank bigint, duplicate bigint, truncated bigint, illegal bigint, distinct_turns bigint, low bigint, high bigint, last_turn bigint, "
        "first_role string, last_role string, costs array<bigint>, ranks array<int>"
    )

    def __init__(self, row: dict):
        self.row = row

    @classmethod
    def of(cls, turns: list, roles: list[str], kinds: list[tuple[str, int]], again: list[int], matrix: bool) -> Summary:
        counts = [0, 0, 0, 0]
        for (_, fault), copies in zip(kinds, again):
            counts[fault] += 1
            counts[BLANK if fault == BLANK else DUPLICATE] += copies
        initials = [r[:1] for r in roles]
        illegal = sum(a + b not in _LEGAL for a, b in zip(initials, initials[1:])) + sum(again)  # a copy meets its like
        known = [t for t in turns if t is not None]
        costs, ranks = [], []
        for s in range(4) if matrix else ():
            c, r, _ = layers(kinds, again, s)
            costs += c
            ranks += r
        return cls(
            dict(zip(("blank", "duplicate", "truncated", "illegal"), (counts[BLANK], counts[DUPLICATE], counts[TRUNCATED], illegal)))
            | {"distinct_turns": len(set(known)), "low": known[0] if known else None, "high": known[-1] if known else None, "last_turn": turns[-1]}
            | {"first_role": initials[0], "last_role": initials[-1], "costs": costs, "ranks": ranks}
        )

    def then(self, other: Summary) -> Summary:
        a, b = self.row, other.row
        out = {k: a[k] + b[k] for k in ("blank", "duplicate", "truncated", "illegal", "distinct_turns")}
        out["illegal"] += a["last_role"] + b["first_role"] not in _LEGAL
        out["distinct_turns"] -= a["last_turn"] is not None and a["last_turn"] == b["low"]
        out |= {"low": b["low"] if a["low"] is None else a["low"], "high": a["high"] if b["high"] is None else b["high"]}
        out |= {"last_turn": b["last_turn"], "first_role": a["first_role"], "last_role": b["last_role"], "costs": [], "ranks": []}
        for s in range(4):
            cost, rank, _ = other.carried(a["costs"][4 * s : 4 * s + 4], a["ranks"][4 * s : 4 * s + 4])
            out["costs"] += cost
            out["ranks"] += rank
        return Summary(out)

    def carried(self, cost: list[int], rank: list[int]) -> tuple[list[int], list[int], list[int]]:
        """The states' costs and ranks behind this stretch from those before it, and the state that each came from."""
        costs, ranks, found, parent = self.row["costs"], self.row["ranks"], [], [-1] * 4
        for t in range(4):
            ways = [(cost[s] + costs[4 * s + t], rank[s], s) for s in range(4) if cost[s] < _FAR and costs[4 * s + t] < _FAR]
            if ways:
                c, r, s = min(ways)
                parent[t] = s
                found.append((r, ranks[4 * s + t], t, c))
        cost, rank = [_FAR] * 4, [-1] * 4
        for place, (_, _, t, c) in enumerate(sorted(found)):
            cost[t], rank[t] = c, place
        return cost, rank, parent


def _path(stretches: list[Summary], entry: int, leave: int | None) -> tuple[list[tuple[int, int]], int, int]:
    """(entry, exit) state of every stretch, the insertions at the end and the total cost; leave None: the conversation ends."""
    cost, rank = [_FAR] * 4, [-1] * 4
    cost[entry], rank[entry] = 0, 0
    parents, tail, total = [], 0, 0
    for s in stretches:
        cost, rank, parent = s.carried(cost, rank)
        parents.append(parent)
    state = leave
    if state is None:
        state, tail, total = last_macro(cost, rank)
    out = []
    for parent in reversed(parents):
        out.append((parent[state], state))
        state = parent[state]
    return out[::-1], tail, total


_TURNS = "array<struct<role:string,text:string>>"


def _segment_schema(key: str) -> str:
    return f"conv_id {key}, part int, segment bigint, whole boolean, {Summary.FIELDS}, cost bigint, audit string, turns {_TURNS}, faults array<int>, again array<bigint>"


def _segmenter(schema: pa.Schema, most_rows: int, most_chars: int):
    """Rows in order -> segments. Rows of one key (conversation, turn, role, text) come together: the mark that says that
    this is the first turn with the role and text, if it is, and the row with its number of copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        out, held = [], 0
        n_segments, size = 0, 0
        now = {"conv": None, "turns": [], "roles": [], "texts": [], "faults": [], "again": []}
        begun = inner = cut = False  # a conversation is open; not the first of the task; has segments already

        def segment(whole: bool) -> dict:
            nonlocal n_segments
            kinds = [(_initial(r), f) for r, f in zip(now["roles"], now["faults"])]
            row = Summary.of(now["turns"], now["roles"], kinds, now["again"], not whole).row | {"conv_id": now["conv"], "part": part, "segment": (part << 32) + n_segments, "whole": whole}
            n_segments += 1
            if whole:
                cost, rank, pointers = layers(kinds, now["again"], 0)
                state, tail, total = last_macro(cost, rank)
                macros = edits(pointers, now["again"], state)
                row |= {"cost": total, "audit": "".join(macros) + "I" * tail, "turns": applied(now["roles"], now["texts"], macros, 0, tail), "faults": None, "again": None}
            else:
                row |= {"cost": None, "audit": None, "turns": [{"role": r, "text": t} for r, t in zip(now["roles"], now["texts"])], "faults": list(now["faults"]), "again": list(now["again"])}
            for name in ("turns", "roles", "texts", "faults", "again"):
                now[name] = []
            return row

        first = False
        for batch in batches:
            for conv, turn, role, text, copies in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "copies"))):
                if copies is None:
                    first = True
                    continue
                if not begun or conv != now["conv"]:
                    if begun:
                        out.append(segment(inner and not cut))
                        held += size
                    inner, begun, cut, size = begun, True, False, 0
                    now["conv"] = conv
                elif len(now["roles"]) >= most_rows or size >= most_chars:
                    out.append(segment(False))
                    held += size
                    cut, size = True, 0
                if len(out) >= 512 or held >= most_chars:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out, held = [], 0
                bare = text.rstrip(_WHITE)
                fault = BLANK if not bare else DUPLICATE if not first else SOUND if bare[-1] in ".!?" else TRUNCATED
                for name, value in (("turns", turn), ("roles", role), ("texts", text), ("faults", fault), ("again", copies - 1)):
                    now[name].append(value)
                size += len(text)
                first = False
        if begun:
            out.append(segment(False))  # it may go on in the next task
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)
        release()

    return run


def _arrow(schema: str, spark) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))


def _ordered(table: pa.Table, by: str) -> list[dict]:
    return table.sort_by(by).to_pylist()


def segments(conversations: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", most_rows: int = 1024, most_chars: int = 4 << 20) -> DataFrame:
    """All turns in segments of at most most_rows rows and about most_chars characters; whole ones are repaired already."""
    ship(conversations.sparkSession)
    c = lambda name: F.coalesce(F.col(name), F.lit(" "))
    rows = conversations.select(F.col(key).alias("conv_id"), F.col(turn).cast("bigint").alias("turn"), c(role).alias("role"), c(text).alias("text"))
    digest = F.sha2("text", 256).alias("digest")
    counted = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies")).select("conv_id", "turn", "role", digest, "copies", "text")
    # min() passes over nulls, which come first: a row without a turn counts as the lowest
    firsts = rows.groupBy("conv_id", "role", digest).agg(F.min("turn").alias("turn"), F.max(F.col("turn").isNull()).alias("before"))
    marks = firsts.select("conv_id", F.when(~F.col("before"), F.col("turn")).alias("turn"), "role", "digest", F.lit(None).cast("bigint").alias("copies"), F.lit(None).cast("string").alias("text"))
    order = ["conv_id", "turn", "role", "digest"]
    laid = counted.unionByName(marks).repartitionByRange(*order).sortWithinPartitions(*order, "copies")
    schema = _segment_schema(rows.schema["conv_id"].dataType.simpleString())
    kind = _arrow(schema, conversations.sparkSession)
    return stored(laid.mapInArrow(_segmenter(kind, most_rows, most_chars), schema), "segments")


def repaired(conversations: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", most_rows: int = 1024, most_chars: int = 4 << 20) -> tuple[DataFrame, DataFrame]:
    """Two tables. Pieces: conv_id, segment (their order), whole, audit and turns (role, text) as repaired; a conversation that
    is not whole has several. Conversations: conv_id, gaps, blank, duplicate, truncated, illegal, cost."""
    spark = conversations.sparkSession
    cut = segments(conversations, key, turn, role, text, most_rows, most_chars)
    id_type = cut.schema["conv_id"].dataType.simpleString()
    names = [f.split()[0] for f in Summary.FIELDS.split(", ")]
    open_ones = cut.filter("not whole").select("conv_id", "part", "segment", *names)

    # up: the stretch that a task has of a conversation, then the conversation
    part_schema = f"conv_id {id_type}, part int, {Summary.FIELDS}"
    part_kind = _arrow(part_schema, spark)

    def composed(table: pa.Table) -> pa.Table:
        rows = _ordered(table, "segment")
        whole = Summary(rows[0])
        for r in rows[1:]:
            whole = whole.then(Summary(r))
        return pa.Table.from_pylist([{n: whole.row[n] for n in names} | {"conv_id": rows[0]["conv_id"], "part": rows[0]["part"]}], part_kind)

    by_part = stored(open_ones.groupBy("conv_id", "part").applyInArrow(composed, part_schema), "parts")
    path_schema = f"path_id {id_type}, path_part int, entry int, leave int, tail int, cost bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, distinct_turns bigint, low bigint, high bigint"
    path_kind = _arrow(path_schema, spark)

    def chained(table: pa.Table) -> pa.Table:
        rows = _ordered(table, "part")  # a row a task at most
        stretches = [Summary(r) for r in rows]
        states, tail, total = _path(stretches, 0, None)
        whole = stretches[0]
        for s in stretches[1:]:
            whole = whole.then(s)
        out = [{"path_id": r["conv_id"], "path_part": r["part"], "entry": a, "leave": b, "tail": 0} for r, (a, b) in zip(rows, states)]
        out[-1] |= {"tail": tail, "cost": total} | {n: whole.row[n] for n in ("blank", "duplicate", "truncated", "illegal", "distinct_turns", "low", "high")}
        return pa.Table.from_pylist(out, path_kind)

    paths = stored(by_part.groupBy("conv_id").applyInArrow(chained, path_schema), "paths")
    discard(by_part)

    # down: the states at the edges of every segment, then its edits
    same = F.col("conv_id").eqNullSafe(F.col("path_id")) & (F.col("part") == F.col("path_part"))
    state_schema = "at bigint, entry int, leave int, tail int"
    state_kind = _arrow(state_schema, spark)

    def spread(table: pa.Table) -> pa.Table:
        rows = _ordered(table, "segment")
        states, _, _ = _path([Summary(r) for r in rows], rows[0]["entry"], rows[0]["leave"])
        out = [{"at": r["segment"], "entry": a, "leave": b, "tail": 0} for r, (a, b) in zip(rows, states)]
        out[-1]["tail"] = rows[0]["tail"]
        return pa.Table.from_pylist(out, state_kind)

    known = open_ones.join(paths.select("path_id", "path_part", "entry", "leave", "tail"), same).drop("path_id", "path_part")
    edges = known.groupBy("conv_id", "part").applyInArrow(spread, state_schema)
    piece_schema = f"conv_id {id_type}, segment bigint, whole boolean, audit string, turns {_TURNS}"
    piece_kind = _arrow(piece_schema, spark)

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in (row for i in range(batch.num_rows) for row in batch.slice(i, 1).to_pylist()):
                roles, texts = [t["role"] for t in r["turns"]], [t["text"] for t in r["turns"]]
                kinds = [(_initial(x), f) for x, f in zip(roles, r["faults"])]
                macros = edits(layers(kinds, r["again"], r["entry"])[2], r["again"], r["leave"])
                out = {"conv_id": r["conv_id"], "segment": r["segment"], "whole": False, "audit": "".join(macros) + "I" * r["tail"], "turns": applied(roles, texts, macros, r["entry"], r["tail"])}
                yield pa.RecordBatch.from_pylist([out], piece_kind)
        release()

    several = cut.filter("not whole").select("conv_id", "segment", "turns", "faults", "again").join(edges, F.col("segment") == F.col("at")).mapInArrow(written, piece_schema)
    pieces = cut.filter("whole").select("conv_id", "segment", "whole", "audit", "turns").unionByName(several)
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("distinct_turns"), F.lit(0)).cast("bigint").alias("gaps")
    told = ["blank", "duplicate", "truncated", "illegal", "cost"]
    totals = cut.filter("whole").select("conv_id", gaps, *told).unionByName(paths.filter("cost is not null").select(F.col("path_id").alias("conv_id"), gaps, *told))
    return holding(pieces, cut, paths), totals


def digests(pieces: DataFrame) -> DataFrame:
    """conv_id, audit, repaired_sha256 (of `role:text` lines) of every conversation. A whole piece is digested where it lies; pieces of
    longer conversations pass through one running digest each, in order and one at a time: a SHA-256 has no parallel form."""
    lines = lambda turns: F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    done = pieces.filter("whole").select("conv_id", "audit", F.sha2(lines(F.col("turns")), 256).alias("repaired_sha256"))
    rest = pieces.filter("not whole").select("conv_id", "segment", "audit", F.when(F.size("turns") > 0, lines(F.col("turns"))).alias("text"))
    schema = f"conv_id {pieces.schema['conv_id'].dataType.simpleString()}, audit string, repaired_sha256 string"
    kind = _arrow(schema, pieces.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, conv, audit, digest, empty = False, None, [], hashlib.sha256(), True
        told = lambda: pa.RecordBatch.from_pylist([{"conv_id": conv, "audit": "".join(audit), "repaired_sha256": digest.hexdigest()}], kind)
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                if begun and r["conv_id"] != conv:
                    yield told()
                    audit, digest, empty = [], hashlib.sha256(), True
                begun, conv = True, r["conv_id"]
                audit.append(r["audit"])
                if r["text"] is not None:
                    digest.update(("" if empty else "\n").encode() + r["text"].encode())
                    empty = False
        if begun:
            yield told()
        release()

    return done.unionByName(rest.repartition("conv_id").sortWithinPartitions("conv_id", "segment").mapInArrow(run, schema))


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with planted faults, by crc32(`conv_id:turn`) % 20: 0 drops a row, 1 empties its text, 2 takes
    its full stops, 3 repeats it, 4 makes it the user's. Nulls count as one space."""
    c = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", c("role").alias("role"), c("text").alias("text"), (F.crc32(F.concat(c("conv_id"), F.lit(":"), c("turn"))) % 20).alias("fault")).filter("fault <> 0")
    role = F.when(F.col("fault") == 4, F.lit("user")).otherwise(F.col("role")).alias("role")
    text = F.when(F.col("fault") == 1, F.lit("")).when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text")
    copies = F.array_repeat(F.lit(0), F.when(F.col("fault") == 3, 2).otherwise(1))
    return rows.select("conv_id", "turn", role, text, F.explode(copies).alias("copy")).drop("copy")


def report(conversations: DataFrame, turns: DataFrame, **bounds: int) -> DataFrame:
    """One row a conversation of `conversations`, repaired from `turns`; one without turns has zeros and nothing in it."""
    pieces, totals = repaired(turns, **bounds)
    ids = conversations.select("conv_id").distinct()
    r, d = totals.withColumnRenamed("conv_id", "r"), digests(pieces).withColumnRenamed("conv_id", "d")
    joined = ids.join(r, F.col("conv_id").eqNullSafe(F.col("r")), "left").join(d, F.col("conv_id").eqNullSafe(F.col("d")), "left")
    zero: list[Column] = [F.coalesce(F.col(n), F.lit(0)).cast("bigint").alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


#: CRC-32 of an ASCII text as DuckDB SQL: the byte table by its rule (eight shifts each), then a reduction over the bytes.
CRC_TABLE = "crc as (select list(list_reduce(list_prepend(n::bigint, range(8)), lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by n) as tab from range(256) as r(n))"


def crc_sql(text: str) -> str:
    return f"xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, length({text}) + 1), lambda i: ord({text}[i])::bigint)), lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295)"


ORACLE = rf"""
with recursive {CRC_TABLE},
named as (select coalesce(conv_id::varchar, 'null') as c, conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
                 coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as id from conversations),
hit as (select *, {crc_sql('id')} % 20 as k from named, crc),
harmed as (
  select c, turn, case when k = 4 then 'user' else role end as role,
         case k when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
         unnest(range(case k when 0 then 0 when 3 then 2 else 1 end)) as copy
  from hit),
placed as (
  select *, row_number() over (partition by c order by turn nulls first, role, sha256(text), copy) as i,
         row_number() over (partition by c, role, text order by turn nulls first, copy) > 1 as seen, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as bare
  from harmed),
judged as (
  select *, left(role, 1) as initial, case when bare = '' then 1 when seen then 2 when right(bare, 1) not in ('.', '!', '?') then 3 else 0 end as fault,
         lag(left(role, 1)) over (partition by c order by i) || left(role, 1) as pair
  from placed),
told as (
  select c, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 1) as blank, count(*) filter (fault = 2) as duplicate,
         count(*) filter (fault = 3) as truncated, count(*) filter (pair not in ('su', 'ua', 'au')) as illegal, max(i) as n
  from judged group by c),
arrow(st, nx, line) as (values (0, 2, 'user:'), (1, 2, 'user:'), (2, 3, 'assistant:'), (3, 2, 'user:')),
inserted as (
  select st, st as mid, '' as code, 0 as cost, '' as lines from arrow
  union all select st, nx, 'I', 5, line || chr(10) from arrow
  union all select a.st, b.nx, 'II', 10, a.line || chr(10) || b.line || chr(10) from arrow a join arrow b on b.st = a.nx),
kept(initial, mid, nx) as (values ('s', 0, 1), ('u', 0, 2), ('u', 1, 2), ('u', 3, 2), ('a', 2, 3)),
walk as (
  select c, 0::bigint as i, 0 as st, 0::bigint as cost, '' as audit, '' as lines from told
  union all
  select c, i, nx, cost, audit, lines from (
    select w.c, j.i, m.nx, w.cost + s.cost + m.cost as cost, w.audit || s.code || m.code as audit,
           w.lines || s.lines || case m.code when 'K' then j.role || ':' || j.text || chr(10) when 'R' then m.line || j.text || chr(10) else '' end as lines
    from walk w join judged j on j.c = w.c and j.i = w.i + 1 join inserted s on s.st = w.st
    join lateral (
      select s.mid as nx, 'D' as code, 2 as cost, '' as line
      union all select a.nx, 'R', 1 + case j.fault when 3 then 5 else 0 end, a.line from arrow a where a.st = s.mid and j.fault in (0, 3)
      union all select k.nx, 'K', case j.fault when 3 then 5 else 0 end, '' from kept k where k.mid = s.mid and k.initial = j.initial and j.fault in (0, 3)
    ) m on true
    qualify row_number() over (partition by w.c, m.nx order by w.cost + s.cost + m.cost, w.audit || s.code || m.code) = 1)),
ended as (
  select w.c, w.cost + s.cost as cost, w.audit || s.code as audit, w.lines || s.lines as lines
  from walk w join told t on t.c = w.c and t.n = w.i join inserted s on s.st = w.st where s.mid in (0, 3)
  qualify row_number() over (partition by w.c order by w.cost + s.cost, w.audit || s.code) = 1)
select distinct n.conv_id, coalesce(t.gaps, 0)::bigint as gaps, coalesce(t.blank, 0)::bigint as blank, coalesce(t.duplicate, 0)::bigint as duplicate,
       coalesce(t.truncated, 0)::bigint as truncated, coalesce(t.illegal, 0)::bigint as illegal, coalesce(e.cost, 0)::bigint as cost, coalesce(e.audit, '') as audit,
       sha256(left(coalesce(e.lines, ''), greatest(0, length(coalesce(e.lines, '')) - 1)::bigint)) as repaired_sha256
from (select distinct conv_id, c from named) n left join told t using (c) left join ended e using (c)
"""
