"""Conversation repair against a search over all edits, in whole and in cut conversations."""

import hashlib
import heapq
import random

import pytest
from pyspark.sql import functions as F

from tallow.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string"


def searched(rows):
    """(cost, audit, lines): best-first search over (rows done, roles so far as s, u, a, end), by cost, then audit."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, last, lines = heapq.heappop(heap)
        if (i, last) in done:
            continue
        done.add((i, last))
        if i == len(rows) and last in ("", "a"):
            return cost, audit, lines
        asked = "assistant" if last == "u" else "user"
        heapq.heappush(heap, (cost + 5, audit + "I", i, asked[0], (*lines, asked + ":")))
        if i == len(rows):
            continue
        role, text, fault = rows[i]
        heapq.heappush(heap, (cost + 2, audit + "D", i + 1, last, lines))
        if fault in ("blank", "duplicate"):
            continue
        more = 5 if fault == "truncated" else 0
        heapq.heappush(heap, (cost + 1 + more, audit + "R", i + 1, asked[0], (*lines, f"{asked}:{text}")))
        if role[:1] == asked[0] or (role[:1] == "s" and not last):
            heapq.heappush(heap, (cost + more, audit + "K", i + 1, role[:1], (*lines, f"{role}:{text}")))


def plainly(rows):
    rows = sorted(((t is not None, t or 0, r if r is not None else " ", hashlib.sha256((x if x is not None else " ").encode()).hexdigest(), x if x is not None else " ") for t, r, x in rows))
    seen, judged = set(), []
    for _, _, role, _, text in rows:
        bare = text.strip("\t\n\x0b\x0c\r ")
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
        seen.add((role, text))
        judged.append((role, text, fault))
    cost, audit, lines = searched(judged)
    turns = {t for known, t, *_ in rows if known}
    pairs = [a[0][:1] + b[0][:1] for a, b in zip(judged, judged[1:])]
    counts = [sum(f == k for _, _, f in judged) for k in ("blank", "duplicate", "truncated")]
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return (gaps, *counts, sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def made(seed, n=60):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(rng.randrange(1, 14)):
            text = rng.choice(["Yes.", "No!", "cut off", " ", "", "x. ", "Why?\n", None, "Yes.", "tail "])
            rows.append((conv if conv else None, rng.choice([turn, turn, turn + 1, None]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "User", "ant"]), text))
    return rows


NAMES = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


@pytest.mark.parametrize(("rows", "chars"), [(1024, 1 << 20), (1, 1 << 20), (3, 4)])
def test_cheapest_edits_of_every_conversation(spark, rows, chars):
    data = made(rows)
    table = spark.createDataFrame(data, SCHEMA).withColumns({c: F.lit(1) for c in ("copies", "digest", "part", "segment", "whole", "audit", "first")})
    got = {r.conv_id: tuple(r[c] for c in NAMES[1:]) for r in repair.report(table, table, most_rows=rows, most_chars=chars).collect()}
    want = {c: plainly([r[1:] for r in data if r[0] == c]) for c in {r[0] for r in data}}
    assert got == want


def test_a_conversation_over_many_tasks(spark):
    rng = random.Random(3)
    data = [("long", i, rng.choice(["user", "assistant"]), rng.choice([f"t{i}.", f"t{i}", "again."])) for i in range(600)] + [("short", 1, "user", "a."), ("short", 2, "assistant", "b.")]
    table = spark.createDataFrame(data, "conv_id string, turn int, role string, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        cut = repair.segments(table.repartition(4), most_rows=50)
        assert cut.filter("conv_id = 'long'").select("part").distinct().count() > 1
        got = {r.conv_id: tuple(r[c] for c in NAMES[1:]) for r in repair.report(table, table, most_rows=50).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {c: plainly([r[1:] for r in data if r[0] == c]) for c in ("long", "short")}


def test_many_equal_rows_are_one_row_with_copies(spark):
    table = spark.createDataFrame([(1, 5, "user", "hello.")] * 3000 + [(1, 6, "assistant", "hi.")], SCHEMA)
    (r,) = repair.report(table, table).collect()
    assert (r.duplicate, r.illegal, r.cost, r.audit) == (2999, 2999, 5998, "K" + "D" * 2999 + "K")


def test_no_turns_and_no_rows(spark):
    table = spark.createDataFrame([(7, 1, "user", "a.")], SCHEMA)
    none = table.filter("turn > 1")
    (r,) = repair.report(table, none).collect()
    assert tuple(r[c] for c in NAMES[1:]) == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert repair.report(none, none).count() == 0


def test_damage_by_checksum(spark):
    import zlib

    rows = [(c, t, "assistant", f"What {t}? Yes.") for c in (1, None) for t in [*range(40), None]]
    got = sorted(map(str, repair.damaged(spark.createDataFrame(rows, SCHEMA)).collect()))
    want = []
    for c, t, role, text in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        row = (c, t, "user" if k == 4 else role, "" if k == 1 else text.translate(str.maketrans("", "", ".!?")) if k == 2 else text)
        want += [row] * {0: 0, 3: 2}.get(k, 1)
    assert got == sorted(map(str, spark.createDataFrame(want, SCHEMA).collect()))
