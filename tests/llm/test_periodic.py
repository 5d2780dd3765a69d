"""Periodic runs against a plain search, for any dealing of lags."""

import hashlib
import random
import zlib
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tallow.llm import periodic, queries

SF = "/root/testdata/sf0.001"


def slow_runs(words):
    """Every stretch that no neighbour extends, lag by lag; the smallest lag of equal stretches is its period."""
    found, n = {}, len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def plainly(doc_id, text):
    words = (text or "").encode().split()
    runs = slow_runs(words)
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs)]
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    told = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in sorted(runs, key=lambda r: (r[0], r[2])))
    return (doc_id, len(runs), *told, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest())


def with_damage(doc_id, text):
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    words, g = (text or "").encode().split(), h // 10
    n = len(words)
    if h % 10 or not n:
        return text
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return b" ".join(words[i] if i < a else words[a + (i - a) % p] for i in range(n)).decode()


def made(seed, n=120):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        words = []
        for _ in range(rng.randrange(1, 6)):
            words += [rng.choice("abc") for _ in range(rng.randrange(0, 30))]
            p = rng.choice([1, 1, 2, 3, 5, 8, 33, 40, 70])
            unit = [rng.choice(["a", "b", str(rng.randrange(99))]) for _ in range(p)]
            words += (unit * 12)[: rng.randrange(2 * p, 12 * p)]
        out.append(words)
    return [*out, ["a"] * 700, ["a", "b", "a"] * 400, (["x"] * 7 + ["y"]) * 90, [], ["one"], ["a"] * 5, ["a"] * 6, ["a", "b"] * 4]


def test_runs_are_those_of_a_plain_search():
    texts = made(1)
    want = [sorted(slow_runs(t), key=lambda r: (r[0], r[2])) for t in texts]
    assert periodic.runs_of([[w.encode() for w in t] for t in texts]) == want
    for i in (0, 1, 2, -8, -7, -6):
        coded, lags = [w.encode() for w in texts[i]], len(texts[i]) // 4
        parts = [periodic.runs_of([coded], lags * k // 5 + 1, lags * (k + 1) // 5)[0] for k in range(5)]
        assert sorted({r for p in parts for r in p}, key=lambda r: (r[0], r[2])) == want[i]


def test_the_query_over_all_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = {plainly(r.doc_id, with_damage(r.doc_id, r.text)) for r in docs}
    got = queries.QUERIES["op12_periodic_runs"](spark, SF)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert {tuple(r) for r in got.collect()} == want and any(r[1] for r in want)


@pytest.mark.parametrize("most_bytes", [1 << 16, 40])
def test_long_texts_repeated_rows_and_odd_columns(spark, most_bytes):
    texts = [None, "", " \n\t", *(" ".join(t) for t in made(2, 30))]
    rows = [(i % 7 if i % 5 else None, t) for i, t in enumerate(texts)] * 2
    names = ("digest", "__digest", "runs", "words", "number", "ranges", "h", "periodic")
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in names})
    found = periodic.with_runs(table, most_bytes=most_bytes)
    assert found.columns == table.columns and found.filter("__digest = 1 and digest = 1 and h = 1").count() == len(rows)
    want = sorted(map(str, (plainly(i, t) for i, t in rows)))
    assert sorted(str(tuple(r)) for r in periodic.report(table, most_bytes=most_bytes).collect()) == want
    assert periodic.report(table.limit(0), most_bytes=most_bytes).count() == 0


def test_planted_tails(spark):
    rows = [(i, " ".join(f"w{j}" for j in range(i % 50))) for i in range(300)] + [(None, "a b  c\td"), (5, None), (20, " ")]
    got = periodic.tiled(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str((i, with_damage(i, t))) for i, t in rows)
