"""Layered plans over parts of series, so that one long series is the work of many tasks.

Rows are numbered through their series (counts by time bucket, sums over the counts, numbers within a bucket), and a part is
rows_a_part rows in a row. Window layers see a part and the rows before it that they reach back to, which are copied from the
part before. Scans are affine in their state: over a part a scan is v -> A v + B, so a pass over the parts finds A and B
(and what seeds a scan that has not begun), these compose along a series, a row a part, and a last pass runs every
part from the state it is entered with. A scan of another scan's values takes one more pass a level, in which the levels
below are run again.

Windows without a bound, and states that are not affine, need whole series: such plans are not `partable`.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.fragments import ORDER
from ..session import ship
from .layers import Affine, Average, Difference, Plan, floats

ROWS_A_PART = 1 << 16
_BUCKET_SECONDS = 30 * 86_400
_LAG = re.compile(r", (\d+)\) over \(" + ORDER + r"\)")
_FRAME = re.compile(r"over \(" + ORDER + r" rows between (\d+) preceding and current row\)")


def reach(expression: str) -> int | None:
    """How many rows before its own an expression looks at; None: no bound, or it looks ahead."""
    lags = [int(k) for k, at in ((m.group(1), m.start()) for m in _LAG.finditer(expression))]
    frames = [int(k) for k in _FRAME.findall(expression)]
    if len(lags) + len(frames) != expression.count(" over (") or "lead(" in expression:
        return None
    return max([0, *lags, *frames])


def partable(plan: Plan) -> bool:
    return all(all(reach(e) is not None for e in s.values()) if isinstance(s, dict) else all(isinstance(x, (Average, Affine, Difference)) for x in s) for s in plan.steps)


def numbered(bars: DataFrame, bucket_seconds: int = _BUCKET_SECONDS) -> DataFrame:
    """bars with rn, the place in the series by ts, from 1 on; no window is longer than a bucket of time or, over the counts
    of buckets, than a series has buckets."""
    at = bars.withColumn("bucket", F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / bucket_seconds))
    counts = at.groupBy("sym", "bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("sym").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("sym", "bucket", F.coalesce(before, F.lit(0)).alias("earlier"))
    here = F.row_number().over(Window.partitionBy("sym", "bucket").orderBy("ts"))
    return at.withColumn("here", here).join(counts, ["sym", "bucket"]).withColumn("rn", F.col("earlier") + F.col("here")).select(*bars.columns, "rn")


def _layers(df: DataFrame, layers: Sequence[dict[str, str]], rows: int) -> DataFrame:
    """Window layers over parts and the rows before them."""
    back = sum(max(reach(e) for e in layer.values()) for layer in layers)
    own = F.floor((F.col("rn") - 1) / rows)
    if back:
        near_end = (F.col("rn") - 1) % rows >= rows - back
        df = df.withColumn("part", F.explode(F.when(near_end, F.array(own, own + 1)).otherwise(F.array(own))))
    for layer in layers:
        df = df.selectExpr("*", *(f"{e.replace(' §', ', true').replace(ORDER, 'partition by sym, part order by ts')} as {c}" for c, e in layer.items()))
    return df.filter(F.col("part") == own) if back else df


class Carried:
    """A scan that goes on from a state: what a part does to it, and the scan itself. States: (values seen, their sum, v) of an average,
    (begun, sum not used, v) of an affine scan."""

    NONE = (0.0, 0.0, 0.0)

    def __init__(self, scan: Average | Affine):
        self.scan = scan

    def inputs(self) -> list[str]:
        s = self.scan
        return [s.x] if isinstance(s, Average) else [s.a, s.b, s.start]

    def summary(self, column) -> list[float]:
        """Of an average: values, A, B, the first n values; of an affine scan: whether it can begin here, v at the end if so, A, B."""
        s = self.scan
        if isinstance(s, Average):
            x = column(s.x)
            x = x[~np.isnan(x)]
            v = 0.0
            for value in x.tolist():
                v += s.alpha * (value - v)
            return [float(len(x)), (1 - s.alpha) ** len(x), v, *x[: s.n].tolist()]
        a, b, start = (column(c) for c in (s.a, s.b, s.start))
        k = np.flatnonzero(~np.isnan(start))[:1]
        fresh = self.run(column, self.NONE)[-1] if len(k) else 0.0
        p, q = 1.0, 0.0
        for x, y in zip(a.tolist(), b.tolist()):
            p, q = x * p, x * q + y
        return [float(len(k)), float(fresh), p, q]

    def after(self, state: Sequence[float], told: Sequence[float]) -> tuple[float, float, float]:
        """The state behind a part from the one before it."""
        s, (seen, held, v) = self.scan, state
        if isinstance(s, Affine):
            begins, fresh, a, b = told
            return (1.0, 0.0, a * v + b) if seen else (1.0, 0.0, fresh) if begins else self.NONE
        values, a, b, *head = told
        if seen >= s.n:
            return seen, 0.0, a * v + b
        k = s.n - int(seen)
        if values < k:
            return seen + values, held + sum(head), 0.0
        seeded, early = (held + sum(head[:k])) / s.n, 0.0
        for x in head[:k]:
            early += s.alpha * (x - early)
        rest = (1 - s.alpha) ** (values - k)
        return float(s.n), 0.0, rest * seeded + b - rest * early

    def run(self, column, state: Sequence[float]) -> np.ndarray:
        s, (seen, held, v) = self.scan, state
        if isinstance(s, Average):
            x = column(s.x)
            out = np.full(len(x), np.nan)
            for i in np.flatnonzero(~np.isnan(x)).tolist():
                if seen < s.n:
                    seen, held = seen + 1, held + x[i]
                    if seen < s.n:
                        continue
                    v = held / s.n
                else:
                    v += s.alpha * (x[i] - v)
                out[i] = v
            return out
        a, b, start = (column(c) for c in (s.a, s.b, s.start))
        out, begun = np.full(len(a), np.nan), bool(seen)
        first = 0
        if not begun:
            k = np.flatnonzero(~np.isnan(start))[:1]
            if not len(k):
                return out
            first = int(k[0]) + 1
            out[first - 1] = v = start[first - 1]
        for i in range(first, len(a)):
            v = a[i] * v + b[i]
            out[i] = v
        return out


def _levels(scans: Sequence[Average | Affine | Difference]) -> list[list]:
    """Scans by how many scans they wait for; a difference is of the level of what it reads."""
    level: dict[str, int] = {}
    out: list[list] = []
    for s in scans:
        reads = [s.a, s.b] if isinstance(s, Difference) else Carried(s).inputs()
        n = max((level.get(c, -1) for c in reads), default=-1) + (0 if isinstance(s, Difference) else 1)
        n = max(n, 0)
        level[s.out] = n
        while len(out) <= n:
            out.append([])
        out[n].append(s)
    return out


def _series(table: pa.Table):
    table = table.take(pc.sort_indices(table, sort_keys=[("rn", "ascending")]))
    have: dict[str, np.ndarray] = {}

    def column(name: str) -> np.ndarray:
        if name not in have:
            have[name] = floats(table.column(name))
        return have[name]

    return table, have, column


def _run(levels: Sequence[Sequence], column, have: dict[str, np.ndarray], states: pa.Table) -> None:
    """The levels' scans of one part, from the states that it is entered with (none: the series begins)."""
    entered = {r["level"]: r["states"] for r in states.to_pylist()} if states is not None else {}
    for n, scans in enumerate(levels):
        carried = iter(entered.get(n, ()))
        for s in scans:
            have[s.out] = column(s.a) - column(s.b) if isinstance(s, Difference) else Carried(s).run(column, next(carried, Carried.NONE))


def _passes(levels: Sequence[Sequence], n: int):
    """What a level's scans do to a part (the first level's, and others', which need the states of the levels below), and how that composes."""
    numbers = pa.list_(pa.list_(pa.float64()))
    now = [Carried(s) for s in levels[n] if not isinstance(s, Difference)]

    def summed_from(table: pa.Table, states: pa.Table | None) -> pa.Table:
        table, have, column = _series(table)
        _run(levels[:n], column, have, states)
        told = [c.summary(column) for c in now]
        return pa.table({"sym": table.column("sym")[:1], "part": table.column("part")[:1], "told": pa.array([told], numbers)})

    def summed(table: pa.Table) -> pa.Table:
        return summed_from(table, None)

    def chained(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, sort_keys=[("part", "ascending")]))
        states, out = [Carried.NONE] * len(now), []
        for told in table.column("told").to_pylist():
            out.append([list(s) for s in states])
            states = [c.after(s, t) for c, s, t in zip(now, states, told)]
        return pa.table({"sym": table.column("sym"), "part": table.column("part"), "level": pa.array([n] * len(out), pa.int32()), "states": pa.array(out, numbers)})

    return summed, summed_from, chained


def scanned_parts(df: DataFrame, scans: Sequence[Average | Affine | Difference]) -> DataFrame:
    """df (sym, part, rn and the scans' inputs) with the scans' columns."""
    ship(df.sparkSession)
    levels = _levels(scans)
    outs = [s.out for s in scans]
    kind = df.schema["sym"].dataType
    told_schema = T.StructType([T.StructField("sym", kind), T.StructField("part", T.LongType()), T.StructField("told", T.ArrayType(T.ArrayType(T.DoubleType())))])
    state_schema = T.StructType([T.StructField("sym", kind), T.StructField("part", T.LongType()), T.StructField("level", T.IntegerType()), T.StructField("states", T.ArrayType(T.ArrayType(T.DoubleType())))])
    made = {s.out for s in scans}
    entered = None
    for n in range(len(levels)):
        reads = {c for level in levels[: n + 1] for s in level for c in ([s.a, s.b] if isinstance(s, Difference) else Carried(s).inputs())} - made
        groups = df.select("sym", "part", "rn", *sorted(reads - {"sym", "part", "rn"})).groupBy("sym", "part")
        summed, summed_from, chained = _passes(levels, n)
        told = groups.applyInArrow(summed, told_schema) if entered is None else groups.cogroup(entered.groupBy("sym", "part")).applyInArrow(summed_from, told_schema)
        states = told.groupBy("sym").applyInArrow(chained, state_schema)
        entered = states if entered is None else entered.unionByName(states)
    names = df.columns

    def applied(table: pa.Table, states: pa.Table) -> pa.Table:
        table, have, column = _series(table)
        _run(levels, column, have, states)
        for o in outs:
            table = table.append_column(o, pa.array(have[o], pa.float64(), from_pandas=True))
        return table.select([*names, *outs])

    schema = T.StructType([*df.schema.fields, *(T.StructField(o, T.DoubleType()) for o in outs)])
    return df.groupBy("sym", "part").cogroup(entered.groupBy("sym", "part")).applyInArrow(applied, schema)


def on_parts(plan: Plan, bars: DataFrame, rows_a_part: int = ROWS_A_PART) -> DataFrame:
    """What layers.on_spark gives, of a partable plan, in parts of rows_a_part rows (or as many as its window layers reach back)."""
    blocks: list = []
    for step in plan.steps:
        if isinstance(step, dict) and blocks and isinstance(blocks[-1], list):
            blocks[-1].append(step)
        else:
            blocks.append([step] if isinstance(step, dict) else step)
    rows = max(rows_a_part, *(sum(max(reach(e) for e in layer.values()) for layer in b) for b in blocks if isinstance(b, list)), 1)
    df = numbered(bars).withColumn("part", F.floor((F.col("rn") - 1) / rows))
    for block in blocks:
        df = _layers(df, block, rows) if isinstance(block, list) else scanned_parts(df, block)
    return df.selectExpr("sym", "ts", *plan.shown())
