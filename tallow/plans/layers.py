"""Layered plans over series: window layers and scans, run on Spark or written out as DuckDB SQL.

A window layer adds columns by SQL fragments over the columns below it; all layers share one window, so
Spark shuffles and sorts once for any number of them. A scan layer adds recursive columns (a value that
depends on the value before): SMA-seeded averages and affine recurrences v = a * v + b, over parts of series (see parts.py) or,
beside states of other kinds and windows without a bound, any number in one Arrow pass over whole series.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..session import ship


@dataclass(frozen=True)
class Average:
    """Recursive average of x: the mean of the first n values, then v += alpha * (x - v)."""

    out: str
    x: str
    n: int
    alpha: float


@dataclass(frozen=True)
class Affine:
    """v = a * v + b from the row on where `start` is not null (v = start there). a, b, start: columns."""

    out: str
    a: str
    b: str
    start: str


@dataclass(frozen=True)
class Difference:
    """a - b of columns of the same pass, so that a later scan of the pass can read it."""

    out: str
    a: str
    b: str


@dataclass(frozen=True)
class Machine:
    """Several states a row. kernel: arrays of `reads` to arrays of `outs`; first and step: the same as SQL over the
    row s and the states r of the row before, from the row on for which `begins` holds (None: SQL can't express it)."""

    outs: list[str]
    reads: list[str]
    begins: str | None
    first: list[str] | None
    step: list[str] | None
    kernel: Callable
    #: Columns that only the SQL reads.
    also: tuple[str, ...] = ()

    @property
    def out(self) -> str:
        return self.outs[0]


def ema(out: str, x: str, n: int) -> Average:
    return Average(out, x, n, 2 / (n + 1))


def rma(out: str, x: str, n: int) -> Average:
    return Average(out, x, n, 1 / n)


@dataclass
class Plan:
    """Steps in order, and the columns that are the result."""

    outputs: list[str]
    steps: list = field(default_factory=list)
    #: Values of any size, compared by mantissa and exponent.
    wide: bool = False

    def add(self, **columns: str) -> Plan:
        self.steps.append(columns)
        return self

    def scan(self, *scans: Average | Affine | Difference | Machine) -> Plan:
        self.steps.append(scans)
        return self

    def shown(self) -> list[str]:
        """The outputs as compared: rounded, or mantissa and exponent."""
        if not self.wide:
            return [f"round(cast({c} as double), 6) as {c}" for c in self.outputs]
        power = "cast(floor(log10(nullif(abs({0}), 0))) as int)"
        return [x for c in self.outputs for x in (f"round({c} / power(10e0, {power.format(c)}), 6) as {c}", f"coalesce({power.format(c)}, 0) as {c}_exponent")]

    def in_sql(self) -> bool:
        return not any(isinstance(x, Machine) and x.step is None for step in self.steps if not isinstance(step, dict) for x in step)


def run_average(x: np.ndarray, n: int, alpha: float) -> np.ndarray:
    out = np.full(len(x), np.nan)
    valid = ~np.isnan(x)
    seen, v = 0, 0.0
    held: list[float] = []
    for i in np.flatnonzero(valid):
        seen += 1
        if seen < n:
            held.append(x[i])
            continue
        v = (sum(held) + x[i]) / n if seen == n else v + alpha * (x[i] - v)
        out[i] = v
    return out


def run_affine(a: np.ndarray, b: np.ndarray, start: np.ndarray) -> np.ndarray:
    out = np.full(len(a), np.nan)
    v = None
    for i in range(len(a)):
        if v is None:
            v = None if np.isnan(start[i]) else start[i]
        else:
            v = a[i] * v + b[i]
        if v is not None:
            out[i] = v
    return out


def floats(column: pa.ChunkedArray) -> np.ndarray:
    return column.cast(pa.float64()).to_numpy(zero_copy_only=False) if not isinstance(column, pa.ChunkedArray) else column.cast(pa.float64()).to_pandas().to_numpy(dtype=float)


def scanned(df: DataFrame, scans: Sequence[Average | Affine | Difference | Machine]) -> DataFrame:
    """df with the scans' columns; a later scan may read an earlier one."""
    ship(df.sparkSession)
    outs = [o for s in scans for o in (s.outs if isinstance(s, Machine) else [s.out])]
    schema = T.StructType([*df.schema.fields, *(T.StructField(o, T.DoubleType()) for o in outs)])
    names = df.columns

    def series(table: pa.Table) -> pa.Table:
        table = table.take(pa.compute.sort_indices(table, sort_keys=[("ts", "ascending")]))
        have: dict[str, np.ndarray] = {}

        def column(name: str) -> np.ndarray:
            if name not in have:
                have[name] = floats(table.column(name))
            return have[name]

        for s in scans:
            if isinstance(s, Machine):
                have.update(zip(s.outs, s.kernel(*map(column, s.reads))))
                continue
            if isinstance(s, Difference):
                have[s.out] = column(s.a) - column(s.b)
                continue
            have[s.out] = run_average(column(s.x), s.n, s.alpha) if isinstance(s, Average) else run_affine(column(s.a), column(s.b), column(s.start))
        for o in outs:
            table = table.append_column(o, pa.array(have[o], pa.float64(), from_pandas=True))
        return table.select([*names, *outs])

    return df.groupBy("sym").applyInArrow(series, schema)


def on_spark(plan: Plan, bars: DataFrame, rows_a_part: int | None = None) -> DataFrame:
    """sym, ts and the plan's outputs. Plans with affine scans and bounded windows go over parts of series (see parts); so do
    plans of bounded windows alone where rows_a_part is given."""
    from . import parts

    if parts.partable(plan) and (rows_a_part or not all(isinstance(s, dict) for s in plan.steps)):
        return parts.on_parts(plan, bars, rows_a_part or parts.ROWS_A_PART)
    df = bars.selectExpr("*", "row_number() over (partition by sym order by ts) as rn")
    for step in plan.steps:
        df = df.selectExpr("*", *(f"{e.replace(' §', ', true')} as {c}" for c, e in step.items())) if isinstance(step, dict) else scanned(df, step)
    return df.selectExpr("sym", "ts", *plan.shown())


def as_sql(plan: Plan, bars_sql: str) -> str:
    """The same as DuckDB SQL, scans as recursive common table expressions."""
    ctes = [f"t0 as materialized (select *, row_number() over (partition by sym order by ts) as rn from ({bars_sql}) b)"]
    n = 0

    def put(body: str, name: str | None = None) -> None:
        nonlocal n
        n += 1
        ctes.append(f"t{n} as materialized ({body})")

    for step in plan.steps:
        if isinstance(step, dict):
            put(f"select *, {', '.join(f'{e.replace(chr(32) + chr(167), chr(32) + "ignore nulls")} as {c}' for c, e in step.items())} from t{n}")
            continue
        for s in step:
            t = f"t{n}"
            if isinstance(s, Difference):
                put(f"select *, {s.a} - {s.b} as {s.out} from {t}")
                continue
            if isinstance(s, Machine):
                columns = ", ".join(s.outs)
                ctes.append(f"s_{s.out} as materialized (select sym, rn, {', '.join((*s.reads, *s.also))} from {t})")
                first = ", ".join(f"({e})::double as {o}" for e, o in zip(s.first, s.outs))
                nxt = ", ".join(f"({e})::double" for e in s.step)
                ctes.append(f"r_{s.out} as (select s.sym, s.rn, {first} from s_{s.out} s where {s.begins} union all select s.sym, s.rn, {nxt} from r_{s.out} r join s_{s.out} s on s.sym = r.sym and s.rn = r.rn + 1)")
                put(f"select t.*, {', '.join(f'r.{o}' for o in s.outs)} from {t} t left join r_{s.out} r on r.sym = t.sym and r.rn = t.rn")
                continue
            if isinstance(s, Average):
                ctes.append(f"s_{s.out} as materialized (select sym, rn, {s.x} as x, count({s.x}) over (partition by sym order by ts rows between unbounded preceding and current row) as vn, avg({s.x}) over (partition by sym order by ts rows between {s.n - 1} preceding and current row) as m from {t})")
                start = f"select sym, rn, m as v from s_{s.out} where vn = {s.n} and x is not null"
                step_sql = f"r.v + {s.alpha!r}::double * (s.x - r.v)"
            else:
                ctes.append(f"s_{s.out} as materialized (select sym, rn, {s.a}::double as a, {s.b}::double as b, {s.start}::double as m from {t})")
                start = f"select sym, rn, m as v from s_{s.out} where m is not null"
                step_sql = "s.a * r.v + s.b"
            ctes.append(f"r_{s.out} as ({start} union all select s.sym, s.rn, {step_sql} from r_{s.out} r join s_{s.out} s on s.sym = r.sym and s.rn = r.rn + 1)")
            put(f"select t.*, r.v as {s.out} from {t} t left join r_{s.out} r on r.sym = t.sym and r.rn = t.rn")
    return f"with recursive {', '.join(ctes)} select sym, ts, {', '.join(plan.shown())} from t{n}"
