"""Extension points: strategies and money policies as plain Python, their parameters, discovery and reconciliation."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field
from typing import Protocol, runtime_checkable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship

ACTIONS = {"HOLD": None, "EXIT": 0, "ENTER_LONG": 1, "ENTER_SHORT": -1}


@dataclass(frozen=True)
class Parameter:
    kind: type
    default: object
    least: float | None = None
    most: float | None = None
    choices: tuple = ()


@dataclass(frozen=True)
class Schema:
    fields: Mapping[str, Parameter] = field(default_factory=dict)

    def resolved(self, given: Mapping[str, object]) -> dict:
        """All parameters, defaults filled in; unknown names and values outside their bounds raise."""
        if unknown := set(given) - set(self.fields):
            raise ValueError(f"unknown parameters: {sorted(unknown)}")
        out = {}
        for name, p in self.fields.items():
            v = given.get(name, p.default)
            if isinstance(v, bool) != (p.kind is bool) or not isinstance(v, (int, float) if p.kind is float else p.kind):
                raise TypeError(f"{name} must be {p.kind.__name__}")
            if p.least is not None and v < p.least or p.most is not None and v > p.most or p.choices and v not in p.choices:
                raise ValueError(f"{name} is out of bounds: {v}")
            out[name] = v
        return out


@runtime_checkable
class Strategy(Protocol):
    """Judges one finalised bar (a dict of its columns), the position's side (1, -1, 0) known; returns an action."""

    name: str
    schema: Schema

    def analyze(self, bar: dict, side: int, parameters: dict) -> str: ...


class EmaRegime:
    """Long while the fast average is above the slow one, short while below."""

    name = "ema_regime"
    schema = Schema({"spot": Parameter(bool, False)})

    def analyze(self, bar: dict, side: int, parameters: dict) -> str:
        fast, slow = bar["fast"], bar["slow"]
        if fast is None or slow is None:
            return "HOLD"
        if side:
            return "EXIT" if side * (fast - slow) <= 0 else "HOLD"
        if fast == slow or fast < slow and parameters["spot"]:
            return "HOLD"
        return "ENTER_LONG" if fast > slow else "ENTER_SHORT"


def discovered(package: str) -> dict[str, Strategy]:
    """All strategies that the modules of a package define, by name; a name given twice raises."""
    out: dict[str, Strategy] = {}
    root = importlib.import_module(package)
    modules = [root, *(importlib.import_module(m.name) for m in pkgutil.iter_modules(getattr(root, "__path__", []), f"{package}."))]
    for module in modules:
        for value in vars(module).values():
            if isinstance(value, type) and value is not Strategy and value.__module__ == module.__name__ and callable(getattr(value, "analyze", None)) and isinstance(getattr(value, "name", None), str):
                if value.name in out:
                    raise ValueError(f"two strategies are called {value.name}")
                out[value.name] = value()
    return out


_DECIDED = pa.schema([("sym", pa.string()), ("ts", pa.timestamp("us")), ("action", pa.string()), ("signal", pa.int32())])


def decided(bars: DataFrame, strategy: Strategy, parameters: Mapping[str, object] = {}) -> DataFrame:
    """sym, ts, action, signal of every bar, judged in order, the side following the strategy's own entries and exits. Bars
    stream through in order of time; no task holds a series."""
    ship(bars.sparkSession)
    own = strategy.schema.resolved(parameters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sym, side = None, 0
        for batch in batches:
            columns = {c: batch.column(c).to_pylist() for c in batch.schema.names}
            actions, sides = [], []
            for values in zip(*columns.values()):
                bar = dict(zip(columns, values))
                if bar["sym"] != sym:
                    sym, side = bar["sym"], 0
                actions.append(strategy.analyze(bar, side, own))
                signal = ACTIONS[actions[-1]]
                side = side if signal is None else signal
                sides.append(side)
            yield pa.RecordBatch.from_arrays([batch.column("sym"), batch.column("ts").cast(pa.timestamp("us")), pa.array(actions, pa.string()), pa.array(sides, pa.int32())], schema=_DECIDED)

    return bars.repartition("sym").sortWithinPartitions("sym", "ts").mapInArrow(run, "sym string, ts timestamp_ntz, action string, signal int")


def reconciled(registered: DataFrame, deployed: DataFrame) -> DataFrame:
    """name, state of two tables (name, version): matched, version_mismatch, only_registered or only_deployed."""
    a, b = registered.select("name", F.col("version").alias("r")), deployed.select("name", F.col("version").alias("d"))
    state = F.when(F.col("d").isNull(), "only_registered").when(F.col("r").isNull(), "only_deployed").when(F.col("r") == F.col("d"), "matched").otherwise("version_mismatch")
    return a.join(b, "name", "full").select("name", state.alias("state"))
