"""Registry-level operators: selection, keys, and many indicators in one plan.

A merged plan runs the window layers of all its members together and all their scans of one stage in one
grouped pass, so that hundreds of series cost one shuffle and as many Python passes as the deepest member has.
"""

from __future__ import annotations

import inspect
import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import align, indicators, patterns, resample
from .layers import Affine, Average, Difference, Machine, Plan, on_spark

Parameters = Mapping[str, object]


def names() -> list[str]:
    return [n.rstrip("_") for n in indicators.REGISTRY] + [f"pat_{n}" for n in patterns.NAMES]


def found(name: str, parameters: Parameters = {}) -> tuple[str, dict]:
    """The registered name (case does not count) and its full parameters; unknown ones raise."""
    wanted = name.casefold().replace(" ", "_")
    for known in names():
        if known == wanted:
            if known.startswith("pat_"):
                if parameters:
                    raise ValueError(f"{name} has no parameters")
                return known, {}
            make = indicators.REGISTRY.get(known) or indicators.REGISTRY[known + "_"]
            own = {k: p.default for k, p in inspect.signature(make).parameters.items()}
            if unknown := set(parameters) - set(own):
                raise ValueError(f"{name} has no parameter {sorted(unknown)}")
            return known, own | dict(parameters)
    raise ValueError(f"no such series: {name}")


def series_key(name: str, parameters: Parameters = {}, timeframe: str | None = None) -> str:
    """name:parameter=value,...@timeframe, parameters in order of their names."""
    text = name + "".join(f"{':' if i == 0 else ','}{k}={parameters[k]}" for i, k in enumerate(sorted(parameters)))
    return f"{text}@{timeframe}" if timeframe else text


def resolved(mode: str, declared: Iterable[str] = (), explicit: Iterable[str] = ()) -> list[str]:
    """Names to compute: auto takes the declared ones, explicit those given, all every one; each once, in order."""
    if mode not in ("auto", "explicit", "all"):
        raise ValueError(f"no such mode: {mode}")
    chosen = {"auto": declared, "explicit": explicit, "all": [n for n in names() if n not in indicators.PAIRED]}[mode]
    return list(dict.fromkeys(found(n)[0] for n in chosen))


def plan_of(name: str, parameters: Parameters = {}) -> Plan:
    known, own = found(name, parameters)
    if known.startswith("pat_"):
        return patterns.plan((known[4:],))
    return (indicators.REGISTRY.get(known) or indicators.REGISTRY[known + "_"])(**own)


def _renamed(plan: Plan, prefix: str) -> Plan:
    """The plan with its own columns under a prefix."""
    own: set[str] = set()
    for step in plan.steps:
        own |= set(step) if isinstance(step, dict) else {o for s in step for o in (s.outs if isinstance(s, Machine) else [s.out])}
    pattern = re.compile(r"(?<![\w.'])(" + "|".join(sorted(map(re.escape, own), key=len, reverse=True)) + r")(?![\w(])")
    text = lambda e: pattern.sub(lambda m: prefix + m[1], e)
    name = lambda n: prefix + n if n in own else n
    out = Plan([name(o) for o in plan.outputs])
    for step in plan.steps:
        if isinstance(step, dict):
            out.add(**{name(k): text(e) for k, e in step.items()})
            continue
        out.scan(*(
            Average(name(s.out), name(s.x), s.n, s.alpha) if isinstance(s, Average)
            else Difference(name(s.out), name(s.a), name(s.b)) if isinstance(s, Difference)
            else Affine(name(s.out), name(s.a), name(s.b), name(s.start)) if isinstance(s, Affine)
            else Machine([name(o) for o in s.outs], [name(r) for r in s.reads], None, None, None, s.kernel)
            for s in step
        ))
    return out


def merged(plans: Mapping[str, Plan]) -> Plan:
    """One plan for all, each one's columns prefixed by its key and two underscores."""
    todo = [_renamed(p, f"{k}__") for k, p in plans.items()]
    out = Plan([o for p in todo for o in p.outputs])
    queues = [list(p.steps) for p in todo]
    while any(queues):
        while layer := {k: e for q in queues if q and isinstance(q[0], dict) for k, e in q[0].items()}:
            out.add(**layer)
            for q in queues:
                if q and isinstance(q[0], dict):
                    q.pop(0)
        scans = [s for q in queues if q for s in q.pop(0)]
        if scans:
            out.scan(*scans)
    return out


def compute(bars: DataFrame, wanted: Mapping[str, tuple[str, Parameters]], decision_time: str | None = None, seconds: int = 3600) -> DataFrame:
    """sym, ts and the outputs of all wanted series (column prefix -> name, parameters), over finalised bars only."""
    if decision_time is not None:
        bars = bars.filter(F.col("ts") + F.make_dt_interval(secs=F.lit(seconds)) <= F.lit(decision_time).cast("timestamp_ntz"))
    return on_spark(merged({k: plan_of(n, p) for k, (n, p) in wanted.items()}), bars)


def finite(value: Column, rn: Column, warm_up: int, name: str) -> Column:
    """value, or an error where it is missing or infinite after the warm-up."""
    bad = (rn >= warm_up) & (value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")))
    return F.when(bad, F.raise_error(F.lit(f"{name} is not finite")).cast("double")).otherwise(value)


# ---- series of several timeframes


def specified(text: str) -> tuple[str, dict, str | None]:
    """name, parameters, timeframe of a key such as `ema:n=9@4h`."""
    m = re.fullmatch(r"([^:@]+)(?::([^@]*))?(?:@(\w+))?", text)
    if not m:
        raise ValueError(f"not a series: {text!r}")
    pairs = [p.split("=", 1) for p in (m[2] or "").split(",") if p]
    given = {k: float(v) if "." in v else int(v) for k, v in pairs}
    return *found(m[1], given), m[3]


def resolved_series(mode: str, declared: Iterable[str], explicit: Iterable[str], execution_timeframe: str) -> dict[str, tuple[str, dict, str]]:
    """key -> (name, parameters, timeframe), each series once: `strategy` or no timeframe is that of the execution, and any
    other must be made of it."""
    chosen = {"auto": declared, "explicit": explicit}.get(mode)
    chosen = resolved(mode) if chosen is None else chosen
    out = {}
    for text in chosen:
        name, own, timeframe = specified(text)
        timeframe = execution_timeframe if timeframe in (None, "strategy") else timeframe
        if resample.timeframe_seconds(timeframe) % resample.timeframe_seconds(execution_timeframe):
            raise ValueError(f"{timeframe} is not made of {execution_timeframe}")
        out[series_key(name, own, timeframe)] = (name, own, timeframe)
    return out


def compute_series(bars: DataFrame, series: Mapping[str, tuple[str, dict, str]], execution_timeframe: str) -> DataFrame:
    """sym, ts and a struct column a key, on the bars of the execution's timeframe: values of wider bars from their close on."""
    step = resample.timeframe_seconds(execution_timeframe)
    out = bars.select("sym", "ts")
    for timeframe in dict.fromkeys(t for _, _, t in series.values()):
        own = {k: v for k, v in series.items() if v[2] == timeframe}
        plans = {f"s{i}": plan_of(n, p) for i, (n, p, _) in enumerate(own.values())}
        wide = bars if timeframe == execution_timeframe else resample.confirmed(bars, execution_timeframe, timeframe).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
        values = on_spark(merged(plans), wide)
        named = [F.struct(*(F.col(f"{p}__{o}").alias(o) for o in plans[p].outputs)).alias(k) for p, k in zip(plans, own)]
        if timeframe == execution_timeframe:
            out = out.join(values.select("sym", "ts", *named), ["sym", "ts"])
        else:
            # a wide bar closes with the last of its own bars
            late = F.col("ts") + F.make_dt_interval(secs=F.lit(resample.timeframe_seconds(timeframe) - step))
            out = align.as_of(out, values.select("sym", late.alias("ts"), F.struct(*named).alias("__all")), "__all").select(*out.columns, "__all.*")
    return out
