"""The simulator once more, as one recursive DuckDB statement over bars: what the journal and its tables are held against.

All series and runs advance a bar a step, in doubles; a step is a chain of projections over the state before it.
"""

from __future__ import annotations

from collections.abc import Mapping

from .operators.simulate import Rules

_STATE = "cash side q ref price margin stop target liq entered tid pend pside pstop ptarget pq pdist pts".split()


def _rules(runs: Mapping[str, Rules]) -> str:
    number = lambda x: "null::double" if x is None else f"{float(x)!r}::double"
    rows = ", ".join(f"('{n}', {number(r.capital)}, {number(r.risk)}, {number(r.distance)}, {number(r.reward)}, {number(r.fee)}, {number(r.entry_slip)}, {number(r.exit_slip)}, {number(r.gap_multiplier)}, {number(r.leverage)}, {number(r.maintenance)}, {number(r.funding)})" for n, r in runs.items())
    return f"(values {rows}) as rules(run_id, capital, risk, share, reward, fee, slip_in, slip_out, gapx, lev, mmr, fallback)"


def _chain(source: str, steps: list[dict[str, str]]) -> str:
    for step in steps:
        source = "(select *, " + ", ".join(f"{v} as {k}" for k, v in step.items()) + f" from {source})"
    return source


def _exit(tag: str, on: str, at: str, ref: str, reason: str, gap: str, decided: str) -> list[dict[str, str]]:
    """Steps that close the position where `on` holds; cash and side go on as {tag}cash, {tag}side."""
    return [
        {f"{tag}on": on},
        {f"{tag}ref": ref, f"{tag}gap": gap, f"{tag}why": reason, f"{tag}at": at, f"{tag}dts": decided},
        {f"{tag}slip": f"round(round({tag}ref * q_, 8) * slip_out * case when {tag}gap then gapx else 1 end, 8)"},
        {f"{tag}price": f"round({tag}ref - side_ * {tag}slip / nullif(q_, 0), 8)"},
        {f"{tag}fee": f"round(round({tag}price * q_, 8) * fee, 8)"},
        {f"{tag}cash": f"case when {tag}on then cash_ + margin_ + round(side_ * ({tag}price - price_) * q_, 8) - {tag}fee else cash_ end", f"{tag}side": f"case when {tag}on then 0 else side_ end", f"{tag}margin": f"case when {tag}on then 0 else margin_ end"},
    ]


def _renamed(steps: list[dict[str, str]], **names: str) -> list[dict[str, str]]:
    out = []
    for step in steps:
        made = {}
        for k, v in step.items():
            for old, new in names.items():
                v = v.replace(f"{old}_", new)
            made[k] = v
        out.append(made)
    return out


def steps(bars: str, runs: Mapping[str, Rules]) -> str:
    """A `with recursive` prefix that defines st: a row a run, series and bar, with what happened on it. bars: SQL for sym,
    ts, o, h, l, c, signal, rate (measured, of the funding time that is the bar's close; null where there is none).
    Bars are of an hour, so that a funding time is always a bar's close."""
    hour = 3600
    body = []
    first = dict(side="side", q="q", price="price", margin="margin", cash="cash")
    body += _renamed(_exit("x1", "side <> 0 and pend in (2, 3)", "t + 0.001", "o", "case when pend = 2 then 'SIGNAL' else 'REVERSAL' end", "false", "pts"), **first)
    body += [
        {"eprice0": "o * (1 + pside * slip_in)", "open1": "x1side = 0 and pend in (1, 3)"},
        {"afford": "floor(x1cash / (eprice0 * (1 / lev + 2 * fee)) * 1e8) / 1e8"},
        {"eq": "case when open1 then least(round(pq, 8), round(round(x1cash * risk, 8) / pdist, 8), afford) end"},
        {"non": "open1 and eq > 0", "refused": "open1 and not coalesce(eq > 0, false)"},
        {"nslip": "round(round(o * eq, 8) * slip_in, 8)"},
        {"nprice": "round(o + pside * nslip / nullif(eq, 0), 8)"},
        {"nfee": "round(round(nprice * eq, 8) * fee, 8)", "nmargin": "round(round(nprice * eq, 8) / lev, 8)"},
        {
            "cash2": "case when non then x1cash - nmargin - nfee else x1cash end", "side2": "case when non then pside else x1side end", "q2": "case when non then eq else q end",
            "ref2": "case when non then o else ref end", "price2": "case when non then nprice else price end", "margin2": "case when non then nmargin else x1margin end", "stop2": "case when non then pstop else stop end",
            "target2": "case when non then ptarget else target end", "liq2": "case when non then round(nprice * (1 - pside * (1 / lev - mmr)), 8) else liq end", "entered2": "case when non then t + 0.001 else entered end", "tid2": "case when non then tid + 1 else tid end",
        },
        {"fon": f"side2 <> 0 and (t + {hour}) % 28800 = 0", "fprice": f"case when nt = t + {hour} then nxo else c end", "frate": "coalesce(rate, fallback)"},
        {"fdue": "case when fon then round(side2 * round(fprice * q2, 8) * frate, 8) end"},
        {"fpaid": "case when fon then case when fdue > 0 then least(fdue, margin2) else fdue end end"},
        {"margin3": "margin2 - coalesce(fpaid, 0)"},
        {"liq3": "case when fon then round(greatest(0, price2 * (1 - side2 * (margin3 / (q2 * price2) - mmr))), 8) else liq2 end"},
        {"bad": "case when side2 > 0 then l else h end", "good": "case when side2 > 0 then h else l end", "tried": "side2 <> 0 and entered2 < t"},
        {"shit": "tried and side2 * (bad - stop2) <= 0", "lhit": "tried and side2 * (bad - liq3) <= 0", "thit": "tried and target2 is not null and side2 * (good - target2) >= 0"},
        {"kind": "case when lhit and (not shit or side2 * (stop2 - liq3) < 0) then 'LIQUIDATION' when shit then 'STOP_LOSS' when thit then 'TAKE_PROFIT' end"},
        {"level": "case kind when 'LIQUIDATION' then liq3 when 'STOP_LOSS' then stop2 when 'TAKE_PROFIT' then target2 end"},
        {"past": "case when kind = 'TAKE_PROFIT' then side2 * (o - level) > 0 else side2 * (o - level) < 0 end"},
    ]
    second = dict(side="side2", q="q2", price="price2", margin="margin3", cash="cash2")
    body += _renamed(_exit("x2", "kind is not null", f"t + {hour}", "case when kind = 'LIQUIDATION' or not past then level else o end", "kind", "past", "t"), **second)
    body += [
        {"upl": "case when x2side <> 0 then round(x2side * (c - price2) * q2, 8) else 0 end"},
        {"equity": "x2cash + x2margin + upl", "lost": f"case when nt is null then 'end_of_data' when nt <> t + {hour} then 'next_candle_gap' end"},
        {
            "why": "case when signal is null then null when signal = 0 and x2side = 0 then 'no_position' when signal <> 0 and signal = x2side then 'pyramiding_disabled' when signal <> 0 and risk > 0.01 then 'exposure_limit' else lost end",
        },
        {"act": "case when signal is null then null when why is not null then 'skip' when signal = 0 then 'exit' when x2side <> 0 then 'reverse' else 'enter' end"},
        {"d": "round(c * share, 8)"},
    ]
    third = dict(side="x2side", q="q2", price="price2", margin="x2margin", cash="x2cash")
    body += _renamed(_exit("x3", "x2side <> 0 and lost is not null", f"t + {hour} + 0.001", "c", "case when nt is null then 'END_OF_DATA' else 'DATA_GAP' end", "false", f"case when nt is null then null else t + {hour} end"), **third)
    keep = {
        "cash": "x3cash", "side": "x3side", "q": "q2", "ref": "ref2", "price": "price2", "margin": "x3margin", "stop": "stop2", "target": "target2", "liq": "liq3", "entered": "entered2", "tid": "tid2",
        "pend": "case act when 'enter' then 1 when 'exit' then 2 when 'reverse' then 3 else 0 end", "pside": "case when act in ('enter', 'reverse') then signal else 0 end", "pstop": "round(c - signal * d, 8)",
        "ptarget": "round(c + signal * d * reward, 8)", "pq": "equity * risk / d", "pdist": "d", "pts": f"t + {hour}",
    }
    out = "x1on x1at x1ref x1price x1fee x1slip x1why x1gap x1dts refused non eq nprice nslip nfee fon fprice frate fdue fpaid x2on x2at x2ref x2price x2fee x2slip x2why x2gap x2dts x3on x3at x3ref x3price x3fee x3slip x3why x3gap x3dts upl equity act why x2cash x2side x2margin t o signal".split()
    kinds = {c: "boolean" for c in ("x1on", "x1gap", "refused", "non", "fon", "x2on", "x2gap", "x3on", "x3gap")} | {c: "varchar" for c in ("x1why", "x2why", "x3why", "act", "why")} | {"x2side": "integer", "signal": "integer"}
    nulls = ", ".join(f"null::{kinds.get(c, 'double')} as {c}" for c in out)
    before = ", ".join(f"st.{c}" for c in _STATE)
    start = "capital as cash, 0 as side, 0e0 as q, 0e0 as ref, 0e0 as price, 0e0 as margin, 0e0 as stop, null::double as target, 0e0 as liq, 0e0 as entered, 0::bigint as tid, 0 as pend, 0 as pside, 0e0 as pstop, null::double as ptarget, 0e0 as pq, 1e0 as pdist, 0e0 as pts"
    cast = lambda c, e: f"({e})::{kinds.get(c, 'double')} as {c}"
    state = ", ".join(f"({keep[c]})::{'integer' if c in ('side', 'pend', 'pside') else 'bigint' if c == 'tid' else 'double'} as {c}" for c in _STATE)
    joined = f"(select rule.*, b.i, b.t, b.o, b.h, b.l, b.c, b.signal, b.rate, b.nt, b.nxo, st.sym, {before} from st join rule on rule.run_id = st.run_id join b on b.sym = st.sym and b.i = st.i + 1)"
    return f"""with recursive src as ({bars}),
b as (select sym, row_number() over (partition by sym order by ts) as i, epoch(ts)::double as t, o, h, l, c, signal::integer as signal, rate::double as rate,
             epoch(lead(ts) over (partition by sym order by ts))::double as nt, lead(o) over (partition by sym order by ts) as nxo from src),
rule as (select * from {_rules(runs)}),
st as (
  select run_id, sym, 0::bigint as i, {start}, {nulls} from rule cross join (select distinct sym from b)
  union all
  select run_id, sym, i, {state}, {", ".join(cast(c, c) for c in out)} from {_chain(joined, body)}
),
entry as (select run_id, sym, tid as trade_id, i, pside_ as direction, t + 0.001 as entry_t, o as entry_reference, nprice as entry_price, eq as quantity, nfee as fee_in, nslip as slip_in, stop as at_stop, dts_in, q, target as at_target
          from (select *, lag(pside) over (partition by run_id, sym order by i) as pside_, lag(pts) over (partition by run_id, sym order by i) as dts_in from st) where non),
gone as (select run_id, sym, i, tid_ as trade_id, x1at as at, x1ref as ref, x1price as price, x1fee as fee, x1slip as slip, x1why as why, x1gap as gap, x1dts as dts from (select *, lag(tid) over (partition by run_id, sym order by i) as tid_ from st) where x1on
         union all select run_id, sym, i, tid, x2at, x2ref, x2price, x2fee, x2slip, x2why, x2gap, x2dts from st where x2on
         union all select run_id, sym, i, tid, x3at, x3ref, x3price, x3fee, x3slip, x3why, x3gap, x3dts from st where x3on),
paid as (select run_id, sym, tid as trade_id, t + 3600 as at, fprice as price, frate as rate, fdue as due, fpaid as paid, q, side from st where fon),
done as (select e.run_id, e.sym, e.trade_id, e.direction, e.entry_t, e.entry_reference, e.entry_price, e.quantity, g.at as exit_t, g.ref as exit_reference, g.price as exit_price, g.why as exit_reason,
                e.fee_in + g.fee as fees, e.slip_in + g.slip as slippage, coalesce(f.paid, 0) as funding, e.direction * (g.ref - e.entry_reference) * e.quantity as gross, abs(e.entry_reference - e.at_stop) * e.quantity as r0
         from entry e join gone g using (run_id, sym, trade_id) left join (select run_id, sym, trade_id, sum(paid) as paid from paid group by all) f using (run_id, sym, trade_id)),
trade as (select *, gross - fees - slippage - funding as net, case when direction > 0 then 'LONG' else 'SHORT' end as side from done)
"""
