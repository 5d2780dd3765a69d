"""Trade simulation: costs as columns, one deterministic pass over each series that keeps a journal, and all else from the
journal by joins and groupings.

The pass does only what depends on the bar before: cash, the open position, the orders that wait. Signals, stop distances
and measured funding rates come in as columns. Its journal has a row a decision, a fill, a funding payment and a mark at
each close; trades, excursions, equity and audits are DataFrame work on it. Money is exact in the pass (decimals of 8
places, half-even). Bars stream through it in order of time, all runs of a task at once, so that bars are shuffled once
and no task holds a series.

Order of events on a bar: orders of the close before fill at the open, 1 ms after it; funding times up to and including
the bar's close are settled; protection is tried on the bar's range, but for the bar of the entry; the position is
marked; the signal at the close is judged. A bar that is not where the last one ended closes the position at the last
close, 1 ms after it, and so does the end of the data.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from datetime import datetime, timedelta
from decimal import ROUND_HALF_EVEN, Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from .align import next_bar
from .money import MOST_RISK, within

_UNIT = Decimal("0.00000001")


def money(x) -> Decimal:
    return Decimal(str(x)).quantize(_UNIT, rounding=ROUND_HALF_EVEN)


# ---- costs as columns


def fee(notional: Column, rate: float) -> Column:
    return F.bround((notional * rate).cast("double"), 8)


def slippage_rate(quantity: Column, fixed: float | None = None, spread: float = 0.0, impact: float = 0.0, liquidity: float | None = None, gap: Column | None = None, gap_multiplier: float = 2.0) -> Column:
    rate = F.lit(fixed) if fixed is not None else F.lit(spread / 2) + (impact * quantity / liquidity if liquidity else F.lit(0.0))
    return rate if gap is None else F.when(gap, rate * gap_multiplier).otherwise(rate)


def liquidation_price(entry: Column, leverage: Column, maintenance: float, long: Column) -> Column:
    return F.round(F.when(long, entry * (1 - 1 / leverage + maintenance)).otherwise(entry * (1 + 1 / leverage - maintenance)), 8)


def trigger_price(kind: Column, buy: Column, level: Column) -> Column:
    """Price at which a resting limit or stop order of `level` fills on the bar o, h, l; null where it does not."""
    o, h, low = F.col("o"), F.col("h"), F.col("l")
    limit = F.when(buy & (low <= level), F.least(level, o)).when(~buy & (h >= level), F.greatest(level, o))
    stop = F.when(buy & (h >= level), F.greatest(level, o)).when(~buy & (low <= level), F.least(level, o))
    return F.when(kind == "limit", limit).when(kind == "stop", stop).when(kind == "market", o)


def funding_boundaries(trades: DataFrame, start: str = "entry_ts", end: str = "exit_ts") -> DataFrame:
    """trades with a row for each funding time (UTC 0, 8 and 16 o'clock) in (start, end]."""
    step = 8 * 3600
    first = F.floor(F.unix_seconds(F.col(start).cast("timestamp")) / step) + 1
    last = F.floor(F.unix_seconds(F.col(end).cast("timestamp")) / step)
    return trades.withColumn("k", F.explode(F.when(first <= last, F.sequence(first, last)))).withColumn("boundary", F.timestamp_seconds(F.col("k") * step)).drop("k")


def intent(price: Column, stop: Column, target: Column, side: Column) -> Column:
    """What a signal asks for, from its levels and the open side (1, -1, 0): exit, enter or reverse, and the side. Without
    levels it is an exit; a stop below the price or a target above it means long."""
    wanted = F.when(stop.isNotNull(), F.when(stop < price, 1).otherwise(-1)).when(target > price, 1).otherwise(-1)
    none = stop.isNull() & target.isNull()
    level = F.coalesce(stop, target)
    checked = F.when(level == price, F.raise_error(F.lit("a level equals the price")).cast("int")).otherwise(wanted)
    action = F.when(none, "exit").when((side != 0) & (side != checked), "reverse").otherwise("enter")
    return F.struct(action.alias("action"), F.when(~none, checked).alias("side"))


def matched(orders: DataFrame, bars: DataFrame, fee_rate: float = 0.0005, slip: float = 0.0005, gap_multiplier: float = 2.0) -> DataFrame:
    """Orders (order_id, sym, ts, kind, side, level, quantity) filled on the bar after their time: reference, price, fee,
    slippage, gap; a null price where the order does not trigger there. kind: market, limit, stop, take_profit."""
    found = next_bar(orders, bars, columns=("o", "h", "l"), seconds=86_400)
    met = found.withColumnsRenamed({"next_ts": "bar_ts", "next_o": "o", "next_h": "h", "next_l": "l"}).withColumn("bar_ts", F.col("bar_ts").cast("timestamp_ntz"))
    buy, o, level = F.col("side") > 0, F.col("o"), F.col("level")
    kind = F.when(F.col("kind") == "take_profit", "limit").otherwise(F.col("kind"))
    reference = trigger_price(kind, buy, level)
    gap = F.when(F.col("kind").isin("market", "take_profit"), False).otherwise(reference != level)
    rate = F.when(gap, slip * gap_multiplier).otherwise(slip)
    out = met.withColumn("reference", reference).withColumn("gap", gap & F.col("reference").isNotNull()).withColumn("price", F.bround(F.col("reference") * (1 + F.col("side") * rate), 8))
    return out.withColumn("fee", fee(F.col("price") * F.col("quantity"), fee_rate)).withColumn("slippage", F.bround(F.abs(F.col("price") - F.col("reference")) * F.col("quantity"), 8)).drop("o", "h", "l")


# ---- the pass


@dataclass(frozen=True)
class Rules:
    """A run. distance: share of the price between decision and stop, where bars have no column `distance` of their own.
    reward: of the target, in stop distances (None: no target). spread, impact, liquidity: slippage that grows with the
    quantity takes the place of entry_slip and exit_slip where liquidity is given. wallet_share: sizes by cash, not risk."""

    capital: float = 100_000.0
    risk: float = 0.01
    distance: float = 0.02
    reward: float | None = 2.0
    fee: float = 0.0005
    entry_slip: float = 0.0005
    exit_slip: float = 0.0001
    spread: float = 0.0
    impact: float = 0.0
    liquidity: float | None = None
    gap_multiplier: float = 2.0
    leverage: int = 1
    maintenance: float = 0.004
    funding: float = 0.0001
    bar_seconds: int = 3600
    wallet_share: float | None = None
    spot: bool = False

    def exact(self, name: str) -> Decimal:
        return Decimal(str(getattr(self, name)))


#: Money and prices of the journal are doubles of exact decimals.
JOURNAL = {
    "run_id": "string", "sym": "string", "seq": "bigint", "kind": "string", "ts": "timestamp_ntz", "trade_id": "bigint", "side": "int", "action": "string", "reason": "string", "decision_ts": "timestamp_ntz",
    "reference": "double", "price": "double", "quantity": "double", "fee": "double", "slippage": "double", "gap": "boolean", "truncated": "boolean", "stop": "double", "target": "double",
    "cash": "double", "margin": "double", "unrealized": "double", "equity": "double", "rate": "double", "amount": "double", "theoretical": "double",
}
JOURNAL_DDL = ", ".join(f"{k} {v}" for k, v in JOURNAL.items())
_ARROW = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "timestamp_ntz": pa.timestamp("us")}
_SCHEMA = pa.schema([(k, _ARROW[v]) for k, v in JOURNAL.items()])
_MS = timedelta(milliseconds=1)
_EIGHT = 8 * 3600
_EPOCH = datetime(1970, 1, 1)
LONG, SHORT = 1, -1


def funding_times(after: datetime, until: datetime) -> list[datetime]:
    """UTC 0, 8 and 16 o'clock in (after, until]."""
    k = (after - _EPOCH) // timedelta(seconds=_EIGHT) + 1
    out = []
    while (at := _EPOCH + timedelta(seconds=_EIGHT * k)) <= until:
        out.append(at)
        k += 1
    return out


class Book:
    """Cash and one isolated position of a run on a series; writes the journal."""

    def __init__(self, rules: Rules, run_id: str, sym: str):
        self.rules, self.run_id, self.sym = rules, run_id, sym
        self.cash, self.side, self.trade, self.seq = money(rules.capital), 0, 0, 0
        self.margin = Decimal(0)
        self.waiting: list[dict] = []
        self.rows: list[tuple] = []
        self.fee_rate, self.mmr = rules.exact("fee"), rules.exact("maintenance")

    def note(self, kind: str, ts: datetime, **values) -> None:
        self.seq += 1
        values = {"run_id": self.run_id, "sym": self.sym, "seq": self.seq, "kind": kind, "ts": ts} | {k: float(v) if isinstance(v, Decimal) else v for k, v in values.items()}
        self.rows.append(tuple(values.get(k) for k in JOURNAL))

    # -- money

    def unrealized(self, mark) -> Decimal:
        return money(self.side * (money(mark) - self.price) * self.quantity) if self.side else Decimal(0)

    def equity(self, mark) -> Decimal:
        return self.cash + self.margin + self.unrealized(mark)

    def quoted(self, reference: Decimal, quantity: Decimal, direction: int, entering: bool, gap: bool) -> tuple[Decimal, Decimal]:
        """Price and cost of slippage: a rate on the reference's notional, against the order."""
        r = self.rules
        if r.liquidity is not None:
            rate = r.exact("spread") / 2 + r.exact("impact") * quantity / r.exact("liquidity")
        else:
            rate = r.exact("entry_slip" if entering else "exit_slip")
        slip = money(money(reference * quantity) * rate * (r.exact("gap_multiplier") if gap else 1))
        return money(reference + direction * slip / quantity), slip

    def needed(self, price: Decimal, quantity: Decimal) -> Decimal:
        """Margin, and the fees in and out."""
        notional = money(price * quantity)
        return money(notional / self.rules.leverage) + 2 * money(notional * self.fee_rate)

    def affordable(self, price: Decimal, most: Decimal) -> Decimal:
        """The largest quantity that cash covers: the quotient, then down by units of 1e-8 while rounding makes it too dear."""
        quotient = self.cash / (price * (Decimal(1) / self.rules.leverage + 2 * self.fee_rate))
        units = min(int(most / _UNIT), int(quotient / _UNIT) + 4)
        while units > 0 and self.needed(price, units * _UNIT) > self.cash:
            units -= 1
        return max(0, units) * _UNIT

    def sized(self, order: dict, reference: Decimal) -> tuple[Decimal, bool]:
        """The quantity within risk and margin at its own price; slippage may depend on it, so until it stays."""
        quantity = asked = money(order["quantity"])
        within = asked if self.rules.wallet_share is not None else money(order["budget"] / order["distance"])
        while quantity > 0:
            price, _ = self.quoted(reference, quantity, order["side"], True, False)
            less = min(quantity, within, self.affordable(price, quantity))
            if less == quantity:
                break
            quantity = less
        return quantity, quantity < asked

    # -- fills

    def enter(self, ts: datetime, reference, order: dict) -> None:
        reference = money(reference)
        order = order | {"budget": money(self.equity(reference) * self.rules.exact("risk"))}
        quantity, truncated = self.sized(order, reference)
        if quantity <= 0:
            self.note("decision", ts, action="skip", reason="available_margin", side=order["side"], decision_ts=order["ts"])
            return
        self.price, slip = self.quoted(reference, quantity, order["side"], True, False)
        notional = money(self.price * quantity)
        cost = money(notional * self.fee_rate)
        self.side, self.quantity, self.entered = order["side"], quantity, ts
        self.margin = money(notional / self.rules.leverage)
        self.cash -= self.margin + cost
        self.stop, self.target, self.trade = order["stop"], order["target"], self.trade + 1
        self.liquidation = money(self.price * (1 - self.side * (Decimal(1) / self.rules.leverage - self.mmr)))
        self.note("fill", ts, trade_id=self.trade, side=self.side, action="entry", decision_ts=order["ts"], reference=reference, price=self.price, quantity=quantity, fee=cost, slippage=slip, gap=False, truncated=truncated, stop=self.stop, target=self.target, cash=self.cash, margin=self.margin)

    def leave(self, ts: datetime, reference, reason: str, gap: bool = False, decided: datetime | None = None) -> None:
        reference = money(reference)
        price, slip = self.quoted(reference, self.quantity, -self.side, False, gap)
        cost = money(money(price * self.quantity) * self.fee_rate)
        self.cash += self.margin + money(self.side * (price - self.price) * self.quantity) - cost
        side, self.side, self.margin = self.side, 0, Decimal(0)
        self.note("fill", ts, trade_id=self.trade, side=side, action="exit", reason=reason, decision_ts=decided, reference=reference, price=price, quantity=self.quantity, fee=cost, slippage=slip, gap=gap, truncated=False, cash=self.cash, margin=Decimal(0))

    def settle(self, at: datetime, price, rate: float | None) -> None:
        """Funding at one time: capped by the isolated margin, which moves the liquidation price; all of it gone, the position goes."""
        source = "fallback" if rate is None else "measured"
        exact = self.rules.exact("funding") if rate is None else Decimal(str(rate))
        due = money(self.side * money(money(price) * self.quantity) * exact)
        paid = min(due, self.margin) if due > 0 else due
        self.margin -= paid
        share = self.margin / (self.quantity * self.price)
        self.liquidation = money(max(Decimal(0), self.price * (1 - self.side * (share - self.mmr))))
        self.note("funding", at, trade_id=self.trade, side=self.side, reason=source, reference=money(price), quantity=self.quantity, rate=float(exact), amount=paid, theoretical=due, margin=self.margin)
        if due > 0 and not self.margin:
            self.leave(at + _MS, price, "LIQUIDATION", decided=at)

    def protect(self, b: dict, close: datetime) -> None:
        """Stop, liquidation and target on the bar's range. A stop beyond the liquidation price yields to it; a stop comes before a target."""
        o, adverse, good = money(b["o"]), *(money(x) for x in ((b["l"], b["h"]) if self.side > 0 else (b["h"], b["l"])))
        reached = lambda level, extreme, way: way * self.side * (extreme - level) >= 0
        stopped = self.stop is not None and reached(self.stop, adverse, -1)
        liquidated = not self.rules.spot and reached(self.liquidation, adverse, -1)
        past = lambda level: self.side * (o - level) < 0
        if liquidated and (not stopped or self.side * (self.stop - self.liquidation) < 0):
            self.leave(close, self.liquidation, "LIQUIDATION", past(self.liquidation), b["ts"])
        elif stopped:
            self.leave(close, o if past(self.stop) else self.stop, "STOP_LOSS", past(self.stop), b["ts"])
        elif self.target is not None and reached(self.target, good, 1):
            beyond = self.side * (o - self.target) > 0
            self.leave(close, o if beyond else self.target, "TAKE_PROFIT", beyond, b["ts"])

    # -- bars

    def judge(self, b: dict, close: datetime, following: dict | None) -> None:
        """The signal at the close: orders for the next open, or why there are none."""
        s, r = b["signal"], self.rules
        skip = lambda reason: self.note("decision", close, action="skip", reason=reason, side=s, decision_ts=close)
        missing = "end_of_data" if following is None else "next_candle_gap" if following["ts"] != close else None
        if s is None:
            return
        if s == 0 and not self.side:
            return skip("no_position")
        if s and s == self.side:
            return skip("pyramiding_disabled")
        if s and r.spot and s == SHORT:
            return skip("spot_short_not_supported")
        if s and r.risk > 0.01:
            return skip("exposure_limit")
        if missing:
            return skip(missing)
        action = "exit" if s == 0 else "reverse" if self.side else "enter"
        self.note("decision", close, action=action, side=s or self.side, decision_ts=close)
        if self.side:
            self.waiting.append({"exit": "SIGNAL" if s == 0 else "REVERSAL", "ts": close})
        if s:
            price = money(b["c"])
            distance = money(b["distance"]) if b.get("distance") is not None else money(price * r.exact("distance"))
            quantity = self.cash * r.exact("wallet_share") / price if r.wallet_share is not None else self.equity(b["c"]) * r.exact("risk") / distance
            target = None if r.reward is None else money(price + s * distance * r.exact("reward"))
            self.waiting.append({"exit": None, "ts": close, "side": s, "distance": distance, "stop": money(price - s * distance), "target": target, "quantity": quantity})

    def step(self, before: dict | None, b: dict, following: dict | None) -> None:
        close = b["ts"] + timedelta(seconds=self.rules.bar_seconds)
        orders, self.waiting = self.waiting, []
        for order in orders:
            if order["exit"]:
                self.leave(b["ts"] + _MS, b["o"], order["exit"], decided=order["ts"])
            else:
                self.enter(b["ts"] + _MS, b["o"], order)
        rates = {x["at"]: x["rate"] for x in b.get("rates") or ()}
        for at in () if self.rules.spot else funding_times(b["ts"], close):
            if self.side and self.entered < at:
                at_open = at == close and following is not None and following["ts"] == close
                last = following["o"] if at_open else b["c"] if at == close else before["c"] if before is not None else b["o"]
                self.settle(at, last, rates.get(at))
        if self.side and self.entered < b["ts"]:
            self.protect(b, close)
        kept = self.unrealized(b["c"])
        self.note("equity", close, trade_id=self.trade if self.side else None, side=self.side, quantity=self.quantity if self.side else Decimal(0), reference=money(b["c"]), cash=self.cash, margin=self.margin, unrealized=kept, equity=self.cash + self.margin + kept)
        self.judge(b, close, following)
        if self.side and (following is None or following["ts"] != close):
            self.leave(close + _MS, b["c"], "END_OF_DATA" if following is None else "DATA_GAP", decided=None if following is None else close)
            if following is None:
                self.note("equity", close + _MS, side=0, quantity=Decimal(0), reference=money(b["c"]), cash=self.cash, margin=self.margin, unrealized=Decimal(0), equity=self.cash)


def journal_of(bars: list[dict], rules: Rules, run_id: str = "run", sym: str = "") -> list[dict]:
    """The journal of one series. bars: ts, o, h, l, c, signal (1 long, -1 short, 0 flat, None unknown), in order."""
    book = Book(rules, run_id, sym)
    for i, b in enumerate(bars):
        book.step(bars[i - 1] if i else None, b, bars[i + 1] if i + 1 < len(bars) else None)
    return [dict(zip(JOURNAL, r)) for r in book.rows]


def journal(bars: DataFrame, runs: Mapping[str, Rules], runs_a_task: int = 16) -> DataFrame:
    """The journal of every run on every series. bars: sym, ts, o, h, l, c, signal, and where there are such, distance
    (of the stop from the price at the close) and rates (array of struct at, rate: funding times in (ts, close])."""
    ship(bars.sparkSession)
    names = list(runs)
    shares = [names[i : i + runs_a_task] for i in range(0, len(names), runs_a_task)]
    columns = ["sym", "ts", "o", "h", "l", "c", "signal", *(c for c in ("distance", "rates") if c in bars.columns)]
    dealt = bars.select(*columns).withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(len(shares) - 1))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books: list[Book] = []
        owner, held, before = None, None, None

        def flushed(least: int) -> Iterator[pa.RecordBatch]:
            if sum(len(b.rows) for b in books) >= least:
                rows = [r for b in books for r in b.rows]
                for b in books:
                    b.rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SCHEMA)], schema=_SCHEMA)

        def moved(following: dict | None) -> None:
            for b in books:
                b.step(before, held, following)

        for batch in batches:
            data = {c: batch.column(c).to_pylist() for c in [*columns, "share"]}
            for i in range(batch.num_rows):
                b = {c: v[i] for c, v in data.items()}
                if (b["sym"], b["share"]) != owner:
                    if held is not None:
                        moved(None)
                        yield from flushed(1)
                    owner, held, before = (b["sym"], b["share"]), None, None
                    books = [Book(runs[n], n, b["sym"]) for n in shares[b["share"]]]
                if held is not None:
                    moved(b)
                    yield from flushed(8192)
                before, held = held, b
        if held is not None:
            moved(None)
            yield from flushed(1)

    in_order = dealt.repartition("sym", "share").sortWithinPartitions("sym", "share", "ts")
    return in_order.mapInArrow(run, JOURNAL_DDL)


def with_rates(bars: DataFrame, rates: DataFrame, bar_seconds: int) -> DataFrame:
    """bars with rates: the measured funding rates (sym, at, rate) of the times in (ts, close]."""
    seconds = F.unix_seconds(F.col("at").cast("timestamp"))
    own = F.timestamp_seconds((F.ceil(seconds / bar_seconds) - 1) * bar_seconds).cast("timestamp_ntz")
    listed = rates.groupBy("sym", own.alias("ts")).agg(F.array_sort(F.collect_list(F.struct("at", "rate"))).alias("rates"))
    return bars.join(listed, ["sym", "ts"], "left")


# ---- from the journal


def trades(kept: DataFrame) -> DataFrame:
    """A row a trade: fills and funding joined by its number. Gross from the references; every cost once."""
    ours = kept.filter("kind in ('fill', 'funding')").groupBy("run_id", "sym", "trade_id")
    one = lambda action, c: F.max(F.when(F.col("action") == action, F.col(c)))
    each = [one("entry", "side").alias("direction"), one("entry", "ts").alias("entry_ts"), one("entry", "reference").alias("entry_reference"), one("entry", "price").alias("entry_price"), one("entry", "quantity").alias("quantity"), one("entry", "stop").alias("stop"), one("entry", "target").alias("target"), one("exit", "ts").alias("exit_ts"), one("exit", "reference").alias("exit_reference"), one("exit", "price").alias("exit_price"), one("exit", "reason").alias("exit_reason")]
    total = lambda c: F.bround(F.coalesce(F.sum(c), F.lit(0.0)), 8)
    t = ours.agg(*each, total("fee").alias("fees"), total("slippage").alias("slippage"), total("amount").alias("funding"))
    t = t.withColumn("gross", F.bround(F.col("direction") * (F.col("exit_reference") - F.col("entry_reference")) * F.col("quantity"), 8))
    t = t.withColumn("net", F.bround(F.expr("gross - fees - slippage - funding"), 8)).withColumn("r0", F.bround(F.abs(F.col("entry_reference") - F.col("stop")) * F.col("quantity"), 8))
    t = t.withColumn("return_pct", F.bround(F.expr("net / (entry_reference * quantity) * 100"), 6)).withColumn("r_multiple", F.expr("net / nullif(r0, 0)"))
    return t.withColumn("side", F.when(F.col("direction") > 0, "LONG").otherwise("SHORT")).withColumn("liquidated", F.col("exit_reason") == "LIQUIDATION").drop("direction", "stop", "target")


def excursions(done: DataFrame, bars: DataFrame, bar_seconds: int = 3600) -> DataFrame:
    """run_id, sym, trade_id, mae, mfe with their times: the worst and best of the bars after the entry's that the trade was
    open on, joined by the days that it spans."""
    day = lambda c: F.to_date(c)
    b = bars.select("sym", F.col("ts").alias("bar_ts"), "h", "l", day("ts").alias("day"))
    open_days = F.explode(F.sequence(day("entry_ts"), day("exit_ts"), F.expr("interval 1 day"))).alias("day")
    t = done.select("run_id", "sym", "trade_id", "side", "entry_ts", "exit_ts", "entry_reference", "quantity", open_days)
    close = F.expr(f"bar_ts + interval {bar_seconds} seconds")
    held = t.join(b, ["sym", "day"]).filter(F.expr("bar_ts > entry_ts") & (F.col("bar_ts") < F.col("exit_ts") - F.expr("interval 1 millisecond")))
    side = F.when(F.col("side") == "LONG", 1).otherwise(-1)
    bad = F.bround(side * (F.when(side > 0, F.col("l")).otherwise(F.col("h")) - F.col("entry_reference")) * F.col("quantity"), 8)
    good = F.bround(side * (F.when(side > 0, F.col("h")).otherwise(F.col("l")) - F.col("entry_reference")) * F.col("quantity"), 8)
    x = held.select("run_id", "sym", "trade_id", bad.alias("bad"), good.alias("good"), close.alias("close"))
    return x.groupBy("run_id", "sym", "trade_id").agg(F.min("bad").alias("mae"), F.min_by("close", F.struct("bad", "close")).alias("mae_ts"), F.max("good").alias("mfe"), F.min_by("close", F.struct(-F.col("good"), F.col("close"))).alias("mfe_ts"))


def simulate(bars: DataFrame, runs: Mapping[str, Rules]) -> DataFrame:
    """The trades of every run and series."""
    return trades(journal(bars, runs))


def equity_curve(kept: DataFrame) -> DataFrame:
    """run_id, sym, ts, cash, position, equity, peak, drawdown at each close; one row a bar of a series in order."""
    w = Window.partitionBy("run_id", "sym").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    e = kept.filter("kind = 'equity'").withColumn("peak", F.max("equity").over(w))
    return e.select("run_id", "sym", "seq", "ts", "cash", F.bround(F.col("margin") + F.col("unrealized"), 8).alias("position"), "equity", "peak", (F.col("equity") / F.col("peak") - 1).alias("drawdown"))


def costed(fills: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """fills (notional; fee_rate, null where the default holds; gap) with fee, entry_slip, exit_slip and maintenance."""
    n, gap = F.col("notional"), F.when(F.coalesce("gap", F.lit(False)), rules.gap_multiplier).otherwise(1.0)
    return fills.withColumn("fee", fee(n * F.coalesce("fee_rate", F.lit(rules.fee)), 1.0)).withColumn("entry_slip", F.bround(n * rules.entry_slip * gap, 8)).withColumn("exit_slip", F.bround(n * rules.exit_slip, 8)).withColumn("maintenance", F.bround(n * rules.maintenance, 8))


@dataclass(frozen=True)
class Guard:
    """What a paper order must pass before it is sent, and again with what it filled at."""

    allowed: tuple[str, ...]
    most_quantity: float
    most_notional: float
    risk: float = 0.005
    market_limit: float = 0.01
    group_limit: float = 0.01
    direction_limit: float = 0.01
    killed: bool = False

    def judged(self, orders: DataFrame) -> DataFrame:
        """orders (sym, mode, spot, side, quantity, price, stop, equity; market_risk, total_risk, direction_risk: of the open
        positions) with the first reason to refuse each, null where there is none."""
        c, more = F.col, F.lit(self.risk)
        crowded = ~within(c("market_risk") + more, F.lit(self.market_limit)) | ~within(c("total_risk") + more, F.lit(self.group_limit)) | ~within(c("direction_risk") + more, F.lit(self.direction_limit))
        faults = [
            (F.lit(self.killed), "kill_switch"),
            (c("mode") != "paper", "paper_only"),
            (c("sym") != F.upper("sym"), "symbol_not_canonical"),
            (~c("sym").isin(*self.allowed), "symbol_not_allowed"),
            (c("spot") & (c("side") < 0), "spot_short_not_supported"),
            (c("quantity") > self.most_quantity, "max_order_quantity"),
            (c("quantity") * c("price") > self.most_notional, "max_order_notional"),
            (c("stop").isNull(), "protective_stop_required"),
            (F.abs(c("price") - c("stop")) * c("quantity") > c("equity") * MOST_RISK * (1 + 1e-9), "one_r_limit"),
            (c("side") == 0, "direction_required"),
            (crowded, "exposure_limit"),
        ]
        return orders.withColumn("reason", F.coalesce(*(F.when(bad, F.lit(why)) for bad, why in faults)))

    def after_fill(self, fills: DataFrame) -> DataFrame:
        """fills (quantity, price) with a reason where the size is over a limit after all."""
        return fills.withColumn("reason", F.when(F.col("quantity") > self.most_quantity, "max_order_quantity").when(F.col("quantity") * F.col("price") > self.most_notional, "max_order_notional"))


def grid_of(**axes: list) -> list[dict]:
    """All cells of a parameter grid, 100 at most."""
    cells: list[dict] = [{}]
    for name, values in axes.items():
        cells = [c | {name: v} for c in cells for v in values]
    if len(cells) > 100:
        raise ValueError("a sweep has 100 cells at most")
    return cells
