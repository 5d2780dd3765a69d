"""Money management as columns: sizes, exposure limits and whole entry plans, a refusal where a plan is not sound."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Protocol, runtime_checkable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_RISK = 0.01
#: Units of one market at most, and the distance between them in N.
UNITS, STEP_N = 4, 0.5
#: The next double above the limit still counts as within it.
_ULP = 2.0**-52


def _sound(value: Column, ok: Column, what: str) -> Column:
    return F.when(ok, value).otherwise(F.raise_error(F.lit(what)).cast("double"))


def equity(cash: Column, margin: Column, unrealized: Column) -> Column:
    return cash + margin + unrealized


def one_r(entry: Column, stop: Column, quantity: Column) -> Column:
    return F.abs(entry - stop) * quantity


def risk_size(risk: Column, own: Column, distance: Column) -> Column:
    """Quantity that loses `risk` of the equity over the distance; null where risk is not in (0, 1 %] or the rest not positive."""
    return F.when((risk > 0) & (risk <= MOST_RISK) & (own > 0) & (distance > 0), risk * own / distance)


def wallet_share(balance: Column, share: float = 0.2) -> Column:
    """Notional by a share of the balance."""
    if not 0 <= share <= 1:
        raise ValueError("a share is between 0 and 1")
    return F.when(balance >= 0, balance * share)


def unit(risk: Column, own: Column, n: Column) -> Column:
    """One unit: the risk size over one N."""
    return risk_size(risk, own, n)


def ladder(entry: Column, n: Column, side: Column) -> Column:
    """Prices of the units of a position, half an N apart."""
    return F.transform(F.sequence(F.lit(0), F.lit(UNITS - 1)), lambda i: entry + side * n * STEP_N * i)


def kelly(p: Column, payoff: Column) -> Column:
    """The full share, which may be below zero; null for impossible inputs."""
    return F.when((p >= 0) & (p <= 1) & (payoff > 0), p - (1 - p) / payoff)


def capped(full: Column, fraction: float = 0.5) -> Column:
    if not 0 < fraction <= 0.5:
        raise ValueError("half the share at most")
    return F.greatest(F.lit(0.0), full) * fraction


def within(total: Column, limit: Column) -> Column:
    """Whether a sum of risks is at most the limit or the double after it."""
    return total <= limit * (1 + _ULP)


def exposure(risks: DataFrame, limits: Mapping[str, float], market: str = "market", group: str = "grp", direction: str = "direction", risk: str = "risk") -> DataFrame:
    """scope, name, total, allowed of a book's risks: by market, by correlated group and by direction. Sums are of decimals,
    so their order does not count."""
    exact = risks.select(F.explode(F.array(*(F.struct(F.lit(scope).alias("scope"), F.col(c).cast("string").alias("name")) for scope, c in (("market", market), ("group", group), ("direction", direction))))).alias("x"), F.col(risk).cast("decimal(28,12)").alias("r"))
    total = exact.groupBy("x.scope", "x.name").agg(F.sum("r").cast("double").alias("total"))
    limit = F.create_map(*(F.lit(v) for kv in limits.items() for v in kv))[F.col("scope")]
    return total.withColumn("allowed", within(F.col("total"), limit))


# ---- policies: a struct of stop, target, quantity, leverage, risk and refusal


@runtime_checkable
class Policy(Protocol):
    """Plans an entry from columns: side (1, -1), price, volatility, equity, cash."""

    name: str
    needs: tuple[str, int, str]  # indicator, length, timeframe ("strategy": that of the run)

    def plan(self, side: Column, price: Column, volatility: Column, own: Column, cash: Column, risk: float = MOST_RISK, maintenance: float = 0.004, most_leverage: int = 125, spot: bool = False) -> Column: ...


def _plan(stop: Column, target: Column, quantity: Column, leverage: Column, risk: Column, refusals: list[tuple[Column, str]]) -> Column:
    refusal = F.coalesce(*(F.when(bad, F.lit(why)) for bad, why in refusals), F.lit(None).cast("string"))
    kept = lambda c: F.when(refusal.isNull(), c)
    return F.struct(kept(stop).alias("stop"), kept(target).alias("target"), kept(quantity).alias("quantity"), kept(leverage).cast("int").alias("leverage"), kept(risk).alias("risk"), refusal.alias("refusal"))


class Manual:
    """A stop of some average true ranges, a target by reward over risk, and a leverage of one's own."""

    name, needs = "manual", ("atr", 14, "strategy")

    def __init__(self, multiple: float = 2.0, reward: float = 2.0, leverage: int = 1):
        self.multiple, self.reward, self.leverage = multiple, reward, leverage

    def plan(self, side, price, volatility, own, cash, risk=MOST_RISK, maintenance=0.004, most_leverage=125, spot=False):
        distance = volatility * self.multiple
        stop, target = price - side * distance, price + side * distance * self.reward
        leverage = 1 if spot else self.leverage
        refusals = [(~F.coalesce(distance > 0, F.lit(False)), "no_distance"), ((stop <= 0) | (target <= 0), "price_not_positive"), (F.lit(leverage > most_leverage), "leverage")]
        return _plan(stop, target, own * risk / distance, F.lit(leverage), own * risk, refusals)


class Turtle:
    """A stop of some daily N, no target, and as much leverage as the notional needs, if no liquidation comes before the stop."""

    name, needs = "turtle", ("atr", 20, "1d")

    def __init__(self, multiple: float = 2.0, cap: int = 5):
        self.multiple, self.cap = multiple, cap

    def plan(self, side, price, volatility, own, cash, risk=MOST_RISK, maintenance=0.004, most_leverage=125, spot=False):
        distance = volatility * self.multiple
        stop, quantity = price - side * distance, own * risk / distance
        leverage = F.greatest(F.lit(1), F.ceil(price * quantity / cash))
        liquidation = price * (1 - side * (1 / leverage - maintenance))
        most = 1 if spot else min(self.cap, most_leverage)
        refusals = [(~F.coalesce(distance > 0, F.lit(False)), "no_distance"), (stop <= 0, "price_not_positive"), (leverage > most, "cash" if spot else "leverage"), (side * (liquidation - stop) >= 0, "liquidation_before_stop")]
        return _plan(stop, F.lit(None).cast("double"), quantity, leverage, own * risk, refusals)


class WalletShare:
    """A share of the cash, the manual policy's levels."""

    name, needs = "wallet_share", ("atr", 14, "strategy")

    def __init__(self, share: float = 0.2, multiple: float = 2.0, reward: float = 2.0):
        self.share, self.multiple, self.reward = share, multiple, reward

    def plan(self, side, price, volatility, own, cash, risk=MOST_RISK, maintenance=0.004, most_leverage=125, spot=False):
        distance = volatility * self.multiple
        stop, target, quantity = price - side * distance, price + side * distance * self.reward, wallet_share(cash, self.share) / price
        refusals = [(~F.coalesce(distance > 0, F.lit(False)), "no_distance"), ((stop <= 0) | (target <= 0), "price_not_positive"), (~F.coalesce(quantity > 0, F.lit(False)), "cash")]
        return _plan(stop, target, quantity, F.lit(1), distance * quantity, refusals)


POLICIES: dict[str, type] = {p.name: p for p in (Manual, Turtle, WalletShare)}
