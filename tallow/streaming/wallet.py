"""Paper wallets over a stream of signals that carry the prices of the bar they fill on; each signal counts once."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

FILLS = "wallet string, signal_id bigint, side int, price double, quantity double, cash double, position double, reason string"


class _Wallet(StatefulProcessor):
    def __init__(self, capital: float, share: float, fee: float, slip: float, allowed: tuple[str, ...]):
        self.capital, self.share, self.fee, self.slip, self.allowed = capital, share, fee, slip, allowed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("wallet", "cash double, position double, last bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        cash, position, last = self.state.get() if self.state.exists() else (self.capital, 0.0, -1)
        out = []
        for s in pd.concat(list(rows)).sort_values("signal_id").itertuples():
            if s.signal_id <= last:
                continue
            last = int(s.signal_id)
            if self.allowed and s.sym not in self.allowed:
                out.append((key[0], last, int(s.side), None, 0.0, cash, position, "symbol_not_allowed"))
                continue
            if position and s.side != (1 if position > 0 else -1):
                price = s.open * (1 - self.slip * (1 if position > 0 else -1))
                cash += position * price - abs(position) * price * self.fee
                out.append((key[0], last, 0, price, abs(position), cash, 0.0, "closed"))
                position = 0.0
            if s.side and not position:
                price = s.open * (1 + self.slip * s.side)
                quantity = max(0.0, cash) * self.share / price
                position = quantity * s.side
                cash -= position * price + quantity * price * self.fee
                out.append((key[0], last, int(s.side), price, quantity, cash, position, "opened"))
        self.state.update((float(cash), float(position), last))
        if not out:
            return
        frame = pd.DataFrame(out, columns=["wallet", "signal_id", "side", "price", "quantity", "cash", "position", "reason"])
        yield frame.astype({"wallet": object, "reason": object, "signal_id": "int64", "side": "int32", "price": float, "quantity": float, "cash": float, "position": float})

    def close(self) -> None:
        pass


def wallet_fills(signals: DataFrame, capital: float = 100_000.0, share: float = 0.2, fee: float = 0.0005, slip: float = 0.0005, allowed: tuple[str, ...] = ()) -> DataFrame:
    """Fills and refusals of signals (wallet, signal_id, sym, side 1, -1 or 0, open: the next bar's open).

    A wallet holds one position; side 0 closes it, the other side closes it and opens anew. Signals at or below the
    last consumed id are replays and leave no trace. Start the query within `keyed_state`.
    """
    return signals.groupBy("wallet").transformWithStateInPandas(_Wallet(capital, share, fee, slip, allowed), FILLS, "Append", "None")


def store(root: str):
    """A function (batch, number) that keeps a batch of fills as one folder, there in whole or not at all: it is written aside
    and renamed. False where the number is there already, which leaves everything as it is."""

    def keep(batch: DataFrame, number: int) -> bool:
        spark = batch.sparkSession
        jvm = spark.sparkContext._jvm
        final, aside = (jvm.org.apache.hadoop.fs.Path(f"{root}/{p}") for p in (f"batch={number}", f"_aside-{number}"))
        fs = final.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if fs.exists(final):
            return False
        batch.write.mode("overwrite").parquet(str(aside))
        return bool(fs.rename(aside, final))

    return keep
