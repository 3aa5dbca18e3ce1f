"""The stall's stock kept up to date as a stream: the same fold as `ledger.inventory`, with its state in Spark's state store.

Each (owner, item) has the stock up to some time and the events after it, which are still open as an earlier one may come. A batch brings
new events; the answer for a key is its open events, in order, folded on its stock. Events that are older than the newest by more than
`patience` are then folded into the stock for good, so the state of a hot key stays as small as what came within that time.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tomeforge.operators.ledger import Stock
from tomeforge.runtime import ship

#: What the state store needs; set it before the stream begins.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: Actions that do not count.
IGNORED = ("unknown", "collected")


def _order(event: list) -> tuple:
    """(time, whether it is a count, id): a count stands after all events of its time, which it takes the place of."""
    at, ident, action, *_ = event
    return at, action == "baseline", ident


def _apply(stock: Stock, event: list) -> Stock:
    _, _, action, quantity, price = event
    if action == "baseline":
        stock = Stock()
        stock.seed(quantity, price)
    else:
        stock.apply(action, quantity, price)
    return stock


class Replay(StatefulProcessor):
    """State of a key: the stock as JSON, and the open events."""

    def __init__(self, patience: float, keys: tuple[str, str]):
        self.patience, self.keys = patience, keys

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.stock = handle.getValueState("stock", "stock string")
        self.open = handle.getListState("open", "event string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        kept = self.stock.get()[0] if self.stock.exists() else None
        stock = Stock(**json.loads(kept)) if kept else Stock()
        events = [json.loads(e[0]) for e in self.open.get()] if self.open.exists() else []
        for f in rows:
            for at, ident, action, n, price in zip(f["event_at"], f["id"].tolist(), f["action"], f["quantity"].tolist(), f["price_unit"].tolist(), strict=True):
                events.append([at, ident, action, n, None if price is None or price != price else price])
        events.sort(key=_order)
        newest = pd.Timestamp(events[-1][0]) if events else None
        final = [e for e in events if (newest - pd.Timestamp(e[0])).total_seconds() > self.patience]
        for e in final:
            stock = _apply(stock, e)
        self.stock.update((json.dumps(asdict(stock)),))
        rest = events[len(final) :]
        self.open.put([(json.dumps(e),) for e in rest]) if rest else self.open.clear()
        for e in rest:
            stock = _apply(stock, e)
        shown = [(*key, price, n, i, stock.status()) for i, (price, n) in enumerate(stock.final(), 1)] or [(*key, None, 0, 0, "gone")]
        yield pd.DataFrame(shown, columns=[*self.keys, "price", "quantity", "place", "status"])

    def close(self) -> None:
        pass


def stock_stream(events: DataFrame, keys: tuple[str, str] = ("owner", "item"), patience: float = 86_400) -> DataFrame:
    """After each batch the stock of every key that it has events of: keys, price, quantity, place, status, as `ledger.inventory` gives it; a key
    without stock has one row of quantity 0 and status gone.

    events (a stream): keys, event_at (a time or its text), id, action, quantity, price_unit; a count of the stock is an event whose
    action is baseline. patience: seconds by which an event may come after a later one of its key; one that comes later still is
    applied when it comes. Events without an item or time, and those that do not count, go.
    """
    spark = events.sparkSession
    ship(spark)
    k = list(keys)
    own = events.filter(F.col(k[-1]).isNotNull() & F.col("event_at").isNotNull() & ~F.coalesce("action", F.lit("unknown")).isin(*IGNORED))
    own = own.select(*(F.col(c).cast("string").alias(c) for c in k), F.col("event_at").cast("string").alias("event_at"), F.coalesce(F.col("id"), F.lit(-1)).cast("long").alias("id"), "action", F.coalesce(F.col("quantity"), F.lit(0)).cast("long").alias("quantity"), F.col("price_unit").cast("double").alias("price_unit"))
    schema = f"{k[0]} string, {k[1]} string, price double, quantity long, place int, status string"
    return own.groupBy(*k).transformWithStateInPandas(statefulProcessor=Replay(patience, keys), outputStructType=schema, outputMode="Update", timeMode="None")
