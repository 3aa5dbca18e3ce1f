"""Order-dependent replay of a stall ledger into priced tiers."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tomeforge.runtime import ship

#: Prices nearer than this are one price.
NEAR = 0.001
#: Days of history that count without a later baseline.
DAYS = 100


def _take(tiers: Iterable[list], quantity: int) -> int:
    """Takes stock off the tiers in turn; what is left to take."""
    for tier in tiers:
        n = min(quantity, max(tier[0], 0))
        tier[0] -= n
        quantity -= n
    return quantity


@dataclass
class Stock:
    """One item's tiers, [quantity, price or None] each, oldest first. A negative quantity is a sale of stock that no event has
    brought in; it stays until the next restock."""

    tiers: list[list] = field(default_factory=list)
    price: float | None = None
    first: str | None = None

    def seed(self, quantity: int, price: float | None) -> None:
        self.tiers, self.first = ([[quantity, price]] if quantity > 0 else []), "baseline"
        self.price = price if quantity > 0 else None

    def _holds(self) -> bool:
        return any(t[0] > 0 for t in self.tiers)

    def added(self, quantity: int) -> None:
        if sum(t[0] for t in self.tiers) < 0:
            self.tiers = []
        self.tiers.append([quantity, None])

    def shown(self, quantity: int, price: float | None) -> None:
        """A listing as seen: its price goes to so many unpriced units, from the front; without any, to the last tier. Empty stock is seeded."""
        if not self._holds() and (price is None or not any(t[1] is None and t[0] > 0 for t in self.tiers)):
            if quantity > 0:
                self.tiers.append([quantity, price])
            return
        if price is None:
            return
        out, left, met = [], quantity, False
        for n, own in self.tiers:
            now = min(n, left) if own is None and n > 0 else 0
            if now > 0:
                out.append([now, price])
                left, met = left - now, True
            if n - now:
                out.append([n - now, own])
        self.tiers = out
        if not met:
            self.tiers[-1][1] = price

    def bought(self, quantity: int, price: float | None) -> None:
        """Stock of just that price goes first, then the oldest."""
        if price is not None:
            quantity = _take((t for t in self.tiers if t[1] is not None and abs(t[1] - price) < NEAR), quantity)
        quantity = _take(self.tiers, quantity)
        if quantity > 0:
            self.tiers.append([-quantity, price])

    def apply(self, action: str, quantity: int, price: float | None) -> None:
        self.first = self.first or action
        if action == "added":
            self.added(quantity)
        elif action in ("visible", "configured"):
            self.shown(quantity, price)
        elif action == "bought":
            self.bought(quantity, price)
        elif action == "removed":
            _take(reversed(self.tiers), quantity)
        elif action == "hid_item":
            self.tiers = []
        if price is not None and action in ("visible", "configured", "bought"):
            self.price = price
        self.tiers = [t for t in self.tiers if t[0]]

    def final(self) -> list[tuple[float | None, int]]:
        """(price, quantity), tiers of one price together, cheapest first; unpriced stock last, at the last known price if nothing else is priced."""
        total: dict[int, int] = {}
        for n, price in self.tiers:
            if n > 0 and price is not None:
                total[round(price * 1000)] = total.get(round(price * 1000), 0) + n
        out: list[tuple[float | None, int]] = [(milli / 1000, n) for milli, n in sorted(total.items())]
        bare = sum(n for n, price in self.tiers if n > 0 and price is None)
        return out + ([(None if out else self.price, bare)] if bare else [])

    def status(self) -> str:
        if any(price is not None for price, _ in self.final()):
            return "listed"
        return "snapshot has no price" if self.first in ("visible", "configured", "baseline") else "added, never priced"


def replay(events: Iterable[tuple[str, int, float | None]], start: tuple[int, float | None] | None = None) -> list[list]:
    """The tiers after the (action, quantity, price) events in order."""
    stock = Stock()
    if start:
        stock.seed(*start)
    for event in events:
        stock.apply(*event)
    return stock.tiers


def usable_baseline(baseline: DataFrame, keys: list[str]) -> DataFrame:
    """The newest valid count of each key: keys, quantity, price_unit, recorded_at (text)."""
    sound = F.col(keys[-1]).isNotNull() & (F.col("quantity") >= 0) & (F.length(F.col("recorded_at").cast("string")) >= 10)
    newest = Window.partitionBy(*keys).orderBy(F.desc(F.col("recorded_at").cast("string")))
    return baseline.filter(sound).withColumn("_r", F.row_number().over(newest)).filter("_r = 1").select(*keys, F.col("quantity").cast("long").alias("quantity"), F.col("price_unit").cast("double").alias("price_unit"), F.col("recorded_at").cast("string").alias("recorded_at"))


def kept(events: DataFrame, as_of: str | None, after_count: Column) -> Column:
    """Which events count: sales and hidden items always, those after a count, and what is not older than DAYS at as_of (a day)."""
    recent = F.lit(True) if as_of is None else F.col("event_at").cast("string") >= F.date_sub(F.to_date(F.lit(as_of)), DAYS).cast("string")
    return ~F.col("action").isin("unknown", "collected") & F.col("event_at").isNotNull() & (F.col("action").isin("bought", "hid_item") | recent | after_count)


def inventory(events: DataFrame, baseline: DataFrame | None = None, keys: tuple[str, str] = ("owner", "item"), as_of: str | None = None) -> DataFrame:
    """owner, item, price (null: not priced), quantity, place, status of the stock that is left.

    events: keys, event_at, id, action, quantity, price_unit; baseline: keys, quantity, price_unit, recorded_at. A count replaces all
    events up to its time. Events are brought together by key and sorted by (event_at, id) in Spark, and folded as a stream: a task
    holds the tiers of one key at a time, however long its history.
    """
    k = list(keys)
    own = events.filter(F.col(k[-1]).isNotNull()).select(*k, F.col("event_at").cast("string").alias("event_at"), F.col("id").cast("long").alias("id"), "action", F.coalesce(F.col("quantity"), F.lit(0)).cast("long").alias("quantity"), F.col("price_unit").cast("double").alias("price_unit"))
    if baseline is not None:
        counts = usable_baseline(baseline, k)
        own = own.join(counts.select(*k, "recorded_at"), k, "left")
        own = own.filter(kept(own, as_of, F.col("event_at") > F.col("recorded_at"))).filter(F.col("recorded_at").isNull() | (F.col("event_at") > F.col("recorded_at"))).drop("recorded_at")
        own = own.unionByName(counts.select(*k, F.col("recorded_at").alias("event_at"), F.lit(-1).cast("long").alias("id"), F.lit("baseline").alias("action"), "quantity", "price_unit"))
    else:
        own = own.filter(kept(own, as_of, F.lit(False)))
    order = F.when(F.col("action") == "baseline", 0).otherwise(1)
    # by an expression of its own: a union of children that are dealt by the key already is not dealt again, though their parts may differ
    own = own.repartition(F.xxhash64(*k)).sortWithinPartitions(*k, order, "event_at", "id")

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, stock = None, Stock()
        names = [*k, "price", "quantity", "place", "status"]
        for f in frames:
            rows = []
            for a, b, action, n, price in zip(f[k[0]], f[k[1]], f["action"], f["quantity"].tolist(), f["price_unit"].tolist(), strict=True):
                key = (None if pd.isna(a) else a, b)
                if key != at:
                    rows += [(*at, price_, n_, i, stock.status()) for i, (price_, n_) in enumerate(stock.final(), 1)] if at else []
                    at, stock = key, Stock()
                price = None if price is None or price != price else price
                if action == "baseline":
                    stock.seed(n, price)
                else:
                    stock.apply(action, n, price)
            yield pd.DataFrame(rows, columns=names)
        if at:
            yield pd.DataFrame([(*at, price_, n_, i, stock.status()) for i, (price_, n_) in enumerate(stock.final(), 1)], columns=names)

    ship(events.sparkSession)
    types = dict(events.dtypes)
    return own.mapInPandas(fold, f"{k[0]} {types[k[0]]}, {k[1]} {types[k[1]]}, price double, quantity long, place int, status string")


def after_baseline(events: DataFrame, baseline: DataFrame, keys: list[str]) -> DataFrame:
    """Events later than the newest baseline of their key; keys without a baseline keep all."""
    newest = Window.partitionBy(*keys).orderBy(F.desc("recorded_at"))
    own = baseline.withColumn("_r", F.row_number().over(newest)).filter("_r = 1").select(*keys, "recorded_at")
    return events.join(own, keys, "left").filter(F.col("recorded_at").isNull() | (F.col("event_at") > F.col("recorded_at"))).drop("recorded_at")
