"""The stock as a stream gives what the batch fold gives, however the events are split into batches."""

import random

import pytest

from tomeforge.operators import ledger
from tomeforge.streaming import stock

SCHEMA = "owner string, item string, event_at string, id long, action string, quantity long, price_unit double"


def events(rng, n):
    actions = ["added", "visible", "configured", "bought", "removed", "hid_item", "unknown", "collected", "bought"]
    return [(rng.choice(["Al", None]), rng.choice(["cup", "pot", "rope", None]), f"2020-01-{1 + i // 20:02d} {10 + i % 10}:00:00", i, rng.choice(actions), rng.choice([1, 2, 3, 5, None]), rng.choice([None, 2.0, 2.5, 7.0])) for i in range(n)]


def streamed(spark, path, batches, counts, patience):
    spark.conf.set(*stock.PROVIDER)
    for i, b in enumerate(batches):
        spark.createDataFrame(b, SCHEMA).coalesce(1).write.parquet(f"{path}/in/{i:03d}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{path}/in")
    state = {}

    def keep(frame, _):
        fresh = {}
        for r in frame.collect():
            fresh.setdefault((r.owner, r.item), []).append((r.place, r.price, r.quantity, r.status))
        state.update(fresh)

    # twice, as if the job had been lost in between: the rest goes on from the checkpoint
    q = stock.stock_stream(stream, patience=patience).writeStream.outputMode("update").option("checkpointLocation", f"{path}/ck").foreachBatch(keep).trigger(availableNow=True).start()
    q.awaitTermination()
    return {k: sorted(v) for k, v in state.items() if v[0][3] != "gone"}


@pytest.mark.parametrize(("seed", "size", "shuffled", "patience"), [(1, 7, False, 0), (2, 25, True, 10**7), (3, 60, True, 10**7)])
def test_equals_the_batch_fold(spark, tmp_path, seed, size, shuffled, patience):
    rng = random.Random(seed)
    rows = events(rng, 60)
    counts = [("Al", "cup", 4, 9.0, "2020-01-02 12:00:00"), (None, "pot", 0, None, "2020-01-01 15:30:00")]
    all_ = rows + [(o, i, at, -1, "baseline", n, p) for o, i, n, p, at in counts]
    all_.sort(key=lambda r: (r[2], r[4] == "baseline", r[3]))
    if shuffled:
        rng.shuffle(all_)
    got = streamed(spark, tmp_path, [all_[i : i + size] for i in range(0, len(all_), size)], counts, patience)
    want = {}
    base = spark.createDataFrame(counts, "owner string, item string, quantity long, price_unit double, recorded_at string")
    for r in ledger.inventory(spark.createDataFrame(rows, SCHEMA), base.filter("owner is not null")).collect():
        want.setdefault((r.owner, r.item), []).append((r.place, r.price, r.quantity, r.status))
    # the batch form joins counts by key, so one without an owner meets nothing there; the fold itself tells
    own = [r for r in sorted(rows, key=lambda r: (r[2], r[3])) if r[0] is None and r[1] == "pot" and r[2] > "2020-01-01 15:30:00" and r[4] not in stock.IGNORED]
    pot = ledger.Stock()
    pot.seed(0, None)
    for r in own:
        pot.apply(r[4], r[5] or 0, r[6])
    want.pop((None, "pot"), None)
    if pot.final():
        want[(None, "pot")] = [(i, p, n, pot.status()) for i, (p, n) in enumerate(pot.final(), 1)]
    assert got == {k: sorted(v) for k, v in want.items()}


def test_state_stays_small():
    """What is older than patience is folded into the stock and forgotten."""

    class Value:
        def __init__(self):
            self.value = None

        def exists(self):
            return bool(self.value)

        def get(self):
            return self.value

        def update(self, v):
            self.value = v

        put = update

        def clear(self):
            self.value = None

    import pandas as pd

    one = stock.Replay(3600, ("owner", "item"))
    one.stock, one.open = Value(), Value()
    for day in range(1, 20):
        frame = pd.DataFrame([(f"2020-01-{day:02d} 10:00:00", day, "added", 1, None)], columns=["event_at", "id", "action", "quantity", "price_unit"])
        (out,) = one.handleInputRows(("Al", "cup"), iter([frame]), None)
        assert out.quantity.tolist() == [day] and len(one.open.value) == 1
