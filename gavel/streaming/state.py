"""Keyed state that outlives the process: the stateful processors of :mod:`gavel.streaming.jobs`.

State is in the query's checkpoint (RocksDB), as values, maps and event-time timers, and advances with the batch: a query
that is killed and started again on its checkpoint goes on where the last committed batch ended. A handler
keeps one entry per tick, hour or context key of a batch, never its rows, and reads them in chunks by pandas operations.
A call of a handler costs some 10 ms whatever it holds, so where keys are many a call serves a slot of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_durable_state(spark: SparkSession) -> None:
    """Queries started from now on keep their state in RocksDB, as values, maps and timers need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def _seconds(column: pd.Series) -> pd.Series:
    return column.astype("datetime64[s]").astype("int64")


def _micros(column: pd.Series) -> pd.Series:
    return column.astype("datetime64[us]").astype("int64")


class _Keyed(StatefulProcessor):
    """A processor with one value per key; ``columns`` of its output."""

    state: str
    columns: list[str]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("value", self.state)

    def held(self) -> tuple | None:
        return tuple(self.value.get()) if self.value.exists() else None

    def only_timer(self, at_ms: int) -> None:
        """The key's one timer; earlier ones are void."""
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old[0] if isinstance(old, (tuple, list)) else old)
        self.handle.registerTimer(at_ms)

    def frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=self.columns)

    def close(self) -> None:
        pass


class _Slots(StatefulProcessor):
    """A processor whose groups are slots of keys (column ``key_text``). What a slot holds about its keys are the ``tables``
    of its state, each one value in Arrow's format: a batch reads and writes it once, however many keys it has."""

    tables: dict[str, dict[str, str]]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.values = {name: handle.getValueState(name, "entries binary") for name in self.tables}

    def held(self, name: str = "keys") -> pd.DataFrame:
        value = self.values[name]
        if value.exists():
            return pa.ipc.open_stream(bytes(value.get()[0])).read_pandas()
        return pd.DataFrame({c: pd.Series(dtype=t) for c, t in self.tables[name].items()})

    def hold(self, entries: pd.DataFrame, name: str = "keys") -> None:
        table = pa.Table.from_pandas(entries[list(self.tables[name])].astype(self.tables[name]), preserve_index=False)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        self.values[name].update((sink.getvalue().to_pybytes(),))

    def close(self) -> None:
        pass


def _last(frames: list[pd.DataFrame], keys: list[str], order: list[str]) -> pd.DataFrame:
    """The last row of each key by ``order``; of equal ones that of the earliest frame."""
    rows = pd.concat(frames[::-1], ignore_index=True) if len(frames) > 1 else frames[0]
    return rows.sort_values(order, kind="stable").drop_duplicates(keys, keep="last")


class PriceDrops(_Slots):
    tables = {"keys": {"key_text": "object", "base": "float64", "target": "float64"}}
    columns = ["key_text", "ts", "old_price", "new_price", "drop_pct"]

    def __init__(self, tick_seconds: int) -> None:
        self.tick_seconds = tick_seconds

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.held()
        watched = dict(zip(known["key_text"], zip(known["base"].tolist(), known["target"].tolist())))
        ticks = []
        for pdf in rows:
            first = pdf.drop_duplicates("key_text")
            for k, base, target in zip(first["key_text"], first["baseline_price"].tolist(), first["target_drop_percent"].tolist()):
                watched.setdefault(k, (base, target))
            pdf = pdf.assign(tick=_seconds(pdf["ts"]) // self.tick_seconds)[["key_text", "tick", "ts", "price"]]
            ticks.append(_last([pdf], ["key_text", "tick"], ["ts", "price"]))
        last = _last(ticks, ["key_text", "tick"], ["ts", "price"]).sort_values(["key_text", "tick"])
        out = []
        for k, ts, price in zip(last["key_text"], last["ts"], last["price"].tolist()):
            base, target = watched[k]
            if base > 0 and 0 < price < base and (base - price) / base * 100.0 >= target:
                out.append((k, ts, base, price, (base - price) / base * 100.0))
                watched[k] = (price, target)
        self.hold(pd.DataFrame([(k, *v) for k, v in watched.items()], columns=list(self.tables["keys"])))
        yield pd.DataFrame(out, columns=self.columns)


class Cooldown(_Slots):
    """Keys whose cooldown is over are dropped when their slot is next read, and by the slot's timer at the latest."""

    tables = {"keys": {"key_text": "object", "last": "int64"}}

    def __init__(self, wait: int, tick_seconds: int) -> None:
        self.wait, self.tick_seconds = wait, tick_seconds

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.held()
        fired = dict(zip(known["key_text"], known["last"].tolist()))
        ticks = []
        for pdf in rows:
            seen = pd.DataFrame({"key_text": pdf["key_text"], "t": _seconds(pdf["ts"]) // self.tick_seconds * self.tick_seconds})
            ticks.append(seen.drop_duplicates())
        order = pd.concat(ticks).drop_duplicates().sort_values(["key_text", "t"])
        out = []
        for k, t in zip(order["key_text"], order["t"].tolist()):
            last = fired.get(k)
            if last is None or t >= last + self.wait:
                out.append((k, t))
                fired[k] = t
        self.hold(pd.DataFrame(list(fired.items()), columns=["key_text", "last"]))
        self.handle.registerTimer((max(fired.values()) + self.wait) * 1000)
        at = pd.to_datetime(pd.Series([t for _, t in out], dtype="int64"), unit="s")
        yield pd.DataFrame({"key_text": [k for k, _ in out], "fired_at": at})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        known = self.held()
        self.hold(known[(known["last"] + self.wait) * 1000 > expiredTimerInfo.getExpiryTimeInMs()])
        yield pd.DataFrame({"key_text": pd.Series(dtype="object"), "fired_at": pd.Series(dtype="datetime64[ns]")})


class Silence(_Keyed):
    state = "last bigint"
    columns = ["key", "last_seen"]

    def __init__(self, limit: int) -> None:
        self.limit = limit

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.held()
        last = held[0] if held else None
        hours: dict[int, tuple[int, int]] = {}
        for pdf in rows:
            secs = _seconds(pdf["ts"])
            spans = secs.groupby(secs // 3600).agg(["min", "max"])
            for hour, lo, hi in zip(spans.index, spans["min"].tolist(), spans["max"].tolist()):
                old = hours.get(hour, (lo, hi))
                hours[hour] = (min(lo, old[0]), max(hi, old[1]))
        out = []
        for lo, hi in (hours[h] for h in sorted(hours)):
            if last is not None and lo - last >= self.limit:
                out.append((*key, pd.Timestamp(last, unit="s")))
            last = hi if last is None else max(last, hi)
        self.value.update((last,))
        self.only_timer((last + self.limit) * 1000)
        yield self.frame(out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.held()
        self.value.clear()
        yield self.frame([(*key, pd.Timestamp(held[0], unit="s"))] if held else [])


class NewestMatches(_Slots):
    """The newest ``top`` ids of each batch above a rule's cursor, which then moves to the newest."""

    tables = {"keys": {"key_text": "object", "cursor": "int64"}}

    def __init__(self, top: int) -> None:
        self.top = top

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.held()
        best = pd.DataFrame({"key_text": pd.Series(dtype="object"), "id": pd.Series(dtype="int64")})
        for pdf in rows:
            new = pdf[["key_text", "last_listing_id"]].drop_duplicates("key_text").rename(columns={"last_listing_id": "cursor"})
            known = pd.concat([known, new], ignore_index=True).drop_duplicates("key_text")
            ids = pdf[["key_text", "id"]].merge(known, "left", on="key_text")
            ids = pd.concat([best, ids.loc[ids["id"] > ids["cursor"], ["key_text", "id"]]], ignore_index=True)
            ids = ids.sort_values(["key_text", "id"], ascending=[True, False])
            best = ids[ids.groupby("key_text").cumcount() < self.top]
        moved = known["key_text"].map(best.drop_duplicates("key_text").set_index("key_text")["id"])
        self.hold(known.assign(cursor=known["cursor"].astype("Int64").mask(moved.notna(), moved.astype("Int64"))))
        yield best.assign(pick=best.groupby("key_text").cumcount() + 1)


class ProfileChanges(_Slots):
    """What a batch changed in the parts of users' profiles: a row with the totals of a key, and one per context key
    with a newer value. Every figure only grows in its order, so changes merge in any order and twice."""

    TOTALS = "first_us bigint, last_us bigint, messages bigint, callbacks bigint, intent string, intent_us bigint, intent_id bigint"
    CONTEXT = "context_key string, context_value string, context_us bigint, context_id bigint"
    tables = {
        "totals": {"key_text": "object", "first_us": "int64", "last_us": "int64", "messages": "int64", "callbacks": "int64"},
        "intents": {"key_text": "object", "intent": "object", "us": "int64", "id": "Int64"}, "context": {"key_text": "object", "context_key": "object", "us": "int64", "id": "Int64"},
    }

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        totals, intents, context = [self.held("totals")], [self.held("intents")], [self.held("context").assign(context_value=None, new=False)]
        touched: list[pd.Series] = []
        for pdf in rows:
            pdf = pdf.assign(us=_micros(pdf["ts"]), id=pdf["id"].astype("Int64"), callbacks=pdf["action"] == "callback", new=True)
            pdf["messages"] = ~pdf["callbacks"] & pdf["action"].notna()
            totals.append(pdf.groupby("key_text").agg(first_us=("us", "min"), last_us=("us", "max"), messages=("messages", "sum"), callbacks=("callbacks", "sum")).reset_index())
            touched.append(totals[-1]["key_text"])
            intents.append(_last([pdf.loc[pdf["intent"].notna(), ["key_text", "intent", "us", "id"]]], ["key_text"], ["us", "id"]))
            context.append(_last([pdf.loc[pdf["context_key"].notna(), ["key_text", "context_key", "us", "id", "context_value", "new"]]], ["key_text", "context_key"], ["us", "id"]))
        total = pd.concat(totals).groupby("key_text").agg({"first_us": "min", "last_us": "max", "messages": "sum", "callbacks": "sum"}).reset_index()
        intent, newest = _last(intents, ["key_text"], ["us", "id"]), _last(context, ["key_text", "context_key"], ["us", "id"])
        self.hold(total, "totals")
        self.hold(intent, "intents")
        self.hold(newest, "context")
        intent = intent.rename(columns={"us": "intent_us", "id": "intent_id"}).astype({"intent_us": "Int64"})
        changed = newest[newest["new"].astype(bool)].rename(columns={"us": "context_us", "id": "context_id"})
        out = pd.concat([total[total["key_text"].isin(pd.concat(touched))].merge(intent, "left", on="key_text"), changed.drop(columns="new")], ignore_index=True)
        whole = [c for c in out if c.endswith(("_us", "_id")) or c in ("messages", "callbacks")]
        words = out[["intent", "context_key", "context_value"]].astype(object)
        yield out.astype({c: "Int64" for c in whole}).assign(**{c: words[c].where(words[c].notna(), None) for c in words})
