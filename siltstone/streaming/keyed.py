"""Ordered folds over streams: a key's rows of a trigger in order, a small state from trigger to trigger.

The twin of ``operators.folds.ordered_fold`` on Spark's state API. Rows of a key come in Arrow batches; if there is more than one, they are put
into the state store by ranges of the order column, and the ranges are then folded one after the other, so a key with any number of rows in a trigger needs one batch and
one range in memory. What a key keeps is one small value, which goes by a timer of event time.

Cases: rows with a null key form a key of their own; rows with a null order value come first; of equal order values those with the smaller tie-breaker come first.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from siltstone.operators.folds import Health, Quota
from siltstone.shipping import ship

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """The state API needs a store with column families; streams that run already keep theirs."""
    if "RocksDB" not in spark.conf.get(PROVIDER, ""):
        spark.conf.set(PROVIDER, ROCKSDB)


class KeyedFold(StatefulProcessor):
    """A fold with feedback; subclasses say what the state is and what a sorted frame of rows makes of it."""

    order: list[str]  # the first is a whole number, of which ``width`` make a range
    width: int
    rows: str  # the columns that a fold uses, as DDL, in the order of ``columns``
    columns: list[str]
    state: str
    time: str | None = None  # the column of event time in ms by which a state expires

    def fresh(self, kept: tuple | None) -> Any:
        raise NotImplementedError

    def kept(self, state: Any) -> tuple:
        raise NotImplementedError

    def fold(self, state: Any, frame: pd.DataFrame) -> pd.DataFrame:
        """Output rows, without the key, of rows in order."""
        raise NotImplementedError

    def expires(self, last: int) -> int:
        """The event time from which a state that was last used at ``last`` no longer matters."""
        raise NotImplementedError

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("fold", self.state)
        arrays = ", ".join(f"{c} array<{kind}>" for c, kind in (x.split() for x in self.rows.split(", ")))
        self.waiting = handle.getMapState("waiting", "range long, part long", arrays)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = self.fresh(self.value.get() if self.value.exists() else None)
        last = None
        for frame in self._ordered(rows):
            out = self.fold(state, frame)
            if self.time and not frame[self.time].isna().all():
                last = max(int(frame[self.time].max()), 0 if last is None else last)
            out.insert(0, "key", [key[0]] * len(out))
            yield out
        self.value.update(self.kept(state))
        if last is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(max(self.expires(last), timerValues.getCurrentWatermarkInMs() + 1))

    def _ordered(self, rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The frames of a trigger as frames in order."""
        first, parts = next(rows)[self.columns], {}
        following = next(rows, None)
        if following is None:
            yield first.sort_values(self.order)
            return
        for frame in self._chain(first, following, rows):
            for at, own in frame.groupby(frame[self.order[0]] // self.width):
                n = parts.get(int(at), 0)
                self.waiting.updateValue((int(at), n), tuple(own[c].tolist() for c in self.columns))
                parts[int(at)] = n + 1
        for at in sorted(parts):
            held = [self.waiting.getValue((at, n)) for n in range(parts[at])]
            for n in range(parts[at]):
                self.waiting.removeKey((at, n))
            frame = pd.concat([pd.DataFrame(dict(zip(self.columns, (list(c) for c in h)))) for h in held])
            yield frame.sort_values(self.order)

    def _chain(self, first: pd.DataFrame, following: pd.DataFrame, rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield first
        yield following[self.columns]
        for frame in rows:
            yield frame[self.columns]

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.value.clear()
        return iter([])

    def close(self) -> None:
        pass


class QuotaFold(KeyedFold):
    order, columns, rows = ["at_ms", "request_id"], ["request_id", "at_ms", "seeds"], "request_id bigint, at_ms bigint, seeds bigint"
    state, time = "at array<bigint>, n array<bigint>", "at_ms"

    def __init__(self, limit: int, window_ms: int) -> None:
        self.limit, self.window_ms, self.width = limit, window_ms, window_ms

    def fresh(self, kept: tuple | None) -> Quota:
        at, n = kept if kept else ([], [])
        return Quota(list(zip(at, n, strict=True)), 0, int(sum(n)))

    def kept(self, state: Quota) -> tuple:
        open_ = state.admitted[state.head :]
        return [int(a) for a, _ in open_], [int(k) for _, k in open_]

    def fold(self, state: Quota, frame: pd.DataFrame) -> pd.DataFrame:
        made = [state.ask(int(at), int(n), self.limit, self.window_ms) for at, n in zip(frame["at_ms"], frame["seeds"])]
        return pd.DataFrame({"request_id": frame["request_id"].to_numpy(), "ok": [m["ok"] for m in made], "used": [m["used"] for m in made]})

    def expires(self, last: int) -> int:
        return last + self.window_ms


class HealthFold(KeyedFold):
    order, state, width = ["seq"], "recent array<boolean>, streak int, demotion int", 100_000

    def __init__(self, forget_ms: int | None) -> None:
        self.forget_ms, self.time = forget_ms, None if forget_ms is None else "at_ms"
        self.columns = ["seq", "outcome"] + ([] if forget_ms is None else ["at_ms"])
        self.rows = "seq bigint, outcome string" + ("" if forget_ms is None else ", at_ms bigint")

    def fresh(self, kept: tuple | None) -> Health:
        return Health([bool(x) for x in kept[0]], int(kept[1]), int(kept[2])) if kept else Health()

    def kept(self, state: Health) -> tuple:
        return list(state.recent), state.streak, state.demotion

    def fold(self, state: Health, frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"seq": frame["seq"].to_numpy(), "demotion": [state.record(o) for o in frame["outcome"]]})

    def expires(self, last: int) -> int:
        return last + self.forget_ms


def keyed_fold(stream: DataFrame, key: str, processor: KeyedFold, output: str) -> DataFrame:
    """The rows that a fold makes of a stream, key by key; the key is the first column of ``output``."""
    ship(stream.sparkSession)
    use_rocksdb(stream.sparkSession)
    renamed = output.split()[0]
    mode = "EventTime" if processor.time else "None"
    made = stream.groupBy(key).transformWithStateInPandas(processor, outputStructType="key" + output[len(renamed) :], outputMode="append", timeMode=mode)
    return made.withColumnRenamed("key", renamed)
