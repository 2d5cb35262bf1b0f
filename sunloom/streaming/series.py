"""Streams: windowed means with late data, and gaps between neighbouring rows as state with event-time timers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: The state store that custom state with timers needs, as a session's setting.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def stream_means(rows: DataFrame, by: str, value: str, minutes: int = 30, late: str = "1 hour", ts: str = "ts") -> DataFrame:
    """by, ts (bin start), mean, n of a stream (ts TIMESTAMP): a bin is given once the watermark has passed it."""
    binned = rows.withWatermark(ts, late).groupBy(by, F.window(ts, f"{minutes} minutes").alias("w")).agg(F.avg(value).alias(value), F.count(value).alias("n"))
    return binned.select(by, F.col("w.start").alias("ts"), value, "n")


class Gaps(StatefulProcessor):
    """Per key: instants that the watermark has not passed, and the last one that it has.

    Rows wait until the watermark has passed them, as one between two of them may still come; then those passed are gone
    through in order. A timer at the latest instant that waits brings that about without further rows of the key. Without
    any row for ``forget`` milliseconds of event time, the key's state is dropped.
    """

    def __init__(self, by: str, ts: str, longer_minutes: float, forget: int):
        self._by, self._ts, self._longer, self._forget = by, ts, longer_minutes * 60e6, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._last = handle.getValueState("last", "us long")
        self._waiting = handle.getMapState("waiting", "us long", "n int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        latest = None
        for batch in rows:
            for us in batch[self._ts].dropna().astype("datetime64[us]").astype("int64").unique().tolist():
                self._waiting.updateValue((us,), (1,))
                latest = us if latest is None else max(latest, us)
        yield self._passed(key, timerValues)
        if latest is not None:
            self._handle.registerTimer(latest // 1000 + 1)
            self._handle.registerTimer(latest // 1000 + 1 + self._forget)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._passed(key, timerValues)
        last = self._last.get()[0] if self._last.exists() else None
        if last is not None and last // 1000 + self._forget < timerValues.getCurrentWatermarkInMs() and not any(True for _ in self._waiting.keys()):
            self._last.clear()

    def _passed(self, key, timerValues) -> pd.DataFrame:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        last, found = self._last.get()[0] if self._last.exists() else None, []
        for us in sorted(k[0] for k in self._waiting.keys() if k[0] < mark):
            if last is not None and us - last > self._longer:
                found.append((key[0], pd.Timestamp(last, unit="us"), pd.Timestamp(us, unit="us"), (us - last) / 60e6))
            last = us if last is None else max(last, us)
            self._waiting.removeKey((us,))
        if last is not None:
            self._last.update((last,))
        return pd.DataFrame(found, columns=[self._by, "after", "until", "minutes"])

    def close(self) -> None:
        pass


def stream_gaps(rows: DataFrame, by: str, longer_minutes: float, ts: str = "ts", late: str = "1 hour", forget_minutes: float = 60 * 24 * 30) -> DataFrame:
    """by, after, until, minutes: neighbouring rows of a stream further apart than longer_minutes, as gaps() has them.

    Rows may come in any order and batch, as much as ``late`` behind the latest: a gap is told once the watermark has
    passed its end, so no row can fall into it. Rows that come later still are left out. Gaps longer than forget_minutes may
    go untold. The session keeps state in STORE.
    """
    schema = f"{by} {dict(rows.dtypes)[by]}, after timestamp, until timestamp, minutes double"
    processor = Gaps(by, ts, longer_minutes, int(forget_minutes * 60_000))
    return rows.filter(F.col(ts).isNotNull()).select(by, ts).withWatermark(ts, late).groupBy(by).transformWithStateInPandas(processor, schema, outputMode="Append", timeMode="EventTime")
