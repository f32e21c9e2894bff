"""Run-over-run checks on a stream of runs' figures."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.validation import THRESHOLDS

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class RunChecks(StatefulProcessor):
    """State of a series: runs that the watermark has not passed yet, and the figures of the last that it has."""

    def __init__(self, key: str, limits: dict[str, float]):
        self.key, self.limits = key, limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        figures = ", ".join(f"{m} double" for m in self.limits)
        self.last = handle.getValueState("last", figures)
        self.waiting = handle.getMapState("waiting", "ts long", figures)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            for ts, *figures in part[["micros", *self.limits]].itertuples(index=False):
                self.waiting.updateValue((int(ts),), tuple(None if pd.isna(x) else float(x) for x in figures))
                self.handle.registerTimer(int(ts) // 1000)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Runs up to the timer's time, in order, each against the one before it."""
        upto = expiredTimerInfo.getExpiryTimeInMs()
        found = []
        for ts in sorted(k[0] for k in self.waiting.keys() if k[0] // 1000 <= upto):
            now = self.waiting.getValue((ts,))
            was = self.last.get()
            if was is not None:
                for (metric, most), x, y in zip(self.limits.items(), now, was, strict=True):
                    if x is not None and y and abs(x - y) / y > most:
                        found.append((key[0], ts, metric, abs(x - y) / y))
            self.last.update(tuple(now))
            self.waiting.removeKey((ts,))
        if found:
            yield pd.DataFrame(found, columns=[self.key, "micros", "metric", "change"])

    def close(self) -> None:
        pass


def run_checks(runs: DataFrame, key: str, ts: str, thresholds: dict[str, float] | None = None, late: str = "1 hour") -> DataFrame:
    """key, ts, metric, change of each figure that moved by more than its threshold since the run of the same series before (which was not
    null or 0): run_anomalies on a stream, for each series (key).

    A run is compared once the watermark, `late` behind the newest run, has passed it, with the one before it in time, in whatever order they
    came; a run that comes later than that is left out. Of runs of a series at the same time the last to come counts. Runs with null ts
    or key are left out. The state is one run a series, and those that wait.
    """
    spark = runs.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    limits = thresholds or THRESHOLDS
    kind = dict(runs.dtypes)[key]
    rows = runs.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(key, F.col(ts).cast("timestamp").alias("event_time"), *(F.col(m).cast("double").alias(m) for m in limits))
    rows = rows.withWatermark("event_time", late).withColumn("micros", F.unix_micros("event_time"))
    told = rows.groupBy(key).transformWithStateInPandas(RunChecks(key, limits), f"{key} {kind}, micros long, metric string, change double", "Append", "EventTime")
    return told.select(key, F.timestamp_micros("micros").alias(ts), "metric", "change")
