"""Gaps and ranges of streams by event time: rows that come late but inside the watermark are put in order first."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

GAPS = "file_id string, ts timestamp, gap double, severity double"


def timestamp_gaps(rows: DataFrame, least_gap: float = 300.0) -> DataFrame:
    """(file_id, ts, gap, severity): gaps of least_gap seconds or more between the consecutive times of a file's rows(file_id, ts); a batch."""
    before = F.lag("ts").over(Window.partitionBy("file_id").orderBy("ts"))
    gap = (F.unix_micros("ts") - F.unix_micros(before)) / 1e6
    found = rows.where(F.col("ts").isNotNull()).select("file_id", "ts", gap.alias("gap")).where(F.col("gap") >= least_gap)
    return found.withColumn("severity", F.least(0.3 + F.col("gap") / 3600 * 0.5, F.lit(0.8)))


class _OrderedGaps(StatefulProcessor):
    """Times wait in state until the watermark has passed them, and are then gone through in order; a silent file's state is deleted."""

    def __init__(self, least_gap: float, idle_ms: int) -> None:
        self.least_gap, self.idle_ms = least_gap, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "us long", "n long")
        self.last = handle.getValueState("last", "us long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        latest = None
        for part in rows:
            times = part["ts"].dropna().astype("datetime64[us]").astype("int64").unique()
            for us in times.tolist():
                self.waiting.updateValue((us,), (1,))
                latest = us if latest is None else max(latest, us)
        if latest is not None:
            self.handle.registerTimer(latest // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        passed = sorted(us for (us,) in self.waiting.keys() if us < mark)
        last = self.last.get()[0] if self.last.exists() else None
        out = []
        for us in passed:
            gap = (us - last) / 1e6 if last is not None else 0.0
            if last is not None and gap >= self.least_gap:
                out.append((key[0], pd.Timestamp(us, unit="us"), gap, min(0.3 + gap / 3600 * 0.5, 0.8)))
            last = us
            self.waiting.removeKey((us,))
        if passed:
            self.last.update((last,))
            self.handle.registerTimer(last // 1000 + self.idle_ms)
        elif last is not None and last // 1000 + self.idle_ms <= expiredTimerInfo.getExpiryTimeInMs() and not self.waiting.exists():
            self.last.clear()
        if out:
            yield pd.DataFrame(out, columns=["file_id", "ts", "gap", "severity"])

    def close(self) -> None:
        pass


def stream_ordered_gaps(rows: DataFrame, least_gap: float = 300.0, late: str = "10 minutes", idle_ms: int = 86_400_000) -> DataFrame:
    """``timestamp_gaps`` over a stream of rows(file_id, ts), whatever order they come in, as long as none is later than the watermark.

    A gap is reported once the watermark has passed its end. State is the times that the watermark has not passed, and one number a file, which goes when the watermark is
    idle_ms beyond the file's last time: a longer gap is not reported. Rows without a time are left out. Needs the RocksDB state store
    (spark.sql.streaming.stateStore.providerClass) and a file_id that is text.
    """
    timed = rows.select("file_id", "ts").withWatermark("ts", late)
    return timed.groupBy("file_id").transformWithStateInPandas(_OrderedGaps(least_gap, idle_ms), GAPS, "Append", "EventTime")


def hit_sessions(hits: DataFrame, gap: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """(file_id, detector, start, end, first_line, last_line, severity, n_hits): hits(file_id, detector, ts, line_no, severity) at most gap apart in time as one range.

    The same on a table and, in append mode, on a stream, where a range is closed and reported once the watermark has passed its end. Partial ranges are
    merged before the shuffle. Hits without a time are left out; end is the time of the last hit.
    """
    kept = hits.where(F.col("ts").isNotNull()).withWatermark("ts", late)
    ranges = kept.groupBy("file_id", "detector", F.session_window("ts", gap).alias("w")).agg(
        F.min("ts").alias("start"), F.max("ts").alias("end"), F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"), F.max("severity").alias("severity"), F.count("*").alias("n_hits")
    )
    return ranges.select("file_id", "detector", "start", "end", "first_line", "last_line", "severity", "n_hits")
