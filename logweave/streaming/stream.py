"""Structured Streaming variants of search and of two detectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.detectors import error_severity, timestamps, warning_severity
from ..operators.trace import identify_patterns, match_events, named


def read_text_stream(spark: SparkSession, path: str) -> DataFrame:
    """Lines of newly arriving files; a line's number in its file is not known in a stream."""
    raw = spark.readStream.option("lineSep", "\n").text(path)
    return raw.select(F.col("_metadata.file_path").alias("file_id"), F.lit(None).cast("long").alias("line_no"), F.lit(None).cast("long").alias("byte_start"), F.octet_length("value").alias("byte_len"), F.col("value").alias("line"))


def stream_trace(lines: DataFrame, patterns: list[str], flags: str = "") -> DataFrame:
    """Stateless search of a stream of lines."""
    return lines.withColumn("pattern_id", F.explode(identify_patterns(named(patterns, flags))))


def stream_match_sink(
    matches: DataFrame, handler: Callable[[DataFrame, int], None], max_per_batch: int, checkpoint: str, report: Callable[[int, int], None] | None = None
) -> StreamingQuery:
    """Hand the match_found records of each micro-batch to a handler: the first max_per_batch by file, place and pattern.

    report, if given, is called with the number of the batch and how many records are beyond the cap.
    """

    def deliver(batch: DataFrame, epoch: int) -> None:
        batch = batch.persist() if report else batch
        events = match_events(batch)
        handler(events.orderBy("file_id", "offset", "line_no", "pattern_id", "line_text").limit(max_per_batch), epoch)
        if report:
            report(epoch, max(events.count() - max_per_batch, 0))
            batch.unpersist()

    return matches.writeStream.foreachBatch(deliver).option("checkpointLocation", checkpoint).start()


def stream_keyword_counts(events: DataFrame, ts: str, line: str, window: str = "5 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Error and warning lines by window of event time; rows later than the watermark are dropped."""
    w = F.window(ts, window, slide) if slide else F.window(ts, window)
    c = F.col(line)
    counts = events.withWatermark(ts, late).groupBy(w.alias("w")).agg(F.count("*").alias("n"), F.count(error_severity(c)).alias("n_errors"), F.count(warning_severity(c)).alias("n_warnings"))
    return counts.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "n_errors", "n_warnings")


def stream_timestamp_gap(rows: DataFrame, least_gap: float = 300.0) -> DataFrame:
    """Gaps between the times of consecutive rows(file_id, ts) of a file, with the last time as state.

    Rows of a batch are put in order of time; a row older than the state counts as no gap.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ts = pd.concat([b["ts"] for b in batches]).sort_values()
        seconds = ts.astype("datetime64[us]").astype("int64") / 1e6
        last = state.get[0] if state.exists else None
        before = seconds.shift(1)
        if last is not None:
            before.iloc[0] = last
        gap = seconds - before
        hit = gap >= least_gap
        state.update((float(max(seconds.iloc[-1], last if last is not None else seconds.iloc[-1])),))
        severity = (0.3 + gap[hit] / 3600 * 0.5).clip(upper=0.8)
        yield pd.DataFrame({"file_id": key[0], "ts": ts[hit], "gap": gap[hit], "severity": severity})

    return rows.groupBy("file_id").applyInPandasWithState(step, "file_id string, ts timestamp, gap double, severity double", "last double", "append", GroupStateTimeout.NoTimeout)


def stream_line_gaps(lines: DataFrame, least_gap: float = 300.0, max_lines: int = 500, lock_after: int = 50, idle_ms: int | None = None) -> DataFrame:
    """Hits of ``detect_timestamp_gap`` over a stream of lines(file_id, line_no, byte_start, line), by the same rules.

    Timestamps are read by Spark's own functions; the state of a file is the count of each format, the format it is locked to, and the last
    timestamp with its line. Lines of a batch are put in order; a line that comes in a later batch than lines after it counts
    as the next one. With idle_ms a file that is silent for so many milliseconds
    loses its state; such a query runs batches without data too, so give it a trigger.
    """
    kinds = [f"ts{i}" for i in range(4)]
    rows = timestamps(lines.select("file_id", "line_no", "byte_start", "line")).select("file_id", "line_no", "byte_start", *kinds).where(F.coalesce(*kinds).isNotNull())

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        *counts, lock, fmt, ts, line = state.get if state.exists else (0, 0, 0, 0, -1, -1, 0.0, 0)
        out = []
        for row in pd.concat(list(batches)).sort_values("line_no").itertuples(index=False):
            readings = row[3:]
            now = lock if lock >= 0 else next(i for i, t in enumerate(readings) if pd.notna(t))
            if pd.isna(readings[now]):
                continue
            counts[now] += 1
            if lock < 0 and counts[now] >= lock_after:
                lock = now
            gap = abs(readings[now] - ts)
            gap = 86400 - gap if now == 3 and gap > 43200 else gap
            if now == fmt and row.line_no - line <= max_lines and gap >= least_gap:
                out.append((key[0], row.line_no, row.byte_start, round(min(0.3 + gap / 3600 * 0.5, 0.8), 6), "timestamp_gap"))
            fmt, ts, line = now, readings[now], row.line_no
        state.update((*counts, lock, fmt, float(ts), int(line)))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["file_id", "line_no", "byte_start", "severity", "detector"])

    kept = "c0 long, c1 long, c2 long, c3 long, lock int, fmt int, ts double, line long"
    hits = "file_id string, line_no long, byte_start long, severity double, detector string"
    return rows.groupBy("file_id").applyInPandasWithState(step, hits, kept, "append", GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout)
