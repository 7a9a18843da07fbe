"""User-defined detectors and metrics."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import detectors


def register_detector(name: str, category: str, severity: tuple[float, float], fn: Callable[[Column], Column]) -> None:
    """Add a row detector: fn gives the severity column of a text column, null for no hit."""
    if not 0 <= severity[0] <= severity[1] <= 1:
        raise ValueError("severities lie between 0 and 1")
    detectors.ROW_DETECTORS[name], detectors.CATEGORY[name], detectors.SEVERITY[name] = fn, category, severity


def unregister_detector(name: str) -> None:
    for registry in (detectors.ROW_DETECTORS, detectors.CATEGORY, detectors.SEVERITY):
        registry.pop(name, None)


def stateful_detector(lines: DataFrame, name: str, new_state: Callable[[], object], step: Callable[[object, dict], float | None]) -> DataFrame:
    """Hits of a detector that sees the lines of a file in order and keeps a state for each file.

    Rows arrive sorted and in batches, so that no file is held as a whole.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        file, state = None, None
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                if row["file_id"] != file:
                    file, state = row["file_id"], new_state()
                severity = step(state, row)
                if severity is not None:
                    out.append((row["file_id"], row["line_no"], row["byte_start"], float(severity), name))
            yield pd.DataFrame(out, columns=["file_id", "line_no", "byte_start", "severity", "detector"])

    ordered = lines.select("file_id", "line_no", "byte_start", "line").repartition("file_id").sortWithinPartitions("file_id", "line_no")
    return ordered.mapInPandas(run, "file_id string, line_no long, byte_start long, severity double, detector string")


def line_metric(lines: DataFrame, name: str, fn: Callable[[pd.Series], pd.Series], returns: str = "double") -> DataFrame:
    """Add a metric of each line by a vectorised function."""
    return lines.withColumn(name, F.pandas_udf(fn, returns)(F.col("line")))


def file_metrics(lines: DataFrame, metrics: dict[str, Column]) -> DataFrame:
    """Aggregates of the user's own for each file."""
    return lines.groupBy("file_id").agg(*[c.alias(n) for n, c in metrics.items()])


