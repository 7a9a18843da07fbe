"""The canonical lines table: one row per line of a file, with exact number and byte offset.

lines(file_id string, line_no long, byte_start long, byte_len int, line string). A line ends at a line feed only; a carriage return
is content.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .files import UNREAD, compression_of

COLUMNS = ("file_id", "line_no", "byte_start", "byte_len", "line")
#: Text cut into lines at once, in bytes; a longer text is cut alone.
CUT_BYTES = 4 << 20


def read_lines(spark: SparkSession, paths: str | list[str], recursive: bool = True, blocks: bool = False) -> DataFrame:
    """Text files, plain or gzip or bzip2, as lines; offsets are in the decompressed text. Files in other compressions are left out (``unread_files``).

    Files are split and read in parallel. Counts and bytes of each split are summed first; their prefix sums, one
    row per split, number the lines without a sort over a whole file.
    """
    reader = spark.read.option("lineSep", "\n").option("recursiveFileLookup", str(recursive).lower())
    readable = ~F.coalesce(compression_of(F.col("_metadata.file_path")).isin(*UNREAD), F.lit(False))
    raw = reader.text(paths).where(readable).select(
        F.col("_metadata.file_path").alias("file_id"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), F.octet_length("value").alias("byte_len"), F.col("value").alias("line"),
    )
    return _numbered(raw, ["at"], *(["block"] if blocks else []))


def _numbered(raw: DataFrame, order: list[str], *more: str) -> DataFrame:
    """raw(file_id, block, byte_len, line, ...) as lines: a window inside each block, and prefix sums over one row per block."""
    # One key that is never null, so that the window and the join share one exchange of the texts.
    raw = raw.withColumn("key", F.struct("file_id", "block")).drop("file_id", "block")
    totals = raw.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.col("byte_len").cast("long") + 1).alias("bytes"))
    before = Window.partitionBy("key.file_id").orderBy("key.block").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(F.col("key").alias("c_key"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("b0"))
    inside = Window.partitionBy("key").orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = raw.withColumns({"k": F.row_number().over(inside), "b": F.coalesce(F.sum(F.col("byte_len").cast("long") + 1).over(upto), F.lit(0))})
    joined = numbered.join(carry, F.col("key") == F.col("c_key"))
    out = joined.withColumns({"file_id": F.col("key.file_id"), "block": F.col("key.block"), "line_no": F.col("n0") + F.col("k"), "byte_start": F.col("b0") + F.col("b") - F.coalesce(F.col("byte_len") + 1, F.lit(0))})
    return out.select(*COLUMNS, *more)


def lines_from_column(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Each row's text as a file of its own; a null text has no lines, and a final line feed opens no further line."""
    rows = df.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("string").alias("file_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            offs = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
            raw = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
            start = 0
            while start < len(texts):
                stop = min(max(int(np.searchsorted(offs, offs[start] + CUT_BYTES, "right")) - 1, start + 1), len(texts))
                yield cut_lines(batch.column(0).slice(start, stop - start), raw[offs[start] : offs[stop]], offs[start : stop + 1] - offs[start])
                start = stop

    return rows.mapInArrow(run, "file_id string, line_no long, byte_start long, byte_len int, line string")


def cut_lines(ids: pa.Array, raw: np.ndarray, offs: np.ndarray) -> pa.RecordBatch:
    """Lines of the texts raw[offs[i]:offs[i + 1]], found in one pass over the bytes: all lines of a text lie in one row, so that offsets need no shuffle."""
    feeds = np.flatnonzero(raw == 10)
    full = np.flatnonzero(np.diff(offs) > 0)
    open_ended = full[raw[offs[full + 1] - 1] != 10]
    end = np.concatenate([feeds, offs[open_ended + 1]])
    row = np.concatenate([np.searchsorted(offs, feeds, "right") - 1, open_ended])
    order = np.lexsort((end, row))
    end, row = end[order], row[order]
    new = np.ones(len(row), bool)
    new[1:] = row[1:] != row[:-1]
    first = np.flatnonzero(new)
    begin = np.where(new, offs[row], np.append(0, end[:-1] + 1)[: len(row)])
    number = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row)))) + 1
    width = end - begin
    at = np.concatenate([[0], np.cumsum(width)]).astype(np.int32)
    line = pa.StringArray.from_buffers(len(row), pa.py_buffer(at.tobytes()), pa.py_buffer(raw[raw != 10].tobytes()))
    arrays = [ids.take(pa.array(row)), pa.array(number.astype(np.int64)), pa.array((begin - offs[row]).astype(np.int64)), pa.array(width.astype(np.int32)), line]
    return pa.RecordBatch.from_arrays(arrays, list(COLUMNS))


def lines_from_rows(df: DataFrame, file_expr: Column, order_cols: list, line_expr: Column, block_expr: Column | None = None, more: dict[str, Column] | None = None) -> DataFrame:
    """Rows rendered as log lines, numbered within a file in the given order.

    block_expr, if given, never falls along that order and cuts a file into blocks, such as the hours of a log: each block is
    numbered by itself, so that a file of any length is many tasks. Without it a file is one block. A null line has no bytes and is numbered.
    more are further columns, of the line: made before it is dealt, so that a query which needs these alone does not shuffle texts.
    """
    named = [(F.col(c) if isinstance(c, str) else c).alias(f"o{i}") for i, c in enumerate(order_cols)]
    block = F.lit(0) if block_expr is None else block_expr
    rows = df.select(file_expr.cast("string").alias("file_id"), line_expr.alias("line"), block.alias("block"), *named)
    rows = rows.withColumns({"byte_len": F.octet_length("line"), **(more or {})})
    return _numbered(rows, [f"o{i}" for i in range(len(named))], *(more or {}))


def text(line: Column | str = "line") -> Column:
    """A line without its trailing carriage returns."""
    return F.regexp_replace(F.col(line) if isinstance(line, str) else line, r"\r+$", "")


def byte_end() -> Column:
    return F.col("byte_start") + F.col("byte_len") + 1
