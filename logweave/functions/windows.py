"""Ordered computations over long files in blocks of lines, so that a file is not one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_LINES = 65_536


def with_block(lines: DataFrame, size: int = BLOCK_LINES) -> DataFrame:
    return lines.withColumn("lblock", F.floor((F.col("line_no") - 1) / size).cast("long"))


def running_sums(lines: DataFrame, sums: dict[str, Column], keys: tuple[str, ...] = ("file_id",)) -> DataFrame:
    """Add sums over all earlier lines of the keys and the line itself: a window inside each block, plus the totals of the blocks before."""
    lines = lines if "lblock" in lines.columns else with_block(lines)
    columns = lines.columns
    # One key that is never null: the window and the join share its exchange, which they do not with a null-safe equality of each key.
    lines = lines.withColumns({"__key": F.struct(*keys, "lblock"), **{f"x_{n}": c for n, c in sums.items()}})
    totals = lines.groupBy("__key").agg(*[F.sum(f"x_{n}").alias(f"t_{n}") for n in sums])
    before = Window.partitionBy(*[f"__key.{k}" for k in keys]).orderBy("__key.lblock").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(F.col("__key").alias("__carry"), *[F.coalesce(F.sum(f"t_{n}").over(before), F.lit(0)).alias(f"p_{n}") for n in sums])
    inside = Window.partitionBy("__key").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = lines.withColumns({n: F.sum(f"x_{n}").over(inside) for n in sums}).join(carry, F.col("__key") == F.col("__carry"))
    return rows.withColumns({n: F.col(n) + F.col(f"p_{n}") for n in sums}).select(*columns, *sums)


def with_halo(lines: DataFrame, k: int, size: int = BLOCK_LINES) -> DataFrame:
    """Copy the last k lines of each block to the next one, marked halo; windows over (file_id, lblock) then see k lines back."""
    lines = with_block(lines, size)
    # Dealt by one scan: a union would read the lines, and shuffle what they are made of, twice.
    own, next_ = F.struct("lblock", F.lit(False).alias("halo")), F.struct((F.col("lblock") + 1).alias("lblock"), F.lit(True).alias("halo"))
    at = F.when((F.col("line_no") - 1) % size >= size - k, F.array(own, next_)).otherwise(F.array(own))
    return lines.withColumn("__at", F.explode(at)).withColumns({"lblock": F.col("__at.lblock"), "halo": F.col("__at.halo")}).drop("__at")


def in_block() -> object:
    return Window.partitionBy("file_id", "lblock").orderBy("line_no")
