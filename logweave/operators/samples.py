"""Random access by line, byte offset and range: point, range and as-of look-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of a bucket by which offset look-ups are equi-joined.
BUCKET = 1 << 20
#: Lines of a bucket by which look-ups of lines are equi-joined.
LINES = 1 << 12


def _buckets(first: Column, last: Column, size: int) -> Column:
    return F.sequence(F.floor(first / size), F.floor(last / size))


def parse_spec(spec: Column) -> Column:
    """struct<start,end,status>: "100", "-5" and "100-200"; anything else, zero lines and reversed ranges are rejected."""
    single, span = F.regexp_extract(spec, r"^(-?\d+)$", 1), F.regexp_extract(spec, r"^(\d+)-(\d+)$", 1)
    end = F.regexp_extract(spec, r"^(\d+)-(\d+)$", 2)
    start_no, end_no = F.coalesce(single.try_cast("long"), span.try_cast("long")), end.try_cast("long")
    status = F.when((single == "") & (span == ""), "bad form").when((span != "") & (end_no < start_no), "reversed").when(start_no.isNull(), "bad form").otherwise("ok")
    return F.struct(F.when(status == "ok", start_no).alias("start"), F.when(status == "ok", end_no).alias("end"), status.alias("status"))


def resolve_negative(value: Column, total: Column, lines: bool = True) -> Column:
    """-k counts from the end: line total - k + 1, at least 1; byte total - k, at least 0."""
    back = F.greatest(total + value + 1, F.lit(1)) if lines else F.greatest(total + value, F.lit(0))
    return F.when(value < 0, back).otherwise(value)


def total_lines(lines: DataFrame) -> DataFrame:
    return lines.groupBy("file_id").agg(F.count("*").alias("n_lines"))


def sample_lines(lines: DataFrame, targets: DataFrame, before: int = 0, after: int = 0) -> DataFrame:
    """Context of each of targets(file_id, target); a target outside its file gives one row without a line, not found."""
    want = targets.select("file_id", "target", F.explode(F.sequence(F.greatest(F.col("target") - before, F.lit(1)), F.greatest(F.col("target") + after, F.lit(1)))).alias("line_no"))
    hit = lines.join(want, ["file_id", "line_no"]).select("file_id", "target", "line_no", "byte_start", "line")
    there = hit.where(F.col("line_no") == F.col("target")).select("file_id", "target").distinct()
    hit = hit.join(there, ["file_id", "target"], "left_semi").withColumn("found", F.lit(True))
    none = targets.select("file_id", "target").distinct().join(there, ["file_id", "target"], "left_anti")
    null = [F.lit(None).cast("long").alias("line_no"), F.lit(None).cast("long").alias("byte_start"), F.lit(None).cast("string").alias("line")]
    return hit.unionByName(none.select("file_id", "target", *null, F.lit(False).alias("found")))


def sample_line_ranges(lines: DataFrame, ranges: DataFrame) -> DataFrame:
    """Lines a..b of ranges(file_id, start, end), cut at the end of the file."""
    asked = ranges.withColumnRenamed("end", "stop").where(F.col("start") <= F.col("stop"))
    sizes = lines.groupBy("file_id").agg(F.max("line_no").alias("n_lines"))
    asked = asked.join(sizes, "file_id").where(F.col("start") <= F.col("n_lines"))
    asked = asked.withColumn("bucket", F.explode(_buckets(F.greatest("start", F.lit(1)), F.least("stop", "n_lines"), LINES)))
    joined = lines.withColumn("bucket", F.floor(F.col("line_no") / LINES)).join(asked, ["file_id", "bucket"]).where(F.col("line_no").between(F.col("start"), F.col("stop")))
    return joined.select("file_id", "start", F.col("stop").alias("end"), "line_no", "line")


def offset_to_line(lines: DataFrame, offsets: DataFrame) -> DataFrame:
    """The line of each of offsets(file_id, offset), -1 for none: an equi-join on buckets of bytes, then the exact test."""
    stop = F.col("byte_start") + F.col("byte_len")
    spread = lines.select("file_id", "line_no", "byte_start", "byte_len", F.explode(F.sequence(F.floor(F.col("byte_start") / BUCKET), F.floor(stop / BUCKET))).alias("bucket"))
    asked = offsets.select("file_id", "offset").distinct().withColumn("bucket", F.floor(F.col("offset") / BUCKET))
    hit = asked.join(spread, ["file_id", "bucket"]).where((F.col("byte_start") <= F.col("offset")) & (F.col("offset") <= stop)).select("file_id", "offset", "line_no")
    return offsets.join(hit, ["file_id", "offset"], "left").select("file_id", "offset", F.coalesce("line_no", F.lit(-1)).cast("long").alias("line_no"))


def sample_offsets(lines: DataFrame, offsets: DataFrame, before: int = 0, after: int = 0) -> DataFrame:
    """Context of the line that holds each byte; nothing for bytes outside the file."""
    at = offset_to_line(lines, offsets).where(F.col("line_no") > 0)
    want = at.select("file_id", "offset", F.explode(F.sequence(F.greatest(F.col("line_no") - before, F.lit(1)), F.col("line_no") + after)).alias("line_no"))
    return lines.join(want, ["file_id", "line_no"]).select("file_id", "offset", "line_no", "byte_start", "line")


def sample_byte_ranges(lines: DataFrame, ranges: DataFrame) -> DataFrame:
    """Lines that overlap [start, end]; nothing if either end is outside the file."""
    sizes = lines.groupBy("file_id").agg(F.max(F.col("byte_start") + F.col("byte_len") + 1).alias("size"))
    r = ranges.withColumnRenamed("end", "stop").join(sizes, "file_id").where((F.col("start") >= 0) & (F.col("stop") < F.col("size")) & (F.col("start") <= F.col("stop")))
    last = F.col("byte_start") + F.col("byte_len")
    spread = lines.withColumn("bucket", F.explode(_buckets(F.col("byte_start"), last, BUCKET)))
    r = r.withColumn("bucket", F.explode(_buckets(F.col("start"), F.col("stop"), BUCKET)))
    # Of the buckets that a line and a range share the first counts.
    once = F.col("bucket") == F.greatest(F.floor(F.col("byte_start") / BUCKET), F.floor(F.col("start") / BUCKET))
    hit = spread.join(r, ["file_id", "bucket"]).where(once & (F.col("byte_start") <= F.col("stop")) & (last >= F.col("start")))
    return hit.select("file_id", "start", F.col("stop").alias("end"), "line_no", "line")


def line_to_offset(lines: DataFrame, targets: DataFrame) -> DataFrame:
    """(file_id, target, start, end): bytes of each line, null outside the file."""
    info = lines.select("file_id", F.col("line_no").alias("target"), F.col("byte_start").alias("start"), (F.col("byte_start") + F.col("byte_len")).alias("end"))
    return targets.select("file_id", "target").join(info, ["file_id", "target"], "left")


def nearest_checkpoint(checkpoints: DataFrame, targets: DataFrame, by: str = "line_no") -> DataFrame:
    """As-of join: the last checkpoint at or before each target; the first one before all, (1, 0) without any.

    ``by`` is line_no or byte_offset. Checkpoints and targets meet in buckets of lines or bytes, where a window carries the checkpoint before and
    the one after; what lies in other buckets comes from one row per bucket. A null target has no row.
    """
    size = LINES if by == "line_no" else BUCKET
    marks = checkpoints.select("file_id", F.col(by).cast("long").alias("k"), F.struct("line_no", "byte_offset").alias("cp"), F.lit(None).cast("long").alias("target"))
    asked = targets.select("file_id", F.col("target").cast("long").alias("k"), F.lit(None).cast(marks.schema["cp"].dataType).alias("cp"), F.col("target").cast("long").alias("target"))
    rows = marks.unionByName(asked).where(F.col("k").isNotNull()).withColumn("bucket", F.floor(F.col("k") / size))
    at = F.when(F.col("target").isNull(), F.struct("k", "cp"))
    buckets = rows.groupBy("file_id", "bucket").agg(F.max(at).alias("hi"), F.min(at).alias("lo"))
    up, down = Window.partitionBy("file_id").orderBy("bucket"), Window.partitionBy("file_id").orderBy(F.desc("bucket"))
    earlier = Window.unboundedPreceding, -1
    far = buckets.select(
        F.col("file_id").alias("far_file"), F.col("bucket").alias("far_bucket"), F.last("hi.cp", True).over(up.rowsBetween(*earlier)).alias("far_last"),
        F.last("lo.cp", True).over(down.rowsBetween(*earlier)).alias("far_next"), F.min("lo").over(Window.partitionBy("file_id"))["cp"].alias("lowest"),
    )
    near = Window.partitionBy("file_id", "bucket")
    last = F.last("cp", True).over(near.orderBy("k", F.col("target").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    following = F.last("cp", True).over(near.orderBy(F.desc("k"), F.col("target").desc_nulls_last()).rowsBetween(*earlier))
    rows = rows.withColumns({"near_last": last, "near_next": following}).where(F.col("target").isNotNull())
    rows = rows.join(far, F.col("file_id").eqNullSafe(F.col("far_file")) & (F.col("bucket") == F.col("far_bucket")))
    before = F.coalesce("near_last", "far_last")
    rows = rows.select("file_id", "target", before.isNull().alias("before"), F.coalesce(before, F.col("lowest")).alias("cp0"), F.coalesce("near_next", "far_next").alias("cp1"))
    return rows.select("file_id", "target", F.coalesce("cp0.line_no", F.lit(1)).alias("line_no"), F.coalesce("cp0.byte_offset", F.lit(0)).alias("byte_offset"), F.when(~F.col("before"), F.col("cp1")).alias("next"), F.col("cp0").isNotNull().alias("found"))


def approx_offset_to_line(checkpoints: DataFrame, offsets: DataFrame) -> DataFrame:
    """Line of a byte by linear interpolation between checkpoints; -1 without any, clamped at the last."""
    at = nearest_checkpoint(checkpoints, offsets.select("file_id", F.col("offset").alias("target")), "byte_offset")
    span = F.col("next.byte_offset") - F.col("byte_offset")
    step = F.bround((F.col("target") - F.col("byte_offset")) / span * (F.col("next.line_no") - F.col("line_no")))
    line = F.when(~F.col("found"), F.lit(-1)).when(F.col("next").isNull() | (span <= 0), F.col("line_no")).otherwise(F.col("line_no") + F.greatest(step, F.lit(0)))
    return at.select("file_id", F.col("target").alias("offset"), line.cast("long").alias("line_no"))


def blocks_for_lines(blocks: DataFrame, targets: DataFrame) -> DataFrame:
    """(file_id, block_no, lines): the wanted lines of each block."""
    spread = blocks.withColumn("bucket", F.explode(_buckets(F.col("first_line"), F.col("last_line"), LINES)))
    hit = targets.withColumn("bucket", F.floor(F.col("target") / LINES)).join(spread, ["file_id", "bucket"]).where(F.col("target").between(F.col("first_line"), F.col("last_line")))
    return hit.groupBy("file_id", "block_no").agg(F.array_sort(F.collect_set("target")).alias("lines"))


def blocks_for_bytes(blocks: DataFrame, ranges: DataFrame) -> DataFrame:
    """Blocks that overlap [start, end); a point is a range of one byte."""
    sizes = blocks.groupBy("file_id").agg(F.max("end_offset").alias("size"))
    asked = ranges.withColumnRenamed("end", "stop").join(sizes, "file_id").where((F.col("stop") > F.col("start")) & (F.col("start") < F.col("size")) & (F.col("stop") > 0))
    first = F.greatest("start", F.lit(0))
    asked = asked.withColumns({"bucket": F.explode(_buckets(first, F.least("stop", "size") - 1, BUCKET))})
    spread = blocks.withColumn("bucket", F.explode(_buckets(F.col("start_offset"), F.col("end_offset") - 1, BUCKET)))
    once = F.col("bucket") == F.greatest(F.floor(F.col("start_offset") / BUCKET), F.floor(first / BUCKET))
    hit = asked.join(spread, ["file_id", "bucket"]).where(once & (F.col("start_offset") < F.col("stop")) & (F.col("end_offset") > F.col("start")))
    return hit.select("file_id", "start", F.col("stop").alias("end"), "block_no")
