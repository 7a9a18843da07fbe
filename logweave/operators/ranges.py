"""Merging of detector hits into ranges, ranking, limits and reports."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.chains import chain_starts
from ..functions.windows import BLOCK_LINES, running_sums, with_block
from .detectors import CATEGORY, ERRORS, SECRETS, SEVERITY, WARNINGS

#: Lower bound and label. The meanings are this library's own words.
SCALE = (
    (0.8, "critical", "the process or a secret is likely lost: look at once"),
    (0.6, "high", "something failed or stood still for long"),
    (0.4, "medium", "a warning, or lines of an unexpected kind"),
    (0.0, "low", "unusual, and likely harmless"),
)


#: Detectors whose descriptions take words or lengths from texts.
WORDED = ("traceback", "error_keyword", "warning_keyword", "high_entropy", "line_length_spike", "json_dump", "prefix_deviation")


def severity_label(severity: Column) -> Column:
    out = F.lit(SCALE[-1][1])
    for bound, label, _ in reversed(SCALE[:-1]):
        out = F.when(severity >= bound, label).otherwise(out)
    return out


def severity_scale(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SCALE), "min_severity double, label string, description string")


def detector_catalog(spark: SparkSession) -> DataFrame:
    rows = sorted((CATEGORY[n], n, *SEVERITY[n]) for n in CATEGORY)
    return spark.createDataFrame(rows, "category string, detector string, severity_min double, severity_max double")


def category_catalog(spark: SparkSession) -> DataFrame:
    return detector_catalog(spark).groupBy("category").agg(F.array_sort(F.collect_list("detector")).alias("detectors"))


def merge_ranges(hits: DataFrame, gap: int = 2, max_lines: int = 1000) -> DataFrame:
    """(file_id, detector, start_line, end_line, severity, n_hits): hits at most gap lines apart, in ranges of max_lines at most.

    Where a range may start rests on where the one before did; ``chain_starts`` finds that in blocks of lines, so that a file in which each line hits is
    many tasks and no hits are gathered. Hits are shuffled once for it, and pre-aggregated by the start of their range.
    """
    started = chain_starts(hits.select("file_id", "detector", "line_no", "severity"), ["file_id", "detector"], "line_no", max_lines, gap)
    ranges = started.groupBy("file_id", "detector", F.col("chain_start").alias("start_line"))
    return ranges.agg(F.max("line_no").alias("end_line"), F.max("severity").alias("severity"), F.count("*").alias("n_hits"))


def range_offsets(ranges: DataFrame, lines: DataFrame) -> DataFrame:
    """Add start_offset, of the first line, and end_offset, of the last byte of the last line, by two equi-joins."""
    at = lines.select("file_id", "line_no", "byte_start", "byte_len")
    first = at.select("file_id", F.col("line_no").alias("start_line"), F.col("byte_start").alias("start_offset"))
    last = at.select("file_id", F.col("line_no").alias("end_line"), (F.col("byte_start") + F.col("byte_len")).alias("end_offset"))
    return ranges.join(first, ["file_id", "start_line"]).join(last, ["file_id", "end_line"])


def _ranked(rows: DataFrame, line: str) -> DataFrame:
    """rows with __rank, from 1, in the order of severity, the highest first, line and detector within a file.

    What comes before is summed up by severity and block of lines; rows are ordered only inside these, so that a file is many tasks.
    """
    more = () if line == "line_no" else ("line_no",)
    rows = with_block(rows.withColumn("line_no", F.col(line)), BLOCK_LINES).withColumnRenamed("lblock", "__block").drop(*more)
    sizes = rows.groupBy("file_id", "severity", "__block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("file_id").orderBy(F.desc("severity"), "__block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(F.col("file_id").alias("s_file"), F.col("severity").alias("s_severity"), F.col("__block").alias("s_block"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("file_id", "severity", "__block").orderBy(line, "detector")
    on = F.col("file_id").eqNullSafe(F.col("s_file")) & F.col("severity").eqNullSafe(F.col("s_severity")) & F.col("__block").eqNullSafe(F.col("s_block"))
    placed = rows.withColumn("__rank", F.row_number().over(inside)).join(sizes, on)
    return placed.withColumn("__rank", F.col("__rank") + F.col("__before")).drop("s_file", "s_severity", "s_block", "__before", "__block")


def cap_hits(hits: DataFrame, k: int = 100_000) -> DataFrame:
    """The k most severe hits of each file; ties by line, then detector."""
    return _ranked(hits, "line_no").where(F.col("__rank") <= k).drop("__rank")


def density_cap(ranges: DataFrame, totals: DataFrame) -> DataFrame:
    """The most severe ranges of each file, as many as its totals(file_id, n_lines) allow; ties by start, then detector."""
    n = F.col("n_lines")
    most = F.greatest(F.lit(50), F.floor(n * 0.0001), F.floor(n * 0.05))
    return _ranked(ranges, "start_line").join(totals, "file_id").where(F.col("__rank") <= most).drop("__rank", "n_lines")


def describe(ranges: DataFrame, lines: DataFrame) -> DataFrame:
    """Add a description, from the first line of each range and its length; of JSON, from all its lines. The wordings are fixed values.

    The ranges are persisted, as they are read several times. Ranges whose wording takes nothing from a text do not meet the lines; the others and the lines of JSON read one exchange of these.
    """
    ranges = ranges.persist(StorageLevel.MEMORY_AND_DISK)
    first = lines.select(F.col("file_id").alias("ff"), F.col("line_no").alias("fl"), F.col("line").alias("first"))
    worded = F.coalesce(F.col("detector").isin(*WORDED), F.lit(False))
    rows = ranges.where(worded).join(first, (F.col("file_id") == F.col("ff")) & (F.col("start_line") == F.col("fl"))).drop("ff", "fl")
    inside = ranges.where(F.col("detector") == "json_dump").select("file_id", "start_line", F.explode(F.sequence("start_line", "end_line")).alias("line_no"))
    chars = inside.join(first, (F.col("file_id") == F.col("ff")) & (F.col("line_no") == F.col("fl"))).groupBy("file_id", "start_line").agg(F.sum(F.length("first")).alias("chars"))
    chars = chars.select(F.col("file_id").alias("cf"), F.col("start_line").alias("cs"), F.lit("json_dump").alias("cd"), "chars")
    rows = rows.join(chars, (F.col("file_id") == F.col("cf")) & (F.col("start_line") == F.col("cs")) & (F.col("detector") == F.col("cd")), "left").drop("cf", "cs", "cd")
    rows = rows.unionByName(ranges.where(~worded), allowMissingColumns=True)
    short = lambda k: F.concat(F.substring("first", 1, k), F.when(F.length("first") > k, "...").otherwise(""))
    f, n = F.trim("first"), F.col("end_line") - F.col("start_line") + 1

    def found(words, prefix: str, other: str) -> Column:
        out = None
        for p, _ in words:
            c, v = F.col("first").rlike(p), F.concat(F.lit(prefix), F.regexp_extract("first", p, 0))
            out = F.when(c, v) if out is None else out.when(c, v)
        return out.otherwise(other)

    trace = (
        F.when(f.contains("Traceback"), "Python traceback").when(f.contains("Exception in thread"), "Java exception").when(f.startswith("panic:"), "Go panic")
        .when(f.contains("panicked at"), "Rust panic").when(f.rlike("^(TypeError|ReferenceError|SyntaxError):"), "JavaScript error").otherwise(F.format_string("Stack trace (%d lines)", n))
    )
    secret = F.when(F.col("first").rlike("|".join(f"(?:{p})" for p in SECRETS)), "Potential secret in context").when(F.col("first").rlike(r"eyJ[A-Za-z0-9_-]+\.eyJ"), "JWT token detected").when(F.col("first").rlike("AKIA[0-9A-Z]{16}"), "AWS access key detected")
    for size, name in ((64, "SHA256"), (40, "SHA1"), (32, "MD5")):
        secret = secret.when(F.col("first").rlike(f"[a-fA-F0-9]{{{size}}}"), f"{name} hash detected")
    d = F.col("detector")
    text = (
        F.when(d == "traceback", trace).when(d == "error_keyword", found(ERRORS, "Error: ", "Error keyword detected")).when(d == "warning_keyword", found(WARNINGS, "Warning: ", "Warning keyword detected"))
        .when(d == "high_entropy", secret.otherwise("High-entropy string detected")).when(d == "line_length_spike", F.format_string("Unusually long line (%d chars)", F.length(F.regexp_replace("first", r"\s+$", ""))))
        .when(d == "indentation_block", F.format_string("Indented block (%d lines)", n)).when(d == "timestamp_gap", "Timestamp gap detected")
        .when(d == "json_dump", F.format_string("Embedded JSON (%d chars, %d lines)", F.coalesce("chars", F.length("first")), n)).when(d == "format_deviation", "Format deviation from dominant pattern")
        .when((d == "prefix_deviation") & (n == 1), F.concat(F.lit("Line doesn't match expected prefix format: "), short(60)))
        .when(d == "prefix_deviation", F.concat(F.format_string("Block of %d lines without expected prefix: ", n), short(40))).otherwise(F.format_string("%s (%d lines)", d, n))
    )
    return rows.withColumn("description", text).drop("first", "chars")


def anomaly_report(ranges: DataFrame) -> DataFrame:
    """Ranges with category and label, in the order of lines; the catalogue has one row per detector and is broadcast."""
    cat = F.broadcast(detector_catalog(ranges.sparkSession).select("detector", "category"))
    return ranges.join(cat, "detector", "left").withColumn("label", severity_label(F.col("severity"))).orderBy("file_id", "start_line", "detector")


def multiline_blocks(lines: DataFrame, start: Column, goes_on: Column) -> DataFrame:
    """(file_id, start_line, end_line, n_lines, block): each start line with the lines after it that continue it.

    Starts and breaks are counted by blocks of lines, so that a file is many tasks; a start and what continues it are the lines that have
    both counts alike. A line that is null, or for which a rule is, ends a block.
    """
    s = F.coalesce(start, F.lit(False))
    rows = lines.select("file_id", "line_no", "line", s.alias("s"), (s | F.coalesce(goes_on, F.lit(False))).alias("g"))
    rows = running_sums(rows, {"b": F.col("s").cast("int"), "stop": (~F.col("g")).cast("int")})
    text = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    blocks = rows.where((F.col("b") > 0) & F.col("g")).groupBy("file_id", "b", "stop").agg(F.bool_or("s").alias("s"), F.min("line_no").alias("start_line"), F.max("line_no").alias("end_line"), F.count("*").alias("n_lines"), text.alias("x"))
    return blocks.where("s").select("file_id", "start_line", "end_line", "n_lines", F.array_join(F.transform("x", lambda r: r["line"]), "\n").alias("block"))
