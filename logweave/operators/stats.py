"""Line statistics, checkpoints, blocks and profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.chains import chain_starts
from ..functions.windows import with_block
from ..sources.files import parent
from ..sources.lines import byte_end, text

STEP = 1 << 20
#: Leading bits of the hash by which a sample of lines is counted.
SAMPLE_BITS = 12


def blank(line: Column) -> Column:
    return F.regexp_like(line, F.lit(r"^\s*$"))


def line_stats(lines: DataFrame, unit: str = "bytes", std: str = "sample") -> DataFrame:
    """Lines, blank lines, and length statistics of the lines that are not blank: one aggregation, exact percentiles."""
    aggs, columns = _stats(unit, std)
    return lines.groupBy("file_id").agg(*aggs).select("file_id", *columns)


def _stats(unit: str, std: str) -> tuple[list[Column], list[Column]]:
    n = F.octet_length(text()) if unit == "bytes" else F.length(text())
    n = F.when(~blank(F.col("line")), n)
    spread = F.stddev_samp(n) if std == "sample" else F.stddev_pop(n)
    spread = F.when(F.count(n) > 1, spread).when(F.count(n) == 1, F.lit(0.0))
    # One buffer of lengths serves all percentiles.
    at = F.percentile(n, F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    aggs = [F.count("*").alias("n_lines"), F.count_if(blank(F.col("line"))).alias("n_empty"), F.max(n).alias("max_len"), F.avg(n).alias("avg_len"), at.alias("at"), spread.alias("std_len")]
    return aggs, [F.col(c) for c in ("n_lines", "n_empty", "max_len", "avg_len")] + [F.get("at", F.lit(i)).alias(f"{c}_len") for i, c in enumerate(("median", "p95", "p99"))] + [F.col("std_len")]


def line_stats_all(lines: DataFrame) -> DataFrame:
    """Statistics that include empty lines, with nearest-rank percentiles, to one decimal."""
    counts = lines.groupBy("file_id", F.length(text()).alias("n")).agg(F.count("*").alias("c"))
    # Windows run over distinct lengths only.
    upto = F.sum("c").over(Window.partitionBy("file_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.withColumns({"upto": upto, "all": F.sum("c").over(Window.partitionBy("file_id"))})
    at = lambda p: F.min(F.when(F.col("upto") > F.least(F.floor(F.col("all") * p), F.col("all") - 1), F.col("n")))
    return ranked.groupBy("file_id").agg(
        F.sum("c").alias("n_lines"), F.coalesce(F.sum(F.when(F.col("n") == 0, F.col("c"))), F.lit(0)).alias("n_empty"), F.max("n").alias("max_len"), F.round(F.sum(F.col("n") * F.col("c")) / F.sum("c"), 1).alias("avg_len"),
        F.round(F.percentile("n", F.lit(0.5), F.col("c")), 1).alias("median_len"), at(0.95).alias("p95_len"), at(0.99).alias("p99_len"),
    )


def longest_line(lines: DataFrame) -> DataFrame:
    """Number, offset and length of the first longest line that is not blank."""
    kept = lines.where(~blank(F.col("line"))).groupBy("file_id").agg(_longest().alias("x"))
    return kept.select("file_id", "x.line_no", "x.byte_start", "x.len")


def _longest() -> Column:
    n = F.length(text())
    key = F.when(~blank(F.col("line")), F.struct(n, -F.col("line_no")))
    return F.max_by(F.struct("line_no", "byte_start", n.alias("len")), key)


def line_ending(lines: DataFrame, first_bytes: int | None = None) -> DataFrame:
    """LF, CRLF, CR or mixed, by all lines or those that start in the first bytes."""
    kept = lines if first_bytes is None else lines.where(F.col("byte_start") < first_bytes)
    return kept.groupBy("file_id").agg(*_ending_kinds()).select("file_id", _ending())


def _ending_kinds() -> list[Column]:
    crlf = F.col("line").endswith("\r")
    # The last line may lack its line feed and tells nothing.
    plain = F.count_if(~crlf) - (~F.max_by(crlf, "line_no")).cast("int")
    return [F.bool_or(crlf).alias("crlf"), (plain > 0).alias("lf"), F.bool_or(F.regexp_like("line", F.lit(r"\r[^\r]"))).alias("cr")]


def _ending() -> Column:
    kinds = F.col("crlf").cast("int") + F.col("lf").cast("int") + F.col("cr").cast("int")
    return F.when(kinds > 1, "mixed").when(F.col("crlf"), "CRLF").when(F.col("cr"), "CR").otherwise("LF").alias("line_ending")


def line_length_sample(lines: DataFrame, n: int | None = 1_000_000) -> DataFrame:
    """Percentiles from at most n lines of a file, a uniform and repeatable choice by a hash of the line number; with n of None from all lines.

    Lines are counted by ranges of the hash; those of ranges below the bound are taken whole, and only the range that meets it is ordered. Percentiles
    are of counts by length, so that no file is one task.
    """
    kept = lines.where(~blank(F.col("line"))).select("file_id", F.length(text()).alias("n"), *([] if n is None else ["line_no", F.xxhash64("file_id", "line_no").alias("h")]))
    if n is not None:
        kept = _fewest(kept.withColumn("cell", F.shiftright("h", 64 - SAMPLE_BITS)), n)
    counts = kept.groupBy("file_id", "n").agg(F.count("*").alias("c"))
    at = counts.groupBy("file_id").agg(F.percentile("n", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)), F.col("c")).alias("at"))
    return at.select("file_id", *[F.col("at")[i].alias(f"{c}_len") for i, c in enumerate(("median", "p95", "p99"))])


def _fewest(rows: DataFrame, n: int) -> DataFrame:
    """The n rows of each file that are first by (h, line_no), or all."""
    cells = rows.groupBy(F.col("file_id").alias("c_file"), F.col("cell").alias("c_cell")).agg(F.count("*").alias("held"))
    upto = F.sum("held").over(Window.partitionBy("c_file").orderBy("c_cell").rowsBetween(Window.unboundedPreceding, 0))
    cells = cells.withColumn("upto", upto).withColumn("free", n - F.col("upto") + F.col("held")).where(F.col("free") > 0)
    met = rows.join(cells, F.col("file_id").eqNullSafe(F.col("c_file")) & (F.col("cell") == F.col("c_cell")))
    rank = F.row_number().over(Window.partitionBy("file_id", "cell").orderBy("h", "line_no"))
    cut = met.where(F.col("upto") > n).withColumn("r", rank).where(F.col("r") <= F.col("free")).select("file_id", "n")
    return met.where(F.col("upto") <= n).select("file_id", "n").unionByName(cut)


def length_sketches(lines: DataFrame, unit: str = "chars", k: int = 800) -> DataFrame:
    """(file_id, lblock, n, sketch): a KLL sketch of the lengths of a block's lines that are not blank; blocks without such lines have none.

    Store these beside the lines: ``sketch_percentiles`` merges those of any files, so that a file that has grown adds blocks and nothing is read again.
    A task sends one small row a block. The rank of a percentile is off by about 1.3 / k ** 0.9 at most, in 99 of 100 cases; up to k lines it is exact.
    """
    n = (F.octet_length(text()) if unit == "bytes" else F.length(text())).cast("long")
    kept = with_block(lines).where(~blank(F.col("line"))).select("file_id", "lblock", n.alias("n"))
    return kept.groupBy("file_id", "lblock").agg(F.count("*").alias("n"), F.kll_sketch_agg_bigint("n", k).alias("sketch"))


def sketch_percentiles(sketches: DataFrame, by: list[str], at: tuple[float, ...] = (0.5, 0.95, 0.99), k: int = 800) -> DataFrame:
    """(by.., n_lines, then one column a percentile, such as p95_len): from merged ``length_sketches``; with no column to group by, of all."""
    merged = sketches.groupBy(*by).agg(F.sum("n").alias("n_lines"), F.kll_merge_agg_bigint("sketch", k).alias("sketch"))
    quantile = lambda p: F.when(F.col("n_lines") > 0, F.kll_sketch_get_quantile_bigint("sketch", F.lit(p))).alias(f"p{p * 100:g}_len")
    return merged.select(*by, "n_lines", *[quantile(p) for p in at])


def checkpoints(lines: DataFrame, step: int = STEP) -> DataFrame:
    """(file_id, line_no, byte_offset): the first line that starts in each step of bytes; found in parallel."""
    first = F.min_by(F.struct("line_no", "byte_start"), "byte_start")
    return lines.groupBy("file_id", F.floor(F.col("byte_start") / step).alias("cell")).agg(first.alias("x")).select("file_id", "x.line_no", F.col("x.byte_start").alias("byte_offset"))


def checkpoint_chain(lines: DataFrame, step: int = STEP) -> DataFrame:
    """(file_id, line_no, byte_offset): the first line, then each first line that starts step bytes or more after the one before.

    Each choice rests on the one before; ``chain_starts`` makes them in blocks of bytes, so that a file is many tasks.
    An entry behind the last line is left out.
    """
    kept = chain_starts(lines.select("file_id", "line_no", "byte_start"), ["file_id"], "byte_start", step, opening=True)
    return kept.select("file_id", "line_no", F.col("byte_start").alias("byte_offset"))


def checkpoints_every(lines: DataFrame, n: int = 1000) -> DataFrame:
    return lines.where((F.col("line_no") - 1) % n == 0).select("file_id", "line_no", F.col("byte_start").alias("byte_offset"))


def block_map(lines: DataFrame, block_bytes: int = 4 << 20) -> DataFrame:
    """First and last line, offsets and line count of each block of bytes."""
    return lines.groupBy("file_id", F.floor(F.col("byte_start") / block_bytes).alias("block_no")).agg(
        F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"), F.min("byte_start").alias("start_offset"), F.max(byte_end()).alias("end_offset"), F.count("*").alias("n_lines")
    )


def compression_ratio(lines: DataFrame, files: DataFrame) -> DataFrame:
    """Decompressed bytes by stored bytes; files(file_id, size_bytes)."""
    sizes = lines.groupBy("file_id").agg(F.sum(F.col("byte_len") + 1).alias("bytes"))
    return sizes.join(files, "file_id").select("file_id", (F.col("bytes") / F.col("size_bytes")).alias("ratio"))


def human_size(n: Column) -> Column:
    units = ["B", "KB", "MB", "GB", "TB", "PB"]
    shown = lambda i: F.format_string(f"%.2f {units[i]}", F.bround(n / float(1024**i), 2))
    out = shown(len(units) - 1)
    for i in range(len(units) - 2, -1, -1):
        out = F.when(F.abs(n) < 1024.0 ** (i + 1), shown(i)).otherwise(out)
    return F.when(n.isNotNull(), out)


def file_profile(lines: DataFrame, files: DataFrame, anomalies: DataFrame | None = None) -> DataFrame:
    """One wide row per file: catalogue, statistics, longest line, line ending and anomalies; one pass over the lines gives all but the latter."""
    aggs, columns = _stats("bytes", "sample")
    one = lines.groupBy("file_id").agg(*aggs, _longest().alias("x"), *_ending_kinds())
    one = one.select("file_id", *columns, F.col("x.line_no").alias("longest_line_no"), F.col("x.byte_start").alias("longest_offset"), _ending())
    out = files.join(one, "file_id", "left")
    if anomalies is not None:
        out = out.join(anomalies.groupBy("file_id").agg(F.count("*").alias("n_anomalies")), "file_id", "left").fillna({"n_anomalies": 0})
    return out


def corpus_profile(lines: DataFrame) -> DataFrame:
    """Lines and bytes by file, by directory and over all: level 0, 1 and 3."""
    sizes = lines.groupBy("file_id").agg(F.count("*").alias("n"), F.sum(F.col("byte_len") + 1).alias("b"))
    sizes = sizes.withColumn("dir", parent(F.col("file_id")))
    return sizes.rollup("dir", "file_id").agg(F.sum("n").alias("n_lines"), F.sum("b").alias("n_bytes"), F.grouping_id().alias("level"))


def anomaly_summary(anomalies: DataFrame) -> DataFrame:
    """Ranges by file and category, with totals of either."""
    return anomalies.cube("file_id", "category").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


def index_needed(files: DataFrame, analyze: bool = False, threshold: int = 50 << 20) -> DataFrame:
    """Files worth an index: text of the threshold's size, or any text if it is to be analysed."""
    return files.where(F.col("is_text") & (F.lit(analyze) | (F.col("size_bytes") >= threshold)))
