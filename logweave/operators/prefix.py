"""Dominant masked prefix of a file's lines, and lines that deviate from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import mask_tokens
from ..functions.windows import BLOCK_LINES, with_block
from ..sources.lines import text
from .detectors import _hits
from .stats import blank

#: What a mask stands for when a prefix is turned back into a regex.
TOKEN_REGEX = {
    "DATETIME": r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:[.,]\d{3,6})?Z?",
    "DATE": r"\d{4}-\d{2}-\d{2}",
    "TIME": r"\d{2}:\d{2}:\d{2}(?:[.,]\d{3,6})?Z?",
    "SYSDATE": r"[A-Z][a-z]{2}\s+\d{1,2}",
    "NUM_ID": r"\[\d+\]",
    "COMPONENT": r"\[[\w.-]+\]",
    "LEVEL": r"(?:DEBUG|INFO|WARN(?:ING)?|ERROR|CRITICAL|FATAL|TRACE)",
    "HEX": r"[0-9A-Fa-f]{8,}",
    "IP": r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}",
    "NUM": r"\d+",
}


def prefix_regex(prefix: Column) -> Column:
    """Masked prefix to regex: literals escaped, masks replaced also inside a token, any white space between tokens."""
    out = F.regexp_replace(prefix, r"([\\.^$|?*+()\[\]{}])", r"\\$1")
    for name, pattern in TOKEN_REGEX.items():
        out = F.replace(out, F.lit(f"<{name}>"), F.lit(pattern))
    return F.concat(F.lit("^"), F.regexp_replace(out, " ", r"\\s+"))


def _sample(lines: DataFrame, sample: int, skip: float, values: dict[str, Column] | None = None, places: DataFrame | None = None) -> DataFrame:
    """The first lines of each file, sample at most and numbered as r, that are not blank and start behind the share skip of its bytes; values of them in place of the line.

    Sizes and counts by block of lines are aggregated, from places(file_id, line_no, byte_start, byte_len, empty) where the caller has these; only lines of blocks that the sample
    reaches meet their text, and are numbered inside their block.
    """
    if places is None:
        places = lines.select("file_id", "line_no", "byte_start", "byte_len", blank(F.col("line")).alias("empty"))
    sizes = places.groupBy(F.col("file_id").alias("z_file")).agg(F.max(F.col("byte_start") + F.col("byte_len") + 1).alias("size")).select("z_file", F.floor(F.col("size") * skip).alias("from"))
    kept = with_block(places, BLOCK_LINES).join(sizes, F.col("file_id").eqNullSafe(F.col("z_file"))).where((F.col("byte_start") >= F.col("from")) & ~F.col("empty"))
    counts = kept.groupBy(F.col("file_id").alias("c_file"), F.col("lblock").alias("c_block")).agg(F.count("*").alias("n"), F.first("from").alias("from"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("c_file").orderBy("c_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumn("before", before).where(F.col("before") < sample)
    met = with_block(lines, BLOCK_LINES).join(counts, F.col("file_id").eqNullSafe(F.col("c_file")) & (F.col("lblock") == F.col("c_block")))
    met = met.where((F.col("byte_start") >= F.col("from")) & ~blank(F.col("line")))
    if values is not None:
        met = met.select("file_id", "lblock", "line_no", "before", *[c.alias(n) for n, c in values.items()])
    inside = F.row_number().over(Window.partitionBy("file_id", "lblock").orderBy("line_no"))
    return met.withColumn("r", (F.col("before") + inside).cast("int")).where(F.col("r") <= sample).drop("c_file", "c_block", "from", "n", "before", "lblock")


def dominant_prefix(lines: DataFrame, coverage: float = 0.9, max_tokens: int = 8, sample: int = 1000, skip: float = 0.05, fallback: float = 0.5, places: DataFrame | None = None) -> DataFrame:
    """(file_id, prefix, token_count, coverage, regex): the longest run of masked leading tokens that enough of the sampled lines share.

    Below that, the commonest run of max_tokens tokens (all of a shorter line's), if the fallback share has it; else the file has none.
    """
    tokens = F.slice(F.filter(F.split(mask_tokens(text()), r"\s+", -1), lambda t: t != ""), 1, max_tokens)
    rows = _sample(lines, sample, skip, {"t": tokens}, places).select("file_id", "r", "t").withColumn("all", F.count("*").over(Window.partitionBy("file_id")))
    # One pass for both ways: a run of tokens taken whole is the prefix of all its tokens.
    runs = rows.groupBy("file_id", "t").agg(F.count("*").alias("n"), F.max("all").alias("all"), F.min("r").alias("seen"))
    each = runs.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(max_tokens)))).where(F.size("t") >= F.col("k"))
    whole = F.size("t") == F.col("k")
    counts = each.groupBy("file_id", "k", F.array_join(F.slice("t", 1, F.col("k")), " ").alias("prefix")).agg(F.sum("n").alias("n"), F.max("all").alias("all"), F.sum(F.when(whole, F.col("n"))).alias("w"), F.min(F.when(whole, F.col("seen"))).alias("seen"))
    good = F.when(F.col("n") / F.col("all") >= coverage, F.struct("k", F.col("n") / F.col("all"), "prefix"))
    # A file without such a prefix takes the commonest run of leading tokens whole, as far as max_tokens, if it is common enough.
    other = F.when(F.col("w").isNotNull(), F.struct("w", -F.col("seen")))
    found = lambda n: F.struct("prefix", "k", (F.col(n) / F.col("all")).alias("share"))
    best = counts.groupBy("file_id").agg(F.max_by(found("n"), good).alias("g"), F.max_by(found("w"), other).alias("o"))
    best = best.select("file_id", F.coalesce("g", F.when(F.col("o.share") >= fallback, F.col("o"))).alias("x")).where(F.col("x").isNotNull())
    return best.select("file_id", "x.prefix", F.col("x.k").alias("token_count"), F.round("x.share", 6).alias("coverage"), prefix_regex(F.col("x.prefix")).alias("regex"))


def prefix_length(lines: DataFrame, prefixes: DataFrame, sample: int = 100) -> DataFrame:
    """Upper median of the length that the prefix takes in the first sampled lines that match it."""
    rows = _sample(lines, sample, 0.05).join(prefixes.select("file_id", "regex"), "file_id")
    n = F.length(F.regexp_substr(text(), F.col("regex")))
    lens = rows.withColumn("n", n).where(F.col("n").isNotNull()).groupBy("file_id").agg(F.sort_array(F.collect_list("n")).alias("a"))
    return lens.select("file_id", F.element_at("a", (F.floor(F.size("a") / 2) + 1).cast("int")).alias("prefix_length"))


def detect_prefix_deviation(lines: DataFrame, prefixes: DataFrame | None = None, coverage: float = 0.9) -> DataFrame:
    """Lines that do not start with their file's dominant prefix, where that covers nearly all; less if indented."""
    prefixes = dominant_prefix(lines) if prefixes is None else prefixes
    rows = lines.join(prefixes.where(F.col("coverage") >= coverage).select("file_id", "regex"), "file_id").where(~blank(F.col("line")))
    severity = F.when(~F.regexp_like(text(), F.col("regex")), F.when(F.col("line").rlike(r"^\s"), 0.24).otherwise(0.3))
    return _hits(rows.withColumn("severity", severity), "prefix_deviation")


