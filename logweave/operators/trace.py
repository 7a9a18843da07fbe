"""Multi-pattern regex search over lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.lines import text


def pattern_regex(pattern: str, flags: str = "") -> str:
    """A pattern with its flags worked in: i ignore case, w words, x whole line, F fixed string."""
    p = "\\Q" + pattern.replace("\\E", "\\E\\\\E\\Q") + "\\E" if "F" in flags else pattern
    if "x" in flags:
        p = f"^(?:{p})$"
    elif "w" in flags:
        p = rf"(?<!\w)(?:{p})(?!\w)"
    return f"(?i){p}" if "i" in flags else p


def named(patterns: list[str] | dict[str, str], flags: str = "") -> dict[str, str]:
    """Ids p1, p2, ... in the order given, with the finished regex of each."""
    items = patterns.items() if isinstance(patterns, dict) else ((f"p{i}", p) for i, p in enumerate(patterns, 1))
    return {i: pattern_regex(p, flags) for i, p in items}


def validate_patterns(spark: SparkSession, patterns: list[str] | dict[str, str], flags: str = "") -> dict[str, str]:
    """Errors by pattern id; empty if all are valid. Evaluated by Spark's own regex engine, on one row."""
    errors = {}
    for i, p in named(patterns, flags).items():
        try:
            spark.range(1).select(F.regexp_like(F.concat(F.lit(""), F.col("id").cast("string")), F.lit(p))).collect()
        except Exception as e:  # noqa: BLE001  any engine error makes the pattern invalid
            errors[i] = str(e).splitlines()[0]
    return errors


def identify_patterns(patterns: dict[str, str], line: Column | None = None) -> Column:
    """Array of the ids of all patterns that match a line."""
    line = text() if line is None else line
    return F.filter(F.array(*[F.when(line.rlike(p), F.lit(i)) for i, p in patterns.items()]), lambda x: x.isNotNull())


def trace(lines: DataFrame, patterns: list[str] | dict[str, str], flags: str = "") -> DataFrame:
    """One row per line and pattern that matches it: one pass, with one alternation that drops the other lines first."""
    p = named(patterns, flags)
    some = text().rlike(next(iter(p.values())))
    for other in list(p.values())[1:]:
        some = some | text().rlike(other)
    # One pattern need not be looked for again.
    return lines.where(some).withColumn("pattern_id", F.lit(*p) if len(p) == 1 else F.explode(identify_patterns(p)))


def submatches(line: Column, pattern: str) -> Column:
    """array<struct<text,start,end>> of all matches, in bytes; matches of the empty string have equal start and end."""

    def spans(parts: Column) -> Column:
        # The text between matches and the matches themselves alternate.
        before = lambda i: F.octet_length(F.array_join(F.slice(parts, 1, 2 * i + 1), ""))
        span = lambda m, i: F.get(F.transform(F.array(before(i)), lambda b: F.struct(m.alias("text"), b.alias("start"), (b + F.octet_length(m)).alias("end"))), 0)
        return F.transform(F.filter(parts, lambda _, i: i % 2 == 1), span)

    marked = F.split(F.regexp_replace(line, F.lit(pattern), F.lit("\n$0\n")), "\n", -1)
    # Text with line feeds of its own, which lines from rows may have, cannot be marked by them; there matches must not be empty.
    found = F.regexp_extract_all(line, F.lit(pattern), F.lit(0))
    pairs = F.flatten(F.transform(F.split(line, pattern, -1), lambda g, i: F.array(g, F.coalesce(F.get(found, i), F.lit("")))))
    parts = F.when(F.contains(line, F.lit("\n")), F.slice(pairs, 1, F.size(pairs) - 1)).otherwise(marked)
    # One element, so that the regex runs once a line and not once a match.
    return F.element_at(F.transform(F.array(parts), spans), 1)


def with_submatches(matches: DataFrame, patterns: list[str] | dict[str, str], flags: str = "") -> DataFrame:
    """Add submatches, and offsets: their absolute byte positions."""
    whens = None
    for i, p in named(patterns, flags).items():
        cond, value = F.col("pattern_id") == i, submatches(text(), p)
        whens = F.when(cond, value) if whens is None else whens.when(cond, value)
    return matches.withColumn("submatches", whens).withColumn("offsets", F.transform("submatches", lambda s: F.col("byte_start") + s["start"]))


def match_context(lines: DataFrame, matches: DataFrame, before: int = 0, after: int = 0) -> DataFrame:
    """Lines m - before to m + after of each match, clipped at the ends of its file, by an equi-join."""
    wanted = matches.select("pattern_id", "file_id", F.col("line_no").alias("match_line"), F.explode(F.sequence(F.greatest(F.col("line_no") - before, F.lit(1)), F.col("line_no") + after)).alias("line_no"))
    return lines.join(wanted, ["file_id", "line_no"]).select("pattern_id", "file_id", "match_line", F.col("line_no").alias("ctx_line"), "byte_start", "line")


def context_union(lines: DataFrame, matches: DataFrame, before: int = 0, after: int = 0) -> DataFrame:
    """Each line to show once, and the number of the run of neighbouring lines that it is in."""
    shown = match_context(lines, matches, before, after).select("file_id", F.col("ctx_line").alias("line_no"), "byte_start", "line").distinct()
    order = Window.partitionBy("file_id").orderBy("line_no")
    new = (F.col("line_no") - F.coalesce(F.lag("line_no").over(order), F.lit(-1)) > 1).cast("int")
    return shown.withColumn("new", new).withColumn("block", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("new")


def natural_key(file_id: Column) -> list[Column]:
    """Order in which f10 follows f2."""
    return [F.regexp_replace(file_id, r"\d+$", ""), F.regexp_extract(file_id, r"(\d+)$", 1).try_cast("long").asc_nulls_first(), file_id]


def trace_topk(matches: DataFrame, max_results: int) -> DataFrame:
    """The first matches by file, offset and pattern."""
    return matches.orderBy(*natural_key(F.col("file_id")), "byte_start", "pattern_id").limit(max_results)


def trace_file_counts(matches: DataFrame, files: DataFrame) -> DataFrame:
    """Matches of each file of files(file_id), also none."""
    counts = matches.groupBy("file_id").agg(F.count("*").alias("n_matches"))
    return files.select("file_id").join(counts, "file_id", "left").select("file_id", F.coalesce("n_matches", F.lit(0)).alias("n_matches"))


def trace_summary(matches: DataFrame, files: DataFrame, max_results: int | None = None) -> DataFrame:
    """One row: files, files with matches, matches, bytes, and whether a limit would cut."""
    m = matches.groupBy("file_id").agg(F.count("*").alias("n"))
    joined = files.join(m, "file_id", "left")
    limit = F.lit(False) if max_results is None else F.coalesce(F.sum("n"), F.lit(0)) > max_results
    return joined.agg(F.count("*").alias("n_files"), F.count("n").alias("n_files_hit"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_matches"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total_bytes"), limit.alias("limit_hit"))


def pattern_profile(lines: DataFrame, patterns: list[str] | dict[str, str], flags: str = "") -> DataFrame:
    """Lines, files and submatches of each pattern, in one aggregation of one pass; patterns without a hit have zeros."""
    p = named(patterns, flags)
    hits = F.array(*[F.struct(F.lit(i).alias("pattern_id"), F.size(F.regexp_extract_all(text(), F.lit(x), F.lit(0))).alias("n")) for i, x in p.items()])
    rows = lines.select("file_id", F.explode(hits).alias("h")).select("file_id", "h.*")
    per_file = rows.groupBy("pattern_id", "file_id").agg(F.count_if(F.col("n") > 0).alias("l"), F.sum("n").alias("s"), F.count("*").alias("all"))
    return per_file.groupBy("pattern_id").agg(F.sum("l").alias("n_lines"), F.count_if(F.col("l") > 0).alias("n_files"), F.sum("s").alias("n_submatches"), (F.sum("l") / F.sum("all")).alias("hit_rate"))


def highlight(line: Column, pattern: str, before: str = "<<", after: str = ">>") -> Column:
    quote = lambda s: s.replace("\\", "\\\\").replace("$", "\\$")
    return F.regexp_replace(line, f"({pattern})", f"{quote(before)}$1{quote(after)}")


def match_events(matches: DataFrame) -> DataFrame:
    """match_found records for consumers."""
    return matches.select(F.lit("match_found").alias("event"), "file_id", "pattern_id", F.col("byte_start").alias("offset"), "line_no", F.col("line").alias("line_text"))
