"""Anomaly detectors over lines: row predicates, and windows over blocks of lines with a halo or a carry."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import shannon_entropy
from ..functions.windows import in_block, running_sums, with_block, with_halo
from ..sources.lines import text
from .stats import blank

#: Starts of stack traces.
TRACEBACK = (
    r"Traceback \(most recent call last\):", r"\w+Error:", r"\w+Exception:", r"Exception in thread", r"Caused by:", r"Error:", r"TypeError:",
    r"ReferenceError:", r"SyntaxError:", r"panic:", r"goroutine \d+ \[", r"thread .* panicked at", r"stack backtrace:",
)
#: Keyword patterns and severities, in the order of descriptions.
ERRORS = (
    (r"(?i)\bFATAL\b", 0.9), (r"(?i)\bCRITICAL\b", 0.85), (r"(?i)\bERROR\b", 0.7), (r"\bException\b", 0.7), (r"(?i)\bFailed\b", 0.6), (r"(?i)\bFailure\b", 0.6),
    (r"(?i)\bAborted\b", 0.6), (r"(?i)\bCrash(?:ed)?\b", 0.7), (r"(?i)\bSegmentation fault\b", 0.9), (r"\bOOM\b", 0.8), (r"(?i)\bOut of memory\b", 0.8),
)
#: A line without any of these starts no stack trace.
TRACEBACK_STEMS = ("Traceback", "Error:", "Exception", "Caused by:", "panic", "goroutine", "stack backtrace:")
#: A line without any of these, lower-cased, has none of the keywords.
ERROR_STEMS = ("fatal", "critical", "error", "exception", "fail", "abort", "crash", "fault", "oom", "memory")
WARNING_STEMS = ("warn", "[w]", "caution", "deprecat")
#: The same of secrets, and of the levels of a format.
SECRET_STEMS = ("key", "secret", "passw", "pwd", "token", "bearer", "authorization", "credential", "-----begin")
LEVEL_STEMS = ("debug", "info", "warn", "error", "fatal", "trace")
WARNINGS = ((r"(?i)\bWARNING\b", 0.4), (r"(?i)\bWARN\b", 0.4), (r"\[W\]", 0.4), (r"(?i)\bCaution\b", 0.35), (r"(?i)\bDeprecated\b", 0.3), (r"(?i)\bDeprecation\b", 0.3))
#: Secrets with their context; hashes and tokens without.
SECRETS = (
    r"""(?i)(?:api[_-]?key|apikey)\s*[=:]\s*["']?[A-Za-z0-9+/=_-]{20,}""",
    r"""(?i)(?:secret|secret[_-]?key)\s*[=:]\s*["']?[A-Za-z0-9+/=_-]{20,}""",
    r"""(?i)(?:password|passwd|pwd)\s*[=:]\s*["']?[^\s"']{8,}""",
    r"""(?i)(?:token|auth[_-]?token|access[_-]?token)\s*[=:]\s*["']?[A-Za-z0-9+/=_-]{20,}""",
    r"""(?i)(?:bearer|authorization)[:\s]+[A-Za-z0-9+/=_.-]{20,}""",
    r"""(?i)(?:private[_-]?key|credential)\s*[=:]\s*["']?[A-Za-z0-9+/=_-]{20,}""",
    r"-----BEGIN\s+\w+\s+PRIVATE\s+KEY-----",
    r"""(?i)(?:aws[_-]?)?(?:access[_-]?key[_-]?id|key[_-]?id)\s*[=:]\s*["']?AKIA[0-9A-Z]{16}""",
)
HEX_LENGTHS = (32, 40, 64, 128)
HEX_ENTROPY = 3.5
JWT = r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"
AWS_KEY = r"AKIA[0-9A-Z]{16}"
NOT_SECRET = r"@|\.(com|org|net|io|edu|gov|co\.|info)|https?://|\s"
#: JSON openers, key-value pairs and structure lines.
JSON_START = r"""^\s*\{\s*"[^"]+"\s*:|:\s*\{\s*"[^"]+"\s*:|^\s*\[\s*[\{"]|:\s*\[\s*[\{"]"""
JSON_PAIR = r""""[^"]+"\s*:\s*(?:"[^"]*"|[\d.]+|true|false|null|\{|\[)"""
JSON_LINE = r"^\s*(?:[\{\}\[\]],?|\{\}|\[\]|[\}\]]\s*,?)\s*$"
#: The parts of a line's format.
FORMAT = (r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}", r"^\[\d{4}-\d{2}-\d{2}", r"^\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}", r"(?i)\b(?:DEBUG|INFO|WARN|WARNING|ERROR|FATAL|TRACE)\b", r"^\[.*?\]")

#: Lines that go on with a stack trace.
CONTINUATION = (r"^  File \".*\", line \d+", r"^\s+at \w+", r"^\s+\.\.\. \d+ more", r"^\s+raise \w+", r"^\s+\d+:\s+0x", r"^\t")
#: Least and greatest severity, and category, of each detector.
SEVERITY = {"traceback": (0.9, 0.9), "error_keyword": (0.6, 0.9), "warning_keyword": (0.3, 0.4), "line_length_spike": (0.3, 0.7), "indentation_block": (0.4, 0.4), "timestamp_gap": (0.3, 0.8), "high_entropy": (0.5, 0.85), "json_dump": (0.3, 0.4), "format_deviation": (0.3, 0.6), "prefix_deviation": (0.24, 0.3)}
CATEGORY = {"traceback": "traceback", "error_keyword": "error", "warning_keyword": "warning", "line_length_spike": "format", "indentation_block": "multiline", "timestamp_gap": "timing", "high_entropy": "security", "json_dump": "format", "format_deviation": "format", "prefix_deviation": "format"}


def _any(line: Column, patterns) -> Column:
    return line.rlike("|".join(f"(?:{p})" for p in patterns))


def _strip(line: Column) -> Column:
    return F.regexp_replace(line, r"\s+$", "")


def traceback_severity(line: Column) -> Column:
    some = reduce(or_, [line.contains(s) for s in TRACEBACK_STEMS])
    return F.when(some & line.rlike("^(?:" + "|".join(TRACEBACK) + ")"), F.lit(0.9))


def _holds(line: Column, stems) -> Column:
    """Whether a line has one of the stems in any case: far cheaper than a regex, which is then run on few lines."""
    low = F.lower(line)
    some = F.contains(low, F.lit(stems[0]))
    for s in stems[1:]:
        some = some | F.contains(low, F.lit(s))
    return some


def _keywords(line: Column, words, stems) -> Column:
    """The highest severity among the words found; their stems and a cheap alternation guard the single tests."""
    best = F.greatest(*[F.when(line.rlike(p), F.lit(s)) for p, s in words])
    return F.when(_holds(line, stems) & _any(line, [p for p, _ in words]), best)


def error_severity(line: Column) -> Column:
    return _keywords(line, ERRORS, ERROR_STEMS)


def warning_severity(line: Column) -> Column:
    return _keywords(line, WARNINGS, WARNING_STEMS)


def entropy_severity(line: Column) -> Column:
    """Secrets in context first, then the first hash of each length in turn that is random enough, then JWT, then AWS keys."""
    hashes = [F.exists(F.regexp_extract_all(line, F.lit(rf"(?<![A-Fa-f0-9])[a-fA-F0-9]{{{n}}}(?![A-Fa-f0-9])"), F.lit(0)), lambda t: shannon_entropy(t) >= HEX_ENTROPY) for n in HEX_LENGTHS]
    some = hashes[0]
    for h in hashes[1:]:
        some = some | h
    token = lambda p: F.exists(F.regexp_extract_all(line, F.lit(p), F.lit(0)), lambda t: ~t.rlike(NOT_SECRET))
    guess = F.when((F.length(line) >= 32) & line.rlike("[a-fA-F0-9]{32}") & some, 0.6)
    guess = guess.when(line.contains("eyJ") & line.rlike(JWT) & token(JWT), 0.7).when(line.contains("AKIA") & line.rlike(AWS_KEY) & token(AWS_KEY), 0.85)
    return F.when(_holds(line, SECRET_STEMS) & _any(line, SECRETS), F.lit(0.85)).otherwise(guess)


def _hits(rows: DataFrame, detector: str) -> DataFrame:
    return rows.where(F.col("severity").isNotNull()).select("file_id", "line_no", "byte_start", F.round("severity", 6).alias("severity"), F.lit(detector).alias("detector"))


def detect_traceback(lines: DataFrame) -> DataFrame:
    return _hits(lines.withColumn("severity", traceback_severity(text())), "traceback")


def detect_error_keyword(lines: DataFrame) -> DataFrame:
    return _hits(lines.withColumn("severity", error_severity(text())), "error_keyword")


def detect_warning_keyword(lines: DataFrame) -> DataFrame:
    return _hits(lines.withColumn("severity", warning_severity(text())), "warning_keyword")


def detect_high_entropy(lines: DataFrame) -> DataFrame:
    return _hits(lines.withColumn("severity", entropy_severity(text())), "high_entropy")


def _indent(line: Column) -> Column:
    """Leading white space, tabs as four; none for blank lines."""
    lead = F.regexp_extract(line, r"^[ \t]*", 0)
    return F.when(~blank(line), F.length(lead) + 3 * (F.length(lead) - F.length(F.translate(lead, "\t", "")))).otherwise(0)


def _json_like(line: Column) -> Column:
    return (line.contains('"') & line.rlike(JSON_PAIR)) | line.rlike(JSON_LINE)


def goes_on(detector: str, least: int = 4) -> Column:
    """Whether a line continues what a detector found on the line before, for ``multiline_blocks``: traces, indented blocks and JSON."""
    line = F.col("line")
    rules = {"traceback": _any(line, CONTINUATION), "indentation_block": _indent(line) >= least, "json_dump": _json_like(line)}
    return ~blank(line) & rules[detector]


def _length(line: Column) -> Column:
    """Length without white space at the end; none for blank lines."""
    return _width(line, _strip(line))


def _width(line: Column, stripped: Column) -> Column:
    return F.when(~blank(line), F.length(stripped)).cast("long")


def _of_files(rows: DataFrame, files: DataFrame) -> DataFrame:
    """The rows whose file is among files(s_file)."""
    return rows.join(files, F.col("file_id").eqNullSafe(F.col("s_file")), "left_semi")


def detect_length_spike(lines: DataFrame, sigmas: float = 5.0, least_std: float = 40.0) -> DataFrame:
    """Length over the running mean plus five deviations, the line itself included, over lines that are not blank."""
    return _spikes(lines.select("file_id", "line_no", "byte_start", _length(F.col("line")).alias("len")), sigmas, least_std)


def _spikes(rows: DataFrame, sigmas: float = 5.0, least_std: float = 40.0) -> DataFrame:
    """Hits of rows(file_id, line_no, byte_start, len). A hit is longer than sigmas times the least deviation, so that files without such a line are left out first."""
    files = rows.where(F.col("len") > sigmas * least_std).select(F.col("file_id").alias("s_file")).distinct()
    rows = _of_files(rows.where(F.col("len").isNotNull()).select("file_id", "line_no", "byte_start", "len"), files)
    rows = running_sums(rows, {"k": F.lit(1), "s": F.col("len"), "q": F.col("len") * F.col("len")})
    mean = F.col("s") / F.col("k")
    std = F.sqrt(F.greatest(F.col("q") / F.col("k") - mean * mean, F.lit(0.0)))
    rows = rows.withColumns({"mean": mean, "std": std})
    z = (F.col("len") - F.col("mean")) / F.col("std")
    severity = F.when((F.col("std") >= least_std) & (F.col("len") > F.col("mean") + sigmas * F.col("std")), F.least(0.3 + (z - sigmas) * 0.1, F.lit(0.7)))
    return _hits(rows.withColumn("severity", severity), "line_length_spike")


def deep(line: Column, least: int = 4) -> Column:
    """Whether a line is indented by least, tabs as four; sources may add it as a column ``deep``, so that texts need not be dealt."""
    return _indent(line) >= least


def detect_indentation(lines: DataFrame, least: int = 4) -> DataFrame:
    """Indented lines, tabs as four, after two lines that are indented too. Only indented lines are shuffled: those before have the numbers right before. Lines may come with ``deep``."""
    rows = lines.where(F.col("deep") if "deep" in lines.columns else deep(F.col("line"), least))
    rows, w = with_halo(rows.select("file_id", "line_no", "byte_start"), 2), in_block()
    follows = (F.lag("line_no", 1).over(w) == F.col("line_no") - 1) & (F.lag("line_no", 2).over(w) == F.col("line_no") - 2)
    return _hits(rows.withColumn("severity", F.when(follows, 0.4)).where(~F.col("halo")), "indentation_block")


def _indentation(w) -> Column:
    """Severity of a deep line after two such lines, of rows with all deep lines among them."""
    before = lambda k: F.lag(F.when(F.col("deep"), F.col("line_no")), k).over(w) == F.col("line_no") - k
    return F.when(F.col("deep") & before(1) & before(2), 0.4)


def timestamps(lines: DataFrame) -> DataFrame:
    """Columns ts0..ts3: seconds by each format, from the first five words of a line."""
    prefix = F.array_join(F.slice(F.filter(F.split("line", r"\s+", -1), lambda w: w != ""), 1, 5), " ")
    iso = F.regexp_extract("head", r"(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2})", 1)
    clf = F.regexp_extract("head", r"(\d{2}/\w{3}/\d{4}:\d{2}:\d{2}:\d{2})", 1)
    unix = F.regexp_extract("head", r"\b(\d{10,13})\b", 1).try_cast("double")
    clock = F.regexp_extract("head", r"(\d{2}:\d{2}:\d{2})", 1)
    part = lambda i: F.substring(clock, i, 2).try_cast("int")
    # No format does without one of these; lines that have neither are not cut into words.
    head = F.when(F.col("line").rlike(r"\d{2}:\d{2}:\d{2}|\d{10}"), prefix)
    return lines.withColumn("head", head).withColumns({
        "ts0": F.unix_timestamp(F.try_to_timestamp(F.translate(iso, "T", " "), F.lit("yyyy-MM-dd HH:mm:ss"))).cast("double"),
        "ts1": F.unix_timestamp(F.try_to_timestamp(clf, F.lit("dd/MMM/yyyy:HH:mm:ss"))).cast("double"),
        "ts2": F.when(unix > 1e12, unix / 1000).otherwise(unix),
        "ts3": (part(1) * 3600 + part(4) * 60 + part(7)).cast("double"),
    }).drop("head")


def detect_timestamp_gap(lines: DataFrame, least_gap: float = 300.0, max_lines: int = 500, lock_after: int = 50) -> DataFrame:
    """Gaps of five minutes and more between timestamps of one format that are at most 500 lines apart.

    A file locks to the format that is seen 50 times first; later lines are read in that format only. The previous
    timestamp is looked for in a halo of 500 lines, which is as far as the rule reaches.
    """
    rows = with_halo(_locked(lines, lock_after).select("file_id", "line_no", "byte_start", "fmt", "ts"), max_lines).where(F.col("ts").isNotNull())
    w = in_block()
    rows = rows.withColumn("met", F.lag(F.struct("fmt", "ts", "line_no")).over(w)).where(~F.col("halo"))
    return _hits(rows.withColumn("severity", _gap(least_gap, max_lines)), "timestamp_gap")


def _gap(least_gap: float, max_lines: int) -> Column:
    """Severity of a line with fmt and ts after met, the timestamp before it."""
    gap = F.abs(F.col("ts") - F.col("met.ts"))
    gap = F.when((F.col("fmt") == 3) & (gap > 43200), 86400 - gap).otherwise(gap)
    ok = (F.col("met.fmt") == F.col("fmt")) & (F.col("line_no") - F.col("met.line_no") <= max_lines) & (gap >= least_gap)
    return F.when(ok, F.least(0.3 + gap / 3600 * 0.5, F.lit(0.8)))


def _locked(lines: DataFrame, lock_after: int) -> DataFrame:
    """lines with fmt and ts, the timestamp in the format that the file is locked to, once it is."""
    return _lock(timestamps(lines), lock_after)


def _lock(rows: DataFrame, lock_after: int) -> DataFrame:
    """rows of ``timestamps`` with fmt and ts in place of the single formats."""
    kinds = range(4)
    first = F.coalesce(*[F.when(F.col(f"ts{i}").isNotNull(), F.lit(i)) for i in kinds])
    rows = rows.withColumn("fmt0", first)
    nth = F.row_number().over(Window.partitionBy("file_id", "fmt0").orderBy("line_no"))
    reached = rows.where(F.col("fmt0").isNotNull()).select("file_id", "fmt0", "line_no").withColumn("nth", nth).where(F.col("nth") <= lock_after).where(F.col("nth") == lock_after)
    lock = reached.groupBy("file_id").agg(F.min(F.struct("line_no", "fmt0")).alias("x")).select(F.col("file_id").alias("lock_file"), F.col("x.line_no").alias("lock_line"), F.col("x.fmt0").alias("lock_fmt"))
    rows = rows.join(lock, F.col("file_id") == F.col("lock_file"), "left")
    locked = F.col("line_no") > F.col("lock_line")
    pick = lambda f: F.coalesce(*[F.when(f == i, F.col(f"ts{i}")) for i in kinds])
    fmt = F.when(locked, F.when(pick(F.col("lock_fmt")).isNotNull(), F.col("lock_fmt"))).otherwise(F.col("fmt0"))
    return rows.withColumn("fmt", fmt).withColumn("ts", pick(F.col("fmt"))).drop("fmt0", "lock_file", "lock_line", "lock_fmt", *[f"ts{i}" for i in kinds])


def detect_json_dump(lines: DataFrame, window: int = 10) -> DataFrame:
    """Long lines of JSON among ten JSON-like lines, of the line and the ten before it."""
    rows = with_halo(_json_parts(lines).where(F.col("like") == 1).select("file_id", "line_no", "byte_start", "like", "dump"), window)
    return _hits(rows.withColumn("severity", _json(in_block(), window)).where(~F.col("halo")), "json_dump")


def _json_parts(lines: DataFrame, stripped: Column | None = None) -> DataFrame:
    """lines with like, whether a line is JSON-like, and dump, its severity if the lines around it are; it is JSON-like itself."""
    stripped = _strip(F.col("line")) if stripped is None else stripped
    n = F.length(stripped)
    pairs = F.size(F.regexp_extract_all(stripped, F.lit(JSON_PAIR), F.lit(0))) >= 3
    dump = F.when((F.length("line") >= 100) & F.col("line").contains('"') & (n >= 100) & stripped.rlike(JSON_START) & pairs, F.when(n > 500, 0.4).when(n > 200, 0.35).otherwise(0.3))
    return lines.withColumns({"like": _json_like(F.col("line")).cast("int"), "dump": dump})


def _json(w, window: int) -> Column:
    """By numbers of lines, not rows: only JSON-like lines need be there."""
    return F.when(F.sum("like").over(w.rangeBetween(-window, 0)) >= window, F.col("dump"))


def detect_format_deviation(lines: DataFrame, settle: int = 100, every: int = 1000) -> DataFrame:
    """Rare formats that differ in two parts and more from the dominant one, which is set at line 100 and anew each 1000 lines."""
    rows = lines.select("file_id", "line_no", "byte_start", _signature(F.col("line")).alias("sig"))
    return _deviations(rows, settle, every)


def _signature(line: Column) -> Column:
    """One digit for each part of a format, whether the line has it; none for blank lines. The three forms of a timestamp are parts of their own."""
    has = lambda p: _holds(line, LEVEL_STEMS) & line.rlike(p) if "DEBUG" in p else line.rlike(p)
    return F.when(~blank(line), F.concat(*[F.when(has(p), "1").otherwise("0") for p in FORMAT]))


def _deviations(rows: DataFrame, settle: int = 100, every: int = 1000) -> DataFrame:
    """Hits of rows(file_id, line_no, byte_start, sig). Files in which no two formats differ in two parts have none and are left out first."""
    rows = with_block(rows.where(F.col("sig").isNotNull()).select("file_id", "line_no", "byte_start", "sig"))
    kinds = rows.select("file_id", "sig").distinct().groupBy("file_id").agg(F.collect_set("sig").alias("all"))
    apart = lambda a, b: sum(((F.substring(a, i, 1) != F.substring(b, i, 1)).cast("int") for i in range(1, len(FORMAT) + 1)), F.lit(0)) >= 2
    odd = F.exists("all", lambda a: F.exists("all", lambda b: apart(a, b)))
    rows = _of_files(rows, kinds.where(odd).select(F.col("file_id").alias("s_file")))
    rows = running_sums(rows, {"n": F.lit(1)})
    # Read three times below; narrow, and empty for most tables.
    rows = running_sums(rows, {"c": F.lit(1)}, ("file_id", "sig")).persist(StorageLevel.MEMORY_AND_DISK)
    upto = F.when(F.col("n") <= settle, F.lit(settle)).otherwise(F.ceil(F.col("n") / every) * every).cast("long")
    counts = rows.groupBy("file_id", "sig", upto.alias("mark")).agg(F.count("*").alias("k"), F.min("line_no").alias("seen"))
    marks = counts.select("file_id", "mark").distinct()
    sigs = counts.groupBy("file_id", "sig").agg(F.min("seen").alias("first"))
    grid = marks.join(sigs, "file_id").join(counts.drop("seen"), ["file_id", "sig", "mark"], "left")
    total = F.sum(F.coalesce("k", F.lit(0))).over(Window.partitionBy("file_id", "sig").orderBy("mark").rowsBetween(Window.unboundedPreceding, 0))
    top = grid.withColumn("total", total).groupBy("file_id", "mark").agg(F.max_by("sig", F.struct("total", -F.col("first"))).alias("top"))
    top = top.select(F.col("file_id").alias("top_file"), "mark", "top")
    at = F.when(F.col("n") >= every, F.floor(F.col("n") / every) * every).when(F.col("n") >= settle, F.lit(settle)).cast("long")
    rows = rows.withColumn("at", at).join(top, (F.col("file_id") == F.col("top_file")) & (F.col("at") == F.col("mark")))
    differ = sum(((F.substring("sig", i, 1) != F.substring("top", i, 1)).cast("int") for i in range(1, len(FORMAT) + 1)), F.lit(0))
    severity = F.when((differ >= 2) & (F.col("c") / F.col("n") < 0.05), F.least(0.3 + differ * 0.1, F.lit(0.6)))
    return _hits(rows.withColumn("severity", severity), "format_deviation")


#: Detectors of one line alone; these share one pass.
ROW_DETECTORS = {"traceback": traceback_severity, "error_keyword": error_severity, "warning_keyword": warning_severity, "high_entropy": entropy_severity}
#: Detectors that look at a bounded number of lines before a line share a pass too; these do not.
RUNNING_DETECTORS = {"line_length_spike": detect_length_spike, "format_deviation": detect_format_deviation}


def detect_rows(lines: DataFrame, detectors: dict | None = None) -> DataFrame:
    """All row detectors in one scan: an array of hits, exploded."""
    chosen = ROW_DETECTORS if detectors is None else detectors
    return _exploded(lines, {n: fn(text()) for n, fn in chosen.items()})


def _exploded(rows: DataFrame, severities: dict[str, Column]) -> DataFrame:
    if not severities:
        return rows.select("file_id", "line_no", "byte_start", F.lit(None).cast("double").alias("severity"), F.lit("").alias("detector")).where("false")
    found = [s.isNotNull() for s in severities.values()]
    rows = rows.where(reduce(or_, found))
    hits = F.filter(F.array(*[F.struct(F.round(s, 6).alias("severity"), F.lit(n).alias("detector")) for n, s in severities.items()]), lambda h: h["severity"].isNotNull())
    return rows.select("file_id", "line_no", "byte_start", F.explode(hits).alias("h")).select("file_id", "line_no", "byte_start", "h.severity", "h.detector")


def _features(lines: DataFrame, row: dict) -> DataFrame:
    """What the detectors need of each line, in narrow columns, so that each regex is run once and no text is shuffled."""
    line, stripped = F.col("line"), F.col("stripped")
    parts = timestamps(lines).withColumns({"t": text(), "stripped": _strip(line)})
    parts = _json_parts(parts, stripped).withColumns({"deep": _indent(line) >= 4, "len": _width(line, stripped), "sig": _signature(line)}).withColumns({f"r_{n}": fn(F.col("t")) for n, fn in row.items()})
    return parts.select("file_id", "line_no", "byte_start", "byte_len", *[f"ts{i}" for i in range(4)], "deep", "like", "dump", "len", "sig", *[f"r_{n}" for n in row])


def detect_near(lines: DataFrame, row: dict | None = None) -> DataFrame:
    """The row detectors and those that look back a bounded number of lines (indentation, JSON, timestamp gaps) with their default bounds.

    Those that look back share one exchange by blocks of lines and one order: what each needs of a line is a few narrow columns, made before the
    lines are dealt with a halo of 500, and only lines that are indented or JSON-like or have a timestamp are dealt. Hits of the row detectors stay where they are found.
    """
    row = ROW_DETECTORS if row is None else row
    return _near(_features(lines, row), row)


def _near(features: DataFrame, row: dict) -> DataFrame:
    times = [f"ts{i}" for i in range(4)]
    near = features.where(F.col("deep") | (F.col("like") == 1) | F.coalesce(*times).isNotNull()).select("file_id", "line_no", "byte_start", *times, "deep", "like", "dump")
    rows = with_halo(_lock(near, 50), 500)
    w = in_block()
    met = F.last(F.when(F.col("ts").isNotNull(), F.struct("fmt", "ts", "line_no")), True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumns({"met": met, "indented": _indentation(w), "json": _json(w, 10)}).where(~F.col("halo"))
    found = _exploded(rows, {"indentation_block": F.col("indented"), "timestamp_gap": _gap(300.0, 500), "json_dump": F.col("json")})
    return _exploded(features, {n: F.col(f"r_{n}") for n in row}).unionByName(found)


def detect_all(lines: DataFrame, row: dict | None = None, window: dict | None = None) -> DataFrame:
    """Union of all detectors' hits, prefix deviations among them, or of the given ones in place of the defaults.

    By default each line is reduced to narrow columns once, which are persisted in place of the texts and read by all detectors; only the rules on
    prefixes read the lines again, the first ones of each file and those of files that have a dominant prefix.
    """
    from .prefix import detect_prefix_deviation, dominant_prefix

    if window is not None:
        lines = lines.persist(StorageLevel.MEMORY_AND_DISK)
        out = detect_rows(lines, row)
        for fn in window.values():
            out = out.unionByName(fn(lines))
        return out
    row = ROW_DETECTORS if row is None else row
    features = _features(lines, row).persist(StorageLevel.MEMORY_AND_DISK)
    places = features.select("file_id", "line_no", "byte_start", "byte_len", F.col("len").isNull().alias("empty"))
    out = _near(features, row).unionByName(_spikes(features)).unionByName(_deviations(features))
    return out.unionByName(detect_prefix_deviation(lines, dominant_prefix(lines, places=places)))
