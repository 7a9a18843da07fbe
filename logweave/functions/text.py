"""String functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Masks of variable parts, applied in this order.
MASKS = (
    (r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:[.,]\d{3,6})?Z?", "DATETIME"),
    (r"\d{4}-\d{2}-\d{2}", "DATE"),
    (r"\d{2}:\d{2}:\d{2}[.,]\d{3,6}Z?", "TIME"),
    (r"\d{2}:\d{2}:\d{2}", "TIME"),
    (r"[A-Z][a-z]{2}\s+\d{1,2}", "SYSDATE"),
    (r"\[\d+\]", "NUM_ID"),
    (r"\[[\w.-]+\]", "COMPONENT"),
    (r"\b(?:DEBUG|INFO|WARN(?:ING)?|ERROR|CRITICAL|FATAL|TRACE)\b", "LEVEL"),
    (r"\b[0-9A-Fa-f]{8,}\b", "HEX"),
    (r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", "IP"),
    (r"\b\d+\b", "NUM"),
)


def shannon_entropy(s: Column) -> Column:
    """Bits a character: characters are sorted once and their runs counted, so that the work does not grow with the number of different ones."""
    chars = F.array_sort(F.filter(F.split(s, ""), lambda c: c != ""))
    spent = lambda a: a["acc"] + F.when(a["n"] > 1, a["n"] * F.log2(a["n"])).otherwise(0.0)
    start = F.struct(F.lit("").alias("c"), F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("acc"))
    same = lambda a: F.struct(a["c"].alias("c"), (a["n"] + 1).alias("n"), a["acc"].alias("acc"))
    other = lambda a, x: F.struct(x.alias("c"), F.lit(1).cast("long").alias("n"), spent(a).alias("acc"))
    runs = F.aggregate(chars, start, lambda a, x: F.when(a["c"] == x, same(a)).otherwise(other(a, x)), spent)
    n = F.length(s)
    return F.when(n > 0, F.greatest(F.log2(n) - runs / n, F.lit(0.0))).when(n == 0, 0.0)


def mask_tokens(line: Column) -> Column:
    for pattern, name in MASKS:
        line = F.regexp_replace(line, pattern, f"<{name}>")
    return line
