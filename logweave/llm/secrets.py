"""Secret scans over a content-addressed, incremental ledger."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stash, table

#: Kind, pattern, group whose length counts, least length. The first three are the base kinds.
RULES = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
    ("pem", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----", 0, 1),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1),
    ("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0, 1),
)
BASE = ("assign", "access", "hex")

FINDINGS = "findings array<struct<start:int,rank:int,end:int,kind:string>>"


def rule_version(rules=RULES) -> str:
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, also where it stands inside a lambda."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _running_ends(steps: Column) -> Column:
    """steps(step, n, counts) as (end, n, counts), end being the sum of all steps up to it.

    Sums run inside chunks of about the square root of their number, then over the chunks, so that a text of
    very many matches costs little more than their number and not its square, as appending to one array does.
    """
    one, chunk = "array<struct<end:int,n:int,counts:int>>", "array<struct<base:int,ends:array<struct<end:int,n:int,counts:int>>>>"
    width = lambda s: F.greatest(F.ceil(F.sqrt(F.size(s))).cast("int"), F.lit(1))
    pieces = _let(steps, lambda s: F.transform(F.sequence(F.lit(0), F.floor((F.size(s) - 1) / width(s)).cast("int")), lambda i: F.slice(s, i * width(s) + 1, width(s))))
    inside = lambda piece: F.aggregate(
        piece, F.struct(F.lit(0).alias("base"), F.array().cast(one).alias("ends")),
        lambda acc, x: F.struct(
            (acc["base"] + x["step"]).alias("base"),
            F.concat(acc["ends"], F.array(F.struct((acc["base"] + x["step"]).alias("end"), x["n"].alias("n"), x["counts"].alias("counts")))).alias("ends"),
        ),
    )
    chunks = F.aggregate(
        F.transform(pieces, inside), F.struct(F.lit(0).alias("base"), F.array().cast(chunk).alias("chunks")),
        lambda acc, c: F.struct((acc["base"] + c["base"]).alias("base"), F.concat(acc["chunks"], F.array(F.struct(acc["base"].alias("base"), c["ends"].alias("ends")))).alias("chunks")),
        lambda acc: acc["chunks"],
    )
    return F.flatten(F.transform(chunks, lambda c: F.transform(c["ends"], lambda x: F.struct((c["base"] + x["end"]).alias("end"), x["n"].alias("n"), x["counts"].alias("counts")))))


def _spans(text: Column, kind: str, rank: int, pattern: str, group: int, least: int) -> Column:
    """Spans of a rule in code points: the gaps between matches and the matches alternate through the text."""
    p = F.lit(pattern)
    found = F.regexp_extract_all(text, p, F.lit(0))
    parts = F.arrays_zip(found.alias("m"), F.slice(F.split(text, pattern, -1), 1, F.size(found)).alias("g"), F.regexp_extract_all(text, p, F.lit(group)).alias("v"))
    steps = F.transform(parts, lambda x: F.struct((F.length(x["g"]) + F.length(x["m"])).alias("step"), F.length(x["m"]).alias("n"), F.length(x["v"]).alias("counts")))
    spans = F.transform(
        F.filter(_running_ends(steps), lambda x: x["counts"] >= least),
        lambda x: F.struct((x["end"] - x["n"]).alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind")),
    )
    return F.when(F.regexp_like(text, p), spans).otherwise(F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>"))


def scan_blobs(blobs: DataFrame, rules=RULES) -> DataFrame:
    """(blob, text) to (blob, findings): all spans by start, then kind as listed."""
    found = F.sort_array(F.concat(*[_spans(F.col("text"), kind, i, p, g, n) for i, (kind, p, g, n) in enumerate(rules)]))
    return blobs.select("blob", found.alias("findings"))


def scan_secrets(files: DataFrame, path_col: str = "doc_id", text_col: str = "text", ledger: DataFrame | None = None, rules=RULES) -> tuple[DataFrame, DataFrame]:
    """Findings for all paths, and the ledger entries that this scan adds.

    Every content is addressed by its SHA-256. Of the (blob, rule version) pairs only those that ``ledger``
    (blob, rules, findings) does not hold are scanned, each blob once however many paths or versions
    have it; findings are joined back to all paths. Append the second result to the ledger.

    Returns (path, blob, findings) with one row per input row. A null text counts as empty and a null path is kept;
    an empty table gives empty results; equal rows are each returned.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    all_files = files.select(F.col(path_col).alias("path"), text.alias("text"), F.sha2(text, 256).alias("blob"))
    names = stash(all_files.select("path", "blob"))
    version = rule_version(rules)
    new = names.groupBy("blob").agg(F.min("path").alias("path"))
    if ledger is not None:
        new = new.join(ledger.where(F.col("rules") == version).select("blob"), "blob", "left_anti")
    # A path and a blob together: a content that very many paths have is looked up at one of them.
    new = stash(new.select(F.col("path").alias("new_path"), F.col("blob").alias("new_blob"))).hint("shuffle_hash")
    texts = all_files.join(new, (F.col("blob") == F.col("new_blob")) & F.col("path").eqNullSafe(F.col("new_path"))).select("blob", "text")
    scanned = scan_blobs(texts, rules).dropDuplicates(["blob"]).withColumn("rules", F.lit(version))
    scanned = stash(scanned.select("blob", "rules", "findings"))
    known = scanned if ledger is None else ledger.where(F.col("rules") == version).select("blob", "rules", "findings").unionByName(scanned)
    hits = known.where(F.size("findings") > 0).select("blob", "findings")
    joined = names.join(hits, "blob", "left")
    return joined.select("path", "blob", F.coalesce("findings", F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")).alias("findings")), scanned


def _joined(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over one ledger: the English documents first, then all of them, of which only unseen blobs are scanned."""
    docs = table(spark, sf_dir, "documents")
    _, ledger = scan_secrets(docs.where(F.col("lang") == "en"))
    found, _ = scan_secrets(docs, ledger=ledger)
    base = F.filter("findings", lambda x: x["rank"] < len(BASE))
    of = lambda k: F.size(F.filter("findings", lambda x: x["kind"] == k))
    counts = [of(k).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select(F.col("path").alias("doc_id"), *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("findings")).alias("spans"))


def _oracle() -> str:
    """The same scan as one SELECT; letters are spelt in both cases."""
    parts = []
    for i, (kind, pattern, group, least) in enumerate(RULES):
        if kind == "assign":
            words = ["password", "passwd", "secret", "token"]
            spelt = "|".join("".join(f"[{c.upper()}{c}]" for c in w) for w in words) + "|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
            pattern = f"({spelt})" + pattern.split(")", 2)[2]
        p = pattern.replace("'", "''")
        parts.append(
            f"list_filter(list_transform(range(1, len(regexp_extract_all(t, '{p}')) + 1), lambda i: {{'s': CAST(list_sum(list_transform(string_split_regex(t, '{p}')[1:i], lambda x: length(x))) "
            f"+ coalesce(list_sum(list_transform(regexp_extract_all(t, '{p}')[1:i-1], lambda x: length(x))), 0) AS INT), 'r': {i}, 'n': length(regexp_extract_all(t, '{p}')[i]), "
            f"'c': length(regexp_extract_all(t, '{p}', {group})[i]), 'k': '{kind}'}}), lambda x: x.c >= {least})"
        )
    joined = lambda cond: f"array_to_string(list_transform(list_filter(f, lambda x: {cond}), lambda x: x.k || ':' || x.s || ':' || (x.s + x.n)), ',')"
    counts = ", ".join(f"CAST(len(list_filter(f, lambda x: x.k = '{k}')) AS BIGINT) AS n_{k}" for k in BASE)
    return (
        f"WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), a AS (SELECT doc_id, list_sort({' || '.join(parts)}) AS f FROM d) "
        f"SELECT doc_id, {counts}, sha256({joined('x.r < 3')}) AS base_sha256, {joined('true')} AS spans FROM a"
    )


OP6_SQL = _oracle()
