"""Reuse of earlier results: pattern hashes, stale files, incremental scans."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.commits import MOST_FOLDERS, CommitLog
from ..sources.lines import read_lines
from .trace import match_context, trace, with_submatches

KEY = ("path", "size_bytes", "modified_at")
#: Flags that change what matches.
RELEVANT = "iwxF"


def pattern_hash(patterns: list[str], flags: str = "") -> str:
    """The same for any order of the patterns, and for flags that do not change what matches."""
    return hashlib.sha256(json.dumps([sorted(patterns), sorted(set(flags) & set(RELEVANT))]).encode()).hexdigest()[:16]


def stale_files(files: DataFrame, store: DataFrame, digest: str | None = None) -> DataFrame:
    """Files that the store does not hold with the same size and time (and pattern hash)."""
    known = store if digest is None else store.where(F.col("pattern_hash") == digest)
    return files.join(known.select(*KEY).distinct(), list(KEY), "left_anti")


def incremental_trace(lines: DataFrame, files: DataFrame, patterns: list[str], store: DataFrame, flags: str = "") -> tuple[DataFrame, DataFrame]:
    """Matches of all files, and the store's new rows: stored matches of fresh files, and a scan of the stale ones alone.

    A file without matches is stored as a row without a line, so that it counts as known. Line numbers are absolute.
    """
    digest = pattern_hash(patterns, flags)
    stale = stale_files(files, store, digest)
    found = trace(lines.join(stale.select(F.col("path").alias("file_id")), "file_id", "left_semi"), patterns, flags)
    new = stale.join(found.select(F.col("file_id").alias("path"), "pattern_id", "line_no", "byte_start"), "path", "left").withColumn("pattern_hash", F.lit(digest))
    new = new.select("pattern_hash", *KEY, "pattern_id", "line_no", "byte_start")
    kept = store.where(F.col("pattern_hash") == digest).join(files.select(*KEY), list(KEY), "left_semi").select(*new.columns)
    return kept.unionByName(new).where(F.col("line_no").isNotNull()), new


MATCHES = "path string, size_bytes long, modified_at timestamp, pattern_id string, line_no long, byte_start long"


def refresh_matches(log: CommitLog, files: DataFrame, read: Callable[[DataFrame], DataFrame], patterns: list[str], flags: str = "") -> DataFrame:
    """(path, size_bytes, modified_at, pattern_id, line_no, byte_start, scanned): matches of all files(path, size_bytes, modified_at), from a store that this call brings up to date.

    read gets the files that the store does not hold as they are, and gives their lines; it is where the source is cut down to them, so that
    texts of other files are not read (``stale_lines`` for text files). What it finds is written aside and then committed as a whole: a run that ends before leaves the store as
    it was, and a run that another one has overtaken fails with Conflict. Each file is in the store with its size and time, and one without a match as a
    row without a line; older states of a file stay until the folders of a pattern set, MOST_FOLDERS at most, are written anew. scanned marks what this call has searched.
    """
    digest = pattern_hash(patterns, flags)
    store = log.read(digest, MATCHES)
    files = files.select(*KEY)
    stale = stale_files(files, store)
    fresh = store.join(files, list(KEY), "left_semi")
    folders = log.folders.get(digest, [])
    if not stale.isEmpty():
        found = trace(read(stale), patterns, flags).select(F.col("file_id").alias("path"), "pattern_id", "line_no", "byte_start")
        new = stale.join(found, "path", "left").select(*[c.split()[0] for c in MATCHES.split(", ")])
        added = log.stage(new)
        if len(folders) + 1 > MOST_FOLDERS:
            both = fresh.unionByName(log.spark.read.schema(MATCHES).parquet(f"{log.path}/data/{added}"))
            log.commit(digest, [log.stage(both)])
        else:
            log.commit(digest, [*folders, added])
        scanned = log.spark.read.schema(MATCHES).parquet(f"{log.path}/data/{added}")
    else:
        scanned = log.spark.createDataFrame([], MATCHES)
    out = fresh.withColumn("scanned", F.lit(False)).unionByName(scanned.withColumn("scanned", F.lit(True)))
    return out.where(F.col("line_no").isNotNull())


def stale_lines(log: CommitLog) -> Callable[[DataFrame], DataFrame]:
    """For refresh_matches over text files: reads the given files only. Their paths go to the driver, as those of any files that Spark reads do."""

    def read(stale: DataFrame) -> DataFrame:
        return read_lines(log.spark, [r.path for r in stale.select("path").collect()])

    return read


def rehydrate_matches(store: DataFrame, lines: DataFrame, patterns: list[str], before: int = 0, after: int = 0, flags: str = "") -> tuple[DataFrame, DataFrame]:
    """Text, submatches and context of stored matches, from the lines."""
    m = store.where(F.col("line_no").isNotNull()).select(F.col("path").alias("file_id"), "pattern_id", "line_no")
    rows = with_submatches(lines.join(m, ["file_id", "line_no"]), patterns, flags)
    return rows, match_context(lines, rows, before, after)


def incremental_index(files: DataFrame, store: DataFrame, analyze: bool = False) -> DataFrame:
    """Files to index: missing, changed, or not analysed yet where that is asked for."""
    known = store.where(F.col("analysis_performed")) if analyze else store
    return stale_files(files, known)


def merge_file_sets(*sets: DataFrame) -> DataFrame:
    out = sets[0]
    for s in sets[1:]:
        out = out.unionByName(s)
    return out.distinct()
