"""File catalogue, filters over it, and stores of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Compression by extension, by leading bytes, and the archives that are no plain compressed files.
EXTENSIONS = {"gz": "gzip", "gzip": "gzip", "zst": "zstd", "zstd": "zstd", "xz": "xz", "bz2": "bz2", "bzip2": "bz2"}
MAGIC = {"1F8B": "gzip", "28B52FFD": "zstd", "FD377A585A00": "xz", "425A68": "bz2"}
ARCHIVES = r"(?i)\.(tar\.gz|tgz|tar\.zst|tzst|tar\.xz|txz|tar\.bz2|tbz2|tbz)$"
#: Compressions that Spark's text source does not decode.
UNREAD = ("xz", "zstd")
MAX_FILES = 1000
#: Bytes in which a NUL marks a binary file.
HEAD_BYTES = 8192


def compression_of(path: Column, content: Column | None = None) -> Column:
    """By extension, then by magic bytes; null for none and for compound archives."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    named = F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])[ext]
    if content is not None:
        head = F.hex(F.substring(content, 1, 6))
        named = F.coalesce(named, *[F.when(head.startswith(m), name) for m, name in MAGIC.items()])
    return F.when(~F.regexp_like(path, F.lit(ARCHIVES)), named)


def is_text(content: Column) -> Column:
    return ~F.contains(F.substring(content, 1, HEAD_BYTES), F.unhex(F.lit("00")))


def file_catalog(spark: SparkSession, paths: str | list[str], recursive: bool = True, peek: bool = False) -> DataFrame:
    """files(path, size_bytes, modified_at, compression[, is_text]); contents are read only to peek at their head."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(paths)
    out = [F.col("path"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at"), compression_of(F.col("path"), F.col("content") if peek else None).alias("compression")]
    return files.select(*out, *([is_text(F.col("content")).alias("is_text")] if peek else []))


def unread_files(spark: SparkSession, paths: str | list[str], recursive: bool = True) -> DataFrame:
    """Files that read_lines leaves out, with their compression as the reason; contents are not read."""
    files = file_catalog(spark, paths, recursive)
    return files.where(F.col("compression").isin(*UNREAD)).withColumn("reason", F.concat(F.lit("compression "), F.col("compression")))


def text_files(lines: DataFrame) -> DataFrame:
    """(file_id, is_text) from lines, without loading whole files: a NUL in the first bytes makes a file binary."""
    nul = F.contains(F.when(F.col("byte_start") < HEAD_BYTES, F.substring("line", 1, HEAD_BYTES)).otherwise(F.lit("")), F.lit("\x00"))
    return lines.groupBy("file_id").agg((~F.bool_or(nul)).alias("is_text"))


def scan_filter(files: DataFrame, max_files: int = MAX_FILES) -> tuple[DataFrame, DataFrame]:
    """Text files to scan, the first max_files by path, and the others, with the reason."""
    good = files.where(F.col("is_text"))
    kept = good.orderBy("path").limit(max_files)
    over = good.join(kept.select("path"), "path", "left_anti").withColumn("reason", F.lit("limit"))
    return kept, files.where(~F.col("is_text")).withColumn("reason", F.lit("binary")).unionByName(over)


def parent(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def dir_rollup(files: DataFrame) -> DataFrame:
    """(dir, n_files, total_bytes) of the files directly in each directory."""
    return files.groupBy(parent(F.col("path")).alias("dir")).agg(F.count("*").alias("n_files"), F.sum("size_bytes").alias("total_bytes"))


def dir_listing(files: DataFrame, directory: str) -> DataFrame:
    """Children of a directory, directories first, then by name."""
    base = directory.rstrip("/") + "/"
    rest = F.substring(F.col("path"), len(base) + 1, 1 << 20)
    inside = files.where(F.col("path").startswith(base)).select(F.substring_index(rest, "/", 1).alias("name"), F.contains(rest, F.lit("/")).alias("is_dir"), "size_bytes")
    return inside.groupBy("name", "is_dir").agg(F.count("*").alias("n_files"), F.sum("size_bytes").alias("total_bytes")).orderBy(F.desc("is_dir"), F.lower("name"))


def allowed_roots(files: DataFrame, roots: list[str]) -> DataFrame:
    """Files under one of the roots, by whole path parts; paths that climb are rejected."""
    under = [(F.col("path") == r) | F.col("path").startswith(r + "/") for r in (x.rstrip("/") for x in roots)]
    cond = under[0]
    for u in under[1:]:
        cond = cond | u
    return files.where(cond & ~F.regexp_like("path", F.lit(r"(^|/)\.\.(/|$)")))


def write_match_store(matches: DataFrame, path: str) -> None:
    """Matches with the hash of their patterns and the fingerprint of their file; a hash is written over as a whole."""
    matches.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("pattern_hash").parquet(path)


def write_file_index(tables: dict[str, DataFrame], path: str) -> None:
    """One Parquet table each for files, checkpoints, stats and anomalies."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def index_json(profile: DataFrame) -> DataFrame:
    """(file_id, json) for export."""
    return profile.select("file_id", F.to_json(F.struct("*")).alias("json"))
