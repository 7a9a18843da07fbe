"""Search with an index: bitmaps of trigrams by block of lines, and what each regex needs of them."""

from __future__ import annotations

import re
from collections.abc import Iterator
from re import _constants as sre
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.lines import COLUMNS, text
from .trace import named, trace

#: Lines of a block, bits of its bitmap (those of Spark's bitmap functions), and bytes of a row group of stored lines.
BLOCK_LINES, BITS, ROW_GROUP = 512, 32_768, 1 << 20
#: Ranges of blocks by which stored lines are read at most; near ones are joined beyond that.
RANGES = 512
#: Up to so many patterns are looked for by one alternation; more are compared pair by pair of block and pattern.
FEW = 16
#: Pairs that are broadcast at most; a pair is a number, a short id and a pattern.
PAIRS = 100_000
#: What the two regex dialects read differently; such a pattern needs nothing, so that all blocks are read.
_UNSURE = re.compile(r"\[\[|\[\^\[|&&|\\[QEvVhHRXGpP0ce]|\(\?[a-zA-Z]*[xUdu]")
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def needs(pattern: str, fixed: bool = False) -> list:
    """What a text that matches holds for sure: a list of which all are needed, of literals in bytes, ASCII letters lower-cased, and of tuples of such lists, of each of which one is."""
    if fixed:
        return [pattern.encode().translate(_LOWER)]
    if _UNSURE.search(pattern):
        return []
    try:
        return _needs(_parser.parse(pattern), bool(re.match(r"\(\?[a-z]*i", pattern)))
    except (re.error, RecursionError, OverflowError):
        return []


def _needs(parsed, fold: bool) -> list:
    out: list = []
    run = b""
    for kind, value in parsed:
        if kind is sre.LITERAL and (value < 128 or not fold):
            run += chr(value).encode("utf-8", "replace").translate(_LOWER)
            continue
        if kind is sre.AT:
            # Anchors and word bounds take no characters.
            continue
        out.append(run)
        run = b""
        if kind is sre.SUBPATTERN:
            out += _needs(value[3], fold or bool(value[1] & re.IGNORECASE))
        elif kind in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
            if value[0] > 0:
                out += _needs(value[2], fold)
        elif kind is sre.ATOMIC_GROUP:
            out += _needs(value, fold)
        elif kind is sre.BRANCH:
            ways = [_needs(way, fold) for way in value[1]]
            if all(ways):
                out.append(tuple(ways))
    out.append(run)
    return [x for x in out if isinstance(x, tuple) or len(x) >= 3]


def _bits(grams: np.ndarray) -> np.ndarray:
    """Bit of each trigram, given as its three bytes in a number."""
    return ((grams.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(49)).astype(np.int64)


def _grams(raw: np.ndarray) -> np.ndarray:
    wide = raw.astype(np.int64)
    return wide[:-2] << 16 | wide[1:-1] << 8 | wide[2:]


def _holds(need: list, bits: np.ndarray) -> np.ndarray:
    """Which rows of bits (blocks, BITS) may hold all that is needed."""
    good = np.ones(len(bits), bool)
    for x in need:
        if isinstance(x, tuple):
            some = np.zeros(len(bits), bool)
            for way in x:
                some |= _holds(way, bits)
            good &= some
        else:
            good &= bits[:, np.unique(_bits(_grams(np.frombuffer(x, np.uint8))))].all(axis=1)
    return good


def write_search_index(lines: DataFrame, path: str, block_lines: int = BLOCK_LINES) -> None:
    """Store lines by file and number with their block, and a bitmap of the trigrams of each block.

    Lines are sorted by ranges, so that a file may be many tasks; blocks are runs of block_lines in that order, and lie together in small row groups, so
    that Parquet statistics leave out those that a search does not need. ASCII letters count as lower-case.
    """
    spark = lines.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = lines.select(*COLUMNS).repartitionByRange(tasks, "file_id", "line_no").sortWithinPartitions("file_id", "line_no")

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, seen = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            block = base + (seen + np.arange(batch.num_rows)) // block_lines
            seen += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(block)], [*COLUMNS, "block"])

    kinds = ", ".join(f"{c} {lines.schema[c].dataType.simpleString()}" for c in COLUMNS)
    ordered.mapInArrow(numbered, f"{kinds}, block long").write.mode("overwrite").option("parquet.block.size", str(ROW_GROUP)).parquet(f"{path}/lines")

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block, line = batch.column(0).to_numpy(), batch.column(1).fill_null("").cast(pa.large_binary())
            offs = np.frombuffer(line.buffers()[1], np.int64)[line.offset : line.offset + len(line) + 1]
            raw = np.frombuffer(line.buffers()[2] or b"", np.uint8)
            edges = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(block)] if len(block) else [0]
            out = []
            for a, b in zip(edges[:-1], edges[1:]):
                part = np.frombuffer(raw[offs[a] : offs[b]].tobytes().translate(_LOWER), np.uint8)
                # A trigram of two lines does no harm: it only makes a block a candidate.
                held = np.zeros(BITS, bool)
                held[_bits(_grams(part))] = True
                out.append((int(block[a]), b - a, np.packbits(held, bitorder="little").tobytes()))
            columns = list(zip(*out)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary()))], ["block", "n_lines", "bits"])

    stored = spark.read.parquet(f"{path}/lines")
    parts = stored.select("block", "line").mapInArrow(mapped, "block long, n_lines long, bits binary")
    parts.groupBy("block").agg(F.sum("n_lines").alias("n_lines"), F.bitmap_or_agg("bits").alias("bits")).write.mode("overwrite").parquet(f"{path}/blocks")


def candidate_blocks(spark: SparkSession, path: str, patterns: list[str] | dict[str, str], flags: str = "") -> DataFrame:
    """(block, pattern_id): the blocks of an index that may have a match of each pattern. All patterns are tested in one pass over the bitmaps."""
    items = patterns if isinstance(patterns, dict) else {f"p{i}": p for i, p in enumerate(patterns, 1)}
    wanted = [(i, needs(p if "F" in flags else f"(?i){p}" if "i" in flags else p, "F" in flags)) for i, p in items.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                bits = np.unpackbits(np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint8).reshape(part.num_rows, BITS // 8), axis=1, bitorder="little").astype(bool)
                for i, need in wanted:
                    found = part.column(0).filter(pa.array(_holds(need, bits)))
                    yield pa.RecordBatch.from_arrays([found, pa.array([i] * len(found), pa.string())], ["block", "pattern_id"])

    return spark.read.parquet(f"{path}/blocks").select("block", "bits").mapInArrow(run, "block long, pattern_id string")


def _within(pairs: DataFrame, total: int) -> list[tuple[int, int]]:
    """At most RANGES ranges of blocks that hold all candidates, one row each to the driver."""
    # Blocks of a task are numbered from its own base; zones are equal parts of these.
    part, number = F.shiftright("block", 32), F.col("block").bitwiseAND(F.lit((1 << 32) - 1))
    tasks = max(pairs.select(part.alias("p")).distinct().count(), 1)
    zones = max(RANGES // tasks, 1)
    if tasks > RANGES:
        part = F.floor(part / F.lit(-(-tasks // RANGES)))
    wide = F.greatest(F.ceil(F.lit(total / tasks / zones)), F.lit(1))
    found = pairs.groupBy(part.alias("p"), F.least(F.floor(number / wide), F.lit(zones - 1)).alias("z")).agg(F.min("block").alias("a"), F.max("block").alias("b"))
    out: list[tuple[int, int]] = []
    for a, b in sorted((r.a, r.b) for r in found.collect()):
        if out and a == out[-1][1] + 1:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def _any_of(ranges: list[tuple[int, int]]) -> Column:
    """Whether a block is in one of the ranges, as a balanced tree: a chain of as many terms overflows the stack of Catalyst."""
    if len(ranges) <= 1:
        return F.col("block").between(*ranges[0]) if ranges else F.lit(False)
    half = len(ranges) // 2
    return _any_of(ranges[:half]) | _any_of(ranges[half:])


def indexed_trace(spark: SparkSession, path: str, patterns: list[str] | dict[str, str], flags: str = "") -> DataFrame:
    """What ``trace`` finds in the lines of an index, whose other blocks are not read.

    Candidates come from the bitmaps; Parquet leaves out row groups outside of their ranges. Few patterns go through one
    alternation. Many are joined to their candidate blocks, so that a line meets only those patterns that its block may have; each pattern's lines of a block
    follow each other, so that it is compiled once for them.
    """
    pairs = candidate_blocks(spark, path, patterns, flags).persist()
    total = spark.read.parquet(f"{path}/blocks").count()
    lines = spark.read.parquet(f"{path}/lines")
    n_pairs = pairs.count()
    ranges = _within(pairs, total)
    pairs.unpersist()
    lines = lines.where(_any_of(ranges))
    finished = named(patterns, flags)
    if len(finished) <= FEW:
        return trace(lines.drop("block"), patterns, flags)
    known = spark.createDataFrame(list(finished.items()), "pattern_id string, pattern string")
    wanted = candidate_blocks(spark, path, patterns, flags).join(F.broadcast(known), "pattern_id")
    met = lines.join(wanted.hint("broadcast") if n_pairs <= PAIRS else wanted, "block").sortWithinPartitions("block", "pattern_id")
    return met.where(F.regexp_like(text(), F.col("pattern"))).select(*COLUMNS, "pattern_id")


def search_report(spark: SparkSession, path: str, patterns: list[str] | dict[str, str], flags: str = "") -> DataFrame:
    """(pattern_id, n_candidates, n_blocks): how many blocks a search reads for each pattern, of how many; also none."""
    names = named(patterns, flags)
    blocks = spark.read.parquet(f"{path}/blocks").agg(F.count("*").alias("n_blocks"))
    counts = candidate_blocks(spark, path, patterns, flags).groupBy("pattern_id").agg(F.count("*").alias("n"))
    all_ = spark.createDataFrame([(i,) for i in names], "pattern_id string")
    return all_.join(counts, "pattern_id", "left").crossJoin(F.broadcast(blocks)).select("pattern_id", F.coalesce("n", F.lit(0)).alias("n_candidates"), "n_blocks")
