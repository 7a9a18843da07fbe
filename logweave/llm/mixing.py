"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lookup_join, stash, table

WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
SEED = "mix-1"
SLICES = 64
#: Levels of large documents: those over 1 / 2 of their source's target, then those over 1 / 6, then those over 1 / 20. Whether one of them is
#: taken changes the words taken visibly.
LEVELS = (2, 6, 20)

#: Word count of a text: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """One row per source with its target: weighted shares of all sizes, capped and reshared.

    ``sizes(source, source_size)`` has one row per source. A target is min(cap, level * weight) with
    the one level at which the targets add up to all sizes; that is what resharing the
    excess by weight until no source is above its cap arrives at. The input is one row per source,
    already summed, so the ordered prefix sums run on it alone.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    array = F.array(*[F.lit(int(w)) for w in weights])
    s = sizes.withColumn("weight", F.element_at(array, F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))).cast("int") + 1))
    s = s.withColumn("cap", F.col("source_size") * max_repeat)
    #: Sources meet their cap in the order of cap / weight.
    ratio = F.col("cap") / F.col("weight").cast("double")
    fill = Window.orderBy(ratio, F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).orderBy(F.lit(0))
    s = s.withColumns({
        "all_size": F.sum("source_size").over(whole), "all_weight": F.sum("weight").over(whole),
        "caps": F.sum("cap").over(fill) - F.col("cap"), "weights": F.sum("weight").over(fill) - F.col("weight"),
    })
    left, share = F.col("all_size") - F.col("caps"), F.col("all_weight") - F.col("weights")
    s = s.withColumn("free", F.col("cap") * share > left * F.col("weight"))
    #: The first source below its cap sets the level for all that follow.
    at = Window.orderBy(~F.col("free"), ratio, F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumns({"left": F.first(left).over(at), "share": F.first(share).over(at)})
    target = F.when(F.col("free"), (F.col("left") * F.col("weight")).cast("double") / F.col("share")).otherwise(F.col("cap").cast("double"))
    return s.select("source", "source_size", "weight", target.alias("target"))


def _unit(*parts: Column) -> Column:
    """A number in [0, 1) from the MD5 of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def _copies(at: Column, target: str, size: str, max_repeat: int) -> Column:
    """Integers that the stretch of the at-th document crosses, each document being target / size long."""
    upto = lambda i: F.floor(i.cast("double") * F.col(target) / F.col(size) + F.col("offset"))
    crossed = F.when(F.col(size) > 0, upto(at) - upto(at - 1)).otherwise(F.lit(0))
    return F.least(crossed, F.lit(max_repeat)).cast("long")


def mix_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, max_repeat: int = MAX_REPEAT, seed: str = SEED, row_col: str | None = None) -> DataFrame:
    """How many copies of each document the mix takes.

    Each document of a source expects target / source_size copies. Documents are laid out by size, their
    expected copies summed along that order, one offset drawn for the source is added, and a
    document is emitted once for each integer that its stretch crosses. Order by size keeps the words
    taken near the target. Large documents come first, by LEVELS, and those of each level and at last all others
    expect an equal share of what the levels before leave of the target, so that a few large texts don't lead away from it. A source has at
    most 20 * source_size / target large ones, whatever its number of rows. For the others the running sum is made
    of counts: strata (size band, hash slice) are
    counted first, so that only positions inside a stratum need a sorted window and a source with a third of
    all rows is spread over many tasks.

    Returns doc_id, source, size, source_size, target, copies, taken; one row for each input row.
    A null text has size 0; a null source is a source of its own, the last; null ids are kept; an
    empty table gives an empty result. Equal rows share the copies of the stretch that they form. A row_col tells
    rows apart that share an id and a size, and is returned as row.
    """
    row = [F.col(row_col).alias("row")] if row_col else []
    more = ["row"] * bool(row_col)
    d = docs.select(
        *row, F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    band = F.length(F.bin("size")) * 4 + F.when(F.col("size") < 4, 0).otherwise(F.substring(F.bin("size"), 2, 2).cast("int").bitwiseAND(3))
    d = stash(d.withColumns({"band": band.cast("int"), "slice": F.conv(F.substring(key, 1, 4), 16, 10).cast("int") % SLICES}))
    targets = source_targets(d.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_repeat)
    drawn = _unit(F.lit(seed), F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("none")))
    targets = stash(targets.select("source", "source_size", "target", drawn.alias("offset")))
    order = ["size", F.col("doc_id").asc_nulls_last(), *more]
    level = F.lit(len(LEVELS))
    for i, share in reversed(list(enumerate(LEVELS))):
        level = F.when(F.col("size") * share > F.col("target"), i).otherwise(level)
    named = lookup_join(d, targets, "source", salt="slice").withColumn("level", level)
    rest = targets.select("source", F.col("source_size").alias("rest_size"), F.col("target").alias("rest_target"))
    kept = [*more, "doc_id", "source", "size", "source_size", "target", "copies"]
    done = []
    for i in range(len(LEVELS)):
        here = lookup_join(named.where(F.col("level") == i), rest, "source").withColumn("at", F.row_number().over(Window.partitionBy("source").orderBy(*order)))
        here = stash(here.withColumn("copies", _copies(F.col("at"), "rest_target", "rest_size", max_repeat)).select(*kept))
        done.append(here)
        met = here.groupBy(F.col("source").alias("s2")).agg(F.sum("size").alias("met_size"), F.sum(F.col("copies") * F.col("size")).alias("met_taken"))
        after = rest.join(met, F.expr("source <=> s2"), "left").fillna(0, ["met_size", "met_taken"]).withColumn("rest_size", F.col("rest_size") - F.col("met_size"))
        left = F.greatest(F.lit(0.0), F.least(F.col("rest_target") - F.col("met_taken"), (F.col("rest_size") * max_repeat).cast("double")))
        rest = stash(after.select("source", "rest_size", left.alias("rest_target")))

    small = named.where(F.col("level") == len(LEVELS))
    strata = small.groupBy("source", "band", "slice").agg(F.count("*").alias("n"))
    before = Window.partitionBy("source").orderBy("band", "slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    strata = strata.withColumn("ahead", F.sum("n").over(before) - F.col("n"))
    info = strata.alias("a").join(rest.alias("t"), F.expr("a.source <=> t.source")).select(
        F.col("a.source").alias("s_source"), F.col("a.band").alias("s_band"), F.col("a.slice").alias("s_slice"), "ahead", "rest_size", "rest_target"
    )
    inside = Window.partitionBy("source", "band", "slice").orderBy(*order)
    small = small.withColumn("at", F.row_number().over(inside)).join(info, F.expr("source <=> s_source AND band = s_band AND slice = s_slice"))
    small = small.withColumn("copies", _copies(F.col("ahead") + F.col("at"), "rest_target", "rest_size", max_repeat)).select(*kept)
    return reduce(DataFrame.unionByName, done, small).withColumn("taken", F.col("copies") * F.col("size"))


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_copies(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


OP10_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
k AS (SELECT *, length(bin(size)) * 4 + CASE WHEN size < 4 THEN 0 ELSE CAST(substr(bin(size), 2, 2) AS INT) & 3 END AS band,
  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 4) AS INT) % 64 AS slice FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM k GROUP BY source),
w AS (SELECT *, [5, 2, 1][CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS INT) + 1] AS weight, source_size * 3 AS cap FROM s),
f AS (SELECT *, sum(source_size) OVER () AS all_size, sum(weight) OVER () AS all_weight,
  coalesce(sum(cap) OVER (ORDER BY CAST(cap AS DOUBLE) / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caps,
  coalesce(sum(weight) OVER (ORDER BY CAST(cap AS DOUBLE) / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weights FROM w),
g AS (SELECT *, cap * (all_weight - weights) > (all_size - caps) * weight AS free FROM f),
l AS (SELECT all_size - caps AS lft, all_weight - weights AS shr FROM g WHERE free ORDER BY CAST(cap AS DOUBLE) / weight, source ASC NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN free THEN CAST((SELECT lft FROM l) * weight AS DOUBLE) / (SELECT shr FROM l) ELSE CAST(cap AS DOUBLE) END AS target,
  CAST(CAST('0x' || substr(md5('mix-1:' || coalesce('s' || source, 'none')), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0 AS u FROM g),
n AS (SELECT k.*, source_size, target, u, CASE WHEN size * 2 > target THEN 0 WHEN size * 6 > target THEN 1 WHEN size * 20 > target THEN 2 ELSE 3 END AS level FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source),
e0 AS (SELECT source, source_size AS rest_size, target AS rest_target FROM t)@@,
r AS (SELECT n.*, rest_size, rest_target, row_number() OVER (PARTITION BY n.source ORDER BY band, slice, size, doc_id ASC NULLS LAST) AS i FROM n JOIN e3 ON n.source IS NOT DISTINCT FROM e3.source WHERE level = 3),
c AS (SELECT *, CASE WHEN rest_size > 0 THEN least(3, CAST(floor(CAST(i AS DOUBLE) * rest_target / rest_size + u) - floor(CAST(i - 1 AS DOUBLE) * rest_target / rest_size + u) AS BIGINT)) ELSE 0 END AS copies FROM r
  UNION ALL SELECT * FROM c0 UNION ALL SELECT * FROM c1 UNION ALL SELECT * FROM c2)
SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken, CAST(copies AS BIGINT) AS copies FROM c
""".replace("@@", "".join(f""",
b{i} AS (SELECT n.*, rest_size, rest_target, row_number() OVER (PARTITION BY n.source ORDER BY size, doc_id ASC NULLS LAST) AS i FROM n JOIN e{i} ON n.source IS NOT DISTINCT FROM e{i}.source WHERE level = {i}),
c{i} AS (SELECT *, CASE WHEN rest_size > 0 THEN least(3, CAST(floor(CAST(i AS DOUBLE) * rest_target / rest_size + u) - floor(CAST(i - 1 AS DOUBLE) * rest_target / rest_size + u) AS BIGINT)) ELSE 0 END AS copies FROM b{i}),
m{i} AS (SELECT source, sum(size) AS met_size, sum(copies * size) AS met_taken FROM c{i} GROUP BY source),
e{i + 1} AS (SELECT e.source, CAST(rest_size - coalesce(met_size, 0) AS BIGINT) AS rest_size,
  greatest(CAST(0 AS DOUBLE), least(rest_target - coalesce(met_taken, 0), CAST((rest_size - coalesce(met_size, 0)) * 3 AS DOUBLE))) AS rest_target FROM e{i} e LEFT JOIN m{i} m ON e.source IS NOT DISTINCT FROM m.source)""" for i in range(3)))
