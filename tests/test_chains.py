"""Greedy chains in blocks against the fold that they stand for, and rankings by block."""

import random

import pytest
from pyspark.sql import functions as F

from logweave.functions import chains
from logweave.operators import ranges, stats


def fold(places, step, gap):
    """The start of each place's link, going through all of them in order."""
    out, start, last = [], None, None
    for p in sorted(places):
        if start is None or p >= start + step or gap is not None and p - last > gap:
            start = p
        last = p
        out.append((p, start))
    return out


def many(rng, n, far):
    at, out = rng.randrange(1000), []
    for _ in range(n):
        at += rng.choice((0, 1, 1, 2, 3, rng.randrange(far)))
        out.append(at)
    return out


@pytest.mark.parametrize(("span", "step", "gap"), [(1, 7, 2), (2, 20, 2), (3, 5, None), (32, 20, 2), (1, 300, None), (2, 1, 0), (4, 11, 40)])
def test_equals_fold(spark, monkeypatch, span, step, gap):
    """Keys, one of them null, with runs inside blocks, over blocks, with blocks left out, equal places; rows in any order."""
    monkeypatch.setattr(chains, "SPAN", span)
    rng = random.Random(span * 100 + step)
    places = {k: many(rng, n, far) for k, n, far in (("a", 400, 3), ("b", 300, 90), (None, 200, 5), ("c", 1, 2), ("d", 60, 2000))}
    rows = [(k, x, p, "y") for k, ps in places.items() for p in ps for x in ("x",)]
    rng.shuffle(rows)
    df = spark.createDataFrame([*rows, ("a", "x", None, "y")], "k string, x string, p long, block string").repartition(3)
    got = sorted(((r.k, r.p, r.chain_start) for r in chains.chain_starts(df, ["k", "x"], "p", step, gap).collect()), key=str)
    assert got == sorted(((k, p, s) for k, ps in places.items() for p, s in fold(ps, step, gap)), key=str)
    opening = sorted(((r.k, r.p) for r in chains.chain_starts(df, ["k", "x"], "p", step, gap, opening=True).collect()), key=str)
    assert opening == sorted({(k, p) for k, ps in places.items() for p, s in fold(ps, step, gap) if p == s}, key=str)


def test_empty(spark):
    df = spark.createDataFrame([], "k string, p long")
    assert chains.chain_starts(df, ["k"], "p", 5).collect() == []


def test_one_noisy_file_is_many_tasks(spark):
    """One file in which each line hits: the fold's ranges, one exchange of hits for both passes, and no window or gathered array of a file."""
    n = 400_000
    hits = spark.range(1, n + 1, 1, 4).select(F.lit("f").alias("file_id"), F.lit("d").alias("detector"), F.col("id").alias("line_no"), (F.col("id") % 7 / 10).alias("severity"))
    merged = ranges.merge_ranges(hits)
    got = sorted((r.start_line, r.end_line, r.n_hits, r.severity) for r in merged.collect())
    assert got == [(a, min(a + 999, n), min(1000, n - a + 1), 0.6) for a in range(1, n + 1, 1000)]
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "collect_list" not in plan
    blocks = hits.select(F.spark_partition_id(), F.floor(F.col("line_no") / (chains.SPAN * 1000))).distinct().count()
    assert blocks >= n // (chains.SPAN * 1000)


def test_chain_of_long_file(spark):
    """Lines of uneven length in one file: the chain of the fold."""
    lines = spark.range(0, 100_000, 1, 3).select(F.lit("f").alias("file_id"), (F.col("id") + 1).alias("line_no"), (F.col("id") * 90 + F.pmod(F.xxhash64("id"), F.lit(80))).alias("byte_start"))
    places = [(r.byte_start, r.line_no) for r in lines.collect()]
    number = dict(places)
    want = sorted((number[p], p) for p, s in fold([p for p, _ in places], 4096, None) if p == s)
    assert sorted((r.line_no, r.byte_offset) for r in stats.checkpoint_chain(lines, 4096).collect()) == want


@pytest.mark.parametrize("block", [65_536, 10])
def test_ranks_do_not_depend_on_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(ranges, "BLOCK_LINES", block)
    rng = random.Random(8)
    hits = [(f, n, rng.choice((0.3, 0.5, 0.9)), d) for f in ("a", "b", None) for d in ("x", "y") for n in range(1, 200) if rng.random() < 0.5]
    df = spark.createDataFrame(hits, "file_id string, line_no long, severity double, detector string").repartition(3)
    key = lambda h: (-h[2], h[1], h[3])
    want = [h for f in ("a", "b", None) for h in sorted((x for x in hits if x[0] == f), key=key)[:60]]
    assert sorted(map(tuple, ranges.cap_hits(df, 60).collect()), key=str) == sorted(want, key=str)
    r = df.where("file_id is not null").select("file_id", F.col("line_no").alias("start_line"), "severity", "detector")
    totals = spark.createDataFrame([("a", 1200), ("b", 10)], "file_id string, n_lines long")
    want = [h for f, k in (("a", 60), ("b", 50)) for h in sorted((x for x in hits if x[0] == f), key=key)[:k]]
    assert sorted(map(tuple, ranges.density_cap(r, totals).collect())) == sorted(want)
