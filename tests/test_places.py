"""Submatches, chains of checkpoints, as-of look-ups and blocks of lines against plain versions; stores, metrics and sets of files."""

import random
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from logweave.functions import extend
from logweave.functions import windows as W
from logweave.operators import incremental, ranges, samples, stats, trace
from logweave.sources import files


def numbered(spark, rows, file="f1"):
    at, out = 0, []
    for i, line in enumerate(rows, 1):
        out.append((file, i, at, len((line or "").encode()), line))
        at += len((line or "").encode()) + 1
    return spark.createDataFrame(out, "file_id string, line_no long, byte_start long, byte_len int, line string")


@pytest.mark.parametrize("pattern", ["a*", "é|b+", r"(a)(b)?\1", r"\b", "x", "$", "(?=a)"])
def test_submatches_are_those_of_a_plain_scan(spark, pattern):
    texts = ["", "a", "baac", "ébbé aa", "aba aa\tx", "$1 a$", "aaaa", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.t: r.m and [(x.text, x.start, x.end) for x in r.m] for r in df.select("t", trace.submatches(F.col("t"), pattern).alias("m")).collect()}
    n = lambda t, i: len(t[:i].encode())
    for t in texts:
        want = None if t is None else [(m.group(), n(t, m.start()), n(t, m.end())) for m in re.finditer(pattern, t)]
        assert got[t] == want, t


def test_submatches_of_text_with_line_feeds(spark):
    row = spark.sql("SELECT 'b\\naa\\n\\na' AS t").select(trace.submatches(F.col("t"), "a+").alias("m")).first()
    assert [tuple(x) for x in row.m] == [("aa", 2, 4), ("a", 6, 7)]


def test_checkpoint_chain(spark):
    rng = random.Random(5)
    want, df = [], None
    for file in ("a", "b", None):
        rows = ["x" * rng.randrange(0, 90) for _ in range(400)]
        one = numbered(spark, rows, file)
        due = 0
        for _, n, at, _, _ in one.orderBy("line_no").collect():
            if at >= due:
                want.append((file, n, at))
                due = at + 100
        df = one if df is None else df.unionByName(one)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    got = [tuple(r) for r in stats.checkpoint_chain(df.repartition(5), 100).collect()]
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(got, key=str) == sorted(want, key=str)
    assert stats.checkpoint_chain(df.where("false"), 100).collect() == []


@pytest.mark.parametrize("size", [4096, 5])
def test_nearest_checkpoints_by_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(samples, "LINES", size)
    monkeypatch.setattr(samples, "BUCKET", size)
    rng = random.Random(size)
    marks = [(f, n, n * 3) for f in ("a", "b", None) for n in rng.sample(range(10, 90), 12)]
    asked = [(f, t) for f in ("a", "b", None, "none") for t in [*range(0, 300, 4), None]]
    cps = spark.createDataFrame(marks, "file_id string, line_no long, byte_offset long")
    targets = spark.createDataFrame(asked, "file_id string, target long")
    for by, k in (("line_no", 1), ("byte_offset", 2)):
        want = []
        for f, t in asked:
            own = sorted(m[1:] for m in marks if m[0] == f)
            if t is not None:
                at = [c for c in own if c[k - 1] <= t]
                after = next((c for c in own if c[k - 1] > t), None)
                here = at[-1] if at else own[0] if own else (1, 0)
                want.append((f, t, *here, after if at else None, bool(own)))
        got = [(r.file_id, r.target, r.line_no, r.byte_offset, r.next and tuple(r.next), r.found) for r in samples.nearest_checkpoint(cps, targets, by).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("size", [65_536, 3])
def test_multiline_blocks_by_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(W, "with_block", lambda rows, n=0: rows.withColumn("lblock", F.floor((F.col("line_no") - 1) / size)))
    rng = random.Random(1)
    rows = [rng.choice(["S", "S go", "go", "go", "go", "no", None]) for _ in range(200)]
    want, held = [], None
    for i, line in enumerate(rows, 1):
        if line is not None and line.startswith("S"):
            held = [i, i, [line]]
            want.append(held)
        elif held and line is not None and "go" in line:
            held[1], held[2] = i, [*held[2], line]
        else:
            held = None
    got = ranges.multiline_blocks(numbered(spark, rows), F.col("line").startswith("S"), F.col("line").contains("go")).orderBy("start_line").collect()
    assert [(r.start_line, r.end_line, r.n_lines, r.block) for r in got] == [(a, b, len(x), "\n".join(x)) for a, b, x in want]


def test_metrics_sets_and_stores(spark, tmp_path):
    lines = numbered(spark, ["ab", "", "abc"])
    assert [r.width for r in extend.line_metric(lines, "width", lambda s: s.str.len().astype("float64")).orderBy("line_no").collect()] == [2.0, 0.0, 3.0]
    one, two = (spark.createDataFrame([(p,) for p in x], "path string") for x in ("ab", "bc"))
    assert sorted(r.path for r in incremental.merge_file_sets(one, two).collect()) == ["a", "b", "c"]
    store = str(tmp_path / "store")
    hits = lambda h, *n: spark.createDataFrame([(i, h) for i in n], "line_no long, pattern_hash string")
    for h in (hits("x", 1, 2), hits("y", 3), hits("x", 4)):
        files.write_match_store(h, store)
    assert sorted((r.pattern_hash, r.line_no) for r in spark.read.parquet(store).collect()) == [("x", 4), ("y", 3)]
    files.write_file_index({"stats": stats.line_stats(lines), "checkpoints": stats.checkpoints(lines)}, str(tmp_path / "index"))
    assert spark.read.parquet(str(tmp_path / "index" / "stats")).first().n_lines == 3
    assert pd.Series([r.json for r in files.index_json(spark.createDataFrame([("f", 2)], "file_id string, n long")).collect()]).tolist() == ['{"file_id":"f","n":2}']


def test_texts_are_not_dealt_for_indents_and_regexes_run_once(spark):
    """Indents are found before lines are numbered, and an exploded list of submatches is not made twice."""
    from logweave.plans import catalog

    plan = lambda name: catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan()

    def nodes(node):
        yield node
        for i in range(node.children().size()):
            yield from nodes(node.children().apply(i))

    windows = [n.output().mkString(",") for n in nodes(plan("detect_indentation")) if n.nodeName() == "Window"]
    assert len(windows) >= 2 and all(not re.search(r"\bline#", w) for w in windows)
    for name in ("submatches", "empty_submatches"):
        assert plan(name).toString().count("regexp_replace(regexp_replace") == 1
