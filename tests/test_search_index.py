"""Search with an index: what patterns need, blocks that are left out, and the matches of the plain search."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logweave.functions.scratch import scratch
from logweave.operators import search_index as X
from logweave.operators.trace import trace
from logweave.sources.lines import lines_from_column


@pytest.mark.parametrize(
    ("pattern", "want"),
    [
        ("license", [b"license"]), ("LICENSE", [b"license"]), ("ab", []), ("a.c", []), ("abc.*defg", [b"abc", b"defg"]), ("abc|de", []), ("abc|def", [([b"abc"], [b"def"])]), ("x(abc)+y", [b"abc"]), ("x(abc)*y", []),
        (r"\bword\b", [b"word"]), ("^from: .*$", [b"from: "]), ("[ab]cdef", [b"cdef"]), ("cafés", ["cafés".encode()]), ("(?i)cafétier", [b"caf", b"tier"]), ("(?=abc)d", []), ("abc{2,3}", []),
        ("(abc|xyz(123|456)?)", [([b"abc"], [b"xyz"])]), (r"\Qa.b\E", []), (r"\p{L}abc", []), ("[a&&b]cde", []), ("(", []), ("a{3}bcd", [b"bcd"]), ("(?x)a b c", []),
    ],
)
def test_needs(pattern, want):
    assert X.needs(pattern) == want


def test_needs_of_fixed_strings():
    assert X.needs("A.b*", fixed=True) == [b"a.b*"]


def met(need, text):
    return all(any(met(way, text) for way in x) if isinstance(x, tuple) else x in text for x in need)


@settings(max_examples=300, deadline=None)
@given(st.data())
def test_matches_hold_what_is_needed(data):
    """A text made to match a random pattern holds all that the pattern needs."""
    part = st.recursive(st.sampled_from(["a", "b", "abc", "Cde", "[ab]", ".", r"\d", "xyz", r"\b", "é"]), lambda x: st.one_of(st.tuples(x, x).map("".join), st.tuples(x, x).map(lambda p: f"(?:{p[0]}|{p[1]})"), x.map(lambda p: f"({p})+"), x.map(lambda p: f"({p})?")), max_leaves=12)
    pattern = data.draw(part)
    text = data.draw(st.from_regex(pattern, fullmatch=False))
    if re.search(pattern, text):
        assert met(X.needs(pattern), text.encode("utf-8", "replace").translate(X._LOWER))


@pytest.fixture(scope="module")
def lines(spark):
    return lines_from_column(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "doc_id", "text").cache()


@pytest.fixture(scope="module")
def path(spark, lines):
    where = scratch(spark, "index")
    X.write_search_index(lines, where, 64)
    return where


def rows(df):
    return sorted((r.file_id, r.line_no, r.byte_start, r.byte_len, r.line, r.pattern_id) for r in df.collect())


@pytest.mark.parametrize(
    ("patterns", "flags"),
    [(["license"], ""), (["LICENSE", "token"], "i"), (["the", "license"], "w"), (["a.b", "token = "], "F"), (["nowhere to be found"], ""), ([r"tok[a-z]+ = \"[0-9a-f]{40}", "zzzz|GPL"], ""), (["."], ""), ([r"All rights reserved\."], "x")],
)
def test_equals_plain_search(spark, lines, path, patterns, flags):
    got = X.indexed_trace(spark, path, patterns, flags)
    assert rows(got) == rows(trace(lines, patterns, flags))
    assert got.columns == trace(lines, patterns, flags).columns


@pytest.mark.parametrize("pairs", [100_000, 0])
def test_many_patterns(spark, lines, path, monkeypatch, pairs):
    """Three hundred patterns, most without a match, by pairs of block and pattern, broadcast or shuffled."""
    monkeypatch.setattr(X, "PAIRS", pairs)
    rng = random.Random(1)
    some = [r.line for r in lines.where(F.length("line") > 40).orderBy("file_id", "line_no").limit(400).collect()]
    patterns = [re.escape(rng.choice(some)[7:30]).replace("\\ ", " ") for _ in range(60)] + [f"absent {i} words" for i in range(240)]
    got = rows(X.indexed_trace(spark, path, patterns))
    assert got == rows(trace(lines, patterns)) and len(got) >= 60


def test_blocks_left_out(spark, lines, path, monkeypatch):
    """A rare pattern has few candidate blocks and an absent one none; both are pushed to the scan, and few rows are read for them."""
    report = {r.pattern_id: r for r in X.search_report(spark, path, {"rare": "Apache License", "none": "nowhere to be found", "all": "."}).collect()}
    blocks = spark.read.parquet(f"{path}/blocks")
    assert report["all"].n_candidates == report["all"].n_blocks == blocks.count() > 100
    assert report["none"].n_candidates == 0 and 0 < report["rare"].n_candidates < 0.5 * blocks.count()
    assert blocks.agg(F.sum("n_lines")).first()[0] == lines.count()
    got = X.indexed_trace(spark, path, {"rare": "Apache License"})
    got.collect()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or" in plan or "GreaterThanOrEqual(block" in plan
    monkeypatch.setattr(X, "RANGES", 2)
    assert rows(X.indexed_trace(spark, path, ["license"])) == rows(trace(lines, ["license"]))


def test_edges(spark):
    """An empty table, null and very long lines, lines of fewer than three characters."""
    kinds = "file_id string, line_no long, byte_start long, byte_len int, line string"
    where = scratch(spark, "index")
    X.write_search_index(spark.createDataFrame([], kinds), where)
    assert X.indexed_trace(spark, where, ["abc"]).collect() == []
    data = [("f", 1, 0, 0, None), ("f", 2, 1, 2, "ab"), ("f", 3, 4, 3_000_000, "needle" + "x" * 3_000_000), (None, 1, 0, 6, "needle")]
    where = scratch(spark, "index")
    X.write_search_index(spark.createDataFrame(data, kinds), where, 1)
    assert sorted(((r.file_id, r.line_no) for r in X.indexed_trace(spark, where, ["needle"]).collect()), key=str) == [("f", 3), (None, 1)]
    assert [r.line for r in X.indexed_trace(spark, where, ["^ab$"]).collect()] == ["ab"]


def test_candidates_in_very_many_ranges(spark):
    """Every other block is a candidate, so that the ranges do not touch and are as many as allowed."""
    data = [("f", n, n * 7, 6, "needle" if n % 2 else "zzzzzz") for n in range(1, 1 + 4 * X.RANGES)]
    where = scratch(spark, "index")
    X.write_search_index(spark.createDataFrame(data, "file_id string, line_no long, byte_start long, byte_len int, line string"), where, 1)
    assert len(X._within(X.candidate_blocks(spark, where, ["needle"]), len(data))) > 400
    assert sorted(r.line_no for r in X.indexed_trace(spark, where, ["needle"]).collect()) == list(range(1, 1 + 4 * X.RANGES, 2))
