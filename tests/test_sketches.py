"""Sketches of line lengths: mergeable, exact while small, and within their bound of rank beyond it."""

import bisect
import random

from logweave.operators import stats as A


def test_sketches_of_blocks_merge_into_percentiles_of_any_files(spark):
    rng = random.Random(3)
    lengths = {"a": [int(rng.expovariate(0.01)) + 1 for _ in range(60_000)], "b": [rng.randrange(1, 40) for _ in range(300)], "c": []}
    rows = [(f, 5 * i + 1, n) for f, ns in lengths.items() for i, n in enumerate(ns)] + [("a", 400_000, 0), ("c", 1, 0)]
    lines = spark.createDataFrame(rows, "file_id string, line_no long, n int").selectExpr("file_id", "line_no", "repeat('x', n) AS line")
    sketches = A.length_sketches(lines).persist()
    assert sketches.where("file_id = 'a'").count() > 1  # many blocks, one row each
    by_file = {r.file_id: r for r in A.sketch_percentiles(sketches, ["file_id"]).collect()}
    everything = A.sketch_percentiles(sketches, []).first()
    assert set(by_file) == {"a", "b"}  # a file without lines that count has no sketch
    for found, ns, bound in ((by_file["a"], lengths["a"], 0.01), (by_file["b"], lengths["b"], 0.005), (everything, lengths["a"] + lengths["b"], 0.01)):
        ns = sorted(ns)
        assert found.n_lines == len(ns)
        for p in (50, 95, 99):
            q = found[f"p{p}_len"]
            assert bisect.bisect_left(ns, q) / len(ns) - bound <= p / 100 <= bisect.bisect_right(ns, q) / len(ns) + bound
    plan = A.sketch_percentiles(A.length_sketches(lines), ["file_id"])._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def test_no_lines(spark):
    lines = spark.createDataFrame([], "file_id string, line_no long, line string")
    assert A.length_sketches(lines).count() == 0
    assert A.sketch_percentiles(A.length_sketches(lines), ["file_id"]).count() == 0
