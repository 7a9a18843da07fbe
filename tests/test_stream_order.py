"""Streams whose rows come in any order inside the watermark give what a batch gives."""

import random
from datetime import datetime, timedelta

import pytest

from logweave.streaming.ordered import hit_sessions, stream_ordered_gaps, timestamp_gaps

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
START = datetime(2024, 1, 1)


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def _stream(spark, path, batches, schema, plan, name):
    """Run plan over one batch after another, and one far ahead that moves the watermark."""
    q = None
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        if q is None:
            q = plan(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)).writeStream.format("memory").queryName(name).outputMode("append").start()
        q.processAllAvailable()
    states = [s.numRowsTotal for s in q.lastProgress.stateOperators]
    q.stop()
    return spark.table(name), states


def test_gaps_of_a_shuffled_stream_equal_those_of_a_batch(spark, tmp_path, rocks):
    rng = random.Random(2)
    rows = []
    for file in ("a", "b"):
        at = START
        for _ in range(120):
            at += timedelta(seconds=rng.choice((1, 20, 400, 900)))
            rows.append((file, at))
    rows += [("a", rows[3][1]), ("c", None)]
    # Each row comes at most 250 seconds late.
    arrival = sorted(rows, key=lambda r: (r[1] or START) + timedelta(seconds=rng.randrange(250)))
    batches = [arrival[i : i + 40] for i in range(0, len(arrival), 40)]
    ahead = START + timedelta(days=9)
    schema = "file_id string, ts timestamp"
    got, states = _stream(spark, str(tmp_path / "rows"), [*batches, [("z", ahead)], [("z", ahead)]], schema, lambda r: stream_ordered_gaps(r, 300, "20 minutes"), "ordered_gaps")
    want = timestamp_gaps(spark.createDataFrame(rows, schema), 300)
    key = lambda df: sorted((r.file_id, r.ts, round(r.gap, 6), round(r.severity, 6)) for r in df.collect())
    assert key(got) == key(want) and want.count() > 40
    assert states[0] <= 6  # files a and b are gone, z waits


def test_sessions_of_a_stream_equal_those_of_a_batch(spark, tmp_path):
    rng = random.Random(5)
    rows = []
    for file in ("a", "b"):
        at = START
        for n in range(1, 150):
            at += timedelta(seconds=rng.choice((1, 60, 299, 300, 301, 900)))
            rows.append((file, rng.choice(("error_keyword", "warning_keyword")), at, n, rng.random()))
    rows.append(("a", "error_keyword", None, 500, 0.5))
    arrival = sorted(rows, key=lambda r: (r[2] or START) + timedelta(seconds=rng.randrange(250)))
    ahead = ("z", "error_keyword", START + timedelta(days=9), 1, 0.5)
    schema = "file_id string, detector string, ts timestamp, line_no long, severity double"
    got, _ = _stream(spark, str(tmp_path / "hits"), [arrival[:100], arrival[100:200], arrival[200:], [ahead], [ahead]], schema, lambda r: hit_sessions(r, "300 seconds", "20 minutes"), "sessions")
    want = hit_sessions(spark.createDataFrame(rows, schema), "300 seconds")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    # The same by a fold over the hits of a file and detector.
    plain = {}
    for f, d, at, n, s in sorted((r for r in rows if r[2]), key=lambda r: (r[0], r[1], r[2])):
        mine = plain.setdefault((f, d), [])
        if mine and at - mine[-1][1] <= timedelta(seconds=300):
            mine[-1][1:] = [at, max(mine[-1][2], s), mine[-1][3] + 1]
        else:
            mine.append([at, at, s, 1])
    assert sorted((r.file_id, r.detector, r.start, r.end, r.severity, r.n_hits) for r in want.collect()) == sorted((*k, *v) for k, vs in plain.items() for v in vs)
