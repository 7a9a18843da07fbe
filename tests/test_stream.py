import random
import time

from logweave.operators import trace as T
from logweave.operators.detectors import detect_timestamp_gap
from logweave.streaming import stream as X


def test_stream_trace_delivers_capped_events(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("ok\nerror one\nerror two\n")
    got = []
    q = X.stream_match_sink(X.stream_trace(X.read_text_stream(spark, str(tmp_path / "in")), ["error"]), lambda df, n: got.extend(df.collect()), 1, str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert len(got) == 1 and got[0].event == "match_found"
    assert T.named(["a"]) == {"p1": "a"}


def test_stream_gap_keeps_state(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.sql("SELECT 'f' file_id, timestamp'2024-01-01 00:00:00' ts UNION ALL SELECT 'f', timestamp'2024-01-01 00:10:00'").write.parquet(path)
    rows = spark.readStream.schema("file_id string, ts timestamp").parquet(path)
    q = X.stream_timestamp_gap(rows).writeStream.format("memory").queryName("gaps").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert [round(r.gap) for r in spark.table("gaps").collect()] == [600]


def test_stream_reports_what_is_beyond_the_cap(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("error c\nerror a\nerror b\n")
    got, left = [], []
    found = X.stream_trace(X.read_text_stream(spark, str(tmp_path / "in")), ["error"])
    q = X.stream_match_sink(found, lambda df, n: got.extend(df.collect()), 2, str(tmp_path / "cp"), lambda n, k: left.append(k))
    q.processAllAvailable()
    q.stop()
    assert [r.line_text for r in got] == ["error a", "error b"] and left == [1]


def test_stream_keyword_counts(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.sql("SELECT timestamp'2024-01-01 00:00:00' ts, 'ERROR x' line UNION ALL SELECT timestamp'2024-01-01 00:04:00', 'WARN y' UNION ALL SELECT timestamp'2024-01-01 00:06:00', 'ok'").write.parquet(path)
    rows = spark.readStream.schema("ts timestamp, line string").parquet(path)
    q = X.stream_keyword_counts(rows, "ts", "line").writeStream.format("memory").queryName("words").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.start.minute, r.n, r.n_errors, r.n_warnings) for r in spark.table("words").collect()) == [(0, 2, 1, 1), (5, 1, 0, 0)]


def test_stream_line_gaps_equal_those_of_a_batch(spark, tmp_path):
    rng = random.Random(4)
    rows = []
    for file in ("a", "b", "c"):
        clock, at = 80_000, 0
        for n in range(1, 1501):
            clock += rng.choice((1, 5, 400)) if rng.random() < 0.3 else 1
            day, s = 1 + clock // 86_400, clock % 86_400
            hms = f"{s // 3600:02d}:{s // 60 % 60:02d}:{s % 60:02d}"
            stamps = [f"2024-01-{day:02d} {hms}", f"{day:02d}/Jan/2024:{hms} x", str(1_704_067_200 + clock), hms]
            kind = rng.choice({"a": (0, 0, 3), "b": (3,), "c": (0, 1, 2, 3)}[file] if n < 400 else {"a": (0, 3), "b": (3, 2), "c": (1, 2)}[file])
            line = "no time" if 600 < n < 1150 and file != "c" or rng.random() < 0.1 else f"{stamps[kind]} INFO x"
            rows.append((file, n, at, line))
            at += len(line) + 1
    schema = "file_id string, line_no long, byte_start long, line string"
    for k in range(3):
        spark.createDataFrame(rng.sample(rows[:], len(rows)), schema).where(f"line_no between {k * 500 + 1} and {k * 500 + 500}").coalesce(1).write.parquet(str(tmp_path / "rows" / f"p{k}"))
    whole = spark.createDataFrame(rows, schema)
    want = sorted(tuple(r) for r in detect_timestamp_gap(whole).collect())
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "rows"))
    q = X.stream_line_gaps(stream).writeStream.format("memory").queryName("line_gaps").outputMode("append").start()
    q.processAllAvailable()
    batches = len([p for p in q.recentProgress if p["numInputRows"]])
    q.stop()
    got = sorted(tuple(r) for r in spark.table("line_gaps").collect())
    assert got == want and len(want) > 100 and batches == 3


def test_stream_line_gaps_with_states_that_expire(spark, tmp_path):
    path = str(tmp_path / "rows")
    schema = "file_id string, line_no long, byte_start long, line string"
    spark.createDataFrame([("f", 1, 0, "2024-01-01 00:00:00 a"), ("f", 2, 22, "2024-01-01 00:10:00 b")], schema).write.parquet(path)
    q = X.stream_line_gaps(spark.readStream.schema(schema).parquet(path), idle_ms=1).writeStream.format("memory").queryName("brief").trigger(processingTime="1 second").start()
    # A query with timeouts always has another batch, so its end is not waited for.
    end = time.time() + 40
    while time.time() < end and not any(p["stateOperators"] and p["stateOperators"][0]["numRowsRemoved"] for p in q.recentProgress):
        time.sleep(0.5)
    removed = sum(p["stateOperators"][0]["numRowsRemoved"] for p in q.recentProgress if p["stateOperators"])
    q.stop()
    assert [(r.line_no, r.severity) for r in spark.table("brief").collect()] == [(2, 0.383333)] and removed == 1
