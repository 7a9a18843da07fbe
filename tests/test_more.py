"""Ranges over block edges, lines of odd texts, descriptions, continuation rules, shared passes, catalogues."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from logweave.operators import detectors, prefix, ranges, samples, stats
from logweave.sources import files
from logweave.sources.lines import lines_from_column, lines_from_rows, read_lines


def numbered(spark, rows, file="f1"):
    at, out = 0, []
    for i, line in enumerate(rows, 1):
        out.append((file, i, at, len(line.encode()), line))
        at += len(line.encode()) + 1
    return spark.createDataFrame(out, "file_id string, line_no long, byte_start long, byte_len int, line string")


def test_lines_of_odd_texts(spark, monkeypatch):
    texts = [None, "", "\n", "a", "a\n", "\nb", "é\r\n\nz", "x" * 100_000 + "\ny", "\n\n", "tail"]
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)] + [(None, "q\nr", "k")], "id long, text string, line string").repartition(2)
    want = []
    for i, t in [*enumerate(texts), (None, "q\nr")]:
        parts = (t or "").split("\n") if t is not None else []
        parts = parts[:-1] if parts and parts[-1] == "" else parts
        at = 0
        for n, x in enumerate(parts, 1):
            want.append((None if i is None else str(i), n, at, len(x.encode()), x))
            at += len(x.encode()) + 1
    for cut in (4 << 20, 3):
        monkeypatch.setattr("logweave.sources.lines.CUT_BYTES", cut)
        got = [tuple(r) for r in lines_from_column(df, "id", "text").collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert lines_from_column(df.where("false"), "id", "text").collect() == []
    assert "Exchange" not in lines_from_column(df, "id", "text")._jdf.queryExecution().executedPlan().toString().replace("Exchange RoundRobinPartitioning", "")


def plain_ranges(hits, gap, most):
    out = []
    for file, detector in sorted({(h[0], h[4]) for h in hits}):
        last = None
        for _, line, _, severity, _ in sorted(h for h in hits if (h[0], h[4]) == (file, detector)):
            if last and line - last[3] <= gap and line - last[2] < most:
                last[3:] = [line, max(last[4], severity), last[5] + 1]
            else:
                last = [file, detector, line, line, severity, 1]
                out.append(last)
    return sorted(map(tuple, out))


@pytest.mark.parametrize("block", [65_536, 7])
def test_ranges_do_not_depend_on_blocks(spark, monkeypatch, block):
    monkeypatch.setattr("logweave.operators.ranges.BLOCK_LINES", block)
    monkeypatch.setattr("logweave.operators.ranges.with_block", lambda rows: rows.withColumn("lblock", F.floor((F.col("line_no") - 1) / block)))
    rng = random.Random(2)
    hits = [(f, n, n * 10, rng.choice((0.3, 0.5)), d) for f in ("a", "b") for d in ("x", "y") for n in range(1, 200) if rng.random() < 0.6]
    df = spark.createDataFrame(hits, "file_id string, line_no long, byte_start long, severity double, detector string")
    got = sorted(tuple(r) for r in ranges.merge_ranges(df, 2, 20).select("file_id", "detector", "start_line", "end_line", "severity", "n_hits").collect())
    assert got == plain_ranges(hits, 2, 20)


def test_shared_pass_equals_single_detectors(spark):
    rng = random.Random(3)
    kinds = ["2024-01-01 10:%02d:00 INFO ok", "    at step", "\tat x", "", '{"a": 1, "b": "%s", "c": true, "d": null}' % ("x" * 90), "ValueError: bad", "WARN slow", "2024-01-01 1%d:00:00 ERROR late"]
    lines = numbered(spark, [(k % rng.randrange(10) if "%" in k and "{" not in k else k) for k in (rng.choice(kinds) for _ in range(400))]).cache()
    single = detectors.detect_rows(lines)
    for fn in (detectors.detect_indentation, detectors.detect_timestamp_gap, detectors.detect_json_dump):
        single = single.unionByName(fn(lines))
    want = sorted(tuple(r) for r in single.collect())
    assert sorted(tuple(r) for r in detectors.detect_near(lines).collect()) == want and len({w[4] for w in want}) >= 5


def test_descriptions(spark):
    lines = numbered(spark, ["y" * 70, "z  ", '{"a": 1,', '"b": 2}', "w" * 45, "v"])
    rows = [("prefix_deviation", 1, 1), ("line_length_spike", 2, 2), ("json_dump", 3, 4), ("prefix_deviation", 5, 6), ("indentation_block", 5, 6), ("timestamp_gap", 6, 6), ("format_deviation", 6, 6), ("own", 5, 6)]
    found = spark.createDataFrame([("f1", d, a, b) for d, a, b in rows], "file_id string, detector string, start_line long, end_line long")
    got = sorted(r.description for r in ranges.describe(found, lines).collect())
    assert got == sorted([
        "Line doesn't match expected prefix format: " + "y" * 60 + "...", "Unusually long line (1 chars)", "Embedded JSON (15 chars, 2 lines)", "Block of 2 lines without expected prefix: " + "w" * 40 + "...",
        "Indented block (2 lines)", "Timestamp gap detected", "Format deviation from dominant pattern", "own (2 lines)",
    ])


def test_continuation_rules(spark):
    lines = numbered(spark, ["Traceback (most recent call last):", '  File "a.py", line 3', "\tat Foo", "    ... 5 more", "done", "", '{"a": 1,', '  "b": 2', "}", "plain"])
    got = [tuple(r) for r in ranges.multiline_blocks(lines, F.col("line").startswith("Traceback"), detectors.goes_on("traceback")).select("start_line", "end_line").collect()]
    assert got == [(1, 4)]
    assert [r.line_no for r in lines.where(detectors.goes_on("json_dump")).orderBy("line_no").collect()] == [7, 8, 9]
    assert [r.line_no for r in lines.where(detectors.goes_on("indentation_block")).orderBy("line_no").collect()] == [3, 4]


def test_prefix_below_the_coverage(spark):
    rows = [f"2024-01-01 10:00:{i % 60:02d} INFO job one two {'x' if i % 10 < 6 else i}" for i in range(200)]
    rows = [r if i % 5 else f"other{i}" for i, r in enumerate(rows)]
    found = prefix.dominant_prefix(numbered(spark, rows), skip=0.0).collect()
    # No run of tokens has 0.9 of the lines, and no whole prefix half of them.
    assert found == []
    even = [f"2024-01-01 10:00:{i % 60:02d} INFO job one" if i % 5 else f"other{i} thing" for i in range(200)]
    got = prefix.dominant_prefix(numbered(spark, even), skip=0.0).collect()
    assert [(r.prefix, r.token_count, r.coverage) for r in got] == [("<DATE> <TIME> <LEVEL> job one", 5, 0.8)]


def test_files_that_are_not_read(spark, tmp_path):
    (tmp_path / "a.log").write_text("one\ntwo\n")
    (tmp_path / "b.log.xz").write_bytes(b"\xfd7zXZ\x00abc\n")
    (tmp_path / "c.zst").write_bytes(b"\x28\xb5\x2f\xfdabc\n")
    assert sorted(r.line for r in read_lines(spark, str(tmp_path)).collect()) == ["one", "two"]
    assert sorted((r.path.rsplit("/", 1)[1], r.reason) for r in files.unread_files(spark, str(tmp_path)).collect()) == [("b.log.xz", "compression xz"), ("c.zst", "compression zstd")]
    catalog = files.file_catalog(spark, str(tmp_path), peek=True)
    assert {(r.path.rsplit("/", 1)[1], r.compression, r.is_text) for r in catalog.collect()} == {("a.log", None, True), ("b.log.xz", "xz", False), ("c.zst", "zstd", True)}
    kept, left = files.scan_filter(catalog, 1)
    assert [r.path.rsplit("/", 1)[1] for r in kept.collect()] == ["a.log"]
    assert {(r.path.rsplit("/", 1)[1], r.reason) for r in left.collect()} == {("b.log.xz", "binary"), ("c.zst", "limit")}
    assert [r.path.rsplit("/", 1)[1] for r in stats.index_needed(catalog.where("compression is null"), analyze=True).collect()] == ["a.log"]
    assert stats.index_needed(catalog).collect() == []


def test_range_look_ups_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(samples, "LINES", 3)
    monkeypatch.setattr(samples, "BUCKET", 16)
    rng = random.Random(7)
    rows = ["x" * rng.randrange(0, 40) for _ in range(60)]
    lines = numbered(spark, rows).cache()
    flat = [tuple(r) for r in lines.orderBy("line_no").collect()]
    asked = [("f1", a, a + rng.randrange(0, 200)) for a in (rng.randrange(0, 900) for _ in range(20))]
    r = spark.createDataFrame(sorted(set(asked)), "file_id string, start long, `end` long")
    size = flat[-1][2] + flat[-1][3] + 1
    got = sorted((x.start, x.end, x.line_no) for x in samples.sample_byte_ranges(lines, r).collect())
    assert got == sorted((a, b, n) for _, a, b in set(asked) if b < size for _, n, s, k, _ in flat if s <= b and s + k >= a)
    got = sorted((x.start, x.end, x.line_no) for x in samples.sample_line_ranges(lines, r).collect())
    assert got == sorted((a, b, n) for _, a, b in set(asked) for _, n, _, _, _ in flat if a <= n <= b)
    blocks = stats.block_map(lines, 50)
    cut = [tuple(x) for x in blocks.select("block_no", "first_line", "last_line", "start_offset", "end_offset").collect()]
    got = sorted((x.start, x.end, x.block_no) for x in samples.blocks_for_bytes(blocks, r).collect())
    assert got == sorted((a, b, n) for _, a, b in set(asked) for n, _, _, s, e in cut if s < b and e > a)
    targets = lines.select("file_id", F.col("line_no").alias("target"))
    got = sorted((x.block_no, tuple(x.lines)) for x in samples.blocks_for_lines(blocks, targets).collect())
    assert got == sorted((n, tuple(range(a, z + 1))) for n, a, z, _, _ in cut)


def test_small_length_samples_are_repeatable(spark):
    lines = numbered(spark, ["x" * i for i in range(1, 300)])
    one, two = (stats.line_length_sample(lines, 20).collect() for _ in range(2))
    assert one == two and 30 < one[0].median_len < 270


def test_scales_and_catalogues(spark):
    assert [r.label for r in ranges.severity_scale(spark).orderBy(F.desc("min_severity")).collect()] == ["critical", "high", "medium", "low"]
    assert {r.category: r.detectors for r in ranges.category_catalog(spark).collect()}["multiline"] == ["indentation_block"]


def test_rows_are_numbered_alike_in_any_blocks(spark):
    data = [(None if i % 5 == 0 else "f" if i % 5 < 4 else "g", i, None if i % 11 == 0 else "é" * (i % 7)) for i in range(200)]
    df = spark.createDataFrame(data, "name string, at long, said string").repartition(5)
    want, sizes = [], {}
    for name, _, said in data:
        n, start = sizes.get(name, (0, 0))
        width = None if said is None else len(said.encode())
        want.append((name or "", n + 1, start, width, said))
        sizes[name] = (n + 1, start + (0 if width is None else width + 1))
    for block in (None, F.floor(F.col("at") / 7), F.col("at"), F.when(F.col("at") > 60, 1)):
        got = [(r.file_id or "", r.line_no, r.byte_start, r.byte_len, r.line) for r in lines_from_rows(df, F.col("name"), ["at"], F.col("said"), block).collect()]
        assert sorted(got, key=lambda r: r[:3]) == sorted(want, key=lambda r: r[:3])
    assert lines_from_rows(df.where("false"), F.col("name"), ["at"], F.col("said")).collect() == []


def test_length_samples_of_any_bound(spark):
    """The lines first by hash, of files above and below the bound; without one all lines."""
    data = [(f, i, i * 9, 1 + i * 7 % 50, "x" * (1 + i * 7 % 50) if i % 5 else "  ") for f, k in (("a", 3000), ("b", 40), (None, 100)) for i in range(1, k)]
    lines = spark.createDataFrame(data, "file_id string, line_no long, byte_start long, byte_len int, line string")
    for n in (1, 37, 1000, 100_000, None):
        kept = lines.where(F.trim("line") != "").select("file_id", F.length("line").alias("n"), F.row_number().over(Window.partitionBy("file_id").orderBy(F.xxhash64("file_id", "line_no"))).alias("r"))
        want = kept.where(F.col("r") <= (n or 10**9)).groupBy("file_id").agg(*[F.percentile("n", F.lit(p)) for p in (0.5, 0.95, 0.99)])
        assert sorted(map(tuple, stats.line_length_sample(lines, n).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_one_pass_profiles(spark):
    """The wide row has what the single operators give, also of files that are blank or have no lines."""
    rows = [("a", 1, 0, 3, "xy\r"), ("a", 2, 4, 2, "ab"), ("a", 3, 7, 0, ""), ("b", 1, 0, 1, " "), ("c", 1, 0, 4, "long")]
    lines = spark.createDataFrame(rows, "file_id string, line_no long, byte_start long, byte_len int, line string")
    files = spark.createDataFrame([(f, 9) for f in "abcd"], "file_id string, size_bytes long")
    longest = stats.longest_line(lines).select("file_id", F.col("line_no").alias("longest_line_no"), F.col("byte_start").alias("longest_offset"))
    want = files.join(stats.line_stats(lines), "file_id", "left").join(longest, "file_id", "left").join(stats.line_ending(lines), "file_id", "left")
    got = stats.file_profile(lines, files)
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_deviations_of_many_files(spark):
    """Spikes and formats in files among others that can have neither; halo rows come once."""
    rows = [f"2024-01-01 10:00:{i % 60:02d} INFO ok {'y' * (i % 90)}" for i in range(300)]
    rows[150], rows[250] = "--- break", "z" * 4000
    odd, plain = numbered(spark, rows, "odd"), numbered(spark, [f"INFO {i}" if i % 2 else "plain" for i in range(300)], "plain")
    for fn in (detectors.detect_length_spike, detectors.detect_format_deviation):
        alone = sorted(map(tuple, fn(odd).collect()))
        assert alone and sorted(map(tuple, fn(odd.unionByName(plain)).collect())) == alone
    both = sorted(map(tuple, detectors.detect_all(odd.unionByName(plain)).collect()))
    assert both == sorted([*map(tuple, detectors.detect_all(odd).collect()), *map(tuple, detectors.detect_all(plain).collect())])
    assert {(r[1], r[4]) for r in both if r[0] == "odd"} >= {(151, "format_deviation"), (251, "line_length_spike")}


def test_texts_are_not_kept_for_all_detectors(spark):
    """What is persisted is narrow; the texts are read again."""
    lines = numbered(spark, ["2024-01-01 10:00:00 INFO ok", "    at x"] * 10)
    plan = detectors.detect_all(lines)._jdf.queryExecution().withCachedData().toString()
    kept = [x for x in plan.split("\n") if "InMemoryRelation" in x]
    assert kept and all("sig#" in x and " line#" not in x.replace("[line#", "[ line#") for x in kept)


def test_texts_are_dealt_once_to_be_numbered(spark):
    """The join with what lies before a block uses the exchange of the window, null files and blocks too."""
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.createDataFrame([("f" if i % 3 else None, i, f"line {i}") for i in range(40)], "name string, at long, said string")
        lines = lines_from_rows(df, F.col("name"), ["at"], F.col("said"), F.floor(F.col("at") / 7))
        plan = lines._jdf.queryExecution().executedPlan().toString()
        assert lines.count() == 40 and not [x for x in plan.split("\n") if "Exchange" in x and "isnull(" in x]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_hits_are_made_once_to_be_merged(spark):
    made = spark.sparkContext.accumulator(0)

    def seen(x):
        made.add(1)
        return x

    hits = spark.createDataFrame([("f", "d", i, 0.5) for i in (1, 2, 9)], "file_id string, detector string, line_no long, severity double")
    hits = hits.withColumn("line_no", F.udf(seen, "long").asNondeterministic()("line_no"))
    assert sorted((r.start_line, r.end_line) for r in ranges.merge_ranges(hits).collect()) == [(1, 2), (9, 9)]
    assert made.value == 3


def test_only_worded_ranges_meet_the_lines(spark):
    found = spark.createDataFrame([("f", d, 1, 3, 0.4, 3) for d in ("indentation_block", "timestamp_gap", "traceback")], "file_id string, detector string, start_line long, end_line long, severity double, n_hits long")
    lines = numbered(spark, ["panic: x"], "f")
    assert {r.description for r in ranges.describe(found, lines).collect()} == {"Indented block (3 lines)", "Timestamp gap detected", "Go panic"}
    assert {r.detector for r in ranges.describe(found, lines.where("false")).collect()} == {"indentation_block", "timestamp_gap"}
