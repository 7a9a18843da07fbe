import gzip

from pyspark.sql import functions as F

from logweave.functions import extend
from logweave.functions.text import shannon_entropy
from logweave.functions.windows import running_sums, with_halo
from logweave.operators import detectors as D
from logweave.operators import incremental as I
from logweave.operators import prefix as P
from logweave.operators import ranges as M
from logweave.operators import samples as R
from logweave.operators import stats as A
from logweave.operators import trace as T
from logweave.sources import files as S
from logweave.sources.lines import lines_from_column, read_lines


def lines(spark, *rows, file="f1"):
    df = spark.createDataFrame([(file, "\n".join(rows))], "id string, t string")
    return lines_from_column(df, "id", "t")


def numbers(df, *cols):
    return sorted(tuple(r) for r in df.select(*(cols or ["line_no"])).collect())


def test_read_lines_is_exact_for_any_split(spark, tmp_path):
    raw = b"".join(b"line %d \xc3\xa9%s\n" % (i, b"\r" if i % 3 == 0 else b"") + (b"\n" if i % 7 == 0 else b"") for i in range(2000)) + b"last"
    (tmp_path / "a.log").write_bytes(raw)
    with gzip.open(tmp_path / "b.log.gz", "wb") as f:
        f.write(raw)
    want, at = [], 0
    for i, x in enumerate(raw.split(b"\n"), 1):
        want.append((i, at, len(x)))
        at += len(x) + 1
    for size in ("3k", "17k", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        got = read_lines(spark, str(tmp_path))
        for name in ("a.log", "b.log.gz"):
            assert numbers(got.where(F.col("file_id").endswith(name)), "line_no", "byte_start", "byte_len") == want
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_context_is_clipped_and_each_line_comes_once(spark):
    ls = lines(spark, "a", "b", "pattern", "x pattern", "pattern", "c", "d")
    m = T.trace(ls, ["pattern"])
    assert numbers(m) == [(3,), (4,), (5,)]
    ctx = T.match_context(ls, m, 2, 1)
    assert numbers(ctx.where("match_line = 5"), "ctx_line") == [(3,), (4,), (5,), (6,)]
    assert numbers(T.context_union(ls, m, 9, 9), "line_no", "block") == [(i, 1) for i in range(1, 8)]


def test_flags_and_several_patterns_on_a_line(spark):
    ls = lines(spark, "Error and Warning both appear", "terror", "a.b", "axb")
    assert numbers(T.trace(ls, ["Error", "Warning"]), "line_no", "pattern_id") == [(1, "p1"), (1, "p2")]
    assert numbers(T.trace(ls, ["error"], "iw")) == [(1,)]
    assert numbers(T.trace(ls, ["a.b"], "F")) == [(3,)]
    assert numbers(T.trace(ls, ["a.b"], "x")) == [(3,), (4,)]
    assert set(T.validate_patterns(spark, ["ok", "("])) == {"p2"}


def test_submatches_are_byte_positions(spark):
    row = T.with_submatches(T.trace(lines(spark, "é aa", "éa aa"), ["a+"]), ["a+"]).where("line_no = 2").collect()[0]
    assert [(s.text, s.start, s.end) for s in row.submatches] == [("a", 2, 3), ("aa", 4, 6)]
    assert row.offsets == [row.byte_start + 2, row.byte_start + 4]


def test_samples(spark):
    ls = lines(spark, *[f"Line {i}: This is line number {i}" for i in range(1, 101)])
    t = spark.createDataFrame([("f1", 50), ("f1", 500)], "file_id string, target long")
    got = R.sample_lines(ls, t, 2, 2)
    assert numbers(got.where("found"), "line_no") == [(i,) for i in range(48, 53)]
    assert got.where("NOT found").collect()[0].target == 500
    spec = spark.createDataFrame([("100",), ("-5",), ("10-15",), ("15-10",), ("x",), ("-3-5",)], "s string").select("s", R.parse_spec(F.col("s")).alias("x")).select("s", "x.*")
    assert {r.s: (r.start, r.end, r.status) for r in spec.collect()} == {"100": (100, None, "ok"), "-5": (-5, None, "ok"), "10-15": (10, 15, "ok"), "15-10": (None, None, "reversed"), "x": (None, None, "bad form"), "-3-5": (None, None, "bad form")}
    back = R.offset_to_line(ls, R.line_to_offset(ls, ls.select("file_id", F.col("line_no").alias("target"))).select("file_id", F.col("start").alias("offset")))
    assert [x for (x,) in numbers(back)] == list(range(1, 101))


def test_checkpoints_as_of_and_interpolation(spark):
    cp = spark.createDataFrame([("f1", 1, 0), ("f1", 100, 5000), ("f1", 200, 10000), ("g", 10, 500)], "file_id string, line_no long, byte_offset long")
    t = spark.createDataFrame([("f1", 100), ("f1", 150), ("f1", 999), ("g", 5), ("none", 7)], "file_id string, target long")
    got = {(r.file_id, r.target): (r.line_no, r.byte_offset) for r in R.nearest_checkpoint(cp, t).collect()}
    assert got == {("f1", 100): (100, 5000), ("f1", 150): (100, 5000), ("f1", 999): (200, 10000), ("g", 5): (10, 500), ("none", 7): (1, 0)}
    grid = spark.createDataFrame([("f", 1 + 100 * i, 10000 * i) for i in range(3)], "file_id string, line_no long, byte_offset long")
    o = spark.createDataFrame([("f", 500), ("f", 5000), ("f", 15000), ("f", 10000), ("none", 1)], "file_id string, offset long")
    assert {r.offset: r.line_no for r in R.approx_offset_to_line(grid, o).collect()} == {500: 6, 5000: 51, 15000: 151, 10000: 101, 1: -1}


def test_statistics(spark):
    rows = ["x" * 10] * 50 + ["x" * 20] * 50
    s = A.line_stats(lines(spark, *rows, *[""] * 500, "")).collect()[0]
    assert (s.n_lines, s.n_empty, s.max_len, s.avg_len, s.median_len) == (600, 500, 20, 15.0, 15.0)
    long = A.longest_line(lines(spark, *["a"] * 100, "x" * 500, *["b"] * 100)).collect()[0]
    assert (long.line_no, long.len) == (101, 500)
    assert A.line_ending(lines(spark, "a\r", "b\r", "c\r")).collect()[0].line_ending == "CRLF"
    assert A.line_ending(lines(spark, "a\r", "b")).collect()[0].line_ending in ("CRLF", "mixed")
    assert A.line_ending(lines(spark, "line1\r", " line2\r line3", " line4\r")).collect()[0].line_ending == "mixed"


def test_row_detectors(spark):
    ls = lines(spark, "INFO ok", "ERROR bad", "FATAL worse", "Traceback (most recent call last):", "api_key = ABCDEFGHIJKLMNOPQRSTUVWX", "Deprecated call", "exception in lower case", "x " + "0123456789abcdef" * 2)
    got = {(r.line_no, r.detector): r.severity for r in D.detect_rows(ls).collect()}
    assert got == {(2, "error_keyword"): 0.7, (3, "error_keyword"): 0.9, (4, "traceback"): 0.9, (5, "high_entropy"): 0.85, (6, "warning_keyword"): 0.3, (8, "high_entropy"): 0.6}
    e = spark.createDataFrame([("abcd",), ("aaaa",), ("",)], "s string").select("s", shannon_entropy(F.col("s")).alias("e"))
    assert {r.s: r.e for r in e.collect()} == {"abcd": 2.0, "aaaa": 0.0, "": 0.0}


def test_window_detectors(spark):
    stamp = ["2024-01-01 00:00:00 a", "2024-01-01 00:01:00 b", "plain", "2024-01-01 00:11:00 c", "one two three four five 2024-01-01 09:00:00", "2024-01-01 01:11:00 d"]
    gaps = {r.line_no: r.severity for r in D.detect_timestamp_gap(lines(spark, *stamp)).collect()}
    assert gaps == {4: round(0.3 + 600 / 3600 * 0.5, 6), 6: 0.8}
    assert numbers(D.detect_indentation(lines(spark, "    a", "\tb", "     c", "d", "    e"))) == [(3,)]
    logs = [f"2024-01-01 00:00:{i % 60:02d} INFO ok" for i in range(150)] + ["--- SYSTEM BREAK ---"]
    assert numbers(D.detect_format_deviation(lines(spark, *logs))) == [(151,)]
    js = ['{"a": 1, "b": 2, "c": 3, "d": "%s"}' % ("x" * 100)] * 12
    assert numbers(D.detect_json_dump(lines(spark, *js))) == [(10,), (11,), (12,)]
    assert D.detect_json_dump(lines(spark, js[0])).count() == 0


def test_running_sums_and_halo_do_not_depend_on_blocks(spark):
    ls = lines(spark, *[str(i) for i in range(100)])
    for size in (7, 1000):
        from logweave.functions.windows import with_block

        got = running_sums(with_block(ls, size), {"s": F.col("line").cast("long")})
        assert [r.s for r in got.orderBy("line_no").collect()] == [i * (i + 1) // 2 for i in range(100)]
    assert with_halo(ls, 2, 10).where("halo").count() == 20


def test_prefix(spark):
    good = [f"2024-01-01 10:00:{i % 60:02d} INFO worker[{i}]: step {i}" for i in range(95)]
    ls = lines(spark, *good, *["odd one"] * 5)
    p = P.dominant_prefix(ls, skip=0.0)
    r = p.collect()[0]
    assert r.prefix.startswith("<DATE> <TIME> <LEVEL>") and r.coverage >= 0.9
    assert numbers(P.detect_prefix_deviation(ls, p)) == [(i,) for i in range(96, 101)]


def test_merge_ranges_cuts_long_islands(spark):
    hits = spark.createDataFrame([("f", i, 0, 0.5, "d") for i in [1, 3, 4, 9] + list(range(100, 2600))], "file_id string, line_no long, byte_start long, severity double, detector string")
    got = numbers(M.merge_ranges(hits), "start_line", "end_line", "n_hits")
    assert got == [(1, 4, 3), (9, 9, 1), (100, 1099, 1000), (1100, 2099, 1000), (2100, 2599, 500)]
    assert [r.label for r in spark.createDataFrame([(0.3,), (0.4,), (0.6,), (0.8,)], "s double").select(M.severity_label(F.col("s")).alias("label")).collect()] == ["low", "medium", "high", "critical"]


def test_pattern_hash_and_incremental(spark):
    assert I.pattern_hash(["a", "b"], "i") == I.pattern_hash(["b", "a"], "in") != I.pattern_hash(["a", "b"])
    ls = lines(spark, "hit", "miss", file="x").unionByName(lines(spark, "miss", "hit", file="y"))
    files = spark.createDataFrame([("x", 1, None), ("y", 2, None)], "path string, size_bytes long, modified_at timestamp").withColumn("modified_at", F.lit(0).cast("timestamp"))
    empty = files.limit(0).withColumns({"pattern_hash": F.lit(""), "pattern_id": F.lit(""), "line_no": F.lit(0).cast("long"), "byte_start": F.lit(0).cast("long")})
    found, new = I.incremental_trace(ls, files, ["hit"], empty)
    assert numbers(found, "path", "line_no") == [("x", 1), ("y", 2)]
    again, nothing = I.incremental_trace(ls, files, ["hit"], new)
    assert nothing.count() == 0 and numbers(again, "path", "line_no") == [("x", 1), ("y", 2)]


def test_files(spark):
    names = ["a.gz", "b.zst", "c.xz", "d.bz2", "e.tar.gz", "f.log"]
    got = spark.createDataFrame([(n,) for n in names], "p string").select("p", S.compression_of(F.col("p")).alias("c"))
    assert {r.p: r.c for r in got.collect()} == {"a.gz": "gzip", "b.zst": "zstd", "c.xz": "xz", "d.bz2": "bz2", "e.tar.gz": None, "f.log": None}


def test_own_detectors(spark):
    ls = lines(spark, "a", "boom", "boom")
    extend.register_detector("boom", "error", (0.5, 0.5), lambda c: F.when(c.contains("boom"), F.lit(0.5)))
    try:
        assert numbers(D.detect_rows(ls).where("detector = 'boom'")) == [(2,), (3,)]
    finally:
        extend.unregister_detector("boom")

    def step(state, row):
        state.append(row["line"])
        return 0.5 if state.count("boom") > 1 else None

    assert numbers(extend.stateful_detector(ls, "second", list, step)) == [(3,)]


def test_all_detectors_include_prefix_deviations(spark):
    log = ["--- BREAK ---" if i == 60 else f"2026-01-02 03:04:{i % 60:02d} INFO user={i}" for i in range(1, 101)]
    assert [(r.line_no, r.severity) for r in D.detect_all(lines(spark, *log)).where("detector = 'prefix_deviation'").collect()] == [(60, 0.3)]
