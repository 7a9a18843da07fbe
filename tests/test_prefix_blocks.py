"""First lines of long files by block, and entropy of long texts."""

import math
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from logweave.functions.text import shannon_entropy
from logweave.operators import prefix


@pytest.mark.parametrize("block", [65_536, 13])
def test_sample_does_not_depend_on_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(prefix, "BLOCK_LINES", block)
    data, want = [], []
    for f, n in (("a", 300), ("b", 7), ("c", 90), (None, 40)):
        at, rows = 0, []
        for i in range(1, n + 1):
            line = "" if i % 5 == 0 else f"line {i}"
            rows.append((f, i, at, len(line), line))
            at += len(line) + 1
        good = [r for r in rows if r[4] and r[2] >= math.floor(at * 0.05)]
        want += [(f, r[1], k) for k, r in enumerate(good[:50], 1)]
        data += rows
    df = spark.createDataFrame(data, "file_id string, line_no long, byte_start long, byte_len int, line string").repartition(3)
    assert sorted(((r.file_id, r.line_no, r.r) for r in prefix._sample(df, 50, 0.05).collect()), key=str) == sorted(want, key=str)


def test_entropy_of_texts(spark):
    """Equal to the definition; a long text of thousands of different characters takes no time that grows with these."""
    texts = ["", "a", "aa", "ab", "abcabcd", "é€é", " \n ", "0123456789abcdef" * 2, "".join(chr(0x4E00 + i % 6000) for i in range(80_000)), None]
    plain = lambda t: None if t is None else -sum(c / len(t) * math.log2(c / len(t)) for c in Counter(t).values()) + 0.0
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    began = time.time()
    got = {r.i: r.e for r in df.select("i", shannon_entropy(F.col("t")).alias("e")).collect()}
    assert time.time() - began < 20
    assert got == {i: None if t is None else pytest.approx(plain(t), abs=1e-9) for i, t in enumerate(texts)}
