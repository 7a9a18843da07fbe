"""Fuzzy line dedup against a brute-force version."""

import random

import brute
import pytest
from pyspark.sql import functions as F

from logweave.llm import linededup


def edited(rng, words, n):
    w = list(words)
    for _ in range(n):
        w[rng.randrange(len(w))] = f"edit{rng.randrange(99)}"
    return " ".join(w)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(300)]
    line = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    families = [line(rng.choice((3, 6, 9, 15, 40, 90))) for _ in range(40)]
    lines = [edited(rng, f, rng.randrange(0, 1 + len(f) // 30)) + rng.choice(("", ".", "!", " ab", "ing")) for f in families for _ in range(8)]
    lines += [" ".join(line(rng.randrange(3, 40))) for _ in range(150)] + ["Yes", "yes", "Yes", "seven c", "eight ch", "eight ch", " \t", "", "x" * 5000, "x" * 5000, "é" * 40, " ".join(line(9000))]
    rng.shuffle(lines)
    docs, at = [], 0
    while at < len(lines):
        n = rng.randrange(1, 7)
        docs.append((len(docs), "\n".join(lines[at : at + n])))
        at += n
    return docs + [(len(docs), None), (len(docs) + 1, "")]


@pytest.fixture(scope="module")
def want(rows):
    return brute.repeated_lines(rows)


def found(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return {r.doc_id: r.removed for r in linededup.repeated_lines(df, brief=True).collect()}


def test_equals_brute_force(spark, rows, want):
    assert len(want[1]) > 300
    assert found(spark, rows) == want[0]


def test_large_groups_and_common_keys(spark, rows, want, monkeypatch):
    """Blocks of three sets, and every band key of two lines dealt to three tasks."""
    monkeypatch.setattr("logweave.llm.blocks.BLOCK_SETS", 3)
    monkeypatch.setattr(linededup, "COMMON_KEY", 16)
    monkeypatch.setattr(linededup, "SALTS", 3)
    monkeypatch.setattr("logweave.llm.common.BROADCAST_CELLS", -1)
    assert found(spark, rows) == want[0]


def test_recall_of_pairs(spark, rows, want):
    """Pairs of lines that link are candidates, short lines too, with a recall of 0.98 at least."""
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.col("doc_id"))
    lines = linededup.signatures(df).cache()
    name = {(r.doc_id, r.pos): r.line for r in lines.where("pos IS NOT NULL").collect()}
    ids = {line: name[i, pos] for i, t in rows for pos, line in brute.line_keys(t, brief=False)}
    keys = {}
    for r in lines.where("size(bands) > 0").collect():
        keys.setdefault(r.line, set()).update(r.bands)
    met = sum(bool(keys[ids[a]] & keys[ids[b]]) for a, b in want[1])
    assert met >= 0.98 * len(want[1])


def test_lines_with_repeated_shingles(spark):
    """Rules, refrains and tables: the similarity is that of the distinct shingles, however often each one comes."""
    pairs = [("-" * 20, "-" * 40), ("ha " * 10, "ha " * 30), ("=-" * 15, "=-" * 40), ("| 0.5 | 0.25 " * 4, "| 0.5 | 0.25 " * 90), ("abcdefghijk", "abcdefghijk" * 3000)]
    rows = [(i, x) for i, x in enumerate(x for p in pairs for x in p)]
    rows += [(100 + i, "\n".join(x * 2 for x in p)) for i, p in enumerate(pairs)]
    assert found(spark, rows) == brute.repeated_lines(rows)[0]


@pytest.fixture(scope="module")
def given(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", F.col("doc_id").alias("row"))
    texts = sorted({line for r in docs.collect() for _, line in brute.line_keys(r.text, brief=False)})
    return docs, texts, brute.linked_texts(texts)


def test_recall_of_edges(spark, given):
    """Over all lines of the table, pairs that link lie in one group of candidates with a recall of 0.98 at least, repeated shingles and all."""
    docs, texts, links = given
    lines = linededup.signatures(docs).cache()
    name = {}
    text = {r.doc_id: (r.text or "").split("\n") for r in docs.collect()}
    for r in lines.where("pos IS NOT NULL").collect():
        name[text[r.doc_id][r.pos]] = r.line
    edges = [(r.a, r.b) for r in linededup.candidate_edges(lines, 80).collect()]
    group = brute.components({x for e in edges for x in e} | set(name.values()), edges)
    met = sum(group[name[texts[i]]] == group[name[texts[j]]] for i, j in links)
    assert len(links) > 200
    assert met >= 0.98 * len(links)


def test_near_limit_pair_of_given_lines(spark, given):
    """A line of 234 and one of 186 characters with J = 0.80 link by distinct shingles, not by positions; alone in two documents the later one goes."""
    _, texts, links = given
    near = [(texts[i], texts[j]) for i, j in links if {len(texts[i]), len(texts[j])} == {234, 186}]
    assert near
    for a, b in near:
        assert found(spark, [(1, a), (2, b)]) == {2: [0]}
