"""Phrase collocations against a plain version."""

import random
import re
from collections import Counter

import pytest

from logweave.llm import phrases

SF = "/root/testdata/sf0.001"


def plain(docs, least=10, longest=3, top=2000):
    """docs: (text, lang); the rows of collocations() by counting everything."""
    counts, total = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, longest + 1):
                counts.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    found = {p: n for p, n in counts.items() if len(p[1]) > 1 and n >= least}
    longer = Counter()
    for (lang, w), n in found.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                longer[lang, w[i : i + k]] = max(longer[lang, w[i : i + k]], n)
    rows = []
    for (lang, w), a in found.items():
        if 100 * longer[lang, w] < 50 * a:
            cuts = [(1_000_000 * a * a // (counts[lang, w[:k]] * counts[lang, w[k:]]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            rows.append((lang, -score, -a, " ".join(w).encode(), counts[lang, w[:k]], counts[lang, w[k:]]))
    out, rank = [], Counter()
    for lang, score, a, phrase, left, right in sorted(rows):
        rank[lang] += 1
        if rank[lang] <= top:
            out.append((lang, rank[lang], phrase.decode(), -a, left, right, total[lang], -score))
    return out


def found(spark, docs, **more):
    df = spark.createDataFrame([(i, *d) for i, d in enumerate(docs)], "doc_id long, text string, lang string").repartition(3)
    return sorted(tuple(r) for r in phrases.collocations(df, **more).collect())


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def test_given_documents(spark, docs):
    want = plain(docs)
    assert len(want) > 100
    assert sorted(tuple(r) for r in phrases.op12_collocations(spark, SF).collect()) == want


@pytest.mark.parametrize("shards", [2, 4])
def test_slots_shared_by_many_phrases(spark, docs, shards, monkeypatch):
    """However many phrases share a slot and so start too early, all are counted in one full cycle."""
    monkeypatch.setattr(phrases, "SLOTS", 1 << 15)
    monkeypatch.setattr(phrases, "RUN_BYTES", 2000)
    assert found(spark, docs, least=3, shards=shards, top=10**6) == plain(docs, least=3, top=10**6)


def test_longer_phrases_and_ties(spark):
    """Phrases of up to four words, many ties, few words, one that holds a third of all."""
    rng = random.Random(9)
    words = ["a", "b", "A", "é", "Ä", "x\u2028y", "und", "b-c", "'", "\x00"]
    docs = [("".join(rng.choice(words) + rng.choice((" ", " ", "  ", "\t", ". ", ",", "\n", " \r")) for _ in range(rng.randrange(60))), rng.choice(("en", "de", None, "und", ""))) for _ in range(150)]
    docs += [("the same line of words, and the same line of words " * 40, "en")] * 60
    assert found(spark, docs, longest=4, least=5, top=50) == plain(docs, longest=4, least=5, top=50)


def test_edges(spark):
    """Null and empty texts, one very long document with very long words, counts at the bound, an empty table, clashing columns."""
    long = " ".join(["w" * 30_000, "v"] * 12)
    docs = [(None, "en"), ("", "en"), (None, None), (long, "en"), ("p q " * 10, None), ("p q\n" * 9, "en")]
    assert found(spark, docs) == plain(docs)
    df = spark.createDataFrame([("p q\n" * 10, "en", 1, 2)], "text string, lang string, n int, phrase int")
    assert [tuple(r) for r in phrases.collocations(df).collect()] == [("en", 1, "p q", 10, 10, 10, 20, 1_000_000)]
    assert phrases.collocations(df.limit(0)).collect() == []


def test_products_beyond_64_bits(spark, monkeypatch):
    """Scores are exact where a a and l r have more than 64 bits."""
    a, left, right = 3 * 10**14 + 7, 10**15 - 1, 9 * 10**14 + 11
    rows = [("en", "", 0, 10**15), ("en", "p", 1, left), ("en", "q", 1, right), ("en", "p q", 2, a)]
    monkeypatch.setattr(phrases, "count_phrases", lambda *_: spark.createDataFrame(rows, "lang string, phrase string, k int, n long"))
    assert phrases.collocations(spark.range(1).selectExpr("'' AS text", "'en' AS lang")).first().score == 1_000_000 * a * a // (left * right)
