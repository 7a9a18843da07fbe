"""Contract cases of single operators: shared ids, ids of other types, letters, ledgers, targets, bounded-error spans."""

import random
import re

import pytest
from pyspark.sql import functions as F

from logweave.llm import langid, licenses, mixing, neardup, secrets, tokens, topk


def test_topk_rows_that_share_an_id(spark):
    rows = [(0, [1.0, 0.0], 1), (0, [1.0, 0.5], 2), (1, [0.5, 0.5], 3), (2, [2.0, 0.0], 4)]
    v = topk.quantize(spark.createDataFrame(rows, "vec_id long, e array<float>, row long"), "vec_id", "e", 256.0)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(v.where("vec_id = 0"), v, 2).collect())
    assert got == [(0, 1, 2, 131072), (0, 1, 2, 131072), (0, 2, 0, 65536), (0, 2, 0, 65536)]
    none = v.where("false")
    assert topk.top_k(none, v).collect() == [] and topk.top_k(v, none).collect() == []


def test_string_ids_in_the_join(spark):
    text = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([("b", text), ("a", text + " more"), (None, text), ("c", None)], "doc_id string, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.ngram_join(df).collect()}
    assert got == {"b": (26, "a"), "a": (27, "a"), None: (26, "a"), "c": (0, "c")}


def test_numbers_are_no_letters(spark):
    docs = spark.createDataFrame([(i, t, "en" if t.startswith("the") else "fr") for i, t in enumerate(["the cat and the dog", "le chat et la souris"] * 20)], "doc_id long, text string, lang string")
    odd = spark.createDataFrame([(1, "½ ² 12"), (2, "x" * 300_000), (3, None), (4, "ª")], "doc_id long, text string")
    got = {r.doc_id: r.lang_pred for r in langid.predict(odd, langid.train(docs)).collect()}
    assert got[1] == got[3] == "und" and got[2] != "und" and got[4] != "und"


def test_the_training_sample_is_bounded(spark, monkeypatch):
    """Of a large language only candidates of small hashes are ordered, and they are the ones that ordering all would take."""
    rows = [(i, f"text number {'abcdefghij'[i % 10]}", "en") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = {}
    monkeypatch.setattr(langid, "fit", lambda texts, langs: seen.update(n=len(texts)) or langid.Model([], None, None, 1.0, 0.0))
    langid.train(docs, per_language=100)
    assert seen["n"] == 100


def test_only_committed_batches_count(spark, tmp_path):
    rollup = tokens.TokenRollup(spark, f"file://{tmp_path}/rollup")
    assert rollup.totals().collect() == []
    counts = spark.createDataFrame([("s", "en", "t", 10), (None, None, "t", 5)], "source string, lang string, tokenizer string, tokens long")
    assert rollup.commit("a", tokens.inserts(counts)) and rollup.commit("b", tokens.inserts(counts))
    (tmp_path / "rollup" / "batch=b" / "_SUCCESS").unlink()
    assert not rollup.committed("b") and rollup.batches() == ["a"]
    assert sorted((r.source or "", r.n_docs, r.n_tokens) for r in rollup.totals().collect()) == [("", 1, 5), ("s", 1, 10)]
    assert rollup.commit("b", tokens.revisions(counts, counts.withColumn("tokens", F.col("tokens") + 1)))
    assert rollup.commit("c", tokens.inserts(counts.where("false")))
    assert rollup.totals().agg(F.sum("n_docs"), F.sum("n_tokens")).first() == (2, 17)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_words_taken_are_near_the_targets(spark, sf):
    got = mixing.mix_copies(spark.read.parquet(f"/root/testdata/{sf}/documents.parquet"))
    by = got.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("copies").alias("copies")).collect()
    assert len(by) > 10 and all(r.copies <= 3 and abs(r.taken - r.target) <= 0.05 * r.target for r in by)


def plain_edits(a, b):
    """Least number of insertions, deletions and substitutions that turn a into b."""
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        last = row
    return last[-1]


def test_fuzzy_notices_by_brute_force(spark):
    """Every run of words within the allowed edits of a notice is found or overlaps a span that is; every span keeps its bound."""
    rng = random.Random(6)
    notices = [(p, len(p) // licenses.CHARS_PER_EDIT) for p, _ in (*licenses.BASE, *licenses.NOTICES)]
    texts = []
    for _ in range(60):
        words = [f"w{rng.randrange(50)}" for _ in range(rng.randrange(5, 30))]
        for _ in range(rng.randrange(1, 3)):
            p, edits = rng.choice(notices)
            p = list(p)
            for _ in range(rng.randrange(0, edits + 2)):
                at = rng.randrange(1, len(p) - 1)
                p[at : at + rng.randrange(0, 2)] = rng.choice(("x", "", "e"))
            words.insert(rng.randrange(len(words)), "".join(p))
        texts.append(" ".join(words))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    n = 0
    for r in licenses.scan_licenses(df).collect():
        words = [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", texts[r.id].lower()) if w]
        spans = [(s.notice, s.start_word, s.start_word + s.n_words) for s in r.spans]
        for s in r.spans:
            found = " ".join(words[s.start_word : s.start_word + s.n_words])
            assert plain_edits(s.notice, found) <= s.edits <= len(s.notice) // licenses.CHARS_PER_EDIT
        for p, edits in notices:
            k = p.count(" ") + 1
            for size in range(max(k - edits, 1), k + edits + 1):
                for a in range(len(words) - size + 1):
                    run = " ".join(words[a : a + size])
                    if abs(len(run) - len(p)) <= edits and plain_edits(p, run) <= edits:
                        n += 1
                        assert any(q == p and b < a + size and a < c for q, b, c in spans), (p, run)
    assert n > 40


def test_secrets_in_empty_tables_and_long_texts(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, blob string")
    found, new = secrets.scan_secrets(empty)
    assert found.collect() == [] and new.collect() == []
    text = "word " * 200_000 + "secret=abcdef1"
    found, _ = secrets.scan_secrets(spark.createDataFrame([(1, text, "x"), (None, text, "y")], "doc_id long, text string, blob string"))
    assert sorted((r.path or 0, r.findings[0].start) for r in found.collect()) == [(0, 1_000_000), (1, 1_000_000)]
