"""The pipeline, stage by stage and as a whole, against a plain version."""

import random

import brute
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from logweave.llm import langid

GIVEN = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """All documents of the smallest tables, and planted ones: copies, leaks, shared lines, nulls, empty and very long texts; columns with clashing names."""
    rng, path = random.Random(12), str(tmp_path_factory.mktemp("tables"))
    docs = spark.read.parquet(f"{GIVEN}/documents.parquet")
    items = spark.read.parquet(f"{GIVEN}/benchmark.parquet")
    texts = [r.text for r in docs.orderBy("doc_id").collect()]
    tests = [r.text for r in items.orderBy("item_id").collect()]
    vocabulary = sorted({w for t in texts[:40] for w in t.split()})
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    planted = [texts[3], texts[3], texts[5] + " and more", f"{prose(80)} {tests[0]} {prose(40)}", f"{prose(30)}\n{tests[1].upper()}", tests[2], prose(20_000)]
    planted += [f"{prose(40)}\nAll rights reserved.\n{prose(30)}" for _ in range(4)] + ["All rights reserved.", "", None, "12 34 --", " \n\t\n", prose(3), prose(5)]
    # The same words in lines of other lengths: near copies that no line gives away.
    words = prose(300).split()
    planted += ["\n".join(" ".join(words[k : k + n]) for k in range(0, len(words), n)) + f"\n{prose(n)}" for n in (7, 11, 17)]
    rows = [(100_000 + i, t, None if i % 3 else "en", (None, "", "src1", "planted")[i % 4], None if t is None else len(t)) for i, t in enumerate(planted)]
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    rows = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("n_chars", F.col("n_chars").cast(docs.schema["n_chars"].dataType))
    extra = {"copies": F.lit(7), "class": F.lit("x"), "row": F.lit(1), "node": F.lit(None).cast("string"), "size": F.col("doc_id") * 2}
    docs.select(*names).unionByName(rows).withColumns(extra).repartition(4).write.parquet(f"{path}/documents.parquet")
    items.write.parquet(f"{path}/benchmark.parquet")
    return path


def test_run_equals_the_plain_version(spark, folder, monkeypatch):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    given = [(r.doc_id, r.text, r.source) for r in docs.orderBy("doc_id").collect()]
    items = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    want, copies = brute.pipeline(given, items, langid.train(docs))
    assert [len(given), *map(len, want)] == sorted([len(given), *map(len, want)], reverse=True) and len(want[3]) < len(want[2]) < len(want[1]) < len(given)
    outs, plain = [], [[d[:2] for d in w] for w in want]
    wrapped = [(name, lambda sp, d, f, fn=fn: outs.append(d) or fn(sp, d, f)) for name, fn in corpus_pipeline.STAGES]
    monkeypatch.setattr(corpus_pipeline, "STAGES", wrapped)
    out = corpus_pipeline.run(spark, folder)
    for (name, _), rows, kept in zip(wrapped, outs[1:], plain, strict=False):
        assert rows.columns == docs.columns, name
        assert sorted((r.doc_id, r.text) for r in rows.collect()) == sorted(kept, key=lambda d: d[0]), name
    assert out.columns == [*docs.columns, "mix_copy"]
    got = sorted((r.doc_id, r.text, r.source or "", r.mix_copy, r["size"]) for r in out.collect())
    assert got == sorted((i, t, s or "", n, 2 * i) for i, t, s in want[3] for n in range(1, copies[i] + 1))
    assert out.where("n_chars <> length(text)").count() == 0


def test_an_empty_table_stays_empty(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").where("false").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
