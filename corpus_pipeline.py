"""Corpus pipeline: language ID, line dedup, near-duplicate documents, decontamination, mixing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.llm import decontam, langid, linededup, mixing, neardup
from logweave.llm.common import lookup_join, one_of_each, row_key, shared_keys, stash, table


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that language ID rejects, or only those without a letter where no row could be learnt from; the others stay as they are.

    Null and empty texts have no letter and go; repeated rows, null ids and further columns stay; an empty table stays empty.
    """
    model = langid.train(docs)
    if not model.langs:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = langid.predict(docs, model, keep=docs.columns, names=("__lw_lang", "__lw_score", "__lw_rejected"))
    return found.where(~F.col("__lw_rejected")).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one line of each class of near-duplicate lines; documents left without any line go.

    Null and empty texts have one blank line, which stays. Rows that share an id, or have none, are told apart by their texts.
    """
    return linededup.drop_repeated_lines(docs, brief=True)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, the smallest id, of each class of near-duplicates; of rows equal in id and text one stays. Rows without an id stay."""
    rows = docs.withColumn("__lw_row", row_key("doc_id", "text"))
    linked = neardup.ngram_join(rows, "__lw_row").where(F.col("n_links") > 0)
    linked = stash(linked.select(F.col("doc_id").alias("__lw_row"), F.col("component_id").alias("class")).distinct())
    named = stash(lookup_join(rows.where(F.col("doc_id").isNotNull()).select("doc_id", "__lw_row"), linked, "__lw_row"))
    first = named.groupBy("class").agg(F.min(F.struct("doc_id", "__lw_row")).alias("first"))
    gone = stash(named.join(first, "class").where(F.col("__lw_row") != F.col("first.__lw_row")).select("__lw_row").distinct())
    kept = rows.join(gone, "__lw_row", "left_anti").select(*rows.columns)
    named = one_of_each(kept.where(F.col("doc_id").isNotNull()), "__lw_row", shared_keys(rows.where(F.col("doc_id").isNotNull()), "__lw_row"))
    return named.unionByName(kept.where(F.col("doc_id").isNull())).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item; null, empty and wordless texts hold none and stay, as do repeated rows without a leak."""
    rows = docs.withColumn("__lw_row", row_key("doc_id", "text"))
    leaks = stash(decontam.find_leaks(rows, table(spark, sf_dir, "benchmark"), "__lw_row").select(F.col("doc_id").alias("__lw_row")).distinct())
    return rows.join(leaks, "__lw_row", "left_anti").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Emit each document once for each copy that the mix takes, numbered from 1; rows equal in id, text and source are one document.

    The number is the last column, mix_copy; a column of that name that the documents bring is replaced. Texts are shuffled once, to their copies.
    """
    rows = docs.withColumn("__lw_row", row_key("doc_id", "text", "source"))
    copies = mixing.mix_copies(rows, row_col="__lw_row").where(F.col("copies") > 0).groupBy(F.col("row").alias("__lw_row")).agg(F.sum("copies").alias("__lw_copies"))
    taken = one_of_each(rows, "__lw_row").join(stash(copies).hint("shuffle_hash"), "__lw_row")
    return taken.select(*[c for c in docs.columns if c != "mix_copy"], F.explode(F.sequence(F.lit(1), F.col("__lw_copies").cast("int"))).alias("mix_copy"))


STAGES = [
    ("language", keep_languages),
    ("lines", dedup_lines),
    ("documents", dedup_documents),
    ("decontamination", decontaminate),
    ("mixing", mix),
]

#: Language ID and fuzzy lines cannot be said in SQL; tests/llm has a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; each stage's rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


