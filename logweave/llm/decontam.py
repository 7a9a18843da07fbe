"""Benchmark decontamination: size-partitioned MinHash containment search, exact verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lookup_join, stash, table, word_list

WIDTH = 5
#: Share of an item's shingles that a document has to hold, as a fraction of whole numbers.
SHARE = (4, 5)


def _starts(words: Column, width: int) -> Column:
    """1-based starts of the shingles; a text of fewer words is one shingle, one without words has none."""
    return F.when(F.size(words) > 0, F.sequence(F.lit(1), F.greatest(F.size(words) - (width - 1), F.lit(1)))).otherwise(F.array().cast("array<int>"))


def _once(value: Column, use) -> Column:
    """use(value), with value computed once and not again for each element of an inner lambda."""
    return F.element_at(F.transform(F.array(value), use), 1)


def shingle_hashes(words: Column, width: int = WIDTH) -> Column:
    return _once(words, lambda w: F.transform(_starts(w, width), lambda i: F.xxhash64(F.slice(w, i, width))))


def shingle_texts(words: Column, width: int = WIDTH) -> Column:
    return F.array_distinct(_once(words, lambda w: F.transform(_starts(w, width), lambda i: F.array_join(F.slice(w, i, width), " "))))


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", width: int = WIDTH, share: tuple[int, int] = SHARE) -> DataFrame:
    """Pairs of a document and a benchmark item of which the document holds at least the given share of shingles.

    An item is indexed by its smallest shingle hashes, the bottom values of a MinHash. Items are partitioned by
    size, doubling from one partition to the next, and the partition's upper size u sets how many values are kept: one more
    than u - ceil(share * u). By pigeonhole a document that holds the share of the item holds
    one of them, however long the document is, so that the search loses nothing. Documents with too few shingles for an
    item are passed over, and each candidate is verified by exact comparison of the shingles themselves.

    Shingles are of words split at ASCII white space, ASCII letters lower-cased; a text of fewer words than the width is one
    shingle. Returns (doc_id, item_id, n_shingles, n_shared, containment), a row per pair. Null or wordless texts and items
    match nothing; rows with the same id count as one item, or as one document with its best row; a null id is an id.
    """
    num, den = share
    one = stash(
        items.select(F.col(item_col).alias("item_id"), F.explode(shingle_texts(word_list(item_text), width)).alias("shingle"))
        .distinct().withColumn("q", F.count("*").over(Window.partitionBy("item_id")))
    )
    upper = F.pow(F.lit(2), F.ceil(F.log2(F.col("q")))).cast("long")
    kept = F.col("upper") - F.ceil(F.col("upper") * num / den) + 1
    order = Window.partitionBy("item_id").orderBy("h", "shingle")
    sketch = (
        one.withColumns({"upper": upper, "h": F.xxhash64(F.split("shingle", " ", -1))}).withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= kept).select("item_id", "h", F.ceil(F.col("q") * num / den).alias("least"))
    )
    sketch = stash(sketch.distinct())
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("key"))
    hashes = d.select("key", shingle_hashes(word_list("text"), width).alias("hs"))
    probes = hashes.select("key", F.size("hs").alias("n"), F.explode("hs").alias("h"))
    wanted = stash(lookup_join(probes, sketch, "h").where(F.col("n") >= F.col("least")).select("key").distinct())
    few = lookup_join(d, wanted, "key").select("doc_id", F.monotonically_increasing_id().alias("row"), shingle_texts(word_list("text"), width).alias("all"))
    own = few.select("doc_id", "row", F.explode("all").alias("shingle"))
    shared = lookup_join(own, one, "shingle").groupBy("doc_id", "row", "item_id", "q").agg(F.count("*").alias("n_shared"))
    found = shared.where(F.col("n_shared") * den >= F.col("q") * num).groupBy("doc_id", "item_id").agg(F.max("q").alias("n_shingles"), F.max("n_shared").alias("n_shared"))
    return found.select("doc_id", "item_id", "n_shingles", "n_shared", (F.col("n_shared") / F.col("n_shingles")).alias("containment"))


def op4_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _words(id_col: str, name: str) -> str:
    return (
        f"SELECT {id_col} AS id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM {name}"
    )


def _shingles(words: str) -> str:
    return f"SELECT DISTINCT id, unnest(list_transform(range(1, greatest(len(w) - 4, CASE WHEN len(w) > 0 THEN 1 ELSE 0 END) + 1), lambda i: array_to_string(w[i:i+4], ' '))) AS s FROM ({words})"


OP4_SQL = f"""
WITH d AS ({_shingles(_words('doc_id', 'documents'))}), b AS ({_shingles(_words('item_id', 'benchmark'))}),
q AS (SELECT *, count(*) OVER (PARTITION BY id) AS q FROM b),
c AS (SELECT d.id AS doc_id, q.id AS item_id, max(q) AS n_shingles, count(*) AS n_shared FROM d JOIN q USING (s) GROUP BY 1, 2)
SELECT doc_id, item_id, n_shingles, n_shared, n_shared / n_shingles AS containment FROM c WHERE n_shared * 5 >= n_shingles * 4
"""
