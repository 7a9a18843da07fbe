"""Exact top-k inner-product search by term-at-a-time accumulation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stash, table

K = 5
QUERY_EVERY = 50
CANDIDATE_BLOCK = 8192
QUERY_BLOCK = 4096
#: Query rows scored at once; the dense score array is this many rows times CANDIDATE_BLOCK.
SCORE_ROWS = 128


def quantize(vectors: DataFrame, id_col: str, vec_col: str, scale: float) -> DataFrame:
    """Integer components floor(scale * x); vectors that are null or hold null or non-finite components go. A column row stays."""
    x = F.transform(F.col(vec_col), lambda v: v.cast("double"))
    extra = [c for c in ["row"] if c in vectors.columns]
    bad = F.exists(F.col("x"), lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    return (
        vectors.select(*extra, F.col(id_col).cast("long").alias("vec_id"), x.alias("x"))
        .where(F.col("x").isNotNull() & ~bad)
        .select(*extra, "vec_id", F.transform("x", lambda v: F.floor(v * F.lit(float(scale)))).alias("q"))
    )


def _matrix(rows: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def score_block(queries: pd.DataFrame, cands: pd.DataFrame, k: int) -> Iterator[pd.DataFrame]:
    """Top k of one block of candidates for each query: postings by term, dense scores, partition selection."""
    if not len(queries) or not len(cands):
        return
    width = max(max(map(len, queries["q"])), max(map(len, cands["q"])))
    ids, rows_of, c = cands["vec_id"].to_numpy(), cands["row"].to_numpy(), _matrix(cands["q"], width)
    order = np.lexsort((rows_of, ids))
    ids, rows_of, c = ids[order], rows_of[order], c[order]
    postings = [(rows, c[rows, t]) for t in range(width) for rows in [np.flatnonzero(c[:, t])]]
    q_ids, q_rows, q = queries["vec_id"].to_numpy(), queries["row"].to_numpy(), _matrix(queries["q"], width)
    for start in range(0, len(q), SCORE_ROWS):
        part, names, own_rows = (x[start : start + SCORE_ROWS] for x in (q, q_ids, q_rows))
        scores = np.zeros((len(part), len(ids)), np.int64)
        for t, (rows, weights) in enumerate(postings):
            hit = np.flatnonzero(part[:, t])
            if len(rows) == len(ids) and len(hit) == len(part):
                scores += part[:, t, None] * weights
            elif len(rows) and len(hit):
                scores[np.ix_(hit, rows)] += part[hit, t, None] * weights
        found = []
        for name, own_row, row in zip(names, own_rows, scores):
            own = np.flatnonzero(rows_of == own_row)
            keep = np.delete(np.arange(len(ids)), own) if len(own) else np.arange(len(ids))
            values = row[keep]
            if len(values) > k:
                least = np.partition(values, len(values) - k)[len(values) - k]
                above = np.flatnonzero(values > least)
                ties = np.flatnonzero(values == least)[: k - len(above)]  # ids ascend
                pick = np.concatenate([above, ties])
            else:
                pick = np.arange(len(values))
            found.append(pd.DataFrame({"query_row": own_row, "query_id": name, "vec_id": ids[keep[pick]], "score": values[pick]}))
        yield pd.concat(found)


def top_k(queries: DataFrame, cands: DataFrame, k: int = K) -> DataFrame:
    """The k candidates of highest integer inner product for each query, in blocks of both sides.

    Both sides have (vec_id long, q array<long>), and a column row, the same on both, if ids may be shared; without it rows are told
    apart by their ids. Each block of queries meets each block of candidates once; a task
    holds one pair of blocks, and of each pair at most k rows a query go on to the merge.
    Missing components of shorter vectors count as zero. A query's own row is no candidate; ties go to the
    smaller vec_id; query rows with one id each get their own k results. Empty sides give an empty result.
    """
    queries, cands = (stash(x if "row" in x.columns else x.withColumn("row", F.col("vec_id"))) for x in (queries, cands))
    nq, nc = -(-max(queries.count(), 1) // QUERY_BLOCK), -(-max(cands.count(), 1) // CANDIDATE_BLOCK)
    block = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.select("row", "vec_id", "q", block(nq).alias("qb")).select("*", each(nc).alias("cb"))
    c = cands.select("row", "vec_id", "q", block(nc).alias("cb")).select("*", each(nq).alias("qb"))

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        parts = list(score_block(left, right, k))
        return pd.concat(parts) if parts else pd.DataFrame({"query_row": [], "query_id": [], "vec_id": [], "score": []}).astype("int64")

    part = q.groupBy("qb", "cb").cogroup(c.groupBy("qb", "cb")).applyInPandas(best, "query_row long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))
    return part.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five best of all vectors for each query row; equal ids are told apart by numbers written with the rows."""
    v = stash(quantize(table(spark, sf_dir, "embeddings").withColumn("row", F.monotonically_increasing_id()), "vec_id", "embedding", 256.0))
    return top_k(v.where(F.col("vec_id") % QUERY_EVERY == 0), v.where(F.col("vec_id").isNotNull()))


OP7_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
