"""Language ID: averaged hashed subword embeddings with a linear softmax, trained by SGD in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lookup_join, mix64, slices, stash, table

BUCKETS = 1 << 16
ORDERS = (1, 2, 3, 4)
#: Bounds of the training sample: rows for each language, and characters of a row.
PER_LANGUAGE = 500
SAMPLE_CHARS = 20_000
UNKNOWN = "und"

_SPACES = bytes(c if chr(c).isalpha() else 32 for c in range(128)) + bytes(range(128, 256))


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def _clean(text: str) -> bytes:
    """Lower-cased text as bytes, ASCII other than letters as spaces, a space at either end."""
    return b" " + text.lower().encode("utf-8", "replace").translate(_SPACES) + b" "


def _grams(raw: np.ndarray, order: int) -> np.ndarray:
    """Bucket of the byte n-gram that starts at each position."""
    n = len(raw) - order + 1
    key = np.zeros(max(n, 0), np.uint64)
    for k in range(order):
        key = (key << np.uint64(8)) | raw[k : k + n]
    return (mix64(key * np.uint64(8) + np.uint64(order)) & np.uint64(BUCKETS - 1)).astype(np.int64)


@dataclass
class Model:
    """scores: embedding times softmax weights for each bucket, so that a text's logits are a mean of its rows."""

    langs: list[str]
    scores: np.ndarray
    bias: np.ndarray
    temperature: float
    reject_below: float

    def logits(self, texts: list[bytes]) -> np.ndarray:
        raw = np.frombuffer(b"".join(texts), np.uint8)
        ends = np.cumsum([len(t) for t in texts])
        starts = ends - [len(t) for t in texts]
        total, count = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts))
        for order in ORDERS:
            index = _grams(raw, order)
            a, b = np.minimum(starts, len(index)), np.clip(ends - order + 1, starts, len(index))
            for c in range(len(self.langs)):
                sums = np.concatenate([[0.0], np.cumsum(self.scores[c][index], dtype=np.float64)])
                total[:, c] += sums[b] - sums[a]
            count += b - a
        return total / np.maximum(count, 1)[:, None] + self.bias

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
        there = [i for i, t in enumerate(texts) if t and has_letter(t)]
        if there and self.langs:
            p = softmax(self.logits([_clean(texts[i]) for i in there]) / self.temperature)
            for i, row in zip(there, p):
                out[i] = (self.langs[int(row.argmax())], float(min(max(row.max(), 0.0), 1.0)))
        return out


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(texts: list[str], langs: list[str], dim: int = 16, epochs: int = 6, rate: float = 0.5, seed: int = 7) -> Model:
    """Train on the driver from a bounded sample; a fifth of it sets the temperature and the rejection bound."""
    names = sorted(set(langs))
    y = np.array([names.index(x) for x in langs])
    rows = []
    for t in texts:
        raw = np.frombuffer(_clean(t), np.uint8)
        index, n = np.unique(np.concatenate([_grams(raw, k) for k in ORDERS]), return_counts=True)
        rows.append((index, (n / n.sum()).astype(np.float32)))
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    held, used = order[: len(rows) // 5], order[len(rows) // 5 :]
    e = rng.normal(0, 1.0, (BUCKETS, dim)).astype(np.float32)
    w, b = np.zeros((dim, len(names)), np.float32), np.zeros(len(names), np.float32)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(used):
            index, weight = rows[i]
            own = e[index]
            h = weight @ own
            g = softmax(h @ w + b)
            g[y[i]] -= 1
            e[index] = own - (10 * step) * np.outer(weight, w @ g)
            w -= step * np.outer(h, g)
            b -= step * g
    model = Model(names, np.ascontiguousarray((e @ w).T.astype(np.float32)), b.astype(np.float64), 1.0, 0.0)
    if len(held):
        z = np.array([model.scores[:, rows[i][0]] @ rows[i][1] + b for i in held], np.float64)
        loss = lambda t: -np.log(softmax(z / t)[np.arange(len(held)), y[held]] + 1e-12).mean()
        model.temperature = float(min(np.geomspace(0.05, 5, 60), key=loss))
        model.reject_below = float(min(0.5, np.quantile(softmax(z / model.temperature).max(axis=1), 0.001)))
    return model


def held_out(id_col: str = "doc_id"):
    """Rows that training never sees: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """Fit on at most per_language labelled rows of each language, taken in the order of their ids' hash.

    Rows without id, text or label, held-out rows and rows over SAMPLE_CHARS characters are not sampled. Labels are counted
    first, and of a language with many rows only those whose hash is so small that some four times per_language pass are ordered, so that
    no task gets more, however large a language is.
    """
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    d = d.where(~held_out("id") & F.col("id").isNotNull() & F.col("lang").isNotNull() & F.length("text").between(1, SAMPLE_CHARS))
    counts = stash(d.groupBy("lang").agg(F.count("*").alias("n")))
    # Hashes run from -2**63 to 2**63.
    early = F.xxhash64("id").cast("double") + 2.0**63 <= F.lit(4.0 * per_language * 2.0**64) / F.col("n")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id"))
    ids = lookup_join(d.select("id", "lang"), counts, "lang").where(early).withColumn("rank", rank).where(F.col("rank") <= per_language).select(F.col("id").alias("pick")).distinct()
    rows = d.join(F.broadcast(ids), F.col("id") == F.col("pick")).select("id", "lang", "text").toPandas()
    rows = rows[rows["text"].map(has_letter).astype(bool)].sort_values(["id", "lang", "text"])
    return fit(list(rows["text"]), list(rows["lang"])) if len(rows) else Model([], np.zeros((0, BUCKETS), np.float32), np.zeros(0), 1.0, 0.0)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, names: tuple[str, str, str] = ("lang_pred", "score", "rejected")) -> DataFrame:
    """Each row's language and calibrated probability, from its whole text alone.

    Returns the kept columns (the id if none are named) and lang_pred, score, rejected, under the names given. A text that is null or has no letter is ``und`` with score 0
    and is rejected, as are texts whose probability is under the model's bound. One row per input row; an empty
    table gives an empty result.
    """
    keep = keep or [id_col]
    given = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text_col).alias("t"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join(f"k{i} {given.schema[i].dataType.simpleString()}" for i in range(len(keep)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in slices(batch, "t"):
                found = m.predict(part.column(len(keep)).to_pylist())
                lang, score = [x for x, _ in found], [s for _, s in found]
                rejected = [x == UNKNOWN or s < m.reject_below for x, s in found]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[: len(keep)], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())],
                    [*[f"k{i}" for i in range(len(keep))], "lang_pred", "score", "rejected"],
                )

    out = given.mapInArrow(run, f"{schema}, lang_pred string, score double, rejected boolean")
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *[F.col(c).alias(n) for c, n in zip(("lang_pred", "score", "rejected"), names)])


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = predict(docs, train(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


