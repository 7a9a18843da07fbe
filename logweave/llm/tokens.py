"""Token counts kept as delta-maintained rollups with idempotent batch commits."""

from __future__ import annotations

import base64
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lookup_join, shared_dir, slices, stash, table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
VERSION = "byte_bpe_50k"
KEYS = ("source", "lang", "tokenizer")
_BATCH = re.compile(r"[A-Za-z0-9_-]+")


def encoding(ranks: bytes, pattern: str):
    """Byte-level BPE from the contents of a public vocabulary file of ranks."""
    import tiktoken

    return tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}, special_tokens={})


def vocabulary(path: str) -> tuple[bytes, str]:
    """Contents of a vocabulary file and the pattern that splits texts for it, read on the driver."""
    import public_tokenizers

    with open(path, "rb") as f:
        return f.read(), public_tokenizers.PATTERN


def encoder(path: str):
    return encoding(*vocabulary(path))


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY, version: str = VERSION) -> DataFrame:
    """Tokens of each whole text: (doc_id, source, lang, tokenizer, tokens), one row per input row; a null text has none.

    The vocabulary file is read on the driver and shipped once to each executor; its size is that of a public vocabulary, a few MB.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), "source", "lang", F.col(text_col).alias("t"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in d.schema.fields[:3])

    shipped = docs.sparkSession.sparkContext.broadcast(vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(*shipped.value)
        for batch in batches:
            for part in slices(batch, "t"):
                n = [len(encode.encode_ordinary(t)) if t else 0 for t in part.column(3).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(n, pa.int64())], ["doc_id", "source", "lang", "tokens"])

    return d.mapInArrow(run, f"{schema}, tokens long").withColumn("tokenizer", F.lit(version))


class TokenRollup:
    """Additive totals by source, language and tokenizer version, under one folder.

    Each batch is a folder of summed deltas named by the batch. It is written under another name and renamed when it is whole; with its
    _SUCCESS marker it is committed. Committing a batch again, after a failure or by mistake, does not count twice: a committed
    name is skipped and an unfinished one is replaced. Totals are the sum of the committed deltas and of nothing else. Null sources and
    languages are groups of their own; an empty batch commits nothing but its name; without batches there are no totals.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _path(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def committed(self, batch: str) -> bool:
        fs, p = self._path(f"{self.path}/batch={batch}/_SUCCESS")
        return fs.exists(p)

    def batches(self) -> list[str]:
        """Names of the committed batches."""
        fs, p = self._path(self.path)
        found = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(b for b in (x.removeprefix("batch=") for x in found if x.startswith("batch=")) if self.committed(b))

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add one batch of changes (source, lang, tokenizer, sign, tokens); False if it was there already.

        sign is 1 for an insert, -1 for a delete; a revised count is a delete of the old one and an insert of the new. Two
        writers of one batch name must not run at once.
        """
        if not _BATCH.fullmatch(batch):
            raise ValueError(f"batch name {batch!r}")
        if self.committed(batch):
            return False
        deltas = changes.groupBy(*KEYS).agg(F.sum("sign").cast("long").alias("d_docs"), F.sum(F.col("sign") * F.col("tokens")).cast("long").alias("d_tokens"))
        unfinished = f"{self.path}/_writing-{uuid.uuid4().hex}"
        deltas.select(*[F.col(k).cast("string") for k in KEYS], "d_docs", "d_tokens").write.parquet(unfinished)
        fs, target = self._path(f"{self.path}/batch={batch}")
        fs.delete(target, True)
        if not fs.rename(self._path(unfinished)[1], target):
            raise OSError(f"cannot rename {unfinished} to {target}")
        return True

    def totals(self) -> DataFrame:
        """Sum of all committed batches; groups without documents are left out."""
        schema = ", ".join(f"{k} string" for k in KEYS) + ", d_docs long, d_tokens long"
        paths = [f"{self.path}/batch={b}" for b in self.batches()]
        deltas = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        total = deltas.groupBy(*KEYS).agg(F.sum("d_docs").alias("n_docs"), F.sum("d_tokens").alias("n_tokens"))
        return total.where((F.col("n_docs") != 0) | (F.col("n_tokens") != 0))


def inserts(counts: DataFrame) -> DataFrame:
    return counts.select(*KEYS, F.lit(1).cast("long").alias("sign"), "tokens")


def deletes(counts: DataFrame) -> DataFrame:
    return counts.select(*KEYS, F.lit(-1).cast("long").alias("sign"), "tokens")


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    return deletes(old).unionByName(inserts(new))


def op9_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of all documents. Those labelled toxic come first with no tokens, as not yet read, and are revised; a batch of them that came twice is withdrawn."""
    counts = stash(count_tokens(table(spark, sf_dir, "documents")))
    toxic = stash(table(spark, sf_dir, "labels").where(F.col("toxic") == 1).select("doc_id").distinct().withColumn("unread", F.lit(True)))
    known = stash(lookup_join(counts, toxic, "doc_id", "left"))
    labelled = known.where("unread")
    blank = labelled.withColumn("tokens", F.lit(0).cast("long"))
    rollup = TokenRollup(spark, f"{shared_dir(spark)}/rollup-{uuid.uuid4().hex}")
    rollup.commit("load", inserts(known.withColumn("tokens", F.when(F.col("unread"), 0).otherwise(F.col("tokens")).cast("long"))))
    rollup.commit("again", inserts(labelled))
    rollup.commit("revised", revisions(blank, labelled))
    rollup.commit("withdrawn", deletes(labelled))
    rollup.commit("load", inserts(counts))  # a retry changes nothing
    return rollup.totals()
