"""Helpers shared by the operators: scratch tables, size-checked look-up joins, text slices."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A look-up side of at most this many cells is broadcast, some 60 MB; a larger one is shuffled. A row is a cell, and so
#: is each element of its arrays and each 16 bytes of its strings.
BROADCAST_CELLS = 1_000_000

#: Text handled at once by the array code, in bytes; a longer document is a slice of its own.
SLICE_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """Folder named by spark.checkpoint.dir; in local mode a temporary one is set where it is unset, a cluster has to name one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stash(df: DataFrame, **options: str) -> DataFrame:
    """Write df as Parquet, with the given options, in the shared folder and read it back, which cuts its lineage."""
    path = f"{shared_dir(df.sparkSession)}/stash-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*stashed: DataFrame) -> None:
    """Delete the tables of stash() that nothing reads any more, to free their disk."""
    for df in stashed:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _cells(small: DataFrame) -> F.Column:
    cells = F.lit(1).cast("long")
    for f in small.schema.fields:
        kind = f.dataType.typeName()
        if kind == "array":
            cells = cells + F.greatest(F.size(f.name), F.lit(0))
        elif kind == "string":
            cells = cells + F.floor(F.coalesce(F.octet_length(f.name), F.lit(0)) / 16)
    return cells


#: Tasks that share the rows of one key of a salted look-up.
SALTS = 16


def lookup_join(big: DataFrame, small: DataFrame, on: str, how: str = "inner", salt: str | None = None) -> DataFrame:
    """Join a wide table with a narrower stashed one on a column of both; nulls meet nulls, and big's column stays.

    The narrow side is broadcast if it is measured as BROADCAST_CELLS at most; beyond that it
    becomes the build side of a shuffled hash join. Where a key may have very many rows, salt names a column of big by whose hash they are
    spread over SALTS tasks, each with a copy of the narrow side's row. Either way no row is lost.
    """
    cells = small.select(_cells(small).alias("n")).agg(F.sum("n")).first()[0] or 0
    small = small.withColumnRenamed(on, "__lw_key")
    if cells <= BROADCAST_CELLS:
        return big.join(small.hint("broadcast"), big[on].eqNullSafe(small["__lw_key"]), how).drop("__lw_key")
    if salt is None:
        return big.join(small.hint("shuffle_hash"), big[on].eqNullSafe(small["__lw_key"]), how).drop("__lw_key")
    dealt = big.withColumn("__lw_salt", F.pmod(F.xxhash64(salt), F.lit(SALTS)).cast("int"))
    copies = small.withColumn("__lw_copy", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("shuffle_hash")
    met = dealt["__lw_salt"] == copies["__lw_copy"]
    return dealt.join(copies, met & dealt[on].eqNullSafe(copies["__lw_key"]), how).drop("__lw_key", "__lw_salt", "__lw_copy")


def row_key(*columns: str) -> F.Column:
    """Hash that tells rows apart by the given columns, as ids may be null or shared; nulls count, wherever they stand."""
    return F.xxhash64(*[F.col(c).isNull() for c in columns], *columns)


def shared_keys(df: DataFrame, key: str) -> DataFrame:
    """(key), stashed: the keys of more than one row."""
    return stash(df.groupBy(key).count().where(F.col("count") > 1).select(key))


def one_of_each(df: DataFrame, key: str, shared: DataFrame | None = None) -> DataFrame:
    """df with one row of those that share a key; only the rows of such keys are shuffled."""
    shared = shared_keys(df, key) if shared is None else shared
    if shared.isEmpty():
        return df
    return df.join(shared, key, "left_anti").select(*df.columns).unionByName(df.join(shared, key, "left_semi").select(*df.columns).dropDuplicates([key]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and its n + 1 offsets into them; a null counts as empty."""
    column = column.fill_null("").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, offs


def slices(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about SLICE_BYTES of text, so that arrays stay small."""
    if not batch.num_rows:
        return
    _, offs = utf8(batch.column(text))
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(offs, offs[start] + SLICE_BYTES, "right")) - 1
        end = min(max(end, start + 1), batch.num_rows)
        yield batch.slice(start, end - start)
        start = end


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalising mixer for 64-bit hashes."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def randoms(n: int, seed: int) -> np.ndarray:
    """n odd pseudo-random 64-bit numbers, the same on every machine."""
    base = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mix64(base + np.uint64(seed)) | np.uint64(1)


def word_list(text: F.Column | str) -> F.Column:
    """Words of a text as an array: ASCII letters lower-cased, split at ASCII white space, nulls empty."""
    text = F.col(text) if isinstance(text, str) else text
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(low, r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
