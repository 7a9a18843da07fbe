"""Phrase collocations by dynamic itemset counting."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, lookup_join, mix64, randoms, shared_dir, stash, table, utf8

LEAST, LONGEST, TOP = 10, 3, 2000
#: Shards of the corpus; a cycle is one scan of each.
SHARDS = 3
#: Slots of the table of phrases that have reached the threshold, a byte each: its size, some 17 MB a length, does not grow with the corpus.
SLOTS = 1 << 24
#: Text whose phrases are counted at once, in bytes; a longer document is a run of its own.
RUN_BYTES = 4 << 20
#: Parts of a language that are ranked by themselves before they meet.
SALTS = 256
NEVER = 255

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[9] = 32
_BREAK = np.zeros(256, bool)
_BREAK[list(b".,;:!?\x0a\x0b\x0c\x0d")] = True
_BYTE = np.stack([randoms(256, 101), randoms(256, 103)])
_PLACE = np.stack([randoms(16, 107), randoms(16, 109)])


class _Words:
    """The words of texts raw[offs[i]:offs[i + 1]]: where they start and end, their text, their piece, and two hashes of each."""

    def __init__(self, raw: np.ndarray, offs: np.ndarray) -> None:
        self.raw = raw = _LOWER[raw]
        part = _BREAK[raw]
        inside = ~part & (raw != 32)
        start = inside.copy()
        start[1:] &= ~inside[:-1]
        first = offs[1:-1]
        first = first[first < len(raw)]
        start[first] = inside[first]
        stop = inside.copy()
        stop[:-1] &= ~inside[1:]
        last = first[first > 0] - 1
        stop[last] = inside[last]
        self.at, self.end = np.flatnonzero(start), np.flatnonzero(stop) + 1
        self.doc = np.searchsorted(offs, self.at, "right") - 1
        self.piece = np.cumsum(part)[self.at] + self.doc
        length = self.end - self.at
        self._head = np.cumsum(length) - length
        self._letters = np.flatnonzero(inside)
        self._place = np.arange(len(self._letters)) - np.repeat(self._head, length)
        self._widest = int(length.max(initial=0))
        self._hashes: dict[int, np.ndarray] = {}

    def hashed(self, which: int) -> np.ndarray:
        """The first or second hash of each word, made when it is first asked for."""
        if which not in self._hashes:
            byte, seed = _BYTE[which], 113 + 14 * which
            # The first places have the same factors, however long the longest word of a run is.
            factor = np.concatenate([_PLACE[which], randoms(self._widest, seed)[_PLACE.shape[1] :]])
            value = byte[self.raw[self._letters]] * factor[self._place]
            self._hashes[which] = mix64(np.add.reduceat(value, self._head) + (self.end - self.at).astype(np.uint64)) if len(self._head) else np.zeros(0, np.uint64)
        return self._hashes[which]

    def keys(self, k: int, tongue: np.ndarray, which: int = 0, at: np.ndarray | None = None) -> np.ndarray:
        """The first or second hash of the k words that start at each word, or at the given ones, with that of the language of its text."""
        at = np.arange(max(len(self.at) - k + 1, 0)) if at is None else at
        h, total = self.hashed(which), tongue[self.doc[at]] + np.uint64(k)
        for j, factor in enumerate(randoms(k, 131 + 6 * which)):
            total = total + h[at + j] * factor
        return mix64(total)

    def whole(self, k: int) -> np.ndarray:
        """Whether the k words that start at each word are of one piece."""
        n = max(len(self.at) - k + 1, 0)
        return self.piece[:n] == self.piece[k - 1 : k - 1 + n]

    def phrases(self, first: np.ndarray, k: int) -> pa.Array:
        """The k words that start at each of the given ones, joined by spaces; what follows a word inside a piece is a space."""
        each = first[:, None] + np.arange(k)
        start, size = self.at[each], self.end[each] - self.at[each]
        size[:, :-1] += 1
        flat, start = size.ravel(), start.ravel()
        upto = np.cumsum(flat)
        data = self.raw[np.arange(upto[-1] if len(upto) else 0) + np.repeat(start - (upto - flat), flat)]
        offs = np.concatenate([[0], upto[k - 1 :: k]]).astype(np.int64)
        return pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(offs.tobytes()), pa.py_buffer(data.tobytes())).cast(pa.string())


def _tongues(langs: list[str]) -> np.ndarray:
    known = {x: int.from_bytes(blake2b(x.encode("utf-8", "replace"), digest_size=8).digest(), "little") for x in set(langs)}
    return np.array([known[x] for x in langs], np.uint64)


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
    """Languages, bytes and offsets of runs of the rows of a batch(lang, text)."""
    raw, offs = utf8(batch.column(1))
    start = 0
    while start < batch.num_rows:
        stop = min(max(int(np.searchsorted(offs, offs[start] + RUN_BYTES, "right")) - 1, start + 1), batch.num_rows)
        yield batch.column(0).slice(start, stop - start).to_pylist(), raw[offs[start] : offs[stop]], offs[start : stop + 1] - offs[start]
        start = stop


def _scan(shard: DataFrame, step: int, shards: int, longest: int, reached: object) -> DataFrame:
    """(phrase, start, n): the phrases that are being counted in this step, each after its language and a line feed, pre-counted by runs of text; the empty phrase counts all words.

    reached holds, for each length, the step from which on a phrase of it serves longer ones, by slot. Single words start at step 0; a longer phrase starts at
    the later of the steps of its two parts and is counted for as many steps as there are shards. A slot that several phrases share
    may start a phrase too early, which is then counted in a full cycle all the same.
    """
    schema = pa.schema([("phrase", pa.string()), ("start", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = reached.value
        for batch in batches:
            for langs, raw, offs in _runs(batch):
                words, names, tongue = _Words(raw, offs), pa.array(langs, pa.string()), _tongues(langs)

                def counted(doc: np.ndarray, phrase: pa.Array, start: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
                    named = pc.binary_join_element_wise(names.take(pa.array(doc)), phrase, "\n")
                    return pa.RecordBatch.from_arrays([named, pa.array(start.astype(np.int32)), pa.array(n)], schema=schema)

                if step < shards and len(words.at):
                    n = np.bincount(words.doc, minlength=len(langs))
                    yield counted(np.arange(len(n)), pa.array([""] * len(n)), np.zeros(len(n)), n)
                steps = np.zeros(len(words.at), np.uint8)
                for k in range(1, longest + 1):
                    if k > 1:
                        n = max(len(words.at) - k + 1, 0)
                        steps = np.maximum(served[:n], served[1 : n + 1])
                        steps[~words.whole(k)] = NEVER
                    keys = words.keys(k, tongue)
                    active = np.flatnonzero((steps != NEVER) & (steps <= step) & (steps.astype(np.int64) + shards > step))
                    if len(active):
                        order = active[np.argsort(keys[active], kind="stable")]
                        first, second = keys[order], words.keys(k, tongue, 1, order)
                        new = np.ones(len(order), bool)
                        new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
                        at = np.flatnonzero(new)
                        yield counted(words.doc[order[at]], words.phrases(order[at], k), steps[order[at]], np.diff(np.append(at, len(order))))
                    if k == longest or not tables[k - 1].any():
                        break
                    # 0 in the table stands for a phrase that has not reached the threshold.
                    served = tables[k - 1][keys & np.uint64(SLOTS - 1)]
                    # Nor does one serve longer ones before it is counted itself, whoever else has its slot.
                    served = np.maximum(np.where(served == 0, np.uint8(NEVER), served), steps)

    return shard.select("lang", "text").mapInArrow(run, "phrase string, start int, n long")


def _named() -> list[Column]:
    """Language, phrase and number of words of what _scan counts by."""
    phrase = F.substring_index("phrase", "\n", -1)
    lang = F.left("phrase", F.length("phrase") - F.length(phrase) - 1)
    k = F.when(phrase == "", 0).otherwise(F.length(phrase) - F.length(F.translate(phrase, " ", "")) + 1)
    return [lang.alias("lang"), phrase.alias("phrase"), k.cast("int").alias("k")]


def _slots(fresh: DataFrame, longest: int) -> np.ndarray:
    """(lengths, slots) whether a phrase of fresh(lang, phrase) has a slot; they come to the driver as bitmaps of the table's fixed size, in one job."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for langs, raw, offs in _runs(batch):
                words, tongue = _Words(raw, offs), _tongues(langs)
                heads = np.searchsorted(words.doc, np.arange(len(langs)))
                sizes = np.diff(np.append(heads, len(words.at)))
                for k in range(1, longest):
                    slots = words.keys(k, tongue, 0, heads[sizes == k]) & np.uint64(SLOTS - 1)
                    # Numbered from 1, as bit i of bucket b, from 1, is number 32768 (b - 1) + i + 1.
                    yield pa.RecordBatch.from_arrays([pa.array(slots.astype(np.int64) + (k - 1) * SLOTS + 1)], ["slot"])

    slots = fresh.select("lang", F.col("phrase").alias("text")).mapInArrow(run, "slot long")
    maps = slots.groupBy(F.bitmap_bucket_number("slot").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("m"))
    found = np.zeros((longest - 1) * SLOTS, bool)
    for row in maps.collect():
        found[(row.b - 1) << 15 : row.b << 15] = np.unpackbits(np.frombuffer(row.m, np.uint8), bitorder="little")
    return found.reshape(longest - 1, SLOTS)


def count_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST, shards: int = SHARDS) -> DataFrame:
    """(lang, phrase, k, n), stashed: exact counts of the phrases of up to longest words that come least times and more; the empty phrase, of length 0, has a language's number of words.

    Dynamic itemset counting: the corpus is written once as shards, which are scanned in turn, round and round. After each scan the counts so far
    are added up; a phrase starts to be counted with the first scan after both its parts, the phrases without its last and without its
    first word, have reached the threshold, while shorter ones are still being counted, and stops after one full cycle. Which phrases have reached it, the
    tasks know from a table of a fixed number of hashed slots, so that nothing broadcast grows with the corpus; counts are kept by the phrases
    themselves and are exact. Phrases that have completed their cycle below the threshold are dropped.
    """
    if not shards * longest < NEVER:
        raise ValueError("shards * longest has to be under 255")
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"), F.pmod(F.monotonically_increasing_id(), F.lit(shards)).alias("shard"))
    rows = rows.where(F.col("text") != "")
    path = f"{shared_dir(spark)}/stash-{uuid.uuid4().hex}"
    rows.write.partitionBy("shard").parquet(path)
    corpus = spark.read.schema("lang string, text string, shard long").parquet(path)
    tables = np.zeros((longest - 1, SLOTS), np.uint8)
    counts, step, last = None, 0, 0
    while step < last + shards:
        sent = spark.sparkContext.broadcast(tables)
        found = _scan(corpus.where(F.col("shard") == step % shards), step, shards, longest, sent).withColumn("known", F.lit(False))
        both = found if counts is None else counts.select(*found.columns).unionByName(found)
        total = both.groupBy("phrase").agg(F.min("start").alias("start"), F.sum("n").alias("n"), F.bool_or("known").alias("seen"))
        words, open_ = F.endswith("phrase", F.lit("\n")), F.col("start") + shards > step + 1
        known = (F.col("n") >= least) & ~words
        # Phrases are all different, so that a dictionary of them would be in vain.
        after = total.where(open_ | (F.col("n") >= least) | words).select("phrase", "start", "n", known.alias("known"), (known & ~F.col("seen")).alias("fresh"))
        after = stash(after, **{"parquet.enable.dictionary#phrase": "false"})
        sent.destroy()
        # The shuffle files of a step are deleted once the driver has collected its plan.
        del found, both, total
        spark._jvm.System.gc()
        if counts is not None:
            discard(counts)
        counts = after
        step += 1
        new = _slots(counts.where("fresh").select(*_named()), longest) & (tables == 0)
        if new.any():
            tables[new] = step
            last = step
    discard(corpus)
    return counts.where("known").unionByName(counts.where(F.endswith("phrase", F.lit("\n")))).select(*_named(), "n")


def _key(phrase: Column | str) -> Column:
    phrase = F.col(phrase) if isinstance(phrase, str) else phrase
    return F.concat(F.length("lang").cast("string"), F.lit(":"), "lang", phrase)


def _parts(words: Column, first: Column, n: Column) -> Column:
    return F.array_join(F.slice(words, first, n), " ")


def collocations(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST, top: int = TOP, percent: int = 50, shards: int = SHARDS
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the phrases of each language whose words come together most often for their parts.

    ASCII letters are lower-cased; texts are cut into pieces at . , ; : ! ? and line ends, pieces into words at spaces and tabs; phrases are
    runs of 2 to longest words of a piece that come least times and more, overlaps counted. The score is 1,000,000 a a / (l r), floored, of the lowest
    scoring cut, ties to the first one. A phrase inside a longer one that has percent of its count is dropped. Counts come from
    ``count_phrases``; products are decimals of 38 digits, exact to counts of 10^15. Null texts have no words, a null language is und, and equal rows
    count each. An empty table gives no rows. Texts of any length are counted whole. Languages are ranked in SALTS parts first, so that one that holds most
    phrases is not one task.
    """
    counts = stash(count_phrases(docs, text_col, lang_col, least, longest, shards))
    words = F.split("phrase", " ", -1)
    parts = stash(counts.where(F.col("k").between(1, longest - 1)).select(_key("phrase").alias("key"), F.col("n").alias("part")))
    found = counts.where(F.col("k") > 1).select("lang", "phrase", "k", F.col("n").alias("a"), words.alias("w"))
    whole = lambda n: F.col(n).cast("decimal(15,0)")
    cuts = found.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cuts = cuts.select("lang", "phrase", "k", "a", "cut", _key(_parts(F.col("w"), F.lit(1), F.col("cut"))).alias("left"), _key(_parts(F.col("w"), F.col("cut") + 1, F.col("k") - F.col("cut"))).alias("right"))
    cuts = lookup_join(cuts, parts.withColumnRenamed("key", "left"), "left").withColumnRenamed("part", "l")
    cuts = lookup_join(cuts, parts.withColumnRenamed("key", "right"), "right").withColumnRenamed("part", "r")
    cuts = cuts.withColumns({"above": F.lit(1_000_000).cast("decimal(7,0)") * (whole("a") * whole("a")), "below": whole("l") * whole("r")})
    scored = cuts.select("lang", "phrase", "k", "a", F.struct(F.expr("above div below").alias("score"), "cut", "l", "r").alias("c"))
    scored = scored.groupBy("lang", "phrase", "k", "a").agg(F.min("c").alias("c"))
    sizes = F.explode(F.sequence(F.lit(2), F.col("k") - 1))
    inner = found.where(F.col("k") > 2).withColumn("size", sizes).withColumn("first", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("size") + 1)))
    inner = stash(inner.groupBy(_key(_parts(F.col("w"), F.col("first"), F.col("size"))).alias("key")).agg(F.max("a").alias("longer")))
    scored = lookup_join(scored.withColumn("key", _key("phrase")), inner, "key", "left")
    scored = scored.where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * percent))
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    rows = scored.select("lang", "phrase", "a", "c.score", "c.l", "c.r")
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    dealt = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    totals = counts.where(F.col("k") == 0).select("lang", "n")
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP12_SQL = r"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
g AS (SELECT lang, array_to_string(ws[i:i + k - 1], ' ') AS phrase, k, count(*) AS f FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (VALUES (1), (2), (3)) v(k)) GROUP BY ALL),
t AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM g WHERE k = 1 GROUP BY 1),
c AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS ws FROM g WHERE k > 1 AND f >= 10),
u AS (SELECT lang, phrase, k, a, cut, array_to_string(ws[1:cut], ' ') AS x, array_to_string(ws[cut + 1:k], ' ') AS y FROM c, (VALUES (1), (2)) v(cut) WHERE cut < k),
s AS (SELECT u.lang, u.phrase, u.k, u.a, cut, x.f AS l, y.f AS r, CAST(1000000::HUGEINT * u.a * u.a // (x.f::HUGEINT * y.f) AS BIGINT) AS score FROM u JOIN g x ON x.lang = u.lang AND x.phrase = u.x JOIN g y ON y.lang = u.lang AND y.phrase = u.y),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
d AS (SELECT lang, i AS phrase, max(a) AS longer FROM (SELECT lang, a, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS i FROM c WHERE k = 3) GROUP BY 1, 2)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r, n, score FROM b JOIN t ON t.lang = b.lang LEFT JOIN d ON d.lang = b.lang AND d.phrase = b.phrase
WHERE longer IS NULL OR 100 * longer < 50 * a QUALIFY rank <= 2000"""
