"""Fuzzy line dedup: MinHash candidates, exact verification, distributed union-find."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .blocks import jaccard_need, large_groups, link_groups
from .common import discard, lookup_join, mix64, randoms, row_key, shared_keys, slices, stash, table
from .components import connected_components

#: Characters of a shingle; a shorter line has none and can only be equal to others.
WIDTH = 8
PERCENT = 80
#: Two lines of similarity 0.8 share one of 12 bands of 5 values with probability 0.991, two of similarity 0.3 with 0.03.
BANDS, ROWS = 12, 5
#: A band key met so often is common: its lines are dealt to SALTS tasks. A task reports keys that it meets a 16th as often.
COMMON_KEY, COMMON_LIMIT, SALTS = 4096, 10_000, 64
#: Shingles whose signatures are made at once.
RUN = 1 << 16

_CHAR = randoms(WIDTH, 53)
_FACTOR = randoms(BANDS * ROWS, 67).astype(np.uint32)
_BAND = randoms(ROWS, 71)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


def _hashes(codes: np.ndarray) -> np.ndarray:
    """Hash of the shingle that starts at each character."""
    n = max(len(codes) - WIDTH + 1, 0)
    out = np.zeros(n, np.uint64)
    for k in range(WIDTH):
        out += codes[k : k + n].astype(np.uint64) * _CHAR[k]
    return mix64(out)


def _bands(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(lines, BANDS) keys from the MinHash signatures of the lines at hashes[start:end]; lines are taken in runs whose arrays stay in the cache."""
    keys = np.empty((len(starts), BANDS), np.uint64)
    upto = np.cumsum(ends - starts)
    a = 0
    while a < len(starts):
        z = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + RUN, "right")))
        n = ends[a:z] - starts[a:z]
        at = np.concatenate([[0], np.cumsum(n)[:-1]])
        # The shingle hashes are mixed already, so that each odd factor orders them anew.
        small = hashes[np.arange(n.sum()) + np.repeat(starts[a:z] - at, n)].astype(np.uint32)
        work = np.empty_like(small)
        for b in range(BANDS):
            key = np.full(z - a, b + 1, np.uint64)
            for r in range(ROWS):
                np.multiply(small, _FACTOR[b * ROWS + r], out=work)
                key = mix64(key + np.minimum.reduceat(work, at).astype(np.uint64) * _BAND[r])
            keys[a:z, b] = key
        a = z
    return keys


def _sizes(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Number of distinct shingles of each line at hashes[start:end], in runs whose arrays stay in the cache.

    One sort of the lines' numbers and the leading bits of the hashes, all that a word has room for, tells them apart; a line that is a run of its own is counted by whole hashes.
    """
    sizes = np.empty(len(starts), np.int64)
    upto = np.cumsum(ends - starts)
    a = 0
    while a < len(starts):
        z = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + RUN, "right")))
        if z == a + 1:
            sizes[a] = len(np.unique(hashes[starts[a] : ends[a]]))
        else:
            n = ends[a:z] - starts[a:z]
            bits = np.uint64(int(z - a).bit_length())
            keys = np.concatenate([hashes[i:j] for i, j in zip(starts[a:z].tolist(), ends[a:z].tolist())])
            keys >>= bits
            keys |= np.repeat(np.arange(z - a, dtype=np.uint64) << (np.uint64(64) - bits), n)
            keys.sort()
            new = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            sizes[a:z] = 1 + np.bincount((keys[new] >> (np.uint64(64) - bits)).astype(np.int64), minlength=z - a)
            # The first key of a line differs from the last one of the line before.
            sizes[a + 1 : z] -= 1
        a = z
    return sizes


def _line_ids(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each line as a sequence of shingles."""
    n = ends - starts
    at = np.concatenate([[0], np.cumsum(n)[:-1]])
    place = np.arange(n.sum()) - np.repeat(at, n)
    value = mix64(hashes[place + np.repeat(starts, n)] + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return mix64(np.add.reduceat(value, at) + n.astype(np.uint64)).view(np.int64)


def _brief_ids(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each line under WIDTH characters, and whether it has more than white space."""
    value, filled = (ends - starts).astype(np.uint64), np.zeros(len(starts), bool)
    for k in range(WIDTH - 1):
        c = np.where(starts + k < ends, codes[np.minimum(starts + k, len(codes) - 1)], 32)
        value += c.astype(np.uint64) * _CHAR[k]
        filled |= (c != 32) & ((c < 9) | (c > 13))
    return mix64(mix64(value) + _CHAR[-1]).view(np.int64), filled


def _judged(texts: list[str | None], brief: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, position and id of every line to judge, the shingle hashes, and where the line's own start and end in them; brief adds lines without any."""
    codes = _codes("\n".join(t or "" for t in texts) + "\n")
    stops = np.flatnonzero(codes == 10)
    begins = np.concatenate([[0], stops[:-1] + 1])
    per_row = np.array([(t or "").count("\n") + 1 for t in texts])
    row = np.repeat(np.arange(len(texts)), per_row)
    pos = np.arange(len(row)) - np.repeat(np.cumsum(per_row) - per_row, per_row)
    ends = np.maximum(stops - WIDTH + 1, begins)
    hashes, keep, line = _hashes(codes), ends > begins, np.zeros(len(row), np.int64)
    if keep.any():
        line[keep] = _line_ids(hashes, begins[keep], ends[keep])
    if brief:
        short = np.flatnonzero(~keep)
        line[short], keep[short] = _brief_ids(codes, begins[short], stops[short])
    return row[keep], pos[keep], line[keep], hashes, begins[keep], ends[keep]


def signatures(docs: DataFrame, brief: bool = False) -> DataFrame:
    """(doc_id, row, pos, line, size, bands) of every judged line; bands are empty and size is 0 where the task has given them for the same line, and for brief lines.

    The size is the number of distinct shingles, by which lines are compared. Rows without a pos tell a band key that the task has met often, as line, and how often, as size.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "row", "pos", "line", "size", "bands"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        pending: list[np.ndarray] = []

        def often(like: pa.RecordBatch) -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(pending), return_counts=True)
            pending.clear()
            many = n >= COMMON_KEY // 16
            m = int(many.sum())
            empty = pa.ListArray.from_arrays(pa.array(np.zeros(m + 1, np.int32)), pa.array([], pa.int64()))
            return pa.RecordBatch.from_arrays([*(pa.nulls(m, t) for t in (like.schema.field("doc_id").type, pa.int64(), pa.int32())), pa.array(keys[many]), pa.array(n[many].astype(np.int64)), empty], names)

        part = None
        for batch in batches:
            for part in slices(batch, "text"):
                row, pos, line, hashes, starts, ends = _judged(part.column("text").to_pylist(), brief)
                if not len(row):
                    continue
                fresh = np.zeros(len(line), bool)
                for i, name in zip(np.flatnonzero(ends > starts).tolist(), line[ends > starts].tolist()):
                    if name not in done:
                        done.add(name)
                        fresh[i] = True
                size = np.zeros(len(line), np.int64)
                size[fresh] = _sizes(hashes, starts[fresh], ends[fresh])
                offs = np.concatenate([[0], np.cumsum(fresh)]) * BANDS
                keys = _bands(hashes, starts[fresh], ends[fresh]).ravel().view(np.int64) if fresh.any() else np.zeros(0, np.int64)
                pending.append(keys)
                bands = pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(keys))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c).take(pa.array(row)) for c in ("doc_id", "row")), pa.array(pos.astype(np.int32)), pa.array(line), pa.array(size), bands], names
                )
                if sum(map(len, pending)) > 2_000_000:
                    yield often(part)
        if pending:
            yield often(part)

    return docs.mapInArrow(run, f"doc_id {kind}, row long, pos int, line long, size long, bands array<long>")


def candidate_edges(lines: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) that connect the lines of a band key whose sizes allow the similarity, stashed; two a posting at most.

    In a key, lines are ordered by size and each is tied to the one before it if their sizes allow a link, so that what could link is
    connected and no line gathers many edges. A common key is dealt to SALTS tasks, and the smallest
    lines of each task and size class, the classes being such that lines that could link are in one or in neighbouring ones, are tied across.
    """
    common = lines.where(F.col("pos").isNull()).groupBy(F.col("line").alias("key")).agg(F.sum("size").alias("n")).where(F.col("n") >= COMMON_KEY)
    common = stash(common.orderBy(F.desc("n"), "key").limit(COMMON_LIMIT).select("key", F.lit(True).alias("common")))
    found = lines.where(F.size("bands") > 0).select(F.explode("bands").alias("key"), F.col("line").alias("node"), F.col("size").cast("int").alias("size"))
    postings = lookup_join(found, common, "key", "left")
    postings = postings.select("key", "node", "size", F.when(F.col("common"), 1 + F.pmod(F.xxhash64("node"), F.lit(SALTS))).otherwise(0).cast("int").alias("salt"))
    order = Window.partitionBy("key", "salt").orderBy("size", "node")
    cell = F.floor(F.log("size") / F.log(F.lit(100 / percent))).cast("int")
    before = F.lag(F.struct("node", "size")).over(order)
    tied = postings.withColumns({"before": before, "cell": cell})
    tied = stash(tied.where(F.col("before").isNotNull() & (F.col("before.node") != F.col("node")) & (F.col("size") * percent <= F.col("before.size") * 100) | (F.col("salt") > 0)))
    inside = tied.where((F.col("before.node") != F.col("node")) & (F.col("size") * percent <= F.col("before.size") * 100)).select(F.col("node").alias("a"), F.col("before.node").alias("b"))
    heads = tied.where(F.col("salt") > 0).groupBy("key", "salt", "cell").agg(F.min("node").alias("low"))
    last = F.lag(F.struct("low", "cell")).over(Window.partitionBy("key").orderBy("cell", "salt"))
    across = heads.withColumn("last", last).where((F.col("cell") - F.col("last.cell") <= 1) & (F.col("low") != F.col("last.low"))).select(F.col("low").alias("a"), F.col("last.low").alias("b"))
    edges = stash(inside.unionByName(across).distinct())
    discard(tied)
    return edges


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, grp, size, line): the texts of the wanted(row, pos, node, grp, size) lines."""
    per_doc = stash(wanted.groupBy("row").agg(F.collect_list(F.struct("pos", "node", "grp", "size")).alias("wants")))
    cut = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    found = lookup_join(docs, per_doc, "row").select(cut.alias("lines"), F.explode("wants").alias("w"))
    # Rows equal in id and text have the same lines.
    return found.select("w.node", "w.grp", "w.size", F.get("lines", F.col("w.pos")).alias("line")).dropDuplicates(["node"])


def line_sets(column: pa.Array) -> list[np.ndarray]:
    """Sorted shingle hashes of each line of a string column."""
    return [np.unique(_hashes(_codes(t))) for t in column.to_pylist()]


def line_classes(docs: DataFrame, lines: DataFrame, percent: int) -> DataFrame:
    """(line, class) of the lines that link with another one, by exact Jaccard similarity of the candidates' shingles."""
    edges = candidate_edges(lines, percent)
    groups = stash(connected_components(edges).withColumnRenamed("component", "grp"))
    spots = lines.where(F.col("pos").isNotNull()).groupBy(F.col("line").alias("node")).agg(F.min(F.struct("doc_id", "row", "pos")).alias("at"), F.max("size").alias("size"))
    members = stash(lookup_join(spots, groups, "node").select("node", "grp", "size", "at.row", "at.pos"))
    large = large_groups(members)
    texts = stash(_texts(docs, members))
    links = stash(link_groups(texts, edges, large, jaccard_need(percent), line_sets, "line"))
    classes = stash(connected_components(links).select(F.col("node").alias("line"), F.col("component").alias("class")))
    discard(edges, groups, members, large, texts, links)
    return classes


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, brief: bool = False) -> DataFrame:
    """(doc_id, row, removed, twins): positions, from 0, of the lines that another line stands for; only documents that have some.

    Lines end at line feeds. Those of WIDTH characters or more are judged, and with brief also shorter ones that have more than white
    space, which are classes of equal lines; equal ones are one node. MinHash signatures of their
    character shingles are cut into bands, nodes that share a band and are alike in size are connected, and inside each connected group the sets of
    shingles are compared exactly, in blocks of bounded size. Links of the given similarity make
    classes by distributed union-find; of each class the line with the smallest document id, then position, stays. Null texts have one
    empty line; a null id comes before all others. Rows with a null or a shared id are told apart by their texts: row is the row_key of id and
    text. Of rows equal in both, one loses the positions removed and each other one those in twins, which are all that are judged.
    Lines of any length are judged whole; an empty table gives an empty result.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), row_key(id_col, text_col).alias("row"))
    lines = stash(signatures(d, brief))
    classes = line_classes(d, lines, percent)
    first = F.min(F.struct("doc_id", "row", "pos"))
    placed = lines.where(F.col("pos").isNotNull()).select("doc_id", "row", "pos", "line")
    spots = placed.groupBy("line").agg(first.alias("first"), F.count("*").alias("n"))
    spots = stash(lookup_join(spots, classes, "line", "left").where((F.col("n") > 1) | F.col("class").isNotNull()))
    heads = stash(spots.where(F.col("class").isNotNull()).groupBy("class").agg(F.min("first").alias("head")))
    named = stash(lookup_join(spots, heads, "class", "left", salt="line").select("line", F.coalesce("head", "first").alias("kept")))
    gone = lookup_join(placed, named, "line", salt="row").where(~F.struct("doc_id", "row", "pos").eqNullSafe(F.col("kept")))
    gone = gone.select("doc_id", "row", "pos", F.lit(None).cast("int").alias("twin"))
    shared = shared_keys(d.select("row"), "row")
    if not shared.isEmpty():
        gone = gone.unionByName(lookup_join(placed, shared, "row").select("doc_id", "row", F.lit(None).cast("int").alias("pos"), F.col("pos").alias("twin")))
    removed = stash(gone.groupBy("doc_id", "row").agg(F.sort_array(F.collect_set("pos")).alias("removed"), F.sort_array(F.collect_set("twin")).alias("twins")))
    discard(lines, classes, spots, heads, named)
    return removed


def _with_removed(docs: DataFrame, removed: DataFrame) -> DataFrame:
    """docs(__lw_row, ...) with __lw_removed, the positions that each row loses; of equal rows, which one comes first is open."""
    found = removed.select(F.col("row").alias("__lw_row"), F.col("removed").alias("__lw_removed"), F.col("twins").alias("__lw_twins"))
    joined = lookup_join(docs, found, "__lw_row", "left")
    equal = F.coalesce(F.size("__lw_twins") > 0, F.lit(False))
    if found.where(equal).isEmpty():
        return joined.drop("__lw_twins")
    place = F.row_number().over(Window.partitionBy("__lw_row").orderBy("__lw_row"))
    twins = joined.where(equal).withColumn("__lw_place", place)
    twins = twins.withColumn("__lw_removed", F.when(F.col("__lw_place") > 1, F.col("__lw_twins")).otherwise(F.col("__lw_removed"))).drop("__lw_place")
    return joined.where(~equal).unionByName(twins).drop("__lw_twins")


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, brief: bool = False) -> DataFrame:
    """The documents without their repeated lines; those left without any line go, and untouched ones stay as they are.

    Other columns stay; a column n_chars is set anew where lines went.
    """
    joined = _with_removed(docs.withColumn("__lw_row", row_key(id_col, text_col)), repeated_lines(docs, id_col, text_col, percent, brief))
    lines = F.filter(F.split(F.col(text_col), "\n", -1), lambda x, i: ~F.array_contains(F.coalesce("__lw_removed", F.array().cast("array<int>")), i))
    joined = joined.withColumn("__lw_kept", F.when(F.size("__lw_removed") > 0, lines))
    joined = joined.where(F.col("__lw_kept").isNull() | (F.size("__lw_kept") > 0))
    changed = {text_col: F.when(F.col("__lw_kept").isNotNull(), F.array_join("__lw_kept", "\n")).otherwise(F.col(text_col))}
    if "n_chars" in docs.columns:
        n = F.length(F.array_join("__lw_kept", "\n")).cast(docs.schema["n_chars"].dataType)
        changed["n_chars"] = F.when(F.col("__lw_kept").isNotNull(), n).otherwise(F.col("n_chars"))
    return joined.withColumns(changed).select(*docs.columns)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    removed = repeated_lines(docs, brief=True)
    lines = docs.select("doc_id", row_key("doc_id", "text").alias("__lw_row"), F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).cast("long").alias("n_lines"))
    out = _with_removed(lines, removed).withColumn("removed", F.when(F.size("__lw_removed") > 0, F.col("__lw_removed")))
    return out.select("doc_id", "n_lines", F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"), F.array_join("removed", ",").alias("removed"))
