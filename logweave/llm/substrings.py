"""Removal of repeated byte strings by a depth-limited, most-significant-digit radix sort of suffixes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, lookup_join, mix64, randoms, row_key, slices, stash, table, utf8

#: Length of a repeated string, and of the part of it by which suffixes are bucketed first.
DEPTH = 200
LEAD = 64
#: Later digits of a suffix, each of DEPTH / DIGITS bytes.
DIGITS = 2

_BYTE = randoms(256, 83)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Anchors, or suffixes, that a task gathers before it looks for equal ones among them.
_GATHERED = 500_000
#: Different surroundings of a digit, among the anchors gathered at once, from which it counts as hot everywhere.
_HOT = 64


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Hasher:
    """Hashes of any stretch of a byte array, in constant time each."""

    def __init__(self, raw: np.ndarray):
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[raw] * _powers(_BASE, len(raw)), dtype=np.uint64)])
        self.back = _powers(_INVERSE, len(raw) + 1)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each run of `width` neighbours."""
    n = len(x) - width + 1
    blocks = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    blocks[: len(x)] = x
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def find_anchors(raw: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """Anchors of all texts of a slice: row, digit, ctx, lo, hi, at.

    Each window of DEPTH bytes is represented by the leading digit with the smallest hash among the LEAD-byte strings in it, the
    leftmost if several; equal windows choose alike. Neighbouring windows with the same choice are one anchor: its windows start at lo..hi,
    and ctx stands for all bytes that they cover together with the place of the digit in them.
    """
    raw, offs = raw[offs[0] : offs[-1]], offs - offs[0]
    none = np.zeros(0, np.int64)
    if len(raw) < DEPTH:
        return dict.fromkeys(("row", "digit", "ctx", "lo", "hi", "at"), none)
    hashes = Hasher(raw)
    at = np.arange(len(raw) - LEAD + 1)
    lead = hashes(at, at + LEAD)
    packed = (lead & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    choice = (_sliding_min(packed, DEPTH - LEAD + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    inside = np.zeros(len(choice) + 1, np.int64)
    for a, b in zip(offs[:-1], offs[1:]):
        if b - a >= DEPTH:
            inside[a] += 1
            inside[b - DEPTH + 1] -= 1
    valid = np.cumsum(inside[:-1]) > 0
    start = np.flatnonzero(valid)
    chosen = choice[start]
    new = np.ones(len(start), bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (np.diff(start) != 1)
    first = np.flatnonzero(new)
    lo, hi, at = start[first], start[np.append(first[1:], len(start)) - 1] if len(start) else none, chosen[first]
    row = np.searchsorted(offs, lo, "right") - 1
    ctx = mix64(hashes(lo, hi + DEPTH) + (at - lo).astype(np.uint64) * np.uint64(0x94D049BB133111EB))
    base = offs[row]
    return {"row": row, "digit": lead[at], "ctx": ctx, "lo": lo - base, "hi": hi - base, "at": at - base}


def _anchors(docs: DataFrame) -> DataFrame:
    """All anchors; those equal to an earlier one of the same task are marked repeated and counted with the first.

    n is the count of a first one, else 0; near is the number of different surroundings that its digit has among those gathered with it.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["digit", "ctx", "lo", "hi", "at"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[pa.Array, dict]] = []

        def ready() -> pa.RecordBatch:
            ids = pa.concat_arrays([i for i, _ in held])
            col = {c: np.concatenate([x[c] for _, x in held]) for c in names}
            held.clear()
            order = np.lexsort((col["ctx"], col["digit"]))
            same = np.zeros(len(order), bool)
            same[1:] = (col["digit"][order][1:] == col["digit"][order][:-1]) & (col["ctx"][order][1:] == col["ctx"][order][:-1])
            heads = np.flatnonzero(~same)
            n = np.zeros(len(order), np.int32)
            n[order[heads]] = np.diff(np.append(heads, len(order)))
            near = np.zeros(len(order), np.int32)
            _, of, count = np.unique(col["digit"][order[heads]], return_inverse=True, return_counts=True)
            near[order[heads]] = count[of]
            arrays = [ids, *(pa.array(col[c].view(np.int64)) for c in ("digit", "ctx")), *(pa.array(col[c].astype(np.int32)) for c in ("lo", "hi", "at")), pa.array(n), pa.array(near)]
            return pa.RecordBatch.from_arrays(arrays, ["doc_id", *names, "n", "near"])

        for batch in batches:
            for part in slices(batch, "text"):
                found = find_anchors(*utf8(part.column("text")))
                if len(found["row"]):
                    held.append((part.column("doc_id").take(pa.array(found["row"])), found))
            if sum(len(i) for i, _ in held) > _GATHERED:
                yield ready()
        if held:
            yield ready()

    return docs.mapInArrow(run, f"doc_id {kind}, digit long, ctx long, lo int, hi int, at int, n int, near int")


def radix_groups(digits: list[np.ndarray]) -> np.ndarray:
    """Group of each suffix after passes over its digits, the most significant first; -1 for those equal to no other.

    A pass sorts what is left by group and digit and leaves out what has become alone.
    """
    alive, group = np.arange(len(digits[0])), np.zeros(len(digits[0]), np.int64)
    for digit in digits:
        order = np.lexsort((digit[alive], group))
        alive, group = alive[order], group[order]
        d = digit[alive]
        new = np.ones(len(alive), bool)
        new[1:] = (group[1:] != group[:-1]) | (d[1:] != d[:-1])
        group = np.cumsum(new) - 1
        many = np.bincount(group, minlength=1)[group] > 1
        alive, group = alive[many], group[many]
    out = np.full(len(digits[0]), -1, np.int64)
    out[alive] = group
    return out


def _suffixes(docs: DataFrame, open_anchors: DataFrame) -> DataFrame:
    """(key, d1.., doc_id, start, kind): the window starts of the anchors, with their digits; kind is 1, or 2 for those known to be repeated.

    Suffixes that a task finds equal among those it gathers are known to be repeated; only the first of them is sent on to meet those of other tasks,
    so that a passage in very many surroundings is a few rows a task. All that were so found come as runs of kind 0, from start to d1; their key deals them by text.
    """
    per_doc = stash(open_anchors.groupBy("doc_id").agg(F.collect_list(F.struct("digit", "lo", "hi", "at", "known")).alias("wants")))
    kind = docs.schema["doc_id"].dataType.simpleString()
    step = DEPTH // DIGITS
    names = ["key", *[f"d{k}" for k in range(1, DIGITS)]]

    def of_slice(part: pa.RecordBatch) -> pa.RecordBatch | None:
        raw, offs = utf8(part.column("text"))
        rows, starts, keys, known = [], [], [], []
        for r, wants in enumerate(part.column("wants").to_pylist()):
            for w in wants:
                if offs[r] + w["hi"] + DEPTH > offs[r + 1]:
                    continue  # another text with the same id
                s = np.arange(w["lo"], w["hi"] + 1)
                rows.append(np.full(len(s), r))
                starts.append(s)
                keys.append(mix64(np.uint64(w["digit"] & (2**64 - 1)) + (w["at"] - s).astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)))
                known.append(np.full(len(s), w["known"]))
        if not rows:
            return None
        row, start = np.concatenate(rows), np.concatenate(starts)
        hashes = Hasher(raw[offs[0] : offs[-1]])
        at = offs[row] - offs[0] + start
        digits = [hashes(at + k * step, at + (k + 1) * step) for k in range(DIGITS)]
        key = mix64(np.concatenate(keys) + digits[0])
        arrays = [pa.array(x.view(np.int64)) for x in (key, *digits[1:])]
        return pa.RecordBatch.from_arrays([*arrays, part.column("doc_id").take(pa.array(row)), pa.array(start.astype(np.int32)), pa.array(np.concatenate(known)), pa.array(row)], [*names, "doc_id", "start", "known", "row"])

    def met(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.concat_batches(held)
        group = radix_groups([rows.column(c).to_numpy() for c in names])
        many = group >= 0
        sent = ~many
        sent[np.flatnonzero(many)[np.unique(group[many], return_index=True)[1]]] = True
        known = rows.column("known").to_numpy(zero_copy_only=False)
        at, start = np.flatnonzero(many & ~known), rows.column("start").to_numpy()
        # Texts count from 0 in each slice, so that they are told apart by slice too.
        text = rows.column("row").to_numpy() + np.repeat(np.arange(len(held)) << 40, [len(b) for b in held])
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(at) != 1) | (np.diff(start[at]) != 1) | (np.diff(text[at]) != 0)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(at)) - 1 if len(at) else first
        on, head = np.flatnonzero(sent), at[first]
        kept = rows.take(pa.array(np.concatenate([on, head])))
        col = {c: kept.column(c).to_numpy().copy() for c in names}
        col["key"][len(on) :] = mix64(text[head].astype(np.uint64)).view(np.int64)
        col["d1"][len(on) :] = start[at[last]]
        kind = np.append(np.where((known | many)[on], 2, 1), np.zeros(len(head))).astype(np.int8)
        return pa.RecordBatch.from_arrays([*(pa.array(col[c]) for c in names), kept.column("doc_id"), kept.column("start"), pa.array(kind)], [*names, "doc_id", "start", "kind"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for part in slices(batch, "text"):
                found = of_slice(part)
                if found is not None:
                    held.append(found)
                if sum(b.num_rows for b in held) > _GATHERED:
                    yield met(held)
                    held = []
        if held:
            yield met(held)

    later = ", ".join(f"d{k} long" for k in range(1, DIGITS))
    return lookup_join(docs, per_doc, "doc_id").select("doc_id", "text", "wants").mapInArrow(run, f"key long, {later}, doc_id {kind}, start int, kind tinyint")


def _repeated_suffixes(suffixes: DataFrame) -> DataFrame:
    """(doc_id, lo, hi): starts of the suffixes that are equal to another one to full depth; those found in their own tasks take no part in the passes."""
    kind = suffixes.schema["doc_id"].dataType.simpleString()
    names = ["key", *[f"d{k}" for k in range(1, DIGITS)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def settle(rows: pa.RecordBatch) -> pa.RecordBatch:
            kind, d1 = rows.column("kind").to_numpy(), rows.column("d1").to_numpy()
            equal = np.zeros(rows.num_rows, bool)
            equal[kind > 0] = radix_groups([rows.column(c).to_numpy()[kind > 0] for c in names]) >= 0
            keep = np.flatnonzero((kind == 0) | (equal & (kind == 1)))
            lo = rows.column("start").to_numpy()[keep]
            hi = np.where(kind[keep] == 0, d1[keep], lo).astype(np.int32)
            return pa.RecordBatch.from_arrays([rows.column("doc_id").take(pa.array(keep)), pa.array(lo), pa.array(hi)], ["doc_id", "lo", "hi"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(b.num_rows for b in held) < 100_000:
                continue
            rows = pa.concat_batches(held)
            # The last digits may go on in the next batch.
            same = np.ones(rows.num_rows, bool)
            for c in names:
                column = rows.column(c).to_numpy()
                same &= column == column[-1]
            cut = rows.num_rows - int(same.sum())
            if cut:
                yield settle(rows.slice(0, cut))
            held = [rows.slice(cut)]
        if held:
            yield settle(pa.concat_batches(held))

    # By all digits, so that suffixes that share the first one only are many tasks.
    rows = suffixes.repartition(*names).sortWithinPartitions(*names)
    return rows.mapInArrow(run, f"doc_id {kind}, lo int, hi int")


def _merge(ranges: DataFrame) -> DataFrame:
    """(doc_id, starts, ends): the bytes that ranges(doc_id, lo, hi) of window starts cover, as runs apart from each other."""
    kind = ranges.schema["doc_id"].dataType.simpleString()
    per_doc = ranges.groupBy("doc_id").agg(F.collect_list("lo").alias("lo"), F.collect_list("hi").alias("hi"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, ends = [], []
            for lo, hi in zip(batch.column("lo").to_pylist(), batch.column("hi").to_pylist()):
                order = np.argsort(lo, kind="stable")
                a, b = np.array(lo)[order], np.maximum.accumulate(np.array(hi)[order] + DEPTH)
                new = np.flatnonzero(np.append(True, a[1:] > b[:-1]))
                starts.append(a[new])
                ends.append(b[np.append(new[1:], len(a)) - 1])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(starts, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32()))], ["doc_id", "starts", "ends"])

    return per_doc.mapInArrow(run, f"doc_id {kind}, starts array<int>, ends array<int>")


def repeated_ranges(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, starts, ends): runs of bytes covered by strings of DEPTH bytes that start anywhere else too; only texts that have some.

    Suffixes are ordered only through DEPTH bytes, digit by digit. The first pass buckets them by a leading digit: a
    LEAD-byte string inside the window, so chosen that equal windows choose alike, which stands for all windows around it
    (``find_anchors``). Buckets of one are dropped. In a bucket, anchors with equal bytes around are settled at once; of the others, one for
    each surrounding, every window is a suffix of its own, and further passes sort these by their digits and drop what is
    alone, until the groups left are exactly the repeated windows. Anchors and suffixes that a task sees twice are reduced to one before the shuffle.
    A digit with very many surroundings is hot: its anchors are dealt by digit and surroundings, as such a digit is in no bucket of one.
    Digits are 64-bit hashes of their bytes. Matches never cross texts; rows must not share an id unless they are equal.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    anchors = stash(_anchors(d))
    hot = stash(anchors.where(F.col("near") >= _HOT).select("digit").distinct().withColumn("hot", F.lit(True)))
    heads = lookup_join(anchors.where(F.col("n") > 0).drop("near"), hot, "digit", "left", salt="ctx").withColumn("hot", F.coalesce("hot", F.lit(False)))
    heads = heads.withColumn("part", F.when(F.col("hot"), F.col("ctx")).otherwise(0))
    in_digit, in_ctx = Window.partitionBy("digit", "part"), Window.partitionBy("digit", "part", "ctx")
    first = F.row_number().over(in_ctx.orderBy("doc_id", "lo"))
    met = heads.withColumns({"n_digit": F.sum("n").over(in_digit), "n_ctx": F.sum("n").over(in_ctx), "place": first})
    met = stash(met.where(F.col("hot") | (F.col("n_digit") > 1)))
    settled = met.where(F.col("n_ctx") > 1).select("doc_id", "lo", "hi")
    # A digit with one surrounding only has nothing left to decide.
    undecided = met.where((F.col("hot") | (F.col("n_digit") > F.col("n_ctx"))) & (F.col("place") == 1)).withColumn("known", F.col("n_ctx") > 1)
    found = _repeated_suffixes(_suffixes(d, undecided))
    again = anchors.where(F.col("n") == 0).select("doc_id", "lo", "hi")
    merged = stash(_merge(again.unionByName(settled).unionByName(found)))
    discard(anchors, hot, met)
    return merged


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): each text without its repeated bytes, one row per input row.

    A null text is empty; texts under DEPTH bytes lose nothing; every copy of a repeated text of DEPTH bytes or more loses all of
    it. Rows with a null or a shared id are told apart by their texts; an empty table gives an empty result.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), row_key(id_col, text_col).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = utf8(batch.column("text"))
            n_bytes, n_removed, n_spans, kept = np.diff(offs), [], [], []
            for i, (starts, ends) in enumerate(zip(batch.column("starts").to_pylist(), batch.column("ends").to_pylist())):
                text = raw[offs[i] : offs[i + 1]].tobytes()
                starts, ends = starts or [], ends or []
                n_spans.append(len(starts))
                n_removed.append(sum(ends) - sum(starts))
                kept.append(b"".join(text[a:b] for a, b in zip([0, *ends], [*starts, len(text)])))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_bytes.astype(np.int64)), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
            )

    ranges = repeated_ranges(d, "row").withColumnRenamed("doc_id", "row")
    joined = lookup_join(d, ranges, "row", "left").select("doc_id", "text", "starts", "ends")
    return joined.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
