"""Greedy chains over ordered places: each link opens at the first place that the one before it leaves free. In blocks, so that no key is one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Width of a block, in steps.
SPAN = 32


class _Block:
    """Ordered places of one block: where its runs break, and the next link after each place."""

    def __init__(self, places: np.ndarray, step: int, gap: int | None) -> None:
        self.places, self.step = places, step
        n = len(places)
        breaks = np.flatnonzero(np.diff(places) > gap) + 1 if gap is not None else np.zeros(0, np.int64)
        self.first_break = int(breaks[0]) if len(breaks) else n
        following = np.append(breaks, n)[np.searchsorted(breaks, np.arange(n), "right")]
        self.next = np.minimum(np.searchsorted(places, places + step), following)

    def entry(self, due: int | None) -> int:
        """Index of the first link that opens in the block if none may before due; without one the first place opens."""
        return 0 if due is None else min(int(np.searchsorted(self.places, due)), self.first_break)

    def outcomes(self, low: int) -> tuple[np.ndarray, np.ndarray]:
        """(bounds, opened): where the last link of the block opens for a due of up to each bound, and beyond all; low is where the block begins.

        What is due lies less than a step behind the start of a block, so that only the places of its first step tell dues apart. Bounds with equal outcomes are one.
        """
        n = len(self.places)
        last = np.where(self.next < n, self.next, np.arange(n))
        while not np.array_equal(further := last[last], last):
            last = further
        c = min(int(np.searchsorted(self.places, low + self.step)), self.first_break)
        opened = self.places[last[: c + 1]]
        bounds = self.places[:c]
        differs = opened[1:] != opened[: len(opened) - 1]
        if c == n:
            return bounds[np.append(differs, True)] if n else bounds, opened[np.append(differs, True)] if n else opened
        return bounds[differs], opened[np.append(differs, True)]

    def starts(self, due: int | None) -> np.ndarray:
        """The place at which the link of each place opens."""
        at = self.entry(due)
        marks = np.full(len(self.places), -1)
        while at < len(self.places):
            marks[at] = at
            at = int(self.next[at])
        marks = np.maximum.accumulate(marks)
        return np.where(marks >= 0, self.places[marks], 0 if due is None else due - self.step)


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of the rows whose first columns, as many as keys, are equal; these rows follow each other."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        if not batch.num_rows:
            continue
        codes = [batch.column(i).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False) for i in range(keys)]
        new = np.zeros(batch.num_rows, bool)
        for c in codes:
            new[1:] |= c[1:] != c[:-1]
        edges = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:]):
            key = tuple(batch.column(i)[a].as_py() for i in range(keys))
            if held and key != now:
                yield pa.Table.from_batches(held)
                held = []
            now = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def chain_starts(rows: DataFrame, keys: list[str], place: str, step: int, gap: int | None = None, opening: bool = False) -> DataFrame:
    """rows with chain_start, the place at which the link opens that each is in; with opening only the rows at which one does.

    Of each key, rows are taken in the order of a long place. The first one opens a link; another one does if it lies step or more behind
    the place where the last link opened, or, with a gap, more than gap behind the row before. Each choice rests on the one before; still a key is many tasks: a block of
    places is summed up by a map from the first place free for a link when it is entered to the last link opened in it. One
    such row a block is gone through in the order of blocks, and every block is then worked on again from what is due at its entry. A task holds one block of SPAN
    steps. Rows without a place are left out; null keys are a key.
    """
    span = SPAN * step
    named = [f"k{i}" for i in range(len(keys))]
    block = F.floor(F.col(place) / F.lit(span)).cast("long")
    key = F.struct(*[F.col(k).alias(n) for k, n in zip(keys, named)], block.alias("block"))
    taken = rows.where(F.col(place).isNotNull()).select(key.alias("key"), F.col(place).cast("long").alias("at"), F.struct(*[c for c in rows.columns if c not in keys]).alias("row"))
    # Persisted, since the two passes would each make the rows and deal them; the key is never null.
    dealt = taken.repartition("key").persist(StorageLevel.MEMORY_AND_DISK).select("key", *[f"key.{n}" for n in (*named, "block")], "at", "row")
    kinds = ", ".join(f"{n} {dealt.schema[n].dataType.simpleString()}" for n in named)
    n_keys = len(named)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, n_keys + 1):
            places = group.column("at").to_numpy()
            bounds, opened = _Block(places, step, gap).outcomes(int(group.column("block")[0].as_py()) * span)
            head = [group.column(i).slice(0, 1).combine_chunks() for i in range(n_keys + 1)]
            values = [pa.array([int(places[0])]), pa.array([int(places[-1])]), pa.array([bounds.tolist()], pa.list_(pa.int64())), pa.array([opened.tolist()], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*head, *values], [*named, "block", "first", "last", "bounds", "opened"])

    blocks = dealt.sortWithinPartitions("key", "at").select(*named, "block", "at").mapInArrow(summed, f"{kinds}, block long, first long, last long, bounds array<long>, opened array<long>")
    shape = f"{kinds}, block long, due long"
    schema = to_arrow_schema(StructType.fromDDL(shape))

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, due, last = None, None, 0
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                key = tuple(row[n] for n in named)
                if key != now or gap is not None and row["first"] - last > gap:
                    due = None
                now, last = key, row["last"]
                out.append({n: row[n] for n in (*named, "block")} | {"due": due})
                i = 0 if due is None else int(np.searchsorted(row["bounds"], due))
                if i < len(row["opened"]):
                    due = row["opened"][i] + step
            yield pa.RecordBatch.from_pylist(out, schema)

    due = blocks.repartition(*named).sortWithinPartitions(*named, "block").mapInArrow(folded, shape)
    due = due.select(F.struct(*named, "block").alias("d_key"), "due")
    met = dealt.join(due, F.col("key") == F.col("d_key"), "left").sortWithinPartitions("key", "at").select(*named, "block", "at", "row", "due")

    def started(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, n_keys + 1):
            places = group.column("at").to_numpy()
            start = _Block(places, step, gap).starts(group.column("due")[0].as_py())
            out = pa.table({**{n: group.column(n) for n in named}, "row": group.column("row"), "chain_start": pa.array(start)})
            if opening:
                # Of rows at one place the first one opens the link.
                new = np.ones(len(places), bool)
                new[1:] = places[1:] != places[:-1]
                out = out.filter(pa.array((start == places) & new))
            yield from out.combine_chunks().to_batches()

    out = StructType([*[dealt.schema[n] for n in named], dealt.schema["row"]]).add("chain_start", "long")
    names = dict(zip(keys, named))
    return met.mapInArrow(started, out).select(*[F.col(names.get(c, f"row.`{c}`")).alias(c) for c in rows.columns], "chain_start")
