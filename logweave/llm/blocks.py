"""Exact set joins inside groups of candidates, in blocks of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, lookup_join, stash
from .components import connected_components
from .trie import join_block

#: A block holds about this many sets and this many tokens at most.
BLOCK_SETS = 512
BLOCK_TOKENS = 1_000_000
#: Cells of a membership matrix.
CELLS = 2_000_000


def jaccard_need(percent: int):
    """Least overlap at which 100 * overlap >= percent * union, for set sizes a and b."""
    return lambda a, b: -(-percent * (a + b) // (100 + percent))


def count_block(left: list[np.ndarray], right: list[np.ndarray], need) -> list[np.ndarray]:
    """For each left set the right sets that it links with, by counting all overlaps of the block as a product of membership matrices.

    Tokens are taken in runs, so that no matrix has more than CELLS cells.
    """
    n, m = len(left), len(right)
    sizes = np.array([len(s) for s in (*left, *right)])
    tokens = np.concatenate([*left, *right])
    owner = np.repeat(np.arange(n + m), sizes)
    _, name, count = np.unique(tokens, return_inverse=True, return_counts=True)
    many = count > 1
    rank = np.cumsum(many) - 1
    owner, name = owner[many[name]], rank[name[many[name]]]
    width = max(CELLS // (n + m), 1)
    order = np.argsort(name, kind="stable") if many.sum() > width else slice(None)
    owner, name = owner[order], name[order]
    overlap = np.zeros((n, m), np.int64)
    for first in range(0, int(many.sum()), width):
        a, b = (0, len(name)) if many.sum() <= width else np.searchsorted(name, [first, first + width])
        member = np.zeros((n + m, min(width, int(many.sum()) - first)), np.float32)
        member[owner[a:b], name[a:b] - first] = 1
        overlap += np.rint(member[:n] @ member[n:].T).astype(np.int64)
    found = (overlap > 0) & (overlap >= need(sizes[:n, None], sizes[None, n:]))
    return [np.flatnonzero(row) for row in found]


def _links(nodes: np.ndarray, part: np.ndarray, x: int, y: int, sets: list[np.ndarray], weights: np.ndarray, need, join=join_block) -> tuple[list, list, list]:
    """(node, other, links) rows of the blocks x and y: a spanning set of links, and how many each node has here; none where one is empty."""
    right = np.flatnonzero(part == y)
    left = right if x == y else np.flatnonzero(part == x)
    if not len(left) or not len(right):
        return nodes[:0], nodes[:0], nodes[:0]
    found = join([sets[i] for i in left], [sets[j] for j in right], need)
    root = np.arange(len(nodes))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    count = np.zeros(len(nodes), np.int64)
    for i, hits in zip(left, found):
        hits = right[hits]
        hits = hits[hits != i]
        count[i] += weights[hits].sum()
        if left is not right:
            count[hits] += weights[i]
        for j in hits:
            a, b = top(i), top(j)
            if a != b:
                root[max(a, b)] = min(a, b)
    linked = np.flatnonzero(count)
    return nodes[linked], nodes[[top(i) for i in linked]] if len(linked) else nodes[:0], count[linked]


def _blocks(n: str = "n", tokens: str = "tokens"):
    return F.ceil(F.greatest(F.col(n) / BLOCK_SETS, F.col(tokens) / BLOCK_TOKENS)).cast("int")


def large_groups(members: DataFrame) -> DataFrame:
    """(grp, blocks), stashed: the groups of members(grp, size, ...) that are more than one block, and how many each is cut into."""
    totals = members.groupBy("grp").agg(F.count("*").alias("n"), F.sum("size").alias("tokens"))
    return stash(totals.select("grp", _blocks().alias("blocks")).where(F.col("blocks") > 1))


def deal(members: DataFrame) -> DataFrame:
    """Add blocks and part to members(grp, node, size, ...): into how many blocks a group is cut, and which one a node is in.

    Groups within the bounds are one block; others are cut by a hash of the node. Only these are looked up, so that no group
    has to meet in one task.
    """
    found = lookup_join(members, large_groups(members), "grp", "left", salt="node").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    return found.withColumn("part", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))


def block_pairs(sets: DataFrame) -> DataFrame:
    """Send each set to the pairs (x, y) of its block with each block of its group, so that no task holds more than two blocks."""
    m = sets.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return m.withColumns({"x": F.least("part", "with"), "y": F.greatest("part", "with")})


def token_lists(column: pa.Array) -> list[np.ndarray]:
    """Sorted token hashes of each row of a list column."""
    offs, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False).view(np.uint64)
    return [np.sort(flat[a:b]) for a, b in zip(offs[:-1], offs[1:])]


def join_groups(dealt: DataFrame, need, sets_of=token_lists, given: str = "tokens", join=join_block) -> DataFrame:
    """(node, other, links) from dealt(grp, x, y, part, node, weight, tokens): links are found pair of blocks by pair of blocks.

    Rows of a pair arrive together, sorted, and are joined as soon as the next pair begins. A node given twice counts once. sets_of makes
    the sets of a batch from the column given, in the task that joins them, and join compares the sets of two blocks. The number of tasks
    is set, as the work of a few rows may be large.
    """
    schema = pa.schema([("node", pa.int64()), ("other", pa.int64()), ("links", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        out: list[list[np.ndarray]] = [[], [], []]

        def close() -> None:
            if len(held) > 1:
                found = _links(np.array([r[1] for r in held]), np.array([r[0] for r in held]), key[1], key[2], [r[3] for r in held], np.array([r[2] for r in held]), need, join)
                for column, values in zip(out, found):
                    column.append(values)
            held.clear()

        def ready() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in out], schema=schema)
            for c in out:
                c.clear()
            return batch

        for batch in batches:
            groups, xs, ys, parts, nodes, weights = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(6))
            for i, tokens in enumerate(sets_of(batch.column(6))):
                if key != (now := (groups[i], xs[i], ys[i])):
                    close()
                    key = now
                if held and held[-1][1] == nodes[i]:
                    continue
                held.append((parts[i], nodes[i], weights[i], tokens))
            if sum(map(len, out[0])) > 10_000:
                yield ready()
        close()
        if out[0]:
            yield ready()

    tasks = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = dealt.select("grp", "x", "y", "part", "node", "weight", given).repartition(tasks, "grp", "x", "y").sortWithinPartitions("grp", "x", "y", "part", "node")
    return rows.mapInArrow(run, "node long, other long, links long")


def linked_pairs(pairs: DataFrame, sets: DataFrame, need, sets_of, given: str) -> DataFrame:
    """The pairs(a, b) whose sets, looked up in sets(node, given), link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = sets_of(batch.column(2)), sets_of(batch.column(3))
            shared = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(left, right)])
            sizes = [np.array([len(x) for x in side]) for side in (left, right)]
            yield batch.select([0, 1]).filter(pa.array(shared >= need(*sizes))) if len(shared) else batch.select([0, 1])

    first = sets.select(F.col("node").alias("a"), F.col(given).alias("left"))
    second = sets.select(F.col("node").alias("b"), F.col(given).alias("right"))
    return pairs.join(first, "a").join(second, "b").select("a", "b", "left", "right").mapInArrow(run, "a long, b long")


def _cut(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks of members(grp, comp, node, size), and the pairs of blocks that may still hold a link between two components.

    A component over the bounds of a block has blocks of its own, whose pairs are left out; all smaller ones of a
    group share blocks and stay whole.
    """
    comps = members.groupBy("grp", "comp").agg(F.count("*").alias("n"), F.sum("size").alias("tokens")).withColumn("own", _blocks())
    rest = comps.where(F.col("own") == 1).groupBy("grp").agg(F.sum("n").alias("n"), F.sum("tokens").alias("tokens")).select("grp", _blocks().alias("shared"))
    big = stash(comps.where(F.col("own") > 1).select("grp", "comp", "own"))
    rest = stash(rest)
    shared_from = 1 << 30
    name = lambda owner, i: F.xxhash64("grp", owner, i.cast("long"))
    none = F.lit(None).cast("long")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias("i")
    listed = big.select("grp", F.col("comp").alias("owner"), each("own")).unionByName(rest.select("grp", none.alias("owner"), each("shared")))
    number = F.when(F.col("owner").isNull(), F.col("i") + shared_from).otherwise(F.col("i"))
    listed = stash(listed.select("grp", "owner", name(F.coalesce("owner", F.lit(0).cast("long")), number).alias("block")))
    other = listed.select(F.col("grp").alias("g2"), F.col("owner").alias("o2"), F.col("block").alias("b2"))
    may = (F.col("grp") == F.col("g2")) & (F.col("block") <= F.col("b2")) & F.coalesce(F.col("owner") != F.col("o2"), F.lit(True))
    pairs = stash(listed.join(other, may).select("grp", F.col("block").alias("x"), F.col("b2").alias("y")))
    placed = lookup_join(members, big.select("comp", "own"), "comp", "left", salt="node")
    placed = lookup_join(placed, rest, "grp", "left", salt="node")
    block = F.when(F.col("own").isNotNull(), name(F.col("comp"), F.pmod(F.xxhash64("node"), F.col("own")))).otherwise(
        name(F.lit(0).cast("long"), F.pmod(F.xxhash64("comp"), F.col("shared")) + shared_from)
    )
    return placed.select("node", "grp", block.alias("part")), pairs


def link_groups(sets: DataFrame, edges: DataFrame, large: DataFrame, need, sets_of, given: str) -> DataFrame:
    """(a, b): links that connect what links in the groups of sets(grp, node, size, given).

    A group that is one block is joined there. In the larger ones, which large(grp, blocks) lists, the edges(a, b) through which the
    candidates met are verified first, a bounded number for each node; only what these leave in different components is joined in pairs of blocks. So a
    group of near copies, however large, costs what its edges cost, and no link between two components is lost.
    """
    known = stash(lookup_join(sets.select("grp", "node", "size"), large, "grp", "inner", salt="node").select("grp", "node", "size"))
    few = lookup_join(sets, large, "grp", "left", salt="node").where(F.col("blocks").isNull())
    one = F.lit(0)
    joined = few.select("grp", one.alias("x"), one.alias("y"), one.alias("part"), "node", F.lit(1).cast("long").alias("weight"), given)
    links = stash(join_groups(joined, need, sets_of, given, count_block).select(F.col("node").alias("a"), F.col("other").alias("b")))
    if known.isEmpty():
        return links
    own = stash(sets.join(known.select("node"), "node").select("node", given))
    inner = edges.join(known.select(F.col("node").alias("a")), "a").select("a", "b").distinct()
    first = stash(linked_pairs(inner, own, need, sets_of, given))
    comps = connected_components(first)
    members = stash(known.join(comps, "node", "left").select("grp", "node", "size", F.coalesce("component", "node").alias("comp")))
    placed, pairs = _cut(members)
    meets = pairs.select("x", "y", F.explode(F.array_distinct(F.array("x", "y"))).alias("part"))
    dealt = placed.join(meets, "part").join(own, "node").withColumn("weight", F.lit(1).cast("long"))
    rest = stash(join_groups(dealt, need, sets_of, given, count_block).select(F.col("node").alias("a"), F.col("other").alias("b")))
    discard(own, known, members)
    return links.unionByName(first).unionByName(rest)
