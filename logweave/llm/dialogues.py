"""Repair of conversations: cheapest edits to a legal order of roles, by block tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache
from hashlib import sha256
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import discard, lookup_join, stash, table

#: Costs of the edits; a truncated row that stays adds its own.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Rows that one transition of the table takes.
BLOCK = 4
#: Rows of a conversation that one task holds; a longer one is worked on in chunks of so many.
CHUNK = 4096
SPACE = " \t\n\x0b\x0c\r"

# States: nothing yet, after s, after u, after a. The row that each one asks for next, and where it leads.
_NEXT, _WANTED = (2, 2, 3, 2), ("user", "user", "assistant", "user")
_KEEP = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None), "x": (None,) * 4}
_CLASSES = "suax"
#: Symbols are twice a class of roles, plus one for a truncated row; this one stands for a row that has to go.
GONE = 2 * len(_CLASSES)
SYMBOLS = GONE + 1
_LEGAL = frozenset(("su", "ua", "au"))


def _choices(symbol: int) -> Iterator[tuple[str, int, tuple]]:
    """(letter, cost, state after each state) of the edits of a row; None where an edit is not allowed."""
    yield "D", DELETE, (0, 1, 2, 3)
    if symbol != GONE:
        late = TRUNCATED * (symbol % 2)
        yield "K", late, _KEEP[_CLASSES[symbol // 2]]
        yield "R", REROLE + late, _NEXT


def _with_inserts(costs: list[int]) -> tuple[int, ...]:
    for _ in range(3):
        costs = [min(costs[q], INSERT + costs[_NEXT[q]]) for q in range(4)]
    return tuple(costs)


def _before(symbol: int, after: tuple[int, ...]) -> tuple[int, ...]:
    """Cheapest costs from each state before a row, inserted rows included, from those after it."""
    costs = [min(cost + after[to[q]] for _, cost, to in _choices(symbol) if to[q] is not None) for q in range(4)]
    return _with_inserts(costs)


#: Costs after the last row: a conversation is complete when empty or after a.
END = _with_inserts([0, 1 << 20, 1 << 20, 0])


class Tables:
    """Normalised cost vectors, by number, and what a symbol, and a block of symbols, makes of each: another one and an amount added to all costs."""

    def __init__(self) -> None:
        number, self.vectors, todo = {}, [], [END]
        steps: list[list[tuple]] = []
        while todo:
            v = todo.pop()
            if v in number:
                continue
            number[v] = len(self.vectors)
            self.vectors.append(v)
            made = []
            for symbol in range(SYMBOLS):
                w = _before(symbol, v)
                made.append((tuple(c - min(w) for c in w), min(w)))
            steps.append(made)
            todo += [w for w, _ in made if w not in number]
        self.end = number[END]
        self.step = np.array([[number[w] for w, _ in made] for made in steps], np.int32).T.copy()
        self.cost = np.array([[c for _, c in made] for made in steps], np.int64).T.copy()
        # Symbols of a block are digits, the first one the highest; the last one is taken first.
        self.block, self.block_cost = np.arange(len(self.vectors), dtype=np.int32)[None, :], np.zeros((1, len(self.vectors)), np.int64)
        for _ in range(BLOCK):
            later, spent = self.block, self.block_cost
            self.block = np.concatenate([self.step[s][later] for s in range(SYMBOLS)])
            self.block_cost = np.concatenate([spent + self.cost[s][later] for s in range(SYMBOLS)])

    def blocks(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the full blocks of symbols, and the symbols left over at the end."""
        full = len(symbols) // BLOCK * BLOCK
        digits = SYMBOLS ** np.arange(BLOCK - 1, -1, -1)
        return symbols[:full].reshape(-1, BLOCK) @ digits, symbols[full:]

    def transition(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each vector after the symbols the one before them, and the cost added."""
        to, spent = np.arange(len(self.vectors)), np.zeros(len(self.vectors), np.int64)
        blocks, rest = self.blocks(symbols)
        for s in rest[::-1]:
            spent, to = spent + self.cost[s][to], self.step[s][to]
        for b in blocks[::-1]:
            spent, to = spent + self.block_cost[b][to], self.block[b][to]
        return to, spent

    def trace(self, symbols: np.ndarray, after: int, state: int, last: bool) -> tuple[list[str], int]:
        """Edits of each row, least in ASCII order of all cheapest ones, inserted rows before it, and the state they lead to; last adds those after the last row.

        Vectors between blocks come from the table, block by block from the end. Each block is then expanded backward into those
        between its rows, which tell what every edit costs to the end, so that the least letter of a cheapest way can be
        taken at every place.
        """
        blocks, rest = self.blocks(symbols)
        at = [after]
        for s in rest[::-1]:
            at.append(int(self.step[s][at[-1]]))
        between = [at[-1]]
        for b in blocks[::-1]:
            between.append(int(self.block[b][between[-1]]))
        between.reverse()
        edits: list[str] = []
        for k in range(len(blocks) + 1):
            part = symbols[k * BLOCK : (k + 1) * BLOCK] if k < len(blocks) else rest
            inner = [between[k + 1] if k < len(blocks) else after]
            for s in part[::-1]:
                inner.append(int(self.step[s][inner[-1]]))
            inner.reverse()
            for i, s in enumerate(part):
                base = int(self.cost[s][inner[i + 1]])
                word, state = _least(int(s), [c + base for c in self.vectors[inner[i]]], self.vectors[inner[i + 1]], state)
                edits.append(word)
        if last:
            word = ""
            while END[state]:
                word, state = word + "I", _NEXT[state]
            edits.append(word)
        return edits, state


def _least(symbol: int, now: list[int], later: tuple, state: int) -> tuple[str, int]:
    """The least letters of a cheapest way from a state, up to the edit of the row, and the state after it; now and later are the costs to the end before and after the row."""
    word = ""
    while True:
        good = {x: to[state] for x, cost, to in _choices(symbol) if to[state] is not None and cost + later[to[state]] == now[state]}
        if "D" not in good and INSERT + now[_NEXT[state]] == now[state]:
            word, state = word + "I", _NEXT[state]
            continue
        letter = min(good)
        return word + letter, good[letter]


@cache
def tables() -> Tables:
    return Tables()


def _fault(role: str, text: str, repeated: bool) -> tuple[int, str | None]:
    """Symbol and first fault of a row."""
    core = text.rstrip(SPACE)
    if not core:
        return GONE, "blank"
    if repeated:
        return GONE, "duplicate"
    cut = core[-1] not in ".!?"
    return 2 * "suax".index(role[0] if role[:1] in ("s", "u", "a") else "x") + cut, "truncated" if cut else None


def _lines(edits: str, state: int, role: str | None, text: str | None) -> tuple[list[str], int]:
    """The repaired role:text lines that the edits of one row give, and the state after them."""
    out = []
    for x in edits:
        if x == "D":
            continue
        if x == "K":
            out.append(f"{role}:{text}")
            state = _KEEP[role[0]][state]
        else:
            out.append(f"{_WANTED[state]}:{text if x == 'R' else ''}")
            state = _NEXT[state]
    return out, state


def damage(rows: DataFrame) -> DataFrame:
    """Rows(conv_id, turn, role, text) after damage by crc32 of conv_id:turn modulo 20: 0 drops a row, 1 empties it, 2 removes its ends of sentences, 3 repeats it, 4 makes it a user's."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(blank("text"), ".!?", "")).otherwise(blank("text"))
    out = rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(blank("role")).alias("role"), text.alias("text"), kind.alias("kind")).where(F.col("kind") != 0)
    return out.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("kind", "copy")


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_SHAPE = ", ".join(f"{c} long" for c in COUNTS) + ", audit string, repaired_sha256 string"


def _gaps(turns: list) -> int:
    known = {t for t in turns if t is not None}
    return max(known) - min(known) + 1 - len(known) if known else 0


def _repair(turns: list, roles: list[str], texts: list[str]) -> tuple:
    """One conversation, in order, as the columns of repair_conversations."""
    seen: set[tuple[str, str]] = set()
    symbols, faults = [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for row in zip(roles, texts):
        symbol, fault = _fault(*row, row in seen)
        seen.add(row)
        symbols.append(symbol)
        if fault:
            faults[fault] += 1
    illegal = sum(a[:1] + b[:1] not in _LEGAL for a, b in zip(roles, roles[1:]))
    t, symbols = tables(), np.array(symbols, np.int64)
    to, spent = t.transition(symbols)
    edits, _ = t.trace(symbols, t.end, 0, True)
    lines, state = [], 0
    for word, role, text in zip(edits, [*roles, None], [*texts, None]):
        more, state = _lines(word, state, role, text)
        lines += more
    cost = int(spent[t.end]) + t.vectors[to[t.end]][0]
    return (_gaps(turns), *faults.values(), illegal, cost, "".join(edits), sha256("\n".join(lines).encode()).hexdigest())


def _mapped(df: DataFrame, schema: str, work: Callable[[Iterator[dict]], Iterator[dict]], batch: int = 1000) -> DataFrame:
    """What work makes of the rows of each partition, in their order."""
    shape = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for row in work(row for b in batches for row in b.to_pylist()):
            out.append(row)
            if len(out) == batch:
                yield pa.RecordBatch.from_pylist(out, shape)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, shape)

    return df.mapInArrow(run, schema)


def _order() -> list:
    return ["conv_id", F.col("turn").asc_nulls_first(), "role", "text"]


def _types(rows: DataFrame) -> tuple[str, str]:
    return rows.schema["conv_id"].dataType.simpleString(), rows.schema["turn"].dataType.simpleString()


def _whole(rows: DataFrame) -> DataFrame:
    """Conversations of CHUNK rows at most, each repaired as soon as its rows have come, in order."""

    def work(rows: Iterator[dict]) -> Iterator[dict]:
        for conv, held in groupby(rows, lambda r: r["conv_id"]):
            columns = zip(*((r["turn"], r["role"], r["text"]) for r in held))
            yield dict(zip(("conv_id", *COUNTS, "audit", "repaired_sha256"), (conv, *_repair(*map(list, columns)))))

    return _mapped(rows.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions(*_order()), f"conv_id {_types(rows)[0]}, {_SHAPE}", work)


def _sorted_chunks(rows: DataFrame) -> DataFrame:
    """(conv_id, part, chunk, i, turn, role, text, symbol, fault) of long conversations, in the order of part, chunk and i.

    One range sort over all conversations cuts each of them into ranges; a conversation's first row of each role and text is looked up among those that repeat.
    """
    kind, turn_kind = _types(rows)
    named = rows.withColumn("key", F.struct("conv_id", F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")).alias("h")))
    met = named.groupBy("key").agg(F.min(F.struct("turn")).alias("first"), F.count("*").alias("n"))
    met = stash(met.where(F.col("n") > 1).select("key", F.col("first.turn").alias("first"), F.lit(True).alias("repeats")))
    rows = lookup_join(named, met, "key", "left", salt="turn").select("conv_id", "turn", "role", "text", "first", "repeats")
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def work(rows: Iterator[dict]) -> Iterator[dict]:
        part, chunk, i, before = TaskContext.get().partitionId(), -1, 0, None
        for row in rows:
            first, repeats = row.pop("first"), row.pop("repeats")
            if before is None or before["conv_id"] != row["conv_id"] or i == CHUNK:
                chunk, i = chunk + 1, 0
            # Equal rows of one turn follow each other, in one range.
            symbol, fault = _fault(row["role"], row["text"], bool(repeats) and (row["turn"] != first or row == before))
            before = row
            yield row | {"part": part, "chunk": chunk, "i": i, "symbol": symbol, "fault": fault}
            i += 1

    ordered = rows.repartitionByRange(tasks, *_order()).sortWithinPartitions(*_order())
    out = stash(_mapped(ordered, f"conv_id {kind}, turn {turn_kind}, role string, text string, part int, chunk int, i int, symbol int, fault string", work))
    discard(met)
    return out


def _fold(rows: DataFrame, schema: str, forward: bool, start: Callable[[], object], step: Callable[[object, dict], tuple[object, dict]]) -> DataFrame:
    """Go through the chunks of each conversation in order, or backward: step gives the next carry, and columns besides conv_id, part and chunk. A task holds a batch and the carry."""

    def work(rows: Iterator[dict]) -> Iterator[dict]:
        for _, held in groupby(rows, lambda r: r["conv_id"]):
            carry = start()
            for row in held:
                carry, made = step(carry, row)
                yield {x: row[x] for x in ("conv_id", "part", "chunk")} | made

    way = [F.col(c) if forward else F.desc(c) for c in ("part", "chunk")]
    place = f"conv_id {_types(rows.withColumn('turn', F.lit(0)))[0]}, part int, chunk int, "
    return _mapped(rows.repartition("conv_id").sortWithinPartitions("conv_id", *way), place + schema, work)


def _summary(row: dict) -> dict:
    """What a chunk tells of its symbols, roles and turns."""
    to, spent = tables().transition(np.array(row["symbols"], np.int64))
    known = [t for t in row["turns"] if t is not None]
    roles = row["roles"]
    return row | {
        "vector": to.tolist(), "spent": spent.tolist(), "illegal": sum(a + b not in _LEGAL for a, b in zip(roles, roles[1:])), "first_role": roles[0], "last_role": roles[-1],
        "n_turns": len(set(known)), "low": min(known, default=None), "high": max(known, default=None),
    }


def _backward(carry: tuple, row: dict) -> tuple:
    """The vector after each chunk, and the least cost from the start of it."""
    after, cost, last = carry
    before, cost = row["vector"][after], cost + row["spent"][after]
    return (before, cost, False), {"after": after, "last": last, "cost": cost + tables().vectors[before][0]}


def _counted(carry: tuple, row: dict) -> tuple:
    """Counts over the chunks so far: roles and turns also meet where two chunks do."""
    role, low, high, turns, sums = carry
    sums = [a + row[x] for a, x in zip(sums, COUNTS[1:5])]
    sums[3] += role is not None and role + row["first_role"] not in _LEGAL
    if row["n_turns"]:
        turns += row["n_turns"] - (high == row["low"])
        low, high = row["low"] if low is None else low, row["high"]
    return (row["last_role"], low, high, turns, sums), dict(zip(COUNTS, (high - low + 1 - turns if turns else 0, *sums)))


def _long(rows: DataFrame) -> DataFrame:
    """Conversations of more rows than a task should hold, in chunks: only one small row a chunk is gone through in order, but for the hash, whose task reads on and holds a batch."""
    kind, turn_kind = _types(rows)
    place = f"conv_id {kind}, part int, chunk int"
    cut = _sorted_chunks(rows)
    ordered = F.sort_array(F.collect_list(F.struct("i", "symbol", F.substring("role", 1, 1).alias("role"), "turn")))
    chunks = cut.groupBy("conv_id", "part", "chunk").agg(ordered.alias("x"), *[F.count_if(F.col("fault") == x).alias(x) for x in COUNTS[1:4]])
    chunks = chunks.select("conv_id", "part", "chunk", *COUNTS[1:4], F.col("x.symbol").alias("symbols"), F.col("x.role").alias("roles"), F.col("x.turn").alias("turns"))
    told = "symbols array<int>, vector array<int>, spent array<long>, illegal long, first_role string, last_role string, n_turns long"
    summed = stash(_mapped(chunks, f"{place}, blank long, duplicate long, truncated long, {told}, low {turn_kind}, high {turn_kind}", lambda rows: map(_summary, rows), 100))
    right = stash(_fold(summed.select("conv_id", "part", "chunk", "vector", "spent"), "after int, last boolean, cost long", False, lambda: (tables().end, 0, True), _backward))

    def ways(rows: Iterator[dict]) -> Iterator[dict]:
        for row in rows:
            found = [tables().trace(np.array(row["symbols"], np.int64), row["after"], q, row["last"]) for q in range(4)]
            yield row | {"edits": [e for e, _ in found], "leads": [q for _, q in found]}

    met = summed.select("part", "chunk", "symbols").join(right, ["part", "chunk"])
    traced = stash(_mapped(met, f"{place}, edits array<array<string>>, leads array<int>", ways, 10))
    entered = stash(_fold(traced.select("conv_id", "part", "chunk", "leads"), "state int", True, lambda: 0, lambda q, row: (row["leads"][q], {"state": q})))
    taken = stash(entered.join(traced.select("part", "chunk", "edits"), ["part", "chunk"]).select("conv_id", "part", "chunk", F.element_at("edits", F.col("state") + 1).alias("edits")))
    audit = taken.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "chunk", F.array_join("edits", "").alias("a")))).alias("x")).select("conv_id", F.array_join("x.a", "").alias("audit"))
    counted = _fold(summed.drop("vector", "spent", "symbols"), ", ".join(f"{x} long" for x in COUNTS[:5]), True, lambda: (None, None, None, 0, [0, 0, 0, 0]), _counted)
    # The last chunk has the counts of all, the first one the cost.
    counted = counted.groupBy("conv_id").agg(F.max_by(F.struct(*COUNTS[:5]), F.struct("part", "chunk")).alias("c")).select("conv_id", "c.*")
    cost = right.groupBy("conv_id").agg(F.min_by("cost", F.struct("part", "chunk")).alias("cost"))

    def hashed(rows: Iterator[dict]) -> Iterator[dict]:
        for conv, held in groupby(rows, lambda r: r["conv_id"]):
            digest, state, some = sha256(), 0, False
            for row in held:
                lines, state = _lines(row["edit"], state, row["role"], row["text"])
                if lines:
                    digest.update(("\n" * some + "\n".join(lines)).encode())
                    some = True
            yield {"conv_id": conv, "repaired_sha256": digest.hexdigest()}

    placed = taken.select("conv_id", "part", "chunk", F.posexplode("edits").alias("i", "edit")).join(cut.select("part", "chunk", "i", "role", "text"), ["part", "chunk", "i"], "left")
    digests = _mapped(placed.repartition("conv_id").sortWithinPartitions("conv_id", "part", "chunk", "i"), f"conv_id {kind}, repaired_sha256 string", hashed)
    out = counted
    for more in (cost, audit, digests):
        more = more.withColumnRenamed("conv_id", "other")
        out = out.join(more, F.col("conv_id").eqNullSafe(F.col("other"))).drop("other")
    out = stash(out.select("conv_id", *COUNTS, "audit", "repaired_sha256"))
    discard(cut, summed, right, traced, entered, taken)
    return out


def repair_conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of the conversations in rows(conv_id, turn, role, text), as they are.

    Rows go by turn, nulls first, then by role and text. A row's first fault counts: blank, duplicate (its role and text came before in the conversation),
    truncated. The cheapest edits that make the roles s?(ua)+ or nothing come from tables that hold, for every block of BLOCK symbols and every normalised
    vector of costs to the end, the vector before the block; of equally cheap edits the least in ASCII order are taken. Conversations of up to CHUNK rows
    are repaired whole. Longer ones are sorted by ranges and cut into chunks, whose transitions are composed: no task holds more than a chunk of one, though a
    SHA-256 has to read its conversation in order. Null ids are one conversation; empty roles, roles of other kinds and repeated rows are rows like others. An empty
    table gives no rows, further columns are not read.
    """
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    sizes = rows.groupBy("conv_id").count()
    long = stash(sizes.where(F.col("count") > CHUNK).select("conv_id", F.lit(True).alias("long")))
    if long.isEmpty():
        return _whole(rows)
    marked = lookup_join(rows, long, "conv_id", "left", salt="turn")
    return _whole(marked.where(F.col("long").isNull())).unionByName(_long(marked.where("long").drop("long")))


def damaged_and_repaired(rows: DataFrame) -> DataFrame:
    """repair_conversations() of rows after damage(); conversations of which no row is left have zeros, no edits and the hash of nothing."""
    out = repair_conversations(damage(rows)).withColumnRenamed("conv_id", "other")
    all_ = rows.select("conv_id").distinct()
    joined = all_.join(out, F.col("conv_id").eqNullSafe(F.col("other")), "left").drop("other")
    return joined.select("conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in COUNTS], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(sha256().hexdigest())).alias("repaired_sha256"))


def op13_dialogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return damaged_and_repaired(table(spark, sf_dir, "conversations"))
