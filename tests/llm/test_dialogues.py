"""Repair of conversations against a plain version."""

import random
import zlib
from collections import defaultdict
from hashlib import sha256
from itertools import product

import pytest

from logweave.llm import dialogues

SF = "/root/testdata/sf0.01"
SPACE = " \t\n\x0b\x0c\r"


def cheapest(rows, faults):
    """(cost, audit, lines) by trying all edits with memory of the states only: least cost, then least audit."""
    nxt, want = {"": "u", "s": "u", "u": "a", "a": "u"}, {"": "user", "s": "user", "u": "assistant", "a": "user"}
    ways = {"": (0, "", ())}

    def put(into, state, way):
        if state not in into or way[:2] < into[state][:2]:
            into[state] = way

    def inserted(ways):
        for _ in range(4):
            for q, (c, a, out) in list(ways.items()):
                put(ways, nxt[q], (c + 3, a + "I", out + (want[q] + ":",)))
        return ways

    # Partial audits of equal cost and state are compared, which is safe where the rest is the same for both.
    for (role, text), fault in zip(rows, faults):
        new = {}
        for q, (c, a, out) in inserted(ways).items():
            put(new, q, (c + 4, a + "D", out))
            if fault not in ("blank", "duplicate"):
                late = 3 * (fault == "truncated")
                if role[:1] == nxt[q] or role[:1] == "s" and q == "":
                    put(new, role[0], (c + late, a + "K", out + (f"{role}:{text}",)))
                put(new, nxt[q], (c + 3 + late, a + "R", out + (f"{want[q]}:{text}",)))
        ways = new
    return min(inserted(ways)[q] for q in ("", "a") if q in ways)


def plain(rows):
    """rows: (conv_id, turn, role, text) as they are; conv_id to the columns of damaged_and_repaired()."""
    show = lambda x: " " if x is None else str(x)
    held = defaultdict(list)
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = "user" if kind == 4 else show(role), "" if kind == 1 else show(text)
        if kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        held[conv] += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = {}
    for conv, kept in held.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults = set(), []
        for _, role, text in kept:
            core = text.rstrip(SPACE)
            faults.append("blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else None)
            seen.add((role, text))
        turns = {t for t, _, _ in kept if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(kept, kept[1:]))
        cost, audit, lines = cheapest([(r, t) for _, r, t in kept], faults)
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha256("\n".join(lines).encode()).hexdigest())
    return out


def found(spark, rows, kind="long"):
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], f"conv_id {kind}, turn long, role string, text string, cost int, part int").repartition(3)
    got = dialogues.damaged_and_repaired(df).collect()
    assert len({r.conv_id for r in got}) == len(got)
    return {r.conv_id: tuple(r)[1:] for r in got}


def rows_of(seed, convs=60):
    rng = random.Random(seed)
    rows = []
    for conv in range(convs):
        for turn in range(rng.choice((0, 1, 3, 8, 30))):
            role = rng.choice(("system", "user", "assistant", "user", "assistant", "tool", "s", "", None))
            text = rng.choice(("Yes.", "No!", "no end", "", " \t", None, f"text {rng.randrange(9)}?", "\u2003.", "é. \n"))
            rows.append((rng.choice((conv, conv, conv, None)) if conv < 3 else conv, rng.choice((turn, turn, turn * 3, None, turn // 2)), role, text))
    return rows


def test_given_conversations(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: tuple(r)[1:] for r in dialogues.op13_dialogues(spark, SF).collect()}
    assert got == plain(rows)
    assert sum(r[5] > 0 for r in got.values()) > 20


def test_blocks_equal_all_edits():
    """Every sequence of up to five symbols: costs and edits of the tables are those of trying all edits."""
    kinds = [(r, f) for r in ("system", "user", "assistant", "x") for f in (None, "truncated")] + [("user", "blank")]
    for n in range(5):
        for word in product(range(9), repeat=n):
            symbols = dialogues.np.array(word, dialogues.np.int64)
            t = dialogues.tables()
            to, spent = t.transition(symbols)
            cost, audit, _ = cheapest([(kinds[s][0], "t") for s in word], [kinds[s][1] for s in word])
            edits, _ = t.trace(symbols, t.end, 0, True)
            assert (int(spent[t.end]) + t.vectors[to[t.end]][0], "".join(edits)) == (cost, audit), word


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_plain_version(spark, seed):
    rows = rows_of(seed)
    assert found(spark, rows) == plain(rows)


def test_long_conversations_in_chunks(spark, monkeypatch):
    """Conversations of more than five rows go by chunks of five, over several ranges; one holds a third of all rows."""
    monkeypatch.setattr(dialogues, "CHUNK", 5)
    monkeypatch.setattr("logweave.llm.common.BROADCAST_CELLS", -1)
    rng = random.Random(5)
    rows = rows_of(3, 30) + [(77, i, rng.choice(("user", "assistant")), rng.choice(("same.", f"text {i}.", "cut"))) for i in range(300)]
    assert found(spark, rows) == plain(rows)


def test_edges(spark):
    """An empty table, all rows dropped, string ids, ids and turns that are null, a very long text, equal rows."""
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows = [(gone, 0, "user", "x."), (None, None, None, None), (None, None, "user", "a."), (5, 9, "user", "long. " * 200_000), (5, 9, "user", "long. " * 200_000), (5, 1 << 60, "assistant", "b")]
    want = {gone: (0,) * 6 + ("", sha256().hexdigest())} | {k: v for k, v in plain(rows).items() if k != gone}
    assert found(spark, rows) == want
    assert found(spark, []) == {}
    named = [("a b", t, "user", "x.") for t in range(3)]
    assert found(spark, named, "string") == plain(named)
