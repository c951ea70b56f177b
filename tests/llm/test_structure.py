"""Conversation repair against the cheapest of all edits, and its tables."""

import hashlib
import random
import re
import zlib
from functools import cache

import pytest

from siftloom.llm import structure
from siftloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SOLID = re.compile(r"[^\x20\x09-\x0D]")
NEXT = {"": "user", "s": "user", "u": "assistant", "a": "user"}


def brute(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, lines) of rows in order."""
    seen, faults = set(), []
    for _, role, text in rows:
        solid = SOLID.findall(text)
        fault = "blank" if not solid else "duplicate" if (role, text) in seen else "" if solid[-1] in ".!?" else "truncated"
        seen.add((role, text))
        faults.append(fault)
    turns = [t for t, _, _ in rows if t is not None]
    initials = [role[:1] or " " for _, role, _ in rows]
    illegal = sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:], strict=False))

    @cache
    def best(i, state, inserts):
        """Least (cost, audit, lines) of the rest; ``inserts`` in a row so far."""
        options = []
        if i == len(rows) and state in ("", "a"):
            options.append((0, "", ()))
        if i < len(rows):
            _, role, text = rows[i]
            options.append(step(4, "D", None, i + 1, state))
            if faults[i] not in ("blank", "duplicate"):
                more = 3 if faults[i] == "truncated" else 0
                legal = {"s": "" == state, "u": state != "u", "a": state == "u"}.get(initials[i], False)
                if legal:
                    options.append(step(more, "K", (role, text), i + 1, initials[i]))
                options.append(step(more + 3, "R", (NEXT[state], text), i + 1, NEXT[state][0]))
        if inserts < 3:
            options.append(step(3, "I", (NEXT[state], ""), i, NEXT[state][0], inserts + 1))
        return min(o for o in options if o is not None) if any(options) else None

    def step(cost, edit, line, i, state, inserts=0):
        rest = best(i, state, inserts)
        if rest is None:
            return None
        return (cost + rest[0], edit + rest[1], ((line,) if line else ()) + rest[2])

    cost, audit, lines = best(0, "", 0)
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("blank"), faults.count("duplicate"),
            faults.count("truncated"), illegal, cost, audit, [f"{r}:{t}" for r, t in lines])


def in_order(rows):
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest())
    return sorted(rows, key=key)


def damage(conv, turn, role, text):
    kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
    role, text = " " if role is None else role, " " if text is None else text
    if kind == 0:
        return []
    text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
    return [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)


def expected(rows):
    groups = {}
    for conv, *rest in rows:
        groups.setdefault(conv, []).extend(damage(conv, *rest))
    for conv, mine in groups.items():
        *numbers, lines = brute(in_order(mine)) if mine else (0, 0, 0, 0, 0, 0, "", [])
        yield (conv, *numbers, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def order(row):
    return (row[0] is not None, row[0] or 0)


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_query_on_whole_table(spark):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()]
    got = QUERIES["op11_conversation_repair"](spark, SF).select(COLUMNS).collect()
    assert sorted(map(tuple, got), key=order) == sorted(expected(rows), key=order)


@pytest.mark.parametrize("chunk, fan", [(structure.CHUNK, structure.FAN), (3, 2)])
def test_random_conversations(spark, folder, monkeypatch, chunk, fan):
    monkeypatch.setattr(structure, "CHUNK", chunk)
    monkeypatch.setattr(structure, "FAN", fan)
    draw = random.Random(11)
    roles = ["user", "assistant", "system", "tool", "umpire", "", None]
    texts = ["Yes.", "No?", "cut", "cut off ", "", " \t", None, "end!\n", "é.", ". x"]
    rows = [(conv, draw.choice([None, *range(12)]), draw.choices(roles, [5, 5, 2, 1, 1, 1, 1])[0], draw.choice(texts) if draw.random() < 0.5 else f"{draw.random()}.")
            for conv in [None, *range(40)] for _ in range(draw.randint(1, 14))]
    rows += [(99, i, draw.choice(roles), f"{i % 70}.") for i in range(150)] + [(100, 1, "user", "x" * 300_000 + ".")] * 3
    path = f"{folder}/conversations.parquet"
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS _c", "2 AS position", "3 AS sha").write.parquet(path)
    got = QUERIES["op11_conversation_repair"](spark, folder).select(COLUMNS).collect()
    want = {r[0]: r for r in expected(rows)}
    assert len(got) == len(want)
    for row in map(tuple, got):
        assert row == want[row[0]]


def test_empty_table(spark, folder):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    assert QUERIES["op11_conversation_repair"](spark, folder).count() == 0


def test_block_tables_equal_single_steps():
    t = structure.tables()
    draw = random.Random(2)
    for _ in range(200):
        symbols = "".join(str(draw.randrange(9)) for _ in range(draw.randint(1, 11)))
        at, cost = structure.costs([symbols])
        for vector in range(len(t.vectors)):
            v, total = t.vectors[vector], 0
            for symbol in reversed(symbols):
                v = structure._before(int(symbol), v)
                total, v = total + min(v), tuple(c - min(v) for c in v)
            assert (t.vectors[at[0, vector]], cost[0, vector]) == (v, total)
