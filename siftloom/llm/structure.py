"""Conversation structure repair with Four-Russians block tables.

A conversation's rows become symbols (the role's initial, truncated or not, or a row that
must go), and legal dialogues the paths of a four-state automaton.  The least costs to go
from the four states, less their minimum, form few distinct vectors; for every block of
``BLOCK`` symbols a table holds the vector before it and the cost added for each vector
after it.  Rows are cut into chunks; a chunk looks its blocks up from the last to the first
for all vectors at once, chunks are composed like functions in a tree (so a conversation of
any length is shared by many tasks), and the vector after each chunk follows.  Then every
block is expanded backward into the vectors between its rows, and the cheapest edits are
read off forward, the ASCII-least first among equals.

Texts do not take part: rows are ordered and compared by role and SHA-256, and texts are
joined to the rows that stay.

Defined results: a null role or text is one blank, an empty role has no legal initial; rows
with a null id are one conversation; null turns come first; rows that share a turn are
ordered by role and digest of the text; repeated rows are duplicates; a table without rows
gives none; other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftloom.llm.registry import query, table
from siftloom.operators.skew import attach_per_key, with_positions_per_key
from siftloom.session import cut_lineage

DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
#: States: nothing yet, after a system row, after a user row, after an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
#: State that a user or assistant row leads to, by rerole or insertion.
NEXT = (USER, USER, ASSISTANT, USER)
#: Symbols: an initial (s, u, a, other), 4 more when truncated; a row that must go; no row.
INITIALS, GONE, NONE = "sua", 8, 9
BLOCK = 4
#: Rows per chunk, and chunks that one step composes.
CHUNK, FAN = 128, 256
BLANKS = r"\x20\x09-\x0D"


def _kept(state: int, initial: int) -> int | None:
    """State after keeping a row with this initial, if legal."""
    if initial == 0:
        return SYSTEM if state == START else None
    if initial == 1:
        return USER if state != USER else None
    return ASSISTANT if initial == 2 and state == USER else None


def _choices(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """(edit, its cost, next state) for a row in a state; inserts are apart.

    Keeping a system row is ``k``, so that edits alone tell the states; it counts as ``K``.
    """
    out = [("D", DELETE, state)]
    if symbol != GONE:
        cost = TRUNCATED if symbol >= 4 else 0
        after = _kept(state, symbol % 4)
        if after is not None:
            out.append(("k" if after == SYSTEM else "K", cost, after))
        out.append(("R", cost + REROLE, NEXT[state]))
    return out


def _before(symbol: int, after: tuple[int, ...]) -> tuple[int, ...]:
    """Costs to go before a symbol from those after it."""
    if symbol == NONE:
        return after
    cost = [min(c + after[q] for _, c, q in _choices(symbol, state)) for state in range(4)]
    for _ in range(3):
        cost = [min(cost[q], INSERT + cost[NEXT[q]]) for q in range(4)]
    return tuple(cost)


class Tables(NamedTuple):
    vectors: list[tuple[int, ...]]  # the first one holds at the end of a conversation
    step: np.ndarray  # [vector after, symbol] -> vector before
    step_cost: np.ndarray
    block: np.ndarray  # [vector after, block of symbols as a number] -> vector before
    block_cost: np.ndarray


@functools.cache
def tables() -> Tables:
    vectors = [(0, 2 * INSERT, INSERT, 0)]
    step: dict[tuple[int, int], tuple[int, int]] = {}
    for at, vector in enumerate(vectors):  # grows until it is closed
        for symbol in range(10):
            cost = _before(symbol, vector)
            low = min(cost)
            normal = tuple(c - low for c in cost)
            if normal not in vectors:
                vectors.append(normal)
            step[at, symbol] = (vectors.index(normal), low)
    one = np.array([[step[v, s] for s in range(10)] for v in range(len(vectors))], np.int32)
    block, cost = one[:, :, 0], one[:, :, 1]
    for _ in range(BLOCK - 1):
        # one more symbol in front of each block
        front = one[block]
        block = front[..., 0].transpose(0, 2, 1).reshape(len(vectors), -1)
        cost = (cost[:, :, None] + front[..., 1]).transpose(0, 2, 1).reshape(len(vectors), -1)
    return Tables(vectors, one[:, :, 0], one[:, :, 1], block, cost)


def blocks(symbols: list[str]) -> np.ndarray:
    """Block numbers of each string of symbols, filled up with NONE at the end."""
    longest = max((len(s) for s in symbols), default=0)
    count = -(-longest // BLOCK)
    digits = np.frombuffer("".join(s.ljust(count * BLOCK, str(NONE)) for s in symbols).encode(), np.uint8) - 48
    return digits.reshape(len(symbols), count, BLOCK).astype(np.int64) @ (10 ** np.arange(BLOCK - 1, -1, -1))


def costs(symbols: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For each string and vector after it: the vector before it and the cost added."""
    t = tables()
    at = np.tile(np.arange(len(t.vectors)), (len(symbols), 1))
    cost = np.zeros(at.shape, np.int64)
    numbers = blocks(symbols)
    for b in range(numbers.shape[1] - 1, -1, -1):
        number = numbers[:, b, None]
        cost += t.block_cost[at, number]
        at = t.block[at, number]
    return at, cost


@functools.lru_cache(200_000)
def expand(vector: int, number: int, state: int) -> tuple[str, int]:
    """Edits of a block from a state, ASCII-least among the cheapest, and the state after it."""
    t = tables()
    symbols = [int(c) for c in str(number).zfill(BLOCK)]
    inside = [vector]
    for symbol in reversed(symbols):
        inside.append(int(t.step[inside[-1], symbol]))
    inside.reverse()
    edits = []
    for i, symbol in enumerate(symbols):
        if symbol == NONE:
            continue
        here, after, added = t.vectors[inside[i]], t.vectors[inside[i + 1]], int(t.step_cost[inside[i + 1], symbol])
        while True:
            fits = [(e, q) for e, c, q in _choices(symbol, state) if here[state] + added == c + after[q]]
            if here[state] == INSERT + here[NEXT[state]]:
                fits.append(("I", NEXT[state]))
            edit, state = min(fits, key=lambda x: x[0].upper())
            edits.append(edit)
            if edit != "I":
                break
    return "".join(edits), state


def edits(symbols: list[str], vectors: list[int]) -> list[list[tuple[str, int]]]:
    """For each string, with the vector after it, and each state before it: edits and state after."""
    t = tables()
    out = []
    for numbers, vector in zip(blocks(symbols).tolist(), vectors, strict=True):
        after = [vector]
        for number in reversed(numbers):
            after.append(int(t.block[after[-1], number]))
        after.reverse()
        mine = []
        for state in range(4):
            parts = []
            for b, number in enumerate(numbers):
                part, state = expand(after[b + 1], number, state)
                parts.append(part)
            mine.append(("".join(parts), state))
        out.append(mine)
    return out


def roles(audit: str, state: int) -> Iterator[tuple[str, int | None, str | None]]:
    """(edit, row consumed or None, new role or None) of each kept or inserted row."""
    row = 0
    for edit in audit:
        if edit == "D":
            row += 1
            continue
        state = SYSTEM if edit == "k" else NEXT[state]
        role = None if edit in "kK" else "user" if state == USER else "assistant"
        yield edit.upper(), None if edit == "I" else row, role
        row += edit != "I"


def _carried(nodes: DataFrame, width: int, first: int, backward: bool) -> tuple[DataFrame, DataFrame]:
    """Compose the functions of each conversation's nodes in order.

    ``nodes`` has _c, node and f (an array of to and cost for each of ``width`` inputs).
    Returns (_c, node, at): the input that reaches each node, and (_c, to, cost): the whole.
    """
    levels, most = [nodes], nodes.agg(F.max("node")).first()[0] or 0
    same = F.array(*[F.struct(F.lit(i).alias("to"), F.lit(0).cast("long").alias("cost")) for i in range(width)])

    def apply(acc: Column, node: Column) -> Column:
        return F.transform(acc, lambda a: F.struct(F.get(node["f"], a["to"])["to"].alias("to"), (a["cost"] + F.get(node["f"], a["to"])["cost"]).alias("cost")))

    gathered = []
    while True:
        parts = levels[-1].groupBy("_c", F.floor(F.col("node") / FAN).alias("node")).agg(
            F.sort_array(F.collect_list(F.struct("node", "f")), asc=not backward).alias("parts"))
        gathered.append(parts)
        levels.append(parts.select("_c", "node", F.aggregate("parts", same, apply).alias("f")))
        most //= FAN
        if most == 0:
            break
    whole = levels[-1].select("_c", F.get("f", F.lit(first)).alias("f")).select("_c", "f.to", "f.cost")
    at = levels[-1].select("_c", "node", F.lit(first).alias("at"))
    none = F.array().cast("array<struct<node:bigint,at:int>>")

    def follow(acc: Column, node: Column) -> Column:
        return F.struct(F.get(node["f"], acc["at"])["to"].alias("at"),
                        F.concat(acc["out"], F.array(F.struct(node["node"].alias("node"), acc["at"].alias("at")))).alias("out"))

    for parts in reversed(gathered):
        start = F.struct(F.col("at").alias("at"), none.alias("out"))
        at = parts.join(at, ["_c", "node"]).select("_c", F.explode(F.aggregate("parts", start, follow)["out"]).alias("o")).select("_c", "o.node", "o.at")
    return at, whole


def conversation_key(conv: Column) -> Column:
    """A key that is not null and tells a null id from every other."""
    return F.coalesce(F.concat(F.lit("="), conv.cast("string")), F.lit(""))


class Repair(NamedTuple):
    summary: DataFrame  # conv, gaps, blank, duplicate, truncated, illegal, cost, audit
    rows: DataFrame  # conv, chunk, parted (into several chunks), seq (order), edit, position, role, text of the repaired rows


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> Repair:
    """Cheapest legal form of each conversation in ``rows``; conversations are named by ``_c``."""
    own_text = F.coalesce(F.col(text), F.lit(" "))
    source = rows.select(conversation_key(F.col(conv)).alias("_c"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit(" ")).alias("role"), own_text.alias("text"))
    narrow = source.select(
        "_c", "turn", "role", F.unhex(F.sha2("text", 256)).alias("sha"), (~F.col("text").rlike(f"[^{BLANKS}]")).alias("blank"),
        (~F.col("text").rlike(rf"[.!?][{BLANKS}]*\z")).alias("open"))
    ordered = with_positions_per_key(narrow, ["_c"], [F.asc_nulls_first("turn"), F.col("role"), F.col("sha")])
    ordered = cut_lineage(ordered)
    first = ordered.groupBy("_c", "role", "sha").agg(F.min("position").alias("first"), F.count("*").alias("_n"))
    marked = attach_per_key(ordered, first, ["_c", "role", "sha"], ["_c", "position"], hot_rows=10_000)
    repeated = ~F.col("blank") & (F.col("first") < F.col("position"))
    cut_off = ~F.col("blank") & ~repeated & F.col("open")
    initial = F.substring("role", 1, 1)
    code = F.when(F.col("blank") | repeated, F.lit(GONE)).otherwise(
        F.coalesce(*[F.when(initial == c, F.lit(i)) for i, c in enumerate(INITIALS)], F.lit(3)) + F.when(cut_off, 4).otherwise(0))
    marked = cut_lineage(marked.select(
        "_c", "position", "turn", "role", "sha", "blank", repeated.alias("repeated"), cut_off.alias("cut_off"),
        F.floor((F.col("position") - 1) / CHUNK).alias("node"), code.cast("string").alias("code"),
        F.when(initial.isin(*INITIALS), initial).otherwise("o").alias("initial")))

    # the last row of a chunk also opens the next one, for pairs of neighbours
    lent = marked.where(F.col("position") % CHUNK == 0).select("_c", F.col("node") + 1, "position", F.lit("").alias("code"), "initial").toDF("_c", "node", "position", "code", "initial")
    gathered = marked.select("_c", "node", "position", "code", "initial").unionByName(lent).groupBy("_c", "node").agg(
        F.array_sort(F.collect_list(F.struct("position", "code", "initial"))).alias("r"))
    initials = F.array_join("r.initial", "")
    chunks = gathered.select(
        "_c", "node", F.array_join("r.code", "").alias("symbols"),
        (F.length(initials) - 1 - F.regexp_count(initials, F.lit("(?=su|ua|au)"))).cast("long").alias("illegal")).where("symbols <> ''")

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            to, cost = costs(batch.column("symbols").to_pylist())
            yield pa.RecordBatch.from_pydict({
                **{c: batch.column(c) for c in ("_c", "node", "symbols", "illegal")}, "f": _functions(to, cost)})

    chunks = cut_lineage(chunks.mapInArrow(look_up, "_c string, node long, symbols string, illegal long, f array<struct<to:int,cost:long>>"))
    vectors = tables().vectors
    after, whole = _carried(chunks.select("_c", "node", "f"), len(vectors), 0, True)

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            found = edits(batch.column("symbols").to_pylist(), batch.column("at").to_pylist())
            to = np.array([[state for _, state in mine] for mine in found])
            yield pa.RecordBatch.from_pydict({
                "_c": batch.column("_c"), "node": batch.column("node"), "f": _functions(to, np.zeros(to.shape, np.int64)),
                "audits": pa.array([[a for a, _ in mine] for mine in found], pa.list_(pa.string()))})

    traced = cut_lineage(chunks.select("_c", "node", "symbols").join(after, ["_c", "node"]).select("_c", "node", "symbols", "at").mapInArrow(
        trace, "_c string, node long, f array<struct<to:int,cost:long>>, audits array<string>"))
    entered, _ = _carried(traced.select("_c", "node", "f"), 4, START, False)

    opening = F.get(F.array(*[F.lit(v[START]) for v in vectors]), F.col("to"))
    counts = marked.groupBy("_c").agg(
        F.count("*").alias("n"), *[F.count_if(c).alias(c) for c in ("blank", "repeated", "cut_off")])
    turns = marked.groupBy("_c", "turn").agg(F.lit(1)).groupBy("_c").agg(
        F.try_subtract(F.try_add(F.try_subtract(F.max("turn"), F.min("turn")), F.lit(1)), F.count("turn")).alias("gaps"))
    end = F.get("f", F.col("at"))["to"]
    tail = F.when(F.col("node") == F.floor((F.col("n") - 1) / CHUNK), F.when(end == SYSTEM, "II").when(end == USER, "I")).otherwise("")
    done = traced.join(entered, ["_c", "node"]).join(counts.select("_c", "n"), "_c").select(
        "_c", "node", (F.col("n") > CHUNK).alias("parted"), F.col("at").alias("state"), F.concat(F.get("audits", F.col("at")), F.coalesce(tail, F.lit(""))).alias("audit"))
    done = cut_lineage(done)

    text_of = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", "audit"))), lambda x: x["audit"]), "")
    summary = (
        counts.join(turns, "_c").join(chunks.groupBy("_c").agg(F.sum("illegal").alias("illegal")), "_c")
        .join(whole.select("_c", (F.col("cost") + opening).alias("cost")), "_c").join(done.groupBy("_c").agg(F.upper(text_of).alias("audit")), "_c")
        .select("_c", F.coalesce("gaps", F.lit(0)).cast("long").alias("gaps"), "blank", F.col("repeated").alias("duplicate"),
                F.col("cut_off").alias("truncated"), "illegal", "cost", "audit"))

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for c, node, parted, state, audit in zip(*(batch.column(x).to_pylist() for x in ("_c", "node", "parted", "state", "audit")), strict=True):
                out += [(c, node, parted, seq, edit, None if row is None else node * CHUNK + row + 1, new)
                        for seq, (edit, row, new) in enumerate(roles(audit, state))]
            columns = list(zip(*out, strict=True)) or [()] * 7
            kinds = (pa.string(), pa.int64(), pa.bool_(), pa.int32(), pa.string(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["_c", "chunk", "parted", "seq", "edit", "position", "new"])

    listed = done.mapInArrow(lines, "_c string, chunk long, parted boolean, seq int, edit string, position long, new string")
    texts = source.where(F.col("text").rlike(f"[^{BLANKS}]")).groupBy("_c", "role", F.unhex(F.sha2("text", 256)).alias("sha")).agg(F.first("text").alias("text"))
    stay = (listed.where("edit <> 'I'").join(marked.select("_c", "position", "role", "sha"), ["_c", "position"])
            .join(texts, ["_c", "role", "sha"]).select("_c", "chunk", "parted", "seq", "edit", "position", F.coalesce("new", "role").alias("role"), "text"))
    added = listed.where("edit = 'I'").select("_c", "chunk", "parted", "seq", "edit", "position", F.col("new").alias("role"), F.lit("").alias("text"))
    return Repair(summary, stay.unionByName(added))


def _functions(to: np.ndarray, cost: np.ndarray) -> pa.Array:
    """Rows of (to, cost) arrays."""
    ends = (np.arange(len(to) + 1) * to.shape[1]).astype(np.int32)
    one = pa.StructArray.from_arrays([pa.array(to.reshape(-1).astype(np.int32)), pa.array(cost.reshape(-1))], ["to", "cost"])
    return pa.ListArray.from_arrays(pa.array(ends), one)


def digests(rows: DataFrame) -> DataFrame:
    """(_c, sha256) of the ``role:text`` lines of repaired rows, joined by newlines.

    A digest is sequential by definition.  Lines are packed by chunk; a conversation of one
    chunk is hashed there, and of the others a sorted stream of chunks is, so a task holds one
    chunk of a conversation at a time.
    """
    line = F.concat("role", F.lit(":"), "text")
    packed = rows.groupBy("_c", "chunk", "parted").agg(F.array_sort(F.collect_list(F.struct("seq", line.alias("line")))).alias("l")).select(
        "_c", "chunk", "parted", F.array_join("l.line", "\n").alias("lines"))
    packed = cut_lineage(packed.select("_c", "chunk", "parted", F.when(F.col("parted"), F.col("lines")).alias("lines"), F.when(~F.col("parted"), F.sha2("lines", 256)).alias("sha256")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, state = None, None
        for batch in batches:
            ids, shas = [], []
            for c, part in zip(batch.column("_c").to_pylist(), batch.column("lines"), strict=True):
                if c != name:
                    if name is not None:
                        ids.append(name)
                        shas.append(state.hexdigest())
                    name, state = c, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(part.as_py().encode())
            yield pa.RecordBatch.from_pydict({"_c": pa.array(ids, pa.string()), "sha256": pa.array(shas, pa.string())})
        if name is not None:
            yield pa.RecordBatch.from_pydict({"_c": [name], "sha256": [state.hexdigest()]})

    streamed = packed.where("parted").select("_c", "chunk", "lines").repartition("_c").sortWithinPartitions("_c", "chunk").mapInArrow(run, "_c string, sha256 string")
    return packed.where("not parted").select("_c", "sha256").unionByName(streamed)


def damaged(rows: DataFrame) -> DataFrame:
    """The contract's damage: rows dropped, emptied, cut short, repeated or given the user's role."""
    blank = F.lit(" ")
    part = lambda c: F.coalesce(F.col(c).cast("string"), blank)
    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn"))) % 20
    rows = rows.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"), kind.alias("_kind")).where("_kind <> 0")
    return rows.select(
        "conv_id", "turn", F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy")).drop("_copy")


@query("op11_conversation_repair")
def op11(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found = repair(damaged(rows))
    every = rows.select("conv_id").distinct().withColumn("_c", conversation_key(F.col("conv_id")))
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return every.join(found.summary, "_c", "left").join(digests(found.rows), "_c", "left").select(
        "conv_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in numbers], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
