"""Live run counters, the run state machine and streaming ingestion.

Each stream shares its logic with a batch twin.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from siftloom import rules
from siftloom.operators.conflicts import first_claims
from siftloom.operators.dedup import file_keys
from siftloom.operators.links import usable_pages, web_page_records
from siftloom.operators.reports import run_counters
from siftloom.operators.skew import attach_per_key, with_positions_per_key
from siftloom.session import cut_lineage

#: states a progress report may not overwrite
PROTECTED = ("CANCEL_REQUESTED", "CANCELLED", "COMPLETED", "FAILED", "PAUSED")
REFERENCE_PROTECTED = ("CANCEL_REQUESTED", "CANCELLED", "COMPLETED", "FAILED")

#: user moves: the states each may leave, and the state it reaches
USER_MOVES: dict[str, tuple[tuple[str, ...], str]] = {
    "CANCEL_REQUESTED": (("PENDING", "RUNNING", "PAUSED", "CANCEL_REQUESTED"), "CANCEL_REQUESTED"),
    "PAUSED": (("PENDING", "RUNNING", "CANCEL_REQUESTED"), "PAUSED"),
    "RESUME": (("PAUSED",), "RUNNING"),
    "FORCE_CANCEL": (tuple(rules.RUN_STATUSES), "CANCELLED"),
}
#: moves that ask for a state the run already has are accepted and change nothing
SAME_STATE = {"CANCEL_REQUESTED": "CANCELLED", "PAUSED": "PAUSED", "RESUME": "RUNNING"}


def next_status(current: str, move: str, protected: Sequence[str] = PROTECTED) -> tuple[str, bool]:
    """(status after the move, accepted).  Worker reports are never refused; a progress
    report leaves a protected state as it is."""
    if move in USER_MOVES:
        if SAME_STATE.get(move) == current:
            return current, True
        allowed, target = USER_MOVES[move]
        return (target, True) if current in allowed else (current, False)
    if move == "RUNNING" and current in protected:
        return current, True
    return move, True


def _next_status_column(current: Column, move: Column, protected: Sequence[str]) -> Column:
    """The same rules as a column."""
    out = F.when((move == "RUNNING") & current.isin(list(protected)), current)
    for name, (allowed, target) in USER_MOVES.items():
        same = SAME_STATE.get(name)
        if same:
            out = out.when((move == name) & (current == same), current)
        out = out.when((move == name) & current.isin(list(allowed)), target)
        out = out.when(move == name, current)
    return out.otherwise(move)


# Statuses as digits, so that the effect of a whole run of moves is one short string.
_STATES = ["PENDING", *[s for s in rules.RUN_STATUSES if s != "PENDING"]]


def _transition(move: Column, protected: Sequence[str]) -> Column:
    """Map of one move: the state digit reached from each state, as a string."""
    digit = lambda status: F.array_position(F.array(*[F.lit(s) for s in _STATES]), status) - 1
    return F.concat(*[digit(_next_status_column(F.lit(s), move, protected)).cast("string") for s in _STATES])


def final_status(
    events: DataFrame, start: str = "PENDING", protected: Sequence[str] = PROTECTED, block: int = 1000
) -> DataFrame:
    """(run_id, status, moves) after folding every move of a run in event order.

    A move is a map from states to states.  Some moves lead to one state from every other
    (a worker's COMPLETED), so nothing before a run's last such move matters: it is found by
    a map-side maximum, and only the moves from there on are written and composed.  Runs
    that still have more than ``block`` moves are composed in blocks, then blocks of blocks,
    so the longest run is never folded in one group.
    """
    moves = events.select("run_id", "event_id", "ts", _transition(F.col("move"), protected).alias("f"))
    at = F.struct("ts", "event_id")
    constant = F.col("f") == F.repeat(F.substring("f", 1, 1), F.lit(len(_STATES)))
    runs = moves.groupBy("run_id").agg(F.max(F.when(constant, at)).alias("last"), F.count("*").alias("_n"))
    since = attach_per_key(moves, runs, ["run_id"], ["event_id"]).where(F.col("last").isNull() | (at >= F.col("last")))
    since = cut_lineage(since.select("run_id", "ts", "event_id", "f"))
    long = since.groupBy("run_id").agg(F.count("*").alias("n")).where(F.col("n") > block).select("run_id")
    folded = since.join(long, "run_id", "left_anti").groupBy("run_id").agg(_compose(at, "f").alias("f"))
    if not long.isEmpty():
        folded = folded.unionByName(_folded_in_blocks(since.join(long, "run_id", "left_semi"), block))
    first = _STATES.index(start) + 1
    state = F.substring("f", first, 1).cast("int") + 1
    named = folded.select("run_id", F.element_at(F.array(*[F.lit(s) for s in _STATES]), state).alias("status"))
    return named.join(runs.select("run_id", F.col("_n").alias("moves")), "run_id")


def _folded_in_blocks(moves: DataFrame, block: int) -> DataFrame:
    """(run_id, f): the composition of each run's moves, block by block."""
    numbered = with_positions_per_key(moves, ["run_id"], [F.col("ts"), F.col("event_id")], "n")
    level = cut_lineage(numbered.groupBy("run_id", F.floor((F.col("n") - 1) / block).alias("at")).agg(_compose(F.col("n"), "f").alias("f")))
    # each round divides the longest run by ``block``, until every run is one row
    while (level.agg(F.max("at").alias("last")).first().last or 0) > 0:
        level = cut_lineage(level.groupBy("run_id", F.floor(F.col("at") / block).alias("at")).agg(_compose(F.col("at"), "f").alias("f")))
    return level.select("run_id", "f")


def _compose(order: Column, name: str) -> Column:
    """Composition of the maps of a group, first to last."""
    ordered = F.array_sort(F.collect_list(F.struct(order.alias("at"), F.col(name).alias("f"))))
    identity = "".join(str(i) for i in range(len(_STATES)))

    def then(acc: Column, step: Column) -> Column:
        return F.concat(
            *[
                F.substring(step["f"], F.substring(acc, i + 1, 1).cast("int") + 1, F.lit(1))
                for i in range(len(_STATES))
            ]
        )

    return F.aggregate(ordered, F.lit(identity), then)


class RunStateMachine(StatefulProcessor):
    """Keeps the status of one run; emits one row per move, refused moves included.

    Moves wait in a list until the watermark has passed them and are then made in event
    order, so the outcome does not depend on how the moves fell into batches.  What waits is
    a run's moves within the watermark's delay; they leave in chunks.
    """

    #: answers of one yielded frame
    chunk = 50_000

    def __init__(self, protected: Sequence[str] = PROTECTED, start: str = "PENDING") -> None:
        self.protected = tuple(protected)
        self.start = start

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.status = handle.getValueState("status", "status string")
        self.waiting = handle.getListState("waiting", "ts long, event_id long, move string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        known = set(self.handle.listTimers())
        for frame in rows:
            # the last microsecond counts: a timer fires once the watermark is past the moves of its millisecond
            micros = frame["ts"].astype("datetime64[us]").astype("int64")
            self.waiting.appendList(list(zip(micros.tolist(), frame["event_id"].astype(int).tolist(), frame["move"].tolist())))
            for due in set((micros // 1000 + 1).tolist()) - known:
                self.handle.registerTimer(due)
                known.add(due)
        return iter([])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        until = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted(self.waiting.get())
        due = [m for m in waiting if m[0] < until]
        rest = waiting[len(due):]
        if rest:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
        current = self.status.get()[0] if self.status.exists() else self.start
        for at in range(0, len(due), self.chunk):
            out = []
            for _, event_id, move in due[at: at + self.chunk]:
                before = current
                current, accepted = next_status(current, move, self.protected)
                out.append((key[0], event_id, move, before, current, accepted))
            yield pd.DataFrame(out, columns=["run_id", "event_id", "move", "before", "status", "accepted"])
        if due:
            self.status.update((current,))

    def close(self) -> None:
        pass


STATE_SCHEMA = "run_id string, event_id long, move string, before string, status string, accepted boolean"


def run_states(events: DataFrame, delay: str = "1 hour", protected: Sequence[str] = PROTECTED) -> DataFrame:
    """Stream of state changes of ``events`` (run_id, event_id, ts, move), each when the watermark passes it.

    Moves may arrive out of order by up to ``delay``; later ones are dropped.  Needs the
    RocksDB state store of the session.
    """
    return events.withWatermark("ts", delay).groupBy("run_id").transformWithStateInPandas(
        statefulProcessor=RunStateMachine(protected), outputStructType=STATE_SCHEMA,
        outputMode="Append", timeMode="EventTime",
    )


ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


# --- streams -----------------------------------------------------------------


def live_counters(events: DataFrame) -> DataFrame:
    """Running counters per run; write in update mode."""
    return run_counters(events)


def start_counters(events: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None]):
    return (
        live_counters(events).writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint).foreachBatch(sink).start()
    )


class KnownKeys:
    """URLs and hashes of all files admitted so far, in folders that micro-batches prune.

    Keys are dealt to ``parts`` by hash and sorted, so a batch reads the parts of its own
    keys, and of these the row groups that may hold them.  Each batch adds a folder of its
    own, replaced when the batch is replayed; every ``merge`` batches what came before is
    merged into a new base.  The catalog is read once, into the first base.
    """

    def __init__(self, spark: SparkSession, folder: str, parts: int = 64, merge: int = 50) -> None:
        self.spark, self.folder, self.parts, self.merge = spark, folder, parts, merge

    def _keyed(self, files: DataFrame) -> DataFrame:
        keys = files.select(F.explode(F.array_compact(F.array(*file_keys(files)))).alias("key")).distinct()
        return keys.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(self.parts)).cast("int"))

    def _write(self, keys: DataFrame, name: str) -> None:
        keys.repartition(min(self.parts, 8), "part").sortWithinPartitions("part", "key").write.mode("overwrite").partitionBy("part").parquet(f"{self.folder}/{name}")

    def _written(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}/_SUCCESS")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def _read(self, base: int, until: int) -> DataFrame:
        schema = "key string, part int"
        names = [f"base={base}", *[f"batch={i}" for i in range(base, until)]]
        return functools.reduce(DataFrame.unionByName, [
            self.spark.read.schema(schema).parquet(f"{self.folder}/{n}") for n in names if self._written(n)])

    def start(self, catalog: DataFrame) -> None:
        """Take over the stored files, unless an earlier start has done so."""
        if not self._written("base=0"):
            self._write(self._keyed(catalog.where("status = 'UPLOADED'")), "base=0")

    def unknown(self, rows: DataFrame, batch_id: int) -> DataFrame:
        """Rows without a known key before a batch."""
        base = batch_id // self.merge * self.merge
        if base and not self._written(f"base={base}"):
            self._write(self._read(base - self.merge, base), f"base={base}")
        wanted = cut_lineage(self._keyed(rows))
        touched = [r.part for r in wanted.select("part").distinct().collect()]  # at most ``parts``
        known = self._read(base, batch_id).where(F.col("part").isin(touched)).join(wanted, ["part", "key"], "left_semi").select("key").distinct()
        known = cut_lineage(known)
        for key in file_keys(rows):
            rows = rows.withColumn("_key", key).join(known, F.col("_key") == F.col("key"), "left_anti").drop("_key")
        return rows

    def add(self, rows: DataFrame, batch_id: int) -> None:
        self._write(self._keyed(rows), f"batch={batch_id}")


def start_known_file_skip(
    incoming: DataFrame, read_catalog: Callable[[], DataFrame], out: str, checkpoint: str, order: str, merge: int = 50,
):
    """Write the rows that a replay by ``order`` admits: no file before them has their URL or content.

    That holds against the stored files, earlier batches and earlier rows of a batch alike.
    A row's two keys decide about each other (a refused row claims neither), so no single
    grouping key of a stateful operator can hold the state; ``KnownKeys`` does.  ``order``
    numbers the rows.  Folders of a replayed batch are replaced, so a restart changes nothing.
    """
    keys = KnownKeys(incoming.sparkSession, f"{checkpoint}-keys", merge=merge)
    keys.start(read_catalog())

    def admit(batch: DataFrame, batch_id: int) -> None:
        new = cut_lineage(keys.unknown(batch, batch_id))
        url, content = file_keys(new)
        first = first_claims(new.select(order, url.alias("_url"), content.alias("_content")), ["_url", "_content"], order)
        taken = cut_lineage(new.join(first, order, "left_semi"))
        keys.add(taken, batch_id)
        taken.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return incoming.writeStream.option("checkpointLocation", checkpoint).foreachBatch(admit).start()


def start_page_ingestion(pages: DataFrame, out: str, checkpoint: str):
    """Turn arriving pages into usable records; stateless, one folder per batch."""
    records = usable_pages(web_page_records(pages))

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return records.writeStream.option("checkpointLocation", checkpoint).foreachBatch(save).start()


def error_log(events: DataFrame) -> DataFrame:
    """Append-only error rows from run events."""
    return events.where("kind = 'failed'").select(
        F.concat(F.lit("err-"), "event_id").alias("error_id"), F.col("run_id").alias("run_pk"),
        F.lit("NETWORK_ERROR").alias("error_code"), F.col("ts").alias("created_at"),
    )


def audit_log(actions: DataFrame) -> DataFrame:
    """Append-only audit rows from user moves."""
    names = F.create_map(
        *[F.lit(x) for pair in {
            "CANCEL_REQUESTED": "run.cancel_requested", "PAUSED": "run.paused", "RESUME": "run.resumed",
            "FORCE_CANCEL": "run.force_cancelled",
        }.items() for x in pair]
    )
    return actions.where(F.col("move").isin(list(USER_MOVES))).select(
        F.concat(F.lit("aud-"), "event_id").alias("audit_id"),
        F.try_element_at(names, F.col("move")).alias("action"),
        F.lit("CollectionRun").alias("entity_type"), F.col("run_id").alias("entity_id"), F.col("ts").alias("created_at"),
    )


def start_log(rows: DataFrame, out: str, checkpoint: str):
    return (
        rows.writeStream.format("parquet").outputMode("append")
        .option("path", out).option("checkpointLocation", checkpoint).start()
    )
