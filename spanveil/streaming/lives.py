"""Lives of tasks from a stream of events, in the order of event time however the events arrive."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..sources.written import shared_folder
from .tasks import MOVES

OUT = "task_id string, at double, status string, reason string"
ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
FOREVER = float("inf")
#: Keys over which tasks are dealt.
PARTS = 4096
#: What can change a task or keep it alive.
EVENTS = sorted({event for _, event in MOVES} | {"poll"})
HELD = pa.schema([("task_id", pa.string()), ("at", pa.float64()), ("seq", pa.int64()), ("event", pa.int8())])
KNOWN = pa.schema([("task_id", pa.string()), ("status", pa.string()), ("asked", pa.float64())])


def packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def opened(values: list[bytes], schema: pa.Schema) -> pa.Table:
    return pa.concat_tables([schema.empty_table(), *(pa.ipc.open_stream(bytes(v)).read_all() for v in values)])


class Lives(StatefulProcessor):
    """Events wait in a list until the watermark has passed them; then they are taken in order, and what is due between them happens.

    A pending task that nobody asks for in ``abandoned_after`` seconds fails; an ended one expires after ``kept_for``,
    unless somebody asks for it before, and nothing of it is kept. The key is a part of the tasks, since each key, value and
    frame costs calls and conversions of its own: a batch's events of a part wait as one value, and its tasks are one.
    """

    def __init__(self, abandoned_after: float, kept_for: float) -> None:
        self.abandoned_after, self.kept_for = abandoned_after, kept_for

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "events binary")
        self.tasks = handle.getValueState("tasks", "known binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = FOREVER
        for frame in rows:
            frame = frame[frame["event"] >= 0]
            if frame.empty:
                continue
            first = min(first, float(frame["at"].min()))
            self.waiting.appendValue((packed(pa.Table.from_pandas(frame[HELD.names], HELD, preserve_index=False).replace_schema_metadata()),))
        if first < FOREVER:
            self._wake(first, timerValues)
        return iter(())

    def _wake(self, at: float, timerValues) -> None:
        self.handle.registerTimer(max(int(at * 1000) + 1, timerValues.getCurrentWatermarkInMs() + 1))

    def _due(self, status: str, asked: float) -> float:
        return FOREVER if status in ("", "running") else asked + (self.abandoned_after if status == "pending" else self.kept_for)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, out = timerValues.getCurrentWatermarkInMs() / 1000.0, []
        held = opened([x[0] for x in self.waiting.get()], HELD)
        ready, later = held.filter(pc.field("at") <= now), held.filter(pc.field("at") > now)
        was = self.tasks.get()
        known = {task: (status, asked) for task, status, asked in zip(*opened([was[0]], KNOWN).to_pydict().values(), strict=True)} if was else {}

        def pass_to(task: str, at: float) -> None:
            """What is due for a task up to a time."""
            status, asked = known.get(task, ("", 0.0))
            while (due := self._due(status, asked)) <= at:
                status, why = ("failed", "abandoned") if status == "pending" else ("", "expired")
                asked = due
                out.append((task, due, status or "expired", why))
            if status:
                known[task] = status, asked
            else:
                known.pop(task, None)

        in_order = ready.sort_by([(name, "ascending") for name in HELD.names]).to_pydict()
        for task, at, event in zip(in_order["task_id"], in_order["at"], (EVENTS[i] for i in in_order["event"]), strict=True):
            pass_to(task, at)
            status = known.get(task, ("",))[0]
            to = MOVES.get((status, event))
            if to:
                out.append((task, at, to, event))
            if to or (event == "poll" and status):
                known[task] = to or status, at
        for task in list(known):
            pass_to(task, now)
        if ready.num_rows and later.num_rows:
            self.waiting.put([(packed(later),)])
        elif ready.num_rows:
            self.waiting.clear()
        if known and (ready.num_rows or out):
            self.tasks.update((packed(pa.table([list(known), *([x[i] for x in known.values()] for i in (0, 1))], schema=KNOWN)),))
        elif was and not known:
            self.tasks.clear()
        following = min([FOREVER, *(self._due(*x) for x in known.values()), *([pc.min(later["at"]).as_py()] if later.num_rows else [])])
        if following < FOREVER:
            self._wake(following, timerValues)
        if out:
            yield pd.DataFrame(out, columns=["task_id", "at", "status", "reason"])

    def close(self) -> None:
        pass


def task_lives(events: DataFrame, late: str = "10 seconds", abandoned_after: float = 60.0, kept_for: float = 3600.0, parts: int = PARTS) -> DataFrame:
    """events(task_id string, seq long, ts timestamp, event) to a row for each change of a task: its time in seconds, the status and why.

    Events older than ``late`` before the newest one of earlier batches are dropped; all others count in the order of (ts, seq).
    Events without a time, and those of kinds that do nothing, are passed over; those without a number come last at their time.
    Tasks are dealt by hash to ``parts`` keys. A key's waiting events and living tasks are in memory together, and a stream keeps its number of keys.
    """
    place = F.array_position(F.lit(EVENTS), F.col("event")) - 1
    part = F.pmod(F.xxhash64("task_id"), F.lit(parts)).cast("int")
    timed = events.select("task_id", "ts", F.expr("unix_micros(ts) / 1e6").alias("at"), F.coalesce("seq", F.lit(2**63 - 1)).alias("seq"), F.coalesce(place, F.lit(-1)).cast("int").alias("event"), part.alias("part")).withWatermark("ts", late)
    # Kinds that do nothing are left out by the processor: a filter would go below the watermark, which counts them.
    return timed.where("at is not null").groupBy("part").transformWithStateInPandas(Lives(abandoned_after, kept_for), OUT, "Append", "eventTime")


def run_through(stream: DataFrame, folder: str | None = None) -> DataFrame:
    """What a stream puts out over all that has come so far. With the folder of an earlier run it goes on from there, and gives the rows of both."""
    spark = stream.sparkSession
    folder = folder or f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    before = spark.conf.get(ROCKS[0], None)
    spark.conf.set(*ROCKS)
    try:
        started = stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    finally:
        spark.conf.set(ROCKS[0], before) if before else spark.conf.unset(ROCKS[0])
    started.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")
