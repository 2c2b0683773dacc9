"""Bounded fair queues as queries over task events."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from ..functions.arrays import scan
from ..sources.written import written

#: Workers and queue bounds of the lanes; other lanes have the default's.
LANES = {"convert": (3, 16), "redact": (32, 256)}
DEFAULT_LANE = (8, 256)
ABANDONED_AFTER, KEPT_FOR = 60.0, 3600.0


def max_queued(lane: Column) -> Column:
    out = F.lit(DEFAULT_LANE[1])
    for name, (_, most) in LANES.items():
        out = F.when(lane == name, F.lit(most)).otherwise(out)
    return out


def ranked(rows: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """rows with ``name``: the row's number, from 1, in its group by the order. Groups of any size are ranked by many tasks.

    Rows are dealt into ranges of (group, order); each range counts its groups' rows, and the sums of the ranges
    before give each range its start. Rows alike in group and order stand in one range.
    """
    dealt = written(rows.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()))
    key = F.struct("_part", *by).alias("_key")
    sizes = dealt.groupBy("_part", *by).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(key, F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part", *by).orderBy(*order))
    numbered = dealt.withColumn("_inside", inside).withColumn("_key", key)
    return numbered.join(starts, "_key").withColumn(name, (F.col("_before") + F.col("_inside")).cast("int")).drop("_key", "_before", "_inside", "_part")


def admitted(tasks: DataFrame, bound: Column | None = None) -> DataFrame:
    """tasks(lane, seq) with ``admitted``: in a backlog that nothing leaves, the first ``bound`` of each lane."""
    return ranked(tasks, ["lane"], ["seq"], "_rank").withColumn("admitted", F.col("_rank") <= (max_queued(F.col("lane")) if bound is None else bound)).drop("_rank")


def _clamped(now: tuple[int, int, int], change: int, most: int) -> tuple[int, int, int]:
    """x -> min(max(x + a, low), high), and after it a change that is kept between 0 and most."""
    a, low, high = now
    keep = lambda x: min(max(x + change, 0), most)
    return a + change, keep(low), keep(high)


def admitted_live(events: DataFrame) -> DataFrame:
    """events(lane, seq, change, bound) with ``waiting`` and ``admitted``, while tasks come (change 1) and leave (-1).

    waiting: the lane's backlog before the event. A task that comes is admitted if the backlog is under the
    lane's bound, which is the same in all its rows; one that leaves an empty backlog changes nothing. admitted is null for those that leave.

    What a range of events does to any backlog is again x -> min(max(x + a, low), high), so the ranges are
    worked out side by side, put together in order, and then gone through again from the backlog each begins with.
    Rows of one lane and seq stand in one range, those that leave first.
    """
    order = ["lane", "seq", "change"]
    dealt = written(events.repartitionByRange("lane", "seq").sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()))

    def sums(batches):
        part, now = None, {}
        for b in batches:
            for p, lane, change, most in zip(*(c.to_pylist() for c in b.columns), strict=True):
                part, now[lane] = p, _clamped(now.get(lane, (0, 0, most)), change, most)
        if now:
            yield pa.RecordBatch.from_pydict({"part": [part] * len(now), "lane": list(now), "a": [x[0] for x in now.values()], "low": [x[1] for x in now.values()], "high": [x[2] for x in now.values()]}, pa.schema([("part", pa.int32()), ("lane", pa.string()), ("a", pa.int64()), ("low", pa.int64()), ("high", pa.int64())]))

    effects = dealt.select("_part", F.col("lane").cast("string"), F.col("change").cast("long"), F.col("bound").cast("long")).mapInArrow(sums, "part int, lane string, a long, low long, high long")
    # One row for each range and lane: a lane's rows are as many as the ranges.
    lists = effects.groupBy("lane").agg(F.array_sort(F.collect_list(F.struct("part", "a", "low", "high"))).alias("x"))
    begin = scan(F.col("x"), "array<bigint>", F.lit(0).cast("bigint"), lambda at, x: (F.least(F.greatest(at + x["a"], x["low"]), x["high"]), F.array(at)))
    starts = lists.select(F.col("lane").alias("_lane"), F.explode(F.arrays_zip("x", begin.alias("b"))).alias("z")).groupBy(F.col("z.x.part").alias("_p")).agg(F.map_from_entries(F.collect_list(F.struct(F.coalesce("_lane", F.lit("")), "z.b"))).alias("_starts"))
    # The ranges' starts are as many as their lanes, so they reach each range by a broadcast; order inside ranges stays.
    joined = dealt.join(F.broadcast(starts), F.col("_part") == F.col("_p"), "left").withColumn("_from", F.element_at("_starts", F.coalesce(F.col("lane").cast("string"), F.lit("")))).drop("_p", "_starts", "_part")
    names = joined.columns
    lane, change, bound, at = (names.index(c) for c in ("lane", "change", "bound", "_from"))

    def through(batches):
        now: dict = {}
        for b in batches:
            waiting, fits = [], []
            for k, d, most, begin in zip(*(b.column(i).to_pylist() for i in (lane, change, bound, at)), strict=True):
                x = now.get(k, begin)
                waiting.append(x)
                fits.append(x < most if d > 0 else None)
                now[k] = min(max(x + d, 0), most)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(waiting, pa.int64()), pa.array(fits, pa.bool_())], [*names[:-1], "waiting", "admitted"])

    return joined.mapInArrow(through, StructType([*joined.schema.fields[:-1], StructField("waiting", LongType()), StructField("admitted", BooleanType())]))


def fair_order(tasks: DataFrame) -> DataFrame:
    """tasks(lane, client, seq) with ``queue_position``: clients take turns in the order in which they came first."""
    turns = ranked(tasks, ["lane", "client"], ["seq"], "turn")
    came = tasks.groupBy(F.struct("lane", "client").alias("_who")).agg(F.min("seq").alias("came"))
    turns = turns.withColumn("_who", F.struct("lane", "client")).join(came, "_who").drop("_who")
    return ranked(turns, ["lane"], ["turn", "came"], "queue_position").drop("turn", "came")


def abandoned(tasks: DataFrame, now: Column, after: float = ABANDONED_AFTER) -> DataFrame:
    """Pending tasks whose caller hasn't asked for them for a while: they fail unrun."""
    return tasks.where((F.col("status") == "pending") & (now - F.col("polled_at") > after)).withColumn("status", F.lit("failed")).withColumn("error", F.lit("abandoned by the caller"))


def kept_alive(tasks: DataFrame, polls: DataFrame, key: str = "task_id", at: str = "ts") -> DataFrame:
    """tasks(polled_at) with the time of their last poll, if one came after; nothing else keeps a task alive."""
    last = polls.groupBy(key).agg(F.max(at).alias("_last"))
    return tasks.join(last, key, "left").withColumn("polled_at", F.greatest("polled_at", "_last")).drop("_last")


def expired(tasks: DataFrame, now: Column, ttl: float = KEPT_FOR) -> DataFrame:
    """Ended tasks that have been kept long enough."""
    return tasks.where((F.col("updated_at") < now - ttl) & ~F.col("status").isin("running", "pending"))


def last_state(events: DataFrame, key: str = "task_id", at: str = "ts", status: str = "status") -> DataFrame:
    return events.groupBy(key).agg(F.max_by(status, at).alias("status"), F.max(at).alias("updated_at"))


def collected(reads: DataFrame, key: str = "resource_id", at: str = "ts") -> DataFrame:
    """reads with ``found``: the first read of a resource takes it."""
    return reads.withColumn("found", F.row_number().over(Window.partitionBy(key).orderBy(at)) == 1)
