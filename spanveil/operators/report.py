"""Load-report analytics over attempts and polls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def attribute_polls(polls: DataFrame, key: str = "task_id", at: str = "ts", status: str = "status") -> DataFrame:
    """Seconds queued and at work: each interval between polls counts for the status at its beginning, 'pending' before the first."""
    w = Window.partitionBy(key).orderBy(at)
    gaps = polls.withColumn("_was", F.lag(status, 1, "pending").over(w)).withColumn("_s", F.coalesce(F.col(at) - F.lag(at).over(w), F.lit(0.0)))
    return gaps.groupBy(key).agg(F.sum(F.when(F.col("_was") == "pending", F.col("_s")).otherwise(0.0)).alias("queue_s"), F.sum(F.when(F.col("_was") != "pending", F.col("_s")).otherwise(0.0)).alias("work_s"), F.count("*").alias("polls"))


def nearest_rank(values: Column, fraction: float) -> Column:
    """The value at rank round(fraction * (n - 1)), halves to even; 0 of none. It gathers the group: for small groups."""
    ordered = F.array_sort(F.collect_list(values))
    return F.coalesce(F.get(ordered, F.bround(F.lit(fraction) * (F.size(ordered) - 1)).cast("int")), F.lit(0.0))


def nearest_ranks(rows: DataFrame, keys: list[str], value: Column, fraction: float, ranges: int = 200) -> DataFrame:
    """(keys, ``value``): each group's value at rank round(fraction * (n - 1)), halves to even, for groups of any size.

    Approximate quantiles part a group into ranges; rows are counted by range, and only the rows of the
    range that holds the rank are put in order. Groups without a value give no row.
    """
    some = rows.where(value.isNotNull()).select(*keys, value.alias("_v"))
    cuts = some.groupBy(*keys).agg(F.percentile_approx("_v", [i / ranges for i in range(1, ranges)], 10_000).alias("_cuts"))
    placed = some.join(cuts, keys).withColumn("_b", F.size(F.filter("_cuts", lambda c: c < F.col("_v")))).drop("_cuts")
    group = Window.partitionBy(*keys)
    counts = placed.groupBy(*keys, "_b").agg(F.count("*").alias("_n")).withColumn("_upto", F.sum("_n").over(group.orderBy("_b"))).withColumn("_rank", F.bround(F.lit(fraction) * (F.sum("_n").over(group) - 1)).cast("long"))
    held = counts.where("_rank < _upto and _rank >= _upto - _n").select(*keys, "_b", (F.col("_rank") - F.col("_upto") + F.col("_n")).alias("_left"))
    order = F.row_number().over(group.orderBy("_v")) - 1
    return placed.join(held, [*keys, "_b"]).withColumn("_i", order).where("_i = _left").select(*keys, F.col("_v").alias("value"))


def stage_report(attempts: DataFrame) -> DataFrame:
    """Per stage: successes, mean submit time, median and largest queue and work times, median total, failures, refusals, a minute's throughput."""
    total = F.col("submit_s") + F.col("queue_s") + F.col("work_s") + F.col("collect_s")
    good = F.col("error").isNull()
    ok = lambda c: F.when(good, c)
    wall = F.max(F.col("started_at") + total) - F.min("started_at")
    measures = {"queue_s": F.col("queue_s"), "work_s": F.col("work_s"), "total_s": total}
    each = attempts.where(good).select("stage", F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), v.alias("v")) for k, v in measures.items()])).alias("m")).select("stage", "m.measure", "m.v")
    middle = nearest_ranks(each, ["stage", "measure"], F.col("v"), 0.5).groupBy("stage").agg(*[F.max(F.when(F.col("measure") == k, F.col("value"))).alias(f"p50_{k}") for k in measures])
    sums = attempts.groupBy("stage").agg(
        F.count_if(good).alias("n"), F.avg(ok(F.col("submit_s"))).alias("mean_submit_s"), F.max(ok(F.col("queue_s"))).alias("max_queue_s"), F.max(ok(F.col("work_s"))).alias("max_work_s"),
        F.count_if(~good).alias("failures"), F.count_if(F.col("error").contains("429")).alias("refused"), F.when(wall > 0, F.count_if(good) / wall * 60).alias("per_minute"), F.max("max_queue_position").alias("max_queue_position"),
    )
    return sums.join(middle, "stage", "left").fillna(0.0, [f"p50_{k}" for k in measures])


def in_flight(attempts: DataFrame) -> DataFrame:
    """Tasks under way in each second, by stage, from entries and exits: the rows don't grow with how long tasks last."""
    end = F.floor(F.col("started_at") + F.col("submit_s") + F.col("queue_s") + F.col("work_s") + F.col("collect_s"))
    steps = attempts.select("stage", F.explode(F.array(F.struct(F.floor("started_at").alias("s"), F.lit(1).alias("d")), F.struct((end + 1).alias("s"), F.lit(-1).alias("d")))).alias("e")).groupBy("stage", "e.s").agg(F.sum("e.d").alias("d"))
    return steps.withColumn("in_flight", F.sum("d").over(Window.partitionBy("stage").orderBy("s"))).select("stage", F.col("s").alias("second"), "in_flight")


def client_fairness(attempts: DataFrame, stage: str = "redact") -> DataFrame:
    done = F.col("started_at") + F.col("submit_s") + F.col("queue_s") + F.col("work_s") + F.col("collect_s")
    return attempts.where((F.col("stage") == stage) & F.col("error").isNull()).groupBy("client").agg(F.min(done).alias("first_done"), F.max(done).alias("last_done"), F.count("*").alias("n"))


def entity_cube(counts: DataFrame) -> DataFrame:
    """counts(doc_id, label, lang, source, k) summed over all groupings of label, lang and source: detections ``n`` and documents ``n_docs``.

    grouping_id: a bit for each column that is summed over (label 4, lang 2, source 1), which tells such a null from one in the data.
    """
    names = ["label", "lang", "source"]
    cube = counts.cube(*names).agg(F.grouping_id().alias("grouping_id"), F.sum("k").alias("n"), F.countDistinct("doc_id").alias("n_docs"))
    return cube.select(*names, F.col("grouping_id").cast("long").alias("grouping_id"), "n", "n_docs")
