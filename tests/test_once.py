"""Results that are given out once, with repeated tasks, several takers and odd rows."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

from spanveil.sources import once


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_each_commit_has_one_taker(spark, tmp_path):
    folder = f"file://{tmp_path}/results"
    odd = [(1, "a", [1.5, None]), (1, "a", [1.5, None]), (None, None, None), (2, "", []), (3, "x" * 100_000, [0.0])]
    df = spark.createDataFrame(odd, "task long, result string, more array<double>")
    once.put(df, folder)
    once.put(df.where("task = 1"), folder)
    first = once.take(spark, folder, "first")
    once.put(df.where("task = 2"), folder)
    assert rows(first) == sorted(map(tuple, odd + odd[:2]), key=str) == rows(first)
    assert rows(once.take(spark, folder, "first")) == rows(first)
    assert rows(once.take(spark, folder, "second")) == [(2, "", [])]
    assert once.take(spark, folder, "third", df.schema).count() == 0
    once.forget(folder, "first")
    assert rows(once.take(spark, folder, "first", df.schema)) == [] and rows(once.take(spark, folder, "second")) == [(2, "", [])]
    assert len(os.listdir(f"{tmp_path}/results/parts")) == 1


def test_a_take_that_stopped_goes_on(spark, tmp_path):
    folder = str(tmp_path)
    df = spark.range(5)
    once.put(df.where("id < 3"), folder)
    once.claim(folder, "a")
    os.remove(tmp_path / "taken/a/_whole")
    once.put(df.where("id >= 3"), folder)
    assert rows(once.take(spark, folder, "a")) == [(i,) for i in range(5)]


def test_refusals(spark, tmp_path):
    folder = str(tmp_path / "x")
    once.put(spark.range(0), folder)
    assert once.take(spark, folder, "a").count() == 0
    with pytest.raises(ValueError):
        once.take(spark, folder, "../b")
    with pytest.raises(Exception, match="append"):
        spark.range(1).write.format(once.FORMAT).mode("overwrite").save(folder)
    with pytest.raises(Exception, match="nothing is ready"):
        once.take(spark, folder, "c")
    once.put(spark.range(1), folder)
    with pytest.raises(Exception, match="other columns"):
        once.take(spark, folder, "d", "name string").collect()


REPEATED = """
import sys
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import SparkSession
from spanveil.sources import once

spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").config("spark.sql.execution.arrow.maxRecordsPerBatch", "1000").getOrCreate()


def breaks(batches):
    for k, b in enumerate(batches):
        if k == 90 and TaskContext.get().attemptNumber() == 0:
            raise RuntimeError("lost")
        yield b


folder = sys.argv[1]
once.put(spark.range(0, 400_000, 1, 4).mapInArrow(breaks, "id long"), folder)
taken = once.take(spark, folder, "a").mapInArrow(breaks, "id long")
assert sorted(r.id for r in taken.collect()) == list(range(400_000))
assert once.take(spark, folder, "b", "id long").count() == 0
print("whole")
"""


def test_repeated_tasks(tmp_path):
    """Each task's first attempt is lost after rows were written, and after rows were read."""
    done = subprocess.run([sys.executable, "-c", REPEATED, str(tmp_path)], cwd=Path(__file__).resolve().parents[1], capture_output=True, text=True, timeout=200)
    assert done.stdout.strip().endswith("whole"), done.stderr[-3000:]
    assert len(list(tmp_path.glob("parts/*/*.parquet"))) > 4
