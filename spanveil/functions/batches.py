"""Python functions over Arrow batches, a part of a batch at a time.

A batch has 10,000 rows by default, and rows may be long. Its rows become Python values in parts of few bytes, so a
worker holds the batch, its result and one part.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Bytes of a part; a longer row is a part of its own.
AT_ONCE = 1 << 19


def parts(columns: list[pa.Array]) -> Iterator[list[pa.Array]]:
    """The columns' rows in order, in halves of halves that have AT_ONCE bytes at most, or one row."""
    n = len(columns[0])
    if n > 1 and sum(c.nbytes for c in columns) > AT_ONCE:
        for at, size in ((0, n // 2), (n // 2, n - n // 2)):
            yield from parts([c.slice(at, size) for c in columns])
    else:
        yield columns


def give_back() -> None:
    """Return free memory of this process to the system: a Python worker stays, and would keep what its batch once took."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of glibc
        trim(0)


def arrow_type(kind: str) -> pa.DataType:
    return to_arrow_schema(StructType.fromDDL(f"v {kind}")).field(0).type


def by_parts(fn: Callable[..., list], kind: str):
    """An Arrow function, made on the driver when it is called for: fn takes a list of values for each column, and gives one.

    Calling it non-deterministic keeps the optimizer from copying it into lambdas.
    """
    arrow = arrow_type(kind)

    def run(*columns: pa.Array) -> pa.Array:
        made = [pa.array(fn(*(c.to_pylist() for c in p)), arrow) for p in parts(list(columns))]
        give_back()
        return pa.concat_arrays(made)

    return F.arrow_udf(run, kind).asNondeterministic()
