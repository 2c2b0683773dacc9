"""Folds over arrays, as expressions of the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Items that are folded together; a fold copies its array at each step.
BLOCK = 64
Pair = Callable[[Column, Column], Column]


def gathered(items: Column, kind: str, alike: Pair, united: Pair) -> Column:
    """Items in order, each united with the first gathered one that is like it, or else gathered itself.

    kind: the array's type; a null array gives an empty one.
    """

    def step(so_far: Column, item: Column) -> Column:
        at = F.array_position(F.transform(so_far, lambda g: alike(g, item)), F.lit(True))
        other = F.transform(so_far, lambda g, i: F.when(i + 1 == at, united(g, item)).otherwise(g))
        return F.when(at > 0, other).otherwise(F.concat(so_far, F.array(item))).cast(kind)

    return F.aggregate(F.coalesce(items.cast(kind), F.array().cast(kind)), F.array().cast(kind), step)


def gathered_fully(items: Column, kind: str, alike: Pair, united: Pair) -> Column:
    """gathered() over again until nothing changes: each pass that changes anything leaves fewer items, so as many passes as items do."""
    passes = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(F.coalesce(items, F.array().cast(kind)))))
    return F.aggregate(passes, F.coalesce(items.cast(kind), F.array().cast(kind)), lambda now, _: gathered(now, kind, alike, united))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def scan(items: Column, kind: str, start: Column, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """What step puts out for all items in order: step(state, item) gives the next state and an array of type ``kind``.

    The array grows block by block, so that the work grows with its length, not its square. start has the state's
    type. A null array gives null.
    """
    empty = F.array().cast(kind)

    def fold(at: Column, block: Column) -> Column:
        def one(acc: Column, item: Column) -> Column:
            now, more = step(acc["at"], item)
            return F.struct(now.alias("at"), F.concat(acc["out"], more).cast(kind).alias("out"))

        return F.aggregate(block, F.struct(at.alias("at"), empty.alias("out")), one)

    def whole(xs: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / BLOCK).cast("int")), lambda b: F.slice(xs, b * BLOCK + 1, BLOCK))
        parts = F.aggregate(blocks, F.array(F.struct(start.alias("at"), empty.alias("out"))), lambda acc, b: F.concat(acc, F.array(fold(F.element_at(acc, -1)["at"], b))))
        return F.when(F.size(xs) > 0, F.flatten(F.transform(parts, lambda p: p["out"]))).when(xs.isNotNull(), empty)

    return let(items, whole)


def running_sums(numbers: Column) -> Column:
    """For each number (bigint) the sum of those before it."""
    return scan(numbers.cast("array<bigint>"), "array<bigint>", F.lit(0).cast("bigint"), lambda at, x: (at + x, F.array(at)))
