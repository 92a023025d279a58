"""Running sums and folds over arrays whose cost stays near the array's length."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements that one fold goes over; a fold that appends copies what it has.
BLOCK = 64


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once: within a lambda an expression would be computed for every element."""
    return F.transform(F.array(value), body)[0]


def blocks(items: Column, size: int = BLOCK) -> Column:
    """items in arrays of at most size elements."""
    last = F.floor((F.size(items) - 1) / size).cast("int")
    return F.when(F.size(items) > 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda k: F.slice(items, k * size + 1, F.lit(size)))).otherwise(F.array())


def running_sum(values: Column) -> Column:
    """Of an array of longs: what comes before each element, summed."""

    def sums(own: Column, begin: Column) -> Column:
        start = F.struct(begin.alias("at"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(own, start, lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])

    def whole(parts: Column) -> Column:
        totals = F.transform(parts, lambda p: F.aggregate(p, F.lit(0).cast("bigint"), lambda a, x: a + x))
        begins = F.aggregate(totals, F.array(F.lit(0).cast("bigint")), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))
        return bind(F.struct(parts.alias("p"), begins.alias("b")), lambda x: F.flatten(F.transform(x["p"], lambda p, k: sums(p, F.get(x["b"], k)))))

    return F.when(F.size(values) > 0, bind(values, lambda v: bind(blocks(v), whole))).otherwise(F.array().cast("array<bigint>"))


def first_where(items: Column, test: Callable[[Column], Column]) -> Column:
    """The position of the first element for which test holds, null if there is none."""
    return F.array_min(F.transform(items, lambda x, i: F.when(test(x), i)))
