"""Array column expressions for token tensors and class scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def array_sum(arr) -> Column:
    """Sum of an integer array as BIGINT (0 for an empty array). An array of 0 and 1 only, as masks are, is counted; the
    test for other items is NULL where one is NULL."""
    a = _c(arr)
    mask = (F.array_min(a) >= 0) & (F.array_max(a) <= 1) & ~F.array_contains(a, F.lit(2))
    ones = (F.size(a) - F.size(F.array_remove(a, F.lit(1)))).cast("bigint")
    return F.when(mask, ones).otherwise(F.aggregate(a, F.lit(0).cast("bigint"), lambda acc, x: acc + x.cast("bigint")))


def pad_to(arr, n, value) -> Column:
    """cut ``arr`` to ``n`` items or pad it with ``value`` up to ``n``."""
    n = F.lit(n) if isinstance(n, int) else _c(n)
    a = _c(arr)
    filler = F.array_repeat(F.lit(value).cast("int"), F.greatest(n - F.size(a), F.lit(0)))
    return F.slice(F.concat(a, filler), 1, n)


def remove_padding(ids, mask) -> tuple[Column, Column]:
    """keep the first ``sum(mask)`` items of both arrays."""
    n = array_sum(mask).cast("int")
    return F.slice(_c(ids), 1, n), F.slice(_c(mask), 1, n)


def softmax(logits) -> Column:
    """Numerically stable softmax of a numeric array."""
    once = lambda value, body: F.transform(F.array(value), body)[0]  # noqa: E731  (else computed again for every item)
    x = _c(logits).cast("array<double>")
    shifted = once(F.array_max(x), lambda top: F.transform(x, lambda v: F.exp(v - top)))
    return once(shifted, lambda e: once(F.aggregate(e, F.lit(0.0), lambda acc, v: acc + v), lambda total: F.transform(e, lambda v: v / total)))


def positive_probability(logits, index: int = 1) -> Column:
    """Probability of class ``index`` (0-based) from a logits array."""
    return F.element_at(softmax(logits), index + 1)


def class_distribution(y) -> Column:
    """Soft label ``y`` as ``[1 - y, y]``."""
    y = _c(y).cast("double")
    return F.array(F.lit(1.0) - y, y)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, also where ``body`` uses it inside another lambda."""
    return F.transform(F.array(value), body)[0]


def running(sizes: Column, block: int = 256) -> Column:
    """For each item of an int array the sum of all items before it. Sums run inside blocks and over the blocks' totals, so
    that the work does not grow with the square of a long array."""
    kind = "struct<at:int,out:array<int>>"

    def sums(a: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().alias("out")).cast(kind)
        return F.aggregate(a, start, lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")).cast(kind))["out"]

    def over(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda s, x: s + x))
        return F.flatten(F.zip_with(blocks, sums(totals), lambda b, before: F.transform(sums(b), lambda x: x + before)))

    return let(sizes, lambda a: let(F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(a) - 1) / block).cast("int"))),
                                                lambda i: F.slice(a, i * block + 1, block)), over))
