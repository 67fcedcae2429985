"""Lists per key in bounded parts.

A list of all values of a key is one row, one aggregate buffer and one task, and
a hot key's list has no bound. Here a list is a set of rows ``(key, part,
items)`` of at most ``size`` items: every value gets its place within its key by
ranges of sampled quantiles (``ranking.range_rank``), so a key with a third
of all values is spread over ranges, and ``(key, part)`` is what is grouped. Readers take parts as
they are; the one-row form is for sinks, and raises beyond a stated length.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqedge.operators.ranking import range_rank
from seqedge.session import dealt, sized

PART_SIZE = 10_000
MAX_ITEMS = 1_000_000


def parts(df: DataFrame, keys: Sequence[str], value: str, order: str | None = None, distinct: bool = False,
          size: int = PART_SIZE, out: str = "items") -> DataFrame:
    """``(keys, part, items)``: the values of each key in the order of
    ``order`` (then of the value itself), ``size`` to a part, parts from 0.
    ``distinct`` drops repeats. NULL values are left out; a NULL key is a key."""
    return sized_parts(df, keys, value, order, distinct, size, out)[0]


def sized_parts(df: DataFrame, keys: Sequence[str], value: str, order: str | None = None, distinct: bool = False,
                size: int = PART_SIZE, out: str = "items") -> tuple[DataFrame, int]:
    """``parts``, and the tasks that its values were dealt to (they grow with the values' bytes)."""
    cols = list(dict.fromkeys([*keys, *([order] if order else []), value]))
    d = df.select(*cols).filter(F.col(value).isNotNull())
    d = d.distinct() if distinct else d
    d, tasks = sized(d, "listed")
    by = order or value
    ranked = range_rank(d, by, by=keys, ties=[value] if order else [], rank_col="_r", ranges=tasks, collapse_copies=not distinct, stored=True)
    placed = ranked.select(*keys, F.floor((F.col("_r") - 1) / size).cast("bigint").alias("part"), F.struct("_r", F.col(value).alias("v")).alias("_i"))
    grouped = dealt(placed, tasks, *keys, "part").groupBy(*keys, "part")
    return grouped.agg(F.transform(F.array_sort(F.collect_list("_i")), lambda x: x["v"]).alias(out)), tasks


def items(listed: DataFrame, value: str, out: str = "items") -> DataFrame:
    """The values of ``parts`` as rows again, with their ``part``."""
    return listed.withColumn(value, F.explode(out)).drop(out)


def one_row(listed: DataFrame, keys: Sequence[str], out: str = "items", max_items: int = MAX_ITEMS, size: int = PART_SIZE,
            tasks: int | None = None) -> DataFrame:
    """The sink's form: one row per key with the whole list. A key of more
    than ``max_items`` is an error, raised from its part numbers before any
    list is put together. ``tasks``: as ``sized_parts`` gives them."""
    beyond = F.col("part") * size + F.size(out) > max_items
    error = F.raise_error(F.concat(F.lit(f"a list of more than {max_items} items: read its parts; key "), F.to_json(F.struct(*keys))))
    checked = listed.withColumn("part", F.when(beyond, error.cast("bigint")).otherwise(F.col("part")))
    whole = F.array_sort(F.collect_list(F.struct("part", F.col(out).alias("i"))))
    return dealt(checked, tasks, *keys).groupBy(*keys).agg(F.flatten(F.transform(whole, lambda x: x["i"])).alias(out))


def text_parts(df: DataFrame, key: str, value: str, order: str, sep: str = ", ", size: int = PART_SIZE) -> DataFrame:
    """A24 in parts: ``(key, part, <value>)``, each part the text of ``size``
    values; parts joined by ``sep`` in order are the whole text."""
    return parts(df, [key], value, order=order, size=size, out="_v").select(key, "part", F.array_join("_v", sep).alias(value))
