"""Deterministic ranks, exact-size selection and running totals.

None of these uses a window without ``partitionBy`` over raw rows. Rows with
an md5 order key or a score are placed in buckets that are a function of it
(a hex-prefix, or a linear slice of the range); rows with raw keys in ranges
by sampled quantiles. The counts per bucket or range are a table bounded by
their number, the only one ordered globally. Rows are then numbered inside
their bucket, in parallel.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqedge.session import cut, dealt, sized, tasks_for

_B = "_se_bucket"
_S = "_se_slice"


def order_key(seed, *cols) -> Column:
    """Reproducible random order key ``md5('seed|c1|c2...')``.

    The same text can be written in DuckDB: ``md5(concat_ws('|', seed, ...))``.
    Callers pass columns that identify a row (or a group) uniquely.
    """
    parts = [F.lit(str(seed))] + [(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols]
    return F.md5(F.concat_ws("|", *parts))


def _attach(d: DataFrame, counts: DataFrame, by: Sequence[str], small_groups: bool) -> DataFrame:
    # counts has at most 16**digits rows per group. Without groups, or with as
    # few as the caller vouches for, that is a bound and the table is
    # broadcast; otherwise it is joined like any other table.
    side = F.broadcast(counts) if small_groups or not by else counts
    return d.join(side, [*by, _B])


_COPIES = "_se_copies"
_POS = "_se_pos"
# Copies are regenerated in three levels of at most 2**16 items each, so no
# generated array is larger than 65,536 entries (up to 2**48 copies).
_L1, _L2 = 1 << 32, 1 << 16


def _orderable(df: DataFrame, exclude: Sequence[str]) -> list[str]:
    return [c for c, t in df.dtypes if c not in exclude and not t.startswith("map")]


def _with_copies(df: DataFrame) -> DataFrame:
    """Distinct rows with their number of copies. A partial aggregate, so a
    group of identical rows (even a third of the input) is counted map-side
    and never lands in one task as rows."""
    return df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias(_COPIES))


def _regenerate(df: DataFrame) -> DataFrame:
    """One row per copy again, with ``_se_pos`` = 0-based copy number."""
    c = F.col(_COPIES).cast("bigint")
    lvl1 = df.withColumn("_se_k1", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((c - 1) / _L1))))
    lvl1 = lvl1.withColumn("_se_n1", F.least(F.lit(_L1), c - F.col("_se_k1") * _L1))
    lvl2 = lvl1.withColumn("_se_k2", F.explode(F.sequence(F.lit(0).cast("bigint"),
                                                          F.floor((F.col("_se_n1") - 1) / _L2))))
    lvl2 = lvl2.withColumn("_se_n2", F.least(F.lit(_L2), F.col("_se_n1") - F.col("_se_k2") * _L2))
    lvl3 = lvl2.select("*", F.posexplode(F.array_repeat(F.lit(0), F.col("_se_n2").cast("int")))
                       .alias("_se_k3", "_se_z"))
    pos = F.col("_se_k1") * _L1 + F.col("_se_k2") * _L2 + F.col("_se_k3")
    return lvl3.withColumn(_POS, pos).drop("_se_k1", "_se_n1", "_se_k2", "_se_n2", "_se_k3", "_se_z")


def prefix_rank(df: DataFrame, key: str, by: Sequence[str] = (), ties: Sequence[str] = (),
                rank_col: str = "rank", digits: int = 4, small_groups: bool = False,
                collapse_copies: bool = True) -> DataFrame:
    """W6 for order keys: 1-based row number of each row ordered by the string
    ``key`` (then ``ties``, then the remaining columns), restarting for each
    ``by`` group. The key's first ``digits`` characters must spread evenly, as
    those of ``order_key`` do; raw ids go to ``range_rank``. ``small_groups``
    vouches for few ``by`` groups (classes).

    Equal to ``row_number() over (partition by by order by key, ties, ...)``
    but computed as bucket offset + running count inside the bucket. Identical
    rows are first collapsed to one row with a copy count (so a hot group of
    copies costs one row in the windows) and regenerated at the end with
    consecutive ranks. Callers whose rows are distinct already (a table of
    distinct keys) pass ``collapse_copies=False`` and save that aggregation.
    """
    cols = df.columns
    base = _with_copies(df) if collapse_copies else df.withColumn(_COPIES, F.lit(1).cast("bigint"))
    m = base.withColumn(_B, F.substring(F.col(key), 1, digits))
    counts = m.groupBy(*by, _B).agg(F.sum(_COPIES).alias("_se_n"))
    w_before = Window.partitionBy(*by).orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*by, _B, F.coalesce(F.sum("_se_n").over(w_before), F.lit(0)).cast("bigint")
                           .alias("_se_before"))
    joined = _attach(m, counts, by, small_groups)
    order = [F.col(key), *[F.col(t) for t in ties],
             *[F.col(c) for c in _orderable(df, [key, *by, *ties])]]
    w = Window.partitionBy(*by, _B).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("_se_before") + F.coalesce(F.sum(_COPIES).over(w), F.lit(0))
    joined = joined.withColumn("_se_start", start)
    if not collapse_copies:
        return joined.select(*cols, (F.col("_se_start") + 1).cast("bigint").alias(rank_col))
    ranked = _regenerate(joined)
    return ranked.select(*cols, (F.col("_se_start") + F.col(_POS) + 1).cast("bigint").alias(rank_col))


_AT = "_se_at"
_NO = "_se_no"


def range_rank(df: DataFrame, key: str, by: Sequence[str] = (), ties: Sequence[str] = (),
               rank_col: str = "rank", ranges: int | None = None, collapse_copies: bool = True, stored: bool = False) -> DataFrame:
    """W6 / L1 over raw keys of any orderable type: ``row_number() over
    (partition by by order by key, ties, the other columns)``.

    The rows are written first (unless ``df`` is ``stored``, in files) and cut into ``ranges`` by sampled
    quantiles of the whole order, so neither a common prefix, nor a hot key or
    group, nor clustered values make one range larger than the others; identical rows are told apart by
    their number in the files, so they spread over ranges too (callers whose rows are distinct pass
    ``collapse_copies=False``). By default the ranges grow with the bytes of the rows (``tasks_for``), so that no task sorts
    more than a fixed share. Each range is
    sorted in its task and written with its places, the counts of all ranges
    (one row for each range and group) give the offsets.
    """
    cols = df.columns
    base, n = (df, ranges or tasks_for(df)) if stored else sized(df, "unranked")
    order = [*by, key, *ties, *_orderable(df, [key, *by, *ties])]
    if collapse_copies:  # always the same number, as the rows come from files
        base, order = base.withColumn(_NO, F.monotonically_increasing_id()), [*order, _NO]
    sorted_ranges = base.repartitionByRange(ranges or n, *order).sortWithinPartitions(*order).select(*cols)
    # the id holds the range in its upper bits and the place in its lower 33
    place = F.monotonically_increasing_id()
    placed = cut(sorted_ranges.withColumn(_AT, place).withColumn(_B, F.shiftright(_AT, 33)), "ranges")
    counts = placed.groupBy(*by, _B).agg(F.count(F.lit(1)).alias("_se_n"), F.min(_AT).alias("_se_first"))
    earlier = Window.partitionBy(*by).orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    group = F.struct(*by)  # a struct is equal to another also where both have a NULL
    counts = counts.select(*([group.alias("_se_group")] if by else []), F.col(_B).alias("_se_range"), "_se_first",
                           F.coalesce(F.sum("_se_n").over(earlier), F.lit(0)).cast("bigint").alias("_se_before"))
    on = F.col(_B) == F.col("_se_range")
    if by:  # written, so that the rows are shuffled for this join only if their groups are many
        counts = dealt(cut(counts, "range-counts"), n, "_se_range", "_se_group")
        on = on & (group == F.col("_se_group"))
    joined = placed.join(F.broadcast(counts) if not by else counts, on)  # without groups: a row a range
    return joined.select(*cols, (F.col("_se_before") + F.col(_AT) - F.col("_se_first") + 1).cast("bigint").alias(rank_col))


def range_running_sum(df: DataFrame, key: str, weight: str, ties: Sequence[str] = (), out: str = "before",
                      ranges: int | None = None) -> DataFrame:
    """W5 over raw keys: ``out`` is the sum of the integer ``weight`` over all
    rows before each one in the order of ``key``, ``ties``, the other columns.
    Ranges by sampled quantiles, as in ``range_rank``."""
    order = [key, *ties, *_orderable(df, [key, *ties])]
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn(_AT, F.monotonically_increasing_id())
    placed = cut(placed.withColumn(_B, F.shiftright(_AT, 33)), "ranges")
    earlier = Window.orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy(_B).agg(F.sum(weight).alias("_se_n")).select(_B, F.coalesce(F.sum("_se_n").over(earlier), F.lit(0)).alias("_se_before"))
    inside = Window.partitionBy(_B).orderBy(_AT).rowsBetween(Window.unboundedPreceding, -1)
    sums = (F.col("_se_before") + F.coalesce(F.sum(weight).over(inside), F.lit(0))).cast("bigint")
    return placed.join(F.broadcast(totals), _B).select(*df.columns, sums.alias(out))  # a row a range


def cut_points(df: DataFrame, key: str, target: Callable[[Column], Column], by: Sequence[str] = (),
               ties: Sequence[str] = (), digits: int = 4, stored: bool = False) -> DataFrame:
    """Where each ``by`` group is cut when its first ``target(group_total)``
    rows in the order of the order key ``key`` and ``ties`` are taken: a row
    ``(by, last, take, copies)`` for each group that takes any. ``last`` is the
    struct (key, ties) of the last row taken; of the ``copies`` rows that are
    equal to it, ``take`` are taken.

    Reads only these columns of ``df``, which are written first (unless
    ``df`` is ``stored``, in files): counts per key prefix find the one bucket per group that the cut falls into, and only
    that bucket is ordered.
    """
    keys = df.select(*by, key, *ties)
    keys = keys if stored else cut(keys, "order-keys")
    keyed = keys.withColumn(_B, F.substring(F.col(key), 1, digits))
    counts = keyed.groupBy(*by, _B).agg(F.count(F.lit(1)).alias("_se_n"))
    group = Window.partitionBy(*by)
    upto = group.orderBy(_B).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = (counts.withColumn("_se_upto", F.sum("_se_n").over(upto)).withColumn("_se_total", F.sum("_se_n").over(group))
              .withColumn("_se_cut", F.least(target(F.col("_se_total")).cast("bigint"), F.col("_se_total"))))
    edge = counts.filter((F.col("_se_upto") >= F.col("_se_cut")) & (F.col("_se_upto") - F.col("_se_n") < F.col("_se_cut")))
    edge = edge.select(*[F.col(c).alias(f"_se_by{i}") for i, c in enumerate(by)], F.col(_B).alias("_se_bucket2"),
                       (F.col("_se_cut") - F.col("_se_upto") + F.col("_se_n")).alias("_se_take"))
    on = F.col(_B) == F.col("_se_bucket2")
    for i, c in enumerate(by):
        on = on & F.col(c).eqNullSafe(F.col(f"_se_by{i}"))
    near = keyed.join(F.broadcast(edge) if not by else edge, on)  # without groups: one row
    tied = near.groupBy(*by, "_se_take", F.struct(key, *ties).alias("last")).agg(F.count(F.lit(1)).alias("copies"))
    before = Window.partitionBy(*by).orderBy("last").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tied = tied.withColumn("_se_upto", F.sum("copies").over(before))
    found = tied.filter((F.col("_se_upto") >= F.col("_se_take")) & (F.col("_se_upto") - F.col("copies") < F.col("_se_take")))
    return cut(found.select(*by, "last", (F.col("_se_take") - F.col("_se_upto") + F.col("copies")).alias("take"), "copies"), "cut-points")


def _literal(row) -> Column:
    return F.struct(*[F.lit(v).alias(k) for k, v in row.asDict().items()])


def first_n(key: str, ties: Sequence[str], last) -> Column:
    """Whether a row comes no later than ``last`` (a row of ``cut_points``; None takes nothing), without a join."""
    return F.lit(False) if last is None else F.struct(key, *ties) <= _literal(last["last"])


def select_first_n(df: DataFrame, key: str, target: Callable[[Column], Column],
                   by: Sequence[str] = (), ties: Sequence[str] = (), flag_col: str = "selected",
                   digits: int = 4, stored: bool = False) -> DataFrame:
    """Flag the first ``target(group_total)`` rows of each ``by`` group in
    ``key`` order (exact size, reproducible).

    ``cut_points`` finds the last row of each group from the order columns
    alone, in files; then every row of ``df`` is compared with it where it
    lies, so rows are neither sorted nor shuffled (with ``by``, the table of
    groups is joined, by broadcast where its files are small), and nothing
    stays cached. Only where rows share key and ties with the last one, and
    not all of them are taken, these rows are ordered by their other columns.
    Null keys are not supported (an order key is never null).
    """
    cols = df.columns
    limits = cut_points(df, key, target, by, ties, digits, stored)
    here = F.struct(key, *ties)
    if by:
        names = [f"_se_by{i}" for i in range(len(by))]
        side = limits.select(*[F.col(c).alias(x) for c, x in zip(by, names)], "last", "take", "copies").withColumnsRenamed(
            {"last": "_se_last", "take": "_se_take", "copies": "_se_eq"})
        on = F.lit(True)
        for c, x in zip(by, names):
            on = on & F.col(c).eqNullSafe(F.col(x))
        d, last, take, equal = df.join(side, on, "left"), F.col("_se_last"), F.col("_se_take"), F.col("_se_eq")
        split = F.coalesce(take < equal, F.lit(False))
        any_split = bool(limits.filter("take < copies").take(1))
    else:
        found = limits.first()
        if found is None:
            return df.withColumn(flag_col, F.lit(False))
        d, last, take = df, _literal(found["last"]), F.lit(found["take"])
        any_split = found["take"] < found["copies"]
        split = F.lit(any_split)
    if not any_split:
        return d.select(*cols, F.coalesce(here <= last, F.lit(False)).alias(flag_col))
    torn = split & (here == last)
    decided = d.filter(~F.coalesce(torn, F.lit(False))).select(*cols, F.coalesce(here <= last, F.lit(False)).alias(flag_col))
    m = _with_copies(d.filter(torn).select(*cols, take.alias("_se_cut")))
    rest = [F.col(c) for c in _orderable(df, [key, *by, *ties])] or [F.lit(0)]
    w = Window.partitionBy(*by, key, *ties).orderBy(*rest).rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("_se_cut") - F.coalesce(F.sum(_COPIES).over(w), F.lit(0))
    edge = _regenerate(m.withColumn("_se_left", F.least(F.greatest(left, F.lit(0)), F.col(_COPIES))))
    return decided.unionByName(edge.select(*cols, (F.col(_POS) < F.col("_se_left")).alias(flag_col)))


def batch_no(rank, batch_size: int) -> Column:
    """0-based fixed-size batch number of a 1-based rank."""
    r = F.col(rank) if isinstance(rank, str) else rank
    return F.floor((r - F.lit(1)) / F.lit(batch_size)).cast("bigint")


def tie_groups(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row per distinct score with its positive and negative counts.

    Map-side partial aggregation collapses repeated scores before the shuffle,
    so a score held by a third of the rows costs one row per task.
    """
    y = F.col(label).cast("bigint")
    return (df.filter(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")) & F.col(label).isNotNull())
            .groupBy(F.col(score).alias("score"))
            .agg(F.sum(y).alias("pos"), F.sum(F.lit(1) - y).alias("neg")))


def running_totals(groups: DataFrame, score: str, sums: Sequence[str], descending: bool = True,
                   n_buckets: int = 4096, suffix: str = "_cum", bounds: tuple | None = None) -> DataFrame:
    """Inclusive running sums of ``sums`` along ``score`` order.

    ``groups`` must have one row per distinct score (see ``tie_groups``).
    Buckets are equal slices of [min, max]; their totals (at most
    ``n_buckets`` rows) give each bucket's offset, and a window partitioned by
    bucket adds the part inside the bucket.
    """
    order = F.col(score).desc() if descending else F.col(score).asc()
    if bounds is None:
        stats = groups.agg(F.min(score).alias("lo"), F.max(score).alias("hi")).first()
        bounds = (stats["lo"], stats["hi"])
    lo, hi = bounds
    if lo is None:
        return groups.select("*", *[F.lit(0).cast("bigint").alias(c + suffix) for c in sums])
    span = float(hi) - float(lo)
    s = F.col(score).cast("double")
    if span <= 0.0:
        bucket = F.lit(0)
    else:
        rel = (F.lit(float(hi)) - s) / F.lit(span) if descending else (s - F.lit(float(lo))) / F.lit(span)
        bucket = F.least(F.greatest(F.floor(rel * F.lit(n_buckets)), F.lit(0)), F.lit(n_buckets - 1))
    g = groups.withColumn(_B, bucket.cast("int"))
    # Second level: a bucket holding more than 1/64 of the distinct scores is sliced again over its own
    # range, so clustered scores do not end up in one window partition. At
    # most 64 buckets can be heavy: the (bucket, slice) table stays bounded
    # by 65 * n_buckets rows.
    st1 = g.groupBy(_B).agg(F.count(F.lit(1)).alias("_n1"), F.min(score).alias("_lo1"),
                            F.max(score).alias("_hi1"))
    st1 = st1.withColumn("_heavy", (F.col("_n1") > F.sum("_n1").over(Window.partitionBy()) / 64)
                         & (F.col("_hi1") > F.col("_lo1")))
    lo1, hi1 = F.col("_lo1").cast("double"), F.col("_hi1").cast("double")
    rel2 = (hi1 - s) / (hi1 - lo1) if descending else (s - lo1) / (hi1 - lo1)
    sub = F.when(F.col("_heavy"), F.least(F.greatest(F.floor(rel2 * F.lit(n_buckets)), F.lit(0)),
                                          F.lit(n_buckets - 1))).otherwise(F.lit(0))
    g = (g.join(F.broadcast(st1.select(_B, "_heavy", "_lo1", "_hi1")), _B)
         .withColumn(_S, sub.cast("int")).drop("_heavy", "_lo1", "_hi1"))
    totals = g.groupBy(_B, _S).agg(*[F.sum(c).alias("_t_" + c) for c in sums])
    # At most 65 * n_buckets rows: a bounded table, ordered once and broadcast.
    w_all = Window.orderBy(_B, _S).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(_B, _S, *[F.coalesce(F.sum("_t_" + c).over(w_all), F.lit(0)).alias("_o_" + c)
                                      for c in sums])
    w_in = Window.partitionBy(_B, _S).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = g.join(F.broadcast(offsets), [_B, _S])
    for c in sums:
        out = out.withColumn(c + suffix, (F.col("_o_" + c) + F.sum(c).over(w_in)).cast("bigint"))
    return out.drop(_B, _S, *["_o_" + c for c in sums])


def global_rank(df: DataFrame, key: str, by: Sequence[str] = (), ties: Sequence[str] = (),
                rank_col: str = "rank") -> DataFrame:
    """W6 under its planned name: see ``range_rank``."""
    return range_rank(df, key, by=by, ties=ties, rank_col=rank_col)
