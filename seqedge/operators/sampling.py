"""Keyed de-duplication, exact-size sampling and balanced batches
(W1, W2, W4, R1, R2, P18, A22).

Every random choice is an md5 order key (D4), so a sample is the same on any
partitioning and has an SQL oracle. Exact sizes come from
``ranking.select_first_n``: rows are compared with the last one taken, where
they lie.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqedge.functions.numeric import binarize
from seqedge.operators.ranking import order_key, prefix_rank, range_rank, select_first_n
from seqedge.session import cut


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row with the smallest ``order`` per key (ties broken by the
    remaining columns). Done with ``min_by``, a partial aggregate, so a hot
    key is reduced on the map side instead of in one task."""
    return _keep(df, keys, order, F.min_by)


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row with the greatest ``order`` per key (last one wins)."""
    return _keep(df, keys, order, F.max_by)


def _keep(df, keys, order, pick):
    rest = [c for c in df.columns if c not in keys]
    tie = [c for c in rest if c not in order and not dict(df.dtypes)[c].startswith("map")]
    row = F.struct(*[F.col(c) for c in rest]) if rest else F.lit(1)
    out = df.groupBy(*keys).agg(pick(row, F.struct(*[F.col(c) for c in [*order, *tie]])).alias("_row"))
    return out.select(*keys, *[F.col("_row." + c).alias(c) for c in rest]).select(*df.columns)


def drop_duplicate_pairs(df: DataFrame, keys: Sequence[str] = ("gene", "tf"),
                         order: Sequence[str] | None = None) -> DataFrame:
    """W1 as used on pair datasets: one row per (gene, tf)."""
    return keep_first(df, list(keys), list(order or [c for c in df.columns if c not in keys]))


def split(df: DataFrame, train_prop: float, seed: int = 0, ids: Sequence[str] | None = None,
          by: Sequence[str] | None = None, col: str = "split") -> DataFrame:
    """Exact-size train/dev split; adds ``split`` = 'train' | 'dev'.

    Without ``by`` rows are ranked by ``md5(seed|ids)`` and the first
    ``floor(n * train_prop)`` are 'train'. With ``by`` (e.g. ``['gene']``)
    whole groups are assigned: ``floor(groups * train_prop)`` groups go to
    'train', so no group sits on both sides.
    """
    target = lambda total: F.floor(total * F.lit(float(train_prop)))
    if not by:
        # rows are made once, and read from files to find the cut and to flag them
        keyed = cut(df, "rows").withColumn("_ok", order_key(seed, *(ids or df.columns)))
        flagged = select_first_n(keyed, "_ok", target, ties=list(ids or []), flag_col="_t", stored=True)
        return flagged.withColumn(col, F.when(F.col("_t"), "train").otherwise("dev")).drop("_ok", "_t")
    groups = df.select(*by).distinct().withColumn("_ok", order_key(seed, *by))
    flagged = select_first_n(groups, "_ok", target, ties=list(by), flag_col="_t")
    side = flagged.select(*by, F.when(F.col("_t"), "train").otherwise("dev").alias(col))
    return df.join(side, list(by))


def downsample_negatives(df: DataFrame, rate: float, label: str = "interaction", seed: int = 0,
                         ids: Sequence[str] | None = None) -> DataFrame:
    """R2: keep every positive (label > 0) and exactly ``int(n_neg * rate)``
    negatives (label = 0), chosen by ``md5(seed|ids)``. A rate giving 0 keeps
    no negative."""
    keyed = cut(df, "rows").withColumn("_ok", order_key(seed, *(ids or df.columns)))
    keyed = keyed.withColumn("_neg", (F.col(label) == 0).cast("int"))
    target = lambda total: F.floor(total * F.lit(float(rate)))
    neg = select_first_n(keyed.filter(F.col("_neg") == 1), "_ok", target, ties=list(ids or []),
                         flag_col="_keep", stored=True).filter("_keep").drop("_keep")
    pos = keyed.filter(F.col(label) > 0)
    return pos.unionByName(neg).drop("_ok", "_neg")


def class_counts(df: DataFrame, label: str = "interaction") -> DataFrame:
    """Rows per class."""
    return df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def cap(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """The first ``n`` rows in ``order`` (top-k; the limit is the feature)."""
    return df.orderBy(*order).limit(n)


def even_class_batches(df: DataFrame, batch_size: int, drop_last: bool, label: str = "label",
                       id_col: str = "id", seed: int = 0, order: str | None = None,
                       threshold: float = 0.5) -> DataFrame:
    """Balanced batches. A label from ``threshold`` on is positive. Each
    class is shuffled (md5 order, or the order of the column ``order``); the smaller class is cycled; the i-th item of the larger
    class is paired with item ``i mod m`` of the smaller; pairs are cut into
    batches of ``batch_size / 2``; in a batch the smaller class comes first in
    each pair (positives when equal). ``drop_last`` drops a short last batch.

    Returns ``batch, slot, <id_col>, <label>``. Each row of the
    smaller class is matched by at most ``ceil(M / m)`` rows, so a shuffle join is even; AQE broadcasts a
    side that it measures as small.
    """
    if batch_size % 2 != 0:
        raise ValueError(f"even_class_batches needs an even batch size, got {batch_size}")
    half = batch_size // 2
    key = F.col(order) if order else order_key(seed, F.col(id_col))
    base = df.select(F.col(id_col).alias("_id"), binarize(label, threshold).alias("_y"), key.alias("_ok"))
    counts = {r["_y"]: r["n"] for r in base.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    p, n = counts.get(1, 0), counts.get(0, 0)
    small_y = 0 if n < p else 1  # positives are the cycled side when sizes tie
    m, big = (n, p) if small_y == 0 else (p, n)
    if m == 0:
        return df.sparkSession.createDataFrame([], f"batch bigint, slot int, {id_col} string, {label} int")
    if order:
        ranked = range_rank(base, "_ok", by=["_y"], ties=["_id"], rank_col="_r")
    else:
        ranked = prefix_rank(base, "_ok", by=["_y"], ties=["_id"], rank_col="_r", small_groups=True)  # two classes
    small = ranked.filter(F.col("_y") == small_y).select(
        (F.col("_r") - 1).alias("_j"), F.col("_id").alias("_sid"))
    large = ranked.filter(F.col("_y") != small_y).select(
        (F.col("_r") - 1).alias("_i"), F.col("_id").alias("_lid"))
    n_pairs = (big // half) * half if drop_last else big
    large = large.filter(F.col("_i") < n_pairs).withColumn("_j", F.pmod(F.col("_i"), F.lit(m)))
    pairs = large.join(small, "_j")
    slot0 = (F.col("_i") % half) * 2
    out = pairs.select(
        F.floor(F.col("_i") / half).cast("bigint").alias("batch"),
        F.explode(F.array(
            F.struct(slot0.cast("int").alias("slot"), F.col("_sid").alias(id_col), F.lit(small_y).alias(label)),
            F.struct((slot0 + 1).cast("int").alias("slot"), F.col("_lid").alias(id_col),
                     F.lit(1 - small_y).alias(label)))).alias("_e"))
    return out.select("batch", "_e.slot", F.col("_e." + id_col).cast("string").alias(id_col),
                      F.col("_e." + label).cast("int").alias(label))


def even_class_batch_count(n_pos: int, n_neg: int, batch_size: int, drop_last: bool) -> int:
    """Number of batches W4 yields: floor or ceil of ``2 max(p, n) / batch_size``."""
    total = 2 * max(n_pos, n_neg)
    return total // batch_size if drop_last else -(-total // batch_size)
