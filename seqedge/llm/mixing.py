"""Mixing (operator 2): temperature weights over sources, realised as budgeted block permutations; DataFrame functions only.

Source shares p become weights p^a / sum p^a. The exponent a in [0, 1] is the largest change that meets the target: the
bisection narrows it for all candidate exponents of a round in one small aggregate over the per-source table, so the
driver sees a few dozen numbers whatever the number of sources.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqedge.llm.common import WORD, cut, fresh, or_empty, quoted, table

#: Candidate exponents and rounds: 16 ** 8 steps, finer than 1e-9.
FAN, ROUNDS = 16, 8


def source_tokens(docs: DataFrame, source: str, text: str) -> DataFrame:
    """(source, tokens, docs) of every source; a null source is a source of its own."""
    tokens = F.regexp_count(or_empty(quoted(text)), F.lit(WORD)).cast("long")
    return docs.select(quoted(source).cast("string").alias("source"), tokens.alias("tokens")).groupBy("source").agg(
        F.sum("tokens").alias("tokens"), F.count("*").alias("docs"))


def exponent(sizes: DataFrame, entropy: float | None, max_repeat: float | None) -> float:
    """The largest exponent in [0, 1] whose weights reach ``entropy`` (a share of the maximum, log of the sources),
    or the smallest whose sources are repeated at most ``max_repeat`` times when the largest source is read once.
    Where both are given, the repetition limit wins. Entropy falls, and repetition too, as the exponent grows."""
    lo, hi = 0.0, 1.0
    full = sizes.filter("tokens > 0").select((F.col("tokens") / F.sum("tokens").over(Window.partitionBy(F.lit(0)))).alias("p"))
    shares = cut(full, "mix-shares")
    for _ in range(ROUNDS):
        grid = [lo + (hi - lo) * i / FAN for i in range(FAN + 1)]
        tried = shares.select(F.explode(F.array(*[F.lit(x) for x in grid])).alias("a"), "p").withColumn("q", F.pow("p", "a"))
        # entropy of q / z is log z - sum q log q / z; the smallest share is repeated most
        rows = tried.groupBy("a").agg(F.sum("q").alias("z"), F.sum(F.col("q") * F.log("q")).alias("s"), F.count("*").alias("n"),
                                      F.max(F.pow("p", F.col("a") - 1)).alias("most"), F.min(F.pow("p", F.col("a") - 1)).alias("least")).collect()
        if not rows:
            return 1.0
        found = {r["a"]: r for r in rows}
        if max_repeat is not None:
            met = [i for i, x in enumerate(grid) if found[x]["most"] / found[x]["least"] <= max_repeat * (1 + 1e-12)]
            i = min(met) if met else FAN
            lo, hi = (grid[max(0, i - 1)], grid[i])
            if i == 0:
                return grid[0]
        else:
            want = (entropy or 0.0) * math.log(max(2, rows[0]["n"]))
            met = [i for i, x in enumerate(grid) if math.log(found[x]["z"]) - found[x]["s"] / found[x]["z"] >= want - 1e-12]
            i = max(met) if met else 0
            lo, hi = (grid[i], grid[min(FAN, i + 1)])
            if i == FAN:
                return grid[FAN]
    return hi if max_repeat is not None else lo


def weights(sizes: DataFrame, entropy: float | None = None, max_repeat: float | None = 2.0, budget: float | None = None) -> DataFrame:
    """(source, tokens, docs, weight, target, epochs): target tokens of each source, and passes over it.

    ``budget`` is in tokens; without it the budget is the least with which every source is read at least once, so
    that nothing is dropped. A source without tokens has weight 0 and is read once.
    """
    sizes = cut(sizes, "mix-sizes")
    a = exponent(sizes, entropy, max_repeat)
    one = Window.partitionBy(F.lit(0))
    share = F.col("tokens") / F.sum("tokens").over(one)
    raw = sizes.withColumn("raw", F.when(F.col("tokens") > 0, F.pow(share, F.lit(a))).otherwise(0.0))
    w = raw.withColumn("weight", F.when(F.sum("raw").over(one) > 0, F.col("raw") / F.sum("raw").over(one)).otherwise(0.0))
    least = F.max(F.when(F.col("weight") > 0, F.col("tokens") / F.col("weight"))).over(one)
    spend = F.coalesce(least, F.lit(0.0)) if budget is None else F.lit(float(budget))
    w = w.withColumn("target", F.round(F.col("weight") * spend)).withColumn(
        "epochs", F.when(F.col("tokens") > 0, F.col("target") / F.col("tokens")).otherwise(1.0))
    return w.select("source", "tokens", "docs", "weight", F.col("target").cast("long").alias("target"), "epochs")


def mix(docs: DataFrame, source: str = "source", text: str = "text", key: str = "doc_id", entropy: float | None = None,
        max_repeat: float | None = 2.0, budget: float | None = None, block_tokens: int = 200_000, seed: int = 7) -> DataFrame:
    """``docs`` drawn to the target weights, with epoch, block and place of every draw (block order is by a hash).

    Each pass over a source is a permutation of blocks: a row's block and its place in the block are hashes of (seed,
    epoch, row), and a source has as many blocks as its tokens ask for, so a source with a third of all rows is many
    small groups. Whole passes take every row. The last, partial pass takes whole blocks in order while they fit the
    budget, and of the one block that straddles it the rows that fit.

    A null source is a source; null or empty texts have no tokens and come with each whole pass; repeated rows are
    drawn one by one; an empty table gives no rows; clashing names stay as they are.
    """
    sizes = cut(weights(source_tokens(docs, source, text), entropy, max_repeat, budget), "mix-weights")
    row = F.struct(*[quoted(c) for c in docs.columns]).alias("row")
    base = docs.select(row, quoted(source).cast("string").alias("source"), F.regexp_count(or_empty(quoted(text)), F.lit(WORD)).cast("long").alias("n"),
                       F.xxhash64(quoted(key), quoted(text)).alias("h"), F.monotonically_increasing_id().alias("uid"))
    plan = sizes.select(F.col("source").alias("s"), "target", "epochs", F.greatest(F.lit(1), F.ceil(F.col("tokens") / block_tokens)).cast("long").alias("blocks"),
                        F.col("tokens").alias("total"))
    drawn = (base.join(plan, F.col("source").eqNullSafe(F.col("s"))).drop("s")
             .withColumn("epoch", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.col("epochs")).cast("int")))))
             .withColumn("block", F.pmod(F.xxhash64("h", "uid", "epoch", F.lit(seed)), F.col("blocks")))
             .withColumn("place", F.xxhash64("h", "uid", "epoch", F.lit(seed + 1))))
    partial = (F.col("epoch") > F.floor(F.col("epochs"))) & (F.col("total") > 0)
    # What the partial pass may still take, and how its blocks add up: one row per block.
    rest = F.col("target") - F.floor(F.col("epochs")).cast("long") * F.col("total")
    sums = drawn.filter(partial).groupBy("source", "epoch", "block", rest.alias("rest")).agg(F.sum("n").alias("block_n"))
    order = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = cut(sums.withColumn("before", F.coalesce(F.sum("block_n").over(order), F.lit(0))), "mix-blocks")
    whole = drawn.filter(~partial)
    b = sums.select(F.col("source").alias("s"), F.col("block").alias("k"), "rest", "before", "block_n").filter("before < rest")
    took = drawn.filter(partial).join(b, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("k")))
    fits = took.filter("before + block_n <= rest")
    # One block per source straddles its budget; only its rows are put in order.
    inside = Window.partitionBy("source", "block").orderBy("place", "uid").rowsBetween(Window.unboundedPreceding, 0)
    cutting = took.filter("before + block_n > rest").withColumn("upto", F.col("before") + F.sum("n").over(inside)).filter("upto <= rest")
    cols = ["row", "source", "epoch", "block", "place", "n"]
    out = whole.select(cols).unionByName(fits.select(cols)).unionByName(cutting.select(cols))
    names = fresh(docs, "epoch", "block", "place", "n_tokens")
    return out.select(*[F.col("row")[c].alias(c) for c in docs.columns], F.col("epoch").alias(names[0]), F.col("block").alias(names[1]),
                      F.col("place").alias(names[2]), F.col("n").alias(names[3]))


def op2_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flattest mix that repeats no source more than twice as often as the most frequent one is read, which is once."""
    docs = table(spark, sf_dir, "documents")
    return mix(docs).select("doc_id", "source", "epoch", "block", "place", "n_tokens")
