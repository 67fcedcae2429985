"""Sharding (operator 8): extendible hashing. A directory indexed by the leading bits of a row's hash; only buckets
over the byte limit split on another bit, until every shard fits.

The directory is a small table of (bucket, depth) that Spark builds from one histogram of hash prefixes: the histogram
is as fine as the total size asks for, and only prefixes that are still too large are read again, ``step`` bits finer.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqedge.llm.common import cut, fresh, quoted, table

#: Bits of a row's hash: 64 from its key and text, then 62 from its place, which part repeated rows.
KEY_BITS, BITS = 64, 126
SHARD_BYTES = 32_000_000


def hash_bits(docs: DataFrame, key: str, text: str) -> tuple[Column, Column]:
    """The two halves of a row's hash. Equal rows are interchangeable, so their places may part them."""
    return F.xxhash64(quoted(key), quoted(text)), F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 2)


def prefix(depth: Column | int) -> Column:
    """The first ``depth`` bits of (h1, h2) as a string of 0 and 1."""
    bits = F.concat(F.lpad(F.bin("h1"), 64, "0"), F.lpad(F.bin("h2"), BITS - KEY_BITS, "0"))
    return F.substring(bits, F.lit(1), depth if isinstance(depth, Column) else F.lit(depth))


def row_bytes(docs: DataFrame) -> Column:
    """What a row weighs: 8 bytes, the bytes of its strings and binaries, the JSON text of its nested columns, and 8 for any other column."""

    def one(field: T.StructField) -> Column:
        c = quoted(field.name)
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            return F.coalesce(F.octet_length(c), F.lit(0))
        if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            return F.coalesce(F.octet_length(F.to_json(c)), F.lit(0))
        return F.lit(8)

    return functools.reduce(lambda a, b: a + b, [one(f) for f in docs.schema], F.lit(8).cast("long"))


def directory(rows: DataFrame, limit: int, step: int = 6) -> DataFrame:
    """(shard, depth, shard_bytes, shard_rows): the buckets of an extendible hash over ``rows`` (h1, h2, bytes).

    A bucket splits while it holds more than ``limit`` bytes and more than one row: a single row over the limit is a
    shard of its own. Work on the driver is a handful of counters; the tables grow with the number of shards.
    """
    total = rows.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("b")).first()["b"]
    depth = min(BITS, step + max(0, math.ceil(math.log2(max(1, total / limit)))))
    sums = (F.sum("bytes").alias("bytes"), F.sum("n").alias("n"))
    leaves, open_, top = None, None, 0
    while True:
        counted = rows.withColumn("n", F.lit(1).cast("long"))
        if open_ is not None:  # only what is still too large is counted at a finer depth
            counted = counted.withColumn("shard", prefix(top)).join(open_.select("shard"), "shard", "left_semi")
        fine = cut(counted.groupBy(prefix(depth).alias("p")).agg(*sums), "shard-histogram")
        # every prefix length from the last round's depth to this one, of the fine histogram
        nodes = (fine.select(F.explode(F.sequence(F.lit(top), F.lit(depth))).alias("depth"), "p", "bytes", "n")
                 .groupBy("depth", F.substring("p", F.lit(1), F.col("depth")).alias("shard")).agg(*sums))
        nodes = nodes.withColumn("fits", (F.col("bytes") <= limit) | (F.col("n") <= 1) | (F.col("depth") >= BITS))
        # A bucket is a leaf if it fits and its parent does not; the parent is the same prefix one bit shorter.
        parent = nodes.filter(~F.col("fits")).select((F.col("depth") + 1).alias("depth"), F.col("shard").alias("parent"), F.lit(True).alias("split"))
        child = nodes.filter("fits").withColumn("parent", F.expr("substring(shard, 1, depth - 1)"))
        leaf = child.filter(F.col("depth") == top) if open_ is None else None
        inner = child.filter(F.col("depth") > top).join(parent, ["depth", "parent"], "left_semi")
        found = [x.select("shard", "depth", "bytes", "n") for x in (leaf, inner) if x is not None]
        for x in found:
            leaves = x if leaves is None else leaves.unionByName(x)
        open_ = cut(nodes.filter(~F.col("fits") & (F.col("depth") == depth)).select("shard"), "shard-open")
        if not open_.take(1):
            return leaves.select("shard", "depth", F.col("bytes").alias("shard_bytes"), F.col("n").alias("shard_rows"))
        top, depth = depth, min(BITS, depth + step)


def shards(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = SHARD_BYTES) -> DataFrame:
    """``docs`` with shard (hash prefix), shard_depth, shard_bytes and row_bytes; clashing input columns keep their names.

    Null keys and texts hash as nulls; a row weighs all its columns (``row_bytes``), null or empty texts nothing; repeated rows part
    by their place; an empty table gives no rows.
    """
    h1, h2, size, out_shard, out_depth, out_bytes, out_row = fresh(docs, "h1", "h2", "bytes", "shard", "shard_depth", "shard_bytes", "row_bytes")
    a, b = hash_bits(docs, key, text)
    keyed = docs.select(a.alias("h1"), b.alias("h2"), row_bytes(docs).alias("bytes"),
                        F.struct(*[quoted(c) for c in docs.columns]).alias("row"))
    books = cut(directory(keyed.select("h1", "h2", "bytes"), limit), "shard-directory")
    low = books.agg(F.min("depth").alias("d")).first()["d"] or 0
    # The depths (at most BITS) that occur below each prefix of the shallowest bucket's length: a row meets the one
    # bucket that its bits spell out at one of these depths, however many buckets lie there.
    depths = books.groupBy(F.substring("shard", F.lit(1), F.lit(low)).alias("low")).agg(F.collect_set("depth").alias("depths"))
    placed = keyed.withColumn("low", prefix(low)).join(depths, "low").withColumn("at", F.explode("depths")).withColumn("shard", prefix(F.col("at"))).join(books, "shard")
    return placed.select(*[F.col("row")[c].alias(c) for c in docs.columns], F.col("shard").alias(out_shard), F.col("depth").alias(out_depth),
                         F.col("shard_bytes").alias(out_bytes), F.col("bytes").alias(out_row))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder of Parquet per shard. Each shard fits its limit, so one task writes it."""
    sharded.repartition("shard").write.partitionBy("shard").parquet(path)


def op8_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards(table(spark, sf_dir, "documents")).select("doc_id", "shard", "shard_depth", "shard_bytes", "row_bytes")
