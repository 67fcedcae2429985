"""Line dedup (operator 13): cuckoo filters over exact reference counts, reversible document by document.

The index is two written tables. ``counts`` has each line key's 128-bit id and the number of documents that hold it, in
shards by hash. ``filters`` has a cuckoo filter for each shard: fingerprints of the keys that ``min_docs`` documents or
more hold, two possible buckets a key, so that a key can also be taken out again. Inserting or deleting documents adds to
or subtracts from the counts; only keys that cross the limit are put into or taken from their shard's filter, and a
filter that is full is built anew, twice as large, from the exact counts.

A filter can mistake a rare key for a frequent one. The shard's exact counts say for which of its keys, and these few
exceptions lie beside the filter, so that cleaning indexed documents is exact without a look at the counts.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from seqedge.llm.common import cut, fresh, pieces, quoted, table

MIN_DOCS = 10
#: Keys of the reference counts in one shard, about.
SHARD_KEYS = 20_000
#: Fingerprints in a bucket, and moves before a filter counts as full.
SLOTS, KICKS = 4, 500
#: Filters are sent to the tasks that clean up to so many bytes in all; beyond, line keys are joined with the counts.
FILTER_BYTES = 64 << 20

COUNTS = "shard int, a long, b long, n long"
FILTERS = "shard int, buckets int, slots binary, exceptions binary"


def line_keys(text: bytes) -> list[bytes]:
    """The key of each line: stripped of ASCII white space, A-Z in lower case."""
    return [line.strip() for line in text.lower().split(b"\n")]


def key_id(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def as_ids(digests: list[bytes]) -> np.ndarray:
    """Ids as rows of two longs."""
    return np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)


def shard_of(a: np.ndarray, shards: int) -> np.ndarray:
    return np.mod(a, shards)


class Cuckoo:
    """A cuckoo filter of 32-bit fingerprints for ids (a, b). ``buckets`` is a power of two."""

    def __init__(self, buckets: int, slots: bytes | None = None):
        self.buckets = buckets
        self.slots = np.zeros((buckets, SLOTS), np.uint32) if slots is None else np.frombuffer(slots, np.uint32).reshape(buckets, SLOTS).copy()

    @staticmethod
    def sized(n: int) -> "Cuckoo":
        """A filter with room for ``n`` keys at 80 % load."""
        return Cuckoo(1 << max(1, int(np.ceil(np.log2(max(1, n) / (0.8 * SLOTS))))))

    def spots(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprint (never 0) and both buckets of each id."""
        b = ids[:, 1].astype(np.uint64)
        mark = np.maximum((b >> np.uint64(32)).astype(np.uint32), np.uint32(1))
        one = (b & np.uint64(self.buckets - 1)).astype(np.int64)
        return mark, one, one ^ self.turn(mark)

    def turn(self, mark):
        """What leads from one of a fingerprint's buckets to the other."""
        return (mark.astype(np.int64) * 0x5BD1E995 >> 15) & (self.buckets - 1)

    def holds(self, ids: np.ndarray) -> np.ndarray:
        mark, one, two = self.spots(ids)
        return ((self.slots[one] == mark[:, None]) | (self.slots[two] == mark[:, None])).any(1)

    def insert(self, ids: np.ndarray) -> bool:
        """Put ids in. False when there is no room; the filter must then be built anew."""
        for mark, one, two in zip(*self.spots(ids)):
            for step in range(KICKS):
                row = self.slots[one] if not self.slots[one].all() else self.slots[two]
                free = np.flatnonzero(row == 0)
                if len(free):
                    row[free[0]] = mark
                    break
                i = (int(mark) + step) % SLOTS  # someone else's fingerprint moves to its other bucket
                mark, self.slots[two][i] = self.slots[two][i], mark
                one, two = two, int(two) ^ int(self.turn(mark))
            else:
                return False
        return True

    def delete(self, ids: np.ndarray) -> None:
        """Take out ids that were put in."""
        for mark, one, two in zip(*self.spots(ids)):
            for row in (self.slots[one], self.slots[two]):
                hit = np.flatnonzero(row == mark)
                if len(hit):
                    row[hit[0]] = 0
                    break


def refreshed(old: Cuckoo | None, ids: np.ndarray, before: np.ndarray, now: np.ndarray, limit: int) -> Cuckoo:
    """A shard's filter after its keys' counts went from ``before`` to ``now``."""
    wanted = now >= limit
    if old is not None:
        held = before >= limit
        old.delete(ids[held & ~wanted])
        if old.insert(ids[wanted & ~held]):
            return old
    new = Cuckoo.sized(int(wanted.sum()))
    while not new.insert(ids[wanted]):
        new = Cuckoo(2 * new.buckets)
    return new


@dataclass(frozen=True)
class LineIndex:
    """One version of the index: its tables, the number of shards, and the limit."""

    counts: DataFrame
    filters: DataFrame
    shards: int
    min_docs: int

    @staticmethod
    def build(docs: DataFrame, text: str = "text", min_docs: int = MIN_DOCS, shard_keys: int = SHARD_KEYS) -> "LineIndex":
        """Index ``docs``. Every row is a document."""
        found = cut(counted(docs, text), "line-keys")
        shards = max(1, -(-found.count() // shard_keys))
        return _version(None, found, shards, min_docs)

    def insert(self, docs: DataFrame, text: str = "text") -> "LineIndex":
        """The index with the rows of ``docs`` as further documents."""
        return _version(self, counted(docs, text), self.shards, self.min_docs)

    def delete(self, docs: DataFrame, text: str = "text") -> "LineIndex":
        """The index without the rows of ``docs``; deleting lines that were never inserted is an error."""
        return _version(self, counted(docs, text).withColumn("n", -F.col("n")), self.shards, self.min_docs)


def counted(docs: DataFrame, text: str = "text") -> DataFrame:
    """(a, b, n): the ids of all non-empty line keys and the number of rows that hold them."""

    def run(batches):
        for batch in batches:
            for piece in pieces(batch, 0):
                seen: Counter = Counter()
                for t in piece.column(0).cast(pa.binary()).to_pylist():
                    seen.update(set(line_keys(t or b"")))
                seen.pop(b"", None)
                ids = as_ids([key_id(k) for k in seen])
                yield pa.RecordBatch.from_arrays([pa.array(ids[:, 0]), pa.array(ids[:, 1]), pa.array(seen.values(), pa.int64())], names=["a", "b", "n"])

    return docs.select(quoted(text).alias("t")).mapInArrow(run, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def _version(old: LineIndex | None, change: DataFrame, shards: int, limit: int) -> LineIndex:
    """The next version: counts added up, each shard's filter brought up to date in one task."""
    merged = change.select(F.pmod(F.col("a"), F.lit(shards)).cast("int").alias("shard"), "a", "b", F.lit(0).cast("long").alias("before"), "n")
    if old is not None:
        both = old.counts.select("shard", "a", "b", F.col("n").alias("before"), "n").unionByName(merged)
        summed = both.groupBy("shard", "a", "b").agg(F.sum("before").alias("before"), F.sum("n").alias("n"))
        bad = F.when(F.col("n") < 0, F.raise_error(F.lit("a deleted line was never inserted")))
        merged = cut(summed.withColumn("n", F.coalesce(bad.cast("long"), F.col("n"))), "line-counts")
    counts = merged.filter("n > 0").select("shard", "a", "b", "n")

    def built(shard: int, keys: pd.DataFrame, slots: pd.DataFrame | None) -> pd.DataFrame:
        ids = np.ascontiguousarray(keys[["a", "b"]].to_numpy(np.int64))
        now = keys["n"].to_numpy()
        was = None if slots is None or not len(slots) else Cuckoo(int(slots["buckets"].iloc[0]), slots["slots"].iloc[0])
        made = refreshed(was, ids, keys["before"].to_numpy(), now, limit)
        cold = ids[(now < limit) & made.holds(ids)]
        return pd.DataFrame({"shard": [shard], "buckets": [made.buckets], "slots": [made.slots.tobytes()], "exceptions": [cold.tobytes()]})

    if old is None:
        filters = merged.groupBy("shard").applyInPandas(lambda key, keys: built(key[0], keys, None), FILTERS)
    else:
        filters = merged.groupBy("shard").cogroup(old.filters.groupBy("shard")).applyInPandas(lambda key, keys, slots: built(key[0], keys, slots), FILTERS)
    return LineIndex(counts, cut(filters, "line-filters"), shards, limit)


class Lookup:
    """All shards' filters in one task."""

    def __init__(self, shards: int, rows: list):
        self.shards = shards
        self.filters = {r[0]: Cuckoo(r[1], r[2]) for r in rows}
        self.exceptions = {bytes(r[3][i : i + 16]) for r in rows for i in range(0, len(r[3]), 16)}

    def frequent(self, digests: list[bytes]) -> set[bytes]:
        """Which ids are those of frequent keys."""
        ids, out = as_ids(digests), set()
        shard = shard_of(ids[:, 0], self.shards)
        order = np.argsort(shard, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
            if len(part) and (f := self.filters.get(int(shard[part[0]]))):
                out.update(digests[i] for i in part[f.holds(np.ascontiguousarray(ids[part]))].tolist())
        return out - self.exceptions


def without(text: str, gone) -> tuple[int, int, str]:
    """(lines, lines dropped, kept text); ``gone`` says of a key whether its lines go."""
    raw = text.encode("utf-8", "surrogatepass")
    lines = raw.split(b"\n")
    kept = [line for line, key in zip(lines, line_keys(raw)) if not gone(key)]
    return len(lines), len(lines) - len(kept), b"\n".join(kept).decode("utf-8", "surrogatepass")


def plain(df: DataFrame) -> DataFrame:
    """``df`` under column names that need no quoting."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def clean(docs: DataFrame, index: LineIndex, text: str = "text", filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """``docs``, all of them inserted in ``index``, without their frequent lines, and with ``n_lines`` (before) and
    ``n_dropped`` (under other names, with ``_`` before them, where ``docs`` has columns of these names).

    Null and empty texts are one empty line, which stays; repeated rows are documents of their own; null keys and extra
    columns pass through; an empty table gives no rows. Filters of up to ``filter_bytes`` in all go to every task;
    beyond, each document's line ids are joined with the counts.
    """
    spark, (n_lines, n_dropped, ids) = docs.sparkSession, fresh(docs, "n_lines", "n_dropped", "ids")
    held = index.filters.agg(F.sum(F.octet_length("slots") + F.octet_length("exceptions") + 64).alias("bytes")).first()["bytes"] or 0
    place = docs.columns.index(text)
    names = [*docs.columns, n_lines, n_dropped]
    schema = StructType([*docs.schema.fields, StructField(n_lines, LongType()), StructField(n_dropped, LongType())])

    def done(piece, results):
        n, gone, kept = zip(*results)
        columns = [pa.array(kept, pa.string()) if i == place else piece.column(i) for i in range(len(names) - 2)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64()), pa.array(gone, pa.int64())], names=names)

    if held <= filter_bytes:
        sent = spark.sparkContext.broadcast([tuple(r) for r in index.filters.collect()])
        shards = index.shards

        def run(batches):
            look = Lookup(shards, sent.value)
            for batch in batches:
                for piece in pieces(batch, place):
                    texts = [t or "" for t in piece.column(place).to_pylist()]
                    keys = list({k for t in texts for k in line_keys(t.encode("utf-8", "surrogatepass"))} - {b""})
                    digests = [key_id(k) for k in keys]
                    hot = look.frequent(digests)
                    gone = {k for k, d in zip(keys, digests) if d in hot}
                    yield done(piece, [without(t, gone.__contains__) for t in texts])

        return plain(docs).mapInArrow(run, schema)

    row, = fresh(docs, "row")
    docs = cut(docs.withColumn(row, F.monotonically_increasing_id()), "lines")

    def listed(batches):
        for batch in batches:
            for piece in pieces(batch, 1):
                rows, digests = [], []
                for r, t in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist()):
                    mine = [key_id(k) for k in set(line_keys((t or "").encode("utf-8", "surrogatepass"))) - {b""}]
                    digests += mine
                    rows += [r] * len(mine)
                x = as_ids(digests)
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(x[:, 0]), pa.array(x[:, 1])], names=["row", "a", "b"])

    lines = docs.select(quoted(row), quoted(text)).mapInArrow(listed, "row long, a long, b long")
    frequent = lines.join(index.counts.filter(F.col("n") >= index.min_docs).select("a", "b"), ["a", "b"], "left_semi")
    mine = frequent.groupBy("row").agg(F.collect_list(F.struct("a", "b")).alias(ids)).withColumnRenamed("row", row)
    kept = [c for c in docs.columns if c != row]

    def strike(batches):
        for batch in batches:
            for piece in pieces(batch, place):
                results = []
                for t, x in zip(piece.column(place).to_pylist(), piece.column(len(names) - 2).to_pylist()):
                    hot = {np.array([i["a"], i["b"]], np.int64).tobytes() for i in x or []}
                    results.append(without(t or "", lambda k: bool(hot) and k != b"" and key_id(k) in hot))
                yield done(piece, results)

    return plain(docs.join(mine, row, "left").select(*[quoted(c) for c in kept], quoted(ids))).mapInArrow(strike, schema)


def op13_cuckoo_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return clean(docs, LineIndex.build(docs)).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
