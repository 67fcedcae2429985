"""Fill-in-middle transformation (operator 12): cut points by rank in an indexable skip list of a text's units.

A unit is a word with the white space before it, or the white space that ends the text. The ground lane links all
units; each lane above keeps about half of the one below. Every link carries two widths, the units and the code points
that it skips, so a descent that adds up widths without passing the wanted rank ends exactly on it and knows its place
in the text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqedge.llm.common import pieces, quoted, table

#: The marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def unit_ends(text: str) -> np.ndarray:
    """Where each unit of ``text`` ends, in code points."""
    if not text:
        return np.empty(0, np.int64)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    solid = (codes != 32) & ((codes < 9) | (codes > 13))
    return np.append(np.flatnonzero(solid[:-1] & ~solid[1:]) + 1, len(codes))


def _coins(ranks: np.ndarray, lane: int) -> np.ndarray:
    """Which nodes of a lane rise to the next one: a fair coin by rank and lane. The head always does."""
    x = (ranks.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15 * (lane + 1) % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return ((x >> np.uint64(63)) == 1) | (ranks == 0)


class SkipList:
    """Units in order. A lane is (units, chars, down): the widths of each node's link to the next node of the lane, and
    the node's place in the lane below. Node 0 is the head, before the first unit."""

    def __init__(self, ends: np.ndarray):
        ranks, places, down, self.lanes = np.arange(len(ends) + 1), np.concatenate(([0], ends)), None, []
        while True:
            self.lanes.append((np.diff(ranks), np.diff(places), down))
            if len(ranks) == 1:
                break
            up = _coins(ranks, len(self.lanes))
            if up.all():  # all coins came up: only the head rises
                up[1:] = False
            down = np.flatnonzero(up)
            ranks, places = ranks[up], places[up]

    def place(self, rank: int) -> int:
        """Code points before unit ``rank`` (all of them, if that is the number of units)."""
        node = units = chars = 0
        for skip, wide, down in reversed(self.lanes):
            while node < len(skip) and units + skip[node] <= rank:
                units += int(skip[node])
                chars += int(wide[node])
                node += 1
            if down is not None:
                node = int(down[node])
        if units != rank:
            raise IndexError(rank)
        return chars


def draws(key: object, seed: int) -> tuple[int, int, int, int]:
    """Four 32-bit draws of a row: the first eight-digit groups of a digest of seed and key."""
    hexes = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    return tuple(int(hexes[8 * i : 8 * i + 8], 16) for i in range(4))


def fim(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 42, percent: int = 50, spm_percent: int = 80) -> DataFrame:
    """(key, n, form, prefix_chars, middle_chars, output) per row: ``percent`` of the texts are cut in three at two ranks of
    their ``n`` units, ``spm_percent`` of these written suffix first (spm), the others prefix first (psm).

    Null texts count as empty. Empty texts, texts that hold a mark, and rows without a key stay as they are (plain, no
    lengths). Equal keys draw alike, so repeated rows give equal results; an empty table gives no rows; other columns
    play no part. Long texts go out a few at a time.
    """

    def run(batches):
        for batch in batches:
            for piece in pieces(batch, 1):
                made = []
                for k, t in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist()):
                    t = t or ""
                    ends, form = unit_ends(t), "plain"
                    if t and k is not None and not any(m in t for m in (PREFIX, SUFFIX, MIDDLE)):
                        h1, h2, h3, h4 = draws(k, seed)
                        if h3 % 100 < percent:
                            form = "spm" if h4 % 100 < spm_percent else "psm"
                    if form == "plain":
                        made.append((len(ends), form, None, None, t))
                        continue
                    lo, hi = sorted((h1 % (len(ends) + 1), h2 % (len(ends) + 1)))
                    units = SkipList(ends)
                    a, b = units.place(lo), units.place(hi)
                    prefix, middle, suffix = t[:a], t[a:b], t[b:]
                    out = (SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle) if form == "spm" else (PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle)
                    made.append((len(ends), form, a, b - a, "".join(out)))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([piece.column(0), *[pa.array(x, t) for x, t in zip(zip(*made), kinds)]],
                                                 names=["key", "n", "form", "prefix_chars", "middle_chars", "output"])

    kind = docs.select(quoted(key)).dtypes[0][1]
    return docs.select(quoted(key).alias("key"), quoted(text).alias("t")).mapInArrow(
        run, f"key {kind}, n long, form string, prefix_chars long, middle_chars long, output string").withColumnRenamed("key", key)


def restored(output: Column, form: Column) -> Column:
    """The text that ``fim`` was given (empty for null), from its output and form alone."""
    parts = F.split(output, "<[PSM]>", -1)  # a text that is not plain holds no mark of its own
    return (F.when(form == "psm", F.concat(parts[1], parts[3], parts[2]))
            .when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output))


def op12_skip_list_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
