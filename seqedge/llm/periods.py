"""Periodic run detection (operator 11): maximal pairs from the LCP intervals of each text's words.

A run (start, length, period) is a stretch of words that equals itself shifted by ``period`` and that no neighbour
extends. With its first and second period as the two places, it is a maximal pair: two places whose following words agree
for ``length - period`` words and then differ, with different words before them, at a distance of at most the agreement.
So nothing is extended: the words' suffixes are sorted, their common prefixes (LCP) are read bottom up, longest first,
and where two parts of an interval meet, places of one are paired with places of the other.

Each part keeps its places in text order, and a place's class is the word to its left; pairs within a class are not
maximal and are passed over. A run's first and second place are next to each other in that order (an occurrence between
them would make its period shorter), so a place meets its two neighbours instead of whole class lists, and the smaller part goes
into the larger. Multiples of a period give the same stretch again, of which the smallest period counts.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqedge.llm.common import let, or_empty, pieces, quoted, table

#: Least words of a run.
MIN_LENGTH = 12
#: Places in one stretch of a part's ordered list.
STRETCH = 2048

RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def repeats(ids: np.ndarray, k: int) -> bool:
    """False only where no ``k`` words in a row occur twice."""
    m = len(ids) - k + 1
    if m < 2:
        return False
    key = ids[:m].astype(np.uint64)
    for i in range(1, k):
        key = key * np.uint64(0x9E3779B97F4A7C15) + ids[i : i + m].astype(np.uint64)
    key.sort()
    return bool((key[1:] == key[:-1]).any())


def suffixes(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp): the suffixes of ``ids`` sorted, and the common prefix of each with the next one."""
    n = len(ids)
    ranks, width = [np.unique(ids, return_inverse=True)[1].astype(np.int32)], 1
    while int(ranks[-1].max()) + 1 < n:
        pair = ranks[-1].astype(np.int64) * (n + 1)
        pair[: n - width] += ranks[-1][width:] + 1
        ranks.append(np.unique(pair, return_inverse=True)[1].astype(np.int32))
        width *= 2
    order = np.empty(n, np.int64)
    order[ranks[-1]] = np.arange(n)
    a, b = order[:-1].copy(), order[1:].copy()
    for k in range(len(ranks) - 2, -1, -1):  # the widths that agree, widest first
        inside = np.flatnonzero(np.maximum(a, b) < n)
        same = inside[ranks[k][a[inside]] == ranks[k][b[inside]]]
        a[same] += 1 << k
        b[same] += 1 << k
    return order, a - order[:-1]


def _first(stretch: list[int]) -> int:
    return stretch[0]


def maximal_pairs(ids: np.ndarray, min_length: int = MIN_LENGTH) -> list[tuple[int, int, int]]:
    """The runs (start, length, period) of a sequence of word numbers, by start, then period."""
    least = max(1, -(-min_length // 2))  # a run's words agree with the next period for half its length at least
    if not repeats(ids, least):
        return []
    order, lcp = suffixes(ids)
    left = [-1, *ids[:-1].tolist()]  # a place's class; nothing comes before place 0
    deep = np.flatnonzero(lcp >= least)
    deep = deep[np.argsort(-lcp[deep], kind="stable")]
    at: dict[int, list] = {}  # a part by its first and its last suffix: [first, last, places, stretches in order]
    found: dict[tuple[int, int], int] = {}
    for k, agree in zip(deep.tolist(), lcp[deep].tolist()):
        one = at.pop(k, None) or [k, k, 1, [[int(order[k])]]]
        two = at.pop(k + 1, None) or [k + 1, k + 1, 1, [[int(order[k + 1])]]]
        small, large = (one, two) if one[2] < two[2] else (two, one)
        stretches = large[3]
        new = [p for s in small[3] for p in s]
        for p in new:
            c = bisect_right(stretches, p, key=_first) - 1 if len(stretches) > 1 else 0
            i = bisect_right(stretches[c], p) if c >= 0 else 0
            before = stretches[c][i - 1] if i else None
            after = stretches[max(c, 0)][i] if i < len(stretches[max(c, 0)]) else stretches[c + 1][0] if c + 1 < len(stretches) else None
            for x, y in ((before, p), (p, after)):
                if x is not None and y is not None and y - x <= agree and agree + y - x >= min_length and left[x] != left[y]:
                    stretch = (x, agree + y - x)
                    found[stretch] = min(y - x, found.get(stretch, y - x))
        for p in new:
            c = max(0, bisect_right(stretches, p, key=_first) - 1) if len(stretches) > 1 else 0
            s = stretches[c]
            s.insert(bisect_right(s, p), p)
            if len(s) > STRETCH:
                stretches[c : c + 1] = [s[: STRETCH // 2], s[STRETCH // 2 :]]
        part = [one[0], two[1], one[2] + two[2], stretches]
        at[part[0]] = at[part[1]] = part
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words without those that any run holds after its first period."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]


def numbered(words: list[bytes]) -> np.ndarray:
    ids: dict[bytes, int] = {}
    return np.array([ids.setdefault(w, len(ids)) for w in words], np.int64)


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH) -> DataFrame:
    """(key, n_words, runs, collapsed) per row: its runs of ``min_length`` words or more (start, length, period, in words,
    by start, then period), and its words without the repeats, joined by one space.

    Null, empty and blank texts have no words, no runs and an empty collapsed text. Null keys and repeated rows are
    judged one by one; runs of one stretch count once, with the smallest period; an empty table gives no rows; other
    columns play no part. A text is one task's work, in O(n log^2 n) steps; long texts go out a few at a time.
    """

    def run(batches):
        for batch in batches:
            for piece in pieces(batch, 1):
                n, runs, texts = [], [], []
                for t in piece.column(1).cast(pa.binary()).to_pylist():
                    words = (t or b"").split()
                    here = maximal_pairs(numbered(words), min_length) if len(words) >= max(2, min_length) else []
                    n.append(len(words))
                    runs.append([{"start": s, "length": m, "period": q} for s, m, q in here])
                    texts.append(b" ".join(collapsed(words, here)))
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(n, pa.int64()), pa.array(runs, RUNS), pa.array(texts, pa.binary()).cast(pa.string())],
                                                 names=["key", "n_words", "runs", "collapsed"])

    kind = docs.select(quoted(key)).dtypes[0][1]
    return docs.select(quoted(key).alias("key"), quoted(text).alias("t")).mapInArrow(
        run, f"key {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string").withColumnRenamed("key", key)


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with the repeats that the contract of operator 11 plants in a tenth of the documents."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)

    def repeat(words):
        n = F.size(words)
        a = (g % n).cast("int")
        p = (F.lit(1) + F.floor((n - a) / (3 + g % 8))).cast("int")
        return F.when(n == 0, F.col("text")).otherwise(let(a, lambda a: let(p, lambda p: F.array_join(F.transform(
            F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.get(words, F.when(i < a, i).otherwise(a + (i - a) % p))), " "))))

    words = F.filter(F.split(or_empty(F.col("text")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return docs.select("doc_id", F.when(h % 10 == 0, let(words, repeat)).otherwise(F.col("text")).alias("text"))


def op11_maximal_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(planted(table(spark, sf_dir, "documents").select("doc_id", "text")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("s"), (-r.period).alias("q"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string")), F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.s")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.q")).alias("period"),
        F.expr("1000 * best.length div -best.q").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def brute_force(words: list, min_length: int = MIN_LENGTH) -> list[tuple[int, int, int]]:
    """Runs by trying every period at every place; for tests."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i + q - s >= max(min_length, 2 * q):
                found.setdefault((s, i + q - s), q)
    return sorted(((s, m, q) for (s, m), q in found.items()), key=lambda r: (r[0], r[2]))
