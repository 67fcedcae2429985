"""Benchmark decontamination (operator 3): a generalised suffix automaton of the normalised test items; every document's
words stream through it and the longest matching lengths say which words lie in a window of an item.

A window is ``window`` consecutive words of an item, or a whole item of fewer. Items are dealt to bounded shards, each
an automaton that a task builds and writes to the shared folder; documents are matched where they lie, a chunk with one shard after another, without a shuffle.
"""

from __future__ import annotations

import hashlib
import itertools
import pickle
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqedge.llm.common import cut, fresh, or_empty, quoted, store, table

#: Words are [0-9a-z] and everything beyond ASCII, after A-Z are lower-cased; any other byte separates.
FOLD = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
JVM_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


class Automaton:
    """Suffix automaton over word numbers. State 0 is the root; an item starts there again, so no path crosses items."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.steps: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.windows: dict[int, set[str]] = {}  # state of a full window -> items that have it
        self.shorts: dict[int, list[tuple[int, str]]] = {}  # state of a whole short item -> (words, item)
        coded = [(k, [self.vocab.setdefault(w, len(self.vocab)) for w in ws]) for k, ws in items if ws]
        for _, ws in coded:
            last = 0
            for c in ws:
                last = self._extend(last, c)
        for k, ws in coded:
            v = 0
            for i, c in enumerate(ws):
                v = self.steps[v][c]
                if i + 1 >= window:
                    v = self._shorten(v)
                    self.windows.setdefault(v, set()).add(k)
            if len(ws) < window:
                self.shorts.setdefault(v, []).append((len(ws), k))
        self.near = [0] * len(self.link)  # the nearest state along suffix links, itself included, with a short item
        for v in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            self.near[v] = v if v in self.shorts else self.near[self.link[v]]
        self.least = min([window, *(len(ws) for _, ws in coded)]) if coded else 0
        n = len(self.vocab)
        self.pairs = np.unique(np.array([a * n + b for _, ws in coded for a, b in zip(ws, ws[1:])] or [-1], dtype=np.int64))

    def _new(self, length: int, like: int | None = None) -> int:
        self.steps.append({} if like is None else dict(self.steps[like]))
        self.link.append(0 if like is None else self.link[like])
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """The state of the strings into ``q`` that are one word longer than ``p``'s."""
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._new(self.length[p] + 1, q)
        self.link[q] = clone
        while p >= 0 and self.steps[p].get(c) == q:
            self.steps[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        if c in self.steps[last]:
            return self._split(last, c, self.steps[last][c])
        cur, p = self._new(self.length[last] + 1), last
        while p >= 0 and c not in self.steps[p]:
            self.steps[p][c] = cur
            p = self.link[p]
        self.link[cur] = 0 if p < 0 else self._split(p, c, self.steps[p][c])
        return cur

    def _shorten(self, v: int) -> int:
        """The state that holds the window-long suffix of ``v``'s strings."""
        while self.length[self.link[v]] >= self.window:
            v = self.link[v]
        return v

    def match(self, words: list[bytes]) -> tuple[np.ndarray, set[str], int]:
        """(flags of the hit words, items, longest matching length)."""
        hit, items, longest = np.zeros(len(words), bool), set(), 0
        if not self.least or len(words) < self.least:
            return hit, items, longest
        get, n = self.vocab.get, len(self.vocab)
        ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        # Only stretches of known words whose every neighbouring pair occurs in an item, and that are as long as the
        # shortest window, can hold a window. The automaton reads these; it would find nothing elsewhere.
        known = ids >= 0
        code = ids[:-1] * n + ids[1:]
        at = np.searchsorted(self.pairs, code).clip(max=len(self.pairs) - 1)
        joined = known[:-1] & known[1:] & (self.pairs[at] == code)
        cuts = np.flatnonzero(~joined) + 1
        begins, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(words)]))
        steps, link, length, near = self.steps, self.link, self.length, self.near
        for b, e in zip(begins.tolist(), ends.tolist()) if self.least == 1 else ((b, e) for b, e in zip(*(x[ends - begins >= self.least].tolist() for x in (begins, ends)))):
            v = l = 0
            for i, c in enumerate(ids[b:e].tolist(), b):
                while v and c not in steps[v]:
                    v = link[v]
                    l = length[v]
                if c in steps[v]:
                    v, l = steps[v][c], l + 1
                longest = max(longest, l)
                if l >= self.window:
                    hit[i - self.window + 1 : i + 1] = True
                    items |= self.windows[self._shorten(v)]
                u = near[v]
                while u:
                    for k, item in self.shorts[u]:
                        if k <= l:
                            hit[i - k + 1 : i + 1] = True
                            items.add(item)
                    u = near[link[u]]
        return hit, items, longest


def spans_of(hit: np.ndarray) -> list[int]:
    """Begin, end, begin, end, ... of the runs of hit words."""
    return np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))).tolist()


def automata(benchmark: DataFrame, key: str, text: str, window: int, shard_words: int) -> list[str]:
    """Files of the items' automata, each of about ``shard_words`` words (or one longer item): items are dealt by a hash, built in
    tasks and written to the shared folder. The driver sees file names only, a few for a shard."""
    items = benchmark.select(F.coalesce(quoted(key).cast("string"), F.lit("")).alias("k"), or_empty(quoted(text)).alias("t")).distinct()
    total = items.agg(F.sum(F.regexp_count("t", F.lit(JVM_WORD)))).first()[0] or 0
    n = max(1, -(-total // shard_words))

    def build(rows):
        built = Automaton([(k, words_of(t.encode())) for k, t in zip(rows["k"], rows["t"])], window)
        return pd.DataFrame({"automaton": [pickle.dumps(built, pickle.HIGHEST_PROTOCOL)]})

    dealt = items.withColumn("shard", F.pmod(F.xxhash64("k", "t"), F.lit(n))).repartition(n, "shard")
    return sorted(cut(dealt.groupBy("shard").applyInPandas(build, "automaton binary"), "leak-automata").inputFiles())


def stored(files: list[str]) -> Iterator[Automaton]:
    """The automata in ``files``, one in memory at a time."""
    for name in files:
        where, at = store(name)
        with where.open_input_file(at) as f:
            for batch in pq.ParquetFile(f).iter_batches(1, columns=["automaton"]):
                yield pickle.loads(batch.column(0)[0].as_py())


_HELD: dict[str, list[Automaton]] = {}


def held(name: str) -> list[Automaton]:
    """The automata of a single file, read once by a Python worker."""
    if name not in _HELD:
        _HELD.clear()
        _HELD[name] = list(stored([name]))
    return _HELD[name]


def chunks(batches, size: int):
    """Lists of Arrow batches of about ``size`` bytes each."""
    some, n = [], 0
    for batch in batches:
        some.append(batch)
        n += batch.nbytes
        if n >= size:
            yield some
            some, n = [], 0
    if some:
        yield some


def by_place(df: DataFrame) -> DataFrame:
    """``df`` with its columns numbered: Arrow batches are read by place, whatever the columns' names hold."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def match(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = 10,
          shard_words: int = 300_000, chunk_bytes: int = 64 << 20) -> DataFrame:
    """``docs`` with n_words, spans (word numbers: begin, end, ...), items (ids, sorted) and n_longest.

    Null and empty texts have no words; items without words match nothing; repeated items, and items without an id
    (their id is the empty string), count once per id; repeated documents are matched one by one; an empty table on
    either side gives no rows or no hits. Columns whose names clash with the new ones are renamed by nobody: the new
    ones take an underscore.
    """
    words, spans, items, longest = fresh(docs, "n_words", "spans", "items", "n_longest")
    new = [(words, "bigint", pa.int64()), (spans, "array<bigint>", pa.list_(pa.int64())), (items, "array<string>", pa.list_(pa.string())), (longest, "bigint", pa.int64())]
    schema = docs.withColumns({n: F.lit(None).cast(t) for n, t, _ in new}).schema
    where, names = docs.columns.index(text), schema.names
    files = automata(benchmark, item, item_text, window, shard_words)

    def run(batches):
        # One shard is read once. Of several, each is read for a chunk of documents at a time, so a task holds one automaton.
        for chunk in chunks(batches, 0 if len(files) == 1 else chunk_bytes):
            seen = [[[0, [], set(), 0] for _ in range(batch.num_rows)] for batch in chunk]
            first = True
            for automaton in itertools.chain(held(files[0]) if len(files) == 1 else stored(files), [None]):  # the last only counts words, if there was no shard
                if automaton is None and not first:
                    break
                for batch, found in zip(chunk, seen):
                    for t, cell in zip(batch.column(where).cast(pa.binary()), found):
                        ws = words_of(t.as_py())
                        cell[0] = len(ws)
                        if automaton is not None:
                            hit, ids, length = automaton.match(ws)
                            for b, e in zip(cell[1][::2], cell[1][1::2]):  # what earlier shards found
                                hit[b:e] = True
                            cell[1:] = spans_of(hit), cell[2] | ids, max(cell[3], length)
                first = False
            for batch, found in zip(chunk, seen):
                cells = zip(*((n, s, sorted(i), m) for n, s, i, m in found)) if found else ([], [], [], [])
                yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, t) for c, (_, _, t) in zip(cells, new))], names=names)

    return by_place(docs).mapInArrow(run, schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", size: str | None = "n_chars", max_coverage: float = 0.5, **options) -> DataFrame:
    """``docs`` without the words that lie in a window, and without documents of which more than ``max_coverage`` do.

    ``size`` is set to the new length where the text changed; other columns stay. Cases as in ``match``.
    """
    words, spans, *_ = fresh(docs, "n_words", "spans")
    found = match(docs, benchmark, text, **options)
    columns, where, at = docs.columns, docs.columns.index(text), len(docs.columns)
    length = columns.index(size) if size in columns else None
    kind = T.StructType([docs.schema[c] for c in columns])

    def strip(batches):
        for batch in batches:
            texts, lengths, keep = batch.column(where).to_pylist(), None if length is None else batch.column(length).to_pylist(), []
            for j, runs in enumerate(batch.column(at + 1).to_pylist()):
                n_hit = sum(runs[1::2]) - sum(runs[::2])
                keep.append(n_hit <= max_coverage * batch.column(at)[j].as_py())
                if runs and keep[-1]:
                    raw, parts, end = texts[j].encode(), [], 0
                    marks = [m.span() for m in WORD.finditer(raw)]
                    for b, e in zip(runs[::2], runs[1::2]):
                        parts.append(raw[end : marks[b][0]])
                        end = marks[e - 1][1]
                    texts[j] = b"".join([*parts, raw[end:]]).decode()
                    if lengths:
                        lengths[j] = len(texts[j])
            cells = list(batch.columns[:at])
            cells[where] = pa.array(texts, cells[where].type)
            if lengths:
                cells[length] = pa.array(lengths, cells[length].type)
            yield pa.RecordBatch.from_arrays(cells, names=columns).filter(pa.array(keep, pa.bool_()))

    return by_place(found).mapInArrow(strip, kind)


def op3_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = match(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: x - a)  # ends less begins, as signs alternate
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"), "n_longest")


def brute_force(texts: list[str | None], items: list[tuple[str, str | None]], window: int = 10) -> list[tuple[int, int, int, str, bool]]:
    """The contract's columns, by looking for every window everywhere; for tests."""
    wanted = {}
    for k, t in items:
        ws = words_of((t or "").encode())
        for i in range(max(1, len(ws) - window + 1) if ws else 0):
            wanted.setdefault(tuple(ws[i : i + window]), set()).add(k)
    out = []
    for t in texts:
        ws = words_of((t or "").encode())
        hit, found = set(), set()
        for n in {len(w) for w in wanted}:
            for i in range(len(ws) - n + 1):
                if got := wanted.get(tuple(ws[i : i + n])):
                    hit.update(range(i, i + n))
                    found |= got
        out.append((len(ws), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out
