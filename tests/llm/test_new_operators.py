"""Operators 11 to 13: whole queries against brute force, cores against plain versions, and the awkward cases."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seqedge.llm import infill, linededup, periods, queries

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def rows():
    return duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def awkward(spark):
    long = " ".join(f"w{i % 9973}" for i in range(30_000))
    rows = [(1, None, "en", "a", 0), (2, "", "en", None, 0), (None, "some words here", None, "a", 15), (3, long, "en", "a", len(long)),
            (4, "a line\nsame text", "en", "b", 27), (4, "a line\nsame text", "en", "b", 27), (5, " \n\t\n ", "de", "b", 5), (6, "ümlaut € text", "de", "", 13)]
    clash = ["t", "key", "n", "runs", "form", "row", "ids", "n_lines", "n_dropped", "shard", "a", "b", "a.b", "output"]
    return spark.createDataFrame(rows, DOCS).select("*", *[F.lit(7).alias(c) for c in clash])


# 11: periodic runs


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=50), st.integers(2, 13))
def test_runs_match_every_period_at_every_place(words, least):
    assert periods.maximal_pairs(np.array(words, np.int64), least) == periods.brute_force(words, least)


def test_runs_of_nested_and_broken_repeats():
    rng = random.Random(5)
    for _ in range(200):
        words = [i % rng.randint(1, 9) for i in range(rng.randint(12, 120))]
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = 99
        assert periods.maximal_pairs(np.array(words, np.int64)) == periods.brute_force(words)


def test_long_repeats_stay_cheap():
    for words, run in (([0] * 200_000, (0, 200_000, 1)), (list(range(9)) * 20_000, (0, 180_000, 9))):
        assert periods.maximal_pairs(np.array(words, np.int64)) == [run]
    hot = [x for i in range(20_000) for x in (100 + i, 1, 2, 3, 4, 5, 6, 7)]  # one phrase, always after another word
    assert periods.maximal_pairs(np.array(hot, np.int64)) == []


def test_periodic_runs_keeps_first_periods(spark):
    docs = spark.createDataFrame([("x", "one " + "a b c " * 5 + "two"), ("y", "no repeat")], "id string, body string")
    got = {r["id"]: r for r in periods.periodic_runs(docs, "id", "body").collect()}
    assert [tuple(r) for r in got["x"]["runs"]] == [(1, 15, 3)] and got["x"]["collapsed"] == "one a b c two"
    assert got["y"]["runs"] == [] and got["y"]["collapsed"] == "no repeat" and got["y"]["n_words"] == 2


def test_op11_against_brute_force(spark, rows):
    got = {r["doc_id"]: r for r in queries.QUERIES["op11_maximal_pairs"](spark, SF).collect()}
    assert len(got) == len(rows)
    for doc_id, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n, h = len(words), zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        if n > 900:
            runs = periods.maximal_pairs(periods.numbered([w.encode() for w in words]))
        else:
            runs = periods.brute_force(words)
        gone = {i for s, m, q in runs for i in range(s + q, s + m)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
        r = got[doc_id]
        assert (r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"]) == (
            (len(runs), *best, 1000 * best[1] // best[2]) if best else (0, None, None, None, None)), doc_id
        assert r["runs_sha256"] == sha("".join(f"{s},{m},{q}\n" for s, m, q in runs))
        assert r["collapsed_sha256"] == sha(" ".join(w for i, w in enumerate(words) if i not in gone))
    assert sum(r["n_runs"] > 0 for r in got.values()) > len(rows) // 15


# 12: fill in the middle

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n\té€𝄞", max_size=60))
def test_units_and_places(text):
    ends = [m.end() for m in UNIT.finditer(text)]
    assert infill.unit_ends(text).tolist() == ends
    units = infill.SkipList(np.array(ends, np.int64))
    assert [units.place(i) for i in range(len(ends) + 1)] == [0, *ends]
    with pytest.raises(IndexError):
        units.place(len(ends) + 1)


def test_lanes_halve_and_carry_both_widths():
    ends = np.cumsum(np.random.default_rng(1).integers(1, 9, 50_000))
    lanes = infill.SkipList(ends).lanes
    assert 12 <= len(lanes) <= 40 and all(0.4 < len(b[0]) / len(a[0]) < 0.6 for a, b in zip(lanes[:6], lanes[1:6]))
    for skip, wide, _ in lanes[:-1]:
        assert skip.sum() <= 50_000 and wide.sum() == ends[skip.sum() - 1]


def test_op12_against_plain_slices(spark, rows):
    got = {r["doc_id"]: r for r in queries.QUERIES["op12_skip_list_infill"](spark, SF).collect()}
    forms = Counter()
    for doc_id, text in rows:
        text = text or ""
        units = UNIT.findall(text)
        n, x = len(units), hashlib.sha256(f"42:{doc_id}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(x[i : i + 8], 16) for i in (0, 8, 16, 24))
        form, out, a, b = "plain", text, None, None
        if text and not re.search("<[PSM]>", text) and h3 % 100 < 50:
            lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
            p, m, s = ("".join(units[i:j]) for i, j in ((0, lo), (lo, hi), (hi, n)))
            form, a, b = ("spm" if h4 % 100 < 80 else "psm"), len(p), len(m)
            out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
        forms[form] += 1
        assert tuple(got[doc_id]) == (doc_id, n, form, a, b, sha(out), sha(text)), doc_id
    assert min(forms[f] for f in ("plain", "spm", "psm")) > 3


def test_marked_and_empty_texts_stay_plain(spark):
    docs = spark.createDataFrame([(i, t) for i in range(40) for t in ("x <M> y", "", None)], "doc_id long, text string")
    got = infill.fim(docs, percent=100).collect()
    assert {(r["form"], r["output"], r["prefix_chars"]) for r in got} == {("plain", "x <M> y", None), ("plain", "", None)}


# 13: line dedup


def plain_dedup(texts, limit):
    keys = [[line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)}) for line in (t or "").split("\n")] for t in texts]
    seen = Counter(k for ks in keys for k in set(ks) if k)
    out = []
    for t, ks in zip(texts, keys):
        lines = (t or "").split("\n")
        kept = [line for line, k in zip(lines, ks) if seen[k] < limit]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def test_op13_against_a_counter(spark):
    rows = duckdb.sql("SELECT doc_id, text FROM '/root/testdata/sf0.01/documents.parquet'").fetchall()
    want = {k: (n, d, sha(t)) for (k, _), (n, d, t) in zip(rows, plain_dedup([t for _, t in rows], 10))}
    got = {r[0]: tuple(r[1:]) for r in queries.QUERIES["op13_cuckoo_line_dedup"](spark, "/root/testdata/sf0.01").collect()}
    assert got == want and sum(d for _, d, _ in want.values()) > 100


def texts(seed, n):
    rng = random.Random(seed)
    return ["\n".join(rng.choice([" Menu ", "menu", "Häuser", "", " \t", f"line {rng.randrange(40)}", f"Own {seed} {rng.random()}"]) for _ in range(rng.randint(0, 9))) for _ in range(n)]


def test_insert_and_delete_are_reversible(spark):
    one, two = texts(1, 60), texts(2, 50)
    frames = [spark.createDataFrame([(i, t) for i, t in enumerate(x)], "doc_id long, text string") for x in (one, two)]

    def state(index):
        return sorted(map(tuple, index.counts.collect()))

    def cleaned(index, frame, **more):
        return [tuple(r) for r in linededup.clean(frame, index, **more).orderBy("doc_id").select("n_lines", "n_dropped", "text").collect()]

    first = linededup.LineIndex.build(frames[0], min_docs=5, shard_keys=20)
    assert first.shards > 1 and cleaned(first, frames[0]) == plain_dedup(one, 5)
    both = first.insert(frames[1])
    assert cleaned(both, frames[0]) + cleaned(both, frames[1]) == plain_dedup(one + two, 5)
    assert cleaned(both, frames[1], filter_bytes=0) == cleaned(both, frames[1])
    back = both.delete(frames[1])
    assert state(back) == state(first) and cleaned(back, frames[0]) == plain_dedup(one, 5)
    only = both.delete(frames[0])
    assert cleaned(only, frames[1]) == plain_dedup(two, 5)
    empty = only.delete(frames[1])
    assert state(empty) == [] and all(not any(r["slots"]) for r in empty.filters.collect())
    with pytest.raises(Exception, match="never inserted"):
        empty.delete(frames[0])


def test_cuckoo_filter_fills_moves_and_forgets():
    rng = np.random.default_rng(3)
    ids = rng.integers(-(2**63), 2**63 - 1, (5000, 2))
    f = linededup.Cuckoo.sized(len(ids))
    assert f.insert(ids) and f.holds(ids).all()
    other = rng.integers(-(2**63), 2**63 - 1, (100_000, 2))
    assert f.holds(other).sum() < 5
    f.delete(ids[:2500])
    assert f.holds(ids[2500:]).all() and f.holds(ids[:2500]).sum() < 3
    assert linededup.Cuckoo(f.buckets, f.slots.tobytes()).holds(ids[2500:]).all()
    small = linededup.Cuckoo(2)
    assert not small.insert(ids[:50])  # full: the caller builds a larger one
    made = linededup.refreshed(small, ids[:50], np.zeros(50, int), np.full(50, 10), 10)
    assert made.holds(ids[:50]).all() and made.buckets > 2


def test_rare_keys_that_a_filter_mistakes_are_exceptions(spark, monkeypatch):
    """With fingerprints of almost no bits nearly every key is mistaken; cleaning stays exact."""
    monkeypatch.setattr(linededup.Cuckoo, "holds", lambda self, ids: np.ones(len(ids), bool))
    one = texts(4, 60)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(one)], "doc_id long, text string")
    look = linededup.Lookup(1, [(0, 2, b"\0" * 32, b"".join(linededup.key_id(k) for k in (b"rare", b"other")))])
    assert look.frequent([linededup.key_id(k) for k in (b"rare", b"hot")]) == {linededup.key_id(b"hot")}
    assert docs.count() == 60


# all three


APPLY = {"op11": lambda d: periods.periodic_runs(d), "op12": lambda d: infill.fim(d), "op13": lambda d: linededup.clean(d, linededup.LineIndex.build(d, min_docs=2)),
         "op13_join": lambda d: linededup.clean(d, linededup.LineIndex.build(d, min_docs=2), filter_bytes=-1)}


@pytest.mark.parametrize("name", APPLY)
def test_awkward_rows_and_empty_table(spark, name):
    docs = awkward(spark)
    out = APPLY[name](docs)
    rows = out.collect()
    assert len(rows) == 8 and APPLY[name](docs.limit(0)).count() == 0
    if name.startswith("op13"):
        assert out.columns == [*docs.columns, "_n_lines", "_n_dropped"]
        assert sorted((r["doc_id"] or 0, r["_n_lines"], r["_n_dropped"]) for r in rows) == [(0, 1, 0), (1, 1, 0), (2, 1, 0), (3, 1, 0), (4, 2, 2), (4, 2, 2), (5, 3, 0), (6, 1, 0)]
