"""N-gram Jaccard join (operator 4): a grouped prefix join of word-shingle sets, exact for every pair over the limit.

Two sets with J >= t share an element among each one's first n - ceil(t n) + 1 in any common order of all elements. The
order here: shingles whose hash lies in the lowest ``REGION`` of all hashes come first, rarest first; then the others.

1. Texts become sets of 64-bit shingle hashes; equal sets (copies) become one.
2. Document frequencies are counted for each set's lowest hashes only. A set keeps its prefix elements that another
   set also has; sets without one have no partner and are done. So are those of which less than t occurs elsewhere.
3. Sets with the same prefix and size form a group, checked against its leader; members that fail leave it.
4. Groups meet over (prefix element, size band). Only groups in different components meet, in rounds whose pivots per
   list grow: first a few in crowded lists, so that the near copies of one text become one component at a few checks
   each, then stretches of all lists until every pair of a list that is still apart has met. A pair is filtered first by
   its place in the prefix and by a bound on the symmetric difference (``WORDS``), then checked by its leaders, then expanded to members.

Set ids are 64-bit hashes, the copy test compares 128 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqedge.llm.common import cut, fresh, quoted, release, table
from seqedge.llm.graph import components

SHINGLE, PERCENT = 5, 80
#: Part of all hashes whose frequency is counted. A set's prefix is about a fifth of it at 80 %.
REGION = 0.25
LOW = int(REGION * 2**64) - 2**63
#: Lists of a group in the first round: the most crowded ones.
CROWDS = 2
#: Groups of a list that are asked for its largest component.
DRAWN = 5
#: Longs of a set's parity bits: bit i says whether an odd number of its hashes falls on i. Two sets' parity bits differ in
#: at most as many places as their symmetric difference has elements, so too many differing places rule a link out.
WORDS = 8
CHUNK = 2 << 20

_FOLD = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint64) + np.uint64(1)
_SPACE = np.array([c == 32 or 9 <= c <= 13 for c in range(256)])
_BASE = 0x9E3779B97F4A7C15 | 1
_TABLES: list[np.ndarray] = []


def _mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of murmur hash: fixed values."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if not _TABLES or len(_TABLES[0]) < n:
        made = []
        for base in (_BASE, pow(_BASE, -1, 2**64)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        _TABLES[:] = made
    return _TABLES[0], _TABLES[1]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text in a buffer of bytes.

    Every word's hash is a polynomial of its bytes, from prefix sums over the whole buffer; a shingle combines k of them.
    """
    n = len(data)
    if not n:
        return [np.empty(0, np.int64)] * (len(offsets) - 1)
    solid = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before, after = np.concatenate(([False], solid[:-1])), np.concatenate((solid[1:], [False]))
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    power, inverse = _powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_FOLD[data] * power[:n], out=sums[1:])
    word = _mix((sums[ends] - sums[starts]) * inverse[starts] ^ (ends - starts).astype(np.uint64) * np.uint64(_BASE))
    places = [_mix(word + np.uint64((i + 1) * 0xD6E8FEB86659FD93 % 2**64)) for i in range(k)]
    full = np.zeros(max(0, len(word) - k + 1), np.uint64)
    for i in range(k):
        full += places[i][i : i + len(full)]
    full = _mix(full).view(np.int64)
    first = np.searchsorted(starts, offsets)
    out = []
    for b, e in zip(first[:-1].tolist(), first[1:].tolist()):
        if e - b >= k:
            out.append(np.unique(full[b : e - k + 1]))
        elif e > b:
            whole = sum(int(places[i][b + i]) for i in range(e - b)) + (e - b) % 2**64
            out.append(_mix(np.array([whole % 2**64], np.uint64)).view(np.int64))
        else:
            out.append(np.empty(0, np.int64))
    return out


def _texts(column: pa.Array):
    """Buffers of about CHUNK bytes over whole texts of a string column: (bytes, offsets)."""
    column = pa.concat_arrays([column.cast(pa.large_binary())])  # offsets of 64 bits
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.empty(0, np.uint8)
    b = 0
    while b < len(column):
        e = max(b + 1, int(np.searchsorted(offsets, offsets[b] + CHUNK, "right")) - 1)
        yield data[offsets[b] : offsets[e]], offsets[b : e + 1] - offsets[b]
        b = e


def needed(n, percent: int = PERCENT):
    """Elements that a partner must share with a set of n: ceil(n percent / 100)."""
    return -(-n * percent // 100)


def set_ids(elements: np.ndarray) -> tuple[int, int]:
    u = elements.view(np.uint64)
    return tuple(int(np.add.reduce(_mix(u ^ np.uint64(s)), dtype=np.uint64).astype(np.int64)) for s in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB))


def sketch(docs: DataFrame, key: str, text: str, percent: int) -> DataFrame:
    """(key, n, s1, s2, e): the set's size, its ids, and its hashes below LOW, or the lowest up to its prefix length."""

    def run(batches):
        for batch in batches:
            n, s1, s2, low = [], [], [], []
            for data, offsets in _texts(batch.column(1)):
                for x in shingle_sets(data, offsets):
                    a, b = set_ids(x)
                    n.append(len(x))
                    s1.append(a)
                    s2.append(b)
                    low.append(x[: max(int(np.searchsorted(x, LOW)), len(x) - needed(len(x), percent) + 1)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()),
                                              pa.array(low, pa.list_(pa.int64()))], names=["key", "n", "s1", "s2", "e"])

    kind = docs.select(quoted(key)).dtypes[0][1]
    return docs.select(quoted(key).alias("key"), quoted(text).alias("t")).mapInArrow(run, f"key {kind}, n long, s1 long, s2 long, e array<long>")


def parity(elements: np.ndarray) -> np.ndarray:
    odd = np.bincount(elements & (64 * WORDS - 1), minlength=64 * WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def may_link(n: Column, wa: str, wb: str, percent: int) -> Column:
    """False only where the sets of parity bits ``wa``, ``wb`` cannot link; ``n`` is the sum of both sizes. J >= t holds
    only if the symmetric difference is at most (1 - t) / (1 + t) of that sum."""
    apart = sum((F.bit_count(F.col(wa)[i].bitwiseXOR(F.col(wb)[i])) for i in range(WORDS)), F.lit(0))
    return (100 + percent) * apart <= (100 - percent) * n


def full_sets(docs: DataFrame) -> DataFrame:
    """(s, x, w): set id, all its hashes and its parity bits, of texts ``t``."""

    def run(batches):
        for batch in batches:
            ids, sets, bits = [], [], []
            for data, offsets in _texts(batch.column(0)):
                for x in shingle_sets(data, offsets):
                    ids.append(set_ids(x)[0])
                    sets.append(x)
                    bits.append(parity(x))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64()))], names=["s", "x", "w"])

    return docs.select("t").mapInArrow(run, "s long, x array<long>, w array<long>")


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b and what else they carry) whose sets link."""
    left, right = sets.select(F.col("s").alias("a"), F.col("x").alias("xa")), sets.select(F.col("s").alias("b"), F.col("x").alias("xb"))
    both = F.size(F.array_intersect("xa", "xb"))
    shared = pairs.join(left, "a").join(right, "b").withColumn("both", both)
    return shared.filter(100 * F.col("both") >= percent * (F.size("xa") + F.size("xb") - F.col("both"))).drop("xa", "xb", "both")


def prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """(s, n, p): of each set that may have a partner, its prefix elements that another set has, in the common order."""
    found = sets.select("s", "n", F.size("e").alias("m"), F.explode("e").alias("h"))
    shared = cut(sets.select(F.explode("e").alias("h")).groupBy("h").agg(F.count("*").alias("df")).filter("df > 1"), "shared")
    release(sets.sparkSession)
    inside = F.col("h") < LOW
    mine = found.join(shared, "h").groupBy("s", "n", "m").agg(F.array_sort(F.collect_list(
        F.struct(~inside, F.when(inside, F.col("df")).otherwise(0).alias("df"), "h"))).alias("p"))
    # Elements of this set alone are the rarest and take the first places.
    slots = F.col("n") - needed_sql(F.col("n"), percent) + 1 - (F.col("m") - F.size("p"))
    return mine.withColumn("slots", slots.cast("int")).filter("slots > 0").select("s", "n", F.expr("transform(slice(p, 1, slots), x -> x.h)").alias("p"))


def peeled(full: DataFrame, percent: int) -> DataFrame:
    """The sets (s, x, w) that share so many elements with any others that a partner is possible: a partner holds
    ``percent`` of a set, so as many of its elements occur in at least two sets. This drops what only has a passage in
    common with others."""
    full = cut(full, "candidate-sets")
    release(full.sparkSession)
    # each shuffle of all elements is let go before the next one, so that one of them is on disk at a time
    shared = cut(full.select(F.explode("x").alias("h")).groupBy("h").agg(F.count("*").alias("df")).filter("df > 1").select("h"), "shared-elements")
    release(full.sparkSession)
    mine = full.select("s", F.size("x").alias("n"), F.explode("x").alias("h")).join(shared, "h", "left_semi").groupBy("s", "n").agg(F.count("*").alias("c"))
    kept = cut(mine.filter(100 * F.col("c") >= percent * F.col("n")).select("s"), "kept-sets")
    release(full.sparkSession)
    return full.join(kept, "s", "left_semi")


def needed_sql(n: Column, percent: int) -> Column:
    return F.floor((n * percent + 99) / 100)


def band(n: Column, percent: int) -> Column:
    """Sizes of a pair over the limit lie in the same band or in neighbouring ones (bands are 4 % wider than the ratio)."""
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(104.0 / percent))).cast("long")


def links(sets: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """(node, component) of the sets that link with another, from ``sets`` (s, n, e, rep) and the texts (key, t)."""
    spark = sets.sparkSession
    kept = cut(prefixes(sets, percent), "prefixes")
    release(spark)
    by_prefix = Window.partitionBy("n", "p")
    grouped = cut(kept.withColumn("g", F.min("s").over(by_prefix)), "groups")
    heads = grouped.filter("s = g")
    b = band(F.col("n"), percent)
    lists = heads.select("g", "n", b.alias("band"), F.explode("p").alias("h")).withColumn("k", F.explode(F.array("band", F.col("band") + 1)))
    met = lists.groupBy("h", "k").agg(F.count("*").alias("c"), F.max(F.col("band") == F.col("k")).alias("own")).filter("c > 1 and own").select("h", "k")
    lists = lists.join(met, ["h", "k"], "left_semi")
    some = lists.select("g").unionByName(grouped.filter("s <> g").select("g")).distinct()
    wanted = cut(grouped.join(some, "g", "left_semi").select("s", "g", "n", "p"), "candidates")
    release(spark)
    reps = sets.join(wanted.select("s"), "s", "left_semi").select("rep").distinct()
    texts = docs.join(reps, F.col("key").eqNullSafe(F.col("rep")), "left_semi")
    full = cut(peeled(full_sets(texts).join(wanted.select("s"), "s", "left_semi").groupBy("s").agg(F.first("x").alias("x"), F.first("w").alias("w")), percent), "sets")
    wanted = wanted.join(full.select("s", "w"), "s").withColumn("g", F.min("s").over(by_prefix)).withColumn("gw", F.min_by("w", "s").over(by_prefix))

    release(spark)
    # 3. members against their leaders; who fails is a group of its own
    star = cut(linked(wanted.filter("s <> g").filter(may_link(2 * F.col("n"), "w", "gw", percent)).select(F.col("g").alias("a"), F.col("s").alias("b")), full, percent), "links")
    nodes = cut(wanted.join(star.select(F.col("b").alias("s"), F.lit(True).alias("in")), "s", "left")
                .select("s", F.when((F.col("s") == F.col("g")) | F.col("in"), F.col("g")).otherwise(F.col("s")).alias("g"), "n", "p", "w"), "nodes")
    # 4. groups meet. A member differs from its leader by at most a link's share of 2 n, so by the triangle inequality
    # leaders whose members link differ by at most a link's share of the sum of their ``reach``.
    many = cut(nodes.groupBy("g").agg(F.count("*").alias("members")).filter("members > 1").select("g", F.lit(3).alias("times")), "many")
    reach = (F.col("n") * F.coalesce("times", F.lit(1))).alias("reach")
    entries = nodes.filter("s = g").join(many, "g", "left").select("g", "n", "w", reach, band(F.col("n"), percent).alias("band"), F.posexplode("p").alias("at", "h"))
    entries = cut(entries.withColumn("k", F.explode(F.array("band", F.col("band") + 1))).select(
        "g", "n", "w", "reach", (F.col("n") - F.col("at")).alias("left"), "h", "k", (F.col("band") == F.col("k")).alias("own"),
        (F.shiftrightunsigned(F.xxhash64("g"), 11) / float(1 << 53)).alias("u")), "entries")
    lists = cut(entries.groupBy("h", "k").agg(F.count("*").alias("size"), F.max("own").alias("any")).filter("size > 1 and any").drop("any"), "lists")
    spread = cut(entries.join(lists, ["h", "k"]), "spread")
    other = nodes.filter("s = g").join(many, "g", "left").select(F.col("g").alias("b"), reach.alias("rb"), F.col("w").alias("wg"))
    top = F.slice(F.sort_array(F.collect_list(F.struct("size", "h", "k")), False), 1, CROWDS)
    crowded = spread.join(spread.groupBy("g").agg(top.alias("t")).select("g", F.explode("t").alias("t")).select("g", "t.h", "t.k"), ["g", "h", "k"], "left_semi")
    longest = lists.agg(F.max("size")).first()[0] or 0
    # before the first round no two leaders are linked: each is its own component
    found, labels, grown, several = star.select("a", "b"), None, False, bool(many.take(1))
    for whole, lo, hi in turns(longest):
        release(spark)
        if grown:
            labels = cut(components(found), "labels")
            found, grown = labels.select(F.col("node").alias("a"), F.col("component").alias("b")), False
        pairs = meetings(spread if whole else crowded, labels, lo, hi, percent)
        if pairs is None and whole:  # every list has one component: what can be linked is
            break
        if pairs is None:
            continue
        grown = bool(pairs.take(1))
        if not grown:
            continue
        yes = cut(linked(pairs, full, percent), "links")
        found = found.unionByName(yes.select("a", "b"))
        if not several:
            continue
        # expand what the leaders did not link, where a group has more members
        rest = pairs.join(yes, ["a", "b"], "left_anti")
        rest = rest.join(many.select(F.col("g").alias("a")), "a", "left_semi").unionByName(rest.join(many.select(F.col("g").alias("b")), "b", "left_semi")).distinct()
        ma, mb = (nodes.select(F.col("g").alias(x), F.col("s").alias("m" + x), F.col("n").alias("n" + x), F.col("w").alias("w" + x)) for x in "ab")
        near = rest.join(other, "b").join(ma, "a").filter(may_link(F.col("na") + F.col("rb"), "wa", "wg", percent)).drop("rb", "wg")
        expanded = (near.join(mb, "b").filter("ma <> a or mb <> b").filter(may_link(F.col("na") + F.col("nb"), "wa", "wb", percent))
                    .select(F.col("ma").alias("a"), F.col("mb").alias("b")))
        found = found.unionByName(linked(expanded, full, percent).select("a", "b"))
    return components(found) if grown or labels is None else labels


def turns(longest: int):
    """(whole lists?, from, to): the rounds' stretches of a list, in which its pivots lie.

    First, some pivots in each group's most crowded lists only, to make one component of the near copies of a text at
    a cost of a few checks each. Then, in all lists, stretches that cover them whole and grow as fewer components are left.
    """
    yield False, 0, 8
    lo, hi = 0, 64
    while lo < longest:
        yield True, lo, hi
        lo, hi = hi, hi * 64


def meetings(lists: DataFrame, labels: DataFrame | None, lo: int, hi: int, percent: int) -> DataFrame | None:
    """Pairs of groups (a, b) of different components that may link: in each list, the groups whose places (by a hash, so
    that no list need be sorted) lie in [lo, hi) meet all groups of other components. None: no list has two components.

    Pivots of the list's largest component only meet the groups outside it; so the work is what is left to be checked.
    A pair whose first common element is the list's shares at most what both have from there on; in its other
    lists this bound may drop the pair, as it is kept there if it can link.
    """
    if labels is None:
        labelled = lists.withColumn("c", F.col("g"))
    else:
        labelled = lists.join(labels.withColumnRenamed("node", "g"), "g", "left").withColumn("c", F.coalesce("component", "g")).drop("component")
    # the largest component is that of most of some groups drawn by hashes; another choice would only mean more work
    drawn = F.array(*[F.min_by("c", F.xxhash64("g", F.lit(i))) for i in range(DRAWN)])
    votes = lambda a: F.transform(a, lambda x: F.struct(F.size(F.filter(a, lambda y: y == x)).alias("n"), x.alias("c")))
    open_ = labelled.groupBy("h", "k").agg(drawn.alias("drawn"), F.min("c").alias("least"), F.max("c").alias("greatest"), F.max("own").alias("any"))
    open_ = cut(open_.filter("least < greatest and any").select("h", "k", F.array_max(votes(F.col("drawn")))["c"].alias("most")), "open")
    if not open_.take(1):
        return None
    alive = labelled.join(open_, ["h", "k"]).withColumn("out", F.col("c") != F.col("most"))
    place = F.floor(F.col("u") * F.col("size"))
    pivots = alive.filter((place >= lo) & (place < hi)).select("h", "k", F.col("out").alias("z"), *[F.col(x).alias("p" + x) for x in ("g", "n", "w", "reach", "left", "own", "c")])
    sides = F.when(F.col("out"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True)))
    all_ = alive.select("h", "k", F.explode(sides).alias("z"), "g", "n", "w", "reach", "left", "own", "c")
    apart = ((F.col("c") != F.col("pc")) & (F.col("own") | F.col("pown")) & (100 * F.least("n", "pn") >= percent * F.greatest("n", "pn"))
             & ((100 + percent) * F.least("left", "pleft") >= percent * (F.col("n") + F.col("pn"))) & may_link(F.col("reach") + F.col("preach"), "w", "pw", percent))
    met = all_.join(pivots, ["h", "k", "z"]).filter(apart)
    return cut(met.select(F.least("g", "pg").alias("a"), F.greatest("g", "pg").alias("b")).distinct(), "pairs")


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """(key, n_shingles, component_id) per input row.

    Null and empty texts have no shingles and are their own component. Null keys are ignored by the smallest key
    (null, if there is no other); repeated rows, and equal keys, are judged by their texts one by one; an empty table
    gives no rows; other columns play no part.
    """
    # the hashes are made twice, so that only those of distinct sets are kept on disk
    made = sketch(docs, key, text, percent)
    rows = cut(made.drop("e"), "sketch")
    sets = cut(made.filter("n > 0").groupBy("s1", "s2").agg(F.min("key").alias("rep"), F.first("n").alias("n"), F.first("e").alias("e"))
               .withColumnRenamed("s1", "s"), "distinct-sets")
    release(docs.sparkSession)
    label = links(sets, docs.select(quoted(key).alias("key"), quoted(text).alias("t")), percent)
    mine = sets.select("s", "s2", "rep").join(label.withColumnRenamed("node", "s"), "s", "left").withColumn("component", F.coalesce("component", "s"))
    least = mine.groupBy("component").agg(F.min("rep").alias("component_id"))
    names = cut(mine.join(least, "component").select(F.col("s").alias("s1"), "s2", "component_id"), "names")
    return rows.select("key", "n", "s1", "s2").join(names, ["s1", "s2"], "left").select(
        F.col("key").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("key")).otherwise(F.col("component_id")).alias("component_id"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each component, the one with the smallest key. Rows with equal key and text are
    one; rows without a key all stay. Columns stay as they are."""
    first = classes(docs, key, text, percent).select(F.col(key).alias("k"), "component_id").filter("k = component_id").select("k").distinct()
    h, = fresh(docs, "h")
    alone = docs.filter(quoted(key).isNull())
    kept = docs.join(first, quoted(key) == F.col("k"), "left_semi").withColumn(h, F.xxhash64(quoted(text)))
    return kept.dropDuplicates([key, h]).select(*[quoted(c) for c in docs.columns]).unionByName(alone)


def op4_grouped_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


def brute_force(rows: list[tuple[int, str | None]], percent: int = PERCENT) -> dict[int, tuple[int, int]]:
    """doc_id -> (n_shingles, component_id), comparing all pairs; for tests. Keys must be unique."""
    sets, root = {}, {}
    for k, t in rows:
        ws = (t or "").encode().lower().split()
        sets[k] = {tuple(ws[i : i + SHINGLE]) for i in range(max(1, len(ws) - SHINGLE + 1))} if ws else set()
        root[k] = k

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((top(a), top(b)))
                root[q] = p
    return {k: (len(sets[k]), top(k)) for k in keys}
