"""Forms that hold at scale: ranks by ranges, exact samples without caches, lists in parts, wide files without a pivot,
refresh without a full join, caches split by size, united sketches, the factorised classifier, restarted rounds."""

import contextlib
import glob
import io
import os
import re

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from seqedge.operators import lists, matrix, motifs, network, pairs, ranking, runs, sampling, scoring, tokens
from seqedge.plans import standins as S
from seqedge.sources import readers, writers

SF = "/root/testdata/sf0.001"


def plan_of(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_range_rank_equals_row_number_with_prefix_ties_copies_and_groups(spark):
    ids = [f"SAME_LONG_PREFIX_{i % 37:05d}" for i in range(600)] + [None] * 3
    df = spark.createDataFrame([(g, x, i % 5) for i, x in enumerate(ids) for g in (["a"] if i % 3 else ["a", "b"])], "g string, id string, v int")
    for by in ([], ["g"]):
        got = sorted(map(tuple, ranking.range_rank(df, "id", by=by, ties=["v"]).collect()), key=str)
        order = Window.partitionBy(*by).orderBy("id", "v", *([] if by else ["g"]))
        want = sorted(map(tuple, df.withColumn("rank", F.row_number().over(order).cast("long")).collect()), key=str)
        assert got == want
    distinct = df.select("id").distinct()
    assert sorted(r["rank"] for r in ranking.range_rank(distinct, "id", collapse_copies=False).collect()) == list(range(1, 39))
    assert ranking.range_rank(df.limit(0), "id").count() == 0


def test_no_range_holds_much_more_than_the_mean(spark, monkeypatch):
    """A common prefix, and one key with a third of all rows, still make even ranges."""
    seen = []
    real = ranking.cut
    monkeypatch.setattr(ranking, "cut", lambda df, name: seen.append(real(df, name)) or seen[-1])
    df = spark.range(30_000).select(F.concat(F.lit("PREFIX_OF_ALL_"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).cast("string")).alias("id"), "id")
    df = df.toDF("key", "no")
    out = ranking.range_rank(df, "key", ranges=16)
    sizes = [r["n"] for r in seen[0].groupBy(ranking._B).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) >= 14 and max(sizes) <= 3 * 30_000 / 16 and out.agg(F.max("rank")).first()[0] == 30_000


def test_running_sums_over_raw_keys(spark):
    df = spark.createDataFrame([(f"K{i:03d}", 10 * i) for i in range(50)], "k string, w long")
    got = {r["k"]: r["before"] for r in ranking.range_running_sum(df, "k", "w").collect()}
    assert got == {f"K{i:03d}": sum(10 * j for j in range(i)) for i in range(50)}


def test_samples_leave_nothing_cached_and_shuffle_no_row(spark):
    spark.catalog.clearCache()
    ev = S.table(spark, SF, "events").select("event_id", "event_type")
    out = sampling.split(ev, 0.3, seed=2, ids=["event_id"])
    assert "Exchange" not in plan_of(out) and out.filter("split = 'train'").count() == int(ev.count() * 0.3)
    assert spark.sparkContext._jsc.getPersistentRDDs().isEmpty()


def test_select_first_n_takes_some_of_rows_with_equal_order_columns(spark):
    rows = [("a", i % 4, i) for i in range(40)] + [("b", 1, 7)] * 10
    df = spark.createDataFrame(rows, "g string, id int, v int").withColumn("k", ranking.order_key(1, "id"))
    for by in ([], ["g"]):
        for share in (0.0, 0.33, 0.7, 1.0):
            f = ranking.select_first_n(df, "k", lambda t, s=share: F.floor(t * s), by=by, ties=["id"])
            got = {r[0]: r[1] for r in f.filter("selected").groupBy(F.col("g") if by else F.lit("all")).count().collect()}
            sizes = {"a": 40, "b": 10} if by else {"all": 50}
            assert got == {g: int(n * share) for g, n in sizes.items() if int(n * share)} and f.count() == 50


def test_refresh_moves_only_the_cells_of_the_block(spark):
    cells = [(f"g{i}", f"t{j}", float(i)) for i in range(20) for j in range(20)] + [(None, "t1", 5.0), ("g1", None, 6.0)]
    old = spark.createDataFrame(cells, "gene string, tf string, value double").repartition(3)
    new = old.withColumn("value", F.lit(-1.0))
    for out, changed in ((matrix.refresh_block(old, new, 0.75, seed=3), 100), (matrix.refresh_pairs(old, new, 6, seed=3), 6)):
        assert out.count() == 402 and out.filter("value = -1").count() == changed
        lines = plan_of(out).splitlines()
        at = next(i for i, line in enumerate(lines) if "Union" in line)
        column = lines[at].index("Union")
        end = next(i for i in range(at + 1, len(lines)) if lines[i][column:].startswith("+- "))
        assert end > at + 1 and not any("hashpartitioning" in line for line in lines[at + 1 : end])  # the cells outside are mapped


def test_lists_of_a_hot_key_come_in_bounded_parts(spark):
    df = spark.range(25_000).select(F.when(F.col("id") % 5 == 0, F.concat(F.lit("t"), F.col("id").cast("string"))).otherwise("hot").alias("tf"),
                                    F.col("id").cast("string").alias("sequence"))
    parts = motifs.sequence_parts(df, size=1_000)
    sizes = parts.filter("tf = 'hot'").select("part", F.size("sequences").alias("n")).orderBy("part").collect()
    assert [tuple(r) for r in sizes] == [(i, 1_000) for i in range(20)]
    whole = [s for r in parts.filter("tf = 'hot'").orderBy("part").collect() for s in r["sequences"]]
    assert whole == sorted(str(i) for i in range(25_000) if i % 5)
    assert lists.items(parts, "sequence", "sequences").count() == 25_000
    with pytest.raises(Exception, match="more than 5000 items"):
        motifs.group_sequences(df, max_items=5_000).collect()
    assert re.search(r"hashpartitioning\(tf#\d+, part#\d+", plan_of(parts))  # lists are put together by key and part


def test_wide_file_of_20000_columns(spark, scratch):
    cells = spark.range(60_000).select((F.col("id") % 3).cast("string").alias("gene"), F.concat(F.lit("T"), F.col("id") % 20_000).alias("tf"), (F.col("id") % 7).cast("double").alias("value"))
    cells = cells.filter("value <> 3")
    path = scratch + "/wide"
    writers.write_wide(cells, path, fill=None)
    back = readers.read_matrix(spark, path)
    assert back.count() == 3 * cells.select("tf").distinct().count()
    assert sorted(map(tuple, back.filter("value is not null").collect())) == sorted(map(tuple, cells.collect()))


def test_wide_file_forms(spark, scratch):
    long = spark.createDataFrame([("g2", "b", 2.0), ("g1", "a", 1.0), ("g1", "c", None), ("g2", "b", 5.0), (None, "a", 1.0), ("g1", None, 1.0)], "gene string, tf string, value double")
    writers.write_wide(long, scratch + "/a")
    lines = sorted(line for f in glob.glob(scratch + "/a/part-*") for line in open(f).read().splitlines())
    assert set(lines) == {"\ta\tb\tc", "g1\t1.0\t0.0\t0.0", "g2\t0.0\t5.0\t0.0"}
    writers.write_wide(long, scratch + "/b", columns=["c", "a", "z"], fill=None)
    lines = {line for f in glob.glob(scratch + "/b/part-*") for line in open(f).read().splitlines()}
    assert lines == {"\tc\ta\tz", "g1\t\t1.0\t", "g2\t\t\t"}
    with pytest.raises(Exception, match="not a plain key"):
        writers.write_wide(long.withColumn("gene", F.concat("gene", F.lit("\t"))), scratch + "/c")
    for f, text in (("x.tsv", '\tA\t"B"\r\n"g1"\t1\tNaN\r\n\ng2\t\t2.5\ng3\t7\n'),):
        open(f"{scratch}/{f}", "w").write(text)
    got = sorted(map(tuple, readers.read_matrix(spark, f"{scratch}/x.tsv").collect()), key=str)
    assert got == sorted([("g1", "A", 1.0), ("g1", "B", None), ("g2", "A", None), ("g2", "B", 2.5), ("g3", "A", 7.0), ("g3", "B", None)], key=str)


def test_cache_files_stay_below_the_limit_and_hold_whole_keys(spark, scratch):
    ids = lambda n: F.sequence(F.lit(1), n)
    rows = spark.range(4_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 90).cast("string")).alias("gene"), F.lit("t").alias("tf"),
                                     ids(F.lit(20)).alias("input_ids"), F.array_repeat(F.lit(1), 20).alias("attention_mask"))
    cache = tokens.cache_parts(rows, size=100)
    path, limit = scratch + "/cache", 300_000
    tokens.write_cache(cache, path, max_bytes=limit)
    files = glob.glob(path + "/*/*.parquet")
    assert len(files) > 2 and max(map(os.path.getsize, files)) <= limit
    back = spark.read.parquet(path)
    assert back.groupBy("gene", "tf").agg(F.count_distinct(tokens.FILE).alias("n")).filter("n > 1").count() == 0
    assert tokens.load_tokens(spark, path).columns == cache.columns and back.agg(F.sum(F.size("seqs"))).first()[0] == 4_000
    with pytest.raises(ValueError, match="does not fit"):
        tokens.write_cache(cache, path + "2", max_bytes=1_000)


def test_sketches_of_runs_unite(spark):
    edges = spark.range(60_000).select((F.col("id") % 4).alias("run"), F.concat(F.lit("t"), F.col("id") % 500).alias("tf"), F.concat(F.lit("g"), F.col("id") % 20_011).alias("gene"))
    stored = network.sketches(edges, ["run"])
    got, exact = network.unite_sketches(stored).first(), network.summary(edges).first()
    assert got["n_rows"] == 60_000
    for c in ("n_tfs", "n_genes", "n_edges"):
        assert abs(got[c] - exact[c]) <= network.SKETCH_ERROR * exact[c]
    assert network.unite_sketches(stored, ["run"]).count() == 4


def test_pairs_carry_no_gene_dna_through_a_shuffle_but_the_gene_tables(spark):
    """Every exchange below the join that adds the DNA is of ids, TF sequences, or the gene table itself."""
    out = pairs.build(S.prior(spark, SF), S.genes(spark, SF), S.tf_seqs(spark, SF))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join Inner" in line]
    assert len(joins) == 2 and "gene#" in joins[0] and "tf#" in joins[1]


def test_classifier_steps_equal_explicit_vectors(spark):
    rng = np.random.default_rng(2)
    seq = lambda n: "".join(rng.choice(list("ACGT"), n))
    genes, tfs = [seq(30) for _ in range(6)], [seq(9) for _ in range(4)] + ["A"]
    rows = [(g, t, float(rng.choice([0, 1, 0.3]))) for g in genes for t in tfs] + [(genes[0], tfs[0], 1.0)] * 3
    p = spark.createDataFrame([*rows, (None, tfs[0], 1.0), (genes[1], tfs[1], None)], "gene_dna string, tf_dna string, label double")
    k, w0, w1, reg = 2, 0.3, 1.0, 0.01
    mers = sorted({s[i : i + k] for s in genes + tfs for i in range(len(s) - k + 1)})
    share = {s: np.array([sum(s[i : i + k] == m for i in range(len(s) - k + 1)) / max(1, len(s) - k + 1) for m in mers]) for s in genes + tfs}
    x = np.array([np.append(share[g] + share[t], 1.0) for g, t, _ in rows])
    y = np.array([r[2] for r in rows])
    w, v, rate = np.zeros(x.shape[1]), np.zeros(x.shape[1]), 1 / (0.25 * 5 + reg)
    for i in range(6):
        prob = 1 / (1 + np.exp(-x @ v))
        d = x.T @ (w1 * y * (prob - 1) + w0 * (1 - y) * prob) / len(y) + reg * np.append(v[:-1], 0)
        old, w = w, v - rate * d
        v = w + i / (i + 3) * (w - old)
    model = scoring.fit_edge_classifier(p, k=k, class_weights=(w0, w1), max_iter=6, reg=reg)
    assert np.allclose([model.weights[m] for m in mers] + [model.intercept], w, atol=1e-12)
    got = scoring.predict_edges(model, p.withColumn("id", F.monotonically_increasing_id())).collect()
    assert len(got) == len(rows) + 2 and sum(r["score"] is None for r in got) == 1
    with pytest.raises(ValueError):
        scoring.fit_edge_classifier(p, k=9)


def test_shipped_model_scores_a_batch_as_the_native_scorer(spark):
    rows = [("ACGTACGT", "ACG"), ("ACGTACGT", "TTTT"), ("AC", "ACG"), ("ACGTTTTT", "GTTT"), (None, "ACG"), ("ACGT", None), ("ACGT", "A"), ("", "ACGT")]
    p = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "gene int, gene_dna string, tf_dna string")
    got = {r["gene"]: r["score"] for r in scoring.score_pairs(p, lambda: scoring.KmerShareModel(k=3), keys=("gene",)).collect()}
    want = {r["gene"]: r["score"] for r in scoring.kmer_overlap(p, k=3).collect()}
    nan = lambda v: v is None or v != v
    assert nan(got[4]) and all(nan(got[i]) if nan(want[i]) else got[i] == want[i] for i in range(len(rows)) if i != 4)


def test_rounds_go_on_where_they_stopped(spark, scratch, monkeypatch):
    args = (spark, S.prior(spark, SF), S.genes(spark, SF), S.tf_seqs(spark, SF))
    calls = []

    def scorer(p):
        calls.append(1)
        return scoring.kmer_overlap(p, k=4)

    whole = [tuple(r) for r in runs.iterate(*args, scorer, n_rounds=2, digits=9).collect()]
    monkeypatch.setattr("seqedge.operators.metrics.evaluate_against_prior", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError, match="killed"):  # after the predictions of round 0 were written
        runs.iterate(*args, scorer, n_rounds=2, digits=9, workdir=scratch + "/run")
    monkeypatch.undo()
    n = len(calls)
    again = [tuple(r) for r in runs.iterate(*args, scorer, n_rounds=2, digits=9, workdir=scratch + "/run").collect()]
    assert again == whole
    n = len(calls)
    assert [tuple(r) for r in runs.iterate(*args, scorer, n_rounds=2, digits=9, workdir=scratch + "/run").collect()] == whole and len(calls) == n
    with pytest.raises(ValueError, match="was run with threshold"):
        runs.iterate(*args, scorer, n_rounds=1, threshold=0.7, workdir=scratch + "/run")


def test_classifier_vectors_are_a_row_a_sequence(spark):
    """a step joins a row a sequence, whatever its k-mers, and edges beyond one row are all counted."""
    seqs = spark.createDataFrame([("ACGTACG",), ("ACGTACG",), ("AAAA",), ("AC",), (None,)], "sequence string")
    vectors, names = scoring.kmer_vectors(seqs, 3)
    got = {r["n"]: {names[m]: c for m, c in zip(r["mers"], r["counts"])} for r in vectors.collect()}
    assert got == {5: {"ACG": 2, "CGT": 1, "GTA": 1, "TAC": 1}, 2: {"AAA": 2}}
    pairs = spark.createDataFrame([("AAAA", f"CCC{t}", t % 2) for t in range(40)], "gene_dna string, tf_dna string, label int")
    before = scoring.EDGES
    try:
        whole = scoring.fit_edge_classifier(pairs, k=3, max_iter=3)
        scoring.EDGES = 7
        assert scoring.fit_edge_classifier(pairs, k=3, max_iter=3).weights == pytest.approx(whole.weights)
    finally:
        scoring.EDGES = before


def test_stored_cells_of_a_wide_matrix_are_read_without_the_blank_ones(spark, scratch):
    """the same cells as the whole grid gives, from compressed files that do not grow with the blanks."""
    long = spark.createDataFrame([(f"g{i}", f"t{(i * 37 + j * 311) % 4000}", float(i + j)) for i in range(300) for j in range(9)], "gene string, tf string, value double")
    writers.write_wide(long, scratch + "/m", fill=None, compression="gzip")
    got = readers.read_matrix(spark, scratch + "/m", blanks=False)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, long.distinct().collect()))
    assert sum(os.path.getsize(f) for f in glob.glob(scratch + "/m/part-*")) < 300 * 4000 / 4
    with open(scratch + "/odd.tsv", "w") as f:
        f.write('\t"a"\tb\tc\n"r"\t1\t\t NaN\nq\t\t \t3\t4\nz\n\n\t5\n')
    whole = readers.read_matrix(spark, scratch + "/odd.tsv").filter(F.col("value").isNotNull()).collect()
    odd = readers.read_matrix(spark, scratch + "/odd.tsv", blanks=False).filter(F.col("value").isNotNull()).collect()
    assert {tuple(r) for r in odd} == {tuple(r) for r in whole} == {("r", "a", 1.0), ("q", "c", 3.0), (None, "a", 5.0)}


def test_offsets_of_groups_are_written_before_they_are_joined(spark, monkeypatch):
    """their size is known before the rows would be shuffled for the join."""
    names, cut = [], ranking.cut
    monkeypatch.setattr(ranking, "cut", lambda df, name: (names.append(name), cut(df, name))[1])
    rows = spark.range(200).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"))
    ranked = ranking.range_rank(rows, "v", by=["k"], collapse_copies=False)
    assert names == ["ranges", "range-counts"]
    assert {(r["k"], r["v"]): r["rank"] for r in ranked.collect()} == {(i % 3, i): i // 3 + 1 for i in range(200)}


def test_no_cell_of_a_wide_matrix_carries_its_line(spark, scratch):
    """a line was copied for each of its cells, so work grew with the cells times the columns."""
    with open(scratch + "/m.tsv", "w") as f:
        f.write("\ta\tb\nr\t1\t2\n")
    plan = readers.read_matrix(spark, scratch + "/m.tsv", blanks=False)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = next(i for i, line in enumerate(plan) if "Generate explode" in line)
    assert "value#" not in plan[at] and "Project" in plan[at + 1] and "_cells" in plan[at + 1]
    assert sum("regexp_extract_all" in line for line in plan) == 1  # nor are a line's cells found twice


def test_long_runs_of_blank_cells_and_lines_with_marks_of_their_own(spark, scratch):
    """cells keep their columns where runs are shortened, and where a line has the characters that stand for runs."""
    n = 9_000
    at = [1, 2, 63, 64, 65, 66, 127, 128, 129, 193, 4095, 4096, 4097, 4161, 8257, 8999, 9000]
    rows = {"g": {i: i / 8 for i in at}, "": {5: 1.0, 5000: 2.0}, "a\x01\x02\x01b": {64: 3.0, 4160: 4.0}, "last": {9000: 5.0}, "none": {}}
    with open(scratch + "/m.tsv", "w") as f:
        f.write("\t" + "\t".join(f"t{i}" for i in range(1, n + 1)) + "\n")
        for k, v in rows.items():
            f.write(k + "".join("\t" + str(v.get(i, "")) for i in range(1, n + 1)) + "\n")
        f.write("mark" + "\t" * 70 + "\x01" + "7\n" + "short" + "\t" * 4096 + "8\n")  # control characters are no part of a number
    got = readers.read_matrix(spark, scratch + "/m.tsv", blanks=False).filter(F.col("value").isNotNull())
    want = {(k or None, f"t{i}", x) for k, v in rows.items() for i, x in v.items()}
    assert {tuple(r) for r in got.collect()} == want | {("mark", "t70", 7.0), ("short", "t4096", 8.0)}
