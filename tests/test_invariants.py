"""Invariants: exact sizes, partition independence,
bucketed ranks equal to a global row_number, bounds on metrics."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from seqedge.functions.numeric import binarize
from seqedge.operators import genome, metrics, network, ranking, sampling, scoring
from seqedge.plans import standins as S
from seqedge.sources import writers

SF = "/root/testdata/sf0.001"


def test_prefix_rank_equals_row_number(spark):
    ev = S.table(spark, SF, "events").select("event_id").withColumn("k", ranking.order_key(9, "event_id"))
    ours = {r["event_id"]: r["rank"] for r in ranking.prefix_rank(ev, "k", ties=["event_id"], digits=2).collect()}
    ref = {r["event_id"]: r["r"] for r in ev.select(
        "event_id", F.row_number().over(Window.orderBy("k", "event_id")).alias("r")).collect()}
    assert ours == ref


@pytest.mark.parametrize("parts", [1, 7])
def test_sample_independent_of_partitioning(spark, parts):
    ev = S.table(spark, SF, "events").select("event_id", "event_type").repartition(parts)
    s = sampling.split(ev, 0.3, seed=2, ids=["event_id"])
    train = sorted(r["event_id"] for r in s.filter("split = 'train'").collect())
    base = sampling.split(S.table(spark, SF, "events").select("event_id", "event_type"), 0.3, seed=2, ids=["event_id"])
    assert train == sorted(r["event_id"] for r in base.filter("split = 'train'").collect())
    n = ev.count()
    assert len(train) == int(n * 0.3) and s.count() == n


def test_select_first_n_exact_per_group(spark):
    ev = S.table(spark, SF, "events").withColumn("k", ranking.order_key(1, "event_id"))
    f = ranking.select_first_n(ev, "k", lambda t: F.floor(t * 0.25), by=["event_type"], ties=["event_id"],
                               digits=1)
    got = {r["event_type"]: r["n"] for r in f.filter("selected").groupBy("event_type").agg(F.count("*").alias("n")).collect()}
    tot = {r["event_type"]: r["n"] for r in ev.groupBy("event_type").agg(F.count("*").alias("n")).collect()}
    assert got == {k: int(v * 0.25) for k, v in tot.items()}


def test_running_totals_match_global_window(spark):
    sc = S.scored_events(spark, SF)
    g = ranking.tie_groups(sc, "score", "label")
    ours = {r["score"]: (r["pos_cum"], r["neg_cum"]) for r in ranking.running_totals(g, "score", ["pos", "neg"], n_buckets=7).collect()}
    w = Window.orderBy(F.col("score").desc())
    ref = {r["score"]: (r["a"], r["b"]) for r in g.select("score", F.sum("pos").over(w).alias("a"),
                                                         F.sum("neg").over(w).alias("b")).collect()}
    assert ours == ref


def test_auc_in_unit_interval_and_all_equal_scores(spark):
    r = metrics.ranking_summary(S.scored_events(spark, SF), "score", "label").first()
    assert 0.0 <= r["roc_auc"] <= 1.0 and 0.0 <= r["auprc"] <= 1.0
    same = spark.createDataFrame([(0.5, 1), (0.5, 0), (0.5, 0)], "p double, y int")
    assert metrics.ranking_summary(same, "p", "y").first()["roc_auc"] == pytest.approx(0.5)


def test_chunked_extraction_equals_substring(spark):
    contigs = S.contigs(spark, SF)
    feats = S.features(spark, SF)
    for chunk in (7, 1000):
        ex = genome.extract_intervals(feats, genome.chunk_contigs(contigs, chunk), chunk)
        ref = feats.join(contigs, "contig", "left").select(
            "gene_id", F.expr("substring(seq, start, stop - start + 1)").alias("r"))
        bad = ex.join(ref, "gene_id").filter(~F.col("sequence").eqNullSafe(F.col("r")))
        assert bad.count() == 0


def test_keep_first_handles_hot_key(spark):
    # a third of the rows share one key; min_by reduces it map-side
    rows = [("hot", i) for i in range(300)] + [(f"k{i}", i) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, v int").repartition(8)
    out = {r["k"]: r["v"] for r in sampling.keep_first(df, ["k"], ["v"]).collect()}
    assert out["hot"] == 0 and len(out) == 601


def test_copies_holding_a_third_of_rows(spark):
    # 300 identical rows + 600 distinct ones: ranks stay 1..900 and exact
    # samples keep their size although the copies share one order key.
    rows = [("dup", 0)] * 300 + [(f"k{i}", i) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, v int").withColumn("o", ranking.order_key(5, "k", "v"))
    ranks = sorted(r["rank"] for r in ranking.prefix_rank(df, "o", digits=1).collect())
    assert ranks == list(range(1, 901))
    for share in (0.1, 0.5, 0.9):
        f = ranking.select_first_n(df, "o", lambda t, s=share: F.floor(t * s), digits=1)
        assert f.filter("selected").count() == int(900 * share) and f.count() == 900


def test_running_totals_split_clustered_scores(spark):
    # most distinct scores sit in a tiny range: the heavy bucket is sliced
    # again and the running sums still equal a global window
    vals = [(1000.0 + i * 1e-6, 1, 0) for i in range(400)] + [(float(i), 0, 1) for i in range(50)]
    g = spark.createDataFrame(vals, "score double, pos long, neg long")
    ours = {r["score"]: (r["pos_cum"], r["neg_cum"]) for r in ranking.running_totals(g, "score", ["pos", "neg"], n_buckets=8).collect()}
    w = Window.orderBy(F.col("score").desc())
    ref = {r["score"]: (r["a"], r["b"]) for r in g.select("score", F.sum("pos").over(w).alias("a"),
                                                         F.sum("neg").over(w).alias("b")).collect()}
    assert ours == ref


def test_nan_is_null(spark):
    nan = float("nan")
    df = spark.createDataFrame([(nan, 1, "g", "t"), (0.9, 1, "g", "t"), (0.1, 0, "g", "u")], "score double, label int, gene string, tf string")
    assert [r[0] for r in df.select(binarize("score", 0.5)).collect()] == [None, 1, 0]
    assert metrics.ranking_summary(df, "score", "label").first()["roc_auc"] == 1.0
    assert {r["tf"]: r["prediction"] for r in scoring.mean_by_pair(df).collect()} == {"t": 0.9, "u": 0.1}
    pred = spark.createDataFrame([("g", "t", 0.9), ("g", "t", 0.7), ("h", "u", 0.2), ("g", "u", nan)], "gene string, tf string, value double")
    gold = spark.createDataFrame([("g", "t", 1.0), ("g", "t", 1.0), ("h", "u", nan)], "gene string, tf string, value double")
    r = metrics.auprc_vs_gold(pred, gold).first()
    assert (r["n_pos"], r["n_neg"]) == (1, 3)


def test_even_batches_threshold_and_long_orders(spark):
    rows = [(i, v, o) for i, (v, o) in enumerate([(0.1, "y"), (0.9, "b"), (0.2, "x" * 20 + "2"), (0.0, "x" * 20 + "1")])]
    df = spark.createDataFrame(rows, "id int, label double, o string")
    got = [(r["batch"], r["slot"], r["id"]) for r in sampling.even_class_batches(df, 2, False, order="o").orderBy("batch", "slot").collect()]
    assert got == [(0, 0, "1"), (0, 1, "3"), (1, 0, "1"), (1, 1, "2"), (2, 0, "1"), (2, 1, "0")]
    nums = df.withColumn("n", F.col("id") * -100)
    got = [r["id"] for r in sampling.even_class_batches(nums, 2, False, order="n").filter("slot = 1").orderBy("batch").collect()]
    assert got == ["3", "2", "0"]


def test_wide_matrix_dotted_names_and_bounds(spark, scratch):
    e = spark.createDataFrame([("g", "t.1"), ("g", "u"), ("h", "u")], "gene string, tf string")
    assert {tuple(r) for r in network.to_matrix(e).collect()} == {("g", 1, 1), ("h", 0, 1)}
    writers.write_wide(e.withColumn("value", F.lit(2.0)), scratch + "/wide")
    with pytest.raises(ValueError):
        writers.write_summary(e, scratch + "/summary")
    spark.conf.set("spark.sql.pivotMaxValues", "1")
    try:
        with pytest.raises(ValueError):
            network.to_matrix(e)
    finally:
        spark.conf.unset("spark.sql.pivotMaxValues")


def test_kmers_and_pieces_by_brute_force(spark):
    from seqedge.functions.dna import kmers
    from seqedge.operators.genome import pieces

    texts = [None, "", "AC", "ACG", "ACGT\nACGTT", "ACGTN" * 200]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string").select("i", kmers("s", 3).alias("k"), pieces("s", 4).alias("p"))
    for r in got.collect():
        t = texts[r["i"]] or ""
        assert r["k"] == [t[j:j + 3] for j in range(len(t) - 2)]
        assert r["p"] == ([None] if texts[r["i"]] is None else [t[j:j + 4] for j in range(0, max(1, len(t)), 4)])


def test_tokenize_pairs_with_two_sequences_of_a_gene(spark):
    from seqedge.operators import tokens

    rows = [("g", "ACGTAC", "t", "AA"), ("g", "TTTTTTA", "t", "AA"), ("g", "ACGTAC", "t", "CC")]
    df = spark.createDataFrame(rows, "gene string, gene_dna string, tf string, tf_dna string")
    want = tokens.tokenize(df.withColumn("formatted_inputs", tokens.format_pair("gene_dna", "tf_dna")))
    got = tokens.tokenize_pairs(df)
    assert sorted((r["tf_dna"], r["input_ids"]) for r in got.collect()) == sorted((r["tf_dna"], r["input_ids"]) for r in want.collect())
