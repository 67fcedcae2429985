"""The fixtures of FIXTURES.md (FX1-FX19), each against its hand-worked result."""

import math

import pytest
from pyspark.sql import functions as F

from seqedge.functions.dna import reverse_complement
from seqedge.operators import genome, matrix, metrics, network, pairs, runs, sampling, tokens
from seqedge.operators import motifs


def _prior_fx1(spark):
    rows = [("YAL068C", "YBR112C", 0.0), ("YAL068C", "YBR150C", 1.0), ("YAL068C", "Fake_TF", 0.0),
            ("YAL068C", "YBR239C", 1.0), ("YAL067C", "YBR112C", 0.0), ("YAL067C", "YBR150C", 0.0),
            ("YAL067C", "Fake_TF", 1.0), ("YAL067C", "YBR239C", 1.0)]
    prior = spark.createDataFrame(rows, "gene string, tf string, value double")
    genes = spark.createDataFrame([("YAL068C", "AAA"), ("YAL067C", "TTT"), ("YAL066W", "GGG")],
                                  "gene string, sequence string")
    tfs = spark.createDataFrame([("YBR112C", "ATC"), ("YBR112C", "CCCC"), ("YBR150C", "GTGT"),
                                 ("YBR239C", "ACACAC")], "tf string, sequence string")
    return prior, genes, tfs


def test_fx1_pair_dataset(spark):
    prior, genes, tfs = _prior_fx1(spark)
    got = {tuple(r) for r in pairs.build(prior, genes, tfs, 0.5).select("gene", "tf", "tf_dna", "interaction").collect()}
    assert got == {("YAL068C", "YBR150C", "GTGT", 1), ("YAL068C", "YBR239C", "ACACAC", 1),
                   ("YAL068C", "YBR112C", "ATC", 0), ("YAL068C", "YBR112C", "CCCC", 0),
                   ("YAL067C", "YBR239C", "ACACAC", 1), ("YAL067C", "YBR112C", "ATC", 0),
                   ("YAL067C", "YBR112C", "CCCC", 0), ("YAL067C", "YBR150C", "GTGT", 0)}


def test_fx1_missing_report_and_downsample(spark):
    prior, genes, tfs = _prior_fx1(spark)
    rep = {tuple(r) for r in pairs.missing_report(prior, genes, tfs).collect()}
    assert rep == {("tf", "Fake_TF")}
    ds = pairs.build(prior, genes, tfs, 0.5)
    out = sampling.downsample_negatives(ds, 0.5, "interaction", seed=1, ids=["gene", "tf", "tf_dna"])
    counts = {r["interaction"]: r["n"] for r in out.groupBy("interaction").agg(F.count("*").alias("n")).collect()}
    assert counts == {1: 3, 0: 2}  # int(5 * 0.5) = 2 negatives, all 3 positives


def test_fx1_split_disjoint_complete_exact(spark):
    prior, genes, tfs = _prior_fx1(spark)
    ds = pairs.build(prior, genes, tfs, 0.5)
    s = sampling.split(ds, 0.5, seed=3, ids=["gene", "tf", "tf_dna"]).collect()
    train = [r for r in s if r["split"] == "train"]
    assert len(s) == 8 and len(train) == math.floor(8 * 0.5)
    by_gene = sampling.split(ds, 0.5, seed=3, by=["gene"]).collect()
    sides = {}
    for r in by_gene:
        sides.setdefault(r["gene"], set()).add(r["split"])
    assert all(len(v) == 1 for v in sides.values()) and len(by_gene) == 8


FX2_IN = [([1, 2, 3, 4, 5, 1, 1, 1], [1, 1, 1, 1, 1, 0, 0, 0]), ([1, 2, 3], [1, 1, 1]), ([1, 2, 3, 1], [1, 1, 1, 0])]


def test_fx2_collate(spark):
    df = spark.createDataFrame([(0, i, m, n) for n, (i, m) in enumerate(FX2_IN)],
                               "batch int, input_ids array<int>, attention_mask array<int>, n int")
    got = [(r["input_ids"], r["attention_mask"]) for r in tokens.collate(df, "batch").orderBy("n").collect()]
    assert got == [([1, 2, 3, 4, 5], [1, 1, 1, 1, 1]), ([1, 2, 3, 1, 1], [1, 1, 1, 0, 0]),
                   ([1, 2, 3, 1, 1], [1, 1, 1, 0, 0])]


def test_fx3_remove_padding(spark):
    df = spark.createDataFrame([(i, m, n) for n, (i, m) in enumerate(FX2_IN)],
                               "input_ids array<int>, attention_mask array<int>, n int")
    got = [(r["input_ids"], r["attention_mask"]) for r in tokens.remove_padding(df).orderBy("n").collect()]
    assert got == [([1, 2, 3, 4, 5], [1] * 5), ([1, 2, 3], [1] * 3), ([1, 2, 3], [1] * 3)]


@pytest.mark.parametrize("drop_last,expected", [
    (True, [[0, 6, 2, 4], [0, 3, 2, 1]]),
    (False, [[0, 6, 2, 4], [0, 3, 2, 1], [0, 5]]),
])
def test_fx4_even_class_batches(spark, drop_last, expected):
    # the shuffled order is injected: positives 0 2, negatives 6 4 3 1 5
    order = {0: 0, 2: 1, 6: 0, 4: 1, 3: 2, 1: 3, 5: 4}
    rows = [(str(i), 1 if i in (0, 2) else 0, order[i]) for i in range(7)]
    df = spark.createDataFrame(rows, "id string, label int, o int")
    out = sampling.even_class_batches(df, 4, drop_last, label="label", id_col="id", order="o").collect()
    batches = {}
    for r in out:
        batches.setdefault(r["batch"], {})[r["slot"]] = int(r["id"])
    got = [[b[s] for s in sorted(b)] for _, b in sorted(batches.items())]
    assert got == expected
    assert len(got) == sampling.even_class_batch_count(2, 5, 4, drop_last)


def test_fx4_odd_batch_size_is_error(spark):
    df = spark.createDataFrame([("a", 1)], "id string, label int")
    with pytest.raises(ValueError):
        sampling.even_class_batches(df, 3, True)


def test_fx5_flatten_options(spark):
    df = spark.createDataFrame([((1,), 2)], "a struct<b:int>, c int").select(F.struct("a", "c").alias("cfg"))
    assert runs.flatten_options(df, "cfg").first()["options"] == ["a.b=1", "c=2"]


# Rows 1-10 of a PWM file of the motif corpus (FX6).
FX6_ROWS = [
    (1, 0.421052631578947, 0.207017543859649, 0.136842105263158, 0.235087719298246),
    (2, 0.135278514588859, 0.16710875331565, 0.474801061007958, 0.222811671087533),
    (3, 0.443069306930693, 0.215346534653465, 0.178217821782178, 0.163366336633663),
    (4, 0.962365591397849, 0.0376344086021505, 0.0, 0.0),
    (5, 0.0, 1.0, 0.0, 0.0),
    (6, 0.774891774891775, 0.0, 0.225108225108225, 0.0),
    (7, 0.817351598173516, 0.0, 0.182648401826484, 0.0),
    (8, 0.0, 0.182648401826484, 0.0, 0.817351598173516),
    (9, 0.494736842105263, 0.0105263157894737, 0.447368421052632, 0.0473684210526316),
    (10, 0.0167597765363128, 0.290502793296089, 0.581005586592179, 0.111731843575419),
]


def test_fx6_pwm_files_and_summary(spark, scratch):
    from seqedge.sources.readers import read_pwms

    with open(f"{scratch}/M05768_2.00.txt", "w") as f:
        f.write("Pos\tA\tC\tG\tT\n")
        for r in FX6_ROWS:
            f.write("\t".join(str(x) for x in r) + "\n")
    with open(f"{scratch}/M00001_2.00.txt", "w") as f:
        f.write("Pos\tA\tC\tG\tT\n")
    pwm = read_pwms(spark, scratch)
    s = {r["motif_id"]: r for r in motifs.summarize(pwm).collect()}
    assert set(s) == {"M05768_2.00", "M00001_2.00"}
    m = s["M05768_2.00"]
    h = [-sum(p * math.log2(p) for p in r[1:] if p > 0) for r in FX6_ROWS]
    assert m["Length"] == 10
    assert m["Shannon_Entropy"] == pytest.approx(sum(h), abs=1e-9)
    assert m["Information_Content"] == pytest.approx(sum(2 - x for x in h), abs=1e-9)
    assert m["Consensus"] == "NNNACAATRG"
    empty = s["M00001_2.00"]
    assert empty["Length"] == 0 and empty["Consensus"] is None


def test_fx7_extract_intervals(spark):
    g = spark.createDataFrame([("c", "ACGTACGTAA")], "contig string, seq string")
    chunks = genome.chunk_contigs(g, 4)
    f = spark.createDataFrame([("c", 1, 1, 1), ("c", 4, 5, 2), ("c", 3, 10, 3), ("x", 1, 2, 4)],
                              "contig string, start long, stop long, n int")
    got = [r["sequence"] for r in genome.extract_intervals(f, chunks, 4).orderBy("n").collect()]
    assert got == ["A", "TA", "GTACGTAA", None]


def test_fx8_promoters(spark):
    g = spark.createDataFrame([("c", "AAACCCGGGT")], "contig string, seq string")
    chunks = genome.chunk_contigs(g, 4)
    f = spark.createDataFrame([("c", 5, 5, "+", 1), ("c", 6, 6, "-", 2), ("c", 2, 2, "+", 3), ("c", 9, 9, "-", 4)],
                              "contig string, start long, stop long, strand string, n int")
    got = [r["promoter_sequence"] for r in genome.promoters(f, chunks, width=3, chunk=4).orderBy("n").collect()]
    assert got == ["ACC", "CCC", "AA", "A"]


def test_fx9_reverse_complement(spark):
    df = spark.createDataFrame([("ACGTNWSacgtRYKMBDHV",)], "s string")
    r = df.select(reverse_complement("s").alias("r"), reverse_complement(reverse_complement("s")).alias("rr")).first()
    assert r["r"] == "BDHVKMRYacgtSWNACGT" and r["rr"] == "ACGTNWSacgtRYKMBDHV"


def test_fx10_tokens(spark):
    df = spark.createDataFrame([("ACGTACGTNNACGTAC",)], "formatted_inputs string")
    toks = df.select(F.regexp_extract_all("formatted_inputs", F.lit(tokens.token_pattern(6)), 1).alias("t")).first()
    assert toks["t"] == ["ACGTAC", "G", "T", "N", "N", "ACGTAC"]
    ids = tokens.tokenize(df, k=6, max_length=5, padding=True).first()
    assert ids["input_ids"][0] == tokens.CLS_ID and len(ids["input_ids"]) == 5
    assert ids["attention_mask"] == [1, 1, 1, 1, 1]


FX11 = [(0.9, 1), (0.8, 1), (0.8, 0), (0.4, 1), (0.2, 0), (0.1, 0)]


def test_fx11_best_f1_and_auc(spark):
    df = spark.createDataFrame(FX11, "p double, y int")
    r = metrics.ranking_summary(df, "p", "y").first()
    assert r["best_f1"] == pytest.approx(6 / 7) and r["best_threshold"] == pytest.approx(0.4)
    assert r["roc_auc"] == pytest.approx(7.5 / 9)


def test_fx12_one_class(spark):
    df = spark.createDataFrame([(0.3, 0), (0.6, 0)], "p double, y int")
    r = metrics.ranking_summary(df, "p", "y").first()
    assert r["roc_auc"] is None and r["best_f1"] == 0.0 and r["best_threshold"] == 0.0


def test_fx13_nan_prior(spark):
    prior = spark.createDataFrame([("g", "a", float("nan")), ("g", "b", None), ("g", "c", 0.5)],
                                  "gene string, tf string, value double")
    genes = spark.createDataFrame([("g", "AAA")], "gene string, sequence string")
    tfs = spark.createDataFrame([(t, "CC") for t in "abc"], "tf string, sequence string")
    got = [(r["tf"], r["interaction"]) for r in pairs.build(prior, genes, tfs, 0.5).collect()]
    assert got == [("c", 1)]


def test_fx14_edges_to_matrix(spark):
    e = spark.createDataFrame([("t1", "g1"), ("t1", "g1"), ("t2", "g2")], "tf string, gene string")
    d = network.density(e).first()
    assert (d["n_genes"], d["n_tfs"], d["n_ones"], d["n_zeros"]) == (2, 2, 2, 2)
    w = {r["gene"]: (r["t1"], r["t2"]) for r in network.to_matrix(e).collect()}
    assert w == {"g1": (1, 0), "g2": (0, 1)}


def test_fx15_histogram(spark):
    df = spark.createDataFrame([(0.0,), (5.0,), (10.0,)], "x double")
    h = [r["n"] for r in genome.length_histogram(df, "x", bins=2, length=False).orderBy("bin").collect()]
    assert h == [1, 2]


def test_fx16_weighted_log_loss(spark):
    df = spark.createDataFrame([(1.0, 0.5), (0.0, 0.5)], "y double, p double")
    r = metrics.weighted_log_loss(df, "y", "p", w0=0.7, w1=1.0).first()
    assert r["loss"] == pytest.approx(0.85 * math.log(2))


def test_fx17_pivot_mean(spark):
    df = spark.createDataFrame([("g1", "t1", 0.2), ("g1", "t1", 0.4), ("g2", "t2", 1.0)],
                               "gene string, tf string, value double")
    w = {r["gene"]: (round(r["t1"], 9), r["t2"]) for r in matrix.pivot_mean(df, "gene", "tf", "value", ["t1", "t2"]).collect()}
    assert w == {"g1": (0.3, 0.0), "g2": (0.0, 1.0)}


def test_fx18_refresh_block(spark):
    old = spark.createDataFrame([(f"g{i}", f"t{j}", 0.0) for i in range(10) for j in range(10)],
                                "gene string, tf string, value double")
    new = old.withColumn("value", F.lit(1.0))
    out = matrix.refresh_block(old, new, 0.99, seed=4)
    assert out.count() == 100 and out.filter("value = 1.0").count() == 1


def test_fx19_grid(spark):
    g = runs.grid(spark)
    assert g.count() == 400
    assert g.filter("run = 0").first()["run_name"] == "batching-cw_0.1_1.0-dsr_0.1-gas_16"
    assert g.select("run_name").distinct().count() == 400
