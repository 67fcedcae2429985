"""What is read several times is made once, and only keys cross the shuffles that look keys up."""

import pytest
from pyspark.sql import functions as F

from seqedge.functions.arrays import array_sum
from seqedge.operators import metrics, runs, sampling, scoring, tokens
from seqedge.plans import queries_more

SF = "/root/testdata/sf0.001"


def counted(df, acc):
    def run(batches):
        for b in batches:
            acc.add(b.num_rows)
            yield b

    return df.mapInArrow(run, df.schema)


def test_a_split_and_a_sample_make_their_rows_once(spark):
    acc = spark.sparkContext.accumulator(0)
    df = counted(spark.range(100).withColumn("interaction", (F.col("id") % 4 == 0).cast("int")), acc)
    assert sampling.split(df, 0.8, ids=["id"]).filter("split = 'train'").count() == 80 and acc.value == 100
    assert sampling.downsample_negatives(df, 0.4, ids=["id"]).count() == 25 + 30 and acc.value == 200


def test_appends_make_the_predictions_once(spark, monkeypatch):
    names, real = [], queries_more.cut
    monkeypatch.setattr(queries_more, "cut", lambda df, name: names.append(name) or real(df, name))
    got = queries_more.q_io_jsonl_roundtrip(spark, SF)
    assert names == ["predictions"] and got.count() == got.distinct().count() > 0


def test_merged_caches_match_keys_without_tokens(spark):
    plan = queries_more.q_tokens_merge_cache(spark, SF)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    joins = [i for i, line in enumerate(plan) if "Join LeftSemi" in line]
    assert joins
    for i in joins:
        for line in plan[i + 1:]:
            if depth(line) <= depth(plan[i]):
                break
            assert "input_ids" not in line


def test_pairs_come_out_as_before_when_genes_are_joined_last(spark):
    pairs = spark.createDataFrame([("g", "t", "ACGTACGT", 1), ("x", "t", "ACGTACGT", 0)], "gene string, tf string, tf_dna string, interaction int")
    genes = spark.createDataFrame([("g", "ACGTACAA")], "gene string, gene_dna string")
    got = tokens.tokenize_pairs(pairs, genes=genes, tfs=pairs.select("tf", "tf_dna").distinct())
    assert got.columns == ["tf", "tf_dna", "gene", "interaction", "input_ids", "attention_mask"]
    plan = got._jdf.queryExecution().optimizedPlan().toString().splitlines()
    outer, inner = [line for line in plan if "Join Inner" in line]
    assert "gene#" in outer and "tf_dna#" in inner
    row, = got.collect()
    assert row["input_ids"][0] == 3 and len(row["input_ids"]) == 1 + 3 + 1 + 3


@pytest.mark.parametrize("items, total", [([1, 1, 0], 2), ([0], 0), ([], 0), ([2, 3], 5), ([-1, 1], 0), ([1, None], None), ([3], 3), (None, None)])
def test_sum_of_masks_and_of_other_arrays(spark, items, total):
    assert spark.createDataFrame([(items,)], "a array<int>").select(array_sum("a")).first()[0] == total


def test_score_of_a_pair_without_a_gene_sequence(spark):
    rows = [("AACC", "AAC"), (None, "AAC"), ("AACC", "AA"), ("AACC", None), ("AACC", "AACG")]
    got = [r["score"] for r in scoring.kmer_overlap(spark.createDataFrame(rows, "gene_dna string, tf_dna string"), k=3).collect()]
    assert got == [1.0, 0.0, None, None, 0.5]


def test_only_unshared_keys_are_looked_up(spark, monkeypatch):
    seen, real = {}, metrics.cut
    monkeypatch.setattr(metrics, "cut", lambda df, name: seen.setdefault(name, real(df, name)))
    pred = spark.createDataFrame([("a", "t", .9), ("a", "u", .2), ("b", "t", .6), ("c", "t", .7), ("a", "v", .8), (None, "t", .5)], "gene string, tf string, value double")
    gold = spark.createDataFrame([("a", "t", 1.), ("b", "u", 1.), ("d", "t", 1.), (None, "t", 1.)], "gene string, tf string, value double")
    got = metrics.auprc_vs_gold(pred, gold).first()
    assert (got["n_pos"], got["n_neg"]) == (2, 2)  # a, b x t, u
    want = metrics.ranking_summary(spark.createDataFrame([(.9, 1), (.2, 0), (.6, 0), (0., 1)], "s double, y int"), "s", "y").first()
    assert got["auprc"] == pytest.approx(want["auprc"]) and got["roc_auc"] == pytest.approx(want["roc_auc"])
    assert {tuple(r) for r in seen["unshared-keys"].collect()} == {(0, "c"), (0, "d"), (1, "v")}


def test_rounds_make_the_prior_and_the_gold_matrix_once(spark):
    one, two = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    cells = spark.createDataFrame([("g", "t", .9), ("g", "u", .1), ("h", "t", .2), ("h", "u", .7)], "gene string, tf string, value double")
    genes = spark.createDataFrame([("g", "ACGTACGT"), ("h", "TTTTACGG")], "gene string, sequence string")
    tfs = spark.createDataFrame([("t", "ACGTA"), ("u", "TTTTA")], "tf string, sequence string")
    out = runs.iterate(spark, counted(cells, one), genes, tfs, lambda p: scoring.kmer_overlap(p, k=4), n_rounds=2, gold=counted(cells, two))
    assert out.count() == 2 and (one.value, two.value) == (4, 4)


def test_shuffles_of_all_elements_are_cut_from_each_other(spark, monkeypatch):
    from seqedge.llm import jaccard

    names, real = [], jaccard.cut
    monkeypatch.setattr(jaccard, "cut", lambda df, name: names.append(name) or real(df, name))
    sets = spark.createDataFrame([(1, list(range(10)), [0] * 8), (2, list(range(10)), [0] * 8), (3, [0, *range(20, 29)], [0] * 8)], "s long, x array<long>, w array<long>")
    assert {r["s"] for r in jaccard.peeled(sets, 80).collect()} == {1, 2}
    assert names == ["candidate-sets", "shared-elements", "kept-sets"]


def test_rounds_keep_no_copy_of_matrices_that_are_in_files(spark, monkeypatch):
    """each round put all cells of the predictions and of the gold matrix into the cache, though both are read from files."""
    kept = []
    cells = spark.createDataFrame([("g", "t", .9), ("g", "u", .1), ("h", "t", .2), ("h", "u", .7), (None, "u", .3)], "gene string, tf string, value double")
    real = type(cells).persist
    monkeypatch.setattr(type(cells), "persist", lambda self, *a: kept.append(self.columns) or real(self, *a))
    genes = spark.createDataFrame([("g", "ACGTACGT"), ("h", "TTTTACGG")], "gene string, sequence string")
    tfs = spark.createDataFrame([("t", "ACGTA"), ("u", "TTTTA")], "tf string, sequence string")
    out = runs.iterate(spark, cells, genes, tfs, lambda p: scoring.kmer_overlap(p, k=4), n_rounds=2, gold=cells)
    assert out.count() == 2 and kept and all("gene" not in c for c in kept)
    assert metrics.auprc_vs_gold(cells, cells, stored=True).collect() == metrics.auprc_vs_gold(cells, cells).collect()
    assert ["gene", "tf", "value"] in kept
