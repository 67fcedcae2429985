"""What is kept on disk, shuffled and written file by file: forms that grow with the input only."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqedge.llm import jaccard
from seqedge.operators import pairs, tokens
from seqedge.plans import queries_more
from seqedge.sources import readers, writers


def _tables(spark):
    prior = spark.createDataFrame([("G1", "T1", 0.9), ("G2", "T1", 0.1), ("G2", "T2", 0.7), ("G3", "T2", 0.2), ("G1", "T9", 1.0)], "gene string, tf string, value double")
    genes = spark.createDataFrame([("G1", "ACGTACGTN"), ("G2", "A" * 80), ("G2", "C"), ("G4", "ACGT")], "gene string, sequence string")
    tfs = spark.createDataFrame([("T1", "ACGTAC"), ("T1", "ACGTAC"), ("T1", "ANG"), ("T2", ""), (None, "A"), ("T2", None)], "tf string, sequence string")
    return prior, genes, tfs


def _rows(df):
    return sorted(tuple(r) for r in df.select("gene", "tf", "tf_dna", "input_ids", "attention_mask").collect())


def test_pairs_keep_the_ids_of_their_tf(spark):
    prior, genes, tfs = _tables(spark)
    keys = pairs.build_keys(prior, tfs=tokens.with_sequence_ids(pairs.distinct_tf_sequences(tfs), k=6))
    text = pairs.build(prior, genes, tfs).withColumn("formatted_inputs", tokens.format_pair("gene_dna", "tf_dna"))
    for options in ({"max_length": 8, "padding": True}, {"max_length": 8}, {"max_length": 64, "padding": True}, {}, {"max_length": 8, "padding": True, "add_cls": False}):
        got = tokens.tokenize_pairs(keys, genes=pairs.unique_genes(genes), **options)
        assert got.columns[:3] == ["tf", "tf_dna", "gene"] and tokens.TF_IDS not in got.columns
        assert _rows(got) == _rows(tokens.tokenize(text, **options)) and got.count() == 5
        joins = got._jdf.queryExecution().optimizedPlan().toString().count("Join Inner")
        assert joins == 2  # the TFs' table and the genes' table, once each


def test_one_file_a_key_over_all_tasks(spark, tmp_path):
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pwm = spark.range(200).coalesce(1).select(F.concat(F.lit("M"), F.floor(F.col("id") / 4).cast("string")).alias("motif_id"), (F.col("id") % 4 + 1).cast("int").alias("pos"),
                                              *[F.lit(0.25).alias(b) for b in "ACGT"])
    path = str(tmp_path / "pwm")
    writers.file_per_key(pwm, "motif_id").option("sep", "\t").option("header", True).csv(path)
    files = list((tmp_path / "pwm").glob("motif_id=*/part-*.csv"))
    tasks = {f.name.split("-")[1] for f in files}
    assert len(files) == 50 and (n == 1 or 1 < len(tasks) <= n)
    got = readers.read_pwms(spark, path, layout="partitioned")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, pwm.collect()))


def test_hashes_are_kept_of_distinct_sets_only(spark, monkeypatch):
    written, whole = {}, jaccard.cut
    monkeypatch.setattr(jaccard, "cut", lambda df, name: written.setdefault(name, df.columns) and whole(df, name))
    words = [f"w{i}" for i in range(40)]
    rows = [(1, " ".join(words)), (2, " ".join(words)), (3, " ".join(words[:39])), (4, "other words stand in this text"), (5, None), (6, "")]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == jaccard.brute_force(rows)
    assert written["sketch"] == ["key", "n", "s1", "s2"]


def test_a_file_for_each_motif_is_written_and_listed_in_bounded_parts(spark, scratch, monkeypatch):
    """Driver memory must not grow with the motifs: no read lists more than a part's files, and all motifs come out."""
    rows = [(i, [float((i * j) % 7 + 1) for j in range(1, 65)], i % 3) for i in range(40)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").write.parquet(f"{scratch}/embeddings.parquet")
    listed, real = [], readers.read_pwms
    monkeypatch.setattr(writers, "FILES_AT_ONCE", 10)

    def seen(spark, path, **kw):
        listed.append(len(spark.read.text(path).inputFiles()))
        return real(spark, path, **kw)

    monkeypatch.setattr(readers, "read_pwms", seen)
    got = {r["motif_id"]: tuple(r)[1:] for r in queries_more.q_io_pwm_corpus(spark, scratch).collect()}
    want = {r["motif_id"]: tuple(r)[1:] for r in queries_more.q_motifs_summarize(spark, scratch).collect()}
    assert got == want | {f"H{i}": (None, None, 0, None) for i in range(3)}
    assert sum(listed) == 43 and len(listed) == 5 and max(listed) < 25


def test_parts_of_keys_are_whole_and_keep_null_keys(spark, monkeypatch):
    monkeypatch.setattr(writers, "FILES_AT_ONCE", 4)
    df = spark.range(60).select(F.when(F.col("id") % 20 > 0, F.col("id") % 20).alias("k"), "id")
    parts = [[tuple(r) for r in p.collect()] for p in writers.key_batches(df, "k")]
    assert len(parts) == 5 and sorted(i for p in parts for _, i in p) == list(range(60))
    assert sum(len({k for k, _ in p}) for p in parts) == 20
    assert [p.count() for p in writers.key_batches(df.limit(0), "k")] == [0]
