"""Streaming running means over prediction shards, and reader edge cases."""

import json
import os

import pytest

from seqedge.sources import readers
from seqedge.streaming.predictions import start_mean_by_pair


def test_stream_mean_by_pair(spark, scratch):
    src = os.path.join(scratch, "in")
    os.makedirs(src)
    with open(os.path.join(src, "a.jsonl"), "w") as f:
        for g, t, p in [("g1", "t1", 0.2), ("g1", "t1", 0.4), ("g2", "t2", 1.0)]:
            f.write(json.dumps({"gene_id": g, "DBID": t, "prediction": p}) + "\n")
    q = start_mean_by_pair(spark, src, os.path.join(scratch, "ckpt"), query_name="fx17_means")
    try:
        q.processAllAvailable()
        with open(os.path.join(src, "b.jsonl"), "w") as f:
            f.write(json.dumps({"gene_id": "g2", "DBID": "t2", "prediction": 0.0}) + "\n")
        q.processAllAvailable()
        got = {(r["gene"], r["tf"]): (round(r["prediction"], 9), r["n"])
               for r in spark.sql("SELECT * FROM fx17_means").collect()}
    finally:
        q.stop()
    assert got == {("g1", "t1"): (0.3, 2), ("g2", "t2"): (0.5, 2)}


def test_read_matrix_blank_header_nan_and_blank(spark, scratch):
    p = os.path.join(scratch, "m.tsv")
    with open(p, "w") as f:
        f.write("\tT1\tT2\nG1\t1\tNaN\nG2\t\t0.5\n")
    got = {(r["gene"], r["tf"]): r["value"] for r in readers.read_matrix(spark, p).collect()}
    assert got == {("G1", "T1"): 1.0, ("G1", "T2"): None, ("G2", "T1"): None, ("G2", "T2"): 0.5}


def test_read_gtf_skips_headers_and_extracts_attribute(spark, scratch):
    p = os.path.join(scratch, "a.gtf")
    with open(p, "w") as f:
        f.write("#!genome-build x\n#!genome-version y\n")
        f.write('I\tsgd\tgene\t335\t649\t.\t+\t.\tgene_id "YAL069W"; gene_name "ABC1";\n')
        f.write('I\tsgd\texon\t538\t792\t.\t-\t.\tgene_id "YAL068W-A";\n')
    rows = readers.read_gtf(spark, p, "gene_name").orderBy("start").collect()
    assert [(r["contig"], r["start"], r["stop"], r["strand"], r["category"], r["gene_id"]) for r in rows] == [
        ("I", 335, 649, "+", "gene", "ABC1"), ("I", 538, 792, "-", "exon", None)]


def test_read_fasta_multiline(spark, scratch):
    p = os.path.join(scratch, "g.fa")
    with open(p, "w") as f:
        f.write(">chrI some description\nACGT\nACGT\nAA\n>chrII\nTTTT\n")
    recs = {r["contig"]: r["seq"] for r in readers.read_fasta_records(spark, p).collect()}
    assert recs == {"chrI": "ACGTACGTAA", "chrII": "TTTT"}
    chunks = readers.read_fasta(spark, p, chunk=4).orderBy("contig", "chunk").collect()
    assert [(r["contig"], r["chunk"], r["offset"], r["seq"]) for r in chunks] == [
        ("chrI", 0, 0, "ACGT"), ("chrI", 1, 4, "ACGT"), ("chrI", 2, 8, "AA"), ("chrII", 0, 0, "TTTT")]


def test_read_fasta_over_splits(spark, scratch):
    """A contig over many splits, a '>' inside a header, an empty record, CRLF, and a long unwrapped line."""
    import random

    rng = random.Random(5)
    want = {n: "".join(rng.choice("ACGT") for _ in range(k)) for n, k in [("chr1", 7013), ("chr2", 0), ("chr3", 501), ("chr4", 2600)]}
    p = os.path.join(scratch, "g.fa")
    with open(p, "w", newline="") as f:
        f.write("stray line\n")
        for n, s in want.items():
            f.write(f">{n} a>b\r\n")
            f.write(s + "\n" if n == "chr4" else "".join(s[i:i + 60] + "\r\n" for i in range(0, len(s), 60)))
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        lines = spark.read.text(p)
        assert lines.rdd.getNumPartitions() > 8
        assert {r["contig"]: r["seq"] for r in readers.read_fasta_records(spark, p).collect()} == want
        got = {(r["contig"], r["chunk"], r["offset"]): r["seq"] for r in readers.read_fasta(spark, p, chunk=256).collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got == {(n, i, i * 256): s[i * 256:(i + 1) * 256] for n, s in want.items() for i in range(max(1, -(-len(s) // 256)))}


@pytest.mark.parametrize("mode,expected", [("dict", {"a": [[9]], "b": [[2]]}), ("list", {"a": [[1], [9]], "b": [[2]]})])
def test_merge_cache_modes(spark, mode, expected):
    from seqedge.operators import tokens

    schema = "gene string, tf string, seqs array<struct<input_ids:array<int>,attention_mask:array<int>>>"
    p0 = spark.createDataFrame([("a", "t", [([1], [1])]), ("b", "t", [([2], [1])])], schema)
    p1 = spark.createDataFrame([("a", "t", [([9], [1])])], schema)
    got = {r["gene"]: [s["input_ids"] for s in r["seqs"]] for r in tokens.merge_cache([p0, p1], mode).collect()}
    assert got == expected


def test_materialize_replaces_partial_output(spark, scratch):
    from seqedge.sources import writers

    path = os.path.join(scratch, "out")
    os.makedirs(path)
    open(os.path.join(path, "part-garbage.txt"), "w").write("x")   # a failed run's leftovers
    assert not writers.is_committed(spark, path)
    df = spark.range(5)
    assert writers.materialize(df, path).count() == 5
    assert writers.is_committed(spark, path)
    # a committed output is reused, not rewritten
    assert writers.materialize(spark.range(50), path).count() == 5
