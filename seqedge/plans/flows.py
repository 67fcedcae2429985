"""End-to-end flows composed from the operators.

* ``sequence_tables`` (E1): genome features + FASTA chunks -> gene sequences.
* ``training_set`` (E3): pair dataset -> tokens -> exact split -> down-sampled
  train negatives -> capped dev set, in one lazy plan.
* ``inference`` (E4): candidate pairs -> gene shards -> scores -> mean per
  pair -> JSON-lines shards -> read back as one prediction table.
* The multi-round loop (E2) is ``operators.runs.iterate``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqedge.operators import genome, pairs, ranking, sampling, scoring, tokens
from seqedge.session import cut
from seqedge.sources import readers, writers

IDS = ["gene", "tf", "tf_dna"]


def sequence_tables(features: DataFrame, fasta_path: str, chunk: int = genome.DEFAULT_CHUNK,
                    bound: int | None = None) -> DataFrame:
    """Gene sequences cut from a FASTA file for the named genes of a
    feature table (genes only, missing contigs dropped, optional length bound)."""
    chunks = readers.read_fasta(features.sparkSession, fasta_path, chunk)
    return genome.sequences_from_chunks(features, chunks, chunk, bound=bound)


def training_set(prior: DataFrame, gene_seq: DataFrame, tf_seq: DataFrame, threshold: float = 0.5,
                 train_prop: float = 0.8, downsample_rate: float = 1.0, seed: int = 0, k: int = 6,
                 max_length: int | None = None, max_eval: int | None = None) -> DataFrame:
    """The labelled, tokenized pair dataset split into ``train`` and
    ``dev`` (exact ``floor(n * train_prop)``), train negatives down-sampled to
    ``int(n_neg * rate)`` when ``rate < 1``, and the dev set capped at
    ``max_eval`` rows. Each random choice has its own seed offset."""
    # Only ids are split and sampled; the rows that stay are tokenized last.
    # Split and samples read the labelled keys several times: written once.
    known = pairs.unique_genes(gene_seq).select("gene")
    ds = cut(pairs.build_keys(prior, tf_seq, threshold).join(known, "gene", "left_semi").select(*IDS, "interaction"), "pairs")
    s = sampling.split(ds, train_prop, seed=seed, ids=IDS)
    train = s.filter(F.col("split") == "train")
    dev = s.filter(F.col("split") == "dev")
    if downsample_rate < 1.0:
        train = sampling.downsample_negatives(train, downsample_rate, "interaction", seed=seed + 1, ids=IDS)
    if max_eval is not None:
        keyed = dev.withColumn("_ok", ranking.order_key(seed + 2, *IDS))
        dev = (ranking.select_first_n(keyed, "_ok", lambda t: F.least(t, F.lit(max_eval)), ties=IDS,
                                      flag_col="_keep")
               .filter("_keep").drop("_keep", "_ok"))
    return tokens.tokenize_pairs(train.unionByName(dev), k=k, max_length=max_length, genes=pairs.unique_genes(gene_seq),
                                 tfs=pairs.distinct_tf_sequences(tf_seq)).select(
        *IDS, "interaction", "split", "input_ids", "attention_mask")


def inference(candidates: DataFrame, gene_seq: DataFrame, tf_seq: DataFrame, out_path: str, n_shards: int = 4,
              scorer: Callable[[DataFrame], DataFrame] | None = None, seed: int = 0) -> DataFrame:
    """Score candidate (gene, tf) pairs over every distinct TF sequence,
    average per pair, write one JSON-lines folder per gene shard (the
    reference ran one job per gene range) and read all shards back.

    ``scorer(pairs) -> pairs + score``; default: ``kmer_overlap`` with k = 6.
    """
    score = scorer or (lambda p: scoring.kmer_overlap(p, k=6))
    genes = pairs.unique_genes(gene_seq)
    listed = pairs.listed(candidates.select("gene", "tf").distinct(), tf_seq)
    # Shard on keys first; the gene sequence joins last, right before scoring,
    # so no shuffle carries it per pair.
    sharded = pairs.shard(listed, "gene", n_shards, seed=seed).join(genes, "gene")
    pred = scoring.mean_by_pair(score(sharded), keys=("shard", "gene", "tf"))
    out = pred.select("shard", F.col("gene").alias("gene_id"), F.col("tf").alias("DBID"), "prediction")
    out.write.mode("overwrite").partitionBy("shard").json(out_path)
    return readers.read_predictions(out.sparkSession, out_path)


def prior_matrix(predictions: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """E4 sink: the mean prediction matrix, wide, genes x TFs, missing cells 0."""
    writers.write_wide(predictions.withColumnRenamed("prediction", "value"), path, columns=columns)
