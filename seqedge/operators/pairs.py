"""Labelled gene x TF pair datasets.

Tables are long: ``prior(gene, tf, value)``, ``gene_seq(gene, sequence)``,
``tf_seq(tf, sequence)`` with several rows per TF. The pair table is the
prior joined to the TF sequences first and to the genes' DNA last; AQE
broadcasts a side that it measures as small and splits hot genes and TFs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqedge.functions.numeric import binarize, nan_to_null
from seqedge.operators.ranking import batch_no, order_key, prefix_rank
from seqedge.operators.sampling import keep_last
from seqedge.session import cut, dealt

PAIR_COLUMNS = ["gene", "gene_dna", "tf", "tf_dna", "interaction"]


def clean_prior(prior: DataFrame, value: str = "value") -> DataFrame:
    """NaN -> NULL, then drop cells without a value (they carry no label)."""
    return prior.withColumn(value, nan_to_null(value)).filter(F.col(value).isNotNull())


def distinct_tf_sequences(tf_seq: DataFrame, tf: str = "tf", sequence: str = "sequence") -> DataFrame:
    """D3 / A2 in long form: one row per distinct (tf, sequence), NULL keys dropped."""
    return (tf_seq.select(F.col(tf).alias("tf"), F.col(sequence).alias("tf_dna"))
            .filter(F.col("tf").isNotNull() & F.col("tf_dna").isNotNull()).distinct())


def unique_genes(gene_seq: DataFrame, gene: str = "gene", sequence: str = "sequence",
                 order: str | None = None) -> DataFrame:
    """One sequence per gene id; the row with the greatest ``order`` wins
    (the reference's dict keeps the last row). Without ``order`` the greatest
    sequence wins, which is deterministic."""
    g = gene_seq.select(F.col(gene).alias("gene"), F.col(sequence).alias("gene_dna"),
                        *( [F.col(order).alias("_ord")] if order else []))
    g = g.filter(F.col("gene").isNotNull() & F.col("gene_dna").isNotNull())
    return keep_last(g, ["gene"], ["_ord"] if order else ["gene_dna"]).select("gene", "gene_dna")


def build(prior: DataFrame, gene_seq: DataFrame, tf_seq: DataFrame, threshold: float = 0.5,
          value: str = "value", gene_order: str | None = None, tasks: int | None = None) -> DataFrame:
    """One row per (prior cell with a known gene and TF) x (distinct TF
    sequence), labelled ``interaction = value >= threshold``.

    ``prior``: ``gene, tf, value``; ``gene_seq``: ``gene, sequence``;
    ``tf_seq``: ``tf, sequence``. Cells whose gene or TF has no sequence are
    dropped (see ``missing_report``); NaN/NULL cells are dropped (D1).

    Only ids and short TF sequences cross the shuffles that move pairs: the
    TF sequences come first (a TF with many of them is a skewed partition
    that AQE splits), and the genes' DNA, long and one row a gene, is joined
    last, so it is shuffled once as the gene table and never with a pair.
    ``tasks``: those of the joins, for a caller who knows how many cells the
    prior has (``session.tasks_for``).
    """
    cells = clean_prior(prior.select("gene", "tf", value), value)
    genes = unique_genes(gene_seq, order=gene_order)
    tfs = distinct_tf_sequences(tf_seq)
    return (cells.join(dealt(tfs, tasks, "tf"), "tf")
            .join(dealt(genes, tasks, "gene"), "gene")
            .select("gene", "gene_dna", "tf", "tf_dna", binarize(value, threshold).alias("interaction")))


def build_keys(prior: DataFrame, tf_seq: DataFrame | None = None, threshold: float = 0.5, value: str = "value",
               tfs: DataFrame | None = None) -> DataFrame:
    """J7 without the genes' DNA: ``gene, tf, tf_dna, interaction`` for every prior
    cell with a known TF. Whoever joins the gene table later drops the
    pairs of unknown genes there. ``tfs`` gives the distinct sequences
    instead of ``tf_seq``; what other columns it has, the pairs keep."""
    cells = clean_prior(prior.select("gene", "tf", value), value)
    tfs = distinct_tf_sequences(tf_seq) if tfs is None else tfs
    kept = [c for c in tfs.columns if c not in ("tf", "tf_dna")]
    return cells.join(tfs, "tf").select("gene", "tf", "tf_dna", binarize(value, threshold).alias("interaction"), *kept)


def missing_report(prior: DataFrame, gene_seq: DataFrame, tf_seq: DataFrame) -> DataFrame:
    """Ids named by the prior that have no sequence: ``kind`` ('gene' or
    'tf') and ``id``."""
    genes = prior.select(F.col("gene").alias("id")).distinct()
    tfs = prior.select(F.col("tf").alias("id")).distinct()
    known_g = gene_seq.select(F.col("gene").alias("id")).filter(F.col("sequence").isNotNull())
    known_t = tf_seq.select(F.col("tf").alias("id")).filter(F.col("sequence").isNotNull())
    return (genes.join(known_g, "id", "left_anti").select(F.lit("gene").alias("kind"), "id")
            .unionByName(tfs.join(known_t, "id", "left_anti").select(F.lit("tf").alias("kind"), "id")))


def listed(pairs: DataFrame, tf_seq: DataFrame) -> DataFrame:
    """Listed (gene, tf) pairs, one row per distinct TF sequence."""
    tfs = distinct_tf_sequences(tf_seq)
    return pairs.select("gene", "tf").join(tfs, "tf")


def gene_counts(prior: DataFrame, threshold: float = 0.5, value: str = "value") -> DataFrame:
    """Per gene, prior cells at or above the threshold and below it."""
    cells = clean_prior(prior, value)
    return cells.groupBy("gene").agg(
        F.count_if(F.col(value) >= threshold).alias("n_interactions"),
        F.count_if(F.col(value) < threshold).alias("n_non_interactions"))


def shard(df: DataFrame, key: str, k: int, seed: int = 0) -> DataFrame:
    """Split the distinct ``key`` values into ``k`` ranges of
    ``ceil(n / k)`` in a reproducible hash order; adds ``shard`` (0-based).

    Ranks are taken over distinct keys (bounded buckets, no global sort) and
    joined back, so rows of one key always land in one shard.
    """
    keys = df.select(key).distinct().withColumn("_ok", order_key(seed, key))
    ranked = cut(prefix_rank(keys, "_ok", ties=[key], rank_col="_r", collapse_copies=False).select(key, "_r"), "ranked-keys")
    size = max(1, -(-ranked.count() // k))
    return df.join(ranked.select(key, batch_no("_r", size).alias("shard")), key)
