"""Edge lists (TF -> gene): union, two-sided restriction, key overlap,
0/1 matrices and their counts (U1, J4, J5, J14, A8, A9, A10, L1).

Matrices stay long (D6): an edge list *is* the sparse 0/1 matrix, zeros are
implied. Counting zeros needs no dense grid (rows x cols - ones), and wide
files are written from the numbered cells of each row.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqedge.operators import matrix
from seqedge.session import cut


def merge(*edge_lists: DataFrame) -> DataFrame:
    """Bag union of edge lists by column name."""
    return reduce(lambda a, b: a.unionByName(b), edge_lists)


def restrict(edges: DataFrame, genes: DataFrame, tfs: DataFrame, gene: str = "gene", tf: str = "tf") -> DataFrame:
    """Keep edges whose gene and TF are both known (two semi joins)."""
    g = genes.select(F.col(genes.columns[0]).alias(gene)) if gene not in genes.columns else genes.select(gene)
    t = tfs.select(F.col(tfs.columns[0]).alias(tf)) if tf not in tfs.columns else tfs.select(tf)
    return edges.join(g, gene, "left_semi").join(t, tf, "left_semi")


def used_sequences(seqs: DataFrame, edges: DataFrame, key: str, edge_key: str | None = None) -> DataFrame:
    """Sequence rows whose id appears in the network."""
    e = edges.select(F.col(edge_key or key).alias(key))
    return seqs.join(e, key, "left_semi")


def key_overlap(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Distinct keys in both, only left, only right (one row)."""
    a = left.select(F.col(key).alias("_k"), F.lit(1).alias("_a")).distinct()
    b = right.select(F.col(key).alias("_k"), F.lit(1).alias("_b")).distinct()
    j = a.join(b, "_k", "full_outer")
    return j.agg(F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("n_both"),
                 F.count_if(F.col("_b").isNull()).alias("n_left_only"),
                 F.count_if(F.col("_a").isNull()).alias("n_right_only"))


def ones(edges: DataFrame, gene: str = "gene", tf: str = "tf") -> DataFrame:
    """A8 (long form): distinct edges; repeated edges collapse to one 1."""
    return edges.select(gene, tf).distinct()


def labels(df: DataFrame, col: str) -> list[str]:
    """L1: sorted distinct labels (the pivot's column list). The list has one
    entry per matrix column; more than ``spark.sql.pivotMaxValues`` raise."""
    most = int(df.sparkSession.conf.get("spark.sql.pivotMaxValues", "10000"))
    found = [r[0] for r in df.select(col).distinct().orderBy(col).limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"a wide matrix of more than {most} columns ({col}): raise spark.sql.pivotMaxValues or stay long")
    return found


def to_matrix(edges: DataFrame, gene: str = "gene", tf: str = "tf", columns: list[str] | None = None) -> DataFrame:
    """A8 as a wide table: 0/1, one row per gene with an edge, one column
    per TF in sorted order, for networks within ``spark.sql.pivotMaxValues``.
    Pass ``columns`` to fix the schema (and skip the distinct job). Files of
    any width come from ``sparse_matrix`` and ``writers.write_wide``."""
    e = ones(edges, gene, tf)
    if columns is None:
        e = cut(e, "edges")  # the label list and the pivot both read them
    cols = columns if columns is not None else labels(e, tf)
    wide = e.groupBy(gene).pivot(tf, cols).agg(F.count(F.lit(1)).cast("int"))
    return wide.select(gene, *[F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias(c) for c in cols])


def sparse_matrix(edges: DataFrame, gene: str = "gene", tf: str = "tf") -> tuple[DataFrame, DataFrame]:
    """A8 of any width: ``(rows, columns)``, a row per gene with the sorted
    numbers of its TFs (``cells``, value 1), and the numbered TFs. Nothing is
    stored for zeros."""
    marked = cut(ones(edges, gene, tf).withColumn("value", F.lit(1.0)), "edges")
    numbers = matrix.column_numbers(marked, tf)
    return matrix.sparse_rows(marked, numbers, gene, tf), numbers


def density(edges: DataFrame, gene: str = "gene", tf: str = "tf") -> DataFrame:
    """Ones and zeros of the dense matrix over the network's genes and
    TFs, computed from three distinct counts (no grid)."""
    e = ones(edges, gene, tf)
    c = e.agg(F.count(F.lit(1)).alias("n_ones"), F.count_distinct(gene).alias("n_genes"),
              F.count_distinct(tf).alias("n_tfs"))
    return c.select("n_genes", "n_tfs", "n_ones",
                    (F.col("n_genes") * F.col("n_tfs") - F.col("n_ones")).alias("n_zeros"))


def summary(edges: DataFrame, gene: str = "gene", tf: str = "tf", approx: bool = False) -> DataFrame:
    """A10: distinct TFs, genes and edges (``approx`` uses HyperLogLog++)."""
    cd = F.approx_count_distinct if approx else F.count_distinct
    return edges.agg(cd(tf).alias("n_tfs"), cd(gene).alias("n_genes"),
                     cd(F.struct(tf, gene)).alias("n_edges"), F.count(F.lit(1)).alias("n_rows"))


#: Two-sided error that a sketch of 2**LG registers keeps to in all but a few cases in 1,000: three standard errors.
SKETCH_LG = 14
SKETCH_ERROR = 3 * 1.04 / 2 ** (SKETCH_LG / 2)


def sketches(edges: DataFrame, by: Sequence[str] = (), gene: str = "gene", tf: str = "tf", lg: int = SKETCH_LG) -> DataFrame:
    """A10 that adds up: a sketch of the TFs, genes and edges and the number
    of rows, for each ``by`` group (a run, a source, a day). The rows are a
    few kB whatever they stand for; store them, and unite them with
    ``unite_sketches`` without reading an edge again."""
    one = lambda c: F.hll_sketch_agg(c, lg)
    pair = F.concat_ws("\t", F.col(tf).cast("string"), F.col(gene).cast("string"))
    edge = F.when(F.col(tf).isNotNull() & F.col(gene).isNotNull(), pair)
    return edges.groupBy(*by).agg(one(F.col(tf).cast("string")).alias("tfs"), one(F.col(gene).cast("string")).alias("genes"),
                                  one(edge).alias("edges"), F.count(F.lit(1)).alias("n_rows"))


def unite_sketches(stored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """A10 from stored ``sketches`` of any number of runs: estimated distinct
    TFs, genes and edges, and the exact number of rows, per ``by`` group."""
    size = lambda c: F.hll_sketch_estimate(F.hll_union_agg(c))
    return stored.groupBy(*by).agg(size("tfs").alias("n_tfs"), size("genes").alias("n_genes"), size("edges").alias("n_edges"), F.sum("n_rows").alias("n_rows"))
