"""Genome tables: feature filters, chunked contigs, interval and promoter
extraction, length statistics (P1-P3, P9, P10, J1, J2, A11, A12, F1, F2).

A contig can be hundreds of megabases, so it is stored as fixed-size chunks
``(contig, chunk, offset, seq)``. Extracting an interval is an equi-join on
``(contig, chunk)`` of small rows: each feature is exploded into the chunk
numbers it covers (at most ``ceil(len / chunk) + 1``), each chunk yields its
piece by ``substring``, and the pieces are put back in chunk order. No contig
is broadcast and no row holds more than one chunk.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqedge.functions.dna import reverse_complement, slice_closed
from seqedge.session import cut

DEFAULT_CHUNK = 65536

__all__ = ["genes_only", "keep_contigs", "drop_unnamed", "count_unnamed", "prefix_contig", "max_length",
           "chunk_contigs", "contig_lengths", "extract_intervals", "promoter_bounds", "promoters",
           "length_histogram", "length_split", "slice_closed", "reverse_complement"]


def genes_only(features: DataFrame, category: str = "category", value: str = "gene") -> DataFrame:
    """Keep features of one category."""
    return features.filter(F.col(category) == value)


def keep_contigs(features: DataFrame, contigs, col: str = "contig") -> DataFrame:
    """Contig whitelist; a Python list becomes ``isin``, a DataFrame a semi join."""
    if isinstance(contigs, DataFrame):
        return features.join(contigs.select(F.col(contigs.columns[0]).alias(col)).distinct(), col, "left_semi")
    return features.filter(F.col(col).isin(list(contigs)))


def drop_unnamed(features: DataFrame, key: str = "gene_id") -> DataFrame:
    """Drop rows without a key."""
    return features.filter(F.col(key).isNotNull())


def count_unnamed(features: DataFrame, key: str = "gene_id") -> DataFrame:
    """How many rows have no key (the audit printed before dropping)."""
    return features.agg(F.count_if(F.col(key).isNull()).alias("n_unnamed"),
                        F.count(F.lit(1)).alias("n_rows"))


def prefix_contig(features: DataFrame, prefix: str = "chr", col: str = "contig") -> DataFrame:
    """Prepend ``prefix`` to contig names."""
    return features.withColumn(col, F.concat(F.lit(prefix), F.col(col)))


def max_length(df: DataFrame, bound: int, col: str = "sequence") -> DataFrame:
    """Keep sequences strictly shorter than ``bound``; NULL (a
    missing contig) is dropped."""
    return df.filter(F.length(F.col(col)) < bound)


def chunk_contigs(genome: DataFrame, chunk: int = DEFAULT_CHUNK, contig: str = "contig",
                  seq: str = "seq") -> DataFrame:
    """Cut ``(contig, seq)`` into ``(contig, chunk, offset, seq)`` rows of
    ``chunk`` characters; ``offset`` is the 0-based position of the first one."""
    e = genome.select(F.col(contig).alias("contig"), F.posexplode(pieces(seq, chunk)).alias("chunk", "seq"))
    return e.select("contig", "chunk", (F.col("chunk").cast("bigint") * chunk).alias("offset"), "seq")


def pieces(seq, size: int):
    """A string as an array of ``size``-character pieces, cut in one pass (the work grows with the length, not with
    its square). An empty string is one empty piece, NULL one NULL piece."""
    s = F.col(seq) if isinstance(seq, str) else seq
    return (F.when(s.isNull(), F.array(F.lit(None).cast("string"))).when(F.length(s) <= size, F.array(s))
            .otherwise(F.regexp_extract_all(s, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))))


def contig_lengths(chunks: DataFrame) -> DataFrame:
    """``contig, length`` from a chunk table (one small aggregate)."""
    return chunks.groupBy("contig").agg(F.max(F.col("offset") + F.length("seq")).alias("length"))


def extract_intervals(features: DataFrame, chunks: DataFrame, chunk: int = DEFAULT_CHUNK,
                      start: str = "start", stop: str = "stop", contig: str = "contig",
                      out: str = "sequence", lengths: DataFrame | None = None) -> DataFrame:
    """``seq[start..stop]`` (1-based, closed, clamped at the contig end)
    for every feature row; NULL when the contig is missing (D7).

    ``chunks`` comes from ``chunk_contigs`` with the same ``chunk`` size.
    """
    keys = [contig, start, stop]
    iv = features.select(*keys).filter(F.col(start).isNotNull() & F.col(stop).isNotNull()).distinct()
    first = F.floor((F.col(start) - 1) / chunk).cast("int")
    last = F.floor((F.greatest(F.col(stop), F.col(start)) - 1) / chunk).cast("int")
    ex = iv.select(*keys, F.explode(F.sequence(F.greatest(first, F.lit(0)), F.greatest(last, F.lit(0))))
                   .alias("chunk"))
    ch = chunks.select(F.col("contig").alias(contig), "chunk", "offset", F.col("seq").alias("_piece_src"))
    joined = ex.join(ch, [contig, "chunk"])
    lo = F.greatest(F.col(start) - F.col("offset"), F.lit(1))
    hi = F.least(F.col(stop) - F.col("offset"), F.length("_piece_src"))
    piece = F.call_function("substring", F.col("_piece_src"), lo, F.greatest(hi - lo + 1, F.lit(0)))
    parts = joined.select(*keys, F.struct("chunk", piece.alias("p")).alias("_part"))
    # A feature spans a bounded number of chunks, so its list is small.
    assembled = parts.groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("_part")), lambda x: x["p"]), "").alias(out))
    # A known contig with an empty window gives '' (as a slice does); a
    # missing contig gives NULL. The contig list has one row per contig; a
    # caller that has it passes it.
    known = (lengths if lengths is not None else chunks).select(F.col("contig").alias(contig)).distinct().withColumn("_known", F.lit(True))
    return (features.join(assembled, keys, "left").join(known, contig, "left")
            .withColumn(out, F.when(F.col("_known"), F.coalesce(F.col(out), F.lit(""))))
            .drop("_known"))


def promoter_bounds(genes: DataFrame, lengths: DataFrame, width: int = 1000, include_tss: bool | None = None,
                    start: str = "start", stop: str = "stop", strand: str = "strand",
                    contig: str = "contig") -> DataFrame:
    """J2 window arithmetic: ``p_start, p_stop`` (1-based, closed, clamped to
    the contig) upstream of each gene.

    ``include_tss=None`` follows the reference's slices (Q10, D5): on ``+``
    the ``width`` bases ending at ``start`` (TSS included), on ``-`` the
    ``width`` bases after ``stop`` (TSS excluded). ``True`` includes the TSS
    base on both strands, ``False`` excludes it on both.
    """
    plus_incl = include_tss in (None, True)
    minus_incl = include_tss is True
    s, e = F.col(start), F.col(stop)
    p_hi = s if plus_incl else s - 1
    m_lo = e if minus_incl else e + 1
    is_minus = F.col(strand) == "-"
    lo = F.when(is_minus, m_lo).otherwise(F.greatest(p_hi - width + 1, F.lit(1)))
    hi = F.when(is_minus, F.least(m_lo + width - 1, F.col("_len"))).otherwise(p_hi)
    lens = lengths.select(F.col("contig").alias(contig), F.col("length").alias("_len"))
    return (genes.join(lens, contig)
            .withColumn("p_start", lo.cast("bigint")).withColumn("p_stop", hi.cast("bigint")).drop("_len"))


def promoters(genes: DataFrame, chunks: DataFrame, width: int = 1000, include_tss: bool | None = None,
              chunk: int = DEFAULT_CHUNK, strand: str = "strand", out: str = "promoter_sequence") -> DataFrame:
    """Strand-aware promoter sequences, reverse-complemented on ``-``.
    Genes on missing contigs are dropped (inner join, as the reference)."""
    lengths = cut(contig_lengths(chunks), "contig-lengths")  # one row a contig: windows and known contigs
    b = promoter_bounds(genes, lengths, width, include_tss, strand=strand)
    seqs = extract_intervals(b, chunks, chunk, start="p_start", stop="p_stop", out="_p", lengths=lengths)
    return (seqs.withColumn(out, F.when(F.col(strand) == "-", reverse_complement("_p")).otherwise(F.col("_p")))
            .drop("_p", "p_start", "p_stop"))


def length_histogram(df: DataFrame, col: str = "sequence", bins: int = 100, lo: float | None = None,
                     hi: float | None = None, length: bool = True) -> DataFrame:
    """Equal-width histogram over [lo, hi] (data min/max by default);
    the top edge falls in the last bin. Empty bins are listed with 0."""
    x = F.length(F.col(col)) if length else F.col(col)
    vals = df.select(x.cast("double").alias("x")).filter(F.col("x").isNotNull())
    if lo is None or hi is None:
        st = vals.agg(F.min("x").alias("lo"), F.max("x").alias("hi")).first()
        lo = st["lo"] if lo is None else lo
        hi = st["hi"] if hi is None else hi
    spark = df.sparkSession
    if lo is None:
        return spark.createDataFrame([], "bin int, lo double, hi double, n bigint")
    width = (float(hi) - float(lo)) / bins if hi > lo else 1.0
    b = F.least(F.floor((F.col("x") - F.lit(float(lo))) / F.lit(width)) + 1, F.lit(bins)).cast("int")
    counts = vals.filter((F.col("x") >= lo) & (F.col("x") <= hi)).groupBy(b.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"))
    # The bin list has `bins` rows (a parameter), joined to the counts.
    edges = spark.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    return (edges.join(counts, "bin", "left")
            .select("bin", (F.lit(float(lo)) + (F.col("bin") - 1) * F.lit(width)).alias("lo"),
                    (F.lit(float(lo)) + F.col("bin") * F.lit(width)).alias("hi"),
                    F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("n")))


def length_split(df: DataFrame, bound: int, col: str = "sequence") -> DataFrame:
    """Rows shorter than ``bound`` and the rest, with shares (D7: strict ``<``)."""
    n = F.length(F.col(col))
    return df.agg(F.count_if(n < bound).alias("n_under"), F.count_if(n >= bound).alias("n_over"),
                  F.count(F.lit(1)).alias("n")).select(
        "n_under", "n_over", F.try_divide(F.col("n_under"), F.col("n")).alias("share_under"),
        F.try_divide(F.col("n_over"), F.col("n")).alias("share_over"))


def sequences_from_features(features: DataFrame, genome: DataFrame, chunk: int = DEFAULT_CHUNK,
                            category: str | None = "gene", key: str = "gene_id",
                            bound: int | None = None) -> DataFrame:
    """E1 in one plan from whole contigs ``(contig, seq)``: see ``sequences_from_chunks``."""
    return sequences_from_chunks(features, chunk_contigs(genome, chunk), chunk, category, key, bound)


def sequences_from_chunks(features: DataFrame, chunks: DataFrame, chunk: int = DEFAULT_CHUNK,
                          category: str | None = "gene", key: str = "gene_id",
                          bound: int | None = None) -> DataFrame:
    """E1 in one plan: keep genes, drop unnamed ones, cut their sequences out
    of the chunked genome, drop misses (D7) and, optionally, long ones (P10)."""
    f = features
    if category is not None:
        f = genes_only(f, value=category)
    f = drop_unnamed(f, key)
    seqs = extract_intervals(f, chunks, chunk).filter(F.col("sequence").isNotNull())
    return max_length(seqs, bound) if bound else seqs
