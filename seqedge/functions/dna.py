"""DNA column expressions: slicing, reverse complement, k-mers, stand-in DNA.

All functions return ``Column`` expressions built from Spark built-ins, so
they stay inside whole-stage codegen; strings are indexed in code points.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The IUPAC nucleotide complement table (upper and lower case).
# U complements to A; N, W, S are their own complements.
IUPAC_FROM = "ACGTUNWSRYKMBDHVacgtunwsrykmbdhv"
IUPAC_TO = "TGCAANWSYRMKVHDBtgcaanwsyrmkvhdb"

# Hex digit -> base, used to turn an md5 digest into 32 bp.
HEX_DIGITS = "0123456789abcdef"
HEX_TO_BASE = "ACGTACGTACGTACGT"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def slice_closed(seq, start, stop) -> Column:
    """``seq[start..stop]`` with 1-based closed bounds (NULL if any is NULL)."""
    start, stop = _c(start), _c(stop)
    return _substring(_c(seq), start, stop - start + F.lit(1))


def _substring(s: Column, pos: Column, length: Column) -> Column:
    # F.substring wants ints in older signatures; the SQL form takes columns.
    return F.call_function("substring", s, pos, F.greatest(length, F.lit(0)))


def reverse_complement(seq) -> Column:
    """reverse complement with IUPAC codes; case is kept, other characters pass through."""
    return F.reverse(F.translate(_c(seq), IUPAC_FROM, IUPAC_TO))


def dna_from_key(key) -> Column:
    """32 bp of deterministic DNA from any key (stand-in sequences).

    ``translate(md5(cast(key as string)), hex, 'ACGT'*4)`` is also valid DuckDB,
    which is what lets stand-in queries have an SQL oracle.
    """
    return F.translate(F.md5(_c(key).cast("string")), HEX_DIGITS, HEX_TO_BASE)


def kmers(seq, k: int) -> Column:
    """All overlapping k-mers of ``seq`` in order (empty array if shorter than k)."""
    # a look-ahead match at every place, in one pass over the sequence
    found = F.regexp_extract_all(_c(seq), F.lit(f"(?s)(?=(.{{{k}}}))"), F.lit(1))
    return F.coalesce(found, F.array().cast("array<string>"))


def kmer_set(seq, k: int) -> Column:
    """Distinct k-mers of ``seq``."""
    return F.array_distinct(kmers(seq, k))
