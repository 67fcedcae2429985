"""Model inputs: pair formatting, k-mer tokenization, padding, batch collate,
and the token cache keyed by (gene, tf) (F3-F6, W3, A4, J12, S14-S16).

Tokenization is a column expression (``regexp_extract_all`` + a computed
base-4 code), not a Python tokenizer: every row stays in the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqedge.functions.arrays import array_sum, pad_to  # noqa: F401  (F6, re-exported)
from seqedge.functions.arrays import remove_padding as _remove_padding
from seqedge.operators import lists
from seqedge.operators.ranking import range_running_sum
from seqedge.operators.sampling import keep_last
from seqedge.session import cut

# Special tokens of the k-mer vocabulary and their ids.
CLS_TOKEN = "<cls>"
SPECIAL_IDS = {"<unk>": 0, "<pad>": 1, "<mask>": 2, "<cls>": 3, "<eos>": 4, "<bos>": 5}
PAD_ID = 1
CLS_ID = 3
UNK_ID = 0
# k-mer ids follow the specials: id = KMER_BASE + base-4 code of the k-mer
# (A=0, C=1, G=2, T=3); single-base tokens follow all 4**k k-mers.
KMER_BASE = 6
SINGLE_BASES = "ACGTN"
#: Folder column of caches split by size.
FILE = "cache_file"
#: Column of pairs with the token ids of their TF sequence.
TF_IDS = "_tids"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def format_pair(gene_dna, tf_dna, sep: str = CLS_TOKEN) -> Column:
    """``<gene DNA><cls><TF DNA>``."""
    return F.concat(_c(gene_dna), F.lit(sep), _c(tf_dna))


def token_pattern(k: int) -> str:
    return f"({CLS_TOKEN}|[ACGT]{{{k}}}|.)"


def token_id(tok: Column, k: int) -> Column:
    """Id of one token string (special, k-mer, single base, or unknown)."""
    single = KMER_BASE + 4 ** k
    code = F.conv(F.translate(tok, "ACGT", "0123"), 4, 10).cast("int")
    out = F.when(tok == CLS_TOKEN, F.lit(CLS_ID)).when(F.length(tok) == k, F.lit(KMER_BASE) + code)
    for i, b in enumerate(SINGLE_BASES):
        out = out.when(tok == b, F.lit(single + i))
    return out.otherwise(F.lit(UNK_ID))


def tokenize(df: DataFrame, text: str = "formatted_inputs", k: int = 6, max_length: int | None = None,
             padding: bool = False, add_cls: bool = True) -> DataFrame:
    """non-overlapping k-mer tokens left to right, falling back to single
    characters; a leading ``<cls>``; truncated to ``max_length`` and, with
    ``padding``, padded to it with ``<pad>``. Adds ``input_ids`` and
    ``attention_mask`` (ARRAY<INT>)."""
    toks = F.regexp_extract_all(F.col(text), F.lit(token_pattern(k)), 1)
    ids = F.transform(toks, lambda t: token_id(t, k))
    if add_cls:
        ids = F.concat(F.array(F.lit(CLS_ID)), ids)
    out = df.withColumn("input_ids", ids.cast("array<int>"))
    if max_length is not None:
        out = out.withColumn("input_ids", F.slice("input_ids", 1, max_length))
    out = out.withColumn("attention_mask", F.array_repeat(F.lit(1), F.size("input_ids")))
    if padding and max_length is not None:
        out = (out.withColumn("input_ids", pad_to("input_ids", max_length, PAD_ID))
               .withColumn("attention_mask", pad_to("attention_mask", max_length, 0)))
    return out


def sequence_ids(seq, k: int = 6) -> Column:
    """Token ids of one sequence, without specials."""
    toks = F.regexp_extract_all(_c(seq), F.lit(token_pattern(k)), 1)
    return F.transform(toks, lambda t: token_id(t, k)).cast("array<int>")


def with_sequence_ids(tfs: DataFrame, tf_dna: str = "tf_dna", k: int = 6, out: str = TF_IDS) -> DataFrame:
    """The sequence table with each sequence's token ids, for pairs that keep them (``pairs.build_keys``)."""
    return tfs.withColumn(out, sequence_ids(tf_dna, k))


def tokenize_pairs(pairs: DataFrame, k: int = 6, max_length: int | None = None, padding: bool = False,
                   gene: str = "gene", gene_dna: str = "gene_dna", tf: str = "tf", tf_dna: str = "tf_dna",
                   add_cls: bool = True, genes: DataFrame | None = None, tfs: DataFrame | None = None) -> DataFrame:
    """F3 + F4 for pair rows, tokenizing each distinct sequence once.

    A token never spans ``<cls>`` (it is not a base), so the ids of
    ``gene <cls> tf`` are ``[cls] + ids(gene) + [cls] + ids(tf)``. With the
    sequence tables ``genes`` (gene, gene_dna: one row a gene) and ``tfs``
    (tf, tf_dna: distinct), these are tokenized and joined to the pairs by
    id, which need not hold any DNA of genes; pairs without a gene drop out.
    Pairs that already hold the TF's ids (``TF_IDS``) are not joined to
    ``tfs`` once more. Without tables the distinct sequences are taken from the pairs, which are
    built once more for each, and a digest of the gene's DNA tells two
    sequences of one gene apart. Equal to ``tokenize`` on ``format_pair``;
    the ``gene_dna`` column is dropped from the output.
    """
    # what stands before and after the gene's ids is put there once a gene
    head = F.array(F.lit(CLS_ID)) if add_cls else F.array().cast("array<int>")
    gids = F.concat(head, sequence_ids(gene_dna, k), F.array(F.lit(CLS_ID))).alias("_gids")
    # Only ids cross the shuffle, never a 12 kb string per pair; AQE sees the
    # real size of both sides and broadcasts one only under its threshold.
    if genes is not None:
        ids, on = pairs.drop(gene_dna), [gene]
        g = genes.select(gene, gids)
    else:
        marked, on = pairs.withColumn("_gmd5", F.coalesce(F.md5(gene_dna), F.lit(""))), [gene, "_gmd5"]
        ids = marked.drop(gene_dna)
        g = marked.select(*on, gene_dna).groupBy(*on).agg(F.first(gene_dna).alias(gene_dna)).select(*on, gids)
    if TF_IDS in pairs.columns:
        known = ids
    else:
        known = ids.join(with_sequence_ids(pairs.select(tf, tf_dna).distinct() if tfs is None else tfs, tf_dna, k), [tf, tf_dna])
    # the long ids of the genes come last, so no pair carries them through a shuffle
    kept = [c for c in ids.columns if c not in (tf, tf_dna, gene, "_gmd5", TF_IDS)]
    j = known.join(g, on).select(tf, tf_dna, gene, *kept, "_gids", TF_IDS)
    parts = [F.col("_gids"), F.col(TF_IDS)]
    n = F.size("_gids") + F.size(TF_IDS)
    if max_length is None:
        return j.withColumns({"input_ids": F.concat(*parts), "attention_mask": F.array_repeat(F.lit(1), n)}).drop("_gids", TF_IDS)
    n = F.least(n, F.lit(max_length))
    if not padding:
        out = j.withColumns({"input_ids": F.slice(F.concat(*parts), 1, max_length), "attention_mask": F.array_repeat(F.lit(1), n)})
        return out.drop("_gids", TF_IDS)
    # both are cut out of constants: the padding follows the ids, the mask is a stretch of ones and then zeros
    pad, ones, zeros = (F.array_repeat(F.lit(x), max_length) for x in (PAD_ID, 1, 0))
    mask = F.slice(F.concat(ones, zeros), F.lit(max_length + 1) - n, F.lit(max_length))
    return j.withColumns({"input_ids": F.slice(F.concat(*parts, pad), 1, max_length), "attention_mask": mask}).drop("_gids", TF_IDS)


def remove_padding(df: DataFrame, ids: str = "input_ids", mask: str = "attention_mask") -> DataFrame:
    """keep the first ``sum(mask)`` items of both arrays."""
    i, m = _remove_padding(ids, mask)
    return df.withColumn(ids, i).withColumn(mask, m)


def collate(df: DataFrame, batch: str, ids: str = "input_ids", mask: str = "attention_mask",
            pad_id: int = PAD_ID) -> DataFrame:
    """Within each batch, pad or cut every row to the longest real length
    (the largest ``sum(mask)`` in the batch).

    The per-batch maximum is a partial aggregate joined back on the batch key
    (not a window), so a batch key holding many rows is reduced map-side and
    its join partition can be split by AQE."""
    real = array_sum(mask).cast("int")
    widths = df.groupBy(batch).agg(F.max(real).alias("_n"))
    return (df.join(widths, batch)
            .withColumn(ids, pad_to(ids, F.col("_n"), pad_id))
            .withColumn(mask, pad_to(mask, F.col("_n"), 0)).drop("_n"))


def build_cache(tokens: DataFrame, keys: Sequence[str] = ("gene", "tf"), ids: str = "input_ids",
                mask: str = "attention_mask") -> DataFrame:
    """A4: one row per key with all its (padding-free) token sequences,
    sorted, as ``seqs ARRAY<STRUCT<input_ids, attention_mask>>``. A key holds
    one entry per sequence of its TF; where these are many, ``cache_parts``
    has them in bounded rows."""
    t = remove_padding(tokens, ids, mask)
    return t.groupBy(*keys).agg(F.array_sort(F.collect_list(
        F.struct(F.col(ids).alias("input_ids"), F.col(mask).alias("attention_mask")))).alias("seqs"))


def cache_parts(tokens: DataFrame, keys: Sequence[str] = ("gene", "tf"), ids: str = "input_ids",
                mask: str = "attention_mask", size: int = 1_000) -> DataFrame:
    """A4 in bounded rows: ``(keys, part, seqs)``, ``size`` sequences to a
    part, sorted within and across parts. ``lookup``, ``write_cache`` and
    ``merge_cache`` (list mode: by part) take them as they take one row."""
    t = remove_padding(tokens, ids, mask).select(*keys, F.struct(F.col(ids).alias("input_ids"), F.col(mask).alias("attention_mask")).alias("_s"))
    return lists.parts(t, list(keys), "_s", size=size, out="seqs")


def lookup(pairs: DataFrame, cache: DataFrame, keys: Sequence[str] = ("gene", "tf"),
           keep_misses: bool = False) -> DataFrame:
    """One row per cached sequence of each pair; a miss gives no row
    (``keep_misses``: one row with NULL ids)."""
    how = "left" if keep_misses else "inner"
    j = pairs.join(cache, list(keys), how)
    gen = F.explode_outer if keep_misses else F.explode
    return (j.withColumn("_s", gen("seqs")).drop("seqs")
            .withColumn("input_ids", F.col("_s.input_ids"))
            .withColumn("attention_mask", F.col("_s.attention_mask")).drop("_s"))


def write_cache(cache: DataFrame, path: str, max_records_per_file: int | None = None,
                mode: str = "errorifexists", max_bytes: int | None = None, keys: Sequence[str] = ("gene", "tf")) -> None:
    """Persist the cache as Parquet. ``max_records_per_file`` splits
    large outputs by rows; ``max_bytes`` by size, as the reference does: no
    file holds more than this of token data (before encoding and
    compression), and all rows of a key lie in one file.

    File numbers come from running byte totals over the keys (their ids and
    totals alone are ordered); a key that is larger than a file is an error.
    ``load_tokens`` reads the files as one table again."""
    w = cache
    if max_bytes:
        size = F.aggregate("seqs", F.lit(0).cast("bigint"), lambda a, x: a + 4 * (F.size(x["input_ids"]) + F.size(x["attention_mask"])) + 16)
        row_bytes = size + sum((F.octet_length(F.col(k).cast("string")) + 8 for k in keys), F.lit(16))
        totals = cut(cache.groupBy(*keys).agg(F.sum(row_bytes).alias("_bytes")), "cache-bytes")
        largest = totals.agg(F.max("_bytes")).first()[0] or 0
        if largest > max_bytes:
            raise ValueError(f"a key of {largest} bytes does not fit a file of {max_bytes}")
        # keys that start in one window of this width end before the file is full
        window = max(1, max_bytes - largest)
        placed = range_running_sum(totals, keys[0], "_bytes", ties=keys[1:], out="_before")
        files = placed.select(*keys, F.floor(F.col("_before") / window).cast("bigint").alias(FILE))
        w = cache.join(files, list(keys)).repartition(FILE)
    w = w.write.mode(mode).partitionBy(FILE) if max_bytes else w.write.mode(mode)
    if max_records_per_file:
        w = w.option("maxRecordsPerFile", max_records_per_file)
    w.parquet(path)


def merge_cache(parts: Sequence[DataFrame], mode: str = "dict", keys: Sequence[str] = ("gene", "tf")) -> DataFrame:
    """Merge cache parts. ``dict``: a key in a later part replaces the
    earlier one. ``list``: sequences of all parts are concatenated in part
    order."""
    tagged = [p.withColumn("_part", F.lit(i)) for i, p in enumerate(parts)]
    u = reduce(lambda a, b: a.unionByName(b), tagged)
    if mode == "dict":
        return keep_last(u, list(keys), ["_part"]).drop("_part")
    if mode == "list":
        g = u.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_part", "seqs"))).alias("_p"))
        return g.select(*keys, F.flatten(F.transform("_p", lambda x: x["seqs"])).alias("seqs"))
    raise ValueError(f"mode must be 'dict' or 'list', got {mode!r}")


def save_tokens(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Save a tokenized dataset as Parquet."""
    df.write.mode(mode).parquet(path)


def load_tokens(spark, path: str) -> DataFrame:
    """Load one or many Parquet parts (a directory or glob)."""
    return spark.read.parquet(path).drop(FILE)
