"""Registered queries for network, matrix, genome, token, motif, source and
run operators (imported for its registrations)."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqedge.operators import genome, lists, matrix, metrics, network, pairs, ranking
from seqedge.plans import standins as S
from seqedge.plans.catalog import BASE_CTES, PREDICTIONS_SQL, SCORED_PAIRS_SQL, _predictions, _ranking_cte, r9, register
from seqedge.plans.standins import with_ctes
from seqedge.session import cut, dealt

# ===================================================================== network


def _long_genes(spark, d):
    return genome.max_length(S.genes(spark, d), 60)


def _tf12(spark, d):
    return S.tf_seqs(spark, d).filter(F.length("sequence") == 12).select("tf").distinct()


SHORT_GENES_SQL = "short_genes AS (SELECT gene, sequence FROM genes WHERE length(sequence) < 60)"
TF12_SQL = "tf12 AS (SELECT DISTINCT tf FROM tf_seqs WHERE length(sequence) = 12)"
RESTRICTED_SQL = """restricted AS (SELECT tf, gene FROM edges
  WHERE gene IN (SELECT gene FROM short_genes) AND tf IN (SELECT tf FROM tf12))"""
NET_CTES = [S.GENES_SQL, S.TF_SEQS_SQL, S.EDGES_SQL, SHORT_GENES_SQL, TF12_SQL, RESTRICTED_SQL]


@register("network_merge", with_ctes(S.EDGES_SQL) + """
SELECT tf, gene FROM edges
UNION ALL
SELECT 'T' || CAST(l_suppkey AS VARCHAR) AS tf, 'G' || CAST(l_partkey AS VARCHAR) AS gene
FROM lineitem WHERE l_returnflag = 'R'""")
def q_network_merge(spark, d):
    returned = (S.table(spark, d, "lineitem").filter(F.col("l_returnflag") == "R")
                .select(F.concat(F.lit("T"), F.col("l_suppkey").cast("string")).alias("tf"),
                        F.concat(F.lit("G"), F.col("l_partkey").cast("string")).alias("gene")))
    return network.merge(S.edges(spark, d), returned)


def _restricted(spark, d):
    return network.restrict(S.edges(spark, d), _long_genes(spark, d).select("gene"), _tf12(spark, d))


@register("network_restrict", with_ctes(*NET_CTES) + "SELECT tf, gene FROM restricted")
def q_network_restrict(spark, d):
    return _restricted(spark, d)


@register("network_used_sequences", with_ctes(*NET_CTES) +
          "SELECT gene, sequence FROM short_genes WHERE gene IN (SELECT gene FROM restricted)")
def q_network_used_sequences(spark, d):
    return network.used_sequences(_long_genes(spark, d), _restricted(spark, d), "gene")


@register("network_key_overlap", with_ctes(S.GENES_SQL, S.PRIOR_SQL, SHORT_GENES_SQL) + """,
a AS (SELECT DISTINCT gene FROM prior), b AS (SELECT DISTINCT gene FROM short_genes)
SELECT (SELECT count(*) FROM a WHERE gene IN (SELECT gene FROM b)) AS n_both,
       (SELECT count(*) FROM a WHERE gene NOT IN (SELECT gene FROM b)) AS n_left_only,
       (SELECT count(*) FROM b WHERE gene NOT IN (SELECT gene FROM a)) AS n_right_only""")
def q_network_key_overlap(spark, d):
    return network.key_overlap(S.prior(spark, d), _long_genes(spark, d), "gene")


@register("network_to_matrix", with_ctes(*NET_CTES) +
          "SELECT DISTINCT gene, tf, CAST(1 AS DOUBLE) AS value FROM restricted")
def q_network_to_matrix(spark, d):
    """The matrix's rows (their ones by column number), read back as cells."""
    rows, numbers = network.sparse_matrix(_restricted(spark, d))
    return matrix.long_cells(rows, numbers)


@register("network_density", with_ctes(*NET_CTES) + """
SELECT count(DISTINCT gene) AS n_genes, count(DISTINCT tf) AS n_tfs, count(*) AS n_ones,
       count(DISTINCT gene) * count(DISTINCT tf) - count(*) AS n_zeros
FROM (SELECT DISTINCT gene, tf FROM restricted) x""")
def q_network_density(spark, d):
    return network.density(_restricted(spark, d))


@register("network_summary", with_ctes(S.EDGES_SQL) + """
SELECT count(DISTINCT tf) AS n_tfs, count(DISTINCT gene) AS n_genes, count(DISTINCT (tf, gene)) AS n_edges,
       count(*) AS n_rows FROM edges""")
def q_network_summary(spark, d):
    return network.summary(S.edges(spark, d))


@register("network_sketches", with_ctes(S.EDGES_SQL) + """
SELECT count(DISTINCT tf) AS n_tfs, count(DISTINCT gene) AS n_genes, count(DISTINCT (tf, gene)) AS n_edges,
       count(*) AS n_rows, true AS tfs_in_bound, true AS genes_in_bound, true AS edges_in_bound FROM edges""")
def q_network_sketches(spark, d):
    """A10 from stored sketches of each line number's edges, united, against the exact counts."""
    runs_ = S.table(spark, d, "lineitem").select("l_linenumber", F.concat(F.lit("T"), F.col("l_suppkey").cast("string")).alias("tf"),
                                                 F.concat(F.lit("G"), F.col("l_partkey").cast("string")).alias("gene"))
    stored = cut(network.sketches(runs_, ["l_linenumber"]), "sketches")
    got = network.unite_sketches(stored).first()
    near = {x: F.abs(F.lit(got["n_" + x]) - F.col("n_" + x)) <= network.SKETCH_ERROR * F.col("n_" + x) for x in ("tfs", "genes", "edges")}
    exact = network.summary(S.edges(spark, d)).drop("n_rows")
    return exact.select("*", F.lit(got["n_rows"]).cast("bigint").alias("n_rows"), *[near[x].alias(x + "_in_bound") for x in near])


@register("rank_common_prefix", """
SELECT id, l_linenumber, row_number() OVER (ORDER BY id, l_linenumber) AS rank
FROM (SELECT 'SPECIES_ASSEMBLY_GENE_' || lpad(CAST(l_orderkey AS VARCHAR), 12, '0') AS id, l_linenumber FROM lineitem) x""")
def q_rank_common_prefix(spark, d):
    """W6 over raw ids that share a long prefix."""
    ids = F.concat(F.lit("SPECIES_ASSEMBLY_GENE_"), F.lpad(F.col("l_orderkey").cast("string"), 12, "0"))
    return ranking.range_rank(S.table(spark, d, "lineitem").select(ids.alias("id"), "l_linenumber"), "id", ties=["l_linenumber"])


@register("matrix_labels", with_ctes(S.EDGES_SQL) +
          "SELECT tf, row_number() OVER (ORDER BY tf) AS rank FROM (SELECT DISTINCT tf FROM edges) x")
def q_matrix_labels(spark, d):
    tfs = S.edges(spark, d).select("tf").distinct()
    return ranking.range_rank(tfs, "tf", rank_col="rank", collapse_copies=False)


# ===================================================================== matrix

EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


def _pivot_mean(spark, d):
    ev = S.table(spark, d, "events")
    w = matrix.pivot_mean(ev, "user_id", "event_type", "value", EVENT_TYPES)
    return w.select("user_id", *[r9(c).alias(c) for c in EVENT_TYPES])


PIVOT_MEAN_SQL = "pm AS (SELECT user_id, " + ", ".join(
    f"round(coalesce(avg(value) FILTER (WHERE event_type = '{t}'), 0.0), 9) AS {t}" for t in EVENT_TYPES) + \
    " FROM events GROUP BY user_id)"


@register("matrix_pivot_mean", with_ctes(PIVOT_MEAN_SQL) + "SELECT * FROM pm")
def q_matrix_pivot_mean(spark, d):
    return _pivot_mean(spark, d)


@register("matrix_pivot_any", "SELECT user_id, " + ", ".join(
    f"coalesce(max(CAST(value > 300 AS INTEGER)) FILTER (WHERE event_type = '{t}'), 0) AS {t}"
    for t in EVENT_TYPES) + " FROM events GROUP BY user_id")
def q_matrix_pivot_any(spark, d):
    ev = S.table(spark, d, "events").withColumn("x", F.col("value") - 300)
    return matrix.pivot_any(ev, "user_id", "event_type", "x", EVENT_TYPES)


@register("matrix_melt", with_ctes(PIVOT_MEAN_SQL) +
          "SELECT user_id, event_type, value FROM (UNPIVOT pm ON " + ", ".join(EVENT_TYPES) +
          " INTO NAME event_type VALUE value) u")
def q_matrix_melt(spark, d):
    return matrix.melt(_pivot_mean(spark, d), "user_id", "event_type", "value")


def _prior_short(spark, d):
    return S.prior(spark, d).join(_long_genes(spark, d).select("gene"), "gene", "left_semi")


@register("matrix_align", with_ctes(S.GENES_SQL, S.PRIOR_SQL, S.GOLD_SQL, SHORT_GENES_SQL) + """,
a AS (SELECT * FROM prior WHERE gene IN (SELECT gene FROM short_genes)),
rows_ AS (SELECT DISTINCT gene FROM a INTERSECT SELECT DISTINCT gene FROM gold),
cols_ AS (SELECT DISTINCT tf FROM a INTERSECT SELECT DISTINCT tf FROM gold)
SELECT 'pred' AS side, gene, tf, value FROM a WHERE gene IN (SELECT gene FROM rows_) AND tf IN (SELECT tf FROM cols_)
UNION ALL
SELECT 'gold' AS side, gene, tf, value FROM gold WHERE gene IN (SELECT gene FROM rows_) AND tf IN (SELECT tf FROM cols_)""")
def q_matrix_align(spark, d):
    a, b = matrix.align(_prior_short(spark, d), S.gold(spark, d))
    return (a.select(F.lit("pred").alias("side"), "gene", "tf", "value")
            .unionByName(b.select(F.lit("gold").alias("side"), "gene", "tf", "value")))


@register("matrix_head_block", with_ctes(S.PRIOR_SQL) + """
SELECT gene, tf, value FROM prior
WHERE gene IN (SELECT DISTINCT gene FROM prior ORDER BY gene LIMIT 100)
  AND tf IN (SELECT DISTINCT tf FROM prior ORDER BY tf LIMIT 10)""")
def q_matrix_head_block(spark, d):
    return matrix.head_block(S.prior(spark, d), 100, 10)


SHARE = (1.0 - 0.99) ** 0.5


def _sample_sql(key: str, seed: int, name: str, cut: str) -> str:
    return f"""{name} AS (SELECT {key} FROM (SELECT {key}, row_number() OVER (ORDER BY md5('{seed}|' || {key}), {key}) AS r,
       count(*) OVER () AS n FROM (SELECT DISTINCT {key} FROM prior) x) y WHERE r <= {cut})"""


REFRESH_CUT = f"ceil(round(CAST('{SHARE!r}' AS DOUBLE) * n, 9))"


@register("matrix_refresh_block", with_ctes(S.PRIOR_SQL, S.GOLD_SQL, _sample_sql("gene", 0, "rs_", REFRESH_CUT),
                                            _sample_sql("tf", 1, "cs_", REFRESH_CUT)) + """
SELECT p.gene, p.tf, coalesce(g.value, p.value) AS value FROM prior p
LEFT JOIN (SELECT gene, tf, value FROM gold WHERE gene IN (SELECT gene FROM rs_) AND tf IN (SELECT tf FROM cs_)) g
  ON p.gene = g.gene AND p.tf = g.tf""")
def q_matrix_refresh_block(spark, d):
    return matrix.refresh_block(S.prior(spark, d), S.gold(spark, d), 0.99, seed=0)


@register("matrix_refresh_pairs", with_ctes(S.PRIOR_SQL, S.GOLD_SQL) + """,
rg AS (SELECT gene, row_number() OVER (ORDER BY md5('0|' || gene), gene) AS i FROM (SELECT DISTINCT gene FROM prior) x),
rt AS (SELECT tf, row_number() OVER (ORDER BY md5('1|' || tf), tf) AS i FROM (SELECT DISTINCT tf FROM prior) x),
cells AS (SELECT rg.gene, rt.tf FROM rg JOIN rt ON rg.i = rt.i WHERE rg.i <= 50)
SELECT p.gene, p.tf, coalesce(g.value, p.value) AS value FROM prior p
LEFT JOIN (SELECT gold.* FROM gold JOIN cells ON gold.gene = cells.gene AND gold.tf = cells.tf) g
  ON p.gene = g.gene AND p.tf = g.tf""")
def q_matrix_refresh_pairs(spark, d):
    return matrix.refresh_pairs(S.prior(spark, d), S.gold(spark, d), 50, seed=0)


@register("matrix_hadamard", with_ctes(S.PRIOR_SQL, S.GOLD_SQL) +
          "SELECT p.gene, p.tf, round(p.value * g.value * 0.5, 9) AS value FROM prior p JOIN gold g "
          "ON p.gene = g.gene AND p.tf = g.tf")
def q_matrix_hadamard(spark, d):
    h = matrix.scale(matrix.hadamard(S.prior(spark, d), S.gold(spark, d)), 0.5)
    return h.withColumn("value", r9("value"))


@register("matrix_clip_logit_sigmoid", with_ctes(S.PRIOR_SQL) + """,
c AS (SELECT gene, tf, CASE WHEN value IS NULL THEN NULL ELSE greatest(0.01, least(0.99, value)) END AS clipped FROM prior)
SELECT gene, tf, round(clipped, 9) AS clipped, round(ln(clipped / (1 - clipped)), 9) AS logit,
       round(1 / (1 + exp(-ln(clipped / (1 - clipped)))), 9) AS sigmoid FROM c""")
def q_matrix_clip_logit_sigmoid(spark, d):
    c = matrix.clip(S.prior(spark, d), 0.01, 0.99).withColumnRenamed("value", "clipped")
    lg = matrix.logit(c.withColumn("logit", F.col("clipped")), "logit")
    sg = matrix.sigmoid(lg.withColumn("sigmoid", F.col("logit")), "sigmoid")
    return sg.select("gene", "tf", r9("clipped").alias("clipped"), r9("logit").alias("logit"),
                     r9("sigmoid").alias("sigmoid"))


@register("metrics_auprc_vs_gold", with_ctes(*BASE_CTES, SCORED_PAIRS_SQL, PREDICTIONS_SQL, S.GOLD_SQL) + """,
rows_ AS (SELECT DISTINCT gene FROM predictions INTERSECT SELECT DISTINCT gene FROM gold),
cols_ AS (SELECT DISTINCT tf FROM predictions INTERSECT SELECT DISTINCT tf FROM gold),
-- oracle only: the dense block built by brute force, to check the grid-free Spark version
cells AS (SELECT coalesce(p.prediction, 0.0) AS score, coalesce(CAST(g.value >= 0.5 AS INTEGER), 0) AS label
          FROM rows_ r CROSS JOIN cols_ c
          LEFT JOIN predictions p ON p.gene = r.gene AND p.tf = c.tf
          LEFT JOIN gold g ON g.gene = r.gene AND g.tf = c.tf),
""" + _ranking_cte("cells", "score", "label") + "\nSELECT auprc, average_precision, roc_auc, n_pos, n_neg FROM rs")
def q_metrics_auprc_vs_gold(spark, d):
    pred = _predictions(spark, d).withColumnRenamed("prediction", "value")
    s = metrics.auprc_vs_gold(pred, S.gold(spark, d), 0.5)
    return s.select(*[r9(c).alias(c) if t == "double" else F.col(c) for c, t in s.dtypes])


# ===================================================================== genome

CHUNK = 1000


def _chunks(spark, d):
    return genome.chunk_contigs(S.contigs(spark, d), CHUNK)


@register("genome_chunk_contigs", with_ctes(S.CONTIGS_SQL) + f"""
SELECT contig, CAST(c AS INTEGER) AS chunk, CAST(c * {CHUNK} AS BIGINT) AS offset,
       substring(seq, CAST(c * {CHUNK} + 1 AS BIGINT), {CHUNK}) AS seq
FROM (SELECT contig, seq, unnest(range(0, CAST(greatest(ceil(length(seq) / {CHUNK}.0), 1) AS BIGINT))) AS c
      FROM contigs) x""")
def q_genome_chunk_contigs(spark, d):
    return _chunks(spark, d)


@register("genome_extract_intervals", with_ctes(S.CONTIGS_SQL, S.FEATURES_SQL) + """
SELECT f.gene_id, f.contig, f.start, f.stop, f.strand, f.category,
       CASE WHEN c.contig IS NULL THEN NULL ELSE substring(c.seq, f.start, f.stop - f.start + 1) END AS sequence
FROM features f LEFT JOIN contigs c ON f.contig = c.contig""")
def q_genome_extract_intervals(spark, d):
    return genome.extract_intervals(S.features(spark, d), _chunks(spark, d), CHUNK)


@register("genome_slice_closed", with_ctes(S.CONTIGS_SQL, S.FEATURES_SQL) + """
SELECT f.gene_id, substring(c.seq, f.start, f.stop - f.start + 1) AS piece
FROM features f JOIN contigs c ON f.contig = c.contig""")
def q_genome_slice_closed(spark, d):
    f = S.features(spark, d).join(S.contigs(spark, d), "contig")
    return f.select("gene_id", genome.slice_closed("seq", "start", "stop").alias("piece"))


def _rc_sql(x: str) -> str:
    from seqedge.functions.dna import IUPAC_FROM, IUPAC_TO
    return f"reverse(translate({x}, '{IUPAC_FROM}', '{IUPAC_TO}'))"


@register("genome_promoters", with_ctes(S.CONTIGS_SQL, S.FEATURES_SQL) + f"""
SELECT f.gene_id, f.contig, f.start, f.stop, f.strand, f.category,
       CASE WHEN f.strand = '-'
            THEN {_rc_sql("substring(c.seq, f.stop + 1, greatest(least(f.stop + 200, length(c.seq)) - f.stop, 0))")}
            ELSE substring(c.seq, greatest(f.start - 199, 1), f.start - greatest(f.start - 199, 1) + 1)
       END AS promoter_sequence
FROM features f JOIN contigs c ON f.contig = c.contig""")
def q_genome_promoters(spark, d):
    return genome.promoters(S.features(spark, d), _chunks(spark, d), width=200, chunk=CHUNK)


@register("genome_promoters_with_tss", with_ctes(S.CONTIGS_SQL, S.FEATURES_SQL) + f"""
SELECT f.gene_id, f.contig, f.start, f.stop, f.strand, f.category,
       CASE WHEN f.strand = '-'
            THEN {_rc_sql("substring(c.seq, f.stop, greatest(least(f.stop + 199, length(c.seq)) - f.stop + 1, 0))")}
            ELSE substring(c.seq, greatest(f.start - 199, 1), f.start - greatest(f.start - 199, 1) + 1)
       END AS promoter_sequence
FROM features f JOIN contigs c ON f.contig = c.contig""")
def q_genome_promoters_with_tss(spark, d):
    return genome.promoters(S.features(spark, d), _chunks(spark, d), width=200, include_tss=True, chunk=CHUNK)


@register("genome_reverse_complement", with_ctes(S.GENES_SQL) +
          f"SELECT gene, {_rc_sql(chr(39) + 'NWSRYKMBDHVacgtU' + chr(39) + ' || sequence')} AS rc FROM genes")
def q_genome_reverse_complement(spark, d):
    g = S.genes(spark, d)
    return g.select("gene", genome.reverse_complement(F.concat(F.lit("NWSRYKMBDHVacgtU"), F.col("sequence")))
                    .alias("rc"))


GTF_FEATURES_SQL = """gtf_features AS (
  SELECT 'c' || CAST(p_partkey % 7 AS VARCHAR) AS contig, p_partkey * 100 AS start,
         p_partkey * 100 + p_size * 40 AS stop, CASE WHEN p_size % 2 = 0 THEN '+' ELSE '-' END AS strand,
         CASE p_size % 3 WHEN 0 THEN 'gene' WHEN 1 THEN 'exon' ELSE 'transcript' END AS category,
         CASE WHEN p_size % 10 = 0 THEN NULL ELSE 'G' || CAST(p_partkey AS VARCHAR) END AS gene_id
  FROM part)"""


def _gtf_features(spark, d):
    p = S.table(spark, d, "part")
    return p.select(
        F.concat(F.lit("c"), F.pmod("p_partkey", F.lit(7)).cast("string")).alias("contig"),
        (F.col("p_partkey") * 100).alias("start"), (F.col("p_partkey") * 100 + F.col("p_size") * 40).alias("stop"),
        F.when(F.pmod("p_size", F.lit(2)) == 0, "+").otherwise("-").alias("strand"),
        F.when(F.pmod("p_size", F.lit(3)) == 0, "gene").when(F.pmod("p_size", F.lit(3)) == 1, "exon")
        .otherwise("transcript").alias("category"),
        F.when(F.pmod("p_size", F.lit(10)) == 0, F.lit(None)).otherwise(
            F.concat(F.lit("G"), F.col("p_partkey").cast("string"))).alias("gene_id"))


@register("genome_feature_filters", with_ctes(GTF_FEATURES_SQL) + """
SELECT 'chr' || contig AS contig, start, stop, strand, category, gene_id FROM gtf_features
WHERE category = 'gene' AND contig IN ('c1', 'c2', 'c3') AND gene_id IS NOT NULL""")
def q_genome_feature_filters(spark, d):
    f = genome.genes_only(_gtf_features(spark, d))
    f = genome.keep_contigs(f, ["c1", "c2", "c3"])
    return genome.prefix_contig(genome.drop_unnamed(f))


@register("genome_count_unnamed", with_ctes(GTF_FEATURES_SQL) +
          "SELECT count(*) FILTER (WHERE gene_id IS NULL) AS n_unnamed, count(*) AS n_rows FROM gtf_features")
def q_genome_count_unnamed(spark, d):
    return genome.count_unnamed(_gtf_features(spark, d))


@register("genome_length_histogram", """
WITH x AS (SELECT CAST(length(text) AS DOUBLE) AS x FROM documents),
st AS (SELECT min(x) AS lo, max(x) AS hi, (max(x) - min(x)) / 100 AS w FROM x),
cnt AS (SELECT CAST(least(floor((x - lo) / w) + 1, 100) AS INTEGER) AS bin, count(*) AS n FROM x, st GROUP BY 1),
bins AS (SELECT CAST(b AS INTEGER) AS bin FROM range(1, 101) t(b))
SELECT bins.bin, round(lo + (bins.bin - 1) * w, 9) AS lo, round(lo + bins.bin * w, 9) AS hi,
       coalesce(cnt.n, 0) AS n
FROM bins LEFT JOIN cnt ON bins.bin = cnt.bin, st""")
def q_genome_length_histogram(spark, d):
    h = genome.length_histogram(S.table(spark, d, "documents"), "text", bins=100)
    return h.select("bin", r9("lo").alias("lo"), r9("hi").alias("hi"), "n")


@register("genome_length_split", """
SELECT count(*) FILTER (WHERE length(text) < 12000) AS n_under, count(*) FILTER (WHERE length(text) >= 12000) AS n_over,
       round(count(*) FILTER (WHERE length(text) < 12000) / count(*), 9) AS share_under,
       round(count(*) FILTER (WHERE length(text) >= 12000) / count(*), 9) AS share_over FROM documents""")
def q_genome_length_split(spark, d):
    s = genome.length_split(S.table(spark, d, "documents"), 12000, "text")
    return s.select("n_under", "n_over", r9("share_under").alias("share_under"),
                    r9("share_over").alias("share_over"))


@register("genome_sequences_from_features", with_ctes(S.CONTIGS_SQL, S.FEATURES_SQL) + """
SELECT f.gene_id, f.contig, f.start, f.stop, f.strand, f.category,
       substring(c.seq, f.start, f.stop - f.start + 1) AS sequence
FROM features f JOIN contigs c ON f.contig = c.contig
WHERE length(substring(c.seq, f.start, f.stop - f.start + 1)) < 2000""")
def q_genome_sequences_from_features(spark, d):
    return genome.sequences_from_features(S.features(spark, d), S.contigs(spark, d), CHUNK, bound=2000)


# ===================================================================== tokens

from seqedge.operators import motifs, tokens  # noqa: E402
from seqedge.plans.catalog import _pairs  # noqa: E402


def _ids_str(col):
    return F.array_join(F.col(col).cast("array<string>"), " ")


def _token_id_sql(x: str, k: int = 6) -> str:
    single = tokens.KMER_BASE + 4 ** k
    singles = " ".join(f"WHEN {x} = '{b}' THEN {single + i}" for i, b in enumerate(tokens.SINGLE_BASES))
    code = f"list_reduce(list_transform(string_split({x}, ''), lambda ch: instr('ACGT', ch) - 1), lambda a, b: a * 4 + b)"
    return (f"CASE WHEN {x} = '<cls>' THEN {tokens.CLS_ID} WHEN length({x}) = {k} THEN {tokens.KMER_BASE} + {code} "
            f"{singles} ELSE {tokens.UNK_ID} END")


TOKENS_SQL = f"""toks AS (
  SELECT gene, tf, tf_dna,
         ([3] || list_transform(regexp_extract_all(gene_dna || '<cls>' || tf_dna, '(<cls>|[ACGT]{{6}}|.)', 1),
                                lambda x: {_token_id_sql('x')}))[1:32] AS ids FROM pairs)"""


def _tokens(spark, d, padding, only=None):
    """The tokenized pairs, or those of the keys in ``only``."""
    genes = S.genes(spark, d)
    # the TFs' ids come with their sequences, so that the pairs are not shuffled by their sequence once more
    keys = pairs.build_keys(S.prior(spark, d), tfs=tokens.with_sequence_ids(pairs.distinct_tf_sequences(S.tf_seqs(spark, d)), k=6))
    keys = keys if only is None else keys.join(only, ["gene", "tf", "tf_dna"], "left_semi")
    return tokens.tokenize_pairs(keys, k=6, max_length=32, padding=padding, genes=pairs.unique_genes(genes)).select(
        "gene", "tf", "tf_dna", "input_ids", "attention_mask")


@register("tokens_tokenize", with_ctes(*BASE_CTES, TOKENS_SQL) + """
SELECT gene, tf, tf_dna, array_to_string(list_resize(ids, 32, 1), ' ') AS input_ids,
       array_to_string(list_resize(list_transform(ids, lambda x: 1), 32, 0), ' ') AS attention_mask FROM toks""")
def q_tokens_tokenize(spark, d):
    t = _tokens(spark, d, padding=True)
    return t.select("gene", "tf", "tf_dna", _ids_str("input_ids").alias("input_ids"),
                    _ids_str("attention_mask").alias("attention_mask"))


@register("tokens_remove_padding", with_ctes(*BASE_CTES, TOKENS_SQL) + """
SELECT gene, tf, tf_dna, array_to_string(ids, ' ') AS input_ids,
       array_to_string(list_transform(ids, lambda x: 1), ' ') AS attention_mask FROM toks""")
def q_tokens_remove_padding(spark, d):
    t = tokens.remove_padding(_tokens(spark, d, padding=True))
    return t.select("gene", "tf", "tf_dna", _ids_str("input_ids").alias("input_ids"),
                    _ids_str("attention_mask").alias("attention_mask"))


@register("tokens_collate", with_ctes(*BASE_CTES, TOKENS_SQL) + """,
b AS (SELECT *, max(len(ids)) OVER (PARTITION BY gene) AS n FROM toks)
SELECT gene, tf, tf_dna, array_to_string(list_resize(ids, n, 1), ' ') AS input_ids,
       array_to_string(list_resize(list_transform(ids, lambda x: 1), n, 0), ' ') AS attention_mask FROM b""")
def q_tokens_collate(spark, d):
    t = tokens.collate(_tokens(spark, d, padding=False), "gene")
    return t.select("gene", "tf", "tf_dna", _ids_str("input_ids").alias("input_ids"),
                    _ids_str("attention_mask").alias("attention_mask"))


def _cache(spark, d):
    return tokens.build_cache(_tokens(spark, d, padding=True))


def _seqs_str(col="seqs"):
    return F.array_join(F.transform(col, lambda s: F.array_join(s["input_ids"].cast("array<string>"), " ")), ";")


@register("tokens_build_cache", with_ctes(*BASE_CTES, TOKENS_SQL) + """
SELECT gene, tf, CAST(count(*) AS INTEGER) AS n_seqs,
       array_to_string(list_transform(list_sort(list(ids)), lambda s: array_to_string(s, ' ')), ';') AS seqs
FROM toks GROUP BY gene, tf""")
def q_tokens_build_cache(spark, d):
    c = _cache(spark, d)
    return c.select("gene", "tf", F.size("seqs").alias("n_seqs"), _seqs_str().alias("seqs"))


@register("tokens_lookup", with_ctes(*BASE_CTES, TOKENS_SQL, S.EDGES_SQL) + """
SELECT e.gene, e.tf, array_to_string(t.ids, ' ') AS input_ids
FROM (SELECT DISTINCT gene, tf FROM edges) e JOIN toks t ON e.gene = t.gene AND e.tf = t.tf""")
def q_tokens_lookup(spark, d):
    lk = tokens.lookup(S.edges(spark, d).distinct(), _cache(spark, d))
    return lk.select("gene", "tf", _ids_str("input_ids").alias("input_ids"))


@register("tokens_merge_cache", with_ctes(*BASE_CTES, TOKENS_SQL) + """,
c0 AS (SELECT gene, tf, list_sort(list(ids)) AS seqs FROM toks GROUP BY gene, tf),
c1 AS (SELECT gene, tf, list_sort(list(list_reverse(ids))) AS seqs FROM toks t JOIN pairs p USING (gene, tf, tf_dna)
       WHERE p.interaction = 1 GROUP BY gene, tf)
SELECT c0.gene, c0.tf, array_to_string(list_transform(coalesce(c1.seqs, c0.seqs), lambda s: array_to_string(s, ' ')), ';') AS seqs
FROM c0 LEFT JOIN c1 ON c0.gene = c1.gene AND c0.tf = c1.tf""")
def q_tokens_merge_cache(spark, d):
    part0 = tokens.build_cache(_tokens(spark, d, padding=False))
    # keys are matched before they are tokenized, so no token crosses that shuffle
    pos = _tokens(spark, d, padding=False, only=_pairs(spark, d).filter(F.col("interaction") == 1).select("gene", "tf", "tf_dna"))
    part1 = tokens.build_cache(pos.withColumn("input_ids", F.reverse("input_ids")))
    m = tokens.merge_cache([part0, part1], mode="dict")
    return m.select("gene", "tf", _seqs_str().alias("seqs"))


# ===================================================================== motifs

PWM_SQL = """pwm AS (
  SELECT motif_id, pos, a / (a + c + g + t) AS A, c / (a + c + g + t) AS C, g / (a + c + g + t) AS G,
         t / (a + c + g + t) AS T
  FROM (SELECT 'M' || CAST(vec_id AS VARCHAR) AS motif_id, CAST(p AS INTEGER) AS pos,
               abs(CAST(embedding[4 * p - 3] AS DOUBLE)) AS a, abs(CAST(embedding[4 * p - 2] AS DOUBLE)) AS c,
               abs(CAST(embedding[4 * p - 1] AS DOUBLE)) AS g, abs(CAST(embedding[4 * p] AS DOUBLE)) AS t
        FROM (SELECT vec_id, embedding, unnest(range(1, 17)) AS p FROM embeddings) x) y)"""


def _pwm(spark, d):
    e = S.table(spark, d, "embeddings").select("vec_id", "embedding",
                                               F.explode(F.sequence(F.lit(1), F.lit(16))).alias("p"))
    el = {b: F.abs(F.element_at("embedding", F.col("p") * 4 - (3 - i)).cast("double"))
          for i, b in enumerate(["a", "c", "g", "t"])}
    tot = el["a"] + el["c"] + el["g"] + el["t"]
    return e.select(F.concat(F.lit("M"), F.col("vec_id").cast("string")).alias("motif_id"),
                    F.col("p").cast("int").alias("pos"),
                    *[(el[b.lower()] / tot).alias(b) for b in ["A", "C", "G", "T"]])


CODE_CASE = " ".join(f"WHEN b1 || b2 = '{k}' OR b2 || b1 = '{k}' THEN '{v}'" for k, v in motifs.PAIR_CODES.items())


@register("motifs_summarize", with_ctes(PWM_SQL) + f""",
lng AS (SELECT motif_id, pos, base, p FROM (UNPIVOT pwm ON A, C, G, T INTO NAME base VALUE p) u),
rk AS (SELECT *, row_number() OVER (PARTITION BY motif_id, pos ORDER BY p DESC, base) AS r FROM lng),
top AS (SELECT motif_id, pos, max(CASE WHEN r = 1 THEN base END) AS b1, max(CASE WHEN r = 1 THEN p END) AS p1,
               max(CASE WHEN r = 2 THEN base END) AS b2, max(CASE WHEN r = 2 THEN p END) AS p2,
               sum(CASE WHEN p > 0 THEN -p * log2(p) ELSE 0.0 END) AS h FROM rk GROUP BY motif_id, pos),
ch AS (SELECT *, CASE WHEN p1 > 0.5 AND p1 > 2 * p2 THEN b1 WHEN p1 + p2 > 0.75 THEN CASE {CODE_CASE} END
                      ELSE 'N' END AS c FROM top)
SELECT motif_id, round(sum(2.0 - h), 9) AS Information_Content, round(sum(h), 9) AS Shannon_Entropy,
       CAST(count(*) AS INTEGER) AS Length, string_agg(c, '' ORDER BY pos) AS Consensus
FROM ch GROUP BY motif_id""")
def q_motifs_summarize(spark, d):
    s = motifs.summarize(_pwm(spark, d))
    return s.select("motif_id", r9("Information_Content").alias("Information_Content"),
                    r9("Shannon_Entropy").alias("Shannon_Entropy"), "Length", "Consensus")


@register("motifs_group_sequences", with_ctes(S.TF_SEQS_SQL) +
          "SELECT tf, array_to_string(list_sort(list(DISTINCT sequence)), ',') AS sequences FROM tf_seqs GROUP BY tf")
def q_motifs_group_sequences(spark, d):
    g = motifs.group_sequences(S.tf_seqs(spark, d), distinct=True)
    return g.select("tf", F.array_join("sequences", ",").alias("sequences"))


@register("motifs_group_sequences_all", with_ctes(S.TF_SEQS_SQL) +
          "SELECT tf, array_to_string(list_sort(list(sequence)), ',') AS sequences FROM tf_seqs GROUP BY tf")
def q_motifs_group_sequences_all(spark, d):
    g = motifs.group_sequences(S.tf_seqs(spark, d), distinct=False)
    return g.select("tf", F.array_join("sequences", ",").alias("sequences"))


@register("motifs_sequence_parts", with_ctes(S.TF_SEQS_SQL) + """
SELECT tf, part, array_to_string(list(sequence ORDER BY sequence), ',') AS sequences FROM (
  SELECT tf, sequence, CAST((row_number() OVER (PARTITION BY tf ORDER BY sequence) - 1) // 2 AS BIGINT) AS part FROM tf_seqs) x
GROUP BY tf, part""")
def q_motifs_sequence_parts(spark, d):
    """A1 in parts of two."""
    g = motifs.sequence_parts(S.tf_seqs(spark, d), distinct=False, size=2)
    return g.select("tf", "part", F.array_join("sequences", ",").alias("sequences"))


TARGETS_SQL = """targets AS (
  SELECT 'T' || CAST(l_suppkey AS VARCHAR) AS TF, string_agg(DISTINCT 'G' || CAST(l_partkey AS VARCHAR), ', ') AS gene_ids
  FROM lineitem GROUP BY l_suppkey)"""


def _targets(spark, d):
    li = S.table(spark, d, "lineitem").select("l_suppkey", "l_partkey")
    return dealt(li, S.cell_tasks(spark, d), "l_suppkey").groupBy("l_suppkey").agg(
        F.concat_ws(", ", F.collect_set(F.concat(F.lit("G"), F.col("l_partkey").cast("string")))).alias("gene_ids")
    ).select(F.concat(F.lit("T"), F.col("l_suppkey").cast("string")).alias("TF"), "gene_ids")


def _proxy(spark, d):
    prom = S.genes(spark, d).select(F.col("gene").alias("gene_id"), F.col("sequence").alias("promoter_sequence"))
    return motifs.proxy_sequences(_targets(spark, d), prom, tasks=S.cell_tasks(spark, d))


PROXY_SQL = """proxy AS (
  SELECT t.TF, g.gene AS Gene_ID, g.sequence AS Promoter_Sequence
  FROM (SELECT TF, trim(unnest(string_split(gene_ids, ','))) AS gid FROM targets) t JOIN genes g ON t.gid = g.gene)"""


@register("motifs_proxy_sequences", with_ctes(S.GENES_SQL, TARGETS_SQL, PROXY_SQL) +
          "SELECT TF, Gene_ID, Promoter_Sequence FROM proxy")
def q_motifs_proxy_sequences(spark, d):
    return _proxy(spark, d)


@register("motifs_concat_sequences", with_ctes(S.GENES_SQL, TARGETS_SQL, PROXY_SQL) +
          "SELECT TF, string_agg(Promoter_Sequence, ', ' ORDER BY Gene_ID) AS Promoter_Sequence FROM proxy GROUP BY TF")
def q_motifs_concat_sequences(spark, d):
    return motifs.concat_sequences(_proxy(spark, d), "TF", "Promoter_Sequence", "Gene_ID")


@register("motifs_text_parts", with_ctes(S.GENES_SQL, TARGETS_SQL, PROXY_SQL) + """
SELECT TF, part, string_agg(Promoter_Sequence, ', ' ORDER BY Gene_ID) AS Promoter_Sequence FROM (
  SELECT *, CAST((row_number() OVER (PARTITION BY TF ORDER BY Gene_ID) - 1) // 50 AS BIGINT) AS part FROM proxy) x GROUP BY TF, part""")
def q_motifs_text_parts(spark, d):
    """A24 in parts of 50 promoters."""
    return lists.text_parts(_proxy(spark, d), "TF", "Promoter_Sequence", "Gene_ID", size=50)


INFO_SQL = """info AS (
  SELECT p_brand AS TF_Name, 'T' || CAST(p_partkey AS VARCHAR) AS DBID,
         'M' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS Motif_ID FROM part)"""


def _info(spark, d):
    p = S.table(spark, d, "part")
    return p.select(F.col("p_brand").alias("TF_Name"),
                    F.concat(F.lit("T"), F.col("p_partkey").cast("string")).alias("DBID"),
                    F.concat(F.lit("M"), F.lpad(F.col("p_partkey").cast("string"), 8, "0")).alias("Motif_ID"))


@register("motifs_attach_ids", with_ctes(INFO_SQL) + """
SELECT m.name AS TF_Name, m.n, d.DBID FROM
  (SELECT p_brand || CASE WHEN p_size > 25 THEN '' ELSE 'x' END AS name, count(*) AS n FROM part GROUP BY 1) m
LEFT JOIN (SELECT TF_Name, arg_min(DBID, Motif_ID) AS DBID FROM info GROUP BY TF_Name) d ON m.name = d.TF_Name""")
def q_motifs_attach_ids(spark, d):
    p = S.table(spark, d, "part")
    names = p.groupBy(F.concat("p_brand", F.when(F.col("p_size") > 25, "").otherwise("x")).alias("TF_Name")) \
        .agg(F.count(F.lit(1)).alias("n"))
    return motifs.attach_ids(names, _info(spark, d)).select("TF_Name", "n", "DBID")


@register("motifs_combine", with_ctes(PWM_SQL, INFO_SQL) + """
SELECT motif_id AS Motif_ID, NULL AS Motif_Name, round(sum(CASE WHEN p > 0 THEN -p * log2(p) ELSE 0 END), 9) AS Shannon_Entropy,
       CAST(count(DISTINCT pos) AS INTEGER) AS Length, NULL AS DBID
FROM (UNPIVOT pwm ON A, C, G, T INTO NAME base VALUE p) u GROUP BY motif_id
UNION ALL
SELECT Motif_ID, upper(DBID) AS Motif_Name, NULL, NULL, upper(TF_Name) AS DBID FROM info
UNION ALL
SELECT 'R' || CAST(r_regionkey AS VARCHAR), r_name, NULL, NULL, NULL FROM region""")
def q_motifs_combine(spark, d):
    cols = ["Motif_ID", "Motif_Name", "Shannon_Entropy", "Length", "DBID"]
    summ = motifs.summarize(_pwm(spark, d)).select(F.col("motif_id").alias("Motif_ID"),
                                                   r9("Shannon_Entropy").alias("Shannon_Entropy"), "Length")
    info = motifs.normalize_ids(_info(spark, d).withColumnRenamed("TF_Name", "Motif_Name"), ["Motif_Name", "DBID"])
    info = motifs.swap_id_columns(info, "Motif_Name", "DBID")
    manual = S.table(spark, d, "region").select(
        F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("Motif_ID"),
        F.col("r_name").alias("Motif_Name"))
    return motifs.add_manual(motifs.combine(summ, info, columns=cols), manual)


# ===================================================================== sources and sinks (round trips)

from seqedge.sources import readers, writers  # noqa: E402


@register("io_gtf_roundtrip", with_ctes(GTF_FEATURES_SQL) +
          "SELECT contig, start, stop, strand, category, gene_id FROM gtf_features")
def q_io_gtf_roundtrip(spark, d):
    f = _gtf_features(spark, d)
    attrs = F.when(F.col("gene_id").isNull(), F.lit('gene_biotype "unnamed";')).otherwise(
        F.concat(F.lit('gene_id "'), F.col("gene_id"), F.lit('"; gene_name "n'), F.col("gene_id"), F.lit('";')))
    line = F.concat_ws("\t", "contig", F.lit("src"), "category", F.col("start").cast("string"),
                       F.col("stop").cast("string"), F.lit("."), "strand", F.lit("."), attrs)
    header = spark.range(5).select(F.concat(F.lit("#!header line "), F.col("id").cast("string")).alias("value"))
    path = writers.scratch_path(spark, "gtf")
    header.unionByName(f.select(line.alias("value"))).write.text(path)
    return readers.read_gtf(spark, path, "gene_id")


FASTA_SQL = f"""fasta AS (
  SELECT 'c' || CAST(s_suppkey AS VARCHAR) AS contig,
         string_agg({S._dna_sql("'c' || CAST(s_suppkey AS VARCHAR) || '-' || CAST(i AS VARCHAR)")}, '' ORDER BY i) AS seq
  FROM (SELECT s_suppkey, unnest(range(0, 10)) AS i FROM supplier) x GROUP BY s_suppkey)"""


@register("io_fasta_roundtrip", with_ctes(FASTA_SQL) + """
SELECT contig, CAST(c AS INTEGER) AS chunk, CAST(c * 100 AS BIGINT) AS offset,
       substring(seq, CAST(c * 100 + 1 AS BIGINT), 100) AS seq
FROM (SELECT contig, seq, unnest(range(0, CAST(ceil(length(seq) / 100.0) AS BIGINT))) AS c FROM fasta) x""")
def q_io_fasta_roundtrip(spark, d):
    from seqedge.functions.dna import dna_from_key
    s = S.table(spark, d, "supplier").select("s_suppkey", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("i"))
    block = dna_from_key(F.concat(F.lit("c"), F.col("s_suppkey").cast("string"), F.lit("-"), F.col("i").cast("string")))
    seqs = s.groupBy("s_suppkey").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("i", block.alias("b")))), lambda x: x["b"]), "").alias("seq"))
    wrapped = F.regexp_replace(F.col("seq"), "(.{60})", "$1\n")
    rec = F.concat(F.lit(">c"), F.col("s_suppkey").cast("string"), F.lit(" stand-in contig\n"), wrapped)
    path = writers.scratch_path(spark, "fasta")
    seqs.select(rec.alias("value")).write.text(path)
    return readers.read_fasta(spark, path, chunk=100)


@register("io_matrix_roundtrip", with_ctes(S.PRIOR_SQL) + "SELECT gene, tf, value FROM prior")
def q_io_matrix_roundtrip(spark, d):
    path = writers.scratch_path(spark, "matrix")
    writers.write_wide(S.prior(spark, d), path, fill=None, compression="gzip")
    return readers.read_matrix(spark, path, blanks=False).filter(F.col("value").isNotNull())


@register("io_matrix_wide", with_ctes(S.PRIOR_SQL) + "SELECT gene, tf, value FROM prior")
def q_io_matrix_wide(spark, d):
    """The transposed matrix: a column for every gene, written and read without a table of that width."""
    path = writers.scratch_path(spark, "wide-matrix")
    writers.write_wide(S.prior(spark, d), path, row="tf", col="gene", fill=None, compression="gzip")
    return readers.read_matrix(spark, path, row="tf", col="gene", blanks=False).filter(F.col("value").isNotNull()).select("gene", "tf", "value")


@register("io_threshold_log", """
SELECT round(value / 500, 9) AS best_f1_score, round(value / 1000, 9) AS best_threshold, event_id AS seq FROM events""")
def q_io_threshold_log(spark, d):
    """S9 + S8: the threshold log, appended to twice and read back."""
    log = S.table(spark, d, "events").select(F.round(F.col("value") / 500, 9).alias("best_f1_score"),
                                             F.round(F.col("value") / 1000, 9).alias("best_threshold"), F.col("event_id").cast("bigint").alias("seq"))
    path = writers.scratch_path(spark, "threshold-log")
    for half in (F.col("seq") % 2 == 0, F.col("seq") % 2 != 0):
        writers.write_jsonl(log.filter(half), path)
    return readers.read_threshold_log(spark, path)


@register("io_edges_roundtrip", with_ctes(S.EDGES_SQL) + "SELECT tf, gene FROM edges")
def q_io_edges_roundtrip(spark, d):
    path = writers.scratch_path(spark, "edges")
    S.edges(spark, d).select(F.col("tf").alias("Gene1"), F.col("gene").alias("Gene2")) \
        .write.option("header", True).csv(path)
    return readers.read_edges(spark, path)


@register("io_tsv_roundtrip", with_ctes(S.GENES_SQL) + "SELECT gene, sequence FROM genes")
def q_io_tsv_roundtrip(spark, d):
    path = writers.scratch_path(spark, "tsv")
    writers.write_tsv(S.genes(spark, d), path)
    return readers.read_tsv(spark, path, "gene STRING, sequence STRING")


@register("io_jsonl_roundtrip", with_ctes(*BASE_CTES, SCORED_PAIRS_SQL, PREDICTIONS_SQL) +
          "SELECT gene, tf, prediction FROM predictions")
def q_io_jsonl_roundtrip(spark, d):
    pred = cut(_predictions(spark, d).select(F.col("gene").alias("gene_id"), F.col("tf").alias("DBID"), "prediction"), "predictions")
    path = writers.scratch_path(spark, "jsonl")
    # two appends, as shards from two inference jobs
    writers.write_jsonl(pred.filter(F.col("prediction") >= 0.5), path)
    writers.write_jsonl(pred.filter(F.col("prediction") < 0.5), path)
    return readers.read_predictions(spark, path)


@register("io_summary_roundtrip", with_ctes(S.SCORED_SQL, _ranking_cte("scored", "score", "label")) +
          "SELECT roc_auc, best_f1, best_threshold, auprc, average_precision, n_pos, n_neg FROM rs")
def q_io_summary_roundtrip(spark, d):
    from seqedge.plans.catalog import QUERIES
    path = writers.scratch_path(spark, "summary")
    writers.write_summary(QUERIES["metrics_ranking_summary"](spark, d), path)
    return spark.read.schema("roc_auc DOUBLE, best_f1 DOUBLE, best_threshold DOUBLE, auprc DOUBLE, "
                             "average_precision DOUBLE, n_pos BIGINT, n_neg BIGINT").json(path)


@register("io_materialize", with_ctes(*BASE_CTES) + "SELECT gene, gene_dna, tf, tf_dna, interaction FROM pairs")
def q_io_materialize(spark, d):
    path = writers.scratch_path(spark, "pairs")
    first = writers.materialize(_pairs(spark, d), path)
    # a second call finds the output and skips the work (mode 'ignore')
    return writers.materialize(_pairs(spark, d).limit(0), path).select(*first.columns)


@register("io_token_cache_roundtrip", with_ctes(*BASE_CTES, TOKENS_SQL) + """
SELECT gene, tf, CAST(count(*) AS INTEGER) AS n_seqs,
       array_to_string(list_transform(list_sort(list(ids)), lambda s: array_to_string(s, ' ')), ';') AS seqs
FROM toks GROUP BY gene, tf""")
def q_io_token_cache_roundtrip(spark, d):
    path = writers.scratch_path(spark, "cache")
    tokens.write_cache(_cache(spark, d), path, max_records_per_file=10000)
    c = tokens.load_tokens(spark, path)
    return c.select("gene", "tf", F.size("seqs").alias("n_seqs"), _seqs_str().alias("seqs"))


@register("io_tokens_saved", with_ctes(*BASE_CTES, TOKENS_SQL) +
          "SELECT gene, tf, tf_dna, array_to_string(ids, ' ') AS input_ids FROM toks")
def q_io_tokens_saved(spark, d):
    """The tokenized pairs saved and loaded."""
    path = writers.scratch_path(spark, "tokens")
    tokens.save_tokens(_tokens(spark, d, padding=False), path)
    return tokens.load_tokens(spark, path).select("gene", "tf", "tf_dna", _ids_str("input_ids").alias("input_ids"))


@register("tokens_cache_parts", with_ctes(*BASE_CTES, TOKENS_SQL) + """
SELECT tf, part, array_to_string(list(s ORDER BY ids), ';') AS seqs FROM (
  SELECT tf, ids, array_to_string(ids, ' ') AS s, CAST((row_number() OVER (PARTITION BY tf ORDER BY ids) - 1) // 100 AS BIGINT) AS part FROM toks) x
GROUP BY tf, part""")
def q_tokens_cache_parts(spark, d):
    """A4 over TFs, whose lists grow with the genes, in parts of 100."""
    parts = tokens.cache_parts(_tokens(spark, d, padding=True), keys=("tf",), size=100)
    return parts.select("tf", "part", _seqs_str().alias("seqs"))


@register("io_cache_by_size", with_ctes(*BASE_CTES, TOKENS_SQL) + """
SELECT tf, CAST(count(*) AS BIGINT) AS n_seqs, CAST(1 AS BIGINT) AS n_files FROM toks GROUP BY tf""")
def q_io_cache_by_size(spark, d):
    """A skewed cache (lists per TF, in parts) in files of 1 MB, each TF in one file."""
    path = writers.scratch_path(spark, "sized-cache")
    parts = cut(tokens.cache_parts(_tokens(spark, d, padding=False), keys=("tf",), size=100), "cache-parts")
    tokens.write_cache(parts, path, max_bytes=1 << 20, keys=("tf",))
    return spark.read.parquet(path).groupBy("tf").agg(F.sum(F.size("seqs")).alias("n_seqs"), F.count_distinct(tokens.FILE).alias("n_files"))


# ===================================================================== runs

from seqedge.operators import runs, scoring  # noqa: E402


@register("runs_best", """
SELECT event_type, arg_max(user_id, (m, user_id)) AS user_id, max(m) AS m
FROM (SELECT event_type, user_id, round(avg(value) / 500, 9) AS m FROM events GROUP BY event_type, user_id) x
GROUP BY event_type""")
def q_runs_best(spark, d):
    ev = S.table(spark, d, "events").groupBy("event_type", "user_id").agg(r9(F.avg("value") / 500).alias("m"))
    return runs.best(ev, "m", run="user_id", by=["event_type"])


@register("runs_latest", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
def q_runs_latest(spark, d):
    return runs.latest(S.table(spark, d, "events"), "user_id", "ts", "event_id")


@register("runs_next_threshold", """
SELECT user_id, arg_max(value / 500, event_id) AS next_threshold FROM events GROUP BY user_id""")
def q_runs_next_threshold(spark, d):
    log = S.table(spark, d, "events").select("user_id", F.col("event_id").alias("seq"),
                                             (F.col("value") / 500).alias("best_threshold"))
    return runs.next_threshold(log, by=["user_id"])


@register("runs_round_seed", """
SELECT user_id, r AS round,
       CAST(CAST('0x' || substr(md5(CAST(user_id AS VARCHAR) || '|' || CAST(r AS VARCHAR)), 1, 8) AS BIGINT)
            % 2147483648 AS BIGINT) AS seed
FROM (SELECT DISTINCT user_id FROM events) u, range(0, 3) t(r)""")
def q_runs_round_seed(spark, d):
    u = S.table(spark, d, "events").select("user_id").distinct()
    u = u.select("user_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("round"))
    return u.select("user_id", F.col("round").cast("bigint").alias("round"),
                    runs.round_seed(F.col("user_id"), F.col("round")).alias("seed"))


@register("runs_flatten_options", """
SELECT event_id, 'event_type=' || event_type || ',ids.user_id=' || CAST(user_id AS VARCHAR)
       || ',ids.event_id=' || CAST(event_id AS VARCHAR) AS options FROM events""")
def q_runs_flatten_options(spark, d):
    ev = S.table(spark, d, "events").select(
        "event_id", F.struct("event_type", F.struct("user_id", "event_id").alias("ids")).alias("cfg"))
    f = runs.flatten_options(ev, "cfg")
    return f.select("event_id", F.array_join("options", ",").alias("options"))


def _scorer(p):
    return scoring.kmer_overlap(p, k=4)


def _round_sql(n: int, threshold: str) -> str:
    """The evaluation of round ``n``, whose labels are the prior at ``threshold``."""
    return f"""ev{n} AS (SELECT p.prediction, CAST(t.value >= {threshold} AS INTEGER) AS interaction
        FROM predictions p LEFT JOIN prior t ON p.gene = t.gene AND p.tf = t.tf),
r{n} AS (WITH {_ranking_cte(f"ev{n}", "prediction", "interaction")} SELECT * FROM rs)"""


@register("runs_iterate", with_ctes(*BASE_CTES, SCORED_PAIRS_SQL, PREDICTIONS_SQL, S.GOLD_SQL) + f""",
rows_ AS (SELECT DISTINCT gene FROM predictions INTERSECT SELECT DISTINCT gene FROM gold),
cols_ AS (SELECT DISTINCT tf FROM predictions INTERSECT SELECT DISTINCT tf FROM gold),
-- oracle only: the dense block by brute force
cells AS (SELECT coalesce(p.prediction, 0.0) AS score, coalesce(CAST(g.value >= 0.5 AS INTEGER), 0) AS label
          FROM rows_ r CROSS JOIN cols_ c
          LEFT JOIN predictions p ON p.gene = r.gene AND p.tf = c.tf
          LEFT JOIN gold g ON g.gene = r.gene AND g.tf = c.tf),
au AS (WITH {_ranking_cte("cells", "score", "label")} SELECT auprc FROM rs),
{_round_sql(0, "0.5")},
t1 AS (SELECT CASE WHEN thr_raw <> 0 THEN thr_raw ELSE 0.5 END AS t FROM r0),
{_round_sql(1, "(SELECT t FROM t1)")}
SELECT CAST(0 AS INTEGER) AS round, CAST(0.5 AS DOUBLE) AS threshold, best_f1, best_threshold, roc_auc, (SELECT auprc FROM au) AS auprc_vs_gold FROM r0
UNION ALL
SELECT CAST(1 AS INTEGER), round((SELECT t FROM t1), 9), best_f1, best_threshold, roc_auc, (SELECT auprc FROM au) FROM r1""")
def q_runs_iterate(spark, d):
    out = runs.iterate(spark, S.prior(spark, d), S.genes(spark, d), S.tf_seqs(spark, d), _scorer,
                       n_rounds=2, threshold=0.5, gold=S.gold(spark, d), digits=9)
    return out.select(*[r9(c).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


@register("runs_run_name", """
SELECT p_partkey, 'batching-cw_0.' || CAST(p_size % 10 AS VARCHAR) || '_1.0-dsr_0.' || CAST(p_size % 7 AS VARCHAR)
       || '-gas_' || CAST(p_size AS VARCHAR) AS run_name FROM part""")
def q_runs_run_name(spark, d):
    """F9 over settings held in a table."""
    from seqedge.functions.text import run_name
    p = S.table(spark, d, "part")
    weights = F.concat(F.lit("[0."), (F.col("p_size") % 10).cast("string"), F.lit(",1.0]"))
    rate = F.concat(F.lit("0."), (F.col("p_size") % 7).cast("string"))
    return p.select("p_partkey", run_name(weights, rate, "p_size").alias("run_name"))


# ===================================================================== user models

@register("score_pairs_model", with_ctes(*BASE_CTES, SCORED_PAIRS_SQL) +
          "SELECT gene, tf, tf_dna, round(score, 9) AS score FROM scored_pairs")
def q_score_pairs_model(spark, d):
    s = scoring.score_pairs(_pairs(spark, d), lambda: scoring.KmerShareModel(k=4), keys=("gene", "tf", "tf_dna"))
    return s.select("gene", "tf", "tf_dna", r9("score").alias("score"))


CLASSIFIER = {"k": 3, "class_weights": (0.3, 1.0), "max_iter": 8}


def _classifier_sql(k: int, class_weights: tuple, max_iter: int) -> str:
    """The same gradient steps, each a few CTEs; ``w{n}`` are the weights, the intercept under ''."""
    w0, w1 = class_weights
    rate = 1.0 / (0.25 * 5 * max(w0, w1))
    mers = f"list_transform(range(1, length(s) - {k} + 2), lambda i: substring(s, i, {k}))"
    steps = [f"""seqs AS MATERIALIZED (SELECT sequence AS s FROM genes UNION SELECT sequence FROM tf_seqs),
vec AS MATERIALIZED (SELECT s, kmer, count(*) / CAST(any_value(length(s) - {k} + 1) AS DOUBLE) AS share
                     FROM (SELECT s, unnest({mers}) AS kmer FROM seqs) x GROUP BY s, kmer),
base AS MATERIALIZED (SELECT gene_dna AS g, tf_dna AS t, CAST(interaction AS DOUBLE) AS y, count(*) AS n FROM pairs GROUP BY ALL),
total AS (SELECT sum(n) AS n FROM base),
w0 AS MATERIALIZED (SELECT '' AS kmer, CAST(0 AS DOUBLE) AS w, CAST(0 AS DOUBLE) AS v)"""]
    for i in range(max_iter):
        steps.append(f"""m{i} AS MATERIALIZED (SELECT s, sum(share * w.v) AS m FROM vec JOIN w{i} w USING (kmer) GROUP BY s),
z{i} AS MATERIALIZED (SELECT g, t, y, n, (SELECT v FROM w{i} WHERE kmer = '') + coalesce(a.m, 0) + coalesce(b.m, 0) AS z
    FROM base LEFT JOIN m{i} a ON a.s = g LEFT JOIN m{i} b ON b.s = t),
r{i} AS MATERIALIZED (SELECT g, t, n / (SELECT n FROM total) * ({w1} * y * (1 / (1 + exp(-z)) - 1) + {w0} * (1 - y) / (1 + exp(-z))) AS r FROM z{i}),
d{i} AS MATERIALIZED (SELECT kmer, sum(share * r) AS d FROM (SELECT g AS s, r FROM r{i} UNION ALL SELECT t, r FROM r{i}) x JOIN vec USING (s) GROUP BY kmer
    UNION ALL SELECT '', sum(r) FROM r{i}),
w{i + 1} AS MATERIALIZED (SELECT kmer, w, w + {i / (i + 3)!r} * (w - old) AS v
    FROM (SELECT d.kmer, coalesce(p.v, 0) - {rate!r} * d.d AS w, coalesce(p.w, 0) AS old FROM d{i} d LEFT JOIN w{i} p USING (kmer)) x)""")
    n = max_iter
    steps.append(f"""mf AS MATERIALIZED (SELECT s, sum(share * w.w) AS m FROM vec JOIN w{n} w USING (kmer) WHERE kmer <> '' GROUP BY s)""")
    return ",\n".join(steps)


def _edge_model(spark, d):
    sequences = S.genes(spark, d).select("sequence").unionByName(S.tf_seqs(spark, d).select("sequence"))
    return scoring.fit_edge_classifier(_pairs(spark, d), label="interaction", sequences=sequences, **CLASSIFIER), sequences


@register("score_edge_classifier", with_ctes(*BASE_CTES, _classifier_sql(**CLASSIFIER)) + f"""
SELECT gene, tf, tf_dna, interaction,
       round(1 / (1 + exp(-((SELECT w FROM w{CLASSIFIER["max_iter"]} WHERE kmer = '') + coalesce(a.m, 0) + coalesce(b.m, 0)))), 6) AS score
FROM pairs LEFT JOIN mf a ON a.s = gene_dna LEFT JOIN mf b ON b.s = tf_dna""")
def q_score_edge_classifier(spark, d):
    model, sequences = _edge_model(spark, d)
    scored = scoring.predict_edges(model, _pairs(spark, d), sequences=sequences)
    return scored.select("gene", "tf", "tf_dna", "interaction", F.round("score", 6).alias("score"))


@register("score_edge_weights", with_ctes(*BASE_CTES, _classifier_sql(**CLASSIFIER)) +
          f"SELECT kmer, round(w, 6) AS weight FROM w{CLASSIFIER['max_iter']}")
def q_score_edge_weights(spark, d):
    model, _ = _edge_model(spark, d)
    rows = [*model.weights.items(), ("", model.intercept)]
    return spark.createDataFrame(rows, "kmer string, weight double").select("kmer", F.round("weight", 6).alias("weight"))


@register("metrics_class_distribution", """
SELECT vec_id, array_to_string([round(1 - label / 9.0, 9), round(label / 9.0, 9)], ' ') AS dist FROM embeddings""")
def q_metrics_class_distribution(spark, d):
    from seqedge.functions.arrays import class_distribution
    e = S.table(spark, d, "embeddings").select("vec_id", class_distribution(F.col("label") / 9.0).alias("a"))
    return e.select("vec_id", F.array_join(F.transform("a", lambda x: F.round(x, 9).cast("string")), " ").alias("dist"))


@register("io_pwm_roundtrip")
def q_io_pwm_roundtrip(spark, d):
    """S7 + A23: PWM tables written one folder per motif, read back, summarized."""
    path = writers.scratch_path(spark, "pwm")
    writers.file_per_key(_pwm(spark, d), "motif_id").option("sep", "\t").option("header", True).csv(path)
    s = motifs.summarize(readers.read_pwms(spark, path, layout="partitioned"))
    return s.select("motif_id", r9("Information_Content").alias("Information_Content"),
                    r9("Shannon_Entropy").alias("Shannon_Entropy"), "Length", "Consensus")


from seqedge.plans.catalog import ORACLE as _ORACLE  # noqa: E402

_ORACLE["io_pwm_roundtrip"] = _ORACLE["motifs_summarize"]


@register("io_pwm_corpus", _ORACLE["motifs_summarize"] + """
UNION ALL SELECT 'H' || CAST(label AS VARCHAR), NULL, NULL, CAST(0 AS INTEGER), NULL FROM (SELECT DISTINCT label FROM embeddings) e""")
def q_io_pwm_corpus(spark, d):
    """S7 + A23 in the corpus layout: a file for every motif, some with a header only, each read once. The files are listed
    by the driver, so they are written and read in parts of a bounded number; a motif is whole in its file, so its part's summary is its summary."""
    path, summaries = (writers.scratch_path(spark, name) for name in ("pwm-corpus", "pwm-summaries"))
    line = F.concat_ws("\t", *[F.col(c).cast("string") for c in ("pos", "A", "C", "G", "T")])
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("l")))), lambda x: x["l"]), "\n")
    header = F.lit("Pos\tA\tC\tG\tT")
    full = _pwm(spark, d).groupBy("motif_id").agg(body.alias("b")).select("motif_id", F.concat(header, F.lit("\n"), F.col("b")).alias("value"))
    bare = S.table(spark, d, "embeddings").select(F.concat(F.lit("H"), F.col("label").cast("string")).alias("motif_id"), header.alias("value")).distinct()
    files = full.unionByName(bare).select("value", F.concat("motif_id", F.lit(".txt")).alias("file"))
    for i, some in enumerate(writers.key_batches(files, "file")):
        writers.file_per_key(some, "file", folders=64).text(f"{path}/part-{i}")
        s = motifs.summarize(readers.read_pwms(spark, f"{path}/part-{i}", id_pattern=r"file=([^/]+)\.txt/"))
        s.write.mode("append").parquet(summaries)
    s = spark.read.schema(s.schema).parquet(summaries)
    return s.select("motif_id", r9("Information_Content").alias("Information_Content"),
                    r9("Shannon_Entropy").alias("Shannon_Entropy"), "Length", "Consensus")


@register("metrics_fill_nulls", """
SELECT event_id, CASE WHEN event_type = 'error' OR user_id % 7 = 0 THEN 0.0 ELSE value END AS v, CASE WHEN event_type = 'view' THEN 0 ELSE user_id END AS k,
       CAST(event_type = 'error' OR user_id % 7 = 0 AS INTEGER) + CAST(event_type = 'view' AS INTEGER) AS n_filled FROM events""")
def q_metrics_fill_nulls(spark, d):
    """P20: NULL and NaN filled, with the number of values filled in each row."""
    ev = S.table(spark, d, "events")
    holes = ev.select("event_id", F.when(F.col("event_type") == "error", F.lit(float("nan"))).when(F.col("user_id") % 7 != 0, F.col("value")).alias("v"),
                      F.when(F.col("event_type") != "view", F.col("user_id")).alias("k"))
    return metrics.fill_nulls(holes, ["v", "k"], count_col="n_filled")


# ===================================================================== end-to-end flows

from seqedge.plans import flows  # noqa: E402


def _md5_ids(seed: int, alias: str = "") -> str:
    a = f"{alias}." if alias else ""
    return f"md5('{seed}|' || {a}gene || '|' || {a}tf || '|' || {a}tf_dna), {a}gene, {a}tf, {a}tf_dna"


def _training_sql(cap: str) -> str:
    return with_ctes(*BASE_CTES, TOKENS_SQL) + f""",
s AS (SELECT p.gene, p.tf, p.tf_dna, p.interaction, t.ids,
             CASE WHEN row_number() OVER (ORDER BY {_md5_ids(0, 'p')}) <= floor(count(*) OVER () * 0.8)
                  THEN 'train' ELSE 'dev' END AS split
      FROM pairs p JOIN toks t ON p.gene = t.gene AND p.tf = t.tf AND p.tf_dna = t.tf_dna),
neg AS (SELECT *, row_number() OVER (ORDER BY {_md5_ids(1)}) AS r, count(*) OVER () AS n
        FROM s WHERE split = 'train' AND interaction = 0),
dev AS (SELECT *, row_number() OVER (ORDER BY {_md5_ids(2)}) AS r FROM s WHERE split = 'dev')
SELECT gene, tf, tf_dna, interaction, split, array_to_string(ids, ' ') AS input_ids FROM s
WHERE split = 'train' AND interaction > 0
UNION ALL
SELECT gene, tf, tf_dna, interaction, split, array_to_string(ids, ' ') FROM neg WHERE r <= floor(n * 0.3)
UNION ALL
SELECT gene, tf, tf_dna, interaction, split, array_to_string(ids, ' ') FROM dev{cap}"""


@register("flow_training_set", _training_sql(" WHERE r <= 5000"))
def q_flow_training_set(spark, d):
    t = flows.training_set(S.prior(spark, d), S.genes(spark, d), S.tf_seqs(spark, d), threshold=0.5,
                           train_prop=0.8, downsample_rate=0.3, seed=0, k=6, max_length=32, max_eval=5000)
    return t.select("gene", "tf", "tf_dna", "interaction", "split", _ids_str("input_ids").alias("input_ids"))


@register("flow_training_set_whole", _training_sql(""))
def q_flow_training_set_whole(spark, d):
    """The same flow with all dev rows."""
    t = flows.training_set(S.prior(spark, d), S.genes(spark, d), S.tf_seqs(spark, d), threshold=0.5,
                           train_prop=0.8, downsample_rate=0.3, seed=0, k=6, max_length=32)
    return t.select("gene", "tf", "tf_dna", "interaction", "split", _ids_str("input_ids").alias("input_ids"))


@register("flow_inference", with_ctes(*BASE_CTES, SCORED_PAIRS_SQL, PREDICTIONS_SQL) +
          "SELECT gene, tf, prediction FROM predictions")
def q_flow_inference(spark, d):
    path = writers.scratch_path(spark, "inference")
    p = flows.inference(S.edges(spark, d), S.genes(spark, d), S.tf_seqs(spark, d), path, n_shards=4,
                        scorer=lambda x: scoring.kmer_overlap(x, k=4))
    return p.select("gene", "tf", r9("prediction").alias("prediction"))
