"""Registered queries: one per operator, each with its DuckDB oracle.

A query is ``fn(spark, sf_dir) -> DataFrame`` over the driver's tables (or
stand-ins derived from them, see ``standins``). ``ORACLE[name]`` is the
same computation in SQL; a query without an oracle gets a rows-only check.
Doubles that come out of sums are rounded to 9 digits on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqedge.functions.arrays import softmax
from seqedge.operators import metrics, pairs, ranking, sampling, scoring
from seqedge.plans import standins as S
from seqedge.plans.standins import with_ctes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

Q = Callable[[SparkSession, str], DataFrame]


def register(name: str, sql: str | None = None):
    def deco(fn: Q) -> Q:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


def r9(col) -> F.Column:
    return F.round(F.col(col) if isinstance(col, str) else col, 9)


def kmers_sql(s: str, k: int) -> str:
    """DuckDB twin of ``functions.dna.kmer_set``."""
    return f"list_distinct(list_transform(range(1, length({s}) - {k} + 2), lambda i: substring({s}, i, {k})))"


def kmer_score_sql(gene: str, tf: str, k: int) -> str:
    t, g = kmers_sql(tf, k), kmers_sql(gene, k)
    return f"CASE WHEN len({t}) > 0 THEN CAST(len(list_intersect({t}, {g})) AS DOUBLE) / len({t}) END"


# ===================================================================== pairs

PAIRS_SQL = """pairs AS (
  SELECT p.gene, g.sequence AS gene_dna, p.tf, t.sequence AS tf_dna,
         CAST(p.value >= 0.5 AS INTEGER) AS interaction
  FROM prior p
  JOIN (SELECT gene, max(sequence) AS sequence FROM genes GROUP BY gene) g ON p.gene = g.gene
  JOIN (SELECT DISTINCT tf, sequence FROM tf_seqs) t ON p.tf = t.tf
  WHERE p.value IS NOT NULL AND NOT isnan(p.value))"""

BASE_CTES = [S.GENES_SQL, S.TF_SEQS_SQL, S.PRIOR_SQL, PAIRS_SQL]


def _pairs(spark, d):
    return pairs.build(S.prior(spark, d), S.genes(spark, d), S.tf_seqs(spark, d), threshold=0.5, tasks=S.cell_tasks(spark, d))


@register("pairs_build", with_ctes(*BASE_CTES) + "SELECT gene, gene_dna, tf, tf_dna, interaction FROM pairs")
def q_pairs_build(spark, d):
    return _pairs(spark, d)


@register("pairs_missing_report", with_ctes(S.GENES_SQL, S.TF_SEQS_SQL, S.PRIOR_SQL) + """
SELECT 'gene' AS kind, gene AS id FROM (SELECT DISTINCT gene FROM prior) p
WHERE gene NOT IN (SELECT gene FROM genes WHERE length(sequence) < 60)
UNION ALL
SELECT 'tf' AS kind, tf AS id FROM (SELECT DISTINCT tf FROM prior) p
WHERE tf NOT IN (SELECT tf FROM tf_seqs)""")
def q_pairs_missing_report(spark, d):
    from seqedge.operators.genome import max_length
    return pairs.missing_report(S.prior(spark, d), max_length(S.genes(spark, d), 60), S.tf_seqs(spark, d))


@register("pairs_gene_counts", with_ctes(S.PRIOR_SQL) + """
SELECT gene, count(*) FILTER (WHERE value >= 0.5) AS n_interactions, count(*) FILTER (WHERE value < 0.5) AS n_non_interactions
FROM prior WHERE value IS NOT NULL GROUP BY gene""")
def q_pairs_gene_counts(spark, d):
    return pairs.gene_counts(S.prior(spark, d), 0.5)


@register("pairs_listed", with_ctes(S.TF_SEQS_SQL, S.EDGES_SQL) + """
SELECT e.gene, e.tf, t.sequence AS tf_dna
FROM (SELECT DISTINCT gene, tf FROM edges) e JOIN (SELECT DISTINCT tf, sequence FROM tf_seqs) t ON e.tf = t.tf""")
def q_pairs_listed(spark, d):
    return pairs.listed(S.edges(spark, d).distinct(), S.tf_seqs(spark, d)).select("gene", "tf", "tf_dna")


@register("pairs_shard", with_ctes(S.PRIOR_SQL) + """
SELECT gene, CAST(floor((row_number() OVER (ORDER BY md5('7|' || gene), gene) - 1)
                        / ceil(count(*) OVER () / 4.0)) AS BIGINT) AS shard
FROM (SELECT DISTINCT gene FROM prior) g""")
def q_pairs_shard(spark, d):
    genes = S.prior(spark, d).select("gene").distinct()
    return pairs.shard(genes, "gene", 4, seed=7)


# ===================================================================== scoring

SCORED_PAIRS_SQL = f"""scored_pairs AS (
  SELECT gene, tf, tf_dna, interaction, {kmer_score_sql('gene_dna', 'tf_dna', 4)} AS score FROM pairs)"""

PREDICTIONS_SQL = """predictions AS (
  SELECT gene, tf, round(avg(score), 9) AS prediction FROM scored_pairs
  WHERE score IS NOT NULL GROUP BY gene, tf)"""


@register("score_kmer_overlap", with_ctes(*BASE_CTES, SCORED_PAIRS_SQL) +
          "SELECT gene, tf, tf_dna, interaction, round(score, 9) AS score FROM scored_pairs")
def q_score_kmer_overlap(spark, d):
    s = scoring.kmer_overlap(_pairs(spark, d), k=4)
    return s.select("gene", "tf", "tf_dna", "interaction", r9("score").alias("score"))


def _predictions(spark, d):
    s = scoring.kmer_overlap(_pairs(spark, d), k=4)
    return scoring.mean_by_pair(s, tasks=S.cell_tasks(spark, d)).withColumn("prediction", r9("prediction"))


@register("score_mean_by_pair", with_ctes(*BASE_CTES, SCORED_PAIRS_SQL, PREDICTIONS_SQL) +
          "SELECT gene, tf, prediction FROM predictions")
def q_score_mean_by_pair(spark, d):
    return _predictions(spark, d)


EVAL_SQL = """eval AS (
  SELECT p.gene, p.tf, p.prediction, CAST(p.prediction >= 0.5 AS INTEGER) AS predicted_interaction,
         CAST(t.value >= 0.5 AS INTEGER) AS interaction
  FROM predictions p LEFT JOIN prior t ON p.gene = t.gene AND p.tf = t.tf)"""


def _ranking_cte(src: str, score: str, label: str) -> str:
    """DuckDB twin of ``metrics.ranking_summary`` as CTEs ending in ``rs``
    (global windows are fine in the oracle; ``s.thr`` is the raw threshold)."""
    return f"""g AS (SELECT {score} AS score, sum({label}) AS pos, count(*) - sum({label}) AS neg
       FROM {src} WHERE {score} IS NOT NULL AND {label} IS NOT NULL GROUP BY {score}),
c AS (SELECT score, pos, neg,
             sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp,
             sum(pos) OVER () AS P, sum(neg) OVER () AS N FROM g),
m AS (SELECT *, CASE WHEN P + tp + fp = 0 THEN 0.0 ELSE 2.0 * tp / (P + tp + fp) END AS f1,
             CAST(tp AS DOUBLE) / (tp + fp) AS prec,
             CASE WHEN tp - pos + fp - neg = 0 THEN CAST(tp AS DOUBLE) / (tp + fp)
                  ELSE CAST(tp - pos AS DOUBLE) / (tp - pos + fp - neg) END AS prec_prev FROM c),
s AS (SELECT max(P) AS P, max(N) AS N, sum(neg * (2 * tp - pos) / 2.0) AS auc_num,
             arg_max(score, (f1, score)) AS thr, max(f1) AS f1,
             sum(CAST(pos AS DOUBLE) / P * (prec + prec_prev) / 2.0) AS auprc,
             sum(CAST(pos AS DOUBLE) / P * prec) AS ap FROM m),
rs AS (
SELECT round(CASE WHEN coalesce(P, 0) > 0 AND coalesce(N, 0) > 0 THEN auc_num / (CAST(P AS DOUBLE) * N) END, 9) AS roc_auc,
       round(CASE WHEN coalesce(P, 0) > 0 THEN f1 ELSE 0.0 END, 9) AS best_f1,
       round(CASE WHEN coalesce(P, 0) > 0 THEN CAST(thr AS DOUBLE) ELSE 0.0 END, 9) AS best_threshold,
       round(CASE WHEN coalesce(P, 0) > 0 THEN auprc END, 9) AS auprc,
       round(CASE WHEN coalesce(P, 0) > 0 THEN ap END, 9) AS average_precision,
       CAST(coalesce(P, 0) AS BIGINT) AS n_pos, CAST(coalesce(N, 0) AS BIGINT) AS n_neg,
       CASE WHEN coalesce(P, 0) > 0 THEN CAST(thr AS DOUBLE) ELSE 0.0 END AS thr_raw FROM s)"""


RS_COLS = "roc_auc, best_f1, best_threshold, auprc, average_precision, n_pos, n_neg"


def _rounded_summary(df: DataFrame) -> DataFrame:
    return df.select(*[r9(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _evaluated(spark, d):
    return metrics.evaluate_against_prior(_predictions(spark, d), S.prior(spark, d), 0.5, tasks=S.cell_tasks(spark, d))


@register("edge_eval", with_ctes(*BASE_CTES, SCORED_PAIRS_SQL, PREDICTIONS_SQL, EVAL_SQL,
                                 _ranking_cte("eval", "prediction", "interaction")) + f"SELECT {RS_COLS} FROM rs")
def q_edge_eval(spark, d):
    """The flagship: pair dataset -> k-mer scores -> mean per pair ->
    evaluation against the prior -> ROC-AUC, best F1, AUPRC."""
    ev = _evaluated(spark, d)
    return _rounded_summary(metrics.ranking_summary(ev, "prediction", "interaction"))


@register("eval_against_prior", with_ctes(*BASE_CTES, SCORED_PAIRS_SQL, PREDICTIONS_SQL, EVAL_SQL) +
          """SELECT gene, tf, prediction, predicted_interaction, interaction,
                    predicted_interaction = interaction AS correct FROM eval""")
def q_eval_against_prior(spark, d):
    ev = _evaluated(spark, d)
    return ev.select("gene", "tf", "prediction", "predicted_interaction", "interaction", "correct")


# ===================================================================== metrics on scored events

@register("metrics_ranking_summary", with_ctes(S.SCORED_SQL, _ranking_cte("scored", "score", "label")) +
          f"SELECT {RS_COLS} FROM rs")
def q_metrics_ranking_summary(spark, d):
    return _rounded_summary(metrics.ranking_summary(S.scored_events(spark, d), "score", "label"))


@register("metrics_best_f1", with_ctes(S.SCORED_SQL, _ranking_cte("scored", "score", "label")) +
          "SELECT best_f1, best_threshold FROM rs")
def q_metrics_best_f1(spark, d):
    return _rounded_summary(metrics.best_f1(S.scored_events(spark, d), "score", "label"))


@register("metrics_roc_curve", with_ctes(S.SCORED_SQL) + """,
g AS (SELECT score, sum(label) AS pos, count(*) - sum(label) AS neg FROM scored GROUP BY score),
c AS (SELECT score, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp,
             sum(pos) OVER () AS P, sum(neg) OVER () AS N FROM g)
SELECT CAST('inf' AS DOUBLE) AS threshold, 0.0 AS fpr, 0.0 AS tpr
UNION ALL
SELECT score AS threshold, round(CAST(fp AS DOUBLE) / N, 9) AS fpr, round(CAST(tp AS DOUBLE) / P, 9) AS tpr FROM c""")
def q_metrics_roc_curve(spark, d):
    c = metrics.roc_curve(S.scored_events(spark, d), "score", "label")
    return c.select("threshold", r9("fpr").alias("fpr"), r9("tpr").alias("tpr"))


CONFUSION_SQL = """cm AS (SELECT count(*) FILTER (WHERE label = 1 AND yhat = 1) AS tp, count(*) FILTER (WHERE label = 0 AND yhat = 1) AS fp,
                    count(*) FILTER (WHERE label = 0 AND yhat = 0) AS tn, count(*) FILTER (WHERE label = 1 AND yhat = 0) AS fn
             FROM (SELECT label, CAST(score >= 0.5 AS INTEGER) AS yhat FROM scored) x)"""


def _yhat(spark, d):
    return S.scored_events(spark, d).withColumn("yhat", metrics.binarize("score", 0.5))


@register("metrics_confusion", with_ctes(S.SCORED_SQL, CONFUSION_SQL) + "SELECT tp, fp, tn, fn FROM cm")
def q_metrics_confusion(spark, d):
    return metrics.confusion(_yhat(spark, d), "label", "yhat")


def _report_sql(cm: str) -> str:
    def div(a, b):
        return f"CASE WHEN ({b}) = 0 THEN 0.0 ELSE CAST({a} AS DOUBLE) / ({b}) END"
    f1_1, f1_0 = div("2 * tp", "2 * tp + fp + fn"), div("2 * tn", "2 * tn + fn + fp")
    return f"""SELECT round({div('tp + tn', 'tp + fp + tn + fn')}, 9) AS accuracy,
       round({div('tp', 'tp + fp')}, 9) AS positive_class_precision,
       round({div('tp', 'tp + fn')}, 9) AS positive_class_recall,
       round({f1_1}, 9) AS positive_class_f1, tp + fn AS positive_support,
       round({div('tn', 'tn + fn')}, 9) AS negative_class_precision,
       round({div('tn', 'tn + fp')}, 9) AS negative_class_recall,
       round({f1_0}, 9) AS negative_class_f1, tn + fp AS negative_support,
       round(({f1_0} + {f1_1}) / 2, 9) AS macro_f1,
       round({div(f'({f1_1}) * (tp + fn) + ({f1_0}) * (tn + fp)', 'tp + fp + tn + fn')}, 9) AS weighted_f1
FROM {cm}"""


@register("metrics_class_report", with_ctes(S.SCORED_SQL, CONFUSION_SQL) + _report_sql("cm"))
def q_metrics_class_report(spark, d):
    return _rounded_summary(metrics.class_report(_yhat(spark, d), "label", "yhat"))


@register("metrics_accuracy", with_ctes(S.SCORED_SQL) +
          "SELECT round(avg(CAST(label = CAST(score >= 0.5 AS INTEGER) AS DOUBLE)), 9) AS accuracy FROM scored")
def q_metrics_accuracy(spark, d):
    return _rounded_summary(metrics.accuracy(_yhat(spark, d), "label", "yhat"))


MCC_SQL = """round(CASE WHEN sqrt(CAST(tp + fp AS DOUBLE) * (tp + fn) * (tn + fp) * (tn + fn)) = 0 THEN 0.0
     ELSE (CAST(tp AS DOUBLE) * tn - CAST(fp AS DOUBLE) * fn)
          / sqrt(CAST(tp + fp AS DOUBLE) * (tp + fn) * (tn + fp) * (tn + fn)) END, 9)"""


@register("metrics_mcc", with_ctes(S.SCORED_SQL, CONFUSION_SQL) + f"SELECT {MCC_SQL} AS mcc FROM cm")
def q_metrics_mcc(spark, d):
    return _rounded_summary(metrics.mcc(_yhat(spark, d), "label", "yhat"))


@register("metrics_null_audit", """
SELECT count(*) FILTER (WHERE value IS NULL OR isnan(value)) AS value_missing, count(*) FILTER (WHERE props IS NULL) AS props_missing,
       count(*) FILTER (WHERE user_id IS NULL) AS user_id_missing FROM events""")
def q_metrics_null_audit(spark, d):
    return metrics.null_audit(S.table(spark, d, "events"), ["value", "props", "user_id"])


EMB_SQL = """emb AS (
  SELECT vec_id, CAST(label >= 5 AS INTEGER) AS y,
         list_transform(embedding, lambda v: exp(CAST(v AS DOUBLE) - CAST(list_max(embedding) AS DOUBLE))) AS e FROM embeddings),
prob AS (SELECT vec_id, y, list_sum(e[33:64]) / list_sum(e) AS p1 FROM emb)"""


def _emb_prob(spark, d):
    """The softmax of all 64 values, its upper half as the positive class."""
    e = S.table(spark, d, "embeddings").withColumn("p", softmax("embedding"))
    upper = F.aggregate(F.slice("p", 33, 32), F.lit(0.0), lambda a, x: a + x)
    return e.select("vec_id", (F.col("label") >= 5).cast("int").alias("y"), upper.alias("p1"))


@register("metrics_softmax", with_ctes(EMB_SQL) + "SELECT vec_id, y, round(p1, 9) AS p1 FROM prob")
def q_metrics_softmax(spark, d):
    return _emb_prob(spark, d).select("vec_id", "y", r9("p1").alias("p1"))


@register("metrics_weighted_log_loss", with_ctes(EMB_SQL) + """
SELECT round(avg(-(0.3 * (1 - y) * ln(1 - least(1 - 1e-7, greatest(1e-7, p1)))
                   + 1.0 * y * ln(least(1 - 1e-7, greatest(1e-7, p1))))), 9) AS loss FROM prob""")
def q_metrics_weighted_log_loss(spark, d):
    return _rounded_summary(metrics.weighted_log_loss(_emb_prob(spark, d), "y", "p1", w0=0.3, w1=1.0))


@register("metrics_report", with_ctes(EMB_SQL, _ranking_cte("prob", "p1", "y"), """cm AS (
  SELECT count(*) FILTER (WHERE y = 1 AND p1 >= t) AS tp, count(*) FILTER (WHERE y = 0 AND p1 >= t) AS fp,
         count(*) FILTER (WHERE y = 0 AND p1 < t) AS tn, count(*) FILTER (WHERE y = 1 AND p1 < t) AS fn,
         max(roc_auc) AS roc_auc, max(best_f1) AS best_f1, max(t) AS best_threshold
  FROM prob, (SELECT thr_raw AS t, roc_auc, best_f1 FROM rs) r)""") +
    _report_sql("cm").replace("FROM cm", f""", round(roc_auc, 9) AS roc_auc, {MCC_SQL} AS matthews_corrcoef,
       round(best_f1, 9) AS best_f1_from_thresholding, round(best_threshold, 9) AS best_threshold FROM cm"""))
def q_metrics_report(spark, d):
    return _rounded_summary(metrics.report(_emb_prob(spark, d), "y", "p1", 0.5))


# ===================================================================== ranking and sampling

@register("rank_global", """
SELECT event_id, row_number() OVER (ORDER BY md5('3|' || CAST(event_id AS VARCHAR)), event_id) AS rank FROM events""")
def q_rank_global(spark, d):
    ev = S.table(spark, d, "events").select("event_id")
    return ranking.prefix_rank(ev.withColumn("_k", ranking.order_key(3, "event_id")), "_k",
                               ties=["event_id"]).drop("_k")


@register("rank_batch_no", """
SELECT event_id, CAST(floor((row_number() OVER (ORDER BY md5('3|' || CAST(event_id AS VARCHAR)), event_id) - 1) / 64)
       AS BIGINT) AS batch FROM events""")
def q_rank_batch_no(spark, d):
    r = q_rank_global(spark, d)
    return r.select("event_id", ranking.batch_no("rank", 64).alias("batch"))


@register("sample_split", with_ctes(*BASE_CTES) + """
SELECT gene, tf, tf_dna, interaction,
       CASE WHEN row_number() OVER (ORDER BY md5('0|' || gene || '|' || tf || '|' || tf_dna), gene, tf, tf_dna)
                 <= floor(count(*) OVER () * 0.8) THEN 'train' ELSE 'dev' END AS split
FROM pairs""")
def q_sample_split(spark, d):
    p = _pairs(spark, d).select("gene", "tf", "tf_dna", "interaction")
    return sampling.split(p, 0.8, seed=0, ids=["gene", "tf", "tf_dna"])


@register("sample_split_by_gene", with_ctes(*BASE_CTES) + """,
gs AS (SELECT gene, CASE WHEN row_number() OVER (ORDER BY md5('0|' || gene), gene)
                            <= floor(count(*) OVER () * 0.8) THEN 'train' ELSE 'dev' END AS split
       FROM (SELECT DISTINCT gene FROM pairs) x)
SELECT p.gene, p.tf, p.tf_dna, p.interaction, gs.split FROM pairs p JOIN gs ON p.gene = gs.gene""")
def q_sample_split_by_gene(spark, d):
    p = _pairs(spark, d).select("gene", "tf", "tf_dna", "interaction")
    return sampling.split(p, 0.8, seed=0, by=["gene"]).select("gene", "tf", "tf_dna", "interaction", "split")


@register("sample_downsample_negatives", with_ctes(*BASE_CTES) + """
SELECT gene, tf, tf_dna, interaction FROM pairs WHERE interaction > 0
UNION ALL
SELECT gene, tf, tf_dna, interaction FROM (
  SELECT *, row_number() OVER (ORDER BY md5('5|' || gene || '|' || tf || '|' || tf_dna), gene, tf, tf_dna) AS r,
         count(*) OVER () AS n FROM pairs WHERE interaction = 0) x
WHERE r <= floor(n * 0.3)""")
def q_sample_downsample_negatives(spark, d):
    p = _pairs(spark, d).select("gene", "tf", "tf_dna", "interaction")
    return sampling.downsample_negatives(p, 0.3, "interaction", seed=5, ids=["gene", "tf", "tf_dna"])


@register("sample_class_counts", with_ctes(*BASE_CTES) +
          "SELECT interaction AS label, count(*) AS n FROM pairs GROUP BY interaction")
def q_sample_class_counts(spark, d):
    return sampling.class_counts(_pairs(spark, d), "interaction")


DOCS_KEEP_SQL = """SELECT md5(text) AS text_md5, {fn}(doc_id, (doc_id, lang, source)) AS doc_id,
       {fn}(lang, (doc_id, lang, source)) AS lang, {fn}(source, (doc_id, lang, source)) AS source
FROM documents GROUP BY text"""


@register("sample_keep_first", DOCS_KEEP_SQL.format(fn="arg_min"))
def q_sample_keep_first(spark, d):
    docs = S.table(spark, d, "documents").select("text", "doc_id", "lang", "source")
    k = sampling.keep_first(docs, ["text"], ["doc_id"])
    return k.select(F.md5("text").alias("text_md5"), "doc_id", "lang", "source")


@register("sample_keep_last", DOCS_KEEP_SQL.format(fn="arg_max"))
def q_sample_keep_last(spark, d):
    docs = S.table(spark, d, "documents").select("text", "doc_id", "lang", "source")
    k = sampling.keep_last(docs, ["text"], ["doc_id"])
    return k.select(F.md5("text").alias("text_md5"), "doc_id", "lang", "source")


@register("sample_cap", "SELECT event_id, user_id, value FROM events ORDER BY value DESC, event_id LIMIT 1000")
def q_sample_cap(spark, d):
    ev = S.table(spark, d, "events").select("event_id", "user_id", "value")
    return sampling.cap(ev, 1000, [F.col("value").desc(), F.col("event_id")])


EVEN_SQL = """
WITH base AS (SELECT CAST(doc_id AS VARCHAR) AS id, CAST(quality > 0 AS INTEGER) AS y,
                     md5('11|' || CAST(doc_id AS VARCHAR)) AS k FROM labels),
cnt AS (SELECT count(*) FILTER (WHERE y = 1) AS p, count(*) FILTER (WHERE y = 0) AS n FROM base),
side AS (SELECT CASE WHEN n < p THEN 0 ELSE 1 END AS small_y,
                CASE WHEN n < p THEN n ELSE p END AS m, CASE WHEN n < p THEN p ELSE n END AS big FROM cnt),
ranked AS (SELECT id, y, row_number() OVER (PARTITION BY y ORDER BY k, id) - 1 AS r FROM base),
small AS (SELECT r AS j, id AS sid FROM ranked, side WHERE y = small_y),
large AS (SELECT r AS i, id AS lid, r % m AS j FROM ranked, side
          WHERE y <> small_y AND r < {limit}),
pairs AS (SELECT i, sid, lid FROM large JOIN small USING (j))
SELECT CAST(floor(i / {half}) AS BIGINT) AS batch, CAST((i % {half}) * 2 AS INTEGER) AS slot, sid AS id,
       (SELECT small_y FROM side) AS label FROM pairs
UNION ALL
SELECT CAST(floor(i / {half}) AS BIGINT) AS batch, CAST((i % {half}) * 2 + 1 AS INTEGER) AS slot, lid AS id,
       1 - (SELECT small_y FROM side) AS label FROM pairs"""


@register("sample_even_class_batches", EVEN_SQL.format(half=8, limit="(big // 8) * 8"))
def q_sample_even_class_batches(spark, d):
    lab = S.table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    return sampling.even_class_batches(lab, 16, drop_last=True, label="label", id_col="id", seed=11)


@register("sample_even_class_batches_keep_last", EVEN_SQL.format(half=8, limit="big"))
def q_sample_even_class_batches_keep_last(spark, d):
    lab = S.table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    return sampling.even_class_batches(lab, 16, drop_last=False, label="label", id_col="id", seed=11)
