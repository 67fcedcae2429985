"""Stand-in inputs built from the driver's tables (there is no genome data).

Each stand-in has a Spark builder and the same table written as a DuckDB
CTE, so every registered query has an SQL oracle over identical inputs.
DNA is ``translate(md5(text), hex digits, 'ACGT' x 4)``: 32 bp per digest,
identical in both engines.

| stand-in | source |
| --- | --- |
| genes ``gene, sequence`` (15 to 64 bp, by ``p_size``) | ``part`` |
| TF sequences ``tf, sequence`` (1-3 per TF, 8 or 12 bp, repeats) | ``supplier`` |
| prior ``gene, tf, value`` = 10 x mean discount per (part, supplier) | ``lineitem`` |
| edges ``tf, gene`` with repeats | ``lineitem`` |
| scored rows ``score, label`` | ``events`` |
| contigs ``contig, seq`` = document text | ``documents`` |
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqedge.functions.dna import HEX_DIGITS, HEX_TO_BASE, dna_from_key
from seqedge.session import dealt, tasks_for

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cell_tasks(spark: SparkSession, sf_dir: str) -> int:
    """The tasks for a row a line item (the prior's cells, a TF's targets)."""
    return tasks_for(table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_discount"))


def _dna_sql(text_sql: str) -> str:
    return f"translate(md5({text_sql}), '{HEX_DIGITS}', '{HEX_TO_BASE}')"


def _tagged(tag: str, col) -> F.Column:
    return F.concat(F.lit(tag), F.col(col).cast("string") if isinstance(col, str) else col.cast("string"))


# ---------------------------------------------------------------- genes


def genes(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "part")
    dna = F.concat(dna_from_key(_tagged("g", "p_partkey")), dna_from_key(_tagged("h", "p_partkey")))
    return p.select(_tagged("G", "p_partkey").alias("gene"),
                    F.call_function("substring", dna, F.lit(1), F.lit(14) + F.col("p_size")).alias("sequence"))


GENES_SQL = f"""genes AS (
  SELECT 'G' || CAST(p_partkey AS VARCHAR) AS gene,
         substring({_dna_sql("'g' || CAST(p_partkey AS VARCHAR)")} || {_dna_sql("'h' || CAST(p_partkey AS VARCHAR)")},
                   1, CAST(14 + p_size AS BIGINT)) AS sequence
  FROM part)"""


# ---------------------------------------------------------------- TF sequences


def tf_seqs(spark, sf_dir) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    k = F.explode(F.sequence(F.lit(0), F.pmod(F.col("s_suppkey"), F.lit(3)).cast("int"))).alias("k")
    e = s.select("s_suppkey", k)
    v = F.pmod(F.col("k"), F.lit(2))
    text = F.concat(F.lit("t"), F.col("s_suppkey").cast("string"), F.lit("-"), v.cast("string"))
    return e.select(_tagged("T", "s_suppkey").alias("tf"),
                    F.call_function("substring", dna_from_key(text), F.lit(1), F.lit(8) + F.lit(4) * v)
                    .alias("sequence"))


TF_SEQS_SQL = f"""tf_seqs AS (
  SELECT 'T' || CAST(s_suppkey AS VARCHAR) AS tf,
         substring({_dna_sql("'t' || CAST(s_suppkey AS VARCHAR) || '-' || CAST(k % 2 AS VARCHAR)")},
                   1, CAST(8 + 4 * (k % 2) AS BIGINT)) AS sequence
  FROM (SELECT s_suppkey, unnest(range(0, s_suppkey % 3 + 1)) AS k FROM supplier) x)"""


# ---------------------------------------------------------------- prior matrix (long)


def prior(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_discount")
    return (dealt(li, cell_tasks(spark, sf_dir), "l_partkey", "l_suppkey").groupBy("l_partkey", "l_suppkey")
            .agg(F.round(F.avg("l_discount") * 10, 6).alias("value"))
            .select(_tagged("G", "l_partkey").alias("gene"), _tagged("T", "l_suppkey").alias("tf"), "value"))


PRIOR_SQL = """prior AS (
  SELECT 'G' || CAST(l_partkey AS VARCHAR) AS gene, 'T' || CAST(l_suppkey AS VARCHAR) AS tf,
         round(avg(l_discount) * 10, 6) AS value
  FROM lineitem GROUP BY l_partkey, l_suppkey)"""


# ---------------------------------------------------------------- gold matrix (long)


def gold(spark, sf_dir) -> DataFrame:
    """Gold edges: a (part, supplier) pair is true when any of its line
    items was returned; long form ``gene, tf, value`` in {0, 1}."""
    li = table(spark, sf_dir, "lineitem")
    return (li.groupBy("l_partkey", "l_suppkey")
            .agg(F.max((F.col("l_returnflag") == "R").cast("int")).cast("double").alias("value"))
            .select(_tagged("G", "l_partkey").alias("gene"), _tagged("T", "l_suppkey").alias("tf"), "value"))


GOLD_SQL = """gold AS (
  SELECT 'G' || CAST(l_partkey AS VARCHAR) AS gene, 'T' || CAST(l_suppkey AS VARCHAR) AS tf,
         CAST(max(CAST(l_returnflag = 'R' AS INTEGER)) AS DOUBLE) AS value
  FROM lineitem GROUP BY l_partkey, l_suppkey)"""


# ---------------------------------------------------------------- edge list with repeats


def edges(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(_tagged("T", "l_suppkey").alias("tf"), _tagged("G", "l_partkey").alias("gene"))


EDGES_SQL = """edges AS (
  SELECT 'T' || CAST(l_suppkey AS VARCHAR) AS tf, 'G' || CAST(l_partkey AS VARCHAR) AS gene FROM lineitem)"""


# ---------------------------------------------------------------- scored rows


def scored_events(spark, sf_dir) -> DataFrame:
    """``score = value / 500`` and ``label = event_type = 'purchase'``."""
    ev = table(spark, sf_dir, "events")
    return ev.select("event_id", (F.col("value") / 500.0).alias("score"),
                     (F.col("event_type") == "purchase").cast("int").alias("label"))


SCORED_SQL = """scored AS (
  SELECT event_id, value / 500.0 AS score, CAST(event_type = 'purchase' AS INTEGER) AS label FROM events)"""


# ---------------------------------------------------------------- contigs and features


def contigs(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(_tagged("D", "doc_id").alias("contig"), F.col("text").alias("seq"))


CONTIGS_SQL = """contigs AS (SELECT 'D' || CAST(doc_id AS VARCHAR) AS contig, text AS seq FROM documents)"""


def features(spark, sf_dir) -> DataFrame:
    """Three intervals per document plus one on a contig that does not exist.

    ``start`` is in [1, n_chars]; ``stop`` may run past the end (clamped, as a
    slice is); strand alternates with ``doc_id + j``.
    """
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    j = d.select("doc_id", "n_chars", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("j"))
    start = F.lit(1) + F.pmod(F.col("doc_id") * 37 + F.col("j") * 1013, F.col("n_chars"))
    stop = start + F.pmod(F.col("doc_id") * 11 + F.col("j") * 517, F.lit(2500))
    contig = F.when(F.col("j") == 3, _tagged("X", "doc_id")).otherwise(_tagged("D", "doc_id"))
    return j.select(
        F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit("_"), F.col("j").cast("string")).alias("gene_id"),
        contig.alias("contig"), start.cast("bigint").alias("start"), stop.cast("bigint").alias("stop"),
        F.when(F.pmod(F.col("doc_id") + F.col("j"), F.lit(2)) == 0, "+").otherwise("-").alias("strand"),
        F.lit("gene").alias("category"))


FEATURES_SQL = """features AS (
  SELECT 'f' || CAST(doc_id AS VARCHAR) || '_' || CAST(j AS VARCHAR) AS gene_id,
         CASE WHEN j = 3 THEN 'X' ELSE 'D' END || CAST(doc_id AS VARCHAR) AS contig,
         CAST(1 + (doc_id * 37 + j * 1013) % n_chars AS BIGINT) AS start,
         CAST(1 + (doc_id * 37 + j * 1013) % n_chars + (doc_id * 11 + j * 517) % 2500 AS BIGINT) AS stop,
         CASE WHEN (doc_id + j) % 2 = 0 THEN '+' ELSE '-' END AS strand,
         'gene' AS category
  FROM (SELECT doc_id, n_chars, unnest(range(0, 4)) AS j FROM documents) x)"""


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
