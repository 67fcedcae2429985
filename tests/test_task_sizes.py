"""Where rows are many, steps deal them to more tasks than there are shuffle partitions, so that a task's share is bounded."""

import contextlib
import io
import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from seqedge import session
from seqedge.operators import lists, motifs, ranking
from seqedge.plans import catalog, queries_more

SF = "/root/testdata/sf0.001"


@pytest.fixture
def small_tasks(spark, monkeypatch):
    """Tasks of 16 kB, and no join by broadcast."""
    monkeypatch.setattr(session, "TASK_BYTES", 16_000)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def dealt_to(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return [(keys, int(n)) for keys, n in re.findall(r"hashpartitioning\((.*?), (\d+)\)", re.sub(r"#\d+L?", "", out.getvalue()))]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_tasks_grow_with_rows_and_texts(spark, monkeypatch):
    rows = session.cut(spark.range(1_000), "t")
    assert session.tasks_for(rows) == 8
    monkeypatch.setattr(session, "TASK_BYTES", 1_000)
    assert session.tasks_for(rows) == 48
    texts = spark.range(10).select(F.repeat(F.lit("é"), 5_000).alias("s.t"), F.array(F.lit(1)).alias("a"), F.struct(F.lit(None).cast("string").alias("n")).alias("b"))
    assert session.tasks_for(session.cut(texts, "t")) == 101
    assert session.tasks_for(rows.limit(0)) == 8


def test_ranks_of_many_rows_with_copies_and_null_groups(spark, small_tasks, monkeypatch):
    seen, real = [], ranking.cut
    monkeypatch.setattr(ranking, "cut", lambda df, name: seen.append(real(df, name)) or seen[-1])
    df = spark.range(6_000).select(F.when(F.col("id") % 5 > 0, F.col("id") % 5).alias("g"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"),
                                   F.when(F.col("id") % 7 > 0, 1.5).alias("v"))
    want = df.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy("k", "v")).cast("long"))
    got = ranking.range_rank(df, "k", by=["g"], ties=["v"])
    assert rows_of(got) == rows_of(want)
    sizes = [r["n"] for r in seen[0].groupBy(ranking._B).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) > 8 and max(sizes) <= 3 * 6_000 / len(sizes)
    assert min(n for _, n in dealt_to(got.select("rank")) if "_se_group" in _) > 8


@pytest.mark.parametrize("distinct", [True, False])
def test_lists_of_many_values(spark, small_tasks, distinct):
    df = spark.range(4_000).select(F.when(F.col("id") % 4 > 0, F.col("id") % 4).alias("k"), (F.col("id") % 901).cast("string").alias("v"))
    got = lists.parts(df, ["k"], "v", distinct=distinct, size=100)
    d = df.distinct() if distinct else df
    part = F.floor((F.row_number().over(Window.partitionBy("k").orderBy("v")) - 1) / 100)
    want = d.withColumn("part", part).groupBy("k", "part").agg(F.array_sort(F.collect_list("v")).alias("items"))
    assert rows_of(got) == rows_of(want)
    assert min(n for keys, n in dealt_to(got) if keys == "k, part") > 8


def test_text_parts_of_many_promoters(spark, small_tasks):
    got = queries_more.q_motifs_text_parts(spark, SF)
    assert min(n for keys, n in dealt_to(got) if keys == "TF, part") > 8
    targets = queries_more._proxy(spark, SF)
    assert dict(dealt_to(targets))["l_suppkey"] > 8 and min(n for keys, n in dealt_to(targets) if keys == "Gene_ID") > 8
    whole = got.groupBy("TF").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "Promoter_Sequence"))), lambda x: x["Promoter_Sequence"]), ", ").alias("s"))
    assert rows_of(whole) == rows_of(targets.groupBy("TF").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("Gene_ID", "Promoter_Sequence"))), lambda x: x["Promoter_Sequence"]), ", ").alias("s")))


def test_whole_texts_of_many_promoters(spark, small_tasks):
    got = queries_more.q_motifs_concat_sequences(spark, SF)
    assert min(n for keys, n in dealt_to(got) if keys == "TF") > 8
    assert dict(rows_of(got)) == {tf: s for tf, s in rows_of(queries_more._proxy(spark, SF).groupBy("TF").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("Gene_ID", "Promoter_Sequence"))), lambda x: x["Promoter_Sequence"]), ", ")))}
    assert min(n for keys, n in dealt_to(motifs.group_sequences(spark.range(3_000).select((F.col("id") % 9).alias("tf"), F.col("id").cast("string").alias("sequence")))) if keys == "tf") > 8


@pytest.mark.parametrize("name", ["pairs_build", "score_mean_by_pair", "eval_against_prior"])
def test_pairs_of_many_cells(spark, monkeypatch, name):
    want = rows_of(catalog.QUERIES[name](spark, SF))
    monkeypatch.setattr(session, "TASK_BYTES", 16_000)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = catalog.QUERIES[name](spark, SF)
        by = [(keys, n) for keys, n in dealt_to(got) if keys in ("l_partkey, l_suppkey", "tf", "gene", "gene, tf")]
        assert {"l_partkey, l_suppkey", "tf", "gene"} <= {keys for keys, _ in by}
        # only the gene table itself goes to the shuffle partitions
        assert rows_of(got) == want and [keys for keys, n in by if n <= 8] in ([], ["gene"])
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
