"""Plan checks: no cross products anywhere, and scans read only the columns
a query needs (column pruning reaches the Parquet reader)."""

import contextlib
import io
import re

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
QUERIES = {k: v for k, v in E.queries().items() if not re.match(r"op\d+_|pipeline$", k)}  # the optional subpackage has its own tests


def _plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    return buf.getvalue()


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n not in ("score_edge_classifier", "runs_iterate")))
def test_no_cartesian_products(spark, name):
    plan = _plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name,table,cols", [
    ("pairs_build", "lineitem", {"l_partkey", "l_suppkey", "l_discount"}),
    ("network_restrict", "lineitem", {"l_partkey", "l_suppkey"}),
    ("metrics_confusion", "events", {"event_type", "value"}),
    ("genome_length_split", "documents", {"text"}),
])
def test_scans_are_pruned(spark, name, table, cols):
    plan = _plan(QUERIES[name](spark, SF))
    schemas = re.findall(rf"{table}\.parquet\].*?ReadSchema: struct<([^>]*)>", plan.replace("\n", " "))
    assert schemas, plan
    for sch in schemas:
        read = {f.split(":")[0] for f in sch.split(",")}
        assert read <= cols
