"""Session helpers: a tuned local session for tests and benches, and the
shared checkpoint folder used to cut lineage between rounds."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of rows, as ``tasks_for`` weighs them, that one task takes after a shuffle.
TASK_BYTES = 32 << 20
_ROW_BYTES = 40  # of a row beside its values

# Settings that matter at scale: AQE re-plans shuffles at run time (coalesces
# small partitions, splits skewed join partitions), and Arrow moves batches to
# Python workers only where a user model runs.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "seqedge", extra: dict | None = None) -> SparkSession:
    """Return the active session, or build a local one with ``DEFAULT_CONF``."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.master(master or f"local[{cpus}]").appName(app_name)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions or cpus)
    conf["spark.driver.memory"] = os.environ.get("SEQEDGE_DRIVER_MEMORY", "8g")
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster this is set by the operator and points at shared storage; we
    only read it, and raise where it is unset. With a local master a fresh
    scratch folder is created and registered then (tests).
    """
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: no SparkContext; the session conf names the folder
        sc = None
    if sc is None:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        return path
    path = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="seqedge-ckpt-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return sc.getCheckpointDir() or path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory (never a
    machine-local temp folder on a cluster)."""
    return f"{checkpoint_dir(spark).rstrip('/')}/seqedge-{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under the shared checkpoint folder and read it back.

    What follows is planned with the measured size of the files, a lost
    executor costs no recomputation of what came before, and no cached block
    outlives the query.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _text_bytes(col: Column, kind: T.DataType) -> Column | None:
    """What a value takes beside its 8 bytes (None: nothing)."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.octet_length(col)
    if isinstance(kind, T.ArrayType):
        return 8 * F.size(col)
    if isinstance(kind, T.StructType):
        parts = [p for f in kind if (p := _text_bytes(col[f.name], f.dataType)) is not None]
        return sum((F.coalesce(p, F.lit(0)) for p in parts), F.lit(0)) if parts else None
    return None


def tasks_for(stored: DataFrame) -> int:
    """Into how many tasks the rows of a table in files are dealt: the shuffle partitions, and more where a task would
    get more than TASK_BYTES. One pass over the texts weighs them; rows without texts are only counted."""
    extra = [w for f in stored.schema if (w := _text_bytes(F.col(f"`{f.name}`"), f.dataType)) is not None]
    texts = sum((F.coalesce(F.sum(w.cast("bigint")), F.lit(0)) for w in extra), F.lit(0))
    rows, size = stored.agg(F.count(F.lit(1)), texts.cast("bigint")).first()
    size += rows * (_ROW_BYTES + 8 * len(stored.columns))
    return max(int(stored.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))


def sized(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """``cut``, and the tasks for the rows that were written."""
    stored = cut(df, name)
    return stored, tasks_for(stored)


def dealt(df: DataFrame, tasks: int | None, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` to ``tasks`` if these are more than the shuffle partitions; otherwise ``df`` as it is,
    and the next step deals it. The smaller side of a join, dealt by the join's keys, has the larger one dealt alike."""
    if tasks is None or tasks <= int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        return df
    return df.repartition(tasks, *keys)
