"""What the operators of this subpackage share: the input tables, column helpers, and cut points in the lineage."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqedge.functions.arrays import let, running  # noqa: F401  (their earlier place)
from seqedge.sources.writers import scratch_path

#: Words of the quality, join and mixing operators: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An input table, whole."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a fresh folder under ``spark.checkpoint.dir`` and read it back.

    The lineage ends here, a lost executor costs no recomputation of what came before, and Spark plans later joins
    with the measured size of the files.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def store(uri: str):
    """(file system, path) of a place on the shared store, for tasks that read or write parts of plain files: a folder that is
    mounted everywhere, or whatever else ``pyarrow.fs`` opens (HDFS, S3, GCS); any other store raises."""
    from pyarrow import fs

    scheme, colon, rest = uri.partition(":")
    if not colon or "/" in scheme or scheme == "file":
        return fs.LocalFileSystem(), "/" + (rest if scheme == "file" else uri).lstrip("/")
    return fs.FileSystem.from_uri(("s3" if scheme in ("s3a", "s3n") else scheme) + colon + rest)


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of tables that are no longer in use. Spark removes them when the driver's JVM collects
    its garbage, which a series of small jobs between cuts may not bring about for long."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that clash with no column of ``df`` (in any letter case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def pieces(batch, column: int, size: int = 2 << 20):
    """Slices of an Arrow batch, each of about ``size`` bytes of the string column (one row at least), so that what a
    task makes of long texts goes out a few texts at a time."""
    import pyarrow.compute as pc

    lengths, b, held = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist(), 0, 0
    for e, n in enumerate(lengths):
        if held and held + n > size:
            yield batch.slice(b, e - b)
            b, held = e, 0
        held += n + 64
    if b < len(lengths):
        yield batch.slice(b)
