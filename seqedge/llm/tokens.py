"""Token counts (operator 10): a separator scan over flat, unindexed token files.

Each block of a file is searched for the end-of-document id at once (numpy); a prefix scan over the blocks' summaries
then says where a document that runs over block boundaries began. The scan has two levels (blocks in a run of blocks,
runs in a file), so a file with a third of all blocks is many small windows.
"""

from __future__ import annotations

import base64
import os

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqedge.llm.common import cut, quoted, store, table
from seqedge.sources.writers import scratch_path

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that splits text before the merges of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
EOD = 50256
BLOCK = 1 << 17
#: Blocks in a run of the prefix scan.
RUN = 1024
BLOCKS = "file string, block long, data binary"

_ENCODERS: dict[str, object] = {}


def encoder(path: str):
    if path not in _ENCODERS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[path] = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def write_flat(docs: DataFrame, folder: str, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, eod: int = EOD, batch_rows: int = 4096) -> DataFrame:
    """Documents as flat, unindexed files of 16-bit tokens under ``folder``, one file a task, each document closed by ``eod``;
    returns their catalogue (file, doc_no, id), written: it says whose documents a file holds, not where they lie.

    A file is named after its task's attempt and the catalogue is committed with the task, so files that a lost or
    repeated attempt left behind are in no catalogue. A null or empty text has no tokens, repeated rows and null keys are documents
    of their own, other columns are not read, an empty table makes no file. ``vocabulary`` must lie at the same path
    on all executors; ``folder`` on a store that they share (``common.store``).
    """

    def run(batches):
        encode, task, n, ids = encoder(vocabulary).encode_ordinary, TaskContext.get(), 0, []
        name, out = f"part-{task.partitionId():06d}-{task.taskAttemptId()}.bin", None

        def listed():
            rows = pa.RecordBatch.from_arrays([pa.array([name] * len(ids), pa.string()), pa.array(range(n - len(ids), n), pa.int64()), pa.array(ids, pa.int64())],
                                              names=["file", "doc_no", "id"])
            ids.clear()
            return rows

        try:
            for batch in batches:
                for k, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                    if out is None:
                        files, at = store(folder)
                        files.create_dir(at, recursive=True)
                        out = files.open_output_stream(f"{at}/{name}", buffer_size=1 << 20)
                    t = t.as_py()
                    out.write(np.array([*(encode(t) if t else ()), eod], np.uint16))
                    ids.append(k)
                    n += 1
                    if len(ids) >= batch_rows:
                        yield listed()
        finally:
            if out is not None:
                out.close()
        if ids:
            yield listed()

    return cut(docs.select(quoted(key).cast("long"), quoted(text)).mapInArrow(run, "file string, doc_no long, id long"), "token-catalogue")


def token_files(files: DataFrame, width: int = 2, block: int = BLOCK, stretch: int = 32 << 20) -> DataFrame:
    """The blocks (file, block, data) of flat token files ``files`` (path, length), of any length: a task opens a file and reads its stretches of
    whole blocks, about ``stretch`` bytes each, by their byte range. Files without a byte have no block; a listed file that is
    gone is an error. Repeated rows read a file twice, under the same name; other columns are not read."""
    step = block * width
    many = max(1, stretch // step)
    total = files.agg(F.sum(F.ceil(F.col("length") / (many * step)))).first()[0] or 0
    last = F.ceil(F.col("length") / step) - 1
    parts = files.filter("length > 0").select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), last, F.lit(many).cast("long"))).alias("first"))

    def run(batches):
        for batch in batches:
            for path, length, first in zip(*(c.to_pylist() for c in batch.columns)):
                where, at = store(path)
                end, some = min(first + many, -(-length // step)), max(1, (1 << 20) // step)  # blocks a batch
                with where.open_input_file(at) as f:
                    for i in range(first, end, some):
                        here = range(i, min(i + some, end))
                        data = f.read_at(min(len(here) * step, length - i * step), i * step)
                        yield pa.RecordBatch.from_arrays([pa.array([path] * len(here)), pa.array(here, pa.int64()),
                                                          pa.array([data[j * step : (j + 1) * step] for j in range(len(here))], pa.binary())], names=["file", "block", "data"])

    # A stretch is one small row: dealt evenly, and by a number, so that they are not put back into one task for their size.
    return parts.repartition(max(1, int(total))).mapInArrow(run, BLOCKS)


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of the files under ``path``, as Spark's reader lists them; no content is read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")


def scan(blocks: DataFrame, width: int = 2, eod: int = EOD) -> DataFrame:
    """(file, doc_no, start, n_tokens, closed) of every document in the files: the separator is not counted; tokens
    after a file's last separator are a document that is not closed. Empty documents count; an empty table gives no rows.
    A block stands once (file and block are its key), no column is null, and a file that is no whole number of tokens is an error; extra columns are not read."""
    dtype = {2: np.uint16, 4: np.uint32, 8: np.uint64}[width]

    def run(batches):
        for batch in batches:
            arrays = [np.frombuffer(d.as_buffer(), dtype) for d in batch.column(2)]
            ends = [np.flatnonzero(a == eod) for a in arrays]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(a) for a in arrays], pa.int64()),
                                              pa.array(ends, pa.list_(pa.int64()))], names=["file", "block", "n", "ends"])

    # The scan below reads these summaries three times; cut, so that the tokens are read once.
    seen = cut(blocks.select("file", "block", "data").mapInArrow(run, "file string, block long, n long, ends array<long>"), "token-blocks").withColumn("run", F.floor(F.col("block") / RUN))
    # Within a run: tokens and separators before each block, and where the last separator was.
    inside = Window.partitionBy("file", "run").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    placed = seen.withColumns({"before": F.coalesce(F.sum("n").over(inside), F.lit(0)), "seps": F.coalesce(F.sum(F.size("ends")).over(inside), F.lit(0))})
    placed = placed.withColumn("ended", F.when(F.size("ends") > 0, F.col("before") + F.try_element_at("ends", F.lit(-1))))
    placed = placed.withColumn("open", F.max("ended").over(inside))
    # Over a file's runs: the same, of one row a run.
    across = Window.partitionBy("file").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = placed.groupBy("file", "run").agg(F.sum("n").alias("run_n"), F.sum(F.size("ends")).alias("run_seps"), F.max("ended").alias("run_end"))
    runs = runs.withColumns({"run_at": F.coalesce(F.sum("run_n").over(across), F.lit(0)), "run_no": F.coalesce(F.sum("run_seps").over(across), F.lit(0))})
    runs = runs.withColumn("run_last", F.col("run_at") + F.col("run_end")).withColumn("run_open", F.coalesce(F.max("run_last").over(across), F.lit(-1)))
    at = placed.join(runs, ["file", "run"]).filter(F.size("ends") > 0).select(
        "file", (F.col("run_at") + F.col("before")).alias("base"), (F.col("run_no") + F.col("seps")).alias("no"),
        F.coalesce(F.col("run_at") + F.col("open"), F.col("run_open")).alias("open"), "ends")
    previous = F.when(F.col("j") == 0, F.col("open")).otherwise(F.col("base") + F.try_element_at("ends", F.greatest("j", F.lit(1))))
    closed = at.select("*", F.posexplode("ends").alias("j", "end")).select(
        "file", (F.col("no") + F.col("j")).alias("doc_no"), (previous + 1).alias("start"),
        (F.col("base") + F.col("end") - previous - 1).alias("n_tokens"), F.lit(True).alias("closed"))
    tail = runs.groupBy("file").agg(F.sum("run_n").alias("all"), F.sum("run_seps").alias("no"), F.coalesce(F.max("run_last"), F.lit(-1)).alias("open")).filter("all > open + 1")
    return closed.unionByName(tail.select("file", F.col("no").alias("doc_no"), (F.col("open") + 1).alias("start"),
                                          (F.col("all") - F.col("open") - 1).alias("n_tokens"), F.lit(False).alias("closed")))


def count(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, block: int = BLOCK) -> DataFrame:
    """(id, file, doc_no, start, n_tokens) of every document: the files of ``write_flat`` under ``spark.checkpoint.dir`` are scanned
    and each document found is named by its number in its file. Cases as in ``write_flat``."""
    folder = scratch_path(docs.sparkSession, "token-files")
    names = write_flat(docs, folder, key, text, vocabulary)
    files = names.select("file").distinct()
    if not files.take(1):  # no file, so no folder to list
        return names.select("id", "file", "doc_no", F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("n_tokens"))
    listed = listing(docs.sparkSession, folder).withColumn("file", F.substring_index("path", "/", -1)).join(files, "file", "left_semi")
    found = scan(token_files(listed, block=block)).withColumn("file", F.substring_index("file", "/", -1))
    return names.join(found, ["file", "doc_no"]).select("id", "file", "doc_no", "start", "n_tokens")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = count(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), "n_tokens")
