"""What the training-data operators share: table reading, scratch space, Arrow text buffers."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"
BATCH_CONF, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 2 << 20
CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where the session names none and all is one machine."""
    root = spark.sparkContext.getCheckpointDir() or spark.conf.get(CHECKPOINT_CONF, None)
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError(f"{CHECKPOINT_CONF} must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quillspark-")
        spark.sparkContext.setCheckpointDir(root)
        root = spark.sparkContext.getCheckpointDir()
    if "://" not in root:
        root = "file://" + root.removeprefix("file:")
    return root


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared root; the file system drops it when the driver ends."""
    path = f"{shared_root(spark)}/quillspark/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes to the shared folder and reads again, so lost executors cost no rework of what came before."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    before = spark.conf.get(CLEANUP_CONF)
    # What is written needs its shuffle files no longer, so disk holds those of one step at a time.
    spark.conf.set(CLEANUP_CONF, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP_CONF, before)
    return spark.read.schema(df.schema).parquet(path)


def release() -> None:
    """Gives the memory that a task has freed back to the system, as workers live on between tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        return  # other C libraries have no such call and give back memory by themselves


def arrow_map(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow whose workers hold nothing once a task is over."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return df.mapInArrow(whole, schema)


#: A key is hot with more than this share of all rows, so there are fewer hot keys than HOT_SHARES, and with HOT_ROWS at least.
HOT_SHARES, HOT_ROWS = 1000, 1000


def join_counted(rows: DataFrame, per_key: DataFrame, keys: list[str], spread_by: list[str], count: str = "c", counts: DataFrame | None = None) -> DataFrame:
    """Inner join of rows with a table of one row for each key, whose column `count` has the key's number of rows; with
    `counts`, that table has them, and `per_key` may have several rows a key.

    Rows of hot keys are dealt out by `spread_by`, and the key's own rows are repeated for each part, so no task gets more
    than about a thousandth of the rows of one key. Only the hot keys are broadcast. The table of counts is read several
    times, so it should be a written one.
    """
    counts = per_key if counts is None else counts
    total = counts.agg(F.sum(count)).first()[0] or 0
    limit = max(total // HOT_SHARES, HOT_ROWS)
    hot = counts.where(F.col(count) > limit).select(*keys, F.ceil(F.col(count) / limit).cast("int").alias("__parts"))
    if hot.isEmpty():
        return rows.join(per_key, keys)
    part = F.coalesce(F.pmod(F.xxhash64(*spread_by), F.col("__parts")), F.lit(0)).cast("int")
    rows = rows.join(F.broadcast(hot), keys, "left").withColumn("__part", part).drop("__parts")
    every = F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1)
    per_key = per_key.join(F.broadcast(hot), keys, "left").withColumn("__part", F.explode(every)).drop("__parts")
    return rows.join(per_key, [*keys, "__part"]).drop("__part")


def reads_files(df: DataFrame) -> bool:
    """Whether the rows come straight from files: no shuffle, join or local rows below projections and filters."""
    plan = df._jdf.queryExecution().optimizedPlan()
    while plan.getClass().getSimpleName() in ("Project", "Filter"):
        plan = plan.children().head()
    name = plan.getClass().getSimpleName()
    return name == "LogicalRelation" and "HadoopFsRelation" in plan.relation().getClass().getSimpleName() or name == "DataSourceV2ScanRelation" and bool(df.inputFiles())


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without copying; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    base, stop = int(ends[0]), int(ends[-1])
    body = np.frombuffer(data, np.uint8)[base:stop] if data is not None else np.zeros(0, np.uint8)
    return body, ends - base


def slices(batches: Iterator[pa.RecordBatch], limit: int = 8 << 20, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that each has about `limit` bytes of `column` (one longer row stays whole)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        ends = utf8(batch.column(column))[1]
        begin = 0
        while begin < n:
            stop = max(begin + 1, int(np.searchsorted(ends, ends[begin] + limit, "right")) - 1)
            yield batch.slice(begin, stop - begin)
            begin = stop


def byte_table(seed: int, bits: int = 64) -> np.ndarray:
    """A fixed random word for every byte value."""
    return np.random.default_rng(seed).integers(0, 1 << bits, 256, dtype=np.uint64)


def finish(x: np.ndarray) -> np.ndarray:
    """Mixes 64-bit words in place so that all bits depend on all bits."""
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values; sorting takes less time than the hash table of np.unique."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def places(n: int, *parts: np.ndarray) -> np.ndarray:
    """Sorted distinct places below n of all parts."""
    mask = np.zeros(n, bool)
    for p in parts:
        mask[p] = True
    return np.flatnonzero(mask)


def small_batches(spark: SparkSession, limit: int = BATCH_BYTES) -> None:
    """Arrow batches of at most `limit` bytes (one longer row stays whole), so that executors hold little beside their own
    state; a smaller setting of the session stays."""
    now = str(spark.conf.get(BATCH_CONF)).rstrip("b")
    if not now.isdigit() or int(now) >= BATCH_BYTES:
        spark.conf.set(BATCH_CONF, str(limit))


def doc_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Only id and text, so that further columns of any name do no harm."""
    small_batches(docs.sparkSession, batch_bytes)
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
