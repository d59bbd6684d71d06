"""Sessions and table loading."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def build(master: str = "local[*]", shuffle_partitions: int = 8, **config) -> SparkSession:
    builder = SparkSession.builder.master(master).appName("quillspark").config("spark.sql.shuffle.partitions", shuffle_partitions)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true", "spark.ui.enabled": "false"} | config
    return builder.config(map={k: str(v) for k, v in settings.items()}).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deals a table that comes in fewer parts than there are cores to all of them; larger tables stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


def cut(df: DataFrame) -> DataFrame:
    """The rows, computed once and written to the session's checkpoint folder, so that what follows doesn't plan them again.

    A folder of our own serves only where the session names none and all is one machine.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        root = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not root and context.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(root or tempfile.mkdtemp(prefix="quillspark-"))
    return df.checkpoint()
