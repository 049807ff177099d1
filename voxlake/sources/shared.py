"""Lineage cuts in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session, with its scheme.

    Where the setting is missing and Spark runs in one process (tests), a temporary folder is set; on a cluster that is
    an error, because executors don't see each other's local folders.
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        found = context.getConf().get("spark.checkpoint.dir")
        if not found and not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(found or tempfile.mkdtemp(prefix="spark-"))
    found = context.getCheckpointDir().rstrip("/")
    return re.sub("^file:/+", "file:///", found)


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder and read from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder as Parquet and read from there: compressed, and only the columns that are asked for.

    A checkpoint holds rows as they are in memory, uncompressed, some five times as many bytes.
    """
    path = f"{shared_folder(df.sparkSession)}/written-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds ``name``: the row's number from 1 in the order of columns that tell all rows apart.

    Ranges of the order are numbered by themselves and start after the counts of those before; only counts of ranges
    come to one task.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = checkpointed(rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = ranged.withColumn("_k", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    return inside.join(F.broadcast(starts), "_part").select(*rows.columns, (F.col("_k") + F.col("_start")).alias(name))
