"""Tables written to the cluster's shared folder to cut lineage or to pin an order."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local session without one uses a temporary folder, a cluster's must set it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.conf.get("spark.master", "")
    if not base and master != "local" and not master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (base or "file://" + os.path.join(tempfile.gettempdir(), "trawl-shared")).rstrip("/")


def pinned(df: DataFrame, tag: str) -> DataFrame:
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/trawl-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
