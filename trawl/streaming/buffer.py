"""Read/write split: fresh documents stream into a buffer, searches see base and buffer, compaction folds them.

The buffer is a Parquet log written by ``foreachBatch``.  A batch's folder is named by its number and overwritten, so a
batch that is replayed after a failure leaves one copy; readers take the latest version of each id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from trawl.operators.mutate import fold


def write_buffer(stream: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Start writing a stream of changes (documents' columns, ts, op).  ``every``: the trigger's interval; None takes
    what there is and stops."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()


def buffered(spark, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{path}/batch=*")


def batches(spark, path: str) -> list[int]:
    """Numbers of the batches that the buffer holds."""
    paths = spark._jvm.org.apache.hadoop.fs
    folder = paths.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in system.listStatus(folder)] if system.exists(folder) else []
    return sorted(int(n.removeprefix("batch=")) for n in names if n.startswith("batch="))


def roll(store, path: str, schema, keep: int = 0, least: int = 1) -> int:
    """Move all but the newest ``keep`` batches from a buffer to a store's log, once there are ``least`` of them, and
    commit the store's postings if it has some.  Returns how many were moved.

    A change is known by its columns, so readers of store and buffer see no difference between the two steps, and a
    roll that is broken off and run again moves nothing twice."""
    spark = store.spark
    old = batches(spark, path)[: -keep or None]
    if len(old) < least:
        return 0
    folders = [f"{path}/batch={n}" for n in old]
    store.log(spark.read.schema(schema).parquet(*folders))
    if store.state["fields"]:
        store.commit_postings()
    for f in folders:
        p = spark._jvm.org.apache.hadoop.fs.Path(f)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    return len(old)


def merged(base: DataFrame, fresh: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Documents as of now: the buffer's changes over the base."""
    return fold(base, fresh, id_col)


def tagged(base: DataFrame, fresh: DataFrame) -> DataFrame:
    """Hits of base and buffer side by side with where they came from, unmerged."""
    return base.withColumn("origin", F.lit("base")).unionByName(fresh.select(base.columns).withColumn("origin", F.lit("buffer")))
