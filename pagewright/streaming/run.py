"""Running a stateful plan over a table to its end, and ordered sinks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def shared_folder(spark: SparkSession) -> str:
    """A new folder under the cluster's checkpoint folder; on a single machine, a local one where none is set."""
    base = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not base and spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    base = base or tempfile.mkdtemp(prefix="pagewright-")
    return f"{base}/stream-{uuid.uuid4().hex}"


def once(table: DataFrame) -> DataFrame:
    """``table`` computed now and kept in the shared folder, for what is dear to compute and read by several branches."""
    sc = table.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_folder(table.sparkSession))
    return table.checkpoint()


def to_the_end(table: DataFrame, plan: Callable[[DataFrame], DataFrame], files: int = 1) -> DataFrame:
    """Writes ``table`` as the stream's source, runs ``plan`` until all is read, and returns what it wrote."""
    spark = table.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    at = shared_folder(spark)
    table.write.parquet(f"{at}/in")
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", max(1, files)).parquet(f"{at}/in")
    query = plan(stream).writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).outputMode("append").start()
    query.awaitTermination()
    return spark.read.parquet(f"{at}/out")


def ordered_json(events: DataFrame, path: str, checkpoint: str, keys: tuple[str, ...] = ("doc_id", "seq")):
    """Starts a sink that writes each batch's events as JSON lines, sorted by document and sequence."""

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.repartition(keys[0]).sortWithinPartitions(*keys)
        rows.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(f"{path}/batch={number}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
