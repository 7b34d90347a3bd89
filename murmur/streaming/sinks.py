"""Idempotent file sinks and run helpers for streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.types import LongType, StructField, StructType

from murmur.session import scratch_dir

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """State larger than memory, and the provider arbitrary state needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def write_batches(frame: DataFrame, path: str):
    """foreachBatch writer: a re-run batch overwrites its own folder, nothing is doubled."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
    return frame.writeStream.foreachBatch(write)


def run_and_keep(frame: DataFrame, label: str, mode: str = "append") -> tuple[DataFrame, str]:
    """Process all input that is there now; the written rows with their batch, and the checkpoint."""
    spark = frame.sparkSession
    out, checkpoint = scratch_dir(spark, label), scratch_dir(spark, f"{label}-checkpoint")
    query = (write_batches(frame, out).outputMode(mode)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()
    schema = StructType([*frame.schema.fields, StructField("batch_id", LongType())])
    return spark.read.schema(schema).parquet(out), checkpoint


def run_available(frame: DataFrame, label: str, mode: str = "append") -> DataFrame:
    return run_and_keep(frame, label, mode)[0]


def latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of keys written by several batches, the row of the last one."""
    values = [c for c in rows.columns if c not in (*keys, "batch_id")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch_id").alias("r")).select(
        *keys, "r.*")


def start_flush(frame: DataFrame, out: str, checkpoint: str,
                every: str = "300 seconds") -> StreamingQuery:
    """Long-running micro-batch append; the checkpoint makes every row land once."""
    return (frame.writeStream.format("parquet").outputMode("append").option("path", out)
            .option("checkpointLocation", checkpoint).trigger(processingTime=every).start())


class LateRows(StreamingQueryListener):
    """Counts the rows that watermarks drop, for each query since the listener was added."""

    def __init__(self) -> None:
        self.dropped: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        self.dropped.setdefault(str(event.id), 0)

    def onQueryProgress(self, event) -> None:
        late = sum(op.numRowsDroppedByWatermark for op in event.progress.stateOperators)
        self.dropped[str(event.progress.id)] = self.dropped.get(str(event.progress.id), 0) + late

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
