"""Streaming sources and running a stream over what is available."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.session import scratch_path
from panelcast.sources.tables import normalise

# Late-data policy: rows more than two hours behind the newest stamp are dropped.
WATERMARK = "2 hours"


SLICE_FILES = 4


def in_slices(df: DataFrame, ts: str, label: str, slices: int = 3) -> DataFrame:
    """A batch table written in ``slices`` of ascending ``ts`` and read back as a stream, one slice a micro-batch."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    low, high = df.select(F.unix_micros(F.min(ts)), F.unix_micros(F.max(ts))).first()
    if low is None:
        df.write.parquet(path)
        return stream_folder(spark, path)
    part = F.least(F.floor((F.unix_micros(ts) - low) * slices / (high - low + 1)), F.lit(slices - 1))
    for k in range(slices):
        df.where(part == k).repartition(SLICE_FILES).write.mode("append").parquet(path)
    return stream_folder(spark, path, files_per_batch=SLICE_FILES)


def stream_folder(spark: SparkSession, folder: str, pattern: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    """New parquet files of a folder as a stream, with the library's time and NULL rules."""
    sample = spark.read.option("pathGlobFilter", pattern).parquet(folder) if pattern else spark.read.parquet(folder)
    reader = spark.readStream.schema(sample.schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return normalise(reader.parquet(folder))


_STORE = "spark.sql.streaming.stateStore.providerClass"


def run_available(stream: DataFrame, label: str, mode: str = "append", timeout: float | None = None) -> DataFrame:
    """Process everything available into a parquet table in the shared folder and return that table; no time limit unless one is given.

    State lives in the RocksDB store, which typed state needs and which keeps it off the heap.
    """
    spark = stream.sparkSession
    spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    out, check = scratch_path(spark, label), scratch_path(spark, f"{label}-progress")
    q = (
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", check)
        .outputMode(mode).trigger(availableNow=True).start()
    )
    if timeout is None:
        q.awaitTermination()
    elif not q.awaitTermination(timeout):
        q.stop()
        raise TimeoutError(f"stream {label} did not finish in {timeout} s")
    return spark.read.schema(stream.schema).parquet(out)
