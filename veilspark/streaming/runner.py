"""Run a streaming query to completion (``availableNow``) into a Parquet sink
under the shared checkpoint folder, then read the sink as a batch table.

The sink and the query checkpoint live in ``spark.checkpoint.dir`` so a
restarted driver resumes exactly once; nothing is collected to the driver.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from ..session import checkpoint_dir


def file_stream(spark: SparkSession, path_glob: str, schema, max_files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path_glob)


def files_for_all_tasks(spark: SparkSession) -> int:
    """Files of a micro-batch of a map-only stream: enough that every task slot
    has some.  Streams that depend on the order of arrival take one at a time."""
    return 2 * spark.sparkContext.defaultParallelism


@contextmanager
def settings(spark: SparkSession, conf: dict[str, str]):
    """Session settings for as long as a query is started and runs."""
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def write_arrivals(spark: SparkSession, frames: list[DataFrame], name: str) -> str:
    """Files that a stream reads one after the other, in the order of ``frames``; returns their glob."""
    base = f"{checkpoint_dir(spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex[:8]}"
    for i, f in enumerate(frames):
        f.coalesce(1).write.parquet(f"{base}/in/part={i:04d}")
    return f"{base}/in/*"


def run_to_table(sdf: DataFrame, name: str, output_mode: str = "append", conf: dict[str, str] | None = None) -> DataFrame:
    with settings(sdf.sparkSession, conf or {}):
        return _run_to_table(sdf, name, output_mode)


def _run_to_table(sdf: DataFrame, name: str, output_mode: str) -> DataFrame:
    spark = sdf.sparkSession
    base = f"{checkpoint_dir(spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex[:8]}"
    q = (sdf.writeStream.format("parquet").option("path", f"{base}/out")
         .option("checkpointLocation", f"{base}/chk").outputMode(output_mode)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return spark.read.parquet(f"{base}/out")


def run_batches(sdf: DataFrame, write, checkpoint: str) -> None:
    """Run to the end with ``write(batch, batch_id)`` for each micro-batch."""
    q = sdf.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
