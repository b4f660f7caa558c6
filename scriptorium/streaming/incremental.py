"""Stage files that arrive over time: every micro-batch runs only the jobs that have no result yet.

The batch form of this is an anti-join against the finished rows; here the
same step runs for each micro-batch, and the results form a Parquet table.
There is no event time, watermark or window in this engine's domain.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from scriptorium.sources.connectors import pending


def finished(spark: SparkSession, path: str) -> DataFrame | None:
    """The results so far, or nothing."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    return spark.read.parquet(path) if there else None


def process_arrivals(
    spark: SparkSession, source: str, schema: str, results: str, checkpoint: str, work: Callable[[DataFrame], DataFrame]
) -> StreamingQuery:
    """Run ``work`` (which gives id and valid, among others) over new JSON lines in ``source`` until none is left.

    A batch writes to a folder of its own number, so one that is run again
    after a failure replaces its rows instead of adding them.
    """

    def step(batch: DataFrame, number: int) -> None:
        jobs = batch.dropDuplicates(["id"])
        done = finished(batch.sparkSession, results)
        todo = jobs if done is None else pending(jobs, done.filter(f"batch <> {number}"))
        work(todo).write.mode("overwrite").parquet(f"{results}/batch={number}")

    stream = spark.readStream.schema(schema).json(source)
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(step).start()
