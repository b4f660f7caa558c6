"""Tables in the shared folder that cut lineage, and row numbers without a single-task sort."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOCAL_DEFAULT = "/tmp/checkpoints/scriptorium"
PACKAGE_ROOT = Path(__file__).resolve().parents[2]


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package, unless their PYTHONPATH already has it."""
    if str(PACKAGE_ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    sc = spark.sparkContext
    if getattr(sc, "_scriptorium_shipped", False):
        return
    path = Path(tempfile.mkdtemp(prefix="scriptorium-")) / "scriptorium_pkg.zip"  # Spark sends the file to the executors
    with zipfile.ZipFile(path, "w") as z:
        for p in (PACKAGE_ROOT / "scriptorium").rglob("*.py"):
            z.write(p, p.relative_to(PACKAGE_ROOT))
    sc.addPyFile(str(path))
    sc._scriptorium_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder under spark.checkpoint.dir, deleted when the driver ends.

    Where the setting is missing a local master gets a default of our own; a
    cluster has no folder that all executors share, which is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = f"{(base or LOCAL_DEFAULT).rstrip('/')}/scriptorium-{uuid.uuid4().hex}"
    file_system, folder = _hadoop(spark, path)
    file_system.mkdirs(folder)
    file_system.deleteOnExit(folder)
    return path


def _hadoop(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: lineage ends in files that survive lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}"
    df.write.mode("overwrite").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scriptorium_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of materialize() that no later plan reads."""
    for df in tables:
        path = getattr(df, "_scriptorium_path", None)
        if path:
            file_system, folder = _hadoop(df.sparkSession, path)
            file_system.delete(folder.getParent(), True)


def exchange_parts(df: DataFrame, bytes_each: int = 256 << 20) -> int:
    """Partitions for an exchange of ``df``: the session's number, more where the planner's size of the input asks for it."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    wanted = min(-(-size // bytes_each), 1_000_000)  # a planner without statistics may name any size
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), wanted, 1)


def number_parts(rows: DataFrame, *order: str) -> DataFrame:
    """The rows in ranges of ``order``, with the number ``_part`` of their range and their place ``_place`` in it."""
    spark, names = rows.sparkSession, rows.columns

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            parts = pa.array(np.full(batch.num_rows, part, dtype=np.int32))
            places = pa.array(np.arange(n, n + batch.num_rows, dtype=np.int64))
            n += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, parts, places], [*names, "_part", "_place"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    tasks = exchange_parts(rows)
    keys = [F.col(c).asc_nulls_first() for c in order]
    ranged = rows.repartitionByRange(tasks, *keys).sortWithinPartitions(*keys)
    return materialize(ranged.mapInArrow(number, f"{fields}, _part int, _place long"), "numbered")


def number_rows(rows: DataFrame, *order: str) -> DataFrame:
    """Add ``number``, from 0 in ``order``: only the sizes of the ranges meet on the driver."""
    placed = number_parts(rows, *order)
    sizes = placed.groupBy("_part").count().collect()
    starts, total = [], 0
    for r in sorted(sizes, key=lambda r: r["_part"]):
        starts += [F.lit(r["_part"]), F.lit(total)]
        total += r["count"]
    start = F.create_map(*starts)[F.col("_part")] if starts else F.lit(0)
    return placed.withColumn("number", (F.col("_place") + start).cast("long")).drop("_part", "_place")
