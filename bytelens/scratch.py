"""Intermediate tables in the cluster's shared folder, and global order without a single-task window.

A table written here cuts lineage and survives the loss of any executor. The folder is the one that
``spark.checkpoint.dir`` names; only where that is unset, and Spark runs in one process (tests), a temporary one is made.
"""

from __future__ import annotations

import atexit
import gc
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """Where executors and driver can all write; raises on a cluster that names no such folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = held.get() if held.isDefined() else None
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="bytelens-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


class Scratch:
    """Tables of one run of an operator."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.dir = f"{shared_folder(spark)}/bytelens-{uuid.uuid4().hex}"
        atexit.register(self.clear)

    def path(self) -> str:
        return f"{self.dir}/{uuid.uuid4().hex}"

    def save(self, df: DataFrame) -> DataFrame:
        """Write df and read it back."""
        path = self.path()
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        for df in frames:
            self._delete(df._scratch_path)

    def release(self, times: int = 1) -> None:
        """Let Spark delete the shuffle files of steps whose results are written; else they stay until a collection of garbage.

        What Python held is let go by the JVM a little later, so one more time after that finds more.
        """
        for k in range(times):
            if k:
                time.sleep(0.3)
            gc.collect()
            self.spark._jvm.System.gc()

    def clear(self) -> None:
        try:
            self._delete(self.dir)
        except Exception:  # the session has ended
            pass

    def _delete(self, path: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def ordered(df: DataFrame, order: list[Column], scratch: Scratch, sums: dict[str, str] | None = None, pos: str = "pos") -> DataFrame:
    """df with its place ``pos`` (long, from 0) in the global order, and running sums of what stands before.

    Rows are dealt by range and numbered in each part; the driver holds one row for each part only.
    sums: new column -> column to sum.
    """
    sums = sums or {}
    part = scratch.save(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    totals = part.groupBy("_part").agg(F.count("*").alias("n"), *[F.sum(c).alias(k) for k, c in sums.items()]).orderBy("_part").collect()
    before, rows = dict.fromkeys(["n", *sums], 0), []
    for t in totals:
        rows.append((t["_part"], *before.values()))
        before = {k: v + (t[k] or 0) for k, v in before.items()}
    schema = "_part int, _n long" + "".join(f", _b_{k} long" for k in sums)
    starts = scratch.spark.createDataFrame(rows, schema)
    w = Window.partitionBy("_part").orderBy(*order)
    out = part.join(F.broadcast(starts), "_part")
    out = out.withColumn(pos, F.row_number().over(w) - 1 + F.col("_n"))
    for k, c in sums.items():
        run = F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1))
        out = out.withColumn(k, F.coalesce(run, F.lit(0)) + F.col(f"_b_{k}"))
    return out.drop("_part", "_n", *[f"_b_{k}" for k in sums])
