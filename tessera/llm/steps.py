"""Steps of long jobs."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession

from tessera.session import ensure_checkpoint_dir, materialize


def release(spark: SparkSession) -> None:
    """Let the shuffle files and checkpoints of earlier steps go: Spark's cleaner
    drops what nothing refers to, and learns of that from the driver's garbage
    collectors, which run here, between two steps, while the driver holds little."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def settle(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, after earlier steps'
    files were released."""
    release(df.sparkSession)
    return materialize(df)


class Scratch:
    """Tables of a job's steps, written as Parquet to a folder of their own under
    the shared checkpoint folder; the folder goes when the job leaves the block."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, f"{ensure_checkpoint_dir(spark)}/steps-{uuid.uuid4()}"

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self._delete(self.folder)

    def _delete(self, path: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` written, and read again; the step's shuffle files are let go."""
        df.write.parquet(f"{self.folder}/{name}")
        del df
        release(self.spark)
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def drop(self, *names: str) -> None:
        for n in names:
            self._delete(f"{self.folder}/{n}")
