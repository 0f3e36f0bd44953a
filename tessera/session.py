"""Session helpers: one place for the configs every job relies on."""

from __future__ import annotations

import contextlib
import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app: str = "tessera") -> SparkSession:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        # Checkpoint files go once nothing refers to them any more.
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.sql.parquet.inferTimestampNTZ.enabled": "true",
        # Feature tables are wide (60-200 columns) and fill / filter every
        # column: constraint inference is quadratic-to-exponential there.
        "spark.sql.constraintPropagation.enabled": "false",
    }
    if master and master.startswith("local"):
        conf["spark.driver.memory"] = "16g"
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the executors (tasks import it by name), so it need
    not be installed there nor be in their working folder."""
    if getattr(ship, "to", None) is spark.sparkContext:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    packed = os.path.join(tempfile.mkdtemp(prefix="tessera-ship-"), "tessera.zip")
    with zipfile.ZipFile(packed, "w") as z:
        for folder, _, names in os.walk(here):
            for n in sorted(names):
                if n.endswith(".py"):
                    f = os.path.join(folder, n)
                    z.write(f, os.path.relpath(f, os.path.dirname(here)))
    spark.sparkContext.addPyFile(packed)
    ship.to = spark.sparkContext


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's ``spark.checkpoint.dir``; only a local master, whose
    executors share the driver's disk, gets a scratch directory when it is unset."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="tessera-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return d


@contextlib.contextmanager
def wide_tables(spark: SparkSession):
    """While plans over wide feature tables (many aliases and null filters) run:
    no constraint inference, which blows up there. The caller's setting returns."""
    name = "spark.sql.constraintPropagation.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def materialize(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut lineage by a reliable checkpoint in the shared checkpoint dir,
    so a lost executor recomputes from the written files, not from scratch."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)
