"""The Spark session, and the folder in which lineage is cut."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, partitions: int = 8) -> SparkSession:
    """A session on this machine for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only where the cluster names none (tests on one machine) one is made."""
    context = spark.sparkContext
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        if not context._jsc.sc().getCheckpointDir().isDefined():
            context.setCheckpointDir(known)
        return known
    found = context._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get()
    if not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    made = tempfile.mkdtemp(prefix="symstream-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    context.setCheckpointDir(made)
    return made


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the checkpoint folder; survives the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
