"""Session, table access and the folder for cut lineage."""

from __future__ import annotations

import atexit
import gc
import io
import os
import shutil
import tempfile
import time
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = os.path.dirname(os.path.abspath(__file__))


def get_session(app: str = "evidelta", cores: str = "*", shuffle: int = 8) -> SparkSession:
    """A local session with the settings the engine is tested under."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once for each Spark context.

    Python functions are pickled by reference, so every worker must be able to import the
    package even where it isn't installed.
    """
    context = spark.sparkContext
    if getattr(context, "_evidelta_shipped", False):
        return
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, files in os.walk(_PACKAGE):
            for name in files:
                if name.endswith((".py", ".json")):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(_PACKAGE)))
    folder = tempfile.mkdtemp(prefix="evidelta_code_")  # the driver serves the file from here; no executor reads this folder
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, f"evidelta_{uuid.uuid4().hex[:8]}.zip")
    with open(path, "wb") as f:
        f.write(buffer.getvalue())
    context.addPyFile(path)
    context._evidelta_shipped = True


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the Parquet tables in ``folder``."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and written intermediates, shared by all executors.

    It is read from ``spark.checkpoint.dir``. Only where that is unset, as in tests on one
    machine, a temporary folder is made.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="evidelta_checkpoint_")
    context.setCheckpointDir(named)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read from there; deleted when the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished jobs whose plans nobody holds; else they stay until it happens to collect its garbage."""
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.2)


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` with at least as many partitions as the cluster has cores, for costly work row by row.

    Large tables have more partitions than that as they are read, and stay as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(2 * cores, key)
