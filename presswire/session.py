"""Session helpers: a local session for tests, and the shared work folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(name: str = "presswire", cores: int | str = 8, **conf: str) -> SparkSession:
    """Single-machine session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(conf.pop("shuffle_partitions", 8)))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        # skips recording a call site per column expression while a plan is built
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", conf.pop("driver_memory", "8g"))
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable by the Python workers, once per Spark context."""
    context = spark.sparkContext
    if getattr(context, "_presswire_shipped", False):
        return
    top = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="presswire-"), "presswire.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, files in os.walk(top):
            for name in files:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(top)))
    context.addPyFile(archive)
    context._presswire_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as the cluster names it in `spark.checkpoint.dir`.

    Where the setting is absent on one machine (tests) a temporary folder is created and
    remembered in the session; on a cluster that is an error, because no folder of one
    machine can be seen by the others.
    """
    folder = spark.conf.get(_CHECKPOINT_CONF, None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {_CHECKPOINT_CONF} to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="presswire-")
        spark.conf.set(_CHECKPOINT_CONF, folder)
    return folder


def work_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return os.path.join(shared_dir(spark), "presswire", f"{label}-{uuid.uuid4().hex}")


def filesystem(spark: SparkSession, path: str):
    """Hadoop path and file system of a place in the shared store."""
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path, hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def materialize(df: DataFrame) -> DataFrame:
    """Write once to reliable storage and cut the lineage."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)
