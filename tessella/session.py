"""Session factory and the shared scratch folder."""

from __future__ import annotations

import atexit
import gc
import re
import tempfile
import time
import uuid
import weakref

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession


#: Where the tables of ``written`` are.
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def session(app: str = "tessella", **conf: str) -> SparkSession:
    """A session with the settings the queries expect; ``conf`` wins over them."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    return SparkSession.builder.appName(app).config(map=settings | conf).getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where that is unset and the master is local (tests on one machine) a temporary folder is set in its place.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    folder = folder or context.getCheckpointDir()
    if not folder:
        if not re.match(r"local($|\[)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tessella-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once, its lineage cut by files in the shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; it is deleted when the driver ends."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/tessella-{label}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001  the session may be gone before the driver ends
        return


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` computed once as Parquet in the shared folder and read again: smaller than a checkpoint.

    Shuffle files go when the driver's objects for them do, so those are collected here: the steps after need the disk.
    """
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    free_shuffles(spark)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes the files of a table that ``written`` gave and that no later step reads."""
    _delete(df.sparkSession, _PATHS.pop(df))


def free_shuffles(spark: SparkSession) -> None:
    """Collects the driver's objects of jobs that have ended.

    Events on their way to listeners hold plans, so those go first. Python lets go of objects in a thread of its own, and what
    the JVM's first collection finds, others may have held: one collection was seen to free nothing, the second everything.
    """
    gc.collect()
    try:
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    except Py4JError:  # a slow listener: what its events hold goes with a later collection
        pass
    for _ in range(3):
        time.sleep(0.2)
        spark.sparkContext._jvm.System.gc()
