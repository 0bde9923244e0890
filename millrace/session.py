"""Session builder and the few session-level helpers the operators share."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side is broadcast; its rows must have a bounded width.
BROADCAST_ROWS = 200_000


def session(app: str = "millrace", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume: UTC, AQE, last-wins maps."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.ui.enabled": "false",
    }
    for key, value in {**settings, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    A cluster names it in ``spark.checkpoint.dir``. A folder of our own is made
    only where that setting is absent, as in local tests.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder shared by the cluster")
    path = "file://" + os.path.join(tempfile.gettempdir(), "millrace-shared")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder; later reads survive the loss of any executor.

    A cut that nothing refers to any more is removed by Spark's cleaner where
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is on, as ``session`` sets it;
    what is left at the end of an application lies in one folder of its own.
    """
    context = df.sparkSession.sparkContext
    where = shared_dir(df.sparkSession)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(where)
    return df.checkpoint(eager=True)


def join_small(big: DataFrame, small: DataFrame, on, how: str = "left", rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join a materialised side, broadcast only if its counted rows stay under ``rows``.

    ``small`` must already be cut (it is counted here) and have rows of bounded
    width. Beyond the bound the join shuffles and adaptive execution splits hot keys.
    """
    if small.limit(rows + 1).count() <= rows:
        small = F.broadcast(small)
    return big.join(small, on, how)


def remove(spark: SparkSession, where: str) -> None:
    """Remove a file or folder by the file system that Spark knows it by."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def ship(spark: SparkSession) -> None:
    """Send the package to executors that do not have it on their path, once per context."""
    context = spark.sparkContext
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if root in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(context, "_millrace_shipped", False):
        return
    # Spark's own folder on the driver, which serves the file to the executors and goes with the session.
    path = os.path.join(SparkFiles.getRootDirectory(), "millrace-package.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for top, _, names in os.walk(os.path.join(root, "millrace")):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(top, name)
                    archive.write(full, os.path.relpath(full, root))
    context.addPyFile(path)
    context._millrace_shipped = True
