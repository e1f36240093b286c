"""Session helpers."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers of all executors, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="penumbra-code-"), "penumbra.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("penumbra", os.path.relpath(full, root)))
    context.addPyFile(target)
    _SHIPPED.add(context.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir; a temporary one only where none is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="penumbra-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


#: Most rows of a table of a few numbers a row that may be broadcast.
MOST_ROWS = 100_000


def bounded(df: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """Broadcast a table of a few numbers a row if it has at most ``most`` rows, which is counted; otherwise leave its joins to a shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def dealt(df: DataFrame) -> DataFrame:
    """Rows of a small file dealt out to all cores, for work that is heavy on each row: Spark reads such a file in one task."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)


#: Rows of a few numbers that one task may sort or count at once.
ROWS_A_TASK = 400_000


def by_rows(df: DataFrame, rows: int, *keys: str, joined: bool = False) -> DataFrame:
    """A table that comes to so many rows, dealt out by its keys so that no task gets many more than ROWS_A_TASK; a table that every core can take a share of stays.

    Left alone, Spark joins shuffle partitions by their bytes in files, where ids and cells are far smaller than in memory. For a join
    it keeps such partitions only if they are no fewer than spark.sql.shuffle.partitions.
    """
    n = -(-rows // ROWS_A_TASK)
    spark = df.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions")) if joined else 1
    return df if n <= spark.sparkContext.defaultParallelism else df.repartition(max(n, least), *keys)


def remove(spark: SparkSession, path: str) -> None:
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may have ended already
        pass


def keep(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, and outlives lost executors.

    Files of millions of rows can be small, as ids and labels compress well, so a table of more than MOST_ROWS rows says that its joins are not to broadcast it.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/penumbra-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(remove, spark, path)
    kept = spark.read.schema(df.schema).parquet(path)
    return kept if kept.limit(MOST_ROWS + 1).count() <= MOST_ROWS else kept.hint("merge")
