"""Helpers shared by the corpus operators: word columns, scratch tables, broadcast checks."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import remove, shared_folder

#: A word is a run of characters other than space, tab, \n, \v, \f, \r.
SPACE = r"[\x20\x09-\x0D]+"
#: Spark's setting that deletes an execution's shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Tables up to this many rows may be broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 200_000
#: Most bytes of texts in a broadcast table.
BROADCAST_BYTES = 32 << 20


def fold_case(text: Column) -> Column:
    """Lower-case A-Z only, leaving every other letter as it is."""
    ascii_only = F.length(text) == F.octet_length(text)
    slow = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(ascii_only, F.lower(text)).otherwise(slow)


def words_of(text: Column, separator: str = SPACE) -> Column:
    """Array of the words of a text; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), separator), lambda w: w != "")


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times inside one expression."""
    return F.transform(F.array(value), body)[0]


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/penumbra-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")  # the table stands for what was shuffled to make it
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    atexit.register(remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def small_enough(df: DataFrame, limit: int = BROADCAST_ROWS, size: Column | None = None) -> bool:
    """Whether a table has at most ``limit`` rows and, by ``size``, BROADCAST_BYTES; reads no more than limit + 1 of them.

    ``size`` is the length of what varies in a row; without it, rows are taken to be a few numbers or an id.
    """
    rows = df.limit(limit + 1).select((F.lit(0) if size is None else size).cast("long").alias("n"))
    n, total = rows.agg(F.count("*"), F.sum("n")).first()
    return n <= limit and (total or 0) <= BROADCAST_BYTES


def maybe_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS, size: Column | None = None) -> DataFrame:
    """Broadcast ``df`` where its counted size allows; otherwise leave the join to a shuffle."""
    return F.broadcast(df) if small_enough(df, limit, size) else df


def with_found(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Rows (_id, _key, ...) with what was ``found`` for their (_of, _of_key); others fall out, unshuffled where the found ones are few."""
    same = rows["_id"].eqNullSafe(F.col("_of")) & (rows["_key"] == F.col("_of_key"))
    ids = found.select("_of", "_of_key")
    if small_enough(ids):
        rows = rows.join(F.broadcast(ids), same, "left_semi")
    return rows.join(found, same).drop("_of", "_of_key")


#: From so many rows on a key is hot; and there are never more hot keys than this.
HOT_ROWS, MOST_HOT = 2_000, 50_000


def join_skewed(rows: DataFrame, small: DataFrame, on: list[str], size: Column | None = None) -> DataFrame:
    """Inner join with a table that has one row a key and says how many rows meet it (n, dropped).

    Hot keys meet their rows by a broadcast, where these few entries are small enough, so no task gets all rows of a key; the others by a shuffle.
    """
    total = small.agg(F.sum("n")).first()[0] or 0
    hot = small.where(F.col("n") > max(HOT_ROWS, total // MOST_HOT)).drop("n")
    if hot.isEmpty() or not small_enough(hot, size=size):
        return rows.join(small.drop("n"), on)
    cold = small.join(F.broadcast(hot.select(*on)), on, "left_anti").drop("n")
    return rows.join(F.broadcast(hot), on).unionByName(rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(cold, on))
