"""Sinks: tiles, staged releases, analytics events and feedback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Kinds of events; most characters of memo and city; most rows of feedback a day.
EVENTS = ["route_search", "route_result", "route_failure", "route_select", "feedback_impression", "feedback_submit", "location_track"]
MOST_MEMO, MOST_CITY, MOST_A_DAY = 500, 60, 500
#: Most bytes of one tile's elements and of a release.
MOST_TILE_BYTES, MOST_RELEASE_BYTES = 2_000_000, 70_000_000


def write_tiles(elements: DataFrame, path: str, size: Column) -> None:
    """One folder for each tile, elements in order of id; ends with an error if a tile or all of them are too large."""
    sizes = elements.groupBy("tile_id").agg(F.sum(size).alias("bytes")).agg(F.max("bytes"), F.sum("bytes")).first()
    if (sizes[0] or 0) > MOST_TILE_BYTES or (sizes[1] or 0) > MOST_RELEASE_BYTES:
        raise ValueError("a tile or the release is too large")
    elements.repartition("tile_id").sortWithinPartitions("tile_id", "id").write.partitionBy("tile_id").mode("overwrite").parquet(path)


def publish(table: DataFrame, staging: str, target: str, check) -> None:
    """Write to a staging path, check what is read back, and only then put it in place by a rename.

    The release before is set aside under the target's name with .before, and comes back if anything fails; after a
    crash between the renames it is found there.
    """
    spark: SparkSession = table.sparkSession
    table.write.mode("overwrite").parquet(staging)
    if not check(spark.read.parquet(staging)):
        raise ValueError("the staged release does not verify")
    jvm = spark.sparkContext._jvm
    a, b = jvm.org.apache.hadoop.fs.Path(staging), jvm.org.apache.hadoop.fs.Path(target)
    fs = b.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    aside = jvm.org.apache.hadoop.fs.Path(f"{target.rstrip('/')}.before")
    fs.delete(aside, True)
    if fs.exists(b) and not fs.rename(b, aside):
        raise OSError("the release before could not be put aside")
    if not fs.rename(a, b):
        fs.rename(aside, b)
        raise OSError("the release could not be put in place")
    if not check(spark.read.parquet(target)):
        fs.delete(b, True)
        fs.rename(aside, b)
        raise ValueError("the published release does not verify")
    fs.delete(aside, True)


def legacy_tiles(elements: DataFrame, most: int = 32) -> DataFrame:
    """Elements (tile_id, id, ...) of the first tile format: each once in a tile; an error if one spans more than ``most`` tiles."""
    wide = elements.groupBy("id").agg(F.count_distinct("tile_id").alias("n")).where(F.col("n") > most)
    if not wide.isEmpty():
        raise ValueError(f"an element spans more than {most} tiles")
    return elements.dropDuplicates(["tile_id", "id"])


def append_events(events: DataFrame, path: str) -> None:
    """Known kinds of events, appended."""
    events.where(F.col("name").isin(EVENTS)).write.mode("append").partitionBy("name").parquet(path)


def feedback_status(memo: Column, city: Column, verdict: Column) -> Column:
    ok = verdict.isin("good", "mid", "bad") & (F.coalesce(F.length(memo), F.lit(0)) <= MOST_MEMO) & (F.coalesce(F.length(city), F.lit(0)) <= MOST_CITY)
    return F.when(F.coalesce(ok, F.lit(False)), "OK").otherwise("INVALID_FEEDBACK")


def within_daily_cap(feedback: DataFrame, most: int = MOST_A_DAY) -> DataFrame:
    """The first ``most`` rows of each day, by time and id."""
    order = F.row_number().over(Window.partitionBy(F.to_date("ts")).orderBy("ts", "id"))
    return feedback.withColumn("day_rank", order).where(F.col("day_rank") <= most)


def safe_cell(text: Column) -> Column:
    """Text that a spreadsheet would take for a formula gets a quote in front."""
    return F.regexp_replace(text, r"^([=+\-@])", r"'$1")


def first_of_path(feedback: DataFrame) -> DataFrame:
    """One submission for each user and path: the first."""
    order = F.row_number().over(Window.partitionBy("user_id", "path_key").orderBy("ts", "id"))
    return feedback.withColumn("_k", order).where("_k = 1").drop("_k")
