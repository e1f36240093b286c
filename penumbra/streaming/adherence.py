"""Is a walker still on the route? As a stream with keyed state, and as a batch with windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import geo

#: Worst usable accuracy, on-route and uncertain distances in metres, confirmations needed.
VAGUE_M, ON_M, MAYBE_M, CONFIRM = 50.0, 20.0, 35.0, 3
OUTPUT = "user_id long, path_key string, ts timestamp, kind string, distance_m double, streak int"


def normalise(samples: DataFrame) -> DataFrame:
    """Adds valid; a heading that isn't finite becomes null and a missing time is now."""
    ok = F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180) & (F.col("acc") >= 0)
    out = samples.withColumn("valid", F.coalesce(ok, F.lit(False))).withColumn("ts", F.coalesce("ts", F.current_timestamp()))
    return out.withColumn("heading", F.when(F.abs("heading") < float("inf"), F.col("heading"))) if "heading" in samples.columns else out


def distance_to_route(lat: Column, lon: Column, route: Column) -> Column:
    """Metres from a sample to the nearest segment of an array of points, in a projection centred on the sample; null without one."""
    kx, ky = F.cos(F.radians(lat)) * geo.METRES_LON, geo.lit(geo.METRES_LAT)

    def segment(i):
        a, b = F.get(route, i), F.get(route, i + 1)
        zero = geo.lit(0.0)
        return geo.on_segment(zero, zero, (a["lon"] - lon) * kx, (a["lat"] - lat) * ky, (b["lon"] - lon) * kx, (b["lat"] - lat) * ky)[3]

    return F.when(F.size(route) >= 2, F.array_min(F.transform(F.sequence(F.lit(0), F.size(route) - 2), segment)))


def certain(distance: Column, accuracy: Column) -> Column:
    return F.greatest(geo.lit(0.0), distance - accuracy)


def adherence_batch(samples: DataFrame) -> DataFrame:
    """(user_id, path_key, ts, distance_m, acc) with kind and streak: consecutive far samples since the last other one."""
    order = Window.partitionBy("user_id", "path_key").orderBy("ts", "event_id")
    far = F.coalesce((F.col("acc") <= VAGUE_M) & (certain(F.col("distance_m"), F.col("acc")) > MAYBE_M), F.lit(False))
    runs = samples.withColumn("far", far).withColumn("run", F.sum((~far).cast("int")).over(order))
    within = Window.partitionBy("user_id", "path_key", "run").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    streak = F.when(F.col("far"), F.sum(F.col("far").cast("int")).over(within)).otherwise(0)
    counted = runs.withColumn("streak", streak.cast("int"))
    vague = F.col("distance_m").isNull() | (F.col("acc") > VAGUE_M)
    kind = F.when(vague, "checking").when(certain(F.col("distance_m"), F.col("acc")) <= ON_M, "on-route").when(F.col("streak") >= CONFIRM, "off-route").otherwise("checking")
    return counted.withColumn("kind", kind).drop("far", "run")


def next_state(streak: int, distance: float | None, accuracy: float) -> tuple[str, int]:
    if distance is None or distance != distance or accuracy > VAGUE_M:
        return "checking", 0
    sure = max(0.0, distance - accuracy)
    if sure <= ON_M:
        return "on-route", 0
    if sure <= MAYBE_M:
        return "checking", 0
    return ("off-route" if streak + 1 >= CONFIRM else "checking"), streak + 1


class Adherence(StatefulProcessor):
    """Holds the streak of one user on one path. A new path is a new key, so a change of route starts afresh."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.streak = handle.getValueState("streak", "n int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        streak = self.streak.get()[0] if self.streak.exists() else 0
        frame = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        out = []
        for ts, distance, accuracy in frame[["ts", "distance_m", "acc"]].itertuples(index=False):
            kind, streak = next_state(streak, distance, accuracy)
            out.append((key[0], key[1], ts, kind, distance, streak))
        self.streak.update((streak,))
        yield pd.DataFrame(out, columns=["user_id", "path_key", "ts", "kind", "distance_m", "streak"])

    def close(self) -> None:
        pass


def adherence_stream(samples: DataFrame) -> DataFrame:
    """The same as a stream. Within a batch samples are taken by time; needs the RocksDB state store."""
    return samples.groupBy("user_id", "path_key").transformWithStateInPandas(statefulProcessor=Adherence(), outputStructType=OUTPUT, outputMode="Append", timeMode="None")


def latest(results: DataFrame, by: str = "user_id") -> DataFrame:
    """The answer to each user's last request; earlier ones that come late are dropped."""
    rest = [c for c in results.columns if c != by]
    return results.groupBy(by).agg(F.max_by(F.struct(*rest), "request_seq").alias("r")).select(by, "r.*")


def event_counts(events: DataFrame, window: str | None = None) -> DataFrame:
    """Events by name, for funnels; with a window (our addition) also by time, with a watermark on streams."""
    if window is None:
        return events.groupBy("name").agg(F.count("*").alias("n_events"))
    timed = events.withWatermark("ts", "10 minutes") if events.isStreaming else events
    return timed.groupBy(F.window("ts", window).alias("w"), "name").agg(F.count("*").alias("n_events")).select(F.col("w.start").alias("window_start"), "name", "n_events")


def feedback_once(submissions: DataFrame) -> DataFrame:
    """One submission of each path in a stream; keys are forgotten after an hour of event time."""
    return submissions.withWatermark("ts", "1 hour").dropDuplicatesWithinWatermark(["user_id", "path_key"])
