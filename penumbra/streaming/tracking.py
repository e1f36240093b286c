"""Live tracking as streams with keyed state and timers: throttled samples, resets, expiry, bad rows aside, latest answers."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import geo
from .adherence import next_state

#: A sample passes if it comes so many milliseconds after the last that did, or so many metres from it.
INTERVAL_MS, INTERVAL_M = 3_000, 10.0
#: Without a sample for so long in event time, a walk is over; how late rows may come.
EXPIRE_MS, LATE = 10 * 60 * 1000, "1 minute"
#: Kinds of rows that come in.
SAMPLE, STOP = "sample", "stop"
#: What comes out: states of walks, and rows that no state comes of, with the reason.
STATE, ERROR = "state", "error"
TRACKED = "user_id long, path_key string, event_id long, ts timestamp, output string, kind string, distance_m double, streak int"
_COLUMNS = [c.split()[0] for c in TRACKED.split(", ")]


def bad_sample(lat, lon, accuracy) -> bool:
    numbers = [math.nan if x is None else x for x in (lat, lon, accuracy)]
    return not all(map(math.isfinite, numbers)) or abs(numbers[0]) > 90 or abs(numbers[1]) > 180 or numbers[2] < 0


def metres(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    east = math.radians(lon2 - lon1) * math.cos(math.radians((lat1 + lat2) / 2))
    return geo.EARTH_RADIUS_M * math.hypot(math.radians(lat2 - lat1), east)


class Tracking(StatefulProcessor):
    """One user's walk. Its state is where and when the last sample passed, on which path, and the streak of far samples.

    A change of path starts the streak afresh, a stop forgets the walk, and so does a timer when no sample has passed for EXPIRE_MS;
    both say so in a row. Samples too soon and too near after the last that passed, or older than it, are
    dropped; those that aren't a place go to the error output and change nothing.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.walk = handle.getValueState("walk", "path_key string, streak int, ms long, lat double, lon double, timer long")

    def _forget(self) -> None:
        if self.walk.exists():
            self.handle.deleteTimer(self.walk.get()[5])
            self.walk.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(["ts", "event_id"], kind="stable")
        out, walk = [], self.walk.get() if self.walk.exists() else None
        before = walk
        for r in frame.to_dict("records"):
            say = lambda output, kind, distance=None, streak=0, r=r: out.append((key[0], r["path_key"], r["event_id"], r["ts"], output, kind, distance, streak))
            if r["input"] == STOP:
                say(STATE, "stopped")
                walk = None
                continue
            if bad_sample(r["lat"], r["lon"], r["acc"]):
                say(ERROR, "LOCATION_UNAVAILABLE")
                continue
            ms = r["ts"].value // 1_000_000
            if walk is not None and walk[0] == r["path_key"]:
                if ms < walk[2] or (ms - walk[2] < INTERVAL_MS and metres(walk[3], walk[4], r["lat"], r["lon"]) < INTERVAL_M):
                    continue
                streak = walk[1]
            else:
                streak = 0
            distance = None if r["distance_m"] is None or math.isnan(r["distance_m"]) else r["distance_m"]
            kind, streak = next_state(streak, distance, r["acc"])
            say(STATE, kind, distance, streak)
            walk = (r["path_key"], streak, ms, r["lat"], r["lon"], ms + EXPIRE_MS)
        if walk is None:
            self._forget()
        elif walk != before:
            if before is not None:
                self.handle.deleteTimer(before[5])
            self.handle.registerTimer(walk[5])
            self.walk.update(walk)
        yield pd.DataFrame(out, columns=_COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = expiredTimerInfo.getExpiryTimeInMs()
        if self.walk.exists() and self.walk.get()[5] == due:
            path = self.walk.get()[0]
            self.walk.clear()
            yield pd.DataFrame([(key[0], path, None, pd.Timestamp(due, unit="ms"), STATE, "expired", None, 0)], columns=_COLUMNS)
        else:
            yield pd.DataFrame([], columns=_COLUMNS)

    def close(self) -> None:
        pass


def track(rows: DataFrame) -> DataFrame:
    """States and errors of a stream of (user_id, path_key, event_id, ts, input, lat, lon, acc, distance_m); needs the RocksDB state store.

    ``input`` is sample or stop; distance_m is ``adherence.distance_to_route``. See Tracking.
    """
    timed = rows.withWatermark("ts", LATE)
    return timed.groupBy("user_id").transformWithStateInPandas(statefulProcessor=Tracking(), outputStructType=TRACKED, outputMode="Append", timeMode="EventTime")


def to_two_sinks(tracked: DataFrame, states: str, errors: str, checkpoint: str):
    """A writer that appends states and errors of one stream to folders of their own. Batches are written under their number, so one that is repeated replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        for output, folder in ((STATE, states), (ERROR, errors)):
            kept.where(F.col("output") == output).drop("output").write.mode("overwrite").parquet(f"{folder}/batch={number}")
        kept.unpersist()

    return tracked.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


#: Kinds of rows of ``latest_answers``.
ASKED, ANSWERED = "asked", "answered"
#: A user who asks nothing for so long in event time is forgotten.
FORGET_MS = 60 * 60 * 1000
ANSWERS = "user_id long, request_seq long, ts timestamp, result string"


class Latest(StatefulProcessor):
    """Holds each user's last request; only its answer passes, once."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "request_seq long, timer long, answered boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows))
        frame = frame.assign(_answer=frame["input"] == ANSWERED).sort_values(["ts", "_answer", "request_seq"], kind="stable")
        last = before = self.last.get() if self.last.exists() else None
        out = []
        for seq, ts, answer, result in frame[["request_seq", "ts", "_answer", "result"]].itertuples(index=False):
            if not answer:
                if last is None or seq > last[0]:
                    last = (int(seq), ts.value // 1_000_000 + FORGET_MS, False)
            elif last is not None and seq == last[0] and not last[2]:
                out.append((key[0], int(seq), ts, result))
                last = (last[0], last[1], True)
        if last is not None and last != before:
            if before is None or before[1] != last[1]:
                if before is not None:
                    self.handle.deleteTimer(before[1])
                self.handle.registerTimer(last[1])
            self.last.update(last)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in ANSWERS.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.last.exists() and self.last.get()[1] == expiredTimerInfo.getExpiryTimeInMs():
            self.last.clear()
        yield pd.DataFrame([], columns=[c.split()[0] for c in ANSWERS.split(", ")])

    def close(self) -> None:
        pass


def latest_answers(rows: DataFrame) -> DataFrame:
    """Answers to users' last requests in a stream of (user_id, request_seq, ts, input, result): one that comes after a newer request was asked is dropped."""
    return rows.withWatermark("ts", LATE).groupBy("user_id").transformWithStateInPandas(statefulProcessor=Latest(), outputStructType=ANSWERS, outputMode="Append", timeMode="EventTime")


def impressions_once(impressions: DataFrame) -> DataFrame:
    """One impression for each user, time of request and path; in a stream, keys are forgotten after an hour of event time."""
    key = ["user_id", "requested_at", "path_key"]
    return impressions.withWatermark("ts", "1 hour").dropDuplicatesWithinWatermark(key) if impressions.isStreaming else impressions.dropDuplicates(key)
