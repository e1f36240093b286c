"""Removal of repeated word sequences, found by doubling the length of windows level by level.

A level looks at windows of one length. Those that occur in one document alone end there; where one is
repeated, windows of twice the length over it are looked up at the next level, and so on up to the
wanted length. Below that length only one part of each target window is taken, the one of least
fingerprint (equal targets choose equal parts), so that a fraction of the places is enough.
``longest_repeats`` goes on doubling until no candidates survive.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import materialize, maybe_broadcast, small_enough, with_found
from .textwords import fingerprint, split_words, windows

#: Words of a window, and of the windows of the first level.
WIDTH, START = 13, 4


def level_lengths(width: int, start: int) -> list[int]:
    """Lengths of the levels before the last: ``start``, doubled as long as it is below ``width``."""
    out = [min(start, width)]
    while 2 * out[-1] < width:
        out.append(2 * out[-1])
    return out if out[-1] < width else []


def parts_of(prints: np.ndarray, width: int, part: int) -> np.ndarray:
    """For each target window, the fingerprint of the part of ``part`` words that stands for it."""
    if len(prints) < width:
        return np.empty(0, np.uint64)
    return np.lib.stride_tricks.sliding_window_view(windows(prints, part), width - part + 1).min(1)


def _among(values: np.ndarray, found) -> np.ndarray:
    return np.isin(values, found.values.to_numpy(zero_copy_only=False).view(np.uint64))


def _owned(batch, owner: list[np.ndarray]) -> list[pa.Array]:
    at = pa.array(np.concatenate(owner))
    return [batch.column(0).take(at), batch.column(1).take(at)]


def _level(rows: DataFrame, width: int, part: int, before: int | None) -> DataFrame:
    """(h, _id, _key) once for each part of each text; after the first level, only where the part of the level before is repeated."""

    def run(batches):
        for batch in batches:
            owner, values = [], []
            for k, text in enumerate(batch.column(2)):
                prints = fingerprint(split_words(text.as_py(), fold=False))
                h = parts_of(prints, width, part)
                if before and len(h):
                    h = h[_among(parts_of(prints, width, before), batch.column(3)[k])]
                h = np.unique(h)
                owner.append(np.full(len(h), k))
                values.append(h)
            if values:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(values).view(np.int64)), *_owned(batch, owner)], names=["h", "_id", "_key"])

    return rows.mapInArrow(run, f"h long, _id {rows.schema['_id'].dataType.simpleString()}, _key long")


def _targets(rows: DataFrame, width: int, before: int | None) -> DataFrame:
    """(h, _id, _key, places) of the target windows over a repeated part; h is a 128-bit hash of the window's bytes."""

    def run(batches):
        for batch in batches:
            owner, keys, places = [], [], []
            for k, text in enumerate(batch.column(2)):
                words = split_words(text.as_py(), fold=False)
                n = len(words) - width + 1
                if n <= 0:
                    continue
                live = np.flatnonzero(_among(parts_of(fingerprint(words), width, before), batch.column(3)[k])) if before else range(n)
                found: dict[bytes, list[int]] = {}
                for i in live:
                    found.setdefault(xxhash.xxh3_128_digest(b" ".join(words[i : i + width])), []).append(int(i))
                owner.append(np.full(len(found), k))
                keys += found
                places += found.values()
            if owner:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), *_owned(batch, owner), pa.array(places, pa.list_(pa.int32()))], names=["h", "_id", "_key", "places"])

    return rows.mapInArrow(run, f"h binary, _id {rows.schema['_id'].dataType.simpleString()}, _key long, places array<int>")


def _repeated(rows: DataFrame) -> DataFrame:
    """Windows (h) that occur in two documents or more, with the least of them. Combined before the shuffle."""
    return rows.groupBy("h").agg(F.min("_id").alias("lo"), F.max("_id").alias("hi")).where("lo < hi").select("h", "lo")


def _per_text(found: DataFrame, values) -> DataFrame:
    """What was found in each text as one array: no more than it has windows."""
    return found.groupBy(F.col("_id").alias("_of"), F.col("_key").alias("_of_key")).agg(values)


def repeated_windows(rows: DataFrame, width: int = WIDTH, start: int = START) -> DataFrame:
    """(_of, _of_key, places, later): where target windows of (_id, _key, _text) rows stand that another document has too.

    later says of each place's window whether it also starts in a document with a smaller id.
    """
    before, todo = None, rows
    for part in level_lengths(width, start):
        level = materialize(_level(todo, width, part, before))
        live = materialize(_per_text(level.join(_repeated(level), "h", "left_semi"), F.collect_list("h").alias("hs")))
        todo, before = with_found(rows, live).select("_id", "_key", "_text", "hs"), part
    targets = materialize(_targets(todo, width, before))
    both = targets.join(_repeated(targets), "h").select("_id", "_key", F.struct("places", (F.col("lo") < F.col("_id")).alias("later")).alias("p"))
    return _per_text(both, F.collect_list("p").alias("windows"))


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, start: int = START) -> DataFrame:
    """id, n_words, n_removed and kept_text (words joined by one space) of every row.

    A word goes if it lies in a window of ``width`` words that also starts in a document with a smaller
    id; windows are judged on the input. Copies of a whole text are settled first: all but those
    with the least id lose all words, if they have ``width`` or more. Shorter, blank and null texts lose
    nothing. Rows that share an id are judged each by its own text, and take no part in each other's windows; rows with
    a null id take no part at all and lose nothing. Empty tables give no rows. Other columns are not read.
    """
    ship_package(docs.sparkSession)
    text = docs[text_col].cast("string")
    rows = docs.select(docs[id_col].alias("_id"), F.xxhash64(text).alias("_key"), text.alias("_text"))
    real = rows.where("_id is not null and _text is not null")
    texts = real.select("_id", "_key", F.unhex(F.md5("_text")).alias("d"))
    firsts = texts.groupBy("d").agg(F.min("_id").alias("lo"), F.max("_id").alias("hi")).where("lo < hi").select("d", "lo")
    copies = materialize(texts.join(firsts, "d").where("lo < _id").select(F.col("_id").alias("_copy"), F.col("_key").alias("_copy_key")).distinct())
    copies = maybe_broadcast(copies)
    is_copy = (F.col("_id") == F.col("_copy")) & (F.col("_key") == F.col("_copy_key"))
    single = real.join(copies, is_copy, "left_anti")
    later = repeated_windows(single, width, start).select("_of", "_of_key", F.flatten(F.transform(F.filter("windows", lambda w: w["later"]), lambda w: w["places"])).alias("places")).where(F.size("places") > 0)
    flags = materialize(later)
    id_type = rows.schema["_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            totals, removed, kept = [], [], []
            for text, places, whole in zip(batch.column(1), batch.column(2), batch.column(3)):
                words = split_words(text.as_py(), fold=False)
                n = len(words)
                gone = np.zeros(n, bool)
                if whole.as_py():
                    gone[:] = n >= width
                elif places.is_valid:
                    ends = np.zeros(n + 1, np.int64)
                    at = places.values.to_numpy(zero_copy_only=False)
                    np.add.at(ends, at, 1)
                    np.add.at(ends, at + width, -1)
                    gone = np.cumsum(ends[:-1]) > 0
                totals.append(n)
                removed.append(int(gone.sum()))
                kept.append(b" ".join(w for w, x in zip(words, gone.tolist()) if not x).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(totals, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["_id", "n_words", "n_removed", "kept_text"])

    marked = rows.join(copies, is_copy, "left").select("_id", "_key", "_text", F.col("_copy").isNotNull().alias("whole"))
    flagged = (F.col("_id") == F.col("_of")) & (F.col("_key") == F.col("_of_key"))
    ids = flags.select("_of", "_of_key")
    if small_enough(ids):  # only texts that have flags are shuffled
        plain = marked.join(F.broadcast(ids), flagged, "left_anti").select("_id", "_text", F.lit(None).cast("array<int>").alias("places"), "whole")
        joined = with_found(marked, flags).select("_id", "_text", "places", "whole").unionByName(plain)
    else:
        joined = marked.join(flags, flagged, "left").select("_id", "_text", "places", "whole")
    return joined.mapInArrow(run, f"_id {id_type}, n_words long, n_removed long, kept_text string").withColumnRenamed("_id", id_col)


def longest_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", start: int = WIDTH) -> DataFrame:
    """(id, length): for each document the largest length start * 2**k of a window that another document has too.

    Each level looks only at documents that had a repeated window at the level before, until none is left:
    no window is longer than the second-longest text, so this ends.
    """
    ship_package(docs.sparkSession)
    text = docs[text_col].cast("string")
    rows = docs.select(docs[id_col].alias("_id"), F.xxhash64(text).alias("_key"), text.alias("_text")).where("_id is not null and _text is not null")
    width, found, first = start, None, START
    while True:
        alive = materialize(repeated_windows(rows, width, first).select("_of", "_of_key"))
        level = alive.select(F.col("_of").alias("_id"), F.lit(width).alias("length"))
        found = level if found is None else found.unionByName(level)
        if alive.isEmpty():
            break
        rows, first, width = with_found(rows, alive), width, 2 * width
    return found.groupBy(F.col("_id").alias(id_col)).agg(F.max("length").alias("length"))
