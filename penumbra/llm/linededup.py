"""Line dedup over content-defined chunks of lines, in DataFrame operations only.

A rolling hash over the hashes of two neighbouring lines chooses chunks of two lines: those where it is the least of some three
neighbouring values. The choice depends on nothing else, so it doesn't shift when lines are inserted elsewhere, and a
passage of four lines or more has a chunk that is chosen wherever it stands. Chunks that occur again are anchors: from each to
its first place (smallest document id, then first in it) the texts are compared line by line to both sides, as far as
they agree. What agrees, two lines or more, is removed after its bytes were compared; the first place keeps it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_skewed, let, materialize, with_found

#: The rolling hash is taken modulo this prime.
PRIME = 1_000_003


def line_hash(line: Column) -> Column:
    """First 60 bits of the line's MD5, as a number."""
    return F.conv(F.substring(F.md5(line), 1, 15), 16, 10).cast("long")


def line_hashes(text: Column) -> Column:
    return F.transform(F.split(text, "\n"), line_hash)


def chunks_of(hashes: Column) -> Column:
    """First lines of the chosen chunks, from 0, by the hashes of a text's lines; texts of two or three lines have them all.

    The rolling hash at line i is (hash(i) + 31 * hash(i + 1)) mod PRIME, of both hashes' remainders.
    """

    def chosen(rolled):
        at = lambda i, d: F.get(rolled, i + d)
        least = lambda i, a, b: F.coalesce((at(i, 0) <= at(i, a)) & (at(i, 0) <= at(i, b)), F.lit(False))
        return F.filter(F.sequence(F.lit(0), F.size(rolled) - 1), lambda i: (F.size(rolled) < 3) | least(i, -1, -2) | least(i, -1, 1) | least(i, 1, 2))

    nothing = F.array().cast("array<int>")
    pairs = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - 2), lambda i: (F.get(h, i) % PRIME + 31 * (F.get(h, i + 1) % PRIME)) % PRIME)
    return F.when(F.size(hashes) >= 2, let(pairs(hashes), chosen)).otherwise(nothing)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = docs[text_col].cast("string")
    return docs.select(docs[id_col].alias("_id"), F.xxhash64(text).alias("_key"), text.alias("_text"))


def _agreeing(lines: Column, first: Column, shift: Column) -> Column:
    """Runs (start, lines) of two lines or more that agree with the first text's lines ``shift`` before."""
    same = lambda i: F.coalesce(F.get(lines, i) == F.when(i >= shift, F.get(first, i - shift)), F.lit(False))
    every = F.sequence(F.lit(0), F.size(lines) - 1)
    starts = F.filter(every, lambda i: same(i) & same(i + 1) & ~same(i - 1))
    ends = F.filter(every, lambda i: same(i) & same(i - 1) & ~same(i + 1))
    return F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("start"), (b - a + 1).alias("lines")))


def _with_texts(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """The spans (_of, _of_key, start, lines, ...) with their text."""
    rest = [c for c in spans.columns if c not in ("_of", "_of_key")]
    wanted = materialize(spans.groupBy("_of", "_of_key").agg(F.collect_set(F.struct(*rest)).alias("s")))
    fetched = with_found(rows, wanted).select("_id", "_key", F.split("_text", "\n").alias("l"), F.explode("s").alias("s"))
    return fetched.select("_id", "_key", "s.*", F.array_join(F.slice("l", F.col("s.start") + 1, F.col("s.lines")), "\n").alias("text"))


def repeated_lines(rows: DataFrame) -> DataFrame:
    """(_of, _of_key, gone) for (_id, _key, _text) rows: spans (start, lines) that an earlier place has too.

    Only hashes of lines are shuffled to find spans, and texts only of the spans that are found.
    """
    hashes = materialize(rows.where(F.contains("_text", F.lit("\n"))).select("_id", "_key", line_hashes(F.col("_text")).alias("h")).distinct())
    pair = F.xxhash64(F.get("h", F.col("i")), F.get("h", F.col("i") + 1))
    anchors = materialize(hashes.select("_id", "_key", "h", F.explode(chunks_of(F.col("h"))).alias("i")).select("_id", "_key", "i", pair.alias("pair")))  # read twice
    firsts = materialize(anchors.groupBy("pair").agg(F.min(F.struct("_id", "_key", "i")).alias("first"), F.count("*").alias("n")).where("n > 1"))
    later = join_skewed(anchors, firsts, ["pair"]).where(~F.struct("_id", "_key", "i").eqNullSafe(F.col("first")))
    source = F.xxhash64("first._id", "first._key").alias("source")
    ways = materialize(later.select("_id", "_key", F.col("first._id").alias("_first"), F.col("first._key").alias("_first_key"), source, (F.col("i") - F.col("first.i")).alias("shift")).distinct())
    of = lambda t, a, b: t[a].eqNullSafe(F.col("_i")) & (t[b] == F.col("_k"))
    named = hashes.select(F.col("_id").alias("_i"), F.col("_key").alias("_k"), "h")
    sources = ways.groupBy("_first", "_first_key", "source").agg(F.count("*").alias("n"))
    sources = sources.join(named.withColumnRenamed("h", "first_h"), of(sources, "_first", "_first_key")).select("source", F.col("_i").alias("_source_id"), "first_h", "n")
    mine = ways.join(named, of(ways, "_id", "_key")).drop("_i", "_k")
    both = join_skewed(mine, materialize(sources), ["source"]).where(F.col("_first").eqNullSafe(F.col("_source_id")))
    runs = both.select("_id", "_key", "_first", "_first_key", "shift", F.explode(_agreeing(F.col("h"), F.col("first_h"), F.col("shift"))).alias("s"))
    spans = runs.select("_id", "_key", "_first", "_first_key", "s.start", "s.lines", (F.col("s.start") - F.col("shift")).alias("at"))
    spans = materialize(spans.withColumn("claim", F.xxhash64("_first", "_first_key", "at", "lines")))
    claims = spans.groupBy(F.col("_first").alias("_of"), F.col("_first_key").alias("_of_key"), F.col("at").alias("start"), "lines", "claim").agg(F.count("*").alias("n"))
    theirs = materialize(_with_texts(rows, claims).select("claim", "text", "n").distinct())
    asked = _with_texts(rows, spans.select(F.col("_id").alias("_of"), F.col("_key").alias("_of_key"), "start", "lines", "claim"))
    equal = join_skewed(asked, theirs, ["claim", "text"], size=F.octet_length("text"))  # of equal bytes
    return equal.groupBy(F.col("_id").alias("_of"), F.col("_key").alias("_of_key")).agg(F.collect_set(F.struct("start", "lines")).alias("gone"))


def _kept_lines(lines: Column, gone: Column) -> Column:
    """The lines outside of all spans; places are compared as sets, so the work grows with the text only."""
    out = F.flatten(F.transform(gone, lambda g: F.sequence(g["start"], g["start"] + g["lines"] - 1)))
    return let(lines, lambda a: F.transform(F.array_except(F.sequence(F.lit(0), F.size(a) - 1), out), lambda i: F.get(a, i)))


def _marked(rows: DataFrame) -> DataFrame:
    gone = repeated_lines(rows.select("_id", "_key", "_text"))
    return rows.join(gone, rows["_id"].eqNullSafe(gone["_of"]) & (rows["_key"] == gone["_of_key"]), "left")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document row with what is left of its text.

    Adds n_lines, n_chunks (chosen ones), n_removed (lines) and kept_text to the id. A null text stays null and
    has no lines; an empty one is one empty line. Rows are told apart by id and text: repeats of one row are
    one place, another text under the same id is a place of its own, and null ids come first. Empty tables give no
    rows. Other columns are not read.
    """
    lines = F.split("_text", "\n")
    kept = F.when(F.col("gone").isNull(), lines).otherwise(_kept_lines(lines, F.col("gone")))
    chunks = let(line_hashes(F.col("_text")), lambda h: F.size(chunks_of(h)))
    out = _marked(_rows(docs, id_col, text_col)).select("_id", F.size(lines).alias("n"), chunks.alias("c"), kept.alias("k"))
    count = lambda c: F.coalesce(F.when(F.col("k").isNotNull(), c), F.lit(0)).cast("long")
    return out.select(F.col("_id").alias(id_col), count(F.col("n")).alias("n_lines"), count(F.col("c")).alias("n_chunks"), count(F.col("n") - F.size("k")).alias("n_removed"), F.array_join("k", "\n").alias("kept_text"))


def without_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", drop_emptied: bool = False) -> DataFrame:
    """The documents with their columns and shortened texts; n_chars, where there is one, is counted again.

    Nulls, empty texts, repeated rows and ids as in line_dedup. A text of which no word is left stays as what it is then,
    or its row goes with ``drop_emptied``; rows that lose nothing always stay.
    """
    gone = repeated_lines(_rows(docs, id_col, text_col)).withColumnsRenamed({"_of": "_penumbra_of", "_of_key": "_penumbra_key", "gone": "_penumbra_gone"})
    text = docs[text_col].cast("string")
    marked = docs.join(gone, docs[id_col].eqNullSafe(gone["_penumbra_of"]) & (F.xxhash64(text) == gone["_penumbra_key"]), "left")
    short = F.when(F.col("_penumbra_gone").isNull(), text).otherwise(F.array_join(_kept_lines(F.split(text, "\n"), F.col("_penumbra_gone")), "\n"))
    out = marked.withColumn("_penumbra_text", short)
    if drop_emptied:
        out = out.where(F.col("_penumbra_gone").isNull() | F.rlike("_penumbra_text", F.lit(r"[^\x20\x09-\x0D]")))
    columns = [F.col("_penumbra_text").alias(c) if c == text_col else F.length("_penumbra_text").cast("long").alias(c) if c == "n_chars" else docs[f"`{c}`"] for c in docs.columns]
    return out.select(*columns)
