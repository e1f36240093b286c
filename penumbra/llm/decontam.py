"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations only.

An item's windows (13 consecutive words, or the whole of a shorter item) are sets of short shingles
with places. All shingles of a window must occur for it to occur, so one shingle is a sufficient
prefix: the one that is rarest in the documents. A first pass over the documents only counts the
shingles, which orders them by rarity; the second one joins the prefixes alone. A candidate must leave
room for the window on both sides, and is verified on the exact words of its place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fold_case, materialize, maybe_broadcast, with_found, words_of

#: What separates words here is all ASCII but digits and letters.
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words in a shingle, or fewer in items that are shorter.
SHINGLE = 3
#: Words in a window.
WIDTH = 13


def item_words(text: Column) -> Column:
    return words_of(fold_case(F.coalesce(text.cast("string"), F.lit(""))), SEPARATOR)


def _shingle(k: int, words: list[Column]) -> Column:
    """Fingerprint of k words in order; equal ones are compared word by word later."""
    return F.xxhash64(F.lit(k), *words[:k])


def _runs(text: DataFrame, sizes: list[int]) -> DataFrame:
    """(_id, _key, len, pos, h) of every run of words of the wanted sizes, in one narrow pass."""
    longest = max(sizes)
    shifted = F.arrays_zip(*(F.slice("w", j + 1, 2**30) for j in range(longest)))
    at = text.select("_id", "_key", F.size("w").alias("len"), F.posexplode(shifted).alias("pos", "z"))
    h = [F.when(F.col("pos") + k <= F.col("len"), _shingle(k, [F.col(f"z.`{j}`") for j in range(k)])) for k in sizes]
    return at.select("_id", "_key", "len", "pos", h[0].alias("h") if len(h) == 1 else F.explode(F.array(*h)).alias("h"))


def _windows(benchmark: DataFrame, item_id: str, text_col: str, width: int) -> DataFrame:
    """Distinct windows with the items they come from: (window words, n, item)."""
    items = benchmark.select(benchmark[item_id].cast("string").alias("item"), item_words(benchmark[text_col]).alias("w")).where(F.size("w") > 0)
    return items.withColumn("n", F.least(F.size("w"), F.lit(width))).select("item", "n", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1), lambda i: F.slice("w", i, F.col("n")))).alias("win"))


def occurrences(docs: DataFrame, benchmark: DataFrame, id_col="doc_id", text_col="text", item_id="item_id", item_text="text", width=WIDTH, shingle=SHINGLE) -> tuple[DataFrame, DataFrame]:
    """Where the items' windows occur, (_id, _key, start, n, wid) each once, and the items of each window, (wid, item).

    Word places count from 0. _key is a hash of the document's text, which tells rows that share an id apart.
    """
    pairs = _windows(benchmark, item_id, item_text, width)
    windows = materialize(pairs.select("win", "n").distinct().withColumn("wid", F.monotonically_increasing_id()))
    owners = pairs.join(windows, ["win", "n"]).select("wid", "item").distinct()
    of = lambda k: F.transform(F.sequence(F.lit(0), F.size("win") - k), lambda i: _shingle(k, [F.get("win", i + j) for j in range(k)]))
    sizes = sorted({min(r.n, shingle) for r in windows.select("n").distinct().collect()})  # at most ``width`` rows
    whole = docs[text_col].cast("string")
    text = docs.select(docs[id_col].alias("_id"), F.xxhash64(whole).alias("_key"), item_words(whole).alias("w"))
    if not sizes:
        return text.select("_id", "_key", F.lit(0).alias("start"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("wid")).where(F.lit(False)), owners
    shingles = F.coalesce(*(F.when(F.least(F.col("n"), F.lit(shingle)) == k, of(k)) for k in sizes))
    parts = materialize(windows.select("wid", "n", F.posexplode(shingles).alias("offset", "h")))
    # First pass: how often each shingle of a window occurs in the documents.
    rarity = materialize(_runs(text, sizes).select("h").join(maybe_broadcast(parts.select("h").distinct()), "h").groupBy("h").agg(F.count("*").alias("df")))
    # The rarest shingle of each window is its prefix. If one doesn't occur at all, the window doesn't.
    ranked = parts.join(rarity, "h", "left").groupBy("wid", "n").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), F.col("h"), F.col("offset"))).alias("p"))
    prefixes = materialize(ranked.where("p.df > 0").select("wid", "n", F.col("p.h").alias("h"), F.col("p.offset").alias("offset")))
    # Second pass: the places of prefixes that leave room for their window.
    met = _runs(text, sizes).join(maybe_broadcast(prefixes), "h").withColumn("start", F.col("pos") - F.col("offset"))
    candidates = materialize(met.where((F.col("start") >= 0) & (F.col("start") + F.col("n") <= F.col("len"))).select("_id", "_key", "start", "n", "wid"))
    # The words of those places are fetched from the texts that have any, and compared.
    per_text = candidates.groupBy("_id", "_key").agg(F.collect_set(F.struct("start", "n", "wid")).alias("c")).withColumnsRenamed({"_id": "_of", "_key": "_of_key"})
    places = with_found(text, per_text).select("_id", "_key", "w", F.explode("c").alias("c")).select("_id", "_key", "c.*", F.slice("w", F.col("c.start") + 1, F.col("c.n")).alias("got"))
    table = windows.select("wid", "win")
    exact = places.join(maybe_broadcast(table, size=F.octet_length(F.array_join("win", " "))), "wid").where(F.col("got") == F.col("win"))
    return materialize(exact.select("_id", "_key", "start", "n", "wid")), owners


def contamination(docs: DataFrame, benchmark: DataFrame, id_col="doc_id", text_col="text", item_id="item_id", item_text="text", width=WIDTH, shingle=SHINGLE, share=20) -> DataFrame:
    """One row for each document row: words, words hit by items' windows, items, and the verdict.

    A document is contaminated if at least one word in ``share`` is hit. Null and blank texts have
    no words and aren't. Items without words are no windows; null item ids are left out of the list.
    Rows that share an id are judged each by its own text. Empty tables give no rows, or no hits. Other columns are not read.
    """
    return _judged(docs, benchmark, id_col, text_col, item_id, item_text, width, shingle, share).drop("_key")


def _judged(docs, benchmark, id_col="doc_id", text_col="text", item_id="item_id", item_text="text", width=WIDTH, shingle=SHINGLE, share=20) -> DataFrame:
    hits, owners = occurrences(docs, benchmark, id_col, text_col, item_id, item_text, width, shingle)
    places = Window.partitionBy("_id", "_key").orderBy("start", "n").rowsBetween(Window.unboundedPreceding, -1)
    spans = hits.select("_id", "_key", "start", "n").distinct().withColumn("reached", F.coalesce(F.max(F.col("start") + F.col("n")).over(places), F.lit(0)))
    covered = spans.groupBy("_id", "_key").agg(F.sum(F.greatest(F.lit(0), F.col("start") + F.col("n") - F.greatest("start", "reached"))).alias("n_hit"))
    found = hits.select("_id", "_key", "wid").distinct().join(maybe_broadcast(owners, size=F.octet_length("item")), "wid")
    items = found.groupBy("_id", "_key").agg(F.sort_array(F.collect_set("item")).alias("items"))
    both = covered["_id"].eqNullSafe(items["_id"]) & (covered["_key"] == items["_key"])
    per_doc = covered.join(items, both, "left").select(covered["_id"].alias("_hit"), covered["_key"].alias("_hit_key"), "n_hit", "items")
    whole = docs[text_col].cast("string")
    counted = docs.select(docs[id_col].alias("_id"), F.xxhash64(whole).alias("_key"), F.size(item_words(whole)).cast("long").alias("n_words"))
    joined = counted.join(per_doc, counted["_id"].eqNullSafe(per_doc["_hit"]) & (counted["_key"] == per_doc["_hit_key"]), "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    names = F.coalesce("items", F.array().cast("array<string>"))
    return joined.select(
        F.col("_id").alias(id_col), "_key", "n_words", n_hit.alias("n_hit"), F.size(names).cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col="doc_id", text_col="text", **kw) -> DataFrame:
    """The documents that aren't contaminated, with the columns they came with.

    A row goes by its id and its text: another text under the same id stays. Null and blank texts stay, as do rows with null ids
    unless their text is contaminated. Without documents there are no rows; without items all stay.
    """
    bad = _judged(docs, benchmark, id_col, text_col, **kw).where("contaminated").select(F.col(id_col).alias("_penumbra_bad"), F.col("_key").alias("_penumbra_key")).distinct()
    return docs.join(bad, docs[id_col].eqNullSafe(bad["_penumbra_bad"]) & (F.xxhash64(docs[text_col].cast("string")) == bad["_penumbra_key"]), "left_anti")
