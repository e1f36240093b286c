"""Places: normal forms, removal of doubles, quotas and search."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tags
from ..functions.types import STRING, STRINGS
from ..session import bounded, keep

#: Separators in names and queries, longest query, most results.
SEPARATORS = r"[\s·.,()\-_/]+"
MOST_QUERY, MOST_RESULTS, DEFAULT_RESULTS = 100, 50, 8
#: Fixed value: most characters of a name or an alias.
MOST_NAME = 120
#: Labels of the kinds of places.
KIND_LABELS = {"station": "지하철역", "cafe": "카페", "food": "음식점", "medical": "병원·약국", "education": "학교·도서관", "store": "상점", "office": "회사", "park": "공원", "landmark": "명소", "building": "건물", "address": "주소"}
#: Fixed value: label of a place without a kind.
NO_KIND_LABEL = "장소"


@F.pandas_udf(STRING)
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


@F.pandas_udf(STRINGS)
def nfkc_all(texts: pd.Series) -> pd.Series:
    return texts.map(lambda ts: None if ts is None else [None if t is None else unicodedata.normalize("NFKC", t) for t in ts])


def as_it_is(text: Column) -> Column:
    """In place of nfkc for texts that are known to be ASCII."""
    return text


def plain_name(text: Column, compose=nfkc) -> Column:
    """For comparing names: compatibility form, lower case, no white space. ``compose`` may be as_it_is."""
    return F.lower(F.regexp_replace(compose(text), r"\s+", ""))


def _plain(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_replace(text, SEPARATORS, "")), "역$", "")


def plain_query(text: Column, compose=nfkc) -> Column:
    """For searching: also without separators and without a last 역."""
    return _plain(compose(text))


def query_tokens(text: Column, compose=nfkc) -> Column:
    return F.filter(F.split(F.lower(compose(text)), SEPARATORS), lambda t: t != "")


def nameless_station(kind: Column, name: Column) -> Column:
    """A station whose name has only digits, white space, dots and dashes."""
    return (kind == "station") & ~name.rlike(r"[^\d\s.\-]")


def place_from(elements: DataFrame) -> DataFrame:
    """Places (id, kind, name, aliases, address, lat, lon, seq) of tagged elements (type, id, tags, lat, lon, seq).

    The name is name:ko, else name, else the address; other names of 120 characters or fewer are aliases, each once.
    Elements of no kind, without a name or with too long a one, and stations without a real name give none.
    """
    t = F.col("tags")
    address = tags.address(t)
    name = F.coalesce(tags.raw(t, "name:ko"), tags.raw(t, "name"), address)
    others = F.array(*(tags.raw(t, k) for k in ("name", "name:en", "alt_name", "short_name", "brand")))
    shaped = elements.select("type", "id", "lat", "lon", "seq", tags.place_kind(t).alias("kind"), name.alias("n"), others.alias("o"), address.alias("a"))
    kept = shaped.where(F.col("kind").isNotNull() & (F.trim("n") != "") & (F.length("n") <= MOST_NAME) & ~nameless_station(F.col("kind"), F.col("n")))
    aliases = F.array_distinct(F.filter("o", lambda x: x.isNotNull() & (x != F.col("n")) & (F.length(x) <= MOST_NAME)))
    return kept.select(F.concat_ws("-", F.lit("osm"), "type", F.col("id").cast("string")).alias("id"), "kind", F.trim("n").alias("name"), aliases.alias("aliases"), F.nullif("a", F.col("n")).alias("address"), "lat", "lon", "seq")


def tidy_places(raw: DataFrame) -> DataFrame:
    """Names and aliases trimmed, empty aliases dropped, stations without a real name left out, first of each id kept (by seq)."""
    named = raw.withColumn("name", F.trim("name")).where((F.length("name") > 0) & (F.length("name") <= MOST_NAME))
    named = named.where(~nameless_station(F.col("kind"), F.col("name")))
    aliases = F.filter(F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.trim(a)), lambda a: a != "")
    first = F.row_number().over(Window.partitionBy("id").orderBy("seq"))
    return named.withColumn("aliases", aliases).withColumn("_k", first).where("_k = 1").drop("_k")


def kind_label(kind: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in KIND_LABELS.items() for x in kv)), kind), F.lit(NO_KIND_LABEL))


def description(kind: Column, address: Column) -> Column:
    """What a result shows below its name: its kind's label, and its address where it has one."""
    return F.concat_ws(" · ", kind_label(kind), F.nullif(address, F.lit("")))


#: Parts in which the places of a kind are ranked before the kind as a whole.
PARTS = 64


def without_doubles(places: DataFrame, name: Column) -> DataFrame:
    """One place for each normal name (stations) or normal name and position to four places; the first with an address comes first."""
    at = lambda c: F.round(F.col(c), 4).cast("string")
    key = F.when(F.col("kind") == "station", F.concat(F.lit("station:"), name)).otherwise(F.concat_ws(":", name, at("lat"), at("lon")))
    first = F.row_number().over(Window.partitionBy("_key").orderBy(F.col("address").isNull(), "seq"))
    return places.withColumn("_key", key).withColumn("_k", first).where("_k = 1").drop("_key", "_k")


def within_quotas(places: DataFrame, quotas: dict[str, int], most: int, order: list[Column]) -> DataFrame:
    """Up to its quota of each kind, then the rest in order until there are ``most``; rank counts from 1.

    Each kind is ranked in PARTS parts first, of which no more than can be chosen goes on to the window by kind, so a kind that holds
    most places isn't sorted by one task; and only places that could be among the first ``most`` go to the last sort.
    """
    limit = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in quotas.items() for x in kv)), F.col("kind")), F.lit(most))
    part = F.pmod(F.xxhash64("id"), F.lit(PARTS))
    could = places.withColumn("_in_part", F.row_number().over(Window.partitionBy("kind", part).orderBy(*order))).where(F.col("_in_part") <= limit + most).drop("_in_part")
    ranked = could.withColumn("in_kind", F.row_number().over(Window.partitionBy("kind").orderBy(*order)))
    chosen = ranked.withColumn("overflow", F.col("in_kind") > limit).where(F.col("in_kind") <= limit + most)
    return chosen.orderBy("overflow", *order).limit(most).drop("in_kind")


def match_score(name: Column, aliases: Column, address: Column, query: Column, tokens: Column) -> Column:
    """0 to 8, lower is better, null for no match: name, then the first alias that matches at all, then all words in one alias, then address."""

    def level(text, base):
        return F.when(text == query, base).when(F.startswith(text, query), base + 1).when(F.contains(text, query), base + 2)

    by_alias = F.get(F.filter(F.transform(aliases, lambda a: level(a, 3)), lambda s: s.isNotNull()), F.lit(0))
    all_words = (F.size(tokens) > 1) & F.exists(aliases, lambda a: F.forall(tokens, lambda t: F.contains(a, t)))
    return F.coalesce(level(name, 0), by_alias, F.when(all_words, 5), level(address, 6))


def grams(text: Column) -> Column:
    """Distinct pairs of neighbouring characters, and the single characters."""
    n = F.length(text)
    some = lambda size: F.when(n >= size, F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: F.substring(text, i, size))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(some(2), some(1)))


def _wanted_grams(text: Column) -> Column:
    """Those that whatever contains the text has too: its pairs, or its only character."""
    return F.filter(grams(text), lambda g: (F.length(g) == 2) | (F.length(text) == 1))


def korean(name: Column) -> Column:
    """Sort key of a name in Korean dictionary order."""
    return F.collate(name, "ko")


def by_codes(name: Column) -> Column:
    """Sort key in order of characters' codes, for builds of Spark without collations."""
    return name


def search(places: DataFrame, queries: DataFrame, k: int = DEFAULT_RESULTS, compose=nfkc, order=korean) -> DataFrame:
    """The best k places of each query (query_id, query): (query_id, rank, id, score), by score, name and id.

    A match contains the query, or in an alias all its words; a word that comes to nothing is in every alias. So places and
    queries meet on one pair of characters: of the query's pairs, and of those of all its words, the one that the fewest places have.
    Only these are scored, once for all queries of the same plain form. Plain forms are written once, as they are read several
    times. ``order`` gives the sort key of names.
    """
    compose_all = as_it_is if compose is as_it_is else nfkc_all
    asked = queries.where(F.length("query") <= MOST_QUERY).select("query_id", plain_query(F.col("query"), compose).alias("q"), F.transform(query_tokens(F.col("query"), compose), lambda t: F.regexp_replace(t, "역$", "")).alias("tokens")).where("q <> ''")
    asked = keep(asked)
    forms = keep(asked.select("q", "tokens").distinct().withColumn("form", F.monotonically_increasing_id()))
    askers = asked.join(forms, ["q", "tokens"]).select("query_id", "form")
    asked = forms.withColumnRenamed("form", "query_id")  # from here on a query is a form
    aliases = F.transform(compose_all(F.coalesce("aliases", F.array().cast("array<string>"))), _plain)
    shown = places.select("id", "name", plain_query(F.col("name"), compose).alias("n"), aliases.alias("al"), plain_query(F.col("address"), compose).alias("ad"))
    shown = keep(shown)
    texts = F.concat(F.array("n", F.coalesce("ad", F.lit(""))), "al")
    held = shown.select("id", F.explode(F.array_distinct(F.flatten(F.transform(texts, grams)))).alias("gram"))
    words = F.filter("tokens", lambda t: t != "")
    several = F.size("tokens") > 1
    looked = F.concat(F.array(F.struct(F.lit("whole").alias("way"), F.col("q").alias("text"))), F.when(several, F.transform(words, lambda t: F.struct(F.lit("words").alias("way"), t.alias("text")))).otherwise(F.array().cast("array<struct<way:string,text:string>>")))
    ways = asked.select("query_id", F.explode(looked).alias("l")).select("query_id", "l.way", F.explode(_wanted_grams(F.col("l.text"))).alias("gram")).distinct()
    counts = held.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = ways.join(counts, "gram", "left").groupBy("query_id", "way").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("gram"))).alias("g")).where("g.n > 0")
    lookups = rarest.select("query_id", F.col("g.gram").alias("gram")).distinct()
    candidates = held.join(bounded(lookups), "gram").select("query_id", "id").distinct()
    # Words that all come to nothing are in every alias: of places with one, the first in order of name stand for all of them.
    most = min(k, MOST_RESULTS)
    first_named = shown.where(F.size("al") > 0).orderBy(order(F.col("name")), "id").limit(most).select("id")
    empty = asked.where(several & (F.size(words) == 0)).select("query_id")
    candidates = candidates.unionByName(empty.withColumn("_one", F.lit(1)).join(F.broadcast(first_named.withColumn("_one", F.lit(1))), "_one").select("query_id", "id")).distinct()
    score = match_score(F.col("n"), F.col("al"), F.col("ad"), F.col("q"), F.col("tokens"))
    scored = candidates.join(asked, "query_id").join(shown, "id").withColumn("score", score).where("score is not null")
    best = Window.partitionBy("query_id").orderBy("score", order(F.col("name")), "id")
    found = scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most).select(F.col("query_id").alias("form"), "rank", "id", "score")
    return askers.join(found, "form").select("query_id", "rank", "id", "score")


def exact_choice(results: DataFrame, places: DataFrame, queries: DataFrame, compose=nfkc) -> DataFrame:
    """(query_id, id): the first result of each query whose name is the query, both in their plain forms."""
    named = results.join(places.select("id", plain_query(F.col("name"), compose).alias("n")), "id").join(queries.select("query_id", plain_query(F.col("query"), compose).alias("q")), "query_id")
    return named.where("n = q").groupBy("query_id").agg(F.min_by("id", "rank").alias("id"))
