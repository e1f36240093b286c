"""Map tags: what may be walked, in which direction, and what kind of place something is."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tag values of the map's conventions.
WALKABLE = ["footway", "pedestrian", "path", "steps", "living_street", "residential", "service", "corridor", "track", "unclassified"]
CONDITIONAL = ["tertiary", "tertiary_link", "secondary", "secondary_link", "primary", "primary_link"]
PUBLIC = ["yes", "designated", "permissive"]
BOTH_WAYS, ONWARD, BACK = ["no", "0", "false"], ["yes", "1", "true"], ["-1", "reverse"]
HARD_TRAILS = ["demanding_mountain_hiking", "alpine_hiking", "demanding_alpine_hiking", "difficult_alpine_hiking"]
SIDEWALKS = ["sidewalk", "sidewalk:left", "sidewalk:right", "sidewalk:both"]
FOOD = ["bar", "fast_food", "food_court", "ice_cream", "pub", "restaurant"]
MEDICAL = ["clinic", "dentist", "doctors", "hospital", "pharmacy"]
EDUCATION = ["college", "kindergarten", "language_school", "library", "school", "university"]
TRANSIT = ["halt", "station", "subway_entrance"]
SIGHTS = ["place_of_worship", "theatre", "cinema"]
#: Bits of a way's flags.
COVERED_BIT, STEPS_BIT, FALLBACK_BIT = 1, 2, 4


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def raw(tags: Column, key: str) -> Column:
    return F.try_element_at(tags, F.lit(key))


def tidy(tags: Column, key: str) -> Column:
    return F.lower(F.trim(raw(tags, key)))


def is_in(value: Column, allowed: list[str]) -> Column:
    """Membership in which a missing value is no member."""
    return F.coalesce(value.isin(allowed), F.lit(False))


def equals(value: Column, wanted: str) -> Column:
    return F.coalesce(value == wanted, F.lit(False))


def supported(tags: Column) -> Column:
    return is_in(tidy(tags, "highway"), WALKABLE + CONDITIONAL)


def pedestrian_space(tags: Column) -> Column:
    sides = [tidy(tags, k) for k in SIDEWALKS]
    return is_in(tidy(tags, "foot"), PUBLIC) | any_of([s.isNotNull() & ~is_in(s, ["no", "none", "separate"]) for s in sides])


def direction(tags: Column) -> Column:
    """both, forward or backward; null where no way of walking is left."""
    onward, back = tidy(tags, "foot:forward"), tidy(tags, "foot:backward")
    no_onward, no_back = onward.isNotNull() & ~is_in(onward, PUBLIC), back.isNotNull() & ~is_in(back, PUBLIC)
    by_foot = F.when(no_onward & no_back, "none").when(no_back, "forward").when(no_onward, "backward").otherwise("both")
    one = tidy(tags, "oneway:foot")
    by_oneway = F.when(one.isNull() | is_in(one, BOTH_WAYS), "both").when(is_in(one, ONWARD), "forward").when(is_in(one, BACK), "backward").otherwise("none")
    belt = tidy(tags, "conveying")
    by_belt = F.when(belt.isNull() | (belt == "no"), "both").when(belt.isin("forward", "backward"), belt).otherwise("none")
    wishes = F.array_distinct(F.filter(F.array(by_foot, by_oneway, by_belt), lambda d: d != "both"))
    return F.when(F.size(wishes) == 0, "both").when((F.size(wishes) == 1) & (F.get(wishes, F.lit(0)) != "none"), F.get(wishes, F.lit(0)))


def _public(tags: Column) -> Column:
    foot, access = tidy(tags, "foot"), tidy(tags, "access")
    return F.when(foot.isNotNull(), is_in(foot, PUBLIC)).otherwise(access.isNull() | is_in(access, PUBLIC))


def _time_bound(tags: Column) -> Column:
    return raw(tags, "access:conditional").isNotNull() | raw(tags, "foot:conditional").isNotNull()


def walkable(tags: Column) -> Column:
    closed = any_of([equals(tidy(tags, k), "yes") for k in ("motorroad", "disused", "abandoned")])
    hard = is_in(tidy(tags, "sac_scale"), HARD_TRAILS)
    no_side = any_of([is_in(tidy(tags, k), ["no", "none", "separate"]) for k in SIDEWALKS])
    bare_road = is_in(tidy(tags, "highway"), CONDITIONAL) & ~pedestrian_space(tags) & no_side
    return supported(tags) & ~closed & ~hard & ~_time_bound(tags) & _public(tags) & ~bare_road & direction(tags).isNotNull()


def fallback(tags: Column) -> Column:
    separate = any_of([equals(tidy(tags, k), "separate") for k in SIDEWALKS])
    bare_road = is_in(tidy(tags, "highway"), CONDITIONAL) & ~pedestrian_space(tags)
    return equals(tidy(tags, "sac_scale"), "mountain_hiking") | (supported(tags) & (separate | bare_road))


def blocked(tags: Column) -> Column:
    """Of a node: locked, open at times only, or not open to people on foot."""
    return equals(tidy(tags, "locked"), "yes") | _time_bound(tags) | ~_public(tags)


def covered(tags: Column) -> Column:
    """On the values as written, without folding their case."""
    tunnel = raw(tags, "tunnel")
    return equals(raw(tags, "covered"), "yes") | (tunnel.isNotNull() & (tunnel != "no")) | equals(raw(tags, "indoor"), "yes") | equals(raw(tags, "highway"), "corridor")


def flags(tags: Column) -> Column:
    bit = lambda c, b: F.when(c, b).otherwise(0)
    return bit(covered(tags), COVERED_BIT) + bit(equals(raw(tags, "highway"), "steps"), STEPS_BIT) + bit(fallback(tags), FALLBACK_BIT)


def number_prefix(text: Column) -> Column:
    """The number that a text starts with, or null: "12.5ft" is 12.5."""
    return F.nullif(F.regexp_extract(F.trim(text), r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?", 0), F.lit("")).try_cast("double")


def positive(text: Column, most: float) -> Column:
    """A positive number up to ``most``, a trailing m aside, to two places; otherwise null."""
    value = number_prefix(F.regexp_replace(text, "(?i)m$", ""))
    return F.when((value > 0) & (value <= most), F.floor(value * 100 + 0.5) / 100)


#: Metres of a storey, and of a building of unknown height.
STOREY_M, UNKNOWN_M = 3.3, 12.0


def measured_height(tags: Column) -> Column:
    """Height from the tags alone; an empty height tag hides building:height and gives none."""
    text = F.coalesce(raw(tags, "height"), raw(tags, "building:height"))
    value = number_prefix(F.regexp_replace(text, "(?i)m$", ""))
    return F.when(value > 0, value)


def building_height(tags: Column) -> Column:
    """Struct of height in metres, whether it is estimated, and whether it is missing."""
    real = measured_height(tags)
    levels = number_prefix(raw(tags, "building:levels"))
    by_levels = F.when(levels > 0, levels * STOREY_M)
    return F.struct(F.coalesce(real, by_levels, F.lit(UNKNOWN_M)).alias("height"), real.isNull().alias("estimated"), F.coalesce(real, by_levels).isNull().alias("missing"))


def clean(text: Column) -> Column:
    """White space runs become one space; an empty text becomes null."""
    return F.nullif(F.trim(F.regexp_replace(text, r"\s+", " ")), F.lit(""))


def address(tags: Column) -> Column:
    parts = F.array(clean(raw(tags, "addr:city")), clean(raw(tags, "addr:district")), clean(F.coalesce(raw(tags, "addr:street"), raw(tags, "addr:place"))), clean(raw(tags, "addr:housenumber")))
    joined = F.array_join(F.array_distinct(F.array_compact(parts)), " ")
    return F.coalesce(clean(raw(tags, "addr:full")), F.nullif(joined, F.lit("")))


def place_kind(tags: Column) -> Column:
    """The first of eleven kinds that fits; null without a name and an address, or where none fits."""
    named = clean(F.coalesce(raw(tags, "name:ko"), raw(tags, "name"))).isNotNull()
    located = address(tags).isNotNull()
    has = lambda k: raw(tags, k).isNotNull()
    amenity = raw(tags, "amenity")
    return (
        F.when(~named & ~located, None)
        .when(is_in(raw(tags, "railway"), TRANSIT) | equals(raw(tags, "public_transport"), "station"), "station")
        .when(equals(amenity, "cafe"), "cafe").when(is_in(amenity, FOOD), "food")
        .when(is_in(amenity, MEDICAL) | has("healthcare"), "medical").when(is_in(amenity, EDUCATION), "education")
        .when(has("shop"), "store").when(has("office"), "office").when(is_in(raw(tags, "leisure"), ["park", "garden"]), "park")
        .when(has("tourism") | has("historic") | is_in(amenity, SIGHTS), "landmark").when(has("building") & named, "building").when(located, "address")
    )
