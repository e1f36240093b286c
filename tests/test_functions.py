"""Truth tables of the scalar layer."""

import pytest
from pyspark.sql import functions as F

from penumbra.functions import geo, rules, sun, tags


def one(spark, column):
    return spark.range(1).select(column.alias("c")).first().c


WAYS = [
    ({"highway": "pedestrian", "name": "Mill Lane"}, True, False, "both"),
    ({"highway": "steps", "incline": "up"}, True, False, "both"),
    ({"highway": "tertiary"}, True, True, "both"),
    ({"highway": "tertiary", "sidewalk": "right"}, True, False, "both"),
    ({"highway": "tertiary", "sidewalk": "separate"}, False, None, None),
    ({"highway": "trunk", "foot": "no"}, False, None, None),
    ({"building": "yes"}, False, None, None),
    ({"highway": "footway", "access": "no"}, False, None, None),
    ({"highway": "footway", "access": "no", "foot": "designated"}, True, None, "both"),
    ({"highway": "footway", "foot": "private"}, False, None, None),
    ({"highway": "path", "sac_scale": "hiking"}, True, None, "both"),
    ({"highway": "path", "sac_scale": "alpine_hiking"}, False, None, None),
    ({"highway": "living_street", "oneway": "-1"}, True, None, "both"),
    ({"highway": "pedestrian", "oneway:foot": "no"}, True, None, "both"),
    ({"highway": "pedestrian", "oneway:foot": "yes"}, True, None, "forward"),
    ({"highway": "pedestrian", "foot:backward": "no"}, True, None, "forward"),
    ({"highway": "pedestrian", "foot:forward": "no", "foot:backward": "no"}, False, None, "none"),
    ({"highway": "footway", "conveying": "backward"}, True, None, "backward"),
]


def test_ways(spark):
    rows = spark.createDataFrame([(k, t) for k, (t, *_) in enumerate(WAYS)], "k int, t map<string,string>")
    t = F.col("t")
    for r in rows.select("k", tags.walkable(t).alias("w"), tags.fallback(t).alias("f"), tags.direction(t).alias("d")).collect():
        _, walk, fall, way = WAYS[r.k]
        assert r.w == walk, WAYS[r.k]
        assert fall is None or r.f == fall, WAYS[r.k]
        assert way is None or (r.d or "none") == way, WAYS[r.k]


def test_blocked_nodes(spark):
    cases = [({"locked": "yes"}, True), ({"access": "private"}, True), ({"access": "private", "foot": "permissive"}, False), ({"barrier": "bollard"}, False)]
    rows = spark.createDataFrame([(t,) for t, _ in cases], "t map<string,string>")
    assert [r.b for r in rows.select(tags.blocked(F.col("t")).alias("b")).collect()] == [b for _, b in cases]


@pytest.mark.parametrize("before, after, kind", [
    (10, 24.9, "straight"), (10, 25, "slight-right"), (24, 9, "slight-left"), (350, 34.9, "slight-right"), (350, 35, "right"), (35, 350, "left"),
    (5, 164.9, "right"), (5, 165, "uturn-right"), (165, 5, "uturn-left"), (20, 200, "uturn-right")])
def test_turns(spark, before, after, kind):
    assert one(spark, geo.turn_kind(F.lit(float(before)), F.lit(float(after)))) == kind


@pytest.mark.parametrize("uv, risk", [(0, "low"), (2.99, "low"), (3.01, "moderate"), (5.99, "moderate"), (6.01, "high"), (7.99, "high"), (8.01, "very-high"), (10.99, "very-high"), (11.01, "extreme")])
def test_uv(spark, uv, risk):
    assert one(spark, rules.uv_risk(F.lit(float(uv)))) == risk


def test_weather(spark):
    assert one(spark, rules.weather_mode(F.lit(True), F.lit(8.2), F.lit(35.0))) == "maxShade"
    assert one(spark, rules.weather_mode(F.lit(False), F.lit(8.2), F.lit(35.0))) == "shortest"


def test_heights(spark):
    cases = [({"height": "12.5ft"}, 12.5, False), ({"height": "12 m"}, 12.0, False), ({"height": "", "building:height": "9", "building:levels": "2"}, 6.6, True), ({"building": "yes"}, 12.0, True), ({"building:levels": "3"}, 9.9, True)]
    rows = spark.createDataFrame([(t,) for t, _, _ in cases], "t map<string,string>").select(tags.building_height(F.col("t")).alias("h")).collect()
    assert [(round(r.h.height, 6), r.h.estimated) for r in rows] == [(h, e) for _, h, e in cases]


def test_sun(spark):
    s = one(spark, sun.sun_state(F.lit(1785906000000.0), geo.CENTRE_LAT, geo.CENTRE_LON))
    assert s.up and abs(s.azimuth - 0.81906779) < 1e-6 and abs(s.altitude - 1.09626994) < 1e-6 and abs(s.length_per_metre - 0.51367339) < 1e-6
    night = one(spark, sun.sun_state(F.lit(1783792800000.0), geo.CENTRE_LAT, geo.CENTRE_LON))
    assert not night.up and abs(night.altitude + 0.378) < 1e-2 and night.length_per_metre is None


def test_point_in_ring_without_division_error(spark):
    ring = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]))
    at = lambda x, y: one(spark, geo.in_ring(F.lit(x), F.lit(y), ring))
    assert at(2.0, 2.0) and at(2.0, 0.0) and not at(5.0, 2.0) and not at(2.0, 4.0)
