"""Labels and advice: minutes, distances, comparison of routes, weather."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import half_up

#: Weights of sun exposure and labels of the three modes.
MODES = {"shortest": (0.0, "빠른길"), "balanced": (1.0, "균형"), "maxShade": (3.0, "그늘우선")}
#: Reasons that failures are counted under.
FAILURE_REASONS = {"ALREADY_NEAR_GOAL": "near_goal", "ROUTE_TOO_LONG": "too_long", "OUTSIDE_SEOUL": "outside_seoul", "ROUTE_DATA_TOO_COMPLEX": "complex_data", "SNAP_FAILED": "off_network", "ROUTE_NOT_FOUND": "off_network"}


#: Fixed value: largest circle of accuracy on a map, in metres.
MOST_CIRCLE_M = 1000.0


def accuracy_circle(accuracy: Column) -> Column:
    return F.least(accuracy, F.lit(MOST_CIRCLE_M))


def walk_minutes(seconds: Column) -> Column:
    return F.greatest(F.lit(1), half_up(seconds / 60))


def sun_minutes(seconds: Column) -> Column:
    return F.greatest(F.lit(0), half_up(seconds / 60))


def _kilometres(metres: Column) -> Column:
    return F.concat(F.format_string("%.1f", F.floor(metres / 100 + 0.5) / 10.0), F.lit("km"))


def distance_label(metres: Column) -> Column:
    return F.when(metres >= 1000, _kilometres(metres)).otherwise(F.concat(half_up(metres).cast("string"), F.lit("m")))


def step_label(metres: Column) -> Column:
    """From a kilometre on in kilometres, else to the nearest ten metres, ten at least."""
    tens = F.greatest(F.lit(10), half_up(metres / 10) * 10)
    return F.when(metres >= 1000, _kilometres(metres)).otherwise(F.concat(tens.cast("string"), F.lit("m")))


def arrival_label(epoch_ms: Column, seconds: Column, zone: str = "Asia/Seoul") -> Column:
    """Time of arrival on a twelve-hour clock: "오후 2:05 도착"."""
    local = F.from_utc_timestamp(F.timestamp_millis((epoch_ms + seconds * 1000).cast("long")), zone)
    half = F.when(F.hour(local) < 12, "오전 ").otherwise("오후 ")
    return F.concat(half, ((F.hour(local) + 11) % 12 + 1).cast("string"), F.lit(":"), F.lpad(F.minute(local).cast("string"), 2, "0"), F.lit(" 도착"))


def exposure_label(exposed: Column, shade: Column) -> Column:
    return F.when(exposed == "connector", "접근 구간").when(exposed == "sun", "햇빛 구간").otherwise(F.concat(F.lit("예상 그늘 "), half_up(shade * 100).cast("string"), F.lit("%")))


def exposure(connector: Column, shade: Column) -> Column:
    return F.when(connector, "connector").when(shade >= 0.55, "shade").when(shade <= 0.35, "sun").otherwise("mixed")


def uv_risk(uv: Column) -> Column:
    return F.when(uv < 3, "low").when(uv < 6, "moderate").when(uv < 8, "high").when(uv < 11, "very-high").otherwise("extreme")


def weather_mode(is_day: Column, uv: Column, feels: Column) -> Column:
    return F.when(~is_day, "shortest").when((uv >= 6) | (feels >= 30), "maxShade").when((uv >= 3) | (feels >= 27), "balanced").otherwise("shortest")


def recommended_mode(offset_minutes: Column, weather: Column) -> Column:
    """Balanced for later departures and without weather; otherwise what the weather suggests."""
    return F.when((offset_minutes > 0) | weather.isNull(), "balanced").otherwise(weather)


def weather_symbol(code: Column, is_day: Column) -> Column:
    """A symbol by WMO weather code; nights have one of their own."""
    return F.when(~is_day, "☾").when(code >= 95, "⛈").when(code >= 51, "☔").when(code >= 2, "☁").otherwise("☀")


def failure_reason(code: Column) -> Column:
    reasons = F.create_map(*(F.lit(x) for kv in FAILURE_REASONS.items() for x in kv))
    return F.coalesce(F.try_element_at(reasons, code), F.lit("generic"))


def comparison(is_baseline: Column, time_s: Column, sun_s: Column, base_time_s: Column, base_sun_s: Column) -> Column:
    """Struct of kind, sun_min, extra_min, sun_saved_min, all on the minutes that are shown."""
    sun = sun_minutes(sun_s)
    saved = sun_minutes(base_sun_s) - sun
    kind = F.when(is_baseline, "baseline").when(saved <= 0, "no-saving").otherwise("saving")
    saving = kind == "saving"
    return F.struct(
        kind.alias("kind"), F.when(~saving, sun).alias("sun_min"),
        F.when(saving, F.greatest(F.lit(0), walk_minutes(time_s) - walk_minutes(base_time_s))).alias("extra_min"), F.when(saving, saved).alias("sun_saved_min"),
    )


# The sentences below and the labels of this module.
def comparison_sentence(label: Column, c: Column) -> Column:
    plain = F.concat(label, F.lit("의 예상 햇빛 노출은 "), c["sun_min"].cast("string"), F.lit("분이에요."))
    lead = F.when(c["extra_min"] == 0, F.lit("은 빠른길보다 더 걸리지 않고, ")).otherwise(F.concat(F.lit("은 빠른길보다 "), c["extra_min"].cast("string"), F.lit("분 더 걸리고, ")))
    saving = F.concat(label, lead, F.lit("예상 햇빛 노출은 "), c["sun_saved_min"].cast("string"), F.lit("분 적어요."))
    return F.when(c["kind"] == "saving", saving).otherwise(plain)
