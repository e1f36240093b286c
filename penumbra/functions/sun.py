"""Position of the sun and length of shadows, by the published low-precision formulas."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import lit

#: Lowest altitude that counts as day (radians), longest shadow (metres), time slot (milliseconds).
UP, LONGEST_M, SLOT_MS = 0.02, 200.0, 900_000
_RAD = math.pi / 180


def sun_state(epoch_ms: Column, lat: float, lon: float) -> Column:
    """Struct of altitude, azimuth, up, dx, dy, length_per_metre (null when the sun is down)."""
    d = epoch_ms / lit(86400000.0) - lit(0.5) + lit(2440588.0) - lit(2451545.0)
    m = lit(_RAD) * (lit(357.5291) + lit(0.98560028) * d)
    c = lit(_RAD) * (lit(1.9148) * F.sin(m) + lit(0.02) * F.sin(2 * m) + lit(0.0003) * F.sin(3 * m))
    ecliptic = m + c + lit(_RAD * 102.9372) + lit(math.pi)
    tilt = _RAD * 23.4397
    declination = F.asin(lit(math.sin(tilt)) * F.sin(ecliptic))
    ascension = F.atan2(F.sin(ecliptic) * lit(math.cos(tilt)), F.cos(ecliptic))
    hour = lit(_RAD) * (lit(280.16) + lit(360.9856235) * d) - lit(-_RAD * lon) - ascension
    phi = _RAD * lat
    azimuth = F.atan2(F.sin(hour), F.cos(hour) * lit(math.sin(phi)) - F.tan(declination) * lit(math.cos(phi)))
    altitude = F.asin(lit(math.sin(phi)) * F.sin(declination) + lit(math.cos(phi)) * F.cos(declination) * F.cos(hour))
    up = altitude > UP
    return F.struct(altitude.alias("altitude"), azimuth.alias("azimuth"), up.alias("up"), F.sin(azimuth).alias("dx"), F.cos(azimuth).alias("dy"), F.when(up, 1 / F.tan(altitude)).alias("length_per_metre"))


def shadow_length(height: Column, length_per_metre: Column) -> Column:
    """Metres, at most LONGEST_M; a sun that is down gives the longest."""
    return F.coalesce(F.least(height * length_per_metre, lit(LONGEST_M)), lit(LONGEST_M))


def time_slot(epoch_ms: Column) -> Column:
    return F.floor(epoch_ms / SLOT_MS).cast("long")
