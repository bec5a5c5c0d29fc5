"""Sun position and light phase as Column arithmetic (low-precision J2000 almanac formulas)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def _turn(angle: Column) -> Column:
    return F.pmod(angle, F.lit(360.0))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once a row, however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def sun_position(lat: Column, lon: Column, unix: Column) -> Column:
    """``height``, the elevation in degrees, and ``hour_angle`` in degrees (positive after solar noon)."""
    def position(days: Column, ecliptic: Column, tilt: Column) -> Column:
        declination = F.asin(F.sin(tilt) * F.sin(ecliptic))
        ascension = F.degrees(F.atan2(F.cos(tilt) * F.sin(ecliptic), F.cos(ecliptic)))
        sidereal = _turn(_turn(F.lit(280.46061837) + F.lit(360.98564736629) * days) + lon)
        hour_angle = _turn(sidereal - ascension + F.lit(180.0)) - F.lit(180.0)
        return _let(F.struct(declination.alias("declination"), hour_angle.alias("hour_angle")), above)

    def above(sun: Column) -> Column:
        here, declination, hour_angle = F.radians(lat), sun["declination"], sun["hour_angle"]
        height = F.sin(here) * F.sin(declination) + F.cos(here) * F.cos(declination) * F.cos(F.radians(hour_angle))
        return F.struct(F.degrees(F.asin(height)).alias("height"), hour_angle.alias("hour_angle"))

    def longitude(days: Column) -> Column:
        mean_longitude = _turn(F.lit(280.460) + F.lit(0.9856474) * days)
        anomaly = F.radians(_turn(F.lit(357.528) + F.lit(0.9856003) * days))
        ecliptic = _let(anomaly, lambda a: F.radians(mean_longitude + F.lit(1.915) * F.sin(a) + F.lit(0.020) * F.sin(a * 2)))
        tilt = F.radians(F.lit(23.439) - F.lit(0.0000004) * days)
        return _let(F.struct(ecliptic.alias("ecliptic"), tilt.alias("tilt")), lambda s: position(days, s["ecliptic"], s["tilt"]))

    return _let(unix / F.lit(86400.0) + F.lit(2440587.5) - F.lit(2451545.0), longitude)


def light_phase(lat: Column, lon: Column, unix: Column) -> Column:
    """Searchable words for the daylight at a place and time; NULL without valid coordinates."""
    phase = _let(sun_position(lat, lon, unix), lambda sun: _phase(sun["height"], sun["hour_angle"]))
    return F.when(lat.between(-90, 90) & lon.between(-180, 180) & unix.isNotNull(), phase)


def _phase(height: Column, hour_angle: Column) -> Column:
    side = F.when(hour_angle > 0, F.lit("dusk sunset")).otherwise(F.lit("dawn sunrise"))
    return (
        F.when(height >= 6, F.lit("day"))
        .when(height >= 0, F.concat(F.lit("golden "), side))
        .when(height >= -6, F.concat(F.lit("twilight bluehour "), side))
        .when(height >= -18, F.concat(F.lit("twilight "), side))
        .otherwise(F.lit("night"))
    )
