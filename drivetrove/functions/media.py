"""Expressions over media probe output and imported timestamps."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Seconds from 1904-01-01 to 1970-01-01, and 1980-01-01 as the first credible date.
HFS_EPOCH_OFFSET = 2_082_844_800
FIRST_VALID_UNIX = 315_532_800


def hfs_to_unix(seconds: Column) -> Column:
    """Seconds since 1904 to unix seconds; 0 and dates before 1980 are unknown (NULL)."""
    unix = seconds.cast("bigint") - HFS_EPOCH_OFFSET
    return F.when((seconds != 0) & (unix >= FIRST_VALID_UNIX), unix)


def frame_rate(text: Column) -> Column:
    """``30000/1001`` or ``25`` as a number; 0 when unreadable."""
    parts = F.split(text, "/", 2)
    numerator = F.coalesce(F.get(parts, F.lit(0)).try_cast("double"), F.lit(0.0))
    denominator = F.get(parts, F.lit(1)).try_cast("double")
    ratio = F.try_divide(numerator, denominator)
    return F.when(F.size(parts) == 2, F.coalesce(ratio, F.lit(0.0))).otherwise(numerator)


def _iso6709_number(text: Column, index: int) -> Column:
    trimmed = F.regexp_replace(F.trim(text), r"/+\z", "")
    fields = F.regexp_extract_all(trimmed, F.lit(r"([+-][^+-]*)"), F.lit(1))
    return F.get(fields, F.lit(index)).try_cast("double")


def iso6709(text: Column) -> Column:
    """``+lat-lon+alt/`` as struct(lat, lon); NULL unless both are in range."""
    lat, lon = _iso6709_number(text, 0), _iso6709_number(text, 1)
    return F.when(lat.between(-90, 90) & lon.between(-180, 180), F.struct(lat.alias("lat"), lon.alias("lon")))


def civil_day(year: Column, month: Column, day: Column) -> Column:
    """Days since 1970 of a civil date; a day past the end of its month runs into the next one."""
    first = F.add_months(F.make_date(year, F.lit(1), F.lit(1)), month - 1)
    return F.datediff(first, F.lit("1970-01-01").cast("date")).cast("bigint") + day - 1


def iso8601_unix(text: Column) -> Column:
    """``YYYY-MM-DDThh:mm[:ss]`` to unix seconds; fraction and zone are ignored, UTC is assumed."""
    shape = r"^(\d+)-(\d+)-(\d+)[T ](\d+):(\d+)(?::(\d+))?"
    part = [F.regexp_extract(F.trim(text), shape, i).try_cast("int") for i in range(1, 7)]
    unix = (civil_day(part[0], part[1], part[2]) * 86400
            + part[3] * 3600 + part[4] * 60 + F.coalesce(part[5], F.lit(0)))
    return F.when(part[1].between(1, 12) & part[2].between(1, 31), unix)


def civil_unix(year: Column, month: Column, day: Column, hour: Column, minute: Column, second: Column) -> Column:
    """Civil UTC time to unix seconds; NULL before 1970 or for an impossible date."""
    unix = civil_day(year, month, day) * 86400 + hour * 3600 + minute * 60 + second
    return F.when((year >= 1970) & month.between(1, 12) & day.between(1, 31), unix)


def tag_value(tags: Column, needles: list[str]) -> Column:
    """First non-empty value of a tag map whose key contains one of ``needles``."""
    wanted = F.map_filter(tags, lambda k, v: (v != "") & F.lower(k).rlike("|".join(needles)))
    return F.get(F.map_values(wanted), F.lit(0))


def strip_times(duration_ms: Column, frames: int) -> Column:
    """``frames`` seconds spread inside a clip, never its very start or end; [0.0] if empty."""
    if frames <= 0:
        return F.array(F.lit(0.0))
    seconds = duration_ms / F.lit(1000.0)
    spread = F.transform(F.sequence(F.lit(1), F.lit(frames)), lambda i: seconds * i.cast("double") / F.lit(frames + 1.0))
    return F.when(duration_ms > 0, spread).otherwise(F.array(F.lit(0.0)))


def place_text(*parts: Column) -> Column:
    """Non-empty parts joined by a comma; NULL when none is left."""
    return F.nullif(F.concat_ws(", ", *[F.nullif(p, F.lit("")) for p in parts]), F.lit(""))
