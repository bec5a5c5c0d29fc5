"""Media probe payloads (JSON text) to columns, parsed by the JVM JSON reader."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from drivetrove.functions import media

PROBE = """struct<format: struct<duration: string, bit_rate: string, tags: map<string, string>>,
    streams: array<struct<codec_type: string, codec_name: string, width: bigint, height: bigint,
    avg_frame_rate: string, r_frame_rate: string, tags: map<string, string>>>>"""


def _parsed(df: DataFrame, json_col: str) -> DataFrame:
    return df.withColumn("_p", F.from_json(json_col, PROBE))


def probe_video_meta(df: DataFrame, json_col: str = "json") -> DataFrame:
    """Duration, size, rate and codecs; payloads without a recognisable video stream are rejected."""
    parsed = _parsed(df, json_col)
    streams = F.coalesce("_p.streams", F.array())
    videos = F.filter(streams, lambda s: s["codec_type"] == "video")
    # the first stream with a codec ends the search; streams before it still count if none has one
    named = F.filter(videos, lambda s: s["codec_name"].isNotNull())
    video = F.coalesce(F.get(named, F.lit(0)), F.try_element_at(videos, F.lit(-1)))
    audio = F.get(F.filter(streams, lambda s: (s["codec_type"] == "audio") & s["codec_name"].isNotNull()), F.lit(0))
    average = media.frame_rate(video["avg_frame_rate"])
    fps = F.when(F.coalesce(average, F.lit(0.0)) != 0, average).otherwise(media.frame_rate(video["r_frame_rate"]))
    return parsed.withColumns({
        "duration_ms": F.coalesce((F.col("_p.format.duration").try_cast("double") * 1000).cast("bigint"), F.lit(0)),
        "bitrate": F.coalesce(F.col("_p.format.bit_rate").try_cast("bigint"), F.lit(0)),
        "width": F.coalesce(video["width"], F.lit(0)), "height": F.coalesce(video["height"], F.lit(0)),
        "fps": F.coalesce(fps, F.lit(0.0)), "vcodec": video["codec_name"], "acodec": audio["codec_name"],
    }).filter("width <> 0 OR vcodec IS NOT NULL").drop("_p", json_col)


def probe_location_meta(df: DataFrame, json_col: str = "json") -> DataFrame:
    """Position, camera and capture time: container tags first, then those of each stream."""
    parsed = _parsed(df, json_col)
    stream_tags = F.transform(F.coalesce("_p.streams", F.array()), lambda s: s["tags"])
    tags = F.filter(F.concat(F.array("_p.format.tags"), stream_tags), lambda t: t.isNotNull())

    def first(value) -> Column:
        return F.get(F.filter(F.transform(tags, value), lambda v: v.isNotNull()), F.lit(0))

    spot = first(lambda t: media.iso6709(media.tag_value(t, ["location", "iso6709", "gps"])))
    return parsed.withColumn("_spot", spot).withColumns({
        "gps_lat": F.col("_spot.lat"), "gps_lon": F.col("_spot.lon"),
        "camera_make": first(lambda t: media.tag_value(t, ["make", "manufacturer"])),
        "camera_model": first(lambda t: media.tag_value(t, ["model"])),
        "captured_at": first(lambda t: media.iso8601_unix(
            media.tag_value(t, ["creation_time", "creationdate", "date"]))),
    }).drop("_p", "_spot", json_col)
