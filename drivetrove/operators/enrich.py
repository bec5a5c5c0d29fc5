"""Location and daylight enrichment."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from drivetrove.functions import media, solar, words
from drivetrove.session import materialize, skew_join

#: Cube sides on the unit sphere grow by this factor until one reaches every point.
COARSENING = 4.0


def _unit_vector(df: DataFrame) -> DataFrame:
    lat, lon = F.radians("lat"), F.radians("lon")
    return df.withColumns({"_x": F.cos(lat) * F.cos(lon), "_y": F.cos(lat) * F.sin(lon), "_z": F.sin(lat)})


def _cell(side: float, shift: tuple[int, int, int] = (0, 0, 0)) -> list[Column]:
    return [(F.floor(F.col(axis) / F.lit(side)) + by).alias(f"_c{axis}")
            for axis, by in zip(("_x", "_y", "_z"), shift)]


_CELL = ["_c_x", "_c_y", "_c_z"]


def _first_side(places: int) -> float:
    """Cube side at which a cube holds a few places on average."""
    return min(max(1.5 * math.sqrt(4 * math.pi / max(places, 1)), 1e-4), 2.0)


def nearest_place(points: DataFrame, gazetteer: DataFrame, cell: float | None = None) -> DataFrame:
    """Nearest ``gazetteer(place_id, lat, lon, place)`` row of every distinct ``points(lat, lon)``.

    Points and places are cut into cubes on the unit sphere, so poles and the date line need no special
    case. A place within one cube side always lies in a neighbouring cube: such an answer is exact.
    Points left over try cubes four times as large, until one covers the globe. Places are repeated over
    the 27 neighbours, not the far more numerous points, and copies of a coordinate are looked up once.
    """
    on_globe = F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180)
    left = materialize(_unit_vector(points.select("lat", "lon").filter(on_globe).distinct()), "points")
    places = materialize(_unit_vector(gazetteer.filter(on_globe)), "places")
    shifts = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]
    known = places.count()
    solved, side = None, cell or _first_side(known)
    while True:
        spread = places.select("place_id", "place", "_x", "_y", "_z", F.explode(F.array(*[
            F.struct(*_cell(side, s)) for s in shifts])).alias("_c")).select(
                "place_id", "place", F.col("_x").alias("_px"), F.col("_y").alias("_py"),
                F.col("_z").alias("_pz"), "_c.*")
        square = sum((F.col(a) - F.col(b)) * (F.col(a) - F.col(b))
                     for a, b in (("_x", "_px"), ("_y", "_py"), ("_z", "_pz")))
        # points without an answer stay in the result, so they need not be looked for again
        tried = materialize(skew_join(left.select("*", *_cell(side)), spread, _CELL, "left", spread=F.struct("lat", "lon"), rows=known * len(shifts))
                            .withColumn("_d", square).groupBy("lat", "lon", "_x", "_y", "_z").agg(
                                F.min(F.when(F.col("_d").isNotNull(), F.struct("_d", "place_id", "place"))).alias("b")), "nearest")
        near = F.coalesce(F.col("b._d") <= side * side, F.lit(False)) if side < 2.0 else F.col("b").isNotNull()
        found = tried.filter(near).select("lat", "lon", F.col("b.place_id").alias("place_id"), F.col("b.place").alias("place"))
        solved = found if solved is None else solved.unionByName(found)
        if side >= 2.0:
            return solved
        left = tried.filter(~near).drop("b")
        if left.isEmpty():
            return solved
        side = min(side * COARSENING, 2.0)


def with_place(df: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """Add ``gps_place`` for ``gps_lat``/``gps_lon``; out-of-range coordinates stay NULL."""
    known = nearest_place(df.select(F.col("gps_lat").alias("lat"), F.col("gps_lon").alias("lon")), gazetteer).select(
        F.col("lat").alias("gps_lat"), F.col("lon").alias("gps_lon"), F.col("place").alias("gps_place"))
    return skew_join(df.drop("gps_place"), known, ["gps_lat", "gps_lon"], "left", spread=F.xxhash64(*sorted(df.columns)))


def with_light(df: DataFrame) -> DataFrame:
    return df.withColumn("light_phase", solar.light_phase(F.col("gps_lat"), F.col("gps_lon"), F.col("captured_at")))


def location_candidates(entries: DataFrame) -> DataFrame:
    """Files whose extension may carry a position."""
    return entries.filter((~F.col("is_folder")) & F.lower("ext").isin(words.LOCATION_EXTS))


def enrich_location(entries: DataFrame, probes: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """Position, place, camera, capture time and light of every probed clip."""
    from drivetrove.sources.probes import probe_location_meta

    clips = location_candidates(entries).select("id")
    # stored, as places are looked up for their points before rows pick them up
    meta = materialize(probe_location_meta(probes.withColumnRenamed("entry_id", "id").join(clips, "id", "left_semi")), "located")
    return with_light(with_place(meta, gazetteer))


def light_histogram(entries: DataFrame) -> DataFrame:
    """Files and bytes per light phase."""
    return entries.filter("light_phase IS NOT NULL").groupBy("light_phase").agg(
        F.count(F.lit(1)).alias("count"), F.sum("size_logical").alias("bytes"))


def with_media_class(df: DataFrame) -> DataFrame:
    return df.withColumn("media_class", words.media_class(F.col("ext"))).withColumn(
        "may_have_location", F.coalesce(F.lower("ext").isin(words.LOCATION_EXTS), F.lit(False)))


def place_label(name: Column, admin: Column, country: Column) -> Column:
    return media.place_text(name, admin, country)
