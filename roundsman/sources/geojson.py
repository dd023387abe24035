"""GeoJSON features and the correction log as JSON text.

One feature per row: a text sink turns the rows into a GeoJSON sequence in parallel,
and no tour is ever gathered into a single document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _feature(kind: str, properties: Column, coordinates: Column) -> Column:
    geometry = F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), properties.alias("properties"), geometry.alias("geometry")))


def _point(lat: str = "lat", lon: str = "lon") -> Column:
    return F.array(F.col(lon), F.col(lat))


def stop_features(features: DataFrame) -> DataFrame:
    """Parcel points; ``ordre`` is left out, not null, for a parcel without a stop."""
    properties = F.struct(F.col("colis_id").alias("colisId"), "statut", "ordre")
    return features.select("colis_id", _feature("Point", properties, _point()).alias("json"))


def favourite_features(favourites: DataFrame) -> DataFrame:
    located = favourites.where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    return located.select("id", _feature("Point", F.struct(F.col("id").alias("favoriId")), _point()).alias("json"))


def waypoint_features(tours: DataFrame) -> DataFrame:
    """Depot of every tour and its return point, if it has one."""
    depot = tours.select("tour_id", F.lit("depot").alias("kind"), F.col("depot_lat").alias("lat"), F.col("depot_lon").alias("lon"))
    back = tours.where(F.col("return_to_depot") & F.col("return_lat").isNotNull()).select(
        "tour_id", F.lit("arrivee").alias("kind"), F.col("return_lat").alias("lat"), F.col("return_lon").alias("lon")
    )
    return depot.unionByName(back).select(
        "tour_id", "kind", _feature("Point", F.struct("kind"), _point()).alias("json")
    )


def route_features(segments: DataFrame) -> DataFrame:
    """One line per leg with its ``done`` flag."""
    line = F.transform("line", lambda p: F.array(p["lon"], p["lat"]))
    return segments.select("tour_id", "leg", _feature("LineString", F.struct("done"), line).alias("json"))


def corrections_json(log: DataFrame) -> DataFrame:
    """Correction log as JSON, newest first."""
    return log.orderBy(F.desc("date_correction"), "colis_id").select(
        "colis_id", F.to_json(F.struct(*log.columns)).alias("json")
    )


def write_features(features: DataFrame, path: str) -> None:
    features.select("json").write.mode("overwrite").text(path)
