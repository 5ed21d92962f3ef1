"""Map-ready tables: heat map, GeoJSON features, trajectories, markers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loginlens.functions import text
from loginlens.functions.geo import valid_coordinates
from loginlens.operators.profiles import time_extent, with_cell
from loginlens.operators.quality import default_columns
from loginlens.operators.segments import SKEW, Ordered, SkewPolicy
from loginlens.schema import EVENT, TIME, USER

HEAT_SCALE = 10.0

# Drawing properties of point and line features.
ANOMALY_COLOR, STANDARD_COLOR = "red", "blue"
ANOMALY_RADIUS, STANDARD_RADIUS = 8, 5
POINT_OPACITY, LINE_OPACITY = 0.8, 0.8
LINE_COLOR, LINE_WEIGHT = "#3388ff", 3

# Shortest span in days (strict >), animation period and duration.
ANIMATION_STEPS = ((30, "P1D", "P5D"), (7, "PT12H", "P1D"), (1, "PT3H", "PT12H"))
ANIMATION_DEFAULT = ("PT30M", "PT3H")


def mappable(scored: DataFrame) -> DataFrame:
    """Rows with usable coordinates and the scoring columns filled in."""
    return default_columns(scored).where(valid_coordinates())


def _time() -> Column:
    return F.date_format(TIME, "yyyy-MM-dd HH:mm:ss")


def heatmap_points(scored: DataFrame) -> DataFrame:
    return mappable(scored).select(
        EVENT, "latitude", "longitude", (F.col("anomaly_score") * HEAT_SCALE).alias("weight"))


def heatmap_grid(scored: DataFrame) -> DataFrame:
    """Heat per 0.001 degree cell: what a map can draw of a very large table."""
    return (with_cell(mappable(scored)).groupBy("cell_lat", "cell_lon")
            .agg(F.count("*").alias("points"), F.sum(F.col("anomaly_score") * HEAT_SCALE).alias("weight")))


def _style() -> dict[str, Column]:
    odd = F.col("is_anomalous")
    return {"fill_color": F.when(odd, ANOMALY_COLOR).otherwise(STANDARD_COLOR),
            "radius": F.when(odd, ANOMALY_RADIUS).otherwise(STANDARD_RADIUS)}


def point_popup() -> Column:
    return F.concat(F.lit("User: "), text.escape_html(USER), F.lit("<br>Device: "), text.escape_html("device_id"),
                    F.lit("<br>Time: "), _time(), F.lit("<br>Anomaly: "), text.yes_no(),
                    F.lit("<br>Score: "), text.fixed_decimals("anomaly_score", 4))


def geojson_points(scored: DataFrame) -> DataFrame:
    """Flat time-stamped point features; see :func:`point_json` for the JSON form."""
    return mappable(scored).select(
        EVENT, USER, TIME, F.col("longitude").alias("lon"), F.col("latitude").alias("lat"),
        _time().alias("time"), *[c.alias(n) for n, c in _style().items()], point_popup().alias("popup"))


def _feature(geometry_type: str, coordinates: Column, properties: Column) -> Column:
    return F.to_json(F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit(geometry_type).alias("type"), coordinates.alias("coordinates")).alias("geometry"),
        properties.alias("properties")))


def point_json(points: DataFrame) -> DataFrame:
    properties = F.struct(
        "time", F.lit("circle").alias("icon"),
        F.struct(F.col("fill_color").alias("fillColor"), F.lit(POINT_OPACITY).alias("fillOpacity"),
                 F.lit("true").alias("stroke"), "radius").alias("iconstyle"),
        F.struct(F.lit(0).alias("weight")).alias("style"), "popup")
    return points.select(EVENT, _feature("Point", F.array("lon", "lat"), properties).alias("feature"))


def search_features(scored: DataFrame) -> DataFrame:
    """Flat features for a map's search box."""
    return mappable(scored).select(
        EVENT, USER, "device_id", F.col("longitude").alias("lon"), F.col("latitude").alias("lat"),
        _time().alias("time"), text.yes_no().alias("is_anomalous"), "anomaly_score",
        F.concat(F.lit("User: "), F.col(USER)).alias("name"))


def search_json(features: DataFrame) -> DataFrame:
    properties = F.struct(USER, "device_id", F.col("time").alias("timestamp"), "is_anomalous",
                          "anomaly_score", "name")
    return features.select(EVENT, _feature("Point", F.array("lon", "lat"), properties).alias("feature"))


def trajectory_segments(logins: DataFrame, skew: SkewPolicy = SKEW) -> DataFrame:
    """A line from each login to the user's next one, stamped with the earlier time."""
    rows = logins.where(valid_coordinates()).select(USER, EVENT, TIME, "latitude", "longitude")
    ordered = Ordered.of(rows, skew).following("_to", F.struct("longitude", "latitude"))
    return (ordered.result().where(F.col("_to").isNotNull()).select(
        USER, EVENT, TIME, F.col("longitude").alias("from_lon"), F.col("latitude").alias("from_lat"),
        F.col("_to.longitude").alias("to_lon"), F.col("_to.latitude").alias("to_lat")))


def trajectory_lines(segments: DataFrame) -> DataFrame:
    properties = F.struct(
        _time().alias("time"),
        F.struct(F.lit(LINE_COLOR).alias("color"), F.lit(LINE_WEIGHT).alias("weight"),
                 F.lit(LINE_OPACITY).alias("opacity")).alias("style"))
    line = F.array(F.array("from_lon", "from_lat"), F.array("to_lon", "to_lat"))
    return segments.select(USER, EVENT, _feature("LineString", line, properties).alias("feature"))


def animation_settings(logins: DataFrame, *keys: str) -> DataFrame:
    """Playback period and duration by time span, for the table or per key."""
    days = F.col("span_days")
    period, duration = F.when(F.lit(False), ""), F.when(F.lit(False), "")
    for above, step, length in ANIMATION_STEPS:
        period, duration = period.when(days > above, step), duration.when(days > above, length)
    return time_extent(logins, *keys).select(
        *keys, "span_days", period.otherwise(ANIMATION_DEFAULT[0]).alias("period"),
        duration.otherwise(ANIMATION_DEFAULT[1]).alias("duration"))


def marker_rows(scored: DataFrame) -> DataFrame:
    """One marker per login: layer, tooltip and popup; the user layer is ``user_id``."""
    odd = F.col("is_anomalous")
    layer = F.when(odd, "Anomalous Logins").otherwise("Standard Logins")
    tooltip = F.concat(F.when(odd, "Anomaly").otherwise("Standard"), F.lit(": User "), text.escape_html(USER))
    return mappable(scored).select(
        EVENT, USER, "latitude", "longitude", layer.alias("layer"),
        F.when(odd, ANOMALY_COLOR).otherwise(STANDARD_COLOR).alias("icon_color"),
        F.when(odd, "exclamation-circle").otherwise("user").alias("icon"),
        tooltip.alias("tooltip"), text.popup_text().alias("popup"))


def marker_layers(markers: DataFrame) -> DataFrame:
    """Markers per layer: standard, anomalous, and one layer per user."""
    shared = markers.groupBy("layer").agg(F.count("*").alias("markers"))
    users = markers.groupBy(F.concat(F.lit("User "), F.col(USER)).alias("layer")).agg(F.count("*").alias("markers"))
    return shared.unionByName(users)
