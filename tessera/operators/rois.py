"""Regions of interest: JSON, polygons, contours. Vertices are arrays of struct<x double, y double>."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

APPS = ("image-pyramid-metadata", "plane-pyramid-metadata")
_POINT = "STRUCT<x: DOUBLE, y: DOUBLE>"
SCHEMA = f"app STRING, version STRING, rois ARRAY<STRUCT<shape: STRING, left: INT, top: INT, width: INT, height: INT, right: INT, bottom: INT, vertices: ARRAY<{_POINT}>, polygons: ARRAY<STRUCT<vertices: ARRAY<{_POINT}>>>>>"


def parse_rois(files: DataFrame, column: str = "json") -> DataFrame:
    """The other columns and roi_index, shape, left, top, width, height, polygons. Rectangles by size or by right and bottom; an unknown app or a vertex that isn't finite is an error."""
    rest = [c for c in files.columns if c != column]
    read = files.select(*rest, F.from_json(column, SCHEMA).alias("j"))
    known = F.when(F.col("j.app").isin(*APPS), F.col("j.rois")).otherwise(F.raise_error(F.lit("unknown app in metadata")).cast(read.schema["j"].dataType["rois"].dataType))
    rows = read.select(*rest, F.posexplode(known).alias("roi_index", "r"))
    polygons = F.when(F.col("r.shape") == "polygon", F.array(F.col("r.vertices"))).when(F.col("r.shape") == "multipolygon", F.expr("transform(r.polygons, p -> p.vertices)"))
    broken = F.exists(F.flatten(polygons), lambda v: v["x"].isNull() | v["y"].isNull() | F.isnan(v["x"]) | F.isnan(v["y"]) | (F.abs(v["x"]) == float("inf")) | (F.abs(v["y"]) == float("inf")))
    polygons = F.when(F.coalesce(broken, F.lit(False)), F.raise_error(F.lit("a vertex isn't finite")).cast(f"array<array<{_POINT}>>")).otherwise(polygons)
    return rows.select(*rest, "roi_index", "r.shape", "r.left", "r.top", F.coalesce(F.expr("r.right - r.left"), "r.width").alias("width"), F.coalesce(F.expr("r.bottom - r.top"), "r.height").alias("height"), polygons.alias("polygons"))


def polygon_box(vertices: Column | str) -> Column:
    """struct of inclusive sides: floors of the minima, ceilings of the maxima less one; null with one vertex or less, or no extent."""
    v = F.col(vertices) if isinstance(vertices, str) else vertices
    xs, ys = F.transform(v, lambda p: p["x"]), F.transform(v, lambda p: p["y"])
    sides = [F.floor(F.array_min(xs)), F.ceil(F.array_max(xs)) - 1, F.floor(F.array_min(ys)), F.ceil(F.array_max(ys)) - 1]
    box = F.struct(*(s.cast("bigint").alias(n) for s, n in zip(sides, ("min_x", "max_x", "min_y", "max_y"), strict=True)))
    return F.when((F.size(v) > 1) & (sides[0] <= sides[1]) & (sides[2] <= sides[3]), box)


def multipolygon_box(polygons: Column | str) -> Column:
    """The box of the boxes of the polygons that have one."""
    p = F.col(polygons) if isinstance(polygons, str) else polygons
    boxes = F.filter(F.transform(p, polygon_box), lambda b: b.isNotNull())
    pick = {"min_x": F.array_min, "max_x": F.array_max, "min_y": F.array_min, "max_y": F.array_max}
    box = F.struct(*(f(boxes[n]).alias(n) for n, f in pick.items()))
    return F.when(F.size(boxes) > 0, box)


def center_size(min_x, max_x, min_y, max_y) -> Column:
    a, b, c, d = (F.col(v) for v in (min_x, max_x, min_y, max_y))
    return F.array((a + b) * 0.5, (c + d) * 0.5, (b - a + 1).cast("double"), (d - c + 1).cast("double"))


def signed_area(vertices: Column | str) -> Column:
    """Twice-halved shoelace sum: negative for contours that run the other way round."""
    v = F.col(vertices) if isinstance(vertices, str) else vertices
    n = F.size(v)
    terms = F.transform(v, lambda p, i: p["x"] * F.element_at(v, (F.pmod(i + 1, n) + 1).cast("int"))["y"] - F.element_at(v, (F.pmod(i + 1, n) + 1).cast("int"))["x"] * p["y"])
    return F.aggregate(terms, F.lit(0.0), lambda s, t: s + t) / 2


def polygon_contour(vertices: Column | str) -> tuple[Column, Column]:
    """(points, internal): vertices rounded half up, and whether the area is negative."""
    v = F.col(vertices) if isinstance(vertices, str) else vertices
    return F.transform(v, lambda p: F.struct(F.floor(p["x"] + 0.5).cast("int").alias("x"), F.floor(p["y"] + 0.5).cast("int").alias("y"))), signed_area(v) < 0


def rect_contour(min_x, max_x, min_y, max_y) -> Column:
    a, b, c, d = F.col(min_x), F.col(max_x) + 1, F.col(min_y), F.col(max_y) + 1
    return F.array(*(F.struct(x.cast("int").alias("x"), y.cast("int").alias("y")) for x, y in ((a, c), (b, c), (b, d), (a, d))))


def all_contours(rois: DataFrame) -> DataFrame:
    """roi_index, part, points, internal: every roi's contours, keyed by the roi's own index; dropped rois shift no others."""
    polygons = rois.where("polygons IS NOT NULL").select("roi_index", F.posexplode("polygons").alias("part", "v"))
    points, internal = polygon_contour("v")
    sides = rois.where("shape = 'rectangle'").withColumns({"min_x": F.col("left"), "max_x": F.expr("left + width - 1"), "min_y": F.col("top"), "max_y": F.expr("top + height - 1")})
    boxes = sides.select("roi_index", F.lit(0).alias("part"), rect_contour("min_x", "max_x", "min_y", "max_y").alias("points"), F.lit(False).alias("internal"))
    return polygons.select("roi_index", "part", points.alias("points"), internal.alias("internal")).unionByName(boxes)


def to_json(rois: DataFrame, *keys: str) -> DataFrame:
    """keys, json: the metadata of each group of rois; multipolygons are written as they are read."""
    one = F.struct("shape", F.when(F.col("shape") == "rectangle", F.col("left")).alias("left"), F.when(F.col("shape") == "rectangle", F.col("top")).alias("top"), F.when(F.col("shape") == "rectangle", F.col("width")).alias("width"), F.when(F.col("shape") == "rectangle", F.col("height")).alias("height"), F.when(F.col("shape") == "polygon", F.col("polygons")[0]).alias("vertices"), F.when(F.col("shape") == "multipolygon", F.transform("polygons", lambda v: F.struct(v.alias("vertices")))).alias("polygons"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("roi_index", one.alias("r")))), lambda x: x["r"])
    return rois.groupBy(*keys).agg(F.to_json(F.struct(F.lit(APPS[0]).alias("app"), F.lit("1.0").alias("version"), listed.alias("rois"))).alias("json"))
