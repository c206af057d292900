"""Planning over pyramids: file lists, levels, areas, frames. levels: pyramid_id, level, dim_x, dim_y."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalars import divide_ceil, max_level, number_of_resolutions, scale_roi
from tessera.operators.raster import window_of
from tessera.operators.rects import SIDES, checked_apart, frames_per_series, roi_min_size, scan_order, tile_grid


def file_list(lists: DataFrame, key: str, column: str) -> DataFrame:
    """key, pyramid_index, path: a JSON array or trimmed lines, blank ones left out; an empty list is an error."""
    text = F.trim(F.col(column))
    paths = F.when(text.startswith("["), F.from_json(text, "array<string>")).otherwise(F.split(text, "\n"))
    paths = F.filter(F.transform(paths, lambda p: F.trim(p)), lambda p: p != "")
    checked = F.when(F.size(paths) > 0, paths).otherwise(F.raise_error(F.lit("no files in the list")).cast("array<string>"))
    return lists.select(key, F.posexplode(checked).alias("pyramid_index", "path"))


def info(levels: DataFrame, level: int, frame_x: int, frame_y: int, key: str = "pyramid_id", sequence: str | None = "ROWS_LEFT_TO_RIGHT", stored: str = "p + 2") -> DataFrame:
    """key, n_levels, level_dim_x, level_dim_y, n_frames, frames_per_series, n_stored of one level; stored: SQL of how many frames to keep, of the frames per series p."""
    of = lambda c: F.max(F.when(F.col("level") == level, F.col(c)))
    sized = levels.groupBy(key).agg(F.count("*").alias("n_levels"), of("dim_x").alias("level_dim_x"), of("dim_y").alias("level_dim_y"))
    p = frames_per_series("level_dim_x", "level_dim_y", frame_x, frame_y, sequence)
    return sized.withColumn("n_frames", divide_ceil("level_dim_x", F.lit(frame_x)) * divide_ceil("level_dim_y", F.lit(frame_y))).withColumn("p", p).withColumn("n_stored", F.expr(stored)).select(key, "n_levels", "level_dim_x", "level_dim_y", "n_frames", F.col("p").alias("frames_per_series"), "n_stored")


def area_to_read(levels: DataFrame, level: int, x: int, y: int, w: int, h: int, key: str = "pyramid_id") -> DataFrame:
    """key and the rectangle at (x, y) of w x h clipped to the level; one that is outside of it is an error."""
    sides = [F.lit(max(x, 0)).cast("bigint"), F.least(F.lit(x + w - 1), F.col("dim_x") - 1), F.lit(max(y, 0)).cast("bigint"), F.least(F.lit(y + h - 1), F.col("dim_y") - 1)]
    some = (sides[0] <= sides[1]) & (sides[2] <= sides[3])
    first = F.when(some, sides[0]).otherwise(F.raise_error(F.lit(f"({x}, {y}) {w} x {h} is outside the level")).cast("bigint"))
    return levels.where(F.col("level") == level).select(key, *(v.alias(n) for v, n in zip([first, *sides[1:]], SIDES, strict=True)))


def areas_to_scan(levels: DataFrame, level: int, rois: DataFrame, frame_x: int, frame_y: int, sequence: str | None = "ROWS_LEFT_TO_RIGHT", equalize: bool = True, key: str = "pyramid_id") -> DataFrame:
    """key, roi_index, frame_index and the frame's rectangle: the frames of a scan over each roi (key, roi_index, sides), or without a scan the roi as a whole. All is clipped to the level."""
    size = levels.where(F.col("level") == level).select(key, "dim_x", "dim_y")
    clipped = rois.join(size, key).withColumns({"min_x": F.greatest("min_x", F.lit(0)), "max_x": F.least("max_x", F.col("dim_x") - 1), "min_y": F.greatest("min_y", F.lit(0)), "max_y": F.least("max_y", F.col("dim_y") - 1)}).where("min_x <= max_x AND min_y <= max_y")
    if sequence is None:
        return clipped.select(key, "roi_index", F.lit(0).cast("bigint").alias("frame_index"), *SIDES)
    grid = scan_order(tile_grid(clipped.withColumn("at_", F.struct(key, "roi_index")), frame_x, frame_y, equalize, "at_"), sequence, "at_")
    return grid.select(f"at_.{key}", "at_.roi_index", "frame_index", *SIDES)


def level_rois(levels: DataFrame, level: int, metadata: DataFrame | None = None, given: DataFrame | None = None, least: int = 0, apart: bool = False, key: str = "pyramid_id") -> DataFrame:
    """key, roi_index and rectangles to work on: the metadata's (scaled to the level, clipped), where a pyramid has any, else the given roi clipped to the level, else the level. least drops smaller ones; apart makes overlaps an error."""
    sized = levels.where(F.col("level") == level).select(key, "dim_x", "dim_y")
    whole = sized.select(key, F.lit(0).cast("bigint").alias("min_x"), (F.col("dim_x") - 1).alias("max_x"), F.lit(0).cast("bigint").alias("min_y"), (F.col("dim_y") - 1).alias("max_y"))
    if given is not None:
        other = given.select(key, *(F.col(c).alias(f"g_{c}") for c in SIDES))
        pick = {c: (F.greatest if c.startswith("min") else F.least)(c, F.coalesce(f"g_{c}", c)) for c in SIDES}
        whole = whole.join(other, key, "left").withColumns(pick).select(key, *SIDES)
    out = whole.select(key, F.lit(0).alias("roi_index"), *SIDES)
    if metadata is not None:
        scaled = metadata.join(level_scales(levels, key).where(F.col("level") == level), key)
        x, w = scale_roi("min_x", F.col("max_x") - F.col("min_x") + 1, "sx")
        y, h = scale_roi("min_y", F.col("max_y") - F.col("min_y") + 1, "sy")
        scaled = scaled.select(key, F.col("roi_index").cast("int").alias("roi_index"), x.alias("l_"), (x + w - 1).alias("r_"), y.alias("t_"), (y + h - 1).alias("b_"))
        inner = scaled.join(whole, key).select(key, "roi_index", F.greatest("l_", "min_x").alias("min_x"), F.least("r_", "max_x").alias("max_x"), F.greatest("t_", "min_y").alias("min_y"), F.least("b_", "max_y").alias("max_y")).where("min_x <= max_x AND min_y <= max_y")
        out = inner.unionByName(out.join(metadata.select(key).distinct(), key, "left_anti"))
    if apart:
        out = checked_apart(out.withColumn("at_", F.struct(key, "roi_index")), "at_").drop("at_")
    return roi_min_size(out, least)


def range_is_valid(from_x, from_y, to_x, to_y, dim_x, dim_y) -> Column:
    """Whether 0 <= from <= to <= dim on both sides."""
    a, b, c, d, w, h = (F.col(v) if isinstance(v, str) else v for v in (from_x, from_y, to_x, to_y, dim_x, dim_y))
    return (a >= 0) & (b >= 0) & (a <= c) & (b <= d) & (c <= w) & (d <= h)


def frame_size(size_x, size_y, least: int) -> tuple[Column, Column]:
    """The frame's sides, an error if one is below the least analysed size."""
    x, y = (F.col(v) if isinstance(v, str) else v for v in (size_x, size_y))
    return tuple(F.when((x >= least) & (y >= least), v).otherwise(F.raise_error(F.lit(f"frames must have sides of {least} or more")).cast("bigint")) for v in (x, y))


def skip_coarse(px: DataFrame, coarse: Column, filler: float, most: float, when_zero: bool = False) -> DataFrame:
    """Coarse pixels replaced by the filler, a share of the largest value; a filler of zero replaces them only on demand."""
    if filler == 0 and not when_zero:
        return px
    return px.withColumn("v", F.when(coarse, F.lit(filler * most).cast(px.schema["v"].dataType)).otherwise(F.col("v")))


def memory_read(levels: DataFrame, level: int, area: tuple[int, int, int, int]) -> DataFrame:
    """x, y, v of an area of one level of pixels (level, x, y, v); pixels that it hasn't are NaN, or 0 where values are whole. A level without pixels is an error."""
    own = levels.where(F.col("level") == level).select("x", "y", "v")
    if own.isEmpty():
        raise ValueError(f"there is no level {level}")
    kind = levels.schema["v"].dataType
    outside = F.lit(float("nan")) if kind.simpleString() in ("double", "float") else F.lit(0).cast(kind)
    x0, x1, y0, y1 = area
    return window_of(own, levels.sparkSession.range(1).selectExpr(f"{x0}L as min_x", f"{x1}L as max_x", f"{y0}L as min_y", f"{y1}L as max_y"), outside)


def contours_of(rois: DataFrame, contours: DataFrame, key: str) -> DataFrame:
    """The rois' contours by their own index: key, roi_index, part, points, internal; rois without contours have none. contours: key, roi_index, part, points, internal."""
    return rois.select(key, "roi_index").join(contours, [key, "roi_index"])


def level_scales(levels: DataFrame, key: str = "pyramid_id") -> DataFrame:
    """key, level, sx, sy: each level's sides over those of level 0."""
    by = Window.partitionBy(key)
    top = lambda c: F.max(F.when(F.col("level") == 0, F.col(c))).over(by)
    return levels.select(key, "level", (F.col("dim_x") / top("dim_x")).alias("sx"), (F.col("dim_y") / top("dim_y")).alias("sy"))


def level_for(levels: DataFrame, compression: float, base: int, key: str = "pyramid_id") -> DataFrame:
    """key, level, left_over: the coarsest level not coarser than a compression, and the compression that is left."""
    fits = levels.withColumn("p", F.pow(F.lit(base), F.col("level"))).where(F.col("p") <= compression)
    return fits.groupBy(key).agg(F.max("level").alias("level"), F.max("p").alias("p")).select(key, "level", (F.lit(compression) / F.col("p")).alias("left_over"))


def special_image(special: DataFrame, levels: DataFrame, kind: str, key: str = "pyramid_id") -> DataFrame:
    """key, image: the special image of a kind, else the smallest level. special: key, kind, image; levels: key, level, image."""
    own = special.where(F.col("kind") == kind).select(key, F.lit(0).alias("rank"), "image")
    last = levels.groupBy(key).agg(F.max_by("image", "level").alias("image")).select(key, F.lit(1).alias("rank"), "image")
    return own.unionByName(last).groupBy(key).agg(F.min_by("image", "rank").alias("image"))


def virtual_levels(sizes: DataFrame, key: str = "pyramid_id", least: int = 256) -> DataFrame:
    """key, level, dim_x, dim_y: halves of the sides (columns dim_x, dim_y) as long as one of them is `least` or more."""
    n = number_of_resolutions("dim_x", "dim_y", F.lit(2), F.lit(least))
    rows = sizes.select(key, "dim_x", "dim_y", F.explode(F.sequence(F.lit(0), (n - 1).cast("int"))).alias("level"))
    half = lambda c: F.floor(F.col(c) / F.pow(F.lit(2), F.col("level"))).cast("bigint")
    return rows.select(key, "level", half("dim_x").alias("dim_x"), half("dim_y").alias("dim_y"))


def svs_actual_level(required, base):
    """The actual level for a required compression: the largest whose power of the base fits."""
    return max_level(required, base)
