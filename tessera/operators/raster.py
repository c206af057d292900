"""Rasters as relations of pixels (x, y, v), and frames of them (frame_seq, x, y, v)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalars import floor_div, rotate_point
from tessera.operators.rects import CELL, in_cells, inside, pixels_of

AVERAGING = ("AVG", "MIN", "MAX", "SIMPLE", "AVG_INT")


def pixels_in_frames(px: DataFrame, frames: DataFrame, cell: int = CELL) -> DataFrame:
    """The pixels under each frame, with its columns: an equi join on coarse cells and an exact filter."""
    tagged = px.withColumns({"cell_x": floor_div("x", F.lit(cell)), "cell_y": floor_div("y", F.lit(cell))})
    met = tagged.join(in_cells(frames, cell), ["cell_x", "cell_y"])
    return met.where("x BETWEEN min_x AND max_x AND y BETWEEN min_y AND max_y").drop("cell_x", "cell_y")


def crop_frames(px: DataFrame, frames: DataFrame, rect: tuple[int, int, int, int], key: str = "frame_seq", cell: int = CELL) -> DataFrame:
    """The pixels (px: x, y, v) of each frame inside a rectangle relative to the frame's corner, shifted to the rectangle's corner.

    Frames are cropped as rectangles before they meet pixels: what is outside is never made, and what is found is final, without a shuffle.
    """
    x0, x1, y0, y1 = rect
    left, top = F.col("min_x"), F.col("min_y")
    sides = {"min_x": left + max(x0, 0), "max_x": F.least(left + x1, F.col("max_x")), "min_y": top + max(y0, 0), "max_y": F.least(top + y1, F.col("max_y"))}
    own = frames.select(key, (left + x0).alias("left_"), (top + y0).alias("top_"), *(c.cast("bigint").alias(n) for n, c in sides.items()))
    return pixels_in_frames(px.select("x", "y", "v"), own, cell).select(key, (F.col("x") - F.col("left_")).alias("x"), (F.col("y") - F.col("top_")).alias("y"), "v")


def overlay(fpx: DataFrame, order: str = "frame_seq") -> DataFrame:
    """The value of the latest frame at each pixel."""
    return fpx.groupBy("x", "y").agg(F.max_by("v", order).alias("v"))


def window_of(pixels: DataFrame, area: DataFrame, outside: Column) -> DataFrame:
    """The pixels of an area (one row of sides); `outside` where there is none."""
    return pixels_of(area).join(pixels, ["x", "y"], "left").select("x", "y", F.coalesce("v", outside).alias("v"))


def read_rect(fpx: DataFrame, area: DataFrame) -> DataFrame:
    """An area read from overlapping frames: the last writer wins, zero where none is."""
    zero = F.lit(0).cast(fpx.schema["v"].dataType)
    return window_of(overlay(fpx), area, zero)


def read_rect_reindexed(fpx: DataFrame, area: DataFrame, bases: DataFrame) -> DataFrame:
    """read_rect, each label replaced by its representative (label, base) where it has one."""
    return reindex_matrix(read_rect(fpx, area), bases)


def reindex_matrix(pixels: DataFrame, bases: DataFrame) -> DataFrame:
    named = bases.select(F.col("label").alias("v"), "base")
    return pixels.join(named, "v", "left").withColumn("v", F.coalesce("base", "v")).drop("base")


def rotate(px: DataFrame, angle: int, width: Column | int, height: Column | int) -> DataFrame:
    """The raster rotated clockwise by 90, 180 or 270 degrees; width and height are its own before."""
    w, h = (v if isinstance(v, Column) else F.lit(v) for v in (width, height))
    back = {90: 270, 270: 90}.get(angle, angle)  # where a pixel goes is where the reverse rotation looks it up
    wide, high = (h, w) if angle in (90, 270) else (w, h)
    x, y = rotate_point(F.lit(back), F.col("x"), F.col("y"), wide, high, pixel=True)
    return px.withColumns({"x": x, "y": y})


def auto_crop(pixels: DataFrame, *keys: str) -> DataFrame:
    """keys and the sides of what isn't zero; one pixel at the first corner where all is zero."""
    some = F.col("v") != 0
    box = pixels.groupBy(*keys).agg(*(f(F.when(some, F.col(c))).alias(f"{n}_{c}") for c in "xy" for n, f in (("min", F.min), ("max", F.max))), F.min("x").alias("x_"), F.min("y").alias("y_"))
    return box.select(*keys, F.coalesce("min_x", "x_").alias("min_x"), F.coalesce("max_x", "x_").alias("max_x"), F.coalesce("min_y", "y_").alias("min_y"), F.coalesce("max_y", "y_").alias("max_y"))


def downsample(px: DataFrame, width: Column | int, height: Column | int, compression: int = 2, mode: str = "AVG") -> DataFrame:
    """The next level: blocks of compression x compression pixels; rows and columns beyond whole blocks go.

    AVG is the exact mean (double), AVG_INT rounds it half up, SIMPLE takes the block's first pixel.
    """
    c = F.lit(compression)
    w, h = (v if isinstance(v, Column) else F.lit(v) for v in (width, height))
    whole = (F.col("x") < floor_div(w, c) * c) & (F.col("y") < floor_div(h, c) * c)
    blocks = px.where(whole).groupBy(floor_div("x", c).alias("x"), floor_div("y", c).alias("y"))
    mean = F.sum("v") / F.count("v")
    value = {"AVG": mean, "AVG_INT": F.floor(mean + 0.5), "MIN": F.min("v"), "MAX": F.max("v"), "SIMPLE": F.min_by("v", F.struct("y", "x"))}[mode]
    return blocks.agg(value.alias("v"))


def level_sizes(width: int, height: int, compression: int = 2, least: int = 256) -> list[tuple[int, int]]:
    """The sides of all levels: halves until both are below least, or one is empty."""
    sizes = [(width, height)]
    while True:
        w, h = sizes[-1][0] // compression, sizes[-1][1] // compression
        if w < 1 or h < 1 or (w < least and h < least):
            return sizes
        sizes.append((w, h))


def build_pyramid(px: DataFrame, width: int, height: int, compression: int = 2, least: int = 256, mode: str = "MAX") -> DataFrame:
    """level, x, y, v of every level; each is one aggregation of the level before. The number of levels is logarithmic."""
    out, now = px.select(F.lit(0).alias("level"), "x", "y", "v"), px
    sizes = level_sizes(width, height, compression, least)
    for k, (w, h) in enumerate(sizes[:-1], 1):
        now = downsample(now, w, h, compression, mode)
        out = out.unionByName(now.select(F.lit(k).alias("level"), "x", "y", F.col("v").cast(px.schema["v"].dataType).alias("v")))
    return out


def read_scaled(px: DataFrame, width: int, height: int, compression: int) -> DataFrame:
    """The raster at a whole compression: the nearest finer power of two, then blocks of what is left."""
    now, w, h, left = px, width, height, compression
    while left % 2 == 0:
        now, w, h, left = downsample(now, w, h, 2, "MAX"), w // 2, h // 2, left // 2
    return downsample(now, w, h, left, "MAX") if left > 1 else now


def resized(px: DataFrame, width: int, height: int, over: int, under: int = 1) -> DataFrame:
    """The raster compressed over / under times (1 or more): each new pixel is the mean of what it covers, pixels counted by the part of them, rounded down. Sides are rounded down; weights are whole numbers, so sums are exact."""
    if over < under:
        raise ValueError("a compression is 1 or more")
    wide, high = width * under // over, height * under // over

    def cells(c: str, n: int) -> Column:
        low, last = F.col(c) * under, (F.col(c) + 1) * under - 1
        at = F.sequence(floor_div(low, F.lit(over)), floor_div(last, F.lit(over)))
        return F.filter(F.transform(at, lambda k: F.struct(k.alias("to"), (F.least(last + 1, (k + 1) * over) - F.greatest(low, k * over)).alias("part"))), lambda q: q["to"] < n)

    spread = px.select("v", F.explode(cells("x", wide)).alias("a"), "y").select("v", "a", F.explode(cells("y", high)).alias("b"))
    part = F.col("a.part") * F.col("b.part")
    sums = spread.groupBy(F.col("a.to").alias("x"), F.col("b.to").alias("y")).agg(F.sum(F.col("v") * part).alias("s"), F.sum(part).alias("n"))
    return sums.select("x", "y", floor_div("s", F.col("n")).alias("v"))


def read_compressed(levels: DataFrame, sizes: list[tuple[int, int]], over: int, under: int = 1, base: int = 2) -> DataFrame:
    """The whole raster at a compression of over / under: the coarsest level (level, x, y, v; sizes: their sides) not coarser than that, compressed by what is left."""
    level = 0
    while level + 1 < len(sizes) and base ** (level + 1) * under <= over:
        level += 1
    own = levels.where(F.col("level") == level).select("x", "y", "v")
    left = under * base**level
    return own if left == over else resized(own, *sizes[level], over, left)


def displayed(px: DataFrame, area: tuple[int, int, int, int], width: int, height: int, most: float, background: int) -> DataFrame:
    """x, y, v of an area as a display shows it, from its corner: values scaled to 0..255 and rounded down, the background's colour outside the image; an empty area shows one black pixel."""
    x0, x1, y0, y1 = area
    if x0 > x1 or y0 > y1:
        return px.sparkSession.range(1).selectExpr("0L as x", "0L as y", "0L as v")
    shown = px.select("x", "y", F.floor(F.col("v") * (255.0 / most)).cast("bigint").alias("v"))
    whole = px.sparkSession.range(1).selectExpr(f"{x0}L as min_x", f"{x1}L as max_x", f"{y0}L as min_y", f"{y1}L as max_y")
    outside = F.when(F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1), 0).otherwise(background).cast("bigint")
    return window_of(shown, whole, outside).select((F.col("x") - x0).alias("x"), (F.col("y") - y0).alias("y"), "v")


def rotated_label(px: DataFrame, angle: int, width: int, height: int, background: int) -> DataFrame:
    """A label image rotated by 0, 90, 180 or 270 degrees within its own sides: made smaller to fit, both sides in the same proportion, and centred on the background."""
    if angle == 0:
        return px
    turned = rotate(px, angle, width, height).select("x", "y", "v")
    w, h = (height, width) if angle in (90, 270) else (width, height)
    over, under = max((w, width), (h, height), (1, 1), key=lambda r: r[0] / r[1])
    if over > under:
        turned, w, h = resized(turned, w, h, over, under), w * under // over, h * under // over
    left, top = (width - w) // 2, (height - h) // 2
    whole = px.sparkSession.range(1).selectExpr("0L as min_x", f"{width - 1}L as max_x", "0L as min_y", f"{height - 1}L as max_y")
    return window_of(turned.select((F.col("x") + left).alias("x"), (F.col("y") + top).alias("y"), "v"), whole, F.lit(background).cast(px.schema["v"].dataType))


def combine_override(main: DataFrame, other: DataFrame, key: str = "level") -> DataFrame:
    """Levels of `other` where it has them, else of `main`."""
    return other.unionByName(main.join(other.select(key).distinct(), key, "left_anti"))


def extend_canvas(px: DataFrame, canvas: DataFrame, shift_x: int, shift_y: int, background: int, border: int, width: int, height: int, border_value: int) -> DataFrame:
    """The raster at (shift_x, shift_y) on a canvas (one row of sides), inside a border of another value, over a background."""
    moved = px.select((F.col("x") + shift_x).alias("x"), (F.col("y") + shift_y).alias("y"), "v")
    framed = F.col("x").between(shift_x - border, shift_x + width + border - 1) & F.col("y").between(shift_y - border, shift_y + height + border - 1)
    return window_of(moved, canvas, F.when(framed, F.lit(border_value)).otherwise(F.lit(background)).cast(px.schema["v"].dataType))


def compose_layers(*layers: DataFrame) -> DataFrame:
    """The value of the first layer that has the pixel."""
    ranked = [d.select("x", "y", "v", F.lit(i).alias("rank")) for i, d in enumerate(layers)]
    out = ranked[0]
    for d in ranked[1:]:
        out = out.unionByName(d)
    return out.groupBy("x", "y").agg(F.min_by("v", "rank").alias("v"))


def fill_rect(px: DataFrame, rect: tuple[int, int, int, int], value) -> DataFrame:
    return px.withColumn("v", F.when(inside(rect), F.lit(value).cast(px.schema["v"].dataType)).otherwise(F.col("v")))


def widen_bands(px: DataFrame, bands: int = 3) -> DataFrame:
    """A one-band raster with its value in every band."""
    return px.select("x", "y", F.explode(F.array(*(F.lit(b) for b in range(bands)))).alias("band"), "v")


def read_tiles(tiles: DataFrame, area: tuple[int, int, int, int]) -> DataFrame:
    """x, y, v of an area from tiles (tile_x, tile_y, min_x, min_y, w, h, data: array of values by rows): only tiles that meet it are opened, rows are clipped before pixels are made."""
    x0, x1, y0, y1 = area
    near = tiles.where(f"min_x <= {x1} AND min_x + w > {x0} AND min_y <= {y1} AND min_y + h > {y0}")
    rows = near.select("min_x", "min_y", "w", "data", F.explode(F.sequence(F.greatest(F.col("min_y"), F.lit(y0)), F.least(F.col("min_y") + F.col("h") - 1, F.lit(y1)))).alias("y"))
    cells = rows.select("*", F.explode(F.sequence(F.greatest(F.col("min_x"), F.lit(x0)), F.least(F.col("min_x") + F.col("w") - 1, F.lit(x1)))).alias("x"))
    return cells.select("x", "y", F.expr("data[cast((y - min_y) * w + x - min_x AS int)]").alias("v"))


def tiles_of(px: DataFrame, tile: int) -> DataFrame:
    """tile_x, tile_y, min_x, min_y, w, h, data: a full raster cut in tiles, values by rows."""
    t = F.lit(tile)
    keyed = px.withColumns({"tile_x": floor_div("x", t), "tile_y": floor_div("y", t)})
    made = keyed.groupBy("tile_x", "tile_y").agg(F.min("x").alias("min_x"), F.min("y").alias("min_y"), (F.max("x") - F.min("x") + 1).alias("w"), (F.max("y") - F.min("y") + 1).alias("h"), F.array_sort(F.collect_list(F.struct("y", "x", "v"))).alias("p"))
    return made.withColumn("data", F.expr("transform(p, c -> c.v)")).drop("p")


def complete_tiles(px: DataFrame, tile: int, width: Column | int, height: Column | int) -> DataFrame:
    """tile_x, tile_y of the tiles whose pixels are all there; those at the right and lower edge are smaller."""
    t = F.lit(tile)
    w, h = (v if isinstance(v, Column) else F.lit(v) for v in (width, height))
    n = px.groupBy(floor_div("x", t).alias("tile_x"), floor_div("y", t).alias("tile_y")).agg(F.count_distinct("x", "y").alias("n"))
    need = F.least(t, w - F.col("tile_x") * t) * F.least(t, h - F.col("tile_y") * t)
    return n.where(F.col("n") == need).select("tile_x", "tile_y")


def best_precision(kinds: DataFrame, kind: str) -> DataFrame:
    """The element type that holds all: any floating type ranks over any whole one."""
    ranks = {"bit": 0, "u8": 1, "u16": 2, "i32": 3, "i64": 4, "f32": 5, "f64": 6}
    rank = F.create_map(*(x for k, v in ranks.items() for x in (F.lit(k), F.lit(v))))
    return kinds.agg(F.max_by(kind, rank[F.col(kind)]).alias(kind))
