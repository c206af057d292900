"""Rectangles as relations: inclusive columns min_x, max_x, min_y, max_y.

Overlap joins are equi joins on coarse cells, never nested loops: a rectangle is repeated for the cells that it meets, and a
pair counts only in the cell of its overlap's first corner, so no distinct is needed. Coverage works on runs (a row of y with x0..x1)
instead of pixels, in one sort by area and row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalars import divide_ceil, equalize_grid, floor_div, rotate_point
from tessera.plans.storage import stored

CELL = 64
SIDES = ("min_x", "max_x", "min_y", "max_y")
NEAR4 = ((1, 0), (-1, 0), (0, 1), (0, -1))
NEAR8 = (*NEAR4, (1, 1), (1, -1), (-1, 1), (-1, -1))


def frame_position(df: DataFrame, left: str, top: str, width: str, height: str) -> DataFrame:
    """Adds the inclusive rectangle of a left top corner and positive sides; other sides are an error."""
    ok = (F.col(width) > 0) & (F.col(height) > 0)
    right = F.when(ok, F.col(left) + F.col(width) - 1).otherwise(F.raise_error(F.lit("sides must be positive")).cast("bigint"))
    return df.withColumns({"min_x": F.col(left), "max_x": right, "min_y": F.col(top), "max_y": F.col(top) + F.col(height) - 1})


def containing_rectangle(frames: DataFrame, *keys: str) -> DataFrame:
    return frames.groupBy(*keys).agg(F.min("min_x").alias("min_x"), F.max("max_x").alias("max_x"), F.min("min_y").alias("min_y"), F.max("max_y").alias("max_y"))


def frames_with_edge(frames: DataFrame, edge: str, value: int) -> DataFrame:
    return frames.where(F.col(edge) == value)


def overlaps(area: tuple[int, int, int, int]) -> Column:
    x0, x1, y0, y1 = area
    return (F.col("min_x") <= x1) & (F.col("max_x") >= x0) & (F.col("min_y") <= y1) & (F.col("max_y") >= y0)


def frames_intersecting(frames: DataFrame, area: tuple[int, int, int, int]) -> DataFrame:
    return frames.where(overlaps(area))


def in_cells(rects: DataFrame, cell: int = CELL, prefix: str = "") -> DataFrame:
    """A row for each coarse cell that a rectangle meets: cell_x, cell_y."""
    x0, x1, y0, y1 = (F.col(prefix + s) for s in SIDES)
    wide = rects.where((x0 <= x1) & (y0 <= y1)).withColumn("cell_x", F.explode(F.sequence(floor_div(x0, F.lit(cell)), floor_div(x1, F.lit(cell)))))
    return wide.withColumn("cell_y", F.explode(F.sequence(floor_div(y0, F.lit(cell)), floor_div(y1, F.lit(cell)))))


def overlap_join(areas: DataFrame, frames: DataFrame, cell: int = CELL) -> DataFrame:
    """Pairs of overlapping rectangles: the areas' columns, and the frames' with the prefix f_."""
    other = frames.select(*(F.col(c).alias(f"f_{c}") for c in frames.columns))
    pairs = in_cells(areas, cell).join(in_cells(other, cell, "f_"), ["cell_x", "cell_y"])
    meet = (F.col("min_x") <= F.col("f_max_x")) & (F.col("max_x") >= F.col("f_min_x")) & (F.col("min_y") <= F.col("f_max_y")) & (F.col("max_y") >= F.col("f_min_y"))
    first = (floor_div(F.greatest("min_x", "f_min_x"), F.lit(cell)) == F.col("cell_x")) & (floor_div(F.greatest("min_y", "f_min_y"), F.lit(cell)) == F.col("cell_y"))
    return pairs.where(meet & first).drop("cell_x", "cell_y")


def is_intersected(areas: DataFrame, frames: DataFrame, key: str) -> DataFrame:
    """key, intersected: whether any frame overlaps the area."""
    hit = overlap_join(areas, frames).select(key).distinct().withColumn("hit", F.lit(True))
    return areas.join(hit, key, "left").select(key, F.col("hit").isNotNull().alias("intersected"))


def covered_runs(areas: DataFrame, frames: DataFrame, key: str) -> DataFrame:
    """key, y, x0, x1: for each row of an area, the overlapping frames' spans clipped to it, merged where they touch."""
    clipped = overlap_join(areas, frames).select(key, F.greatest("min_x", "f_min_x").alias("x0"), F.least("max_x", "f_max_x").alias("x1"), F.explode(F.sequence(F.greatest("min_y", "f_min_y"), F.least("max_y", "f_max_y"))).alias("y"))
    row = Window.partitionBy(key, "y").orderBy("x0", "x1")
    reach = F.max("x1").over(row.rowsBetween(Window.unboundedPreceding, -1))
    marked = clipped.withColumn("new", F.coalesce(F.col("x0") > reach + 1, F.lit(True)).cast("int"))
    runs = marked.withColumn("run", F.sum("new").over(row.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(key, "y", "run").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).drop("run")


def region_subtract(areas: DataFrame, frames: DataFrame, key: str) -> DataFrame:
    """key, y, x0, x1: the runs of each area that no frame covers."""
    rows = areas.select(key, "min_x", "max_x", F.explode(F.sequence("min_y", "max_y")).alias("y"))
    taken = covered_runs(areas, frames, key)
    edges = rows.select(key, "y", (F.col("min_x") - 1).alias("x0"), (F.col("min_x") - 1).alias("x1")).unionByName(taken).unionByName(rows.select(key, "y", (F.col("max_x") + 1).alias("x0"), (F.col("max_x") + 1).alias("x1")))
    after = F.lead("x0").over(Window.partitionBy(key, "y").orderBy("x0", "x1"))
    gaps = edges.select(key, "y", (F.col("x1") + 1).alias("x0"), (after - 1).alias("x1"))
    return gaps.where("x0 <= x1")


def is_covered(areas: DataFrame, frames: DataFrame, key: str) -> DataFrame:
    """key, covered: whether the frames cover the whole area."""
    open_ = region_subtract(areas, frames, key).select(key).distinct().withColumn("open", F.lit(True))
    return areas.join(open_, key, "left").select(key, F.col("open").isNull().alias("covered"))


def region_intersect(container: DataFrame, rects: DataFrame) -> DataFrame:
    """The parts of rects inside the containers: f_* columns of rects kept, sides clipped."""
    return overlap_join(container, rects).withColumns({"min_x": F.greatest("min_x", "f_min_x"), "max_x": F.least("max_x", "f_max_x"), "min_y": F.greatest("min_y", "f_min_y"), "max_y": F.least("max_y", "f_max_y")})


def pixels_of(rects: DataFrame, *keep: str) -> DataFrame:
    """A row for each pixel of each rectangle: x, y and the kept columns."""
    rows = rects.select(*keep, "min_x", "max_x", F.explode(F.sequence("min_y", "max_y")).alias("y"))
    return rows.select(*keep, F.explode(F.sequence("min_x", "max_x")).alias("x"), "y")


def _near(pixels: DataFrame, straight: bool) -> DataFrame:
    steps = F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in (NEAR4 if straight else NEAR8)))
    return pixels.select("x", "y", F.explode(steps).alias("s")).select("x", "y", (F.col("x") + F.col("s.dx")).alias("nx"), (F.col("y") + F.col("s.dy")).alias("ny"))


def external_boundary(region: DataFrame, straight: bool = True) -> DataFrame:
    """x, y of the pixels next to the region (distinct x, y), outside it."""
    return _near(region, straight).select(F.col("nx").alias("x"), F.col("ny").alias("y")).distinct().join(region, ["x", "y"], "left_anti")


def internal_boundary(region: DataFrame, straight: bool = True) -> DataFrame:
    """x, y of the region's pixels that have a neighbour outside it."""
    other = region.select(F.col("x").alias("nx"), F.col("y").alias("ny"))
    return _near(region, straight).join(other, ["nx", "ny"], "left_anti").select("x", "y").distinct()


def inside(area: tuple[int, int, int, int]) -> Column:
    x0, x1, y0, y1 = area
    return F.col("x").between(x0, x1) & F.col("y").between(y0, y1)


def boundary_skip(region: DataFrame, large: tuple[int, int, int, int]) -> DataFrame:
    """For too large objects to be skipped: the boundary of what the region has inside the large rectangle."""
    return internal_boundary(region.where(inside(large)))


def boundary_retain(region: DataFrame, large: tuple[int, int, int, int]) -> DataFrame:
    """For their last part to be retained: the boundary of the whole region, as far as it is inside the large rectangle."""
    return internal_boundary(region).where(inside(large))


def _sides(frames: DataFrame, key: str, name: str, facing: bool, cell: int) -> DataFrame:
    """A row for each cell along each side: side, at, cell, name, low, high. facing: the sides as seen from outside."""
    a, b, c, d = (F.col(s) for s in SIDES)
    one = lambda side, at, low, high: F.struct(F.lit(side).alias("side"), at.alias("at"), low.alias("low"), high.alias("high"))
    own = [one("X_MINUS", a - 1, c, d), one("Y_MINUS", c - 1, a, b), one("X_PLUS", b + 1, c, d), one("Y_PLUS", d + 1, a, b)]
    seen = [one("X_MINUS", b, c, d), one("Y_MINUS", d, a, b), one("X_PLUS", a, c, d), one("Y_PLUS", c, a, b)]
    rows = frames.select(F.col(key).alias(name), F.explode(F.array(*(seen if facing else own))).alias("s")).select(name, "s.*").where("low <= high")
    return rows.withColumn("cell", F.explode(F.sequence(floor_div("low", F.lit(cell)), floor_div("high", F.lit(cell)))))


def adjacent_frames(frames: DataFrame, key: str = "frame_seq", cell: int = CELL) -> DataFrame:
    """a, b, side: frames b that touch a's side, from outside, along a part of it. One equi join on the touching coordinate and the coarse cell along the side; a pair counts in its common part's first cell."""
    a, b = _sides(frames, key, "a", False, cell), _sides(frames, key, "b", True, cell).withColumnsRenamed({"low": "b_low", "high": "b_high"})
    pairs = a.join(b, ["side", "at", "cell"]).where("low <= b_high AND high >= b_low")
    return pairs.where(floor_div(F.greatest("low", "b_low"), F.lit(cell)) == F.col("cell")).select("a", "b", "side")


def roi_clip(rois: DataFrame, width, height) -> DataFrame:
    """The parts of rectangles inside a level of width x height; those outside go."""
    sides = {"min_x": F.greatest("min_x", F.lit(0)), "max_x": F.least(F.col("max_x"), F.lit(width - 1)), "min_y": F.greatest("min_y", F.lit(0)), "max_y": F.least(F.col("max_y"), F.lit(height - 1))}
    return rois.withColumns(sides).where("min_x <= max_x AND min_y <= max_y")


def roi_min_size(rois: DataFrame, least: int) -> DataFrame:
    """Those with both sides of `least` or more; a least size up to 1 keeps all."""
    return rois.where(F.expr(f"max_x - min_x + 1 >= {least} AND max_y - min_y + 1 >= {least}")) if least > 1 else rois


def roi_overlaps(rois: DataFrame, key: str = "roi_index", block: int = 2048, pairs_a_task: int = 50_000_000) -> DataFrame:
    """i, j: pairs of overlapping rectangles, i < j.

    A cell with more than `block` rectangles is cut: each of its parts, of about so many, meets the cell's rectangles as a task's work of its own.
    Tasks are as many as the pairs to look at need, since the few bytes that go in tell nothing of them.
    """
    rows = in_cells(rois.select(key, *SIDES))
    full = rows.groupBy("cell_x", "cell_y").agg(F.count("*").alias("n_"))
    work = full.agg(F.sum(F.col("n_").cast("double") * F.col("n_"))).first()[0] or 0
    tasks = max(1, int(-(-work // pairs_a_task)))
    parts = F.coalesce(F.ceil(F.col("n_") / block), F.lit(1))
    crowded = F.broadcast(full.where(F.col("n_") > block))
    cut = rows.join(crowded, ["cell_x", "cell_y"], "left").withColumn("parts", parts).drop("n_")
    at = ["cell_x", "cell_y", "part"]
    one = cut.withColumn("part", F.pmod(F.xxhash64(key), F.col("parts"))).drop("parts")
    two = cut.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1))).select(*at, *(F.col(c).alias(f"f_{c}") for c in (key, *SIDES)))
    if tasks > 1:
        one, two = one.repartition(tasks, *at), two.repartition(tasks, *at)
    meet = (F.col("min_x") <= F.col("f_max_x")) & (F.col("max_x") >= F.col("f_min_x")) & (F.col("min_y") <= F.col("f_max_y")) & (F.col("max_y") >= F.col("f_min_y"))
    first = (floor_div(F.greatest("min_x", "f_min_x"), F.lit(CELL)) == F.col("cell_x")) & (floor_div(F.greatest("min_y", "f_min_y"), F.lit(CELL)) == F.col("cell_y"))
    return one.hint("merge").join(two, at).where((F.col(key) < F.col(f"f_{key}")) & meet & first).select(F.col(key).alias("i"), F.col(f"f_{key}").alias("j"))


def tile_grid(rois: DataFrame, frame_x: int, frame_y: int, equalize: bool = True, key: str = "roi_index") -> DataFrame:
    """key, tx, ty, n_x, n_y and the tile's rectangle, clipped to the roi; closed form, one row a tile."""
    w, h = F.col("max_x") - F.col("min_x") + 1, F.col("max_y") - F.col("min_y") + 1
    fx, fy = (equalize_grid(w, F.lit(frame_x)), equalize_grid(h, F.lit(frame_y))) if equalize else (F.lit(frame_x), F.lit(frame_y))
    sized = rois.select(key, *SIDES, w.alias("w"), h.alias("h"), fx.alias("fx"), fy.alias("fy")).withColumns({"n_x": divide_ceil("w", "fx"), "n_y": divide_ceil("h", "fy")})
    grid = sized.withColumn("ty", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_y") - 1))).withColumn("tx", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_x") - 1)))
    left, top = F.col("min_x") + F.col("tx") * F.col("fx"), F.col("min_y") + F.col("ty") * F.col("fy")
    return grid.select(key, "tx", "ty", "n_x", "n_y", left.alias("min_x"), F.least(left + F.col("fx") - 1, F.col("max_x")).alias("max_x"), top.alias("min_y"), F.least(top + F.col("fy") - 1, F.col("max_y")).alias("max_y"))


def scan_order(grid: DataFrame, sequence: str, key: str = "roi_index") -> DataFrame:
    """Adds high, low (as they are visited) and frame_index within the roi: rows or columns first, plain or snake, or by the shorter side.

    SHORTEST_SIDE takes rows where dim_x <= dim_y; its snake takes rows where dim_x >= dim_y (as many tiles), a quirk that is kept.
    """
    rows = {"ROWS_LEFT_TO_RIGHT": F.lit(True), "ROWS_BY_SNAKE": F.lit(True), "COLUMNS_TOP_TO_BOTTOM": F.lit(False), "COLUMNS_BY_SNAKE": F.lit(False)}
    if sequence in rows:
        by_rows = rows[sequence]
    else:
        extent = Window.partitionBy(key)
        dim_x, dim_y = (F.max(f"max_{o}").over(extent) - F.min(f"min_{o}").over(extent) for o in "xy")
        by_rows = dim_x <= dim_y if sequence == "SHORTEST_SIDE" else dim_x >= dim_y
    snake = "SNAKE" in sequence
    out = grid.withColumn("by_rows", by_rows)
    high, low, n = F.when(F.col("by_rows"), F.col("ty")).otherwise(F.col("tx")), F.when(F.col("by_rows"), F.col("tx")).otherwise(F.col("ty")), F.when(F.col("by_rows"), F.col("n_x")).otherwise(F.col("n_y"))
    visited = F.when(F.pmod(high, F.lit(2)) == 1, n - 1 - low).otherwise(low) if snake else low
    return out.withColumns({"high": high, "low": visited}).withColumn("frame_index", F.col("high") * n + F.col("low")).drop("by_rows")


def total_frames(rois: DataFrame, frame_x: int, frame_y: int, whole_roi: bool = False) -> DataFrame:
    """n: how many frames the rectangles need in all; one each when read whole."""
    n = F.lit(1) if whole_roi else divide_ceil(F.col("max_x") - F.col("min_x") + 1, F.lit(frame_x)) * divide_ceil(F.col("max_y") - F.col("min_y") + 1, F.lit(frame_y))
    return rois.agg(F.coalesce(F.sum(n), F.lit(0)).cast("bigint").alias("n"))


def loop_flags(frames: DataFrame, pyramid: str = "pyramid_index", roi: str = "roi_index", index: str = "frame_index") -> DataFrame:
    """Adds first_in_roi, last_in_roi, first_in_pyramid, last_in_pyramid, last; per pyramid and roi in their order. Ends come from aggregations, so no pyramid is one task."""
    of_roi = frames.groupBy(pyramid, roi).agg(F.min(index).alias("low_"), F.max(index).alias("high_"))
    of_pyramid = of_roi.groupBy(pyramid).agg(F.min(F.struct(roi, "low_")).alias("first_"), F.max(F.struct(roi, "high_")).alias("end_"))
    last = of_pyramid.agg(F.max(F.struct(pyramid, "end_")).alias("all_"))
    ends = of_roi.join(of_pyramid, pyramid).join(F.broadcast(last))
    at = F.struct(F.col(roi), F.col(index))
    is_end = at == F.struct(F.col(f"end_.{roi}"), F.col("end_.high_"))
    flags = {"first_in_roi": F.col(index) == F.col("low_"), "last_in_roi": F.col(index) == F.col("high_"), "first_in_pyramid": at == F.struct(F.col(f"first_.{roi}"), F.col("first_.low_")), "last_in_pyramid": is_end, "last": is_end & (F.col(pyramid) == F.col(f"all_.{pyramid}"))}
    return frames.join(ends, [pyramid, roi]).withColumns(flags).drop("low_", "high_", "first_", "end_", "all_")


def background_areas(areas: DataFrame, width: int, height: int, key: str) -> DataFrame:
    """key and up to four rectangles: what of an area lies outside 0..width-1, 0..height-1 (above, below, left, right of it)."""
    def rect(a, b, c, d):
        return F.struct(a.alias("min_x"), b.alias("max_x"), c.alias("min_y"), d.alias("max_y"))

    x0, x1, y0, y1 = (F.col(s) for s in SIDES)
    zero, mid0, mid1 = F.lit(0).cast("bigint"), F.greatest(y0, F.lit(0)), F.least(y1, F.lit(height - 1))
    parts = [rect(x0, x1, y0, F.least(y1, zero - 1)), rect(x0, x1, F.greatest(y0, zero + height), y1), rect(x0, F.least(x1, zero - 1), mid0, mid1), rect(F.greatest(x0, zero + width), x1, mid0, mid1)]
    return areas.select(key, F.explode(F.array(*parts)).alias("r")).select(key, "r.*").where("min_x <= max_x AND min_y <= max_y")


def live_frames(frames: DataFrame, capacity: int, key: str = "frame_seq") -> DataFrame:
    """step, live: the frames that a buffer of so many frames holds after each append."""
    ranked = running(frames.select(key), key).select(key, F.col("row").alias("n"))
    held = ranked.select(F.col(key).alias("live"), F.explode(F.sequence(F.col("n"), F.col("n") + capacity - 1)).alias("n"))
    return ranked.join(held, "n").select(F.col(key).alias("step"), "live")


def running(rows: DataFrame, order: str, value: str | None = None) -> DataFrame:
    """Adds row (from 1) and, for a value, before: its sum over all earlier rows, in the order of a column.

    Rows are dealt by ranges of the order and each range is numbered by itself; the ranges' totals, as many as there are tasks, make the offsets.
    """
    ranged = stored(rows.repartitionByRange(order).withColumn("range_", F.spark_partition_id()), "ranges")
    v = F.col(value) if value else F.lit(0).cast("bigint")
    totals = ranged.groupBy("range_").agg(F.count("*").alias("n_"), F.sum(v).alias("v_"))
    earlier = Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("range_", F.coalesce(F.sum("n_").over(earlier), F.lit(0)).alias("rows_"), F.coalesce(F.sum("v_").over(earlier), F.lit(0)).alias("sum_"))
    within = Window.partitionBy("range_").orderBy(order)
    own = ranged.withColumns({"row_": F.row_number().over(within), "own_": F.coalesce(F.sum(v).over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    out = own.join(offsets, "range_").withColumn("row", F.col("rows_") + F.col("row_"))
    out = out.withColumn("before", F.col("sum_") + F.col("own_")) if value else out
    return out.drop("range_", "rows_", "sum_", "row_", "own_")


def checked_apart(rois: DataFrame, key: str = "roi_index") -> DataFrame:
    """The rectangles, an error if any two of them overlap."""
    found = roi_overlaps(rois, key).agg(F.min(F.struct("i", "j")).alias("pair_"))
    text = F.concat(F.lit("rectangles overlap: "), F.col("pair_.i").cast("string"), F.lit(" and "), F.col("pair_.j").cast("string"))
    first = F.col(rois.columns[0])
    return rois.join(F.broadcast(found)).withColumn(rois.columns[0], F.when(F.col("pair_").isNull(), first).otherwise(F.raise_error(text).cast(rois.schema[0].dataType))).drop("pair_")


def relative(rect: tuple, other: tuple) -> tuple[Column, ...]:
    """The rectangle (min_x, max_x, min_y, max_y) seen from another's first corner."""
    a, b, c, d = rect
    x, _, y, _ = other
    return a - x, b - x, c - y, d - y


def frames_per_series(width, height, frame_x: int, frame_y: int, sequence: str | None = None) -> Column:
    """How many frames a row or column of the scan has over a whole level or input roi; without a scan as for rows."""
    across, down = divide_ceil(width, F.lit(frame_x)), divide_ceil(height, F.lit(frame_y))
    if sequence is None or sequence.startswith("ROWS"):
        return across
    if sequence.startswith("COLUMNS"):
        return down
    w, h = (v if isinstance(v, Column) else F.col(v) for v in (width, height))
    return F.when(w <= h if sequence == "SHORTEST_SIDE" else w >= h, across).otherwise(down)


def expanded(rects: DataFrame, border: int) -> DataFrame:
    """The rectangles grown by a border on every side."""
    return rects.withColumns({"min_x": F.col("min_x") - border, "max_x": F.col("max_x") + border, "min_y": F.col("min_y") - border, "max_y": F.col("max_y") + border})


def shifted(rects: DataFrame, x: int, y: int) -> DataFrame:
    """The rectangles moved, as where an image lies in an extended one."""
    return rects.withColumns({"min_x": F.col("min_x") + x, "max_x": F.col("max_x") + x, "min_y": F.col("min_y") + y, "max_y": F.col("max_y") + y})


def rotated(rects: DataFrame, angle: int, width, height) -> DataFrame:
    """Where the rectangles of an image of width x height lie after its rotation clockwise by 0, 90, 180 or 270 degrees."""
    back = {90: 270, 270: 90}.get(angle, angle)
    w, h = (v if isinstance(v, Column) else F.lit(v) for v in (width, height))
    wide, high = (h, w) if angle in (90, 270) else (w, h)
    x0, y0 = rotate_point(F.lit(back), F.col("min_x"), F.col("min_y"), wide, high, pixel=True)
    x1, y1 = rotate_point(F.lit(back), F.col("max_x"), F.col("max_y"), wide, high, pixel=True)
    return rects.withColumns({"min_x": F.least(x0, x1), "max_x": F.greatest(x0, x1), "min_y": F.least(y0, y1), "max_y": F.greatest(y0, y1)})


def actual_rectangles(sizes: DataFrame, own: DataFrame | None = None, key: str = "pyramid_id") -> DataFrame:
    """key and the rectangles with data at level 0: a pyramid's own, else all of it; an empty one without its own has none. sizes: key, dim_x, dim_y."""
    whole = sizes.where("dim_x > 0 AND dim_y > 0").select(key, F.lit(0).cast("bigint").alias("min_x"), (F.col("dim_x") - 1).alias("max_x"), F.lit(0).cast("bigint").alias("min_y"), (F.col("dim_y") - 1).alias("max_y"))
    if own is None:
        return whole
    own = own.select(key, *SIDES)
    return own.unionByName(whole.join(own.select(key).distinct(), key, "left_anti"))


def boundaries(rects: DataFrame, *keys: str) -> DataFrame:
    """keys and the vertices (x, y) of the rectangles' outlines: four inclusive corners, clockwise from the first."""
    a, b, c, d = (F.col(s) for s in SIDES)
    return rects.select(*keys, F.posexplode(F.array(*(F.struct(x.alias("x"), y.alias("y")) for x, y in ((a, c), (b, c), (b, d), (a, d))))).alias("vertex", "p")).select(*keys, "vertex", "p.x", "p.y")
