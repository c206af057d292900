"""Queries of pyramid planning, buffers and recognition."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.operators import buffer as M
from tessera.operators import pyramid as Y
from tessera.operators import raster as R
from tessera.operators import recognise as Q
from tessera.operators import rects as B
from tessera.plans.catalog import query
from tessera.plans.views import WIDTH


def _lists(v):
    """A file list for each region: the nations in it, as trimmed lines or as JSON."""
    names = v.table("nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("names"))
    lines, json = F.array_join("names", " \n\n "), F.to_json("names")
    return names.select(F.col("n_regionkey").alias("k"), F.when(F.col("n_regionkey") % 2 == 0, lines).otherwise(json).alias("list"))


@query("select n_regionkey as k, row_number() over (partition by n_regionkey order by n_name) - 1 as pyramid_index, n_name as path from nation")
def pyramid_file_list(v):
    return Y.file_list(_lists(v), "k", "list")


def _levels(v):
    """Three levels for each supplier: its width and height over powers of two."""
    k = F.col("s_suppkey")
    base = v.table("supplier").select(k.alias("pyramid_id"), (k * 37 % 3000 + 400).alias("w"), (k * 53 % 2000 + 300).alias("hh"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("level"))
    side = lambda c: F.floor(F.col(c) / F.pow(F.lit(2), F.col("level"))).cast("bigint")
    return base.select("pyramid_id", "level", side("w").alias("dim_x"), side("hh").alias("dim_y"))


_LEVELS = "select s_suppkey as pyramid_id, l as level, (s_suppkey * 37 % 3000 + 400) // (1 << l) as dim_x, (s_suppkey * 53 % 2000 + 300) // (1 << l) as dim_y from supplier cross join (select unnest(range(0, 3))::int as l)"


@query(f"with l as ({_LEVELS}) select pyramid_id, count(*) as n_levels, max(dim_x) filter (where level = 1) as level_dim_x, max(dim_y) filter (where level = 1) as level_dim_y, cast(((max(dim_x) filter (where level = 1) + 255) // 256) * ((max(dim_y) filter (where level = 1) + 255) // 256) as bigint) as n_frames, (max(dim_x) filter (where level = 1) + 255) // 256 as frames_per_series, (max(dim_x) filter (where level = 1) + 255) // 256 + 2 as n_stored from l group by pyramid_id")
def pyramid_info(v):
    return Y.info(_levels(v), 1, 256, 256)


@query(f"with l as ({_LEVELS}) select pyramid_id, 0 as min_x, least(-30 + 700 - 1, dim_x - 1) as max_x, 50 as min_y, least(50 + 500 - 1, dim_y - 1) as max_y from l where level = 1")
def area_to_read(v):
    return Y.area_to_read(_levels(v), 1, -30, 50, 700, 500)


def _two_rois(v):
    """Two rectangles for each pyramid, the second partly outside of most."""
    at = v.table("supplier").select(F.col("s_suppkey").alias("pyramid_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("roi_index"))
    return at.selectExpr("pyramid_id", "roi_index", "roi_index * 350L - 20 as min_x", "roi_index * 350L + 310 as max_x", "roi_index * 200L + 10 as min_y", "roi_index * 200L + 290 as max_y")


_CLIPPED = f"l as ({_LEVELS}), r as (select pyramid_id, i as roi_index, greatest(i * 350 - 20, 0) as min_x, least(i * 350 + 310, dim_x - 1) as max_x, i * 200 + 10 as min_y, least(i * 200 + 290, dim_y - 1) as max_y from l cross join (select unnest([0, 1]) as i) where level = 0), q as (select * from r where min_x <= max_x and min_y <= max_y)"


@query(f"with {_CLIPPED}, t as (select q.*, a.i as tx, b.i as ty from q cross join (select unnest(range(0, 4)) as i) a cross join (select unnest(range(0, 4)) as i) b where q.min_x + a.i * 128 <= q.max_x and q.min_y + b.i * 96 <= q.max_y) select pyramid_id, roi_index, tx * ((max_y - min_y + 96) // 96) + ty as frame_index, min_x + tx * 128 as min_x, least(min_x + tx * 128 + 127, max_x) as max_x, min_y + ty * 96 as min_y, least(min_y + ty * 96 + 95, max_y) as max_y from t")
def areas_to_scan(v):
    return Y.areas_to_scan(_levels(v), 0, _two_rois(v), 128, 96, "COLUMNS_TOP_TO_BOTTOM", False)


@query(f"with {_CLIPPED} select pyramid_id, roi_index, 0 as frame_index, min_x, max_x, min_y, max_y from q")
def whole_rois(v):
    return Y.areas_to_scan(_levels(v), 0, _two_rois(v), 128, 96, None)


@query("""with s as (select roi_index as k, max_x - min_x + 1 as w, max_y - min_y + 1 as hh from rois), n as (select *, (w + 31) // 32 as across, (hh + 23) // 24 as down from s)
    select k, across as none, across as rows, across as rows_snake, down as cols, case when w <= hh then across else down end as shortest, case when w >= hh then across else down end as shortest_snake from n""", ("rois",))
def frames_per_series(v):
    sized = v.rois.selectExpr("roi_index as k", "max_x - min_x + 1 as w", "max_y - min_y + 1 as hh")
    kinds = {"none": None, "rows": "ROWS_LEFT_TO_RIGHT", "rows_snake": "ROWS_BY_SNAKE", "cols": "COLUMNS_TOP_TO_BOTTOM", "shortest": "SHORTEST_SIDE", "shortest_snake": "SHORTEST_SIDE_BY_SNAKE"}
    return sized.select("k", *(B.frames_per_series("w", "hh", 32, 24, s).alias(n) for n, s in kinds.items()))


@query("select roi_index, min_x % 17 as min_x, max_x - (min_x - min_x % 17) as max_x, min_y % 11 as min_y, max_y - (min_y - min_y % 11) as max_y from rois", ("rois",))
def relative_rect(v):
    """Rectangles seen from the first corner of the larger ones around them."""
    own = tuple(F.col(s) for s in B.SIDES)
    around = (own[0] - own[0] % 17, own[1] + 5, own[2] - own[2] % 11, own[3] + 5)
    return v.rois.select("roi_index", *(x.alias(n) for x, n in zip(B.relative(own, around), B.SIDES, strict=True)))


@query(f"""with l as ({_LEVELS}), w as (select pyramid_id, case when pyramid_id % 3 = 0 then 40 else 0 end as x0, case when pyramid_id % 3 = 0 then least(260, dim_x - 1) else dim_x - 1 end as x1, case when pyramid_id % 3 = 0 then 30 else 0 end as y0, case when pyramid_id % 3 = 0 then least(140, dim_y - 1) else dim_y - 1 end as y1, dim_x, dim_y from l where level = 1),
    z as (select pyramid_id, dim_x as big_x, dim_y as big_y from l where level = 0),
    s as (select w.*, i as roi_index, cast(floor((i * 300 + 20) * (dim_x / cast(big_x as double)) + 0.5) as bigint) as l, cast(ceil(200 * (dim_x / cast(big_x as double))) as bigint) as ww, cast(floor((i * 150 + 50) * (dim_y / cast(big_y as double)) + 0.5) as bigint) as t, cast(ceil(120 * (dim_y / cast(big_y as double))) as bigint) as hh from w join z using (pyramid_id) cross join (select unnest([0, 1]) as i) where pyramid_id % 2 = 0),
    m as (select pyramid_id, roi_index, greatest(l, x0) as min_x, least(l + ww - 1, x1) as max_x, greatest(t, y0) as min_y, least(t + hh - 1, y1) as max_y from s),
    a as (select * from m where min_x <= max_x and min_y <= max_y union all select pyramid_id, 0, x0, x1, y0, y1 from w where pyramid_id % 2 = 1)
    select * from a where max_x - min_x >= 19 and max_y - min_y >= 19""")
def level_rois(v):
    """Metadata for every second pyramid, a given rectangle for every third; at least 20 pixels on both sides."""
    k = v.table("supplier").select(F.col("s_suppkey").alias("pyramid_id"))
    meta = k.where("pyramid_id % 2 = 0").select("pyramid_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("roi_index")).selectExpr("pyramid_id", "roi_index", "roi_index * 300L + 20 as min_x", "roi_index * 300L + 219 as max_x", "roi_index * 150L + 50 as min_y", "roi_index * 150L + 169 as max_y")
    given = k.where("pyramid_id % 3 = 0").selectExpr("pyramid_id", "40L as min_x", "260L as max_x", "30L as min_y", "140L as max_y")
    return Y.level_rois(_levels(v), 1, meta, given, 20)


@query("select o_orderkey as k, a >= 0 and b >= 0 and a <= c and b <= c + 3 and c <= 900 and c + 3 <= 800 as ok from (select o_orderkey, o_orderkey % 997 - 3 as a, o_custkey % 37 - 1 as b, o_custkey % 911 as c from orders)")
def range_is_valid(v):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return v.table("orders").select(k.alias("k"), Y.range_is_valid(k % 997 - 3, c % 37 - 1, c % 911, c % 911 + 3, F.lit(900), F.lit(800)).alias("ok"))


@query("select s_suppkey as k, s_suppkey % 90 + 32 as x, s_suppkey % 70 + 40 as y from supplier")
def frame_size(v):
    k = F.col("s_suppkey")
    x, y = Y.frame_size(k % 90 + 32, k % 70 + 40, 32)
    return v.table("supplier").select(k.alias("k"), x.alias("x"), y.alias("y"))


@query("select x, y, case when (x // 16 + y // 16) % 2 = 0 then 127 else v end as v from px", ("px",))
def skip_filler(v):
    coarse = (S.floor_div("x", F.lit(16)) + S.floor_div("y", F.lit(16))) % 2 == 0
    return Y.skip_coarse(v.px, coarse, 0.5, 255)


@query("select x, y, coalesce(v, 0) as v from (select unnest(range(50, 90)) as x) a cross join (select unnest(range(-3, 30)) as y) b left join (select x // 2 as x, y // 2 as y, max(v) as v from px where y < (select (h // 2) * 2 from h) group by 1, 2) p using (x, y)", ("px",))
def memory_pyramid(v):
    """An area of the second level, partly outside of it."""
    return Y.memory_read(R.build_pyramid(v.px, WIDTH, v.height, 2, 1).where("level < 3"), 1, (50, 89, -3, 29))


def _sizes(v):
    return _levels(v).where("level = 0").select("pyramid_id", "dim_x", "dim_y")


_ACTUAL = "a as (select s_suppkey as k, s_suppkey * 37 % 3000 + 400 as w, s_suppkey * 53 % 2000 + 300 as hh from supplier), r as (select k, w, hh, 0 as x0, w - 1 as x1, 0 as y0, hh - 1 as y1 from a where k % 4 <> 0 union all select k, w, hh, 10 + 100 * i, 90 + 100 * i, 20, 120 from a cross join (select unnest([0, 1]) as i) where k % 4 = 0)"


def _actual(v):
    own = _sizes(v).where("pyramid_id % 4 = 0").select("pyramid_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("i")).selectExpr("pyramid_id", "10L + 100 * i as min_x", "90L + 100 * i as max_x", "20L as min_y", "120L as max_y")
    return B.actual_rectangles(_sizes(v), own)


@query(f"with {_ACTUAL} select k as pyramid_id, x0 + 7 as min_x, x1 + 7 as max_x, y0 - 5 as min_y, y1 - 5 as max_y from r")
def actual_rectangles(v):
    """Rectangles with data, moved as the pyramid is in an extended one."""
    return B.shifted(_actual(v), 7, -5)


@query(f"with {_ACTUAL} select k as pyramid_id, hh - 1 - y1 as min_x, hh - 1 - y0 as max_x, x0 as min_y, x1 as max_y from r")
def rotated_rectangles(v):
    found = _actual(v).join(_sizes(v), "pyramid_id")
    return B.rotated(found, 90, F.col("dim_x"), F.col("dim_y")).select("pyramid_id", *B.SIDES)


@query(f"with {_ACTUAL} select k as pyramid_id, x0 as first_x, 0 as vertex, x0 as x, y0 as y from r union all select k, x0, 1, x1, y0 from r union all select k, x0, 2, x1, y1 from r union all select k, x0, 3, x0, y1 from r")
def actual_boundaries(v):
    return B.boundaries(_actual(v).withColumn("first_x", F.col("min_x")), "pyramid_id", "first_x")


@query("select x, y, case when x between 20 and 60 and y between 2 and 8 then v when x between 17 and 63 and y between -1 and 11 then 163 else 255 end as v from px", ("px",))
def bordered_area(v):
    """The raster where it has data, a border of three pixels around that, the background elsewhere."""
    data = v.spark.range(1).selectExpr("20L as min_x", "60L as max_x", "2L as min_y", "8L as max_y")
    flag = lambda rects, name: R.pixels_in_frames(v.px, rects).select("x", "y", F.lit(True).alias(name))
    marked = v.px.join(flag(data, "own"), ["x", "y"], "left").join(flag(B.expanded(data, 3), "near"), ["x", "y"], "left")
    return marked.select("x", "y", F.when(F.col("own"), F.col("v")).when(F.col("near"), 163).otherwise(255).cast("bigint").alias("v"))


@query(f"with l as ({_LEVELS}) select pyramid_id, level, dim_x / cast(max(dim_x) filter (where level = 0) over (partition by pyramid_id) as double) as sx, dim_y / cast(max(dim_y) filter (where level = 0) over (partition by pyramid_id) as double) as sy from l")
def level_scale(v):
    return Y.level_scales(_levels(v))


@query(f"with l as ({_LEVELS}) select pyramid_id, max(level) filter (where pow(2, level) <= 3.5) as level, 3.5::double / pow(2, max(level) filter (where pow(2, level) <= 3.5)) as left_over from l group by pyramid_id")
def level_for_compression(v):
    return Y.level_for(_levels(v), 3.5, 2)


@query(f"with l as ({_LEVELS}) select pyramid_id, case when pyramid_id % 2 = 0 then 'LABEL' else 'LEVEL ' || max(level) end as image from l group by pyramid_id")
def special_image(v):
    have = _levels(v).select("pyramid_id").distinct().where("pyramid_id % 2 = 0").select("pyramid_id", F.lit("LABEL_ONLY_IMAGE").alias("kind"), F.lit("LABEL").alias("image"))
    smallest = _levels(v).select("pyramid_id", "level", F.concat(F.lit("LEVEL "), F.col("level").cast("string")).alias("image"))
    return Y.special_image(have, smallest, "LABEL_ONLY_IMAGE")


@query(f"with l as ({_LEVELS}), r as (select pyramid_id, ((dim_x + 255) // 256) as nx, ((dim_y + 255) // 256) as ny from l where level = 0) select pyramid_id, y * nx + x as frame_index, x as x_index, y as y_index from r, (select unnest(range(0, 20)) as x) a, (select unnest(range(0, 20)) as y) b where x < nx and y < ny")
def scan_index(v):
    whole = _levels(v).where("level = 0").select(F.col("pyramid_id").alias("roi_index"), F.lit(0).cast("bigint").alias("min_x"), (F.col("dim_x") - 1).alias("max_x"), F.lit(0).cast("bigint").alias("min_y"), (F.col("dim_y") - 1).alias("max_y"))
    order = B.scan_order(B.tile_grid(whole, 256, 256, False), "ROWS_LEFT_TO_RIGHT")
    return order.select(F.col("roi_index").alias("pyramid_id"), "frame_index", F.col("tx").alias("x_index"), F.col("ty").alias("y_index"))


@query("select distinct s_suppkey as pyramid_id, l as level, (s_suppkey * 37 % 3000 + 400) // (1 << l) as dim_x, (s_suppkey * 53 % 2000 + 300) // (1 << l) as dim_y from supplier cross join (select unnest(range(0, 12))::int as l) where l = 0 or ((s_suppkey * 37 % 3000 + 400) // (1 << l) >= 256 or (s_suppkey * 53 % 2000 + 300) // (1 << l) >= 256) and (s_suppkey * 37 % 3000 + 400) // (1 << l) >= 1")
def svs_virtual_levels(v):
    return Y.virtual_levels(_levels(v).where("level = 0").drop("level"))


@query("select case when max(case when k % 5 = 0 then 6 when k % 3 = 0 then 2 else 1 end) = 6 then 'f64' else 'u16' end as kind from (select s_suppkey as k from supplier)")
def best_precision(v):
    k = F.col("s_suppkey")
    return R.best_precision(v.table("supplier").select(F.when(k % 5 == 0, "f64").when(k % 3 == 0, "u16").otherwise("u8").alias("kind")), "kind")


@query("select s_suppkey as k, c as channel, (s_suppkey * 3 + case when s_suppkey % 2 = 0 then c else 0 end)::double as v from supplier cross join (select unnest(range(0, 3)) as c)")
def channel_convert(v):
    from tessera.sources.tiff import channel_convert as convert

    k = F.col("s_suppkey")
    px = v.table("supplier").select(k.alias("k"), F.explode(F.when(k % 2 == 0, F.array(F.lit(0), F.lit(1), F.lit(2))).otherwise(F.array(F.lit(0)))).alias("channel"))
    return convert(px.withColumn("v", (F.col("k") * 3 + F.col("channel")).cast("double")), 3)


@query("select x, y, cast(quantile_disc(v, 0.5) as bigint) as v from (select p.x, p.y, n.v from px p join (select unnest([-1, 0, 1]) as dx) a on true join (select unnest([-1, 0, 1]) as dy) b on true join px n on n.x = least(greatest(p.x + dx, 0), 127) and n.y = least(greatest(p.y + dy, 0), (select h - 1 from h))) group by x, y", ("px",))
def median_filter(v):
    return Q.median_filter(v.px, 1)


@query("select a.x, a.y from px a join px b on b.x between a.x and a.x + 2 and b.y between a.y and a.y + 2 and b.v % 5 <> 0 group by a.x, a.y having count(*) = 9", ("px",))
def erosion(v):
    marked = v.px.withColumn("v", F.when(F.col("v") % 5 != 0, 1).otherwise(0))
    return Q.erosion(marked, 3).where("x >= 0 AND y >= 0")


def _macro(v):
    """A dark object on each strip of 64 rows of a bright raster, its corner at (12, 10)."""
    y = F.col("y") % 64
    dark = (F.col("x") >= 12) & (y >= 10)
    return v.px.select(S.floor_div("y", F.lit(64)).alias("strip"), "x", y.alias("y"), F.when(dark, 30 + F.col("v") % 9).otherwise(220 + F.col("v") % 9).alias("v"))


_SMALL = Q.Search(along_x=12, along_y=8, least_along=4, background_x=6, background_y=6)


@query()
def corner_quality(v):
    return Q.corner_qualities(_macro(v), "strip", _SMALL)


@query()
def best_corner(v):
    """The best corner over all strips' qualities."""
    return Q.best_corner(Q.corner_qualities(_macro(v), "strip", _SMALL))


@query()
def quality_map(v):
    return Q.quality_map(_macro(v), Q.corner_qualities(_macro(v), "strip", _SMALL), "strip", 100.0)


@query("""with m as (select y // 64 as strip, x, y % 64 as y, case when x >= 12 and y % 64 >= 10 then 30 + v % 9 else 220 + v % 9 end as v, max(y % 64) over (partition by y // 64) as top from px)
    select strip, x, y, case when y >= 5 and y < least(13, top) and abs(x - 8) <= 20 then cast(floor(0.5 * 255 * (20 - abs(x - 8)) / 20.0) as bigint) when x >= 8 and x < least(20, 127) and abs(y - 5) <= 20 then cast(floor(0.5 * 255 * (20 - abs(y - 5)) / 20.0) as bigint) else v end as v from m""", ("px",))
def draw_corner(v):
    at = _macro(v).select("strip").distinct().selectExpr("strip", "8L as x", "5L as y")
    return Q.draw_corner(_macro(v), at, "strip", 0.5, _SMALL)


@query("select x, y, cast(floor((v + v * 3 % 256 + (x + y) % 200) / 3.0) as bigint) as v from px", ("px",))
def gray_macro(v):
    bands = F.array(F.col("v"), F.col("v") * 3 % 256, (F.col("x") + F.col("y")) % 200)
    return Q.gray_macro(v.px.select("x", "y", F.posexplode(bands).alias("band", "v")), 255.0)


@query()
def pack_squares_fixed(v):
    return Q.pack_squares(v.px.select((S.floor_div("y", F.lit(64))).alias("strip"), "x", (F.col("y") % 64).alias("y"), (F.col("v") % 11).alias("v")), "strip", 3)


@query()
def largest_squares(v):
    return Q.pack_squares(v.px.select((S.floor_div("y", F.lit(64))).alias("strip"), "x", (F.col("y") % 64).alias("y"), (F.col("v") % 11).alias("v")), "strip", 3, True)


def _events(v):
    """Every frame of labels appended to one of four buffers, by column, each storing three. Frames of a buffer have one size: the raster's last rows, if fewer than 32, are filled with background."""
    cells = v.lab.groupBy("frame_seq").agg(F.collect_list(F.struct("y", "x", "label")).alias("c"))
    x0, y0 = (F.col("frame_seq") % 4) * 32, S.floor_div("frame_seq", F.lit(4)) * 32
    at = F.transform("c", lambda p: F.struct(((p["y"] - y0) * 32 + p["x"] - x0).alias("at"), p["label"].alias("label")))
    filled = F.transform(F.array_sort(F.concat(at, F.transform(F.array_except(F.sequence(F.lit(0).cast("bigint"), F.lit(1023).cast("bigint")), F.transform(at, lambda p: p["at"])), lambda k: F.struct(k.alias("at"), F.lit(0).cast("bigint").alias("label"))))), lambda p: p["label"])
    frames = cells.select((F.col("frame_seq") % 4).alias("buffer_id"), (S.floor_div("frame_seq", F.lit(4)) + 1).alias("seq"), F.lit("FRAME").alias("kind"), F.lit(None).cast("int").alias("capacity"), F.lit(None).cast("boolean").alias("reset"), x0.alias("min_x"), y0.alias("min_y"), F.lit(32).alias("w"), F.lit(32).alias("h"), filled.alias("labels"))
    start = frames.select("buffer_id").distinct().selectExpr("buffer_id", "0L as seq", "'INIT' as kind", "3 as capacity", "false as reset", "cast(null as bigint) as min_x", "cast(null as bigint) as min_y", "cast(null as int) as w", "cast(null as int) as h", "cast(null as array<bigint>) as labels")
    return start.unionByName(frames)


@query()
def buffer_replay(v):
    return M.replay(_events(v))


@query("""with n as (select (h + 31) // 32 as frames from h), b as (select frame_seq % 4 as buffer_id, frame_seq // 4 as k, max(label) as mx from lab group by 1, 2),
    c as (select buffer_id, k, coalesce(sum(mx) over (partition by buffer_id order by k rows between unbounded preceding and 1 preceding), 0) as base from b),
    l as (select frame_seq % 4 as buffer_id, frame_seq // 4 as k, x, y, label from lab)
    select l.buffer_id, n.frames + 1 as seq, l.x, l.y, cast(case when l.label = 0 or l.k < n.frames - 3 then 0 else l.label + c.base end as bigint) as v from l join c using (buffer_id, k), n
    where l.y >= greatest(n.frames - 4, 0) * 32""", ("lab",))
def buffer_reads(v):
    """What each buffer holds of its last four frames' places after the last append: the last three frames, zero above."""
    n = -(-v.height // 32)
    top, high = max(n - 4, 0) * 32, v.height - max(n - 4, 0) * 32
    ask = v.spark.range(4).selectExpr("id as buffer_id", f"{n + 1}L as seq", "'READ' as kind", "cast(null as int) as capacity", "false as reset", "id * 32 as min_x", f"{top}L as min_y", "32 as w", f"{high} as h", "cast(null as array<bigint>) as labels")
    return M.reads(_events(v).unionByName(ask))


@query()
def buffer_partial(v):
    """Every frame jointed after its append; the correlation table of each buffer at the end."""
    events = _events(v)
    events = events.withColumn("seq", F.col("seq") * 2)
    joints = events.where("kind = 'FRAME'").withColumns({"seq": F.col("seq") + 1, "kind": F.lit("JOINT"), "labels": F.lit(None).cast("array<bigint>")})
    return M.correlation_tables(events.unionByName(joints))


@query("select (y // 32) * 4 + x // 32 as frame_seq, x, y, v from px qualify row_number() over (partition by y // 32, x // 32 order by v desc, y, x) = 1", ("px",))
def frame_maximum(v):
    at = (S.floor_div("y", F.lit(32)) * 4 + S.floor_div("x", F.lit(32))).alias("frame_seq")
    return v.px.groupBy(at).agg(F.max_by(F.struct("x", "y", "v"), F.struct("v", -F.col("y"), -F.col("x"))).alias("b")).select("frame_seq", "b.*")


_HALF = "select x // 2 as x, y // 2 as y, max(v) as v from px where y < (select (h // 2) * 2 from h) group by 1, 2"


@query(f"""with l as ({_HALF}), t as (select v, i as x, least(4 * (x + 1), 5 * (i + 1)) - greatest(4 * x, 5 * i) as wx, y from l cross join (select unnest(range(0, 51)) as i) where 5 * i < 4 * (x + 1) and 5 * (i + 1) > 4 * x),
    u as (select v, x, wx, j as y, least(4 * (y + 1), 5 * (j + 1)) - greatest(4 * y, 5 * j) as wy from t cross join (select unnest(range(0, (select (h // 2) * 4 // 5 from h))) as j) where 5 * j < 4 * (y + 1) and 5 * (j + 1) > 4 * y)
    select x, y, cast(sum(v * wx * wy) as bigint) // cast(sum(wx * wy) as bigint) as v from u group by x, y""", ("px",))
def read_compressed(v):
    """The raster at a compression of 2.5: from the second level, 1.25 times."""
    sizes = R.level_sizes(WIDTH, v.height, 2, 1)[:3]
    levels = R.build_pyramid(v.px, WIDTH, v.height, 2, 1).where("level < 3")
    return R.read_compressed(levels, sizes, 5, 2)


@query("select a.x, b.y, case when p.v is not null then cast(floor(p.v * (255.0::double / 250)) as bigint) when a.x + 100 <= 127 and b.y - 4 between 0 and (select h - 1 from h) then 0 else 243 end as v from (select unnest(range(0, 60)) as x) a cross join (select unnest(range(0, 30)) as y) b left join px p on p.x = a.x + 100 and p.y = b.y - 4", ("px",))
def display_image(v):
    return R.displayed(v.px, (100, 159, -4, 25), WIDTH, v.height, 250, 243)


@query("select x, y, v from px", ("px",))
def pass_through(v):
    """What is given isn't read again."""
    from tessera.sources.pyramids import given_or_read

    return given_or_read(v.px, lambda: v.table("missing"))


@query()
def pack_squares_limited(v):
    """At most five squares a strip, which overlap by one pixel."""
    return Q.pack_squares(v.px.select((S.floor_div("y", F.lit(64))).alias("strip"), "x", (F.col("y") % 64).alias("y"), (F.col("v") % 11).alias("v")), "strip", 3, False, 1, 5)


@query()
def buffer_controls(v):
    """The frames of each buffer with a smaller store from the second on, all dropped after the third, the buffer forgotten after the fourth."""
    events = _events(v).withColumn("seq", F.col("seq") * 2)
    controls = v.spark.range(4).selectExpr("id as buffer_id", "explode(array(struct(5L as seq, 'CAPACITY' as kind, 1 as capacity, false as reset), struct(7L as seq, 'CLEAR' as kind, 0 as capacity, false as reset), struct(9L as seq, 'REMOVE' as kind, 0 as capacity, true as reset))) as e").select("buffer_id", "e.*")
    controls = controls.selectExpr("buffer_id", "seq", "kind", "capacity", "reset", "cast(null as bigint) as min_x", "cast(null as bigint) as min_y", "cast(null as int) as w", "cast(null as int) as h", "cast(null as array<bigint>) as labels")
    return M.replay(events.unionByName(controls))
