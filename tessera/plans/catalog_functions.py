"""Queries of scalar functions, slides, regions of interest, graphs and pyramid planning."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.operators import graph as G
from tessera.operators import labels as L
from tessera.operators import pyramid as Y
from tessera.operators import rects as B
from tessera.operators import rois as P
from tessera.operators import slide as D
from tessera.plans.catalog import query

_O = "select o_orderkey as k, o_custkey as c, o_orderkey % 997 as a, o_custkey % 37 + 1 as b from orders"
_DIRS = ("LEFT_UP", "RIGHT_UP", "LEFT_DOWN", "RIGHT_DOWN", "EXPAND")


def _o(v):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return v.table("orders").select(k.alias("k"), c.alias("c"), (k % 997).alias("a"), (c % 37 + 1).alias("b"))


def _pick(names, column):
    return F.element_at(F.array(*(F.lit(n) for n in names)), (column % len(names) + 1).cast("int"))


def _pick_sql(names, column):
    return "(['" + "', '".join(names) + f"'])[{column} % {len(names)} + 1]"


@query(f"with o as ({_O}) select k, (a + b - 1) // b as n from o")
def divide_ceil(v):
    return _o(v).select("k", S.divide_ceil("a", "b").alias("n"))


@query(f"with o as ({_O}) select k, case when a = 0 then b when a % b = 0 then b else (a + (a + b - 1) // b - 1) // ((a + b - 1) // b) end as cell from o")
def equalize_grid(v):
    return _o(v).select("k", S.equalize_grid("a", "b").alias("cell"))


@query(f"with o as ({_O}) select k, cast(floor((a - 500) / 8.0 + 0.5) as bigint) as r from o")
def round_half_up(v):
    return _o(v).select("k", S.round_half_up((F.col("a") - 500) / 8.0).alias("r"))


@query(f"with o as (select *, {_pick_sql(_DIRS[:4], 'k')} as d from ({_O})) select k, case when d like 'LEFT%' then -a else a end as x, case when d like '%UP' then -b else b end as y from o")
def direction_shift(v):
    x, y = S.direction_shift(_pick(_DIRS[:4], F.col("k")), "a", "b")
    return _o(v).select("k", x.alias("x"), y.alias("y"))


@query(f"with o as (select *, {_pick_sql(_DIRS, 'k')} as d from ({_O})) select k, case when d = 'EXPAND' then a - 3 when d like 'LEFT%' then a - 3 else a + 3 end as min_x, case when d = 'EXPAND' then a + b + 3 when d like 'LEFT%' then a + b - 3 else a + b + 3 end as max_x, case when d = 'EXPAND' then c - 5 when d like '%UP' then c - 5 else c + 5 end as min_y, case when d = 'EXPAND' then c + b + 5 when d like '%UP' then c + b - 5 else c + b + 5 end as max_y from o")
def change_rect(v):
    sides = S.change_rect(_pick(_DIRS, F.col("k")), ("a", F.col("a") + F.col("b"), "c", F.col("c") + F.col("b")), F.lit(3), F.lit(5))
    return _o(v).select("k", *(s.alias(n) for s, n in zip(sides, B.SIDES, strict=True)))


_SEQ = ("ROWS_LEFT_TO_RIGHT", "ROWS_BY_SNAKE", "COLUMNS_TOP_TO_BOTTOM", "COLUMNS_BY_SNAKE")


@query(f"with o as (select *, {_pick_sql(_SEQ, 'k')} as s from ({_O})) select k, case when s = 'ROWS_BY_SNAKE' and a % 2 = 1 then 'RIGHT_UP' when s = 'COLUMNS_BY_SNAKE' and a % 2 = 1 then 'LEFT_DOWN' else 'LEFT_UP' end as d from o")
def recommended_expansion(v):
    return _o(v).select("k", S.recommended_expansion(_pick(_SEQ, F.col("k")), "b", "a").alias("d"))


@query(f"with o as ({_O}) select k, case when a = 0 then 0 else a + c end as label from o")
def add_index_base(v):
    return _o(v).select("k", S.add_index_base("a", "c").alias("label"))


@query(f"with o as ({_O}) select k, cast(floor(a / cast(c + 9 as double) * (c * 4 + 3) + 0.5) as bigint) as x from o")
def scale_special(v):
    return _o(v).select("k", S.scale_special("a", F.col("c") + 10, F.col("c") * 4 + 4).alias("x"))


@query(f"with o as ({_O}) select k, cast(floor(a * 0.375 + 0.5) as bigint) as low, cast(ceil(b * 0.375) as bigint) as size from o")
def scale_roi(v):
    low, size = S.scale_roi("a", "b", F.lit(0.375))
    return _o(v).select("k", low.alias("low"), size.alias("size"))


@query(f"with o as (select *, (k % 4) * 90 as r from ({_O})) select k, case r when 90 then b when 180 then 996 - a when 270 then 996 - b else a end as x, case r when 90 then 699 - a when 180 then 699 - b when 270 then a else b end as y from o")
def rotate_point(v):
    x, y = S.rotate_point((F.col("k") % 4) * 90, "a", "b", F.lit(997), F.lit(700), True)
    return _o(v).select("k", x.alias("x"), y.alias("y"))


@query("select o_orderkey as k, (360 - (o_orderkey % 4) * 90) % 360 as r from orders")
def rotation_reverse(v):
    return _o(v).select("k", S.rotation_reverse((F.col("k") % 4) * 90).alias("r"))


@query(f"with recursive o as ({_O}), r as (select k, greatest(c * 5 + 1, a) as s, b + 1 as q, 0 as n, false as done from o union all select k, s // (case when q > 9 then 2 else q end), q, n + 1, s // (case when q > 9 then 2 else q end) < 100 from r where not done) select k, cast(max(n) as bigint) as n from r group by k")
def number_of_resolutions(v):
    q = F.when(F.col("b") + 1 > 9, 2).otherwise(F.col("b") + 1)
    return _o(v).select("k", S.number_of_resolutions(F.col("c") * 5 + 1, "a", q, F.lit(100)).alias("n"))


@query(f"with o as ({_O}) select k, (a < 1 or b < 1 or (a < 256 and b < 256)) as little from o")
def very_little_sizes(v):
    return _o(v).select("k", S.very_little_sizes("a", "b").alias("little"))


@query(f"with o as ({_O}) select k, ((a // 4 = c // 7 or a // 4 + 1 = c // 7) and (b // 4 = 3 or b // 4 + 1 = 3)) as ok from o")
def is_dimensions_relation_correct(v):
    return _o(v).select("k", S.is_dimensions_relation_correct("a", "b", S.floor_div("c", F.lit(7)), F.lit(3), F.lit(4)).alias("ok"))


@query(f"with o as ({_O}), t as (select k, q.i from o join (select unnest(range(2, 33)) as i) q on ((a + 400) // i = (a + 400) // (b % 9 + 1) or (a + 400) // i + 1 = (a + 400) // (b % 9 + 1)) and ((c + 300) // i = (c + 300) // (b % 9 + 1) or (c + 300) // i + 1 = (c + 300) // (b % 9 + 1))) select o.k, coalesce(min(t.i), 0) as f from o left join t on o.k = t.k group by o.k")
def find_compression(v):
    w, h, q = F.col("a") + 400, F.col("c") + 300, F.col("b") % 9 + 1
    return _o(v).select("k", S.find_compression(w, h, S.floor_div(w, q), S.floor_div(h, q)).alias("f"))


@query(f"with o as ({_O}) select k, a - a % b as min_x, a - a % b + b - 1 as max_x, c - c % b as min_y, c - c % b + b - 1 as max_y from o")
def tile_of(v):
    return _o(v).select("k", *(s.alias(n) for s, n in zip(S.tile_of(F.lit("RIGHT_DOWN"), F.col("b"), "a", "c"), B.SIDES, strict=True)))


@query(f"with o as ({_O}) select k, (select max(i) from (select unnest(range(0, 11)) as i) where pow(b + 1, i) <= a + 1) as level from o")
def max_level(v):
    return _o(v).select("k", S.max_level((F.col("a") + 1).cast("double"), (F.col("b") + 1).cast("double")).alias("level"))


@query(f"with o as ({_O}) select k, cast(case when ceil(a / 8.0) - a / 8.0 < 1e-7 then ceil(a / 8.0) else floor(a / 8.0) end as bigint) as f from o")
def safe_floor(v):
    return _o(v).select("k", S.safe_floor(F.col("a") / 8.0).alias("f"))


@query(f"with o as ({_O}) select k, case when b - 1 < 1 then b - 1 else b end as ifd from o")
def svs_level_ifd(v):
    return _o(v).select("k", S.svs_level_ifd(F.col("b") - 1).alias("ifd"))


@query(f"with o as ({_O}) select k, a + cast(floor(c * b / cast(a + 1 as double) + 0.5) as bigint) as x from o")
def whole_slide_dim_x(v):
    return _o(v).select("k", S.whole_slide_dim_x("a", "b", "c", (F.col("a") + 1).cast("double")).alias("x"))


@query(f"with o as ({_O}) select k, round(0.3::double * a + 0.59::double * b + 0.11::double * c, 6) as g from o")
def gray(v):
    return _o(v).select("k", F.round(S.gray("a", "b", "c"), 6).alias("g"))


@query(f"with o as ({_O}) select k, a * 65280.0::double / 255.0::double as v from o")
def rescale_precision(v):
    return _o(v).select("k", S.rescale_precision(F.col("a").cast("double"), F.lit(255.0), F.lit(65280.0)).alias("v"))


@query("select o_orderkey as k, case o_orderkey % 3 when 0 then 'int' when 1 then 'double' else 'string' end as kind, case o_orderkey % 3 when 0 then cast(o_custkey as double) when 1 then o_custkey + 0.5::double end as value from orders")
def parse_number_if_possible(v):
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    text = F.when(k % 3 == 0, F.concat(F.lit(" "), c)).when(k % 3 == 1, F.concat(c, F.lit(".5"))).otherwise(F.concat(F.lit("n"), c))
    kind, value = S.parse_number_if_possible(text)
    return v.table("orders").select(k.alias("k"), kind.alias("kind"), value.alias("value"))


@query("select o_orderkey as k, case o_orderkey % 3 when 0 then 'SVS' else 'IMAGE_IO' end as format from orders")
def pyramid_format(v):
    k = F.col("o_orderkey")
    path = F.concat(F.lit("/a.svs/"), k.cast("string"), F.element_at(F.array(F.lit(".SVS"), F.lit(".tiff"), F.lit("")), (k % 3 + 1).cast("int")))
    return v.table("orders").select(k.alias("k"), S.pyramid_format(path).alias("format"))


@query(f"with o as ({_O}) select k, case when k % 2 = 0 then 2 * b else b + 2 end as n from o")
def recommended_frames(v):
    return _o(v).selectExpr("k", "b", "k % 2 = 0 as snake").select("k", S.recommended_frames("snake ? 2*m : m+2", "b", "b", "snake").alias("n"))


@query(f"with o as ({_O}) select k, cast(floor(a * 0.25 + 0.5) as bigint) as x, c - a as rel from o")
def joint_expansion(v):
    return _o(v).select("k", S.round_half_up(F.col("a") * 25.0 / 100.0).alias("x"), (F.col("c") - F.col("a")).alias("rel"))


# -- slides ------------------------------------------------------------------------------------------------------------------

_TEXT = "'Maker v1' || chr(10) || p_partkey || 'x800 [0,0 1000x800]|AppMag = ' || p_size || '|MPP = 0.25|Left = 25.5|Top=23|AppMag = 99|a=b=c'"


def _described(v):
    text = F.concat(F.lit("Maker v1\n"), F.col("p_partkey").cast("string"), F.lit("x800 [0,0 1000x800]|AppMag = "), F.col("p_size").cast("string"), F.lit("|MPP = 0.25|Left = 25.5|Top=23|AppMag = 99|a=b=c"))
    return v.table("part").select(F.col("p_partkey").alias("k"), D.parse_description(text).alias("m"))


@query("select p_partkey as k, p_partkey || 'x800 [0,0 1000x800]' as common, '' || p_size as mag, 5 as n from part")
def svs_description(v):
    return _described(v).select("k", F.col("m")["CommonInfo"].alias("common"), F.col("m")["AppMag"].alias("mag"), F.size("m").alias("n"))


@query("select p_partkey as k, 0.25::double as pixel, p_size::double as mag, 25500.0::double as l, 23000.0::double as t from part")
def slide_geometry(v):
    left, top = D.on_slide("m")
    return _described(v).select("k", D.pixel_size("m").alias("pixel"), D.magnification("m").alias("mag"), left.alias("l"), top.alias("t"))


_IFDS = """select c_custkey // 6 as slide, c_custkey % 6 as ifd_index, case c_custkey % 6 when 0 then 4000 when 2 then 1000 when 3 then 250 when 1 then 200 when 4 then 300 else 150 + c_nationkey * 12 end as dim_x,
 case c_custkey % 6 when 0 then 3200 when 2 then 800 when 3 then 200 when 1 then 160 when 4 then 60 + c_nationkey * 9 else 100 end as dim_y, c_custkey % 6 in (1, 5) or c_custkey % 6 = 4 and (c_custkey // 6) % 3 <> 0 as small, c_nationkey % 2 = 0 as jpeg, c_nationkey % 3 = 0 as lzw, false as has_geometry from customer"""


def _ifds(v):
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    i = k % 6
    x = F.when(i == 0, 4000).when(i == 2, 1000).when(i == 3, 250).when(i == 1, 200).when(i == 4, 300).otherwise(n * 12 + 150)
    y = F.when(i == 0, 3200).when(i == 2, 800).when(i == 3, 200).when(i == 1, 160).when(i == 4, n * 9 + 60).otherwise(100)
    return v.table("customer").select(S.floor_div(k, F.lit(6)).alias("slide"), i.alias("ifd_index"), x.alias("dim_x"), y.alias("dim_y"), (i.isin(1, 5) | (i == 4) & (S.floor_div(k, F.lit(6)) % 3 != 0)).alias("small"), (n % 2 == 0).alias("jpeg"), (n % 3 == 0).alias("lzw"), F.lit(False).alias("has_geometry"))


_ROLE = f"""i as ({_IFDS}), r as (select *, greatest(dim_x, dim_y) / cast(least(dim_x, dim_y) as double) as ratio, dim_x * dim_y as area, max(ifd_index) over (partition by slide) as top, count(*) over (partition by slide) as n from i),
 z as (select a.slide, a.n, a.ifd_index as i2, a.small as s2, a.jpeg as j2, a.ratio as r2, a.area as a2, b.ifd_index as i1, b.small as s1, b.ratio as r1, b.area as a1 from r a left join r b on b.slide = a.slide and b.ifd_index = (select max(q.ifd_index) from r q where q.slide = a.slide and q.ifd_index < a.top) where a.ifd_index = a.top),
 w as (select *, n > 3 and s1 and s2 as pair, case when r2 > r1 then r2 else r1 end as wide from z),
 m as (select *, case when pair then case when wide > 75.0 / 26 * 0.8 and wide < 75.0 / 26 / 0.8 then (case when r1 > r2 then i1 else i2 end) else (case when a1 > a2 then i1 else i2 end) end when n > 2 and s2 then case when r2 <= 75.0 / 26 * 0.8 then (case when j2 then i2 end) when r2 < 75.0 / 26 / 0.8 then i2 end end as macro from w),
 lb as (select *, case when pair then case when macro = i1 then i2 else i1 end when n > 2 and s2 and macro is null and r2 <= 75.0 / 26 * 0.8 then i2 end as label from m),
 c as (select r.*, case when r.ifd_index = 1 and r.small then 'THUMBNAIL' when r.ifd_index = lb.macro then 'MACRO' when r.ifd_index = lb.label then 'LABEL' when r.small and r.ifd_index > 0 then 'UNKNOWN' else 'LEVEL' end as role from r join lb on r.slide = lb.slide)"""


@query(f"with {_ROLE} select slide, ifd_index, role from c")
def classify_ifds(v):
    return D.classify_ifds(_ifds(v)).select("slide", "ifd_index", "role")


@query(f"with i as ({_IFDS}) select slide, count(*) filter (where small and lzw and ifd_index <> 1) = 2 as motic from i group by slide")
def detect_motic(v):
    return D.detect_motic(_ifds(v))


@query(f"with {_ROLE}, mo as (select slide, count(*) filter (where small and lzw and ifd_index <> 1) = 2 as motic from i group by slide) select c.slide, c.ifd_index, case when motic and role = 'LABEL' then 270 when motic then 90 else 0 end as angle from c join mo on c.slide = mo.slide")
def recommended_rotation(v):
    found = D.classify_ifds(_ifds(v)).join(D.detect_motic(_ifds(v)), "slide")
    return found.select("slide", "ifd_index", D.recommended_rotation("role", "motic").alias("angle"))


@query(f"with {_ROLE}, l as (select *, row_number() over (partition by slide order by ifd_index) - 1 as level from c where role = 'LEVEL' and ifd_index <> 4) select slide, level, ifd_index, case when count(*) over (partition by slide) > 1 and min(ifd_index) over (partition by slide) = 0 then 4 when count(*) over (partition by slide) > 1 then 4 else 0 end as compression from l")
def svs_levels(v):
    return D.levels(D.classify_ifds(_ifds(v)))


@query("select c_custkey // 6 as slide, min(c_custkey % 6) filter (where c_nationkey % 4 = 1) || '|MPP = 0.5' as description from customer group by 1 having count(*) filter (where c_nationkey % 4 = 1) > 0")
def svs_main_description(v):
    k = F.col("c_custkey")
    text = F.when(F.col("c_nationkey") % 4 == 1, F.concat((k % 6).cast("string"), F.lit("|MPP = 0.5"))).otherwise(F.lit("scanned"))
    return D.main_description(v.table("customer").select(S.floor_div(k, F.lit(6)).alias("slide"), (k % 6).alias("ifd_index"), text.alias("description")))


@query("with n as (select n_nationkey as p, n_regionkey + 1 as n_levels from nation) select p, l as level, (p + l) % 3 <> 0 as available from n join (select unnest(range(0, 6)) as l) on l < n_levels")
def level_availability(v):
    sizes = v.table("nation").select(F.col("n_nationkey").alias("p"), (F.col("n_regionkey") + 1).alias("n_levels"))
    here = sizes.select("p", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("level")).where("(p + level) % 3 <> 0")
    return D.level_availability(sizes, here, "p")


@query("select s_suppkey as k, cast(floor(l / 0.5 + 0.5) as bigint) + 3 as min_x, cast(floor(l / 0.5 + 0.5) as bigint) + cast(floor(w / 0.5 + 0.5) as bigint) - 4 as max_x, cast(floor(t / 0.5 + 0.5) as bigint) + 3 as min_y, cast(floor(t / 0.5 + 0.5) as bigint) + cast(floor(hh / 0.5 + 0.5) as bigint) - 4 as max_y from (select s_suppkey, s_suppkey * 0.75::double as l, s_suppkey * 0.25::double as t, 900.25::double as w, 500.75::double as hh from supplier)")
def metric_pyramid_at_level(v):
    m = v.table("supplier").selectExpr("s_suppkey as k", "s_suppkey * 0.75D as l", "s_suppkey * 0.25D as t", "900.25D as w", "500.75D as hh", "0.5D as p")
    return m.select("k", D.metric_area("l", "t", "w", "hh", "p").alias("r")).select("k", "r.*")


@query("select s_suppkey as k, case when s_suppkey % 3 = 0 then 1000.0::double else 1000.0::double * 4 / 5 end as size from supplier")
def correct_combining_info(v):
    return v.table("supplier").select(F.col("s_suppkey").alias("k"), D.corrected_by_border(F.lit(1000.0), F.when(F.col("s_suppkey") % 3 == 0, 0.0).otherwise(4.0), F.lit(5.0)).alias("size"))


# -- regions of interest -----------------------------------------------------------------------------------------------------

def _roi_files(v):
    """A metadata file for each supplier: a rectangle by size, one by right and bottom, a polygon, a multipolygon."""
    k = F.col("s_suppkey").cast("string")
    text = F.concat(F.lit('{"app":"image-pyramid-metadata","version":"1.0","rois":[{"shape":"rectangle","left":'), k, F.lit(',"top":2,"width":50,"height":40},{"shape":"rectangle","left":'), k, F.lit(',"top":10,"right":20000,"bottom":45},{"shape":"polygon","vertices":[{"x":1.5,"y":2.0},{"x":'), k, F.lit('.75,"y":2.0},{"x":9.2,"y":7.7}]},{"shape":"multipolygon","polygons":[{"vertices":[{"x":0,"y":0},{"x":4,"y":0},{"x":4,"y":'), k, F.lit('.5}]},{"vertices":[{"x":7,"y":7}]}]}]}'))
    return v.table("supplier").select(F.col("s_suppkey").alias("k"), text.alias("json"))


_RECTS = "select s_suppkey as k, 0 as roi_index, 'rectangle' as shape, s_suppkey as l, 2 as t, 50 as w, 40 as hh from supplier union all select s_suppkey, 1, 'rectangle', s_suppkey, 10, 20000 - s_suppkey, 35 from supplier"


@query(f"{_RECTS} union all select s_suppkey, 2, 'polygon', null, null, null, null from supplier union all select s_suppkey, 3, 'multipolygon', null, null, null, null from supplier")
def parse_roi(v):
    return P.parse_rois(_roi_files(v)).selectExpr("k", "roi_index", "shape", "left as l", "top as t", "width as w", "height as hh")


@query("select s_suppkey as k, case when s_suppkey = 0 then 0 else 1 end as min_x, case when s_suppkey >= 9 then s_suppkey else 9 end as max_x, 2 as min_y, 7 as max_y from supplier where s_suppkey > 0 union all select s_suppkey, 0, 9, 2, 7 from supplier where s_suppkey = 0")
def polygon_bbox(v):
    rows = P.parse_rois(_roi_files(v)).where("shape = 'polygon'")
    return rows.select("k", P.polygon_box(F.col("polygons")[0]).alias("b")).select("k", "b.*")


@query("select s_suppkey as k, 0 as min_x, 3 as max_x, 0 as min_y, s_suppkey as max_y from supplier")
def multipolygon_bbox(v):
    rows = P.parse_rois(_roi_files(v)).where("shape = 'multipolygon'")
    return rows.select("k", P.multipolygon_box("polygons").alias("b")).select("k", "b.*")


@query("select s_suppkey as k, 1.5::double * 2.0::double * 0 + ((1.5::double * 2.0 - (s_suppkey + 0.75::double) * 2.0) + ((s_suppkey + 0.75::double) * 7.7::double - 9.2::double * 2.0) + (9.2::double * 2.0 - 1.5::double * 7.7::double)) / 2 < 0 as internal, 3 as n from supplier")
def roi_contour(v):
    rows = P.parse_rois(_roi_files(v)).where("shape = 'polygon'")
    points, internal = P.polygon_contour(F.col("polygons")[0])
    return rows.select("k", internal.alias("internal"), F.size(points).alias("n"))


_PARTS = "select s_suppkey as k, 0 as roi_index, 0 as part, 4 as n, false as internal from supplier union all select s_suppkey, 1, 0, 4, false from supplier union all select s_suppkey, 2, 0, 3, (3.0::double - (s_suppkey + 0.75::double) * 2) + ((s_suppkey + 0.75::double) * 7.7::double - 9.2::double * 2) + (9.2::double * 2 - 1.5::double * 7.7::double) < 0 from supplier union all select s_suppkey, 3, 0, 3, false from supplier union all select s_suppkey, 3, 1, 1, false from supplier"


def _contours(v):
    rows = P.parse_rois(_roi_files(v))
    found = P.all_contours(rows.withColumn("roi_index", F.struct("k", "roi_index")))
    return found.select("roi_index.k", "roi_index.roi_index", "part", "points", "internal")


@query(_PARTS)
def all_roi_contours(v):
    return _contours(v).select("k", "roi_index", "part", F.size("points").alias("n"), "internal")


@query(f"select * from ({_PARTS}) where roi_index = k % 5")
def roi_contours_by_index(v):
    """The contours of one roi of each file, by its index; those of an index that a file hasn't are none."""
    asked = v.table("supplier").select(F.col("s_suppkey").alias("k"), (F.col("s_suppkey") % 5).cast("int").alias("roi_index"))
    return Y.contours_of(asked, _contours(v), "k").select("k", "roi_index", "part", F.size("points").alias("n"), "internal")


@query("select s_suppkey as k, roi_index, shape, n from (select s_suppkey, 0 as roi_index, 'rectangle' as shape, 0 as n from supplier union all select s_suppkey, 1, 'rectangle', 0 from supplier union all select s_suppkey, 2, 'polygon', 1 from supplier union all select s_suppkey, 3, 'multipolygon', 2 from supplier)")
def roi_to_json(v):
    again = P.parse_rois(P.to_json(P.parse_rois(_roi_files(v)), "k"))
    return again.select("k", "roi_index", "shape", F.coalesce(F.size("polygons"), F.lit(0)).alias("n"))


@query("select roi_index, (min_x + max_x) * 0.5::double as cx, (min_y + max_y) * 0.5::double as cy, cast(max_x - min_x + 1 as double) as w, cast(max_y - min_y + 1 as double) as hh from rois", ("rois",))
def roi_center_size(v):
    return v.rois.select("roi_index", P.center_size(*B.SIDES).alias("a")).selectExpr("roi_index", "a[0] as cx", "a[1] as cy", "a[2] as w", "a[3] as hh")


# -- graphs and links --------------------------------------------------------------------------------------------------------

_EDGES = "select n_nationkey as src, (n_nationkey + 1 + n_regionkey) % 25 as dst, cast(n_regionkey * 3 + n_nationkey % 7 + 1 as double) as weight from nation union all select n_nationkey, (n_nationkey * 3 + 2) % 25, cast(n_nationkey % 5 + 2 as double) from nation"


def _edges(v):
    n, r = F.col("n_nationkey"), F.col("n_regionkey")
    t = v.table("nation")
    one = t.select(n.alias("src"), ((n + 1 + r) % 25).alias("dst"), (r * 3 + n % 7 + 1).cast("double").alias("weight"))
    return one.unionByName(t.select(n.alias("src"), ((n * 3 + 2) % 25).alias("dst"), (n % 5 + 2).cast("double").alias("weight")))


@query("with recursive e as (" + _EDGES + "), w as (select 0 as vertex, 0.0::double as d, 0 as n union select e.dst, w.d + e.weight, w.n + 1 from w join e on e.src = w.vertex where w.n < 12) select vertex, min(d) as distance from w group by vertex")
def shortest_path_dijkstra(v):
    return G.shortest_paths(_edges(v), 0).select("vertex", "distance")


@query("with recursive e as (select * from (" + _EDGES + ") where dst > src), w as (select 0 as vertex, 0.0::double as d, 0 as n union select e.dst, w.d + e.weight, w.n + 1 from w join e on e.src = w.vertex) select vertex, min(d) as distance from w group by vertex")
def shortest_path_dag(v):
    return G.shortest_paths_dag(_edges(v).where("dst > src"), 0).select("vertex", "distance")


@query("with recursive e as (" + _EDGES + "), w as (select 0 as vertex, 0.0::double as d, 0 as n union select e.dst, w.d + e.weight, w.n + 1 from w join e on e.src = w.vertex where w.n < 12), s as (select vertex, min(d) as distance from w group by vertex), p as (select b.vertex, b.distance, min(a.vertex) as prev from s a join e on e.src = a.vertex join s b on b.vertex = e.dst and a.distance + e.weight = b.distance where b.vertex <> 0 group by 1, 2), r as (select 0 as vertex, 0.0::double as distance, [0] as path union all select p.vertex, p.distance, list_append(r.path, p.vertex) from r join p on p.prev = r.vertex) select vertex, distance, array_to_string(path, '>') as route from r")
def shortest_path_route(v):
    found = G.routes(G.shortest_paths(_edges(v), 0))
    return found.select("vertex", "distance", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("route"))


@query()
def shortest_path_vertices(v):
    """The same as arrays."""
    return G.routes(G.shortest_paths(_edges(v), 0))


def _points(v):
    e = v.table("events")
    return e.select((F.col("user_id") % 50).alias("g"), F.when(F.col("event_id") % 2 == 0, "S").otherwise("T").alias("side"), (F.col("event_id") % 977).cast("double").alias("v"))


@query()
def link_points(v):
    return L.link_points(_points(v))


_FEW = "select event_id // 8 as g, event_id % 2 = 0 as s, cast(event_id * 7919 % 977 as double) as v from events"


@query(f"""with recursive p as ({_FEW}), a as (select g, v, row_number() over (partition by g order by v) - 1 as i from p where s), b as (select g, v, row_number() over (partition by g order by v) - 1 as j from p where not s),
    c as (select a.g, i, j, abs(a.v - b.v) as cost, max(i) over (partition by a.g) as n, max(j) over (partition by a.g) as m from a join b on a.g = b.g),
    w as (select g, i, j, cost as cost from c where i = 0 and j = 0 union all select c.g, c.i, c.j, w.cost + c.cost from w join c on c.g = w.g and c.i - w.i in (0, 1) and c.j - w.j in (0, 1) and c.i + c.j > w.i + w.j)
    select w.g, min(w.cost) as cost from w join (select distinct g, n, m from c) e on w.g = e.g and w.i = e.n and w.j = e.m group by w.g""")
def link_cost(v):
    """Groups of eight events, half of them on either side."""
    k = F.col("event_id")
    points = v.table("events").select(S.floor_div(k, F.lit(8)).alias("g"), F.when(k % 2 == 0, "S").otherwise("T").alias("side"), (k * 7919 % 977).cast("double").alias("v"))
    return L.link_cost(L.link_points(points))


@query("with l as (select event_id % 50 as g, event_id, user_id % 40 + event_id // 40 as v, lag(user_id % 40 + event_id // 40) over (partition by event_id % 50 order by event_id) as p from events) select g, not bool_or(coalesce(p > v, false)) as is_sorted from l group by g")
def points_sorted(v):
    k = F.col("event_id")
    points = v.table("events").select((k % 50).alias("g"), k.alias("k"), (F.col("user_id") % 40 + S.floor_div(k, F.lit(40))).alias("v"))
    return L.sortedness(points, "g", "k", "v")


@query("select s_suppkey % 4 as g, count(distinct case when s_suppkey % 4 = 3 then s_suppkey % 8 else 0 end) <= 1 as compatible from supplier group by 1")
def frame_compatibility(v):
    """Frames of four sets, of which the last has two sizes."""
    k = F.col("s_suppkey")
    frames = v.table("supplier").select((k % 4).alias("g"), F.lit("u8").alias("element_type"), F.lit(1).alias("channels"), F.when(k % 4 == 3, k % 8).otherwise(0).alias("w"), F.lit(5).alias("h"))
    sets = [L.frame_compatibility(frames.where(F.col("g") == g)).select(F.lit(g).alias("g"), "compatible") for g in range(4)]
    return sets[0].unionByName(sets[1]).unionByName(sets[2]).unionByName(sets[3])


@query("select s_suppkey as k, min_x - 3 as e0, max_x + 3 as e1, min_y - 2 as e2, max_y + 2 as e3, min_x + 5 as m0, max_x + 5 as m1, min_y - 7 as m2, max_y - 7 as m3, case when least(max_x, 2500) >= greatest(min_x, 300) and least(max_y, 2000) >= greatest(min_y, 200) then greatest(min_x, 300) end as i0, case when least(max_x, 2500) >= greatest(min_x, 300) and least(max_y, 2000) >= greatest(min_y, 200) then least(max_x, 2500) end as i1 from (select roi_index as s_suppkey, * from rois)", ("rois",))
def rect_algebra(v):
    """Rectangles expanded, shifted, and the sides of what they have in common with one area."""
    own = tuple(F.col(s) for s in B.SIDES)
    grown = S.change_rect(F.lit("EXPAND"), own, F.lit(3), F.lit(2))
    moved = S.change_rect(F.lit("RIGHT_UP"), own, F.lit(5), F.lit(7))
    area = (300, 2500, 200, 2000)
    a, b, c, d = F.greatest(own[0], F.lit(area[0])), F.least(own[1], F.lit(area[1])), F.greatest(own[2], F.lit(area[2])), F.least(own[3], F.lit(area[3]))
    meet = (a <= b) & (c <= d)
    return v.rois.select(F.col("roi_index").alias("k"), *(x.alias(f"e{i}") for i, x in enumerate(grown)), *(x.alias(f"m{i}") for i, x in enumerate(moved)), F.when(meet, a).alias("i0"), F.when(meet, b).alias("i1"))


@query("select s_suppkey as k, case when r >= 256 then 4 when r >= 64 then 3 when r >= 16 then 2 when r >= 4 then 1 else 0 end as level from (select s_suppkey, s_suppkey % 300 + 1 as r from supplier)")
def svs_actual_level(v):
    k = F.col("s_suppkey")
    return v.table("supplier").select(k.alias("k"), Y.svs_actual_level((k % 300 + 1).cast("double"), F.lit(4.0)).alias("level"))
