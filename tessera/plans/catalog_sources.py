"""Queries of files: written to the shared folder from the tables, and read again."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.operators import raster as R
from tessera.operators import slide as D
from tessera.plans.catalog import query
from tessera.plans.catalog_functions import _roi_files
from tessera.plans.storage import new_path
from tessera.plans.views import WIDTH
from tessera.sources import image as I
from tessera.sources import pyramids as P
from tessera.sources import tiff as T

_NAME = "regexp_extract(path, '([^/]+)$', 1)"


def _strips(v):
    """The raster in images of 64 rows."""
    return v.px.select(F.concat(F.lit("strip"), S.floor_div("y", F.lit(64)).cast("string"), F.lit(".tif")).alias("name"), F.lit(0).alias("channel"), "x", (F.col("y") % 64).alias("y"), "v")


def _saved(v, files):
    """The folder with the files (name, content)."""
    folder = new_path(v.spark, "files")
    v.spark.dataSource.register(T.TiffDataSource)
    files.write.format("tiff").mode("append").save(folder)
    return folder


def _strip_files(v, **options):
    return T.files(v.spark, _saved(v, T.encode_images(_strips(v), "name", **options)) + "/*.tif")


_STRIPS = "s as (select 'strip' || (y // 64) || '.tif' as name, x, y % 64 as y, v from px)"


@query(f"with {_STRIPS} select name, x, y, v::double as v from s", ("px",))
def tiff_write(v):
    """Images written as LZW tiles with a predictor, and all of their pixels as they are read."""
    return T.tiff_read(_strip_files(v, compression="LZW", tile=16, predictor=True)).selectExpr(f"{_NAME} as name", "x", "y", "v")


@query(f"with {_STRIPS} select name, c as channel, x, y, v::double as v from s cross join (select unnest([0, 1, 2]) as c) where x between 20 and 69 and y between 3 and 32", ("px",))
def tiff_read(v):
    """An area of every image as three channels; tiles outside it aren't decoded."""
    return T.tiff_read(_strip_files(v, tile=32), 0, (20, 3, 50, 30), 3).selectExpr(f"{_NAME} as name", "channel", "x", "y", "v")


@query(f"with {_STRIPS} select name, true as valid, 0 as ifd_index, 128 as dim_x, max(y) + 1 as dim_y, 1 as channels, 'uint8' as element_type, true as tiled, 1 as compression_code from s group by name union all select 'odd.tif', false, null, null, null, null, null, null, null", ("px",))
def tiff_info(v):
    """The directories of all files, one of which is no image."""
    odd = v.spark.range(1).select(F.lit("odd.tif").alias("name"), F.lit(b"no image").alias("content"))
    found = T.files(v.spark, _saved(v, T.encode_images(_strips(v), "name", compression="NONE", tile=16).unionByName(odd)) + "/*.tif")
    return T.tiff_info(found).selectExpr(f"{_NAME} as name", "valid", "ifd_index", "dim_x", "dim_y", "channels", "element_type", "tiled", "compression_code")


@query(f"with {_STRIPS} select name, 1 as images, 128 as dim_x, max(y) + 1 as dim_y, 8 * ((max(y) + 16) // 16) as tiles, 8 * ((max(y) + 16) // 16) * 256 as n_bytes from s group by name", ("px",))
def write_statistics(v):
    return T.write_statistics(_strip_files(v, compression="NONE", tile=16)).selectExpr(f"{_NAME} as name", "images", "dim_x", "dim_y", "tiles", "n_bytes")


@query("with p as (select x // 16 as tile_x, y // 16 as tile_y, v % 50 as step from px where v < 250), e as (select max(step) as last from p) select tile_x, tile_y, case when count(*) = 16 * least(16, (select h from h) - tile_y * 16) then max(step) else (select last from e) end as step, count(*) = 16 * least(16, (select h from h) - tile_y * 16) as complete from p group by tile_x, tile_y", ("px",))
def incremental_tiles(v):
    """Pixels that arrive in fifty steps, the brightest never: when each tile is written."""
    return T.incremental_tiles(v.px.where("v < 250").select((F.col("v") % 50).alias("step"), "x", "y"), 16, WIDTH, v.height)


@query("""with l as (select x // 2 as x, y // 2 as y, max(v) as v from px where y < (select (h // 2) * 2 from h) group by 1, 2), s as (select least(50, 63) as x1, least(40, h // 2 - 1) as y1 from h),
    f as (select l.*, (x - 5) // 32 as tx, (y - 1) // 24 as ty, (x1 - 5) // 32 as last_x, (y1 - 1) // 24 as last_y from l, s where x between 5 and x1 and y between 1 and y1)
    select ty * (last_x + 1) + case when ty % 2 = 1 then last_x - tx else tx end as frame_index, 5 + tx * 32 as min_x, 1 + ty * 24 as min_y, x, y, v::double as v,
        ty = 0 and tx = 0 as first_in_pyramid, ty = last_y and tx = case when ty % 2 = 1 then 0 else last_x end as "last" from f""", ("px",))
def pyramid_read(v):
    """A file with three levels, read at the second in frames by snake over a given rectangle."""
    levels = R.build_pyramid(v.px, WIDTH, v.height, 2, 1).where("level < 3").select(F.lit("slide.svs").alias("name"), "level", F.lit(0).alias("channel"), "x", "y", "v")
    folder = _saved(v, T.encode_pyramids(levels, "name", tile=16))
    tiles = P.open_pyramids(v.spark, folder + "/slide.svs")
    given = tiles.select("path").distinct().selectExpr("path", "5L as min_x", "50L as max_x", "1L as min_y", "40L as max_y")
    found = P.read_frames(tiles, 1, 32, 24, "ROWS_BY_SNAKE", given=given)
    return found.select("frame_index", "min_x", "min_y", "x", "y", "v", "first_in_pyramid", "last")


@query(f"with {_STRIPS} select replace(name, 'tif', 'png') as name, c as channel, x, y, case c when 0 then v when 1 then x else y end as v from s cross join (select unnest([0, 1, 2]) as c)", ("px",))
def image_read(v):
    """Colour images (red: the value, green: x, blue: y) through Spark's image source."""
    px = _strips(v).select(F.replace("name", F.lit("tif"), F.lit("png")).alias("name"), "x", "y", F.posexplode(F.array("v", "x", "y")).alias("channel", "v"))
    found = I.images(v.spark, _saved(v, I.encode_png(px, "name")) + "/*.png")
    return I.image_pixels(found).selectExpr(f"{_NAME} as name", "channel", "x", "y", "v")


@query("select 'slide' || s_suppkey || '.svs' as name, s_suppkey % 2 = 0 as found, case when s_suppkey % 2 = 0 then 4 end as rois from supplier")
def external_metadata(v):
    """Files of which every second has a metadata file beside it."""
    k = F.col("k")
    name = F.concat(F.lit("slide"), k.cast("string"), F.lit(".svs"))
    files = _roi_files(v).select(name.alias("name"), F.lit(b"slide").alias("content"))
    metas = _roi_files(v).where("k % 2 = 0").select(F.concat(name, F.lit(P.META)).alias("name"), F.col("json").cast("binary").alias("content"))
    folder = _saved(v, files.unionByName(metas))
    found = P.with_metadata(v.spark.read.format("binaryFile").load(folder + "/*.svs").select("path"), P.sidecars(v.spark, folder))
    return found.selectExpr(f"{_NAME} as name", "json IS NOT NULL as found", "size(from_json(json, 'rois array<struct<shape: string>>').rois) as rois")


@query("""select s_suppkey as k, s_suppkey % 3 = 0 as combine, case when s_suppkey % 4 = 1 then 90 else 0 end as rotation, case when s_suppkey % 3 = 0 then 75000.0::double + s_suppkey end as slide_width, s_suppkey % 2 = 0 as skip_coarse, case when s_suppkey % 2 = 0 then 0.25::double else 0.0::double end as filler,
    case when s_suppkey % 5 = 0 then '#A3A3A3' when s_suppkey % 5 = 1 then '#102030' end as border_color, case when s_suppkey % 5 = 0 then 2 when s_suppkey % 5 = 1 then 7 else 0 end as border_width from supplier""")
def slide_settings(v):
    k = F.col("s_suppkey")
    own = F.concat(F.when(k % 3 == 0, F.concat(F.lit('"combineWithWholeSlideImage": true, "recommendedGeometry": {"slideWidth": '), (k + 75000).cast("string"), F.lit("}, "))).otherwise(F.lit("")), F.when(k % 4 == 1, F.lit('"rotation": 90')).otherwise(F.lit('"other": 1')))
    pyramid = F.concat(F.lit('{"format": {"'), F.when(k % 2 == 0, F.lit("svs")).otherwise(F.lit("aperio")), F.lit('": {'), own, F.lit("}}}"))
    coarse = F.when(k % 2 == 0, F.lit('"coarseData": {"skip": true, "filler": 0.25}')).otherwise(F.lit('"x": 0'))
    border = F.when(k % 5 == 0, F.lit(', "border": {}')).when(k % 5 == 1, F.lit(', "border": {"color": "#102030", "width": 7}')).otherwise(F.lit(""))
    rows = v.table("supplier").select(k.alias("k"), pyramid.alias("p"), F.concat(F.lit("{"), coarse, border, F.lit("}")).alias("r"))
    return D.slide_settings(rows, "p", "r").select("k", "combine", "rotation", "slide_width", "skip_coarse", "filler", "border_color", "border_width")
