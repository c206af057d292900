"""Slide descriptions and the roles of a slide file's directories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalars import find_compression, is_dimensions_relation_correct, round_half_up

#: The usual aspect ratio of a macro image and how far from it one may be; the gap in pixels; microns in a millimetre.
MACRO_RATIO, RATIO_RANGE, GAP, MICRONS = 75 / 26, 0.8, 3, 1000.0


def parse_description(text: Column | str) -> Column:
    """map of attributes: in lines with a pipe, the first record is CommonInfo (the last line's stays), key=value records with one equals sign follow (the first stays)."""
    t = F.col(text) if isinstance(text, str) else text
    lines = F.filter(F.split(F.trim(t), "\r?\n"), lambda x: x.contains("|"))
    records = F.flatten(F.transform(lines, lambda x: F.slice(F.split(x, r"\|"), 2, 1_000_000)))
    pairs = F.transform(F.filter(records, lambda r: F.size(F.split(r, "=")) == 2), lambda r: F.struct(F.trim(F.split(r, "=")[0]).alias("k"), F.trim(F.split(r, "=")[1]).alias("v")))
    first = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, 1, F.greatest(i, F.lit(0))), lambda q: q["k"] == p["k"]))
    common = F.when(F.size(lines) > 0, F.trim(F.split(F.element_at(lines, -1), r"\|")[0]))
    return F.map_concat(F.when(common.isNotNull(), F.create_map(F.lit("CommonInfo"), common)).otherwise(F.create_map().cast("map<string,string>")), F.map_from_entries(F.filter(first, lambda p: p["k"] != "CommonInfo")))


def number(attributes: Column | str, name: str) -> Column:
    """An attribute as a number; one that is there but isn't a number is an error."""
    raw = (F.col(attributes) if isinstance(attributes, str) else attributes)[name]
    value = raw.try_cast("double")
    return F.when(raw.isNotNull() & value.isNull(), F.raise_error(F.concat(F.lit(f"{name} isn't a number: "), raw)).cast("double")).otherwise(value)


def pixel_size(attributes: Column | str) -> Column:
    mpp = number(attributes, "MPP")
    return F.when(mpp > 0, mpp)


def magnification(attributes: Column | str) -> Column:
    return number(attributes, "AppMag")


def on_slide(attributes: Column | str) -> tuple[Column, Column]:
    """Left and top of the image on the slide, in microns."""
    return number(attributes, "Left") * MICRONS, number(attributes, "Top") * MICRONS


def corrected_by_border(slide: Column, old: Column, new: Column) -> Column:
    """A slide's size scaled by the ratio of the old to the found border's offset, if both are positive."""
    return F.when((old > 0) & (new > 0), slide * old / new).otherwise(slide)


def metric_area(left, top, width, height, pixel) -> Column:
    """struct of pixel sides of a rectangle in microns, shrunk by GAP on every side."""
    px = [round_half_up(F.col(v) / F.col(pixel)) for v in (left, top, width, height)]
    return F.struct((px[0] + GAP).alias("min_x"), (px[0] + px[2] - 1 - GAP).alias("max_x"), (px[1] + GAP).alias("min_y"), (px[1] + px[3] - 1 - GAP).alias("max_y"))


def classify_ifds(ifds: DataFrame, key: str = "slide") -> DataFrame:
    """Adds role. ifds: key, ifd_index, dim_x, dim_y, small (not a level by its size), jpeg.

    The second directory is the thumbnail if small. Of the last two, if both are small (and there are four or more): the more extended one
    is the macro image if its aspect ratio is in range, else the larger one in area; the other is the label, and of equals the last is the macro image. A single small last
    one is the label up to the range (the macro image if JPEG compressed), the macro image within it, unknown beyond. Other small ones are unknown, the rest are levels.
    """
    by = Window.partitionBy(key)
    ratio = F.greatest("dim_x", "dim_y") / F.least("dim_x", "dim_y")
    df = ifds.withColumns({"back": F.row_number().over(by.orderBy(F.desc("ifd_index"))), "count_": F.count("*").over(by), "ratio": ratio, "area": (F.col("dim_x") * F.col("dim_y")).cast("double")})

    def of(n: int, c: str) -> Column:
        return F.max(F.when(F.col("back") == n, F.col(c))).over(by)

    low, high = MACRO_RATIO * RATIO_RANGE, MACRO_RATIO / RATIO_RANGE
    both = (F.col("count_") > 3) & F.coalesce(of(1, "small") & of(2, "small"), F.lit(False))
    extended = F.greatest(of(1, "ratio"), of(2, "ratio"))
    by_form = (extended > low) & (extended < high)
    before_is_macro = F.when(by_form, of(2, "ratio") > of(1, "ratio")).otherwise(of(2, "area") > of(1, "area"))
    pair = F.when(before_is_macro == (F.col("back") == 2), "MACRO").otherwise("LABEL")
    single = F.when(F.col("ratio") <= low, F.when(F.col("jpeg"), "MACRO").otherwise("LABEL")).when(F.col("ratio") < high, "MACRO").otherwise("UNKNOWN")
    alone = (F.col("count_") > 2) & (F.col("back") == 1) & F.col("small")
    role = F.when((F.col("ifd_index") == 1) & F.col("small"), "THUMBNAIL").when(both & (F.col("back") <= 2), pair).when(~both & alone, single).when(F.col("small") & (F.col("ifd_index") > 0), "UNKNOWN").otherwise("LEVEL")
    return df.withColumn("role", role).drop("back", "count_", "ratio", "area")


def detect_motic(ifds: DataFrame, key: str = "slide") -> DataFrame:
    """key, motic: exactly two small LZW directories besides the second one, and no geometry in the description (has_geometry)."""
    return ifds.groupBy(key).agg(((F.count_if(F.col("small") & F.col("lzw") & (F.col("ifd_index") != 1)) == 2) & ~F.max("has_geometry")).alias("motic"))


def recommended_rotation(kind: Column | str, motic: Column | str) -> Column:
    kind, motic = (F.col(c) if isinstance(c, str) else c for c in (kind, motic))
    return F.when(motic & (kind == "LABEL"), 270).when(motic, 90).otherwise(0)


def levels(ifds: DataFrame, key: str = "slide") -> DataFrame:
    """key, level, ifd_index, compression: the levels in order, up to the first that breaks the first pair's compression. ifds: with role."""
    by = Window.partitionBy(key).orderBy("ifd_index")
    lv = ifds.where("role = 'LEVEL'").withColumns({"level": F.row_number().over(by) - 1, "px": F.lag("dim_x").over(by), "py": F.lag("dim_y").over(by)})
    lv = lv.withColumn("c", F.when(F.col("level") == 1, find_compression("px", "py", "dim_x", "dim_y")))
    lv = lv.withColumn("compression", F.max("c").over(Window.partitionBy(key)))
    ok = (F.col("level") == 0) | ((F.coalesce("compression", F.lit(0)) > 1) & is_dimensions_relation_correct("px", "py", "dim_x", "dim_y", F.greatest(F.coalesce("compression", F.lit(2)), F.lit(1))))
    lv = lv.withColumn("ok", F.min(ok).over(by))
    return lv.where("ok").select(key, "level", "ifd_index", F.coalesce("compression", F.lit(0)).alias("compression"))


def main_description(ifds: DataFrame, key: str = "slide") -> DataFrame:
    """key, description: the first directory's that has a pixel size."""
    return ifds.where(F.col("description").rlike(r"(^|\|)\s*MPP\s*=")).groupBy(key).agg(F.min_by("description", "ifd_index").alias("description"))


def level_availability(sizes: DataFrame, present: DataFrame, key: str = "pyramid_id") -> DataFrame:
    """key, level, available for levels 0 .. n_levels - 1. sizes: key, n_levels; present: key, level."""
    wanted = sizes.select(key, F.explode(F.sequence(F.lit(0), F.col("n_levels") - 1)).alias("level"))
    return wanted.join(present.select(key, "level").distinct().withColumn("here", F.lit(True)), [key, "level"], "left").select(key, "level", F.col("here").isNotNull().alias("available"))


#: The colour and width of the border around the data where a border is asked for without them.
BORDER_COLOR, BORDER_WIDTH = "#A3A3A3", 2
_PYRAMID = "format STRUCT<svs: STRUCT<combineWithWholeSlideImage: BOOLEAN, rotation: INT, recommendedGeometry: STRUCT<slideWidth: DOUBLE, slideHeight: DOUBLE>>, aperio: STRUCT<combineWithWholeSlideImage: BOOLEAN, rotation: INT, recommendedGeometry: STRUCT<slideWidth: DOUBLE, slideHeight: DOUBLE>>>"
_RENDERING = "coarseData STRUCT<skip: BOOLEAN, filler: DOUBLE>, border STRUCT<color: STRING, width: INT>"


def slide_settings(rows: DataFrame, pyramid: str, rendering: str) -> DataFrame:
    """Adds combine, rotation, slide_width, slide_height, skip_coarse, filler, border_color, border_width from two JSON columns; aperio is another name of svs, no border has width 0."""
    read = rows.withColumn("p_", F.from_json(pyramid, _PYRAMID)).withColumn("r_", F.from_json(rendering, _RENDERING))
    own = F.coalesce("p_.format.svs", "p_.format.aperio")
    border = F.col("r_.border").isNotNull()
    found = {
        "combine": F.coalesce(own["combineWithWholeSlideImage"], F.lit(False)), "rotation": F.coalesce(own["rotation"], F.lit(0)),
        "slide_width": own["recommendedGeometry"]["slideWidth"], "slide_height": own["recommendedGeometry"]["slideHeight"],
        "skip_coarse": F.coalesce("r_.coarseData.skip", F.lit(False)), "filler": F.coalesce("r_.coarseData.filler", F.lit(0.0)),
        "border_color": F.when(border, F.coalesce("r_.border.color", F.lit(BORDER_COLOR))), "border_width": F.when(border, F.coalesce("r_.border.width", F.lit(BORDER_WIDTH))).otherwise(0),
    }
    return read.withColumns(found).drop("p_", "r_")
