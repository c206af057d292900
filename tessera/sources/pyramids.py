"""Pyramids in files as one source: which reader opens a path, its levels, frames of a scan with their loop flags, sidecar metadata.

A reader takes (spark, path) and gives tiles of all levels: path, level, min_x, min_y, w, h, channels, element_type, data.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.pyramid import areas_to_scan, level_rois
from tessera.operators.rects import loop_flags
from tessera.sources import image as I
from tessera.sources import tiff as T

Reader = Callable[[SparkSession, str], DataFrame]
META = ".meta"


def _tiff(spark: SparkSession, path: str) -> DataFrame:
    """Directories are levels, the largest first. Blocks are decoded where a file is read."""
    found = T.files(spark, path)
    n = T.tiff_info(found, "FAILFAST").agg(F.max("ifd_index").alias("n")).first().n
    out = None
    for k in range((n or 0) + 1):
        tiles = T.tiff_tiles(found, k, mode="PERMISSIVE").select("path", F.lit(k).alias("level"), "min_x", "min_y", "w", "h", "channels", "element_type", "data")
        out = tiles if out is None else out.unionByName(tiles)
    return out


def _image(spark: SparkSession, path: str) -> DataFrame:
    """A single image is a pyramid of one level and one tile."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                v = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.channels)
                v = v[:, :, [2, 1, 0, 3][: r.channels]] if r.channels >= 3 else v
                yield pd.DataFrame([(r.path, 0, 0, 0, r.width, r.height, r.channels, "uint8", v.tobytes())], columns="path level min_x min_y w h channels element_type data".split())

    return I.images(spark, path, True).mapInPandas(run, "path string, level int, min_x long, min_y long, w int, h int, channels int, element_type string, data binary")


READERS: dict[str, Reader] = {"tiff": _tiff, "tif": _tiff, "svs": _tiff, "png": _image, "jpg": _image, "jpeg": _image, "bmp": _image, "gif": _image}


def register(extension: str, reader: Reader) -> None:
    """A reader for files of an extension; it takes the place of one that is there."""
    READERS[extension.lower()] = reader


def open_pyramids(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """The tiles of the pyramids in the files at a path, read by what their extension (or kind) names; a kind that none reads is an error."""
    kind = (kind or path.rsplit(".", 1)[-1]).lower()
    if kind not in READERS:
        raise NotImplementedError(f"unsupported: {kind}")
    return READERS[kind](spark, path)


def levels_of(tiles: DataFrame, key: str = "path") -> DataFrame:
    """key, level, dim_x, dim_y."""
    return tiles.groupBy(key, "level").agg(F.max(F.col("min_x") + F.col("w")).alias("dim_x"), F.max(F.col("min_y") + F.col("h")).alias("dim_y"))


def read_frames(tiles: DataFrame, level: int, frame_x: int, frame_y: int, sequence: str | None = "ROWS_LEFT_TO_RIGHT", metadata: DataFrame | None = None, given: DataFrame | None = None, least: int = 0, equalize: bool = False, key: str = "path") -> DataFrame:
    """Every pixel of every frame of a scan: key, roi_index, frame_index, its loop flags, min_x, min_y, channel, x, y, v.

    Frames cover the metadata's rois (key, roi_index, sides at level 0), where a pyramid has any, else the given roi, else the level; without a
    sequence a roi is one frame. Frames meet tiles by coarse cells; a tile that no frame meets isn't opened, and its pixels are cut to the frame before they are rows.
    """
    levels = levels_of(tiles, key)
    frames = areas_to_scan(levels, level, level_rois(levels, level, metadata, given, least, True, key), frame_x, frame_y, sequence, equalize, key)
    frames = loop_flags(frames, key)
    flags = ["first_in_roi", "last_in_roi", "first_in_pyramid", "last_in_pyramid", "last"]
    cell = 256
    near = lambda low, high: F.explode(F.sequence(F.floor(F.col(low) / cell), F.floor(F.col(high) / cell)))
    wanted = frames.withColumn("cell_x", near("min_x", "max_x")).withColumn("cell_y", near("min_y", "max_y"))
    own = tiles.where(F.col("level") == level).drop("level").withColumnsRenamed({"min_x": "tile_x", "min_y": "tile_y"}).withColumns({"tile_r": F.col("tile_x") + F.col("w") - 1, "tile_b": F.col("tile_y") + F.col("h") - 1})
    own = own.withColumn("cell_x", near("tile_x", "tile_r")).withColumn("cell_y", near("tile_y", "tile_b"))
    met = wanted.join(own, [key, "cell_x", "cell_y"]).where("min_x <= tile_r AND max_x >= tile_x AND min_y <= tile_b AND max_y >= tile_y")
    first = (F.floor(F.greatest("min_x", "tile_x") / cell) == F.col("cell_x")) & (F.floor(F.greatest("min_y", "tile_y") / cell) == F.col("cell_y"))
    met = met.where(first).select(key, "roi_index", "frame_index", *flags, "min_x", "max_x", "min_y", "max_y", "tile_x", "tile_y", "w", "h", "channels", "element_type", "data")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                x0, y0 = max(r.min_x, r.tile_x), max(r.min_y, r.tile_y)
                x1, y1 = min(r.max_x, r.tile_x + r.w - 1), min(r.max_y, r.tile_y + r.h - 1)
                v = np.frombuffer(r.data, r.element_type).reshape(r.h, r.w, r.channels)[y0 - r.tile_y : y1 + 1 - r.tile_y, x0 - r.tile_x : x1 + 1 - r.tile_x]
                y, x, c = np.indices(v.shape)
                head = {name: getattr(r, name) for name in (key, "roi_index", "frame_index", *flags, "min_x", "min_y")}
                yield pd.DataFrame(head | {"channel": c.ravel(), "x": x.ravel() + x0, "y": y.ravel() + y0, "v": v.ravel().astype(float)})

    kind = met.schema[key].dataType.simpleString()
    return met.mapInPandas(run, f"{key} {kind}, roi_index int, frame_index long, " + ", ".join(f"{f} boolean" for f in flags) + ", min_x long, min_y long, channel int, x long, y long, v double")


class Delayed:
    """A pyramid whose sides are known before its tiles: reading before they are set is an error, and so are tiles of other sides."""

    def __init__(self, levels: list[tuple[int, int]]):
        self.levels, self._tiles = levels, None

    def set(self, tiles: DataFrame) -> None:
        found = {r.level: (r.dim_x, r.dim_y) for r in levels_of(tiles).collect()}
        if found != dict(enumerate(self.levels)):
            raise ValueError(f"the pyramid has other levels: {found}")
        self._tiles = tiles

    @property
    def tiles(self) -> DataFrame:
        if self._tiles is None:
            raise RuntimeError("the pyramid isn't ready")
        return self._tiles


def given_or_read(given: DataFrame | None, read: Callable[[], DataFrame]) -> DataFrame:
    """What is already there, else what is read; then nothing is opened."""
    return given if given is not None else read()


def sidecars(spark: SparkSession, folder: str, suffix: str = META) -> DataFrame:
    """path (of the file that it belongs to), json: the metadata files in a folder, each whole."""
    read = spark.read.text(f"{folder}/*{suffix}", wholetext=True)
    return read.select(F.regexp_replace(F.col("_metadata.file_path"), suffix.replace(".", "[.]") + "$", "").alias("path"), F.col("value").alias("json"))


def with_metadata(found: DataFrame, metadata: DataFrame, use: bool = True) -> DataFrame:
    """The files (path, ...) with their sidecar's json; null where there is none or it isn't wanted."""
    if not use:
        return found.withColumn("json", F.lit(None).cast("string"))
    plain = lambda c: F.regexp_replace(c, "^([a-z0-9]+):/+", "$1:/")  # noqa: E731  # sources write one scheme with one or three slashes
    named = metadata.select(plain(F.col("path")).alias("plain_"), "json")
    return found.withColumn("plain_", plain(F.col("path"))).join(named, "plain_", "left").drop("plain_")
