"""Single images (PNG, JPEG, BMP, GIF) as pixels and pyramids, decoded by Spark's own image source on the executors."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from tessera.operators.raster import build_pyramid


def images(spark: SparkSession, path: str, drop_invalid: bool = False) -> DataFrame:
    """path, height, width, channels, data (rows of bytes, channels blue, green, red, alpha); files that can't be decoded have -1 as sides, or go."""
    read = spark.read.format("image").option("dropInvalid", drop_invalid).load(path)
    return read.selectExpr("image.origin AS path", "image.height", "image.width", "image.nChannels AS channels", "image.data")


def image_pixels(found: DataFrame, alpha: bool = True) -> DataFrame:
    """path, channel, x, y, v: channels red, green, blue and, if wanted and there, alpha; gray images have one."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                if r.height < 1:
                    continue
                v = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.channels)
                v = v[:, :, [2, 1, 0, 3][: r.channels]] if r.channels >= 3 else v
                v = v if alpha else v[:, :, :3]
                y, x, c = np.indices(v.shape)
                yield pd.DataFrame({"path": r.path, "channel": c.ravel(), "x": x.ravel(), "y": y.ravel(), "v": v.ravel().astype("int64")})

    return found.mapInPandas(run, "path string, channel int, x long, y long, v long")


def image_pyramid(px: DataFrame, width: int, height: int, compression: int = 2, least: int = 256, mode: str = "AVG_INT") -> DataFrame:
    """level, x, y, v of one band of an image, halved until its sides are small."""
    return build_pyramid(px, width, height, compression, least, mode)


def png(image: np.ndarray) -> bytes:
    """A PNG file of bytes (h, w, 1, 3 or 4 channels)."""
    h, w, channels = image.shape
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    rows = np.concatenate([np.zeros((h, 1), np.uint8), image.astype(np.uint8).reshape(h, -1)], 1)
    head = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2, 4: 6}[channels], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def encode_png(px: DataFrame, key: str) -> DataFrame:
    """key, content: one PNG file for each image of pixels (key, channel, x, y, v)."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        image = np.zeros((int(pdf["y"].max()) + 1, int(pdf["x"].max()) + 1, int(pdf["channel"].max()) + 1), np.uint8)
        image[pdf["y"], pdf["x"], pdf["channel"]] = pdf["v"]
        return pd.DataFrame({key: [pdf[key].iloc[0]], "content": [png(image)]})

    return px.groupBy(key).applyInPandas(run, f"{key} {px.schema[key].dataType.simpleString()}, content binary")
