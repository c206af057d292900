"""Jointing completed objects: of the last frame's surroundings, only objects that don't touch the unknown."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.rects import boundary_retain, boundary_skip, inside

Rect = tuple[int, int, int, int]


def based(pixels: DataFrame, bases: DataFrame) -> DataFrame:
    """x, y, base of stitched pixels (x, y, label)."""
    return pixels.join(bases, "label", "left").select("x", "y", F.coalesce("base", "label").alias("base"))


def boundary_labels(pixels: DataFrame, boundary: DataFrame) -> DataFrame:
    """base: representatives on the boundary. pixels: x, y, base."""
    return pixels.join(boundary, ["x", "y"], "left_semi").select("base").distinct()


def completed_labels(pixels: DataFrame, frame: Rect, boundary: DataFrame) -> DataFrame:
    """base: representatives that touch the frame's sides from outside and aren't on the boundary."""
    x0, x1, y0, y1 = frame
    ring = (F.col("x").isin(x0 - 1, x1 + 1) & F.col("y").between(y0, y1)) | (F.col("y").isin(y0 - 1, y1 + 1) & F.col("x").between(x0, x1))
    return pixels.where(ring).select("base").distinct().join(boundary, "base", "left_anti")


def joint_completed(pixels: DataFrame, frame: Rect, expansion: int, policy: str = "SKIP") -> DataFrame:
    """x, y, base over the frame expanded by so many pixels: kept in the frame or if completed, never if on the boundary; zero elsewhere. pixels: x, y, base."""
    x0, x1, y0, y1 = frame
    large = (x0 - expansion, x1 + expansion, y0 - expansion, y1 + expansion)
    region = pixels.select("x", "y")
    edge = boundary_retain(region, large) if policy == "RETAIN_LAST_PART" else boundary_skip(region, large)
    border = boundary_labels(pixels, edge).withColumn("on_border", F.lit(True))
    done = completed_labels(pixels, frame, border.select("base")).withColumn("done", F.lit(True))
    near = pixels.where(inside(large)).join(border, "base", "left").join(done, "base", "left")
    keep = F.col("on_border").isNull() & (inside(frame) | F.col("done").isNotNull())
    return near.select("x", "y", F.when(keep, F.col("base")).otherwise(F.lit(0)).cast("bigint").alias("base"))
