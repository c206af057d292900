"""Finding a slide's border and packing squares over an object, on one image at a time (numpy over whole images), and its relational pieces."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: most squares by default.
MOST_SQUARES = 10_000


@dataclass(frozen=True)
class Search:
    """Parameters of the search for a corner; the defaults are fixed values. Brightness is a share of full brightness.

    Each has a key spark.tessera.corner.<name> in the session's configuration that overrides it (from_conf).
    """

    along_x: int = 100
    along_y: int = 100
    least_along: int = 25
    background_x: int = 30
    background_y: int = 30
    most_variation: float = 40 / 255
    least_difference: float = 40 / 255
    variation_softening: float = 10 / 255
    difference_softening: float = 10 / 255
    search_x: int = 2**31 - 1
    search_y: int = 2**31 - 1

    @classmethod
    def from_conf(cls, spark) -> Search:
        found = {name: spark.conf.get(f"spark.tessera.corner.{name}", None) for name in cls.__dataclass_fields__}
        return cls(**{name: (float if "." in str(getattr(cls, name)) else int)(v) for name, v in found.items() if v is not None})

    def window(self, width: int, height: int, at: tuple[int, int] = (0, 0)) -> tuple[int, int, int, int]:
        """(x0, x1, y0, y1), inclusive: where corners are looked for; the last pixels along both sides are not, as borders get short there."""
        half_x, half_y = self.search_x // 2, self.search_y // 2
        return max(0, at[0] - half_x), min(width - 1 - self.along_x, at[0] + half_x), max(0, at[1] - half_y), min(height - 1 - self.along_y, at[1] + half_y)


def gray_macro(px: DataFrame, most: float, *keys: str) -> DataFrame:
    """keys, x, y, v: the bands of pixels (x, y, band, v) averaged and rescaled to 0..255, rounded down; most is the largest possible value."""
    return px.groupBy(*keys, "x", "y").agg(F.floor(F.avg(F.col("v") * (255.0 / most))).cast("bigint").alias("v"))


def median_filter(px: DataFrame, radius: int, after: int | None = None) -> DataFrame:
    """x, y, v: the middle value of each pixel's neighbourhood from `radius` before to `after` (the same) behind it, mirrored at the edges.

    Pixels near an edge are mirrored beyond it first; then every pixel goes to the neighbourhoods it is in, in one aggregation.
    """
    after = radius if after is None else after
    size = px.agg(F.max("x").alias("w_"), F.max("y").alias("h_"))

    def places(c: str, last: str) -> Column:
        v, end = F.col(c), F.col(last)
        return F.array_compact(F.array(v, F.when(v < radius, -v - 1), F.when(v > end - after, 2 * end + 1 - v)))

    grown = px.join(F.broadcast(size)).withColumn("px_", F.explode(places("x", "w_"))).withColumn("py_", F.explode(places("y", "h_")))
    step = F.explode(F.sequence(F.lit(-after), F.lit(radius)))  # a pixel is in the neighbourhoods of those up to `after` before it
    reached = grown.select("*", step.alias("dx")).select("*", step.alias("dy"))
    reached = reached.select((F.col("px_") + F.col("dx")).alias("x"), (F.col("py_") + F.col("dy")).alias("y"), "v", "w_", "h_").where("x BETWEEN 0 AND w_ AND y BETWEEN 0 AND h_")
    return reached.groupBy("x", "y").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY v)").cast("bigint").alias("v"))


def erosion(px: DataFrame, side: int) -> DataFrame:
    """x, y of the corners of side x side squares that are wholly set (v > 0): a count of set pixels for each corner."""
    back = F.explode(F.sequence(F.lit(0), F.lit(side - 1)))
    reach = px.where("v > 0").select("x", "y", back.alias("dx")).select("x", "y", "dx", back.alias("dy"))
    return reach.groupBy((F.col("x") - F.col("dx")).alias("x"), (F.col("y") - F.col("dy")).alias("y")).agg(F.count("*").alias("n")).where(F.col("n") == side * side).select("x", "y")


def best_corner(quality: DataFrame) -> DataFrame:
    """x, y, q of the highest quality; NaN never wins, the first in row order does on a tie."""
    return quality.where(~F.isnan("q")).groupBy().agg(F.max_by(F.struct("x", "y", "q"), F.struct(F.col("q"), -F.col("y"), -F.col("x"))).alias("b")).select("b.*")


def _mirrored_median(image: np.ndarray, before: tuple[int, int], after: tuple[int, int]) -> np.ndarray:
    """The middle value (the lower of two) of each pixel's rectangle, mirrored at the edges, a row of the image at a time."""
    padded = np.pad(image, ((before[1], after[1]), (before[0], after[0])), "symmetric")
    tall, wide = before[1] + after[1] + 1, before[0] + after[0] + 1
    out = np.empty_like(image)
    for y in range(len(image)):
        cells = np.lib.stride_tricks.sliding_window_view(padded[y : y + tall], wide, 1).transpose(1, 0, 2).reshape(image.shape[1], -1)
        out[y] = np.partition(cells, (cells.shape[1] - 1) // 2, 1)[:, (cells.shape[1] - 1) // 2]
    return out


def averaged(image: np.ndarray, search: Search = Search()) -> np.ndarray:
    """The image smoothed by the median of the background's size."""
    return _mirrored_median(image, (search.background_x - 1 - search.background_x // 2, search.background_y - 1 - search.background_y // 2), (search.background_x // 2, search.background_y // 2))


def _along(image: np.ndarray, outside: np.ndarray, length: int, least: int, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest brightness on the way to the right from each corner, as far as its border seems to reach."""
    w = image.shape[1]
    corner, end = image[y, x], np.minimum(x + length, w - 1)
    stop, open_ = end.copy(), np.ones(len(x), bool)
    for k in range(length):
        at = x + k
        open_ &= at < end
        v = image[y, np.minimum(at, w - 1)]
        left = open_ & (np.abs(v - outside) < np.abs(v - corner))  # nearer to the outside: the border ended before; half the way is safe
        stop[left] = np.maximum((x[left] + at[left]) // 2, np.minimum(x[left] + least, w - 1))
        open_ &= ~left
    low, high = corner.copy(), corner.copy()
    for k in range(length):
        v = image[y, np.minimum(x + k, w - 1)]
        on = x + k < stop
        low, high = np.where(on, np.minimum(low, v), low), np.where(on, np.maximum(high, v), high)
    return low, high


def corner_quality(image: np.ndarray, smooth: np.ndarray, x: np.ndarray, y: np.ndarray, search: Search = Search()) -> np.ndarray:
    """How well pixels are the left top corner of a border: minus the brightness's variation along both sides over the corner's difference from what is outside and inside (the smaller one). NaN: too like its background, or too uneven."""
    image, smooth = image.astype(np.int64), smooth.astype(np.int64)
    h, w = image.shape
    dx, dy = search.background_x // 2 + 2, search.background_y // 2 + 2
    corner = image[y, x]
    outside, inside_ = smooth[np.maximum(0, y - dy), np.maximum(0, x - dx)], smooth[np.minimum(h - 1, y + dy), np.minimum(w - 1, x + dx)]
    difference = np.minimum(np.abs(corner - outside), np.abs(corner - inside_)) / 255
    low_x, high_x = _along(image, outside, search.along_x, search.least_along, x, y)
    low_y, high_y = _along(image.T, outside, search.along_y, search.least_along, y, x)
    variation = (np.maximum(high_x, high_y) - np.minimum(low_x, low_y)) / 255
    q = -(variation + search.variation_softening) / (difference + search.difference_softening)
    return np.where((difference < search.least_difference) | (variation > search.most_variation), np.nan, q)


def _image(pdf: pd.DataFrame) -> np.ndarray:
    out = np.zeros((int(pdf["y"].max()) + 1, int(pdf["x"].max()) + 1), np.int64)
    out[pdf["y"], pdf["x"]] = pdf["v"]
    return out


def corner_qualities(px: DataFrame, key: str, search: Search = Search(), at: tuple[int, int] = (0, 0)) -> DataFrame:
    """key, x, y, q for the pixels of each image (key, x, y, v) where corners are looked for. A macro image is one group."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        image = _image(pdf)
        x0, x1, y0, y1 = search.window(image.shape[1], image.shape[0], at)
        ys, xs = (v.ravel() for v in np.mgrid[y0 : max(y0, y1 + 1), x0 : max(x0, x1 + 1)])
        q = corner_quality(image, averaged(image, search), xs, ys, search) if len(xs) else np.zeros(0)
        return pd.DataFrame({key: pdf[key].iloc[0], "x": xs, "y": ys, "q": q})

    found = px.groupBy(key).applyInPandas(run, f"{key} {px.schema[key].dataType.simpleString()}, x long, y long, q double")
    return found.withColumn("q", F.coalesce("q", F.lit(float("nan"))))  # NaN comes out of pandas as null


def quality_map(px: DataFrame, qualities: DataFrame, key: str, multiplier: float) -> DataFrame:
    """key, x, y, v: 255 plus the quality times the multiplier, cut to a whole number of 0 or more; 0 where it is NaN, 128 where none was looked for."""
    v = F.when(F.isnan("q"), 0.0).when(F.col("q").isNotNull(), F.greatest(F.lit(0.0), 255.0 + F.col("q") * multiplier))
    return px.select(key, "x", "y").join(qualities, [key, "x", "y"], "left").select(key, "x", "y", F.coalesce(F.floor(v), F.lit(128)).cast("bigint").alias("v"))


def draw_corner(px: DataFrame, corner: DataFrame, key: str, color: float, search: Search = Search(), reach: int = 20) -> DataFrame:
    """key, x, y, v: the image with a line from the corner (key, x, y) along either side, fading over `reach` pixels; the vertical one is on top."""
    size = px.groupBy(key).agg(F.max("x").alias("w_"), F.max("y").alias("h_"))
    marked = px.join(corner.select(key, F.col("x").alias("cx_"), F.col("y").alias("cy_")).join(size, key), key, "left")
    dx, dy = F.col("x") - F.col("cx_"), F.col("y") - F.col("cy_")
    fade = lambda d: F.floor(color * 255.0 * (reach - F.abs(d)) / float(reach)).cast("bigint")
    down = (dy >= 0) & (F.col("y") < F.least(F.col("cy_") + search.along_y, F.col("h_"))) & (F.abs(dx) <= reach)
    across = (dx >= 0) & (F.col("x") < F.least(F.col("cx_") + search.along_x, F.col("w_"))) & (F.abs(dy) <= reach)
    return marked.select(key, "x", "y", F.when(down, fade(dx)).when(across, fade(dy)).otherwise(F.col("v")).alias("v"))


def _inner(mask: np.ndarray) -> np.ndarray:
    """The mask without the image's outermost pixels, which never belong to a square."""
    out = np.zeros(mask.shape, bool)
    out[1:-1, 1:-1] = mask[1:-1, 1:-1]
    return out


def packed_fixed(mask: np.ndarray, side: int, overlap: int = 0, most: int = MOST_SQUARES) -> list[tuple[int, int, int]]:
    """(x, y, side): squares inside the mask that overlap by `overlap` at most: after each, the place below it is tried before the next free one in row order."""
    if overlap >= side:
        raise ValueError("squares can't overlap by their whole side")
    mask, step = _inner(mask), side - overlap
    h, w = mask.shape
    sums = np.zeros((h + 1, w + 1), np.int64)
    sums[1:, 1:] = mask.cumsum(0).cumsum(1)
    fits = np.zeros((h, w), bool)  # corners of squares that are wholly in the mask
    if h >= side and w >= side:
        fits[: h - side + 1, : w - side + 1] = sums[side:, side:] - sums[:-side, side:] - sums[side:, :-side] + sums[:-side, :-side] == side * side
    free, places, k, out = fits.ravel(), np.flatnonzero(fits), 0, []
    while len(out) < most:
        if out and out[-1][1] + step < h and fits[out[-1][1] + step, out[-1][0]]:
            x, y = out[-1][0], out[-1][1] + step
        else:
            while k < len(places) and not free[places[k]]:
                k += 1
            if k == len(places):
                break
            y, x = divmod(int(places[k]), w)
            k += 1
        out.append((x, y, side))
        fits[max(0, y - side + 1) : y + step, max(0, x - side + 1) : x + step] = False
    return out


def _reach(mask: np.ndarray) -> np.ndarray:
    """For each pixel of the mask how far the largest square around it reaches on every side."""
    out, now = np.zeros(mask.shape, np.int64), mask
    while now.any():
        smaller = np.zeros(mask.shape, bool)
        rows = now[:-2] & now[1:-1] & now[2:]
        smaller[1:-1, 1:-1] = rows[:, :-2] & rows[:, 1:-1] & rows[:, 2:]
        out += smaller
        now = smaller
    return out


def packed_decreasing(mask: np.ndarray, overlap: int = 0, most: int = MOST_SQUARES) -> list[tuple[int, int, int]]:
    """(x, y, side): the largest square of an odd side inside the mask (around the first of equal centres in row order), then the largest in what is left of it less the overlap, while more than one pixel is taken."""
    free = _inner(mask)
    out = []
    while len(out) < most:
        reach = _reach(free)
        y, x = divmod(int(reach.argmax()), free.shape[1])
        d = int(reach[y, x])
        taken = 2 * d + 1 - overlap
        if taken <= 1:
            break
        out.append((x - d, y - d, 2 * d + 1))
        half = taken // 2
        free[max(0, y - half) : y - half + taken, max(0, x - half) : x - half + taken] = False
    return out


def pack_squares(px: DataFrame, key: str, side: int, decreasing: bool = False, overlap: int = 0, most: int = MOST_SQUARES) -> DataFrame:
    """key, square, x, y, side: squares packed over what is set (v > 0) in each image; an image is one group. Decreasing ones have no given side."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        mask = _image(pdf) > 0
        found = packed_decreasing(mask, overlap, most) if decreasing else packed_fixed(mask, side, overlap, most)
        return pd.DataFrame([(pdf[key].iloc[0], k, *s) for k, s in enumerate(found)], columns=[key, "square", "x", "y", "side"])

    return px.groupBy(key).applyInPandas(run, f"{key} {px.schema[key].dataType.simpleString()}, square long, x long, y long, side long")
