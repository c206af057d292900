"""Labelled frames: re-indexing, runs along sides, and the alignment of labels across frame borders."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalars import add_index_base
from tessera.operators.rects import adjacent_frames, running

NO_LABEL = -1


def indexing_base(lab: DataFrame, zero_reserved: bool = True, order: str = "frame_seq") -> DataFrame:
    """frame, base: the sum of the largest labels (plus one unless zero is reserved) of all earlier frames."""
    top = lab.groupBy(order).agg((F.max("label") + (0 if zero_reserved else 1)).cast("bigint").alias("m"))
    return running(top, order, "m").select(order, F.col("before").cast("bigint").alias("base"))


def number_of_objects(lab: DataFrame, zero_reserved: bool = True, order: str = "frame_seq") -> DataFrame:
    """n: one more than the last index in use."""
    top = lab.groupBy(order).agg((F.max("label") + (0 if zero_reserved else 1)).alias("m"))
    return top.agg((F.sum("m") + (1 if zero_reserved else 0)).alias("n"))


def auto_reindex(lab: DataFrame, zero_reserved: bool = True, order: str = "frame_seq") -> DataFrame:
    """Labels made unique over frames by adding each frame's base; the base table has a row for each frame, the pixels aren't sorted."""
    return lab.join(indexing_base(lab, zero_reserved, order), order).withColumn("label", add_index_base("label", "base", zero_reserved)).drop("base")


def dense_labels(lab: DataFrame, column: str = "label") -> DataFrame:
    """label, n: non-zero labels numbered 1.. in order; a sorted scan numbers each range partition and offsets them, so no task holds all labels."""
    return running(lab.select(column).where(F.col(column) != 0).distinct(), column).select(column, F.col("row").alias("n"))


def sequential_reindex(lab: DataFrame, column: str = "label") -> DataFrame:
    """Adds n: labels replaced by 1.. in increasing order, zero kept."""
    return lab.join(dense_labels(lab, column), column, "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("bigint"))


def restoring_table(lab: DataFrame, column: str = "label", zero_based: bool = False) -> DataFrame:
    """n, label: the inverse of sequential_reindex; zero_based adds the background's row."""
    table = dense_labels(lab, column).select("n", F.col(column).alias("label"))
    return table.unionByName(table.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("label"))) if zero_based else table


def label_range(lab: DataFrame, *keys: str) -> DataFrame:
    some = F.when(F.col("label") != 0, F.col("label"))
    return lab.groupBy(*keys).agg(F.min(some).alias("low"), F.max(some).alias("high"))


def distinct_labels(lab: DataFrame, *keys: str) -> DataFrame:
    return lab.where("label != 0").select(*keys, "label").distinct()


def label_validity(lab: DataFrame) -> DataFrame:
    """valid: whether labels are whole, not negative and below 2^31, and there are any."""
    whole = lab.schema["label"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    return lab.agg((F.lit(whole) & (F.count("label") > 0) & (F.min("label") >= 0) & (F.max("label") <= 2147483647)).alias("valid")).select(F.coalesce("valid", F.lit(False)).alias("valid"))


def frame_compatibility(frames: DataFrame) -> DataFrame:
    """compatible: whether all frames have one element type, channel count and size."""
    kinds = F.count_distinct("element_type", "channels", "w", "h")
    return frames.agg((kinds <= 1).alias("compatible"))


def side_pixels(lab: DataFrame, frames: DataFrame, key: str = "frame_seq") -> DataFrame:
    """frame, side, pos, own, adj: labels along each frame's four sides and those facing them from adjacent frames (the latest wins, NO_LABEL where none)."""
    edges = []
    own = lab.join(frames, key)
    for side, at, pos, dx, dy in (("X_MINUS", "x = min_x", "y", -1, 0), ("Y_MINUS", "y = min_y", "x", 0, -1), ("X_PLUS", "x = max_x", "y", 1, 0), ("Y_PLUS", "y = max_y", "x", 0, 1)):
        edges.append(own.where(at).select(F.col(key), F.lit(side).alias("side"), F.col(pos).alias("pos"), F.col("label").alias("own"), (F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y")))
    rows = edges[0]
    for e in edges[1:]:
        rows = rows.unionByName(e)
    facing = lab.select(F.col(key).alias("b"), "x", "y", F.col("label").alias("adj"))
    touching = adjacent_frames(frames, key).select(F.col("a").alias(key), "b", "side")
    met = rows.join(touching, [key, "side"]).join(facing, ["b", "x", "y"]).groupBy(key, "side", "pos").agg(F.max_by("adj", "b").alias("adj"))
    return rows.join(met, [key, "side", "pos"], "left").select(key, "side", "pos", "own", F.coalesce("adj", F.lit(NO_LABEL)).cast("bigint").alias("adj"))


def side_runs(line: DataFrame, key: str, pos: str = "pos", label: str = "label") -> DataFrame:
    """key, pos, label at every change along a line, its start among them."""
    before = F.lag(label).over(Window.partitionBy(key).orderBy(pos))
    return line.withColumn("p_", before).where(F.col("p_").isNull() | (F.col("p_") != F.col(label))).select(key, pos, label)


def changes(labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where a line of labels changes (its start and its length too), and the label to the right of each (-1 at the end)."""
    at = np.concatenate([[0], np.flatnonzero(np.diff(labels)) + 1]).astype(np.int64)
    return np.append(at, len(labels)), np.append(labels[at], NO_LABEL)


def _band(source: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each source the range of targets that a cheapest linking can join it with.

    Of a link over a target and a source beyond it, both between its ends, the two halves without the part between them are cheaper: from a
    source on, links reach as far as the next larger source after the next target, and the same to the left.
    """
    at = np.searchsorted(target, source)
    after = np.append(target, np.inf)[at]
    high = np.searchsorted(target, np.append(source, np.inf)[np.searchsorted(source, after, "right")])
    at = np.searchsorted(target, source, "right")
    before = np.append(-np.inf, target)[at]
    low = np.searchsorted(target, np.append(-np.inf, source)[np.searchsorted(source, before)], "right")
    return low, high


class _Diagonals:
    """The grid of best_links() by sums of indices, as far as the band reaches: pairs of one sum depend on those of the two sums before only."""

    def __init__(self, source: np.ndarray, target: np.ndarray):
        self.s, self.t = source, target
        n, m = len(source), len(target)
        low, high = _band(source, target) if np.isfinite(source).all() and np.isfinite(target).all() else (np.zeros(n, np.int64), np.full(n, m))
        i, d = np.arange(n), np.arange(n + m - 1)
        # rows of each diagonal: both bounds of a row rise with it
        self.first, self.end = np.searchsorted(i + high, d, "right"), np.searchsorted(i + low, d, "right")
        self.cells = np.concatenate([[0], np.cumsum(self.end - self.first)])

    def start(self) -> tuple:
        return 0, np.zeros(1), 0, np.empty(0)

    def run(self, begin: int, end: int, state: tuple, come: np.ndarray | None = None) -> tuple:
        """From the state (first row and costs of the last diagonal and of the one before it) to that before `end`; come takes how each pair is reached."""
        row1, best1, row2, best2 = state
        for d in range(begin, end):
            a, z = int(self.first[d]), int(self.end[d])
            ways = np.full((3, z - a), np.inf)  # both raised, the source, the target: the first of equally cheap ones stays
            for k, (row, best, shift) in enumerate(((row2, best2, 1), (row1, best1, 1), (row1, best1, 0))):
                x, y = max(a, row + shift), min(z, row + shift + len(best))
                if x < y:
                    ways[k, x - a : y - a] = best[x - row - shift : y - row - shift]
            how = ways.argmin(0)
            if come is not None:
                come[self.cells[d] - self.cells[begin] : self.cells[d + 1] - self.cells[begin]] = how
            now = ways[how, np.arange(z - a)] + np.abs(self.s[a:z] - self.t[d - z + 1 : d - a + 1][::-1])
            row2, best2, row1, best1 = row1, best1, a, now
        return row1, best1, row2, best2

    def path(self, most: int) -> tuple[np.ndarray, np.ndarray]:
        """How pairs are reached is kept for blocks of diagonals with at most so many pairs (or one diagonal), the last first; of others only the state at their start."""
        total = len(self.first)
        cuts, states = [1], [self.start()]
        while cuts[-1] < total:
            nxt = min(total, max(cuts[-1] + 1, int(np.searchsorted(self.cells, self.cells[cuts[-1]] + most, "right")) - 1))
            if nxt < total:
                states.append(self.run(cuts[-1], nxt, states[-1]))
            cuts.append(nxt)
        i, j = len(self.s) - 1, len(self.t) - 1
        rows, columns = [i], [j]
        for k in range(len(states) - 1, -1, -1):
            begin, end = cuts[k], cuts[k + 1] if k + 1 < len(cuts) else total
            come = np.empty(self.cells[end] - self.cells[begin], np.int8)
            self.run(begin, end, states[k], come)
            first, base = self.first[begin:end].tolist(), (self.cells[begin:end] - self.cells[begin]).tolist()
            while i + j >= begin:
                d = i + j - begin
                h = come[base[d] + i - first[d]]
                i, j = i - (h != 2), j - (h != 1)
                rows.append(i)
                columns.append(j)
        return np.array(rows[::-1]), np.array(columns[::-1])


def best_path(source: np.ndarray, target: np.ndarray, most: int = 1 << 24) -> tuple[np.ndarray, np.ndarray]:
    """best_links() as arrays of indices. Memory: the points and `most` pairs at a time; time: the pairs in the band, which are few unless many points are equal or lie apart from all of the other side."""
    if not points_sorted(source) or not points_sorted(target):
        raise ValueError("points must be sorted")
    return _Diagonals(source, target).path(most)


def best_links(source: np.ndarray, target: np.ndarray) -> tuple[list[tuple[int, int]], float]:
    """The cheapest many-to-many linking of two sorted point sets: the grid path from first to last pair whose steps raise one or both
    indices, each costing the distance of the points it reaches. Of equally cheap ways the one by both, then by the source, then by the target."""
    i, j = best_path(source, target)
    return list(zip(i.tolist(), j.tolist(), strict=True)), float(sum(np.abs(source[i] - target[j]).astype(float)[::-1]))


def points_sorted(points: np.ndarray) -> bool:
    return not (np.diff(points) < 0).any()


def sortedness(points: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """key, is_sorted: whether each group's values don't fall in its order."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(order))
    return points.withColumn("falls_", F.coalesce(before > F.col(value), F.lit(False))).groupBy(key).agg((~F.max("falls_")).alias("is_sorted"))


def linked_labels(own: np.ndarray, adj: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of labels that continue across a border: those after each step of the linking that moves along both lines."""
    s, s_label = changes(own)
    t, t_label = changes(adj)
    path, _ = best_links(s.astype(float), t.astype(float))
    out = []
    for (a, b), (c, d) in zip(path, path[1:], strict=False):
        if c == a + 1 and d == b + 1:
            pair = int(s_label[a]), int(t_label[b])
            if pair[0] != 0 and pair[1] > 0 and pair[0] != pair[1]:
                out.append(pair)
    return out


def side_link_pairs(sides: DataFrame, key: str = "frame_seq", only: tuple[str, ...] = ("X_MINUS", "Y_MINUS", "X_PLUS", "Y_PLUS")) -> DataFrame:
    """frame, side, k, object1, object2 from side_pixels; each group is one side of one frame."""
    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        found = linked_labels(pdf["own"].to_numpy(), pdf["adj"].to_numpy())
        head = pdf.iloc[0]
        return pd.DataFrame({key: head[key], "side": head["side"], "k": range(len(found)), "object1": [a for a, _ in found], "object2": [b for _, b in found]}).astype({key: "int64", "k": "int64", "object1": "int64", "object2": "int64"})

    return sides.where(F.col("side").isin(*only)).groupBy(key, "side").applyInPandas(link, f"{key} long, side string, k long, object1 long, object2 long")


def stitched_pairs(lab: DataFrame, frames: DataFrame, key: str = "frame_seq", kind: str | None = None) -> DataFrame:
    """object1, object2: pairs met while frames arrive in order, each against the frames before it. Labels must be unique over frames.

    The linking goes by where labels change along a border: different objects that end at the border and face each other are met too. Where
    it is known what the pixels are parts of (the column kind, one for each label), only pairs of one kind are links.
    """
    sides = side_pixels(lab, frames, key)
    owner = lab.where("label != 0").groupBy("label").agg(F.min(key).alias("of"))
    earlier = sides.join(owner.withColumnRenamed("label", "adj"), "adj", "left").withColumn("adj", F.when(F.coalesce("of", F.lit(-1)) <= F.col(key), F.col("adj")).otherwise(F.lit(NO_LABEL).cast("bigint"))).drop("of")
    pairs = side_link_pairs(earlier, key).select("object1", "object2").distinct()
    if kind is None:
        return pairs
    kinds = lab.where("label != 0").groupBy("label").agg(F.min(kind).alias("kind"))
    one, two = (kinds.select(F.col("label").alias(f"object{i}"), F.col("kind").alias(f"kind{i}")) for i in (1, 2))
    return pairs.join(one, "object1").join(two, "object2").where("kind1 = kind2").select("object1", "object2")


def _paths_of_shape(s: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """best_path() of many pairs of point sets of one shape at once (s: groups x n, t: groups x m): group, i, j of all pairs."""
    (size, n), m = s.shape, t.shape[1]
    best, come = {}, np.zeros((n, m, size), np.int8)
    for i in range(n):
        for j in range(m):
            if i == j == 0:
                best[0, 0] = np.zeros(size)
                continue
            ways = [(k, best[p]) for k, p in enumerate(((i - 1, j - 1), (i - 1, j), (i, j - 1))) if p in best]
            how, least = np.full(size, ways[0][0], np.int8), ways[0][1]
            for k, w in ways[1:]:
                how[w < least] = k
                least = np.minimum(w, least)
            come[i, j] = how
            best[i, j] = least + np.abs(s[:, i] - t[:, j])
        for j in range(m):
            best.pop((i - 1, j), None)
    every, i, j = np.arange(size), np.full(size, n - 1), np.full(size, m - 1)
    steps, on = [(i, j, np.ones(size, bool))], (i > 0) | (j > 0)
    while on.any():
        h = come[i, j, every]
        i, j = i - (on & (h != 2)), j - (on & (h != 1))
        steps.append((i, j, on))
        on = (i > 0) | (j > 0)
    i, j, on = (np.stack(c[::-1], 1) for c in zip(*steps, strict=True))
    return np.nonzero(on)[0], i[on], j[on]


def link_points(points: DataFrame, key: str = "g") -> DataFrame:
    """g, i, j, cost: the cheapest linking within each group of points (side S or T, v).

    Groups come as rows of two sorted arrays. Those of one shape are linked together, if they are many for their size; large ones one by one.
    """
    own = lambda c: F.sort_array(F.collect_list(F.when(F.col("side") == c, F.coalesce(F.col("v").cast("double"), F.lit(float("nan")))))).alias(c)

    def linked(keys: np.ndarray, s: tuple, t: tuple) -> Iterator[tuple]:
        n, m = np.diff(s[0]), np.diff(t[0])
        shapes, of, many = np.unique(np.stack([n, m], 1), axis=0, return_inverse=True, return_counts=True)
        groups = np.split(np.argsort(of.ravel(), kind="stable"), np.cumsum(many)[:-1])
        for (a, b), at in zip(shapes.tolist(), groups, strict=True):
            if not a or not b:
                continue
            together = max(1, (1 << 20) // (a * b)) if 2 * a * b <= len(at) * (a + b) else 1
            for k in range(0, len(at), together):
                some = at[k : k + together]
                x, y = (v[off[some][:, None] + np.arange(size)] for (off, v), size in ((s, a), (t, b)))
                g, i, j = _paths_of_shape(x, y) if together > 1 else (0, *best_path(x[0], y[0]))
                yield np.broadcast_to(keys[some][g], i.shape), i, j, np.abs(x[g, i] - y[g, j])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s, t = ((c.offsets.to_numpy(), c.values.to_numpy(zero_copy_only=False)) for c in (b.column(1), b.column(2)))
            for found in linked(b.column(0).to_numpy(zero_copy_only=False), s, t):
                for k in range(0, len(found[1]), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(c[k : k + (1 << 16)], f) for c, f in zip(found, (pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)], [key, "i", "j", "cost"])

    grouped = points.where(F.col("side").isin("S", "T")).groupBy(key).agg(own("S"), own("T"))
    return grouped.select(F.col(key).cast("long"), "S", "T").mapInArrow(run, f"{key} long, i long, j long, cost double")


def link_cost(links: DataFrame, key: str = "g") -> DataFrame:
    return links.groupBy(key).agg(F.sum("cost").alias("cost"))


def pairs_from_array(arrays: DataFrame, key: str, column: str) -> DataFrame:
    """key, pair_seq, object1, object2 from flat arrays; equal pairs go; odd lengths and negative values are errors."""
    a = F.col(column)
    bad = (F.size(a) % 2 != 0) | F.exists(a, lambda v: v < 0)
    checked = arrays.select(key, F.when(bad, F.raise_error(F.lit("pairs need an even number of labels, none negative")).cast(arrays.schema[column].dataType)).otherwise(a).alias("a"))
    pairs = checked.select(key, F.posexplode(F.expr("transform(sequence(0, size(a) div 2 - 1), i -> struct(a[2 * i] AS object1, a[2 * i + 1] AS object2))")).alias("pair_seq", "p"))
    return pairs.select(key, F.col("pair_seq").cast("bigint").alias("pair_seq"), "p.object1", "p.object2").where("object1 != object2")
