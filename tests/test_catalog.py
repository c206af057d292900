"""Registered queries against DuckDB on the smallest tables, and properties of the operators."""

import collections
import os
import tracemalloc

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import scalars
from tessera.operators import components, graph, labels, raster, rects, rois, slide
from tessera.plans import catalog, catalog_functions, catalog_pyramids, catalog_sources  # noqa: F401

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f[:-8]} as select * from '{DATA}/{f}'")
    return con


def bag(rows):
    return collections.Counter(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_oracle(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    want = duck.sql(catalog.ORACLES[name])
    assert cols == sorted(want.columns)
    quoted = ", ".join(f'"{c}"' for c in cols)
    assert bag(map(tuple, df.select(*cols).collect())) == bag(duck.sql(f"select {quoted} from ({catalog.ORACLES[name]})").fetchall())


def test_golden_graph(spark):
    edges = [(1, 2, 7.0), (1, 3, 9.0), (1, 6, 14.0), (2, 3, 10.0), (2, 4, 15.0), (3, 6, 2.0), (3, 4, 11.0), (4, 5, 6.0), (5, 6, 9.0), (7, 8, 3.3)]
    df = spark.createDataFrame(edges, "src int, dst int, weight double")
    want = {1: (0, [1]), 2: (7, [1, 2]), 3: (9, [1, 3]), 4: (20, [1, 3, 4]), 5: (26, [1, 3, 4, 5]), 6: (11, [1, 3, 6])}
    for paths in (graph.shortest_paths(df, 1), graph.shortest_paths_dag(df, 1)):
        assert {r.vertex: (r.distance, r.path) for r in graph.routes(paths).collect()} == want


@pytest.mark.parametrize(
    ("own", "adj", "pairs"),
    [
        ([0, 0, 1, 1, 1, 0, 2, 2], [0, 3, 3, 3, 0, 0, 4, 4], [(1, 3), (2, 4)]),
        ([1, 1, 1, 1], [5, 5, 6, 6], [(1, 6)]),
        ([0, 1, 1, 0, 0, 0], [0, 0, 0, 0, 7, 7], []),
        ([0, 1, 1, 0], [8, 8, 8, 8], [(1, 8)]),
    ],
)
def test_linked_labels(own, adj, pairs):
    assert labels.linked_labels(np.array(own), np.array(adj)) == pairs


def test_best_links_is_cheapest():
    rng = np.random.default_rng(1)
    for _ in range(30):
        s, t = np.sort(rng.integers(0, 20, rng.integers(1, 5))), np.sort(rng.integers(0, 20, rng.integers(1, 5)))
        path, cost = labels.best_links(s.astype(float), t.astype(float))
        best = {(0, 0): abs(s[0] - t[0])}
        for i in range(len(s)):
            for j in range(len(t)):
                if (i, j) != (0, 0):
                    best[i, j] = abs(s[i] - t[j]) + min(best.get(p, np.inf) for p in ((i - 1, j), (i, j - 1), (i - 1, j - 1)))
        assert cost == best[len(s) - 1, len(t) - 1] and path[0] == (0, 0)
    with pytest.raises(ValueError):
        labels.best_links(np.array([2.0, 1.0]), np.array([1.0]))


def test_replayed_representatives(spark):
    pairs = {1: [(3, 1)], 2: [(1, 3)], 3: [(5, 2), (7, 5), (1, 7)]}
    rows = [(b, k, x, y) for b, ps in pairs.items() for k, (x, y) in enumerate(ps)]
    got = components.replayed(spark.createDataFrame(rows, "buffer_id long, pair_seq long, object1 long, object2 long")).collect()
    assert {r.buffer_id: r.base for r in got} == {1: 3, 2: 1, 3: 5}


def test_components_do_not_depend_on_order(spark):
    rng = np.random.default_rng(2)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 60, (50, 2))]
    one, two = (sorted(map(tuple, components.components(spark.createDataFrame(p, "object1 long, object2 long")).collect())) for p in (pairs, [(b, a) for a, b in reversed(pairs)]))
    assert one == two


def test_equalized_grid_keeps_the_count(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(int(a), int(b)) for a, b in zip(rng.integers(1, 5000, 500), rng.integers(1, 90, 500), strict=True)], "t long, c long")
    out = df.withColumn("e", scalars.equalize_grid("t", "c")).withColumns({"n": scalars.divide_ceil("t", "c"), "m": scalars.divide_ceil("t", "e")})
    assert out.where("n <> m or e > c").isEmpty()


def test_rotations_undo_each_other(spark):
    px = spark.range(15).selectExpr("id % 5 as x", "id div 5 as y", "id as v")
    there = raster.rotate(px, 90, 5, 3)
    assert bag(map(tuple, raster.rotate(there, 270, 3, 5).select("x", "y", "v").collect())) == bag(map(tuple, px.collect()))
    assert bag(map(tuple, raster.rotate(raster.rotate(px, 180, 5, 3), 180, 5, 3).select("x", "y", "v").collect())) == bag(map(tuple, px.collect()))


def test_tiles_cover_each_roi_once(spark):
    r = spark.createDataFrame([(0, 3, 40, -5, 20), (1, 0, 0, 0, 0)], "roi_index long, min_x long, max_x long, min_y long, max_y long")
    cells = rects.pixels_of(rects.tile_grid(r, 7, 9), "roi_index")
    assert cells.count() == cells.distinct().count() == 38 * 26 + 1


def test_overflow_and_bad_input_are_errors(spark):
    one = spark.range(1)
    for bad in (one.select(scalars.add_index_base(F.lit(5), F.lit(2147483645))), one.select(scalars.rotation_reverse(F.lit(45))), one.select(scalars.recommended_frames("m - 5", "1", "1", "true"))):
        with pytest.raises(Exception):
            bad.collect()
    with pytest.raises(ValueError):
        scalars.recommended_frames("__import__('os')", "1", "1", "true")


def test_roi_errors(spark):
    bad = spark.createDataFrame([('{"app":"other","rois":[]}',)], "json string")
    with pytest.raises(Exception):
        rois.parse_rois(bad).collect()


def test_description_errors(spark):
    bad = spark.createDataFrame([("x|MPP = wide",)], "t string").select(slide.pixel_size(slide.parse_description("t")))
    with pytest.raises(Exception):
        bad.collect()


def test_resizing(spark):
    rng = np.random.default_rng(4)
    image = rng.integers(0, 200, (7, 9))
    px = spark.createDataFrame([(x, y, int(image[y, x])) for y in range(7) for x in range(9)], "x long, y long, v long")
    fine = np.repeat(np.repeat(image, 2, 0), 2, 1)  # compressed 3 / 2 times: whole blocks of 3 x 3 halves
    want = {(x, y): int(fine[3 * y : 3 * y + 3, 3 * x : 3 * x + 3].sum()) // 9 for y in range(14 // 3) for x in range(18 // 3)}
    assert {(r.x, r.y): r.v for r in raster.resized(px, 9, 7, 3, 2).collect()} == want
    turned = {(r.x, r.y): r.v for r in raster.rotated_label(px, 90, 9, 7, 255).collect()}
    assert len(turned) == 63 and sum(v == 255 for v in turned.values()) == 63 - 5 * 7 and all(turned[x, y] == 255 for x in (0, 1, 7, 8) for y in range(7))
    half = raster.rotated_label(px, 180, 9, 7, 255).collect()
    assert {(r.x, r.y): r.v for r in half} == {(8 - x, 6 - y): int(image[y, x]) for y in range(7) for x in range(9)}
    with pytest.raises(ValueError):
        raster.resized(px, 9, 7, 1, 2)
    assert [tuple(r) for r in raster.displayed(px, (3, 2, 0, 0), 9, 7, 255, 1).collect()] == [(0, 0, 0)]


def test_running_sums(spark):
    rng = np.random.default_rng(5)
    keys = rng.permutation(500)
    df = spark.createDataFrame([(int(k), int(k) % 7) for k in keys], "k long, v long").repartition(5)
    want = np.concatenate([[0], np.cumsum(np.arange(500) % 7)])
    assert all(r.row == r.k + 1 and r.before == want[r.k] for r in rects.running(df, "k", "v").collect())
    assert rects.running(df.limit(0), "k").count() == 0


@pytest.mark.parametrize("name", ["component_sizes", "connected_components", "correlation_table", "stitched_raster"])
def test_objects_that_meet_at_a_frame_border_stay_apart(spark, tmp_path, name):
    """At row 224 objects and frames end together, and the objects below aren't those above."""
    con = duckdb.connect()
    con.execute(f"copy (select i as o_orderkey, i % 1000 as o_custkey from range(128 * 231) t(i)) to '{tmp_path}/orders.parquet'")
    con.execute(f"create view orders as select * from '{tmp_path}/orders.parquet'")
    df = catalog.QUERIES[name](spark, str(tmp_path))
    cols = sorted(df.columns)
    assert bag(map(tuple, df.select(*cols).collect())) == bag(con.execute(f"select {', '.join(cols)} from ({catalog.ORACLES[name]})").fetchall())


def _full_grid(s, t):
    """The cheapest linking over the whole grid: of equally cheap ways the one by both, then by the source, then by the target."""
    best, come = {(0, 0): 0.0}, {}
    for i in range(len(s)):
        for j in range(len(t)):
            if (i, j) != (0, 0):
                come[i, j] = min((p for p in ((i - 1, j - 1), (i - 1, j), (i, j - 1)) if p in best), key=best.get)
                best[i, j] = best[come[i, j]] + abs(s[i] - t[j])
    path = [(len(s) - 1, len(t) - 1)]
    while path[-1] != (0, 0):
        path.append(come[path[-1]])
    return path[::-1]


def test_best_links_are_those_of_the_whole_grid():
    rng = np.random.default_rng(7)
    for most in range(1, 301):
        s, t = (np.sort(rng.integers(0, most % 30 + 1, rng.integers(1, 14))).astype(float) for _ in "st")
        i, j = labels.best_path(s, t, most)
        assert list(zip(i.tolist(), j.tolist(), strict=True)) == _full_grid(s.tolist(), t.tolist())


def test_many_points_are_linked_in_little_memory():
    points = np.arange(20000, dtype=float)
    tracemalloc.start()
    i, j = labels.best_path(points, points + 0.25)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (i == j).all() and len(i) == 20000 and peak < 50e6  # the whole grid has 4e8 pairs


def test_groups_are_linked_together(spark):
    """Groups of one shape, of other shapes, with one side only; the number of groups that Python handles one by one doesn't grow."""
    rng = np.random.default_rng(8)
    groups = {g: [np.sort(rng.integers(0, 9, k)).astype(float) for k in ((4, 4) if g < 150 else rng.integers(0, 7, 2))] for g in range(180)}
    rows = [(g, side, float(v)) for g, two in groups.items() for side, vs in zip("ST", two, strict=True) for v in vs[::-1]]
    links = labels.link_points(spark.createDataFrame(rows, "g long, side string, v double"))
    assert "FlatMapGroups" not in links._jdf.queryExecution().toString()
    want = {(g, i, j, abs(s[i] - t[j])) for g, (s, t) in groups.items() if len(s) and len(t) for i, j in _full_grid(s.tolist(), t.tolist())}
    assert bag(map(tuple, links.collect())) == bag(want)


def test_frames_are_cropped_before_pixels_are_made(spark):
    px = spark.range(40 * 30).selectExpr("id % 40 as x", "id div 40 as y", "id as v")
    frames = [(0, 3, 20, 2, 18), (1, 5, 6, 5, 25), (2, 5, 30, 9, 9), (3, 35, 50, 25, 40), (4, -4, 9, -3, 9)]
    df = spark.createDataFrame(frames, "frame_seq long, min_x long, max_x long, min_y long, max_y long")
    for rect in ((2, 9, 1, 6), (0, 4, 0, 0), (-3, 1, -2, 2)):
        x0, x1, y0, y1 = rect
        want = {(k, x - a - x0, y - c - y0, y * 40 + x) for k, a, b, c, d in frames for x in range(40) for y in range(30) if a <= x <= b and c <= y <= d and x0 <= x - a <= x1 and y0 <= y - c <= y1}
        assert bag(map(tuple, raster.crop_frames(px, df, rect).collect())) == bag(want)
    assert raster.crop_frames(px, df, (2, 9, 1, 6))._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def test_crowded_cells_are_shared_out(spark):
    rng = np.random.default_rng(9)
    rows = [(k, x, x + w, y, y + h) for k, (x, y, w, h) in enumerate(rng.integers(-40, 40, (300, 4)).tolist())]
    df = spark.createDataFrame(rows, "roi_index long, min_x long, max_x long, min_y long, max_y long")
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and all(r[1] <= r[2] and r[3] <= r[4] for r in (a, b)) and a[1] <= b[2] and a[2] >= b[1] and a[3] <= b[4] and a[4] >= b[3]}
    found = rects.roi_overlaps(df, block=10, pairs_a_task=200).withColumn("task", F.spark_partition_id()).collect()
    assert bag((r.i, r.j) for r in found) == bag(want)
    assert max(collections.Counter(r.task for r in found).values()) < len(want) / 4
    assert rects.roi_overlaps(df.limit(0)).count() == 0
