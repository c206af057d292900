import numpy as np
import pytest

from tessera.operators import buffer, recognise
from tessera.streaming.buffer import stitched_stream


def events():
    rng = np.random.default_rng(7)
    rows = []
    for b in (1, 2):
        rows.append((b, 0, "INIT", 3, None, None, None, None, None, None))
        for k in range(1, 9):
            labels = np.repeat(rng.integers(0, 4, (2, 8)), 4, axis=0)
            rows.append((b, k, "FRAME", None, None, 8 * ((k - 1) % 3), 8 * ((k - 1) // 3), 8, 8, labels.ravel().tolist()))
        rows.append((b, 9, "CAPACITY", 1, None, None, None, None, None, None))
        rows.append((b, 10, "FRAME", None, None, 100, 100, 8, 8, [1] * 64))
    rows.append((1, 11, "CLEAR", None, True, None, None, None, None, None))
    rows.append((1, 12, "FRAME", None, None, 0, 0, 8, 8, [2] * 64))
    return rows


def key(r):
    return tuple(-1 if v is None else v for v in r)


def test_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame(events(), buffer.EVENTS)
    batch = sorted(map(key, buffer.replay(df).collect()))
    for k in range(3):
        df.where(f"seq div 5 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = stitched_stream(spark.readStream.schema(buffer.EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("stitched").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(key, spark.table("stitched").collect())) == batch


def test_rules():
    b = buffer.Buffer(capacity=2)
    one = np.array([[0, 1], [1, 1]])
    assert b.append(1, 0, 0, one) == ([], None)
    links, gone = b.append(2, 2, 0, one)
    assert b.base == 2 and gone is None and links == buffer.linked_labels(np.array([0, 2]), np.array([1, 1]))
    b.capacity = 1
    assert b.append(3, 50, 50, one)[1] == 1 and len(b.frames) == 2
    with pytest.raises(ValueError):
        b.append(4, 0, 0, np.zeros((3, 3), int))
    with pytest.raises(ValueError):
        b.append(5, 0, 0, np.array([[0, -1], [0, 0]]))


def test_median_and_erosion(spark):
    rng = np.random.default_rng(1)
    image = rng.integers(0, 9, (7, 6))
    px = spark.createDataFrame([(x, y, int(image[y, x])) for y in range(7) for x in range(6)], "x long, y long, v long")
    padded = np.pad(image, 1, "symmetric")
    want = {(x, y, int(np.sort(padded[y : y + 3, x : x + 3].ravel())[4])) for y in range(7) for x in range(6)}
    assert set(map(tuple, recognise.median_filter(px, 1).collect())) == want
    got = {(r.x, r.y) for r in recognise.erosion(px, 2).collect()}
    assert got == {(x, y) for y in range(6) for x in range(5) if (image[y : y + 2, x : x + 2] > 0).all()}


def test_squares():
    mask = np.zeros((14, 14), bool)
    mask[1:7, 2:9] = True
    mask[9:12, 1:4] = True
    for found in (recognise.packed_fixed(mask, 3), recognise.packed_decreasing(mask)):
        cover = np.zeros(mask.shape, int)
        for x, y, s in found:
            cover[y : y + s, x : x + s] += 1
        assert cover.max() == 1 and not cover[~mask].any()
    # after a square the place below it is tried before the next free one in the row
    assert recognise.packed_fixed(mask, 3) == [(2, 1, 3), (2, 4, 3), (5, 1, 3), (5, 4, 3), (1, 9, 3)]
    assert recognise.packed_decreasing(mask)[:2] == [(2, 1, 5), (1, 9, 3)]
    assert recognise.packed_fixed(mask, 3, most=2) == [(2, 1, 3), (2, 4, 3)]
    full = np.ones((9, 9), bool)
    # the outermost pixels belong to no square; squares that overlap start two pixels apart
    assert recognise.packed_fixed(full, 3, 1) == [(1, y, 3) for y in (1, 3, 5)] + [(3, y, 3) for y in (1, 3, 5)] + [(5, y, 3) for y in (1, 3, 5)]
    assert recognise.packed_decreasing(full) == [(1, 1, 7)] and recognise.packed_decreasing(np.ones((3, 3), bool)) == []
    with pytest.raises(ValueError):
        recognise.packed_fixed(full, 3, 3)


def brute_reach(mask):
    h, w = mask.shape
    out = np.zeros(mask.shape, int)
    for y in range(h):
        for x in range(w):
            d = -1
            while y - d - 1 >= 0 and x - d - 1 >= 0 and y + d + 1 < h and x + d + 1 < w and mask[y - d - 1 : y + d + 2, x - d - 1 : x + d + 2].all():
                d += 1
            out[y, x] = max(d, 0)
    return out


def test_reach_of_squares():
    rng = np.random.default_rng(5)
    for _ in range(10):
        mask = recognise._inner(rng.random((17, 13)) < 0.93)
        assert np.array_equal(recognise._reach(mask), brute_reach(mask))


def brute_quality(image, smooth, x, y, p):
    """A corner's quality, pixel by pixel, from its definition."""
    h, w = image.shape
    corner = int(image[y, x])
    outside = int(smooth[max(0, y - p.background_y // 2 - 2), max(0, x - p.background_x // 2 - 2)])
    inside = int(smooth[min(h - 1, y + p.background_y // 2 + 2), min(w - 1, x + p.background_x // 2 + 2)])
    difference = min(abs(corner - outside), abs(corner - inside)) / 255
    if difference < p.least_difference:
        return float("nan")
    seen = [corner]
    for line, at, length in ((image[y], x, p.along_x), (image[:, x], y, p.along_y)):
        end = stop = min(at + length, len(line) - 1)
        for k in range(at, end):
            if abs(int(line[k]) - outside) < abs(int(line[k]) - corner):
                stop = max((at + k) // 2, min(at + p.least_along, len(line) - 1))
                break
        seen += [int(v) for v in line[at:stop]]
    variation = (max(seen) - min(seen)) / 255
    return float("nan") if variation > p.most_variation else -(variation + p.variation_softening) / (difference + p.difference_softening)


def test_corner_quality(spark):
    p = recognise.Search(along_x=9, along_y=7, least_along=3, background_x=5, background_y=4)
    rng = np.random.default_rng(6)
    image = np.full((26, 30), 220) + rng.integers(0, 9, (26, 30))
    image[8:, 11:] = 40 + rng.integers(0, 9, (18, 19))
    image[8, 9:] = image[8:, 9] = 120
    px = spark.createDataFrame([(0, x, y, int(image[y, x])) for y in range(26) for x in range(30)], "k long, x long, y long, v long")
    smooth = recognise.averaged(image, p)
    padded = np.pad(image, ((1, 2), (2, 2)), "symmetric")
    assert all(smooth[y, x] == np.sort(padded[y : y + 4, x : x + 5].ravel())[9] for y in range(26) for x in range(30))
    found = {(r.x, r.y): r.q for r in recognise.corner_qualities(px, "k", p).collect()}
    assert set(found) == {(x, y) for y in range(26 - 7) for x in range(30 - 9)}
    for (x, y), q in found.items():
        assert q == pytest.approx(brute_quality(image, smooth, x, y, p), nan_ok=True)
    some = [(x, y, q) for (x, y), q in found.items() if q == q]
    best = recognise.best_corner(recognise.corner_qualities(px, "k", p)).first()
    assert some and (best.x, best.y) == min(some, key=lambda s: (-s[2], s[1], s[0]))[:2] == (9, 8)
    near = recognise.Search(along_x=9, along_y=7, search_x=4, search_y=2)
    assert near.window(30, 26, (10, 9)) == (8, 12, 8, 10)
    spark.conf.set("spark.tessera.corner.along_x", "7")
    spark.conf.set("spark.tessera.corner.most_variation", "0.5")
    own = recognise.Search.from_conf(spark)
    spark.conf.unset("spark.tessera.corner.along_x")
    spark.conf.unset("spark.tessera.corner.most_variation")
    assert (own.along_x, own.most_variation, own.along_y) == (7, 0.5, 100)
    shown = {(r.x, r.y): r.v for r in recognise.quality_map(px, recognise.corner_qualities(px, "k", p), "k", 50.0).collect()}
    assert shown[29, 25] == 128 and all(shown[k] == (0 if q != q else int(max(0, 255 + 50 * q))) for k, q in found.items())
    assert recognise.pack_squares(px, "k", 4).count() > 0


def test_partial_objects_follow_the_frames():
    """An object that goes on beyond the frames is partial until a later frame completes it."""
    b = buffer.Buffer(capacity=5)
    left = np.array([[0, 0, 0], [0, 1, 1], [0, 0, 0]])
    right = np.array([[0, 0, 0], [1, 0, 0], [0, 2, 0]])
    b.append(1, 0, 0, left)
    assert b.joint() == set() and b.partial == {1}
    b.append(2, 3, 0, right)
    assert b.union.base(2) == b.union.base(1)
    assert b.joint() >= {b.union.base(1)} and 1 not in b.partial and b.partial == {3}
    assert [(k, raw, p) for k, _, raw, p in b.correlations()] == [(1, False, False), (2, False, False), (3, True, True)]
    assert b.read(2, 1, 3, 1).tolist() == [[1, 2, 0]] and b.based(b.read(2, 1, 2, 1)).tolist() == [[b.union.base(1)] * 2]
    with pytest.raises(ValueError):
        buffer.Buffer().joint()


def test_remove_forgets_the_buffer(spark):
    rows = [(1, 0, "INIT", 3, None, None, None, None, None, None)]
    rows += [(1, 1, "FRAME", None, None, 0, 0, 2, 2, [1, 1, 2, 2]), (1, 2, "READ", None, False, 0, 0, 2, 2, None), (1, 3, "REMOVE", None, None, None, None, None, None, None)]
    rows += [(1, 4, "FRAME", None, None, 0, 0, 3, 1, [1, 0, 1]), (1, 5, "READ", None, True, -1, 0, 3, 1, None)]
    events = spark.createDataFrame(rows, buffer.EVENTS)
    assert [(r.seq, r.base, r.n_stored) for r in buffer.replay(events).orderBy("seq").collect()] == [(1, 0, 1), (4, 0, 1)]
    got = {(r.seq, r.x, r.y): r.v for r in buffer.reads(events).collect()}
    assert got == {(2, 0, 0): 1, (2, 1, 0): 1, (2, 0, 1): 2, (2, 1, 1): 2, (5, -1, 0): 0, (5, 0, 0): 1, (5, 1, 0): 0}
    assert [tuple(r) for r in buffer.correlation_tables(events, 0).orderBy("label").collect()] == [(1, 0, 0, False, False), (1, 1, 1, False, False)]


def test_rectangles_of_a_buffer():
    b = buffer.Buffer(capacity=2)
    b.append(1, 0, 0, np.ones((3, 4), int))
    assert b.change(None, "EXPAND", 2, 1) == (-2, 5, -1, 3) and b.change(None, "LEFT_DOWN", 2, 1, True) == (-2, 1, 1, 3)
    assert b.change((0, 3, 0, 2), "RIGHT_UP", 1, 1, True, (0, 9, 0, 9)) == (1, 4, 0, 1)
    for bad in (lambda: b.change((0, 4, 0, 2), "EXPAND", 0, 0, True), lambda: b.change(None, "LEFT_UP", 50, 0, False, (0, 9, 0, 9)), lambda: buffer.Buffer().change(None, "EXPAND", 1, 1)):
        with pytest.raises(ValueError):
            bad()
