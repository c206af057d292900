import numpy as np
import pytest

from tessera.sources import tiff, tiff_codec


@pytest.mark.parametrize("compression", sorted(tiff_codec.CODECS))
@pytest.mark.parametrize("kind", ["uint8", "uint16", "int32", "float32"])
@pytest.mark.parametrize("tile", [None, 16])
@pytest.mark.parametrize(("order", "big"), [("<", False), (">", True)])
def test_codec_round_trip(compression, kind, tile, order, big):
    rng = np.random.default_rng(1)
    image = np.repeat(rng.integers(0, 200, (37, 23, 3)), 2, axis=1).astype(kind)
    data = tiff_codec.write(image, compression, tile, True, "some text", order, big)
    d = tiff_codec.directories(data)[0]
    assert (d.width, d.height, d.channels, d.description) == (46, 37, 3, "some text")
    assert np.array_equal(tiff_codec.read(data, d), image)
    part = tiff_codec.read(data, d, (40, 30, 10, 10))
    assert np.array_equal(part[:7, :6], image[30:, 40:]) and not part[7:].any() and not part[:, 6:].any()


def test_packers():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 3, 127, 128, 129, 5000, 70_000):
        for top in (1, 3, 256):
            raw = rng.integers(0, top, n).astype(np.uint8).tobytes()
            assert tiff_codec.unpack_bits(tiff_codec.pack_bits(raw)) == raw
            assert tiff_codec.lzw_decode(tiff_codec.lzw_encode(raw)) == raw


def test_append_and_errors():
    one = tiff_codec.write(np.zeros((4, 5, 1), np.uint8))
    two = tiff_codec.write(np.ones((6, 7, 1), np.uint16), before=one)
    assert [(d.width, d.height) for d in tiff_codec.directories(two)] == [(5, 4), (7, 6)]
    for bad in (b"", b"II*", b"nothing here", two[:40]):
        with pytest.raises(tiff_codec.TiffError):
            tiff_codec.directories(bad)
    with pytest.raises(tiff_codec.TiffError):
        tiff_codec.write(np.zeros((1, 1, 1), np.uint8), "JPEG_RGB")


def test_spark_round_trip(spark, tmp_path):
    px = spark.range(30 * 20).selectExpr("'img.tif' as name", "0 as channel", "id % 30 as x", "id div 30 as y", "id % 251 as v")
    spark.dataSource.register(tiff.TiffDataSource)
    tiff.encode_images(px, "name", tile=16).write.format("tiff").mode("append").save(str(tmp_path / "out"))
    (tmp_path / "out" / "odd.tif").write_bytes(b"no image")
    found = tiff.files(spark, str(tmp_path / "out" / "*.tif"))
    info = {r.valid: r for r in tiff.tiff_info(found).collect()}
    assert (info[True].dim_x, info[True].dim_y, info[True].element_type) == (30, 20, "uint8") and info[False].ifd_index is None
    with pytest.raises(Exception):
        tiff.tiff_info(found, "FAILFAST").collect()
    back = tiff.tiff_read(found.where("path like '%img.tif'"), area=(10, 5, 12, 9))
    assert {(r.x, r.y, r.v) for r in back.collect()} == {(x, y, float((y * 30 + x) % 251)) for x in range(10, 22) for y in range(5, 14)}
    assert tiff.tiff_read(found, channels=3, mode="PERMISSIVE").count() == 1800
    assert tiff.all_ifds_json(tiff.tiff_info(found)).count() == 1


def test_channels_are_converted_in_the_tile():
    v = np.arange(24, dtype=np.uint8).reshape(2, 3, 4)
    assert tiff.converted(v, 0) is v and tiff.converted(v, 4) is v
    assert np.array_equal(tiff.converted(v, 3), v[:, :, :3])
    assert np.array_equal(tiff.converted(v, 1)[:, :, 0], v[:, :, :3].astype(float).mean(2))
    assert np.array_equal(tiff.converted(v[:, :, :1], 3), np.repeat(v[:, :, :1], 3, 2))
    assert np.array_equal(tiff.converted(v[:, :, :2], 4), np.concatenate([np.repeat(v[:, :, :1], 3, 2), np.full((2, 3, 1), 255.0)], 2))
    with pytest.raises(ValueError):
        tiff.converted(v, 2)


def test_writer_leaves_no_parts_and_takes_no_name_twice(spark, tmp_path):
    spark.dataSource.register(tiff.TiffDataSource)
    out = tmp_path / "out"
    spark.createDataFrame([("a.bin", b"1"), ("b.bin", b"22")], "name string, content binary").repartition(2).write.format("tiff").mode("append").save(str(out))
    assert sorted(p.name for p in out.iterdir()) == ["a.bin", "b.bin"] and (out / "b.bin").read_bytes() == b"22"
    twice = spark.createDataFrame([("c.bin", b"1"), ("c.bin", b"2")], "name string, content binary")
    for n in (1, 2):
        with pytest.raises(Exception):
            twice.repartition(n, "content").write.format("tiff").mode("append").save(str(out))
    assert sorted(p.name for p in out.iterdir() if p.is_file()) == ["a.bin", "b.bin"]


def test_readers_by_extension(spark, tmp_path):
    from tessera.sources import image, pyramids

    rng = np.random.default_rng(3)
    for channels in (1, 3, 4):
        v = rng.integers(0, 256, (9, 11, channels))
        (tmp_path / f"c{channels}.png").write_bytes(image.png(v))
        px = image.image_pixels(image.images(spark, str(tmp_path / f"c{channels}.png"))).collect()
        assert {(r.x, r.y, r.channel, r.v) for r in px} == {(x, y, c, int(v[y, x, c])) for y in range(9) for x in range(11) for c in range(channels)}
    tiles = pyramids.open_pyramids(spark, str(tmp_path / "c3.png"))
    assert [(r.level, r.dim_x, r.dim_y) for r in pyramids.levels_of(tiles).collect()] == [(0, 11, 9)]
    frames = pyramids.read_frames(tiles, 0, 6, 5)
    assert frames.count() == 9 * 11 * 3 and frames.where("first_in_pyramid").select("frame_index").distinct().collect()[0][0] == 0
    whole = pyramids.read_frames(tiles, 0, 6, 5, None)
    assert whole.where("last").count() == 9 * 11 * 3
    with pytest.raises(NotImplementedError):
        pyramids.open_pyramids(spark, "x.unknown")
    pyramids.register("unknown", lambda s, path: tiles)
    assert pyramids.open_pyramids(spark, "x.unknown").count() == 1
    del pyramids.READERS["unknown"]
    assert pyramids.given_or_read(tiles, lambda: 1 / 0) is tiles


def test_rois_that_overlap_are_errors(spark):
    from tessera.operators import pyramid, rects

    apart = spark.createDataFrame([(0, 0, 4, 0, 4), (1, 5, 9, 0, 4)], "roi_index long, min_x long, max_x long, min_y long, max_y long")
    assert rects.checked_apart(apart).count() == 2
    with pytest.raises(Exception):
        rects.checked_apart(apart.union(spark.createDataFrame([(2, 4, 5, 4, 9)], apart.schema))).collect()
    levels = spark.createDataFrame([("p", 0, 100, 50)], "pyramid_id string, level int, dim_x long, dim_y long")
    assert pyramid.area_to_read(levels, 0, 90, -5, 20, 10).collect()[0][1:] == (90, 99, 0, 4)
    for x, y in ((100, 0), (0, 50), (-20, 0)):
        with pytest.raises(Exception):
            pyramid.area_to_read(levels, 0, x, y, 10, 10).collect()
    with pytest.raises(ValueError):
        pyramid.memory_read(spark.createDataFrame([(0, 1, 1, 5.0)], "level int, x long, y long, v double"), 1, (0, 1, 0, 1))
    read = pyramid.memory_read(spark.createDataFrame([(0, 1, 1, 5.0)], "level int, x long, y long, v double"), 0, (0, 1, 1, 1)).orderBy("x").collect()
    assert np.isnan(read[0].v) and read[1].v == 5.0
    with pytest.raises(Exception):
        levels.select(*pyramid.frame_size("dim_x", "dim_y", 64)).collect()


def test_delayed_pyramids(spark, tmp_path):
    from tessera.sources import image, pyramids

    (tmp_path / "a.png").write_bytes(image.png(np.zeros((4, 6, 3))))
    tiles = pyramids.open_pyramids(spark, str(tmp_path / "a.png"))
    late = pyramids.Delayed([(6, 4)])
    with pytest.raises(RuntimeError):
        late.tiles
    with pytest.raises(ValueError):
        pyramids.Delayed([(6, 5)]).set(tiles)
    late.set(tiles)
    assert pyramids.read_frames(late.tiles, 0, 3, 3).count() == 72


def test_pyramids_are_encoded_in_areas(spark):
    """The same bytes as of whole images; no group of pixels is larger than an area."""
    rng = np.random.default_rng(11)
    for big, predictor in ((False, True), (True, False)):
        images = [rng.integers(0, 255, (90 >> k, 70 >> k, 2)).astype(np.uint8) for k in range(3)]
        images[0][20:60, 16:50] = 0
        gap = lambda k, y, x: k == 0 and 20 <= y < 60 and 16 <= x < 50
        rows = [("a", k, c, x, y, int(m[y, x, c])) for k, m in enumerate(images) for y in range(m.shape[0]) for x in range(m.shape[1]) for c in range(2) if not gap(k, y, x)]
        px = spark.createDataFrame(rows, "name string, level int, channel int, x long, y long, v long")
        want = b""
        for m in images:
            want = tiff_codec.write(m, tile=16, predictor=predictor, big=big, before=want)
        made = tiff.encode_pyramids(px, "name", tile=16, area=32, predictor=predictor, big=big)
        assert "area_x" in made._jdf.queryExecution().toString()
        assert [bytes(r.content) for r in made.collect()] == [want]
