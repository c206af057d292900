"""TIFF files in Spark: directory tables, pixels and tiles from binary files, and a batch writer.

Files are read by Spark's own binaryFile source, so any store that Spark reaches will do; columns of bytes stay in their task.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from tessera.functions.scalars import floor_div
from tessera.sources import tiff_codec as codec

IFDS = "path string, valid boolean, ifd_index int, dim_x long, dim_y long, channels int, element_type string, tiled boolean, compression_code int, description string, tags map<string,string>, file_size long"
TILES = "path string, ifd_index int, tile_x long, tile_y long, min_x long, min_y long, w int, h int, channels int, element_type string, data binary"


def files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content", "length")


def tiff_info(found: DataFrame, mode: str = "PERMISSIVE") -> DataFrame:
    """A row for each directory; files that aren't TIFF give one row with valid = false, or fail in mode FAILFAST."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content, length in zip(pdf["path"], pdf["content"], pdf["length"], strict=True):
                try:
                    for i, d in enumerate(codec.directories(bytes(content))):
                        rows.append((path, True, i, d.width, d.height, d.channels, np.dtype(d.dtype).name, d.tiled, d.get("Compression", 1), d.description, d.as_map(), length))
                except codec.TiffError:
                    if mode == "FAILFAST":
                        raise
                    rows.append((path, False, None, None, None, None, None, None, None, None, None, length))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in "path valid ifd_index dim_x dim_y channels element_type tiled compression_code description tags file_size".split()])

    return found.mapInPandas(run, IFDS)


def all_ifds_json(info: DataFrame) -> DataFrame:
    """path, json: the directories of each file in order."""
    one = F.struct("ifd_index", "dim_x", "dim_y", "channels", "element_type", "tiled", "compression_code", "description")
    return info.where("valid").groupBy("path").agg(F.to_json(F.array_sort(F.collect_list(one))).alias("json"))


def tiff_tiles(found: DataFrame, ifd_index: int = 0, area: tuple[int, int, int, int] | None = None, mode: str = "FAILFAST") -> DataFrame:
    """The blocks of one directory that meet an area (x, y, w, h), decoded one at a time; data are values by rows, channels together, little-endian."""
    columns = "path ifd_index tile_x tile_y min_x min_y w h channels element_type data".split()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                raw = bytes(content)
                try:
                    d = codec.directories(raw)[ifd_index]
                    where = [b for b in codec.blocks(d, area) if b[1] == 0]
                except (codec.TiffError, IndexError):
                    if mode == "FAILFAST":
                        raise
                    continue
                bw, bh = d.block()
                rows, held = [], 0
                for _, _, x, y, w, h in where:
                    w, h = min(w, d.width - x), min(h, d.height - y)
                    part = codec.read(raw, d, (x, y, w, h))
                    rows.append((path, ifd_index, x // bw, y // bh, x, y, w, h, d.channels, part.dtype.name, part.tobytes()))
                    held += part.nbytes
                    if held >= 1 << 20:
                        yield pd.DataFrame(rows, columns=columns)
                        rows, held = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=columns)

    return found.select("path", "content").mapInPandas(run, TILES)


def converted(v: np.ndarray, channels: int, opaque: float = 255.0) -> np.ndarray:
    """Values (h, w, channels) with 1, 3 or 4 channels, 0 keeps them: 1 averages the first three, 3 or 4 repeat the first of fewer or add an opaque one."""
    if channels not in (0, 1, 3, 4):
        raise ValueError("1, 3 or 4 channels")
    n = v.shape[2]
    if not channels or (channels == n and n != 2):
        return v
    if channels == 1:
        return v[:, :, :3].astype(float).mean(2, keepdims=True) if n >= 3 else v[:, :, :1]
    rgb = v[:, :, :3] if n >= 3 else np.repeat(v[:, :, :1], 3, 2)
    return rgb if channels == 3 else np.concatenate([rgb, v[:, :, 3:4] if n >= 4 else np.full((*v.shape[:2], 1), opaque)], 2)


def tile_pixels(tiles: DataFrame, channels: int = 0, area: tuple[int, int, int, int] | None = None) -> DataFrame:
    """path, ifd_index, channel, x, y, v of tiles, with so many channels; a tile's channels are converted, and clipped to an area (x, y, w, h), where they are."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for t in pdf.itertuples(index=False):
                v = np.frombuffer(t.data, t.element_type).reshape(t.h, t.w, t.channels)
                x0, y0 = t.min_x, t.min_y
                if area:
                    left, top = max(0, area[0] - x0), max(0, area[1] - y0)
                    v = v[top : max(top, area[1] + area[3] - y0), left : max(left, area[0] + area[2] - x0)]
                    x0, y0 = x0 + left, y0 + top
                v = converted(v, channels)
                y, x, c = np.indices(v.shape)
                yield pd.DataFrame({"path": t.path, "ifd_index": t.ifd_index, "channel": c.ravel(), "x": x.ravel() + x0, "y": y.ravel() + y0, "v": v.ravel().astype(float)})

    return tiles.mapInPandas(run, "path string, ifd_index int, channel int, x long, y long, v double")


def tiff_read(found: DataFrame, ifd_index: int = 0, area: tuple[int, int, int, int] | None = None, channels: int = 0, mode: str = "FAILFAST") -> DataFrame:
    """Pixels of an area, clipped to the image; channels as in converted(). No shuffle: tiles become pixels in their task."""
    return tile_pixels(tiff_tiles(found, ifd_index, area, mode), channels, area)


def channel_convert(px: DataFrame, channels: int, opaque: float = 255.0) -> DataFrame:
    """Pixels (channel, v and others) with 1, 3 or 4 channels, for pixels that aren't in tiles: one aggregation, without lists."""
    if channels not in (1, 3, 4):
        raise ValueError("1, 3 or 4 channels")
    keys = [c for c in px.columns if c not in ("channel", "v")]
    of = lambda k: F.max(F.when(F.col("channel") == k, F.col("v"))).alias(f"c{k}_")
    packed = px.groupBy(*keys).agg(F.count("*").alias("n_"), *(of(k) for k in range(4)))
    many, c = F.col("n_") >= 3, [F.col(f"c{k}_") for k in range(4)]
    if channels == 1:
        out = F.array(F.when(many, (c[0] + c[1] + c[2]) / 3).otherwise(c[0]))
    else:
        rgb = [c[0], F.when(many, c[1]).otherwise(c[0]), F.when(many, c[2]).otherwise(c[0])]
        out = F.array(*rgb) if channels == 3 else F.array(*rgb, F.coalesce(c[3], F.lit(opaque)))
    return packed.select(*keys, F.posexplode(out).alias("channel", "v"))


def stored_tiles(found: DataFrame) -> DataFrame:
    """path, ifd_index, tile, n_bytes of every block that a file's directories hold; an empty one has no bytes."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                for i, d in enumerate(codec.directories(bytes(content))):
                    sizes = d.many("TileByteCounts") if d.tiled else d.many("StripByteCounts")
                    yield pd.DataFrame({"path": path, "ifd_index": i, "tile": range(len(sizes)), "n_bytes": [int(b) for b in sizes]})

    return found.select("path", "content").mapInPandas(run, "path string, ifd_index int, tile long, n_bytes long")


def write_statistics(found: DataFrame) -> DataFrame:
    """path, images, dim_x, dim_y (of the first image), tiles (stored ones), n_bytes (in them) of each file."""
    sizes = tiff_info(found).where("valid").groupBy("path").agg(F.count("*").alias("images"), F.max(F.when(F.col("ifd_index") == 0, F.col("dim_x"))).alias("dim_x"), F.max(F.when(F.col("ifd_index") == 0, F.col("dim_y"))).alias("dim_y"))
    return sizes.join(stored_tiles(found).groupBy("path").agg(F.count_if(F.col("n_bytes") > 0).alias("tiles"), F.sum("n_bytes").alias("n_bytes")), "path")


def incremental_tiles(arrivals: DataFrame, tile: int, width, height, flush: bool = True) -> DataFrame:
    """tile_x, tile_y, step, complete: when each tile of an image is written as its pixels (step, x, y) arrive. With flush a tile goes at the step that completes it; all others go at the last step."""
    t = F.lit(tile)
    w, h = (v if isinstance(v, Column) else F.lit(v) for v in (width, height))
    once = arrivals.groupBy("x", "y").agg(F.min("step").alias("step"))
    tiles = once.groupBy(floor_div("x", t).alias("tile_x"), floor_div("y", t).alias("tile_y")).agg(F.count("*").alias("n"), F.max("step").alias("done"))
    whole = F.col("n") == F.least(t, w - F.col("tile_x") * t) * F.least(t, h - F.col("tile_y") * t)
    end = arrivals.agg(F.max("step").alias("end"))
    return tiles.join(F.broadcast(end)).select("tile_x", "tile_y", F.when(whole & F.lit(flush), F.col("done")).otherwise(F.col("end")).alias("step"), whole.alias("complete"))


def encode_pyramids(px: DataFrame, key: str, element_type: str = "uint8", tile: int | None = 256, area: int = 512, **options) -> DataFrame:
    """key, content: one TIFF file for each pyramid of pixels (key, level, channel, x, y, v), a directory for each level.

    Tiles are encoded in groups of about area x area pixels; only their bytes come together in a pyramid's group. Without tiles (strips) a
    pyramid is one group of pixels.
    """
    if not tile:
        return _encode_whole(px, key, element_type, tile=tile, **options)
    kind, side = px.schema[key].dataType.simpleString(), tile * max(1, area // tile)
    encoding = {k: v for k, v in options.items() if k in ("compression", "predictor", "order")}
    sizes = px.groupBy(key, "level").agg(*((F.max(c) + 1).cast("long").alias(n) for c, n in (("x", "w_"), ("y", "h_"), ("channel", "c_"))))

    def tiles(pdf: pd.DataFrame) -> pd.DataFrame:
        channels, x, y = int(pdf["c_"].iloc[0]), pdf["x"].to_numpy(), pdf["y"].to_numpy()
        x0, y0 = int(x.min()) // tile * tile, int(y.min()) // tile * tile
        image = np.zeros(((int(y.max()) - y0) // tile * tile + tile, (int(x.max()) - x0) // tile * tile + tile, channels), element_type)
        image[y - y0, x - x0, pdf["channel"].to_numpy()] = pdf["v"].to_numpy().astype(element_type)
        rows = [((y0 + b) // tile, (x0 + a) // tile, codec.encode_block(image[b : b + tile, a : a + tile], **encoding)) for b in range(0, image.shape[0], tile) for a in range(0, image.shape[1], tile)]
        return pd.DataFrame(rows, columns=["tile_y", "tile_x", "data"]).assign(**{c: pdf[c].iloc[0] for c in (key, "level", "w_", "h_", "c_")})

    def file(pdf: pd.DataFrame) -> pd.DataFrame:
        content = b""
        for _, part in pdf.groupby("level"):
            w, h, c = (int(part[n].iloc[0]) for n in ("w_", "h_", "c_"))
            found = dict(zip(zip(part["tile_y"].tolist(), part["tile_x"].tolist(), strict=True), part["data"].tolist(), strict=True))
            empty = codec.encode_block(np.zeros((tile, tile, c), element_type), **encoding)
            rows = (found.get((b, a), empty) for b in range(-(-h // tile)) for a in range(-(-w // tile)))
            content = codec.assemble(rows, w, h, c, np.dtype(element_type), tile=tile, before=content, **options)
        return pd.DataFrame({key: [pdf[key].iloc[0]], "content": [content]})

    level = px.schema["level"].dataType.simpleString()
    sized = px.join(F.broadcast(sizes), [key, "level"]).select(key, "level", "channel", "x", "y", "v", "w_", "h_", "c_")
    encoded = sized.groupBy(key, "level", floor_div("x", F.lit(side)).alias("area_x"), floor_div("y", F.lit(side)).alias("area_y")).applyInPandas(tiles, f"tile_y long, tile_x long, data binary, {key} {kind}, level {level}, w_ long, h_ long, c_ long")
    return encoded.groupBy(key).applyInPandas(file, f"{key} {kind}, content binary")


def _encode_whole(px: DataFrame, key: str, element_type: str, **options) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        content = b""
        for _, part in pdf.groupby("level"):
            image = np.zeros((int(part["y"].max()) + 1, int(part["x"].max()) + 1, int(part["channel"].max()) + 1), element_type)
            image[part["y"], part["x"], part["channel"]] = part["v"].astype(element_type)
            content = codec.write(image, before=content, **options)
        return pd.DataFrame({key: [pdf[key].iloc[0]], "content": [content]})

    return px.groupBy(key).applyInPandas(run, f"{key} {px.schema[key].dataType.simpleString()}, content binary")


def encode_images(px: DataFrame, key: str, element_type: str = "uint8", **options) -> DataFrame:
    """key, content: one TIFF file for each image of pixels (key, channel, x, y, v)."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        image = np.zeros((int(pdf["y"].max()) + 1, int(pdf["x"].max()) + 1, int(pdf["channel"].max()) + 1), element_type)
        image[pdf["y"], pdf["x"], pdf["channel"]] = pdf["v"].astype(element_type)
        return pd.DataFrame({key: [pdf[key].iloc[0]], "content": [codec.write(image, **options)]})

    return px.groupBy(key).applyInPandas(run, f"{key} {px.schema[key].dataType.simpleString()}, content binary")


class _Commit(WriterCommitMessage):
    def __init__(self, paths: list[str], sizes: list[int]):
        self.paths, self.sizes = paths, sizes


class TiffWriter(DataSourceWriter):
    """Writes rows (name, content) as files: each task into a folder of the job's own, from which they are moved on commit. What failed tasks left goes with that folder, on commit as on abort. Two rows of one name are an error."""

    def __init__(self, folder: str, delete_on_error: bool):
        self.folder, self.delete, self.job = folder, delete_on_error, f"_job-{uuid.uuid4().hex}"

    def _fs(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.folder) if "://" in self.folder else (fs.LocalFileSystem(), self.folder)

    def write(self, rows) -> WriterCommitMessage:
        store, root = self._fs()
        own = f"{root}/{self.job}/{uuid.uuid4().hex}"
        store.create_dir(own, recursive=True)
        paths, sizes = [], []
        for name, content in rows:
            path = f"{own}/{name}"
            if path in paths:
                raise ValueError(f"two files are named {name}")
            with store.open_output_stream(path) as f:
                f.write(bytes(content))
            paths.append(path)
            sizes.append(len(content))
        return _Commit(paths, sizes)

    def commit(self, messages) -> None:
        store, root = self._fs()
        paths = [p for m in filter(None, messages) for p in m.paths]
        names = [p.rsplit("/", 1)[1] for p in paths]
        if len(set(names)) != len(names):
            raise ValueError("two files have one name")
        for p, name in zip(paths, names, strict=True):
            store.move(p, f"{root}/{name}")
        store.delete_dir(f"{root}/{self.job}") if paths else None

    def abort(self, messages) -> None:
        from pyarrow import fs

        store, root = self._fs()
        if self.delete and store.get_file_info(f"{root}/{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/{self.job}")


class TiffDataSource(DataSource):
    """df.write.format("tiff").mode("append").save(folder) for a DataFrame (name string, content binary)."""

    @classmethod
    def name(cls) -> str:
        return "tiff"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return TiffWriter(self.options["path"], self.options.get("deletefileonerror", "true") == "true")
